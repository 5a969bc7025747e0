"""Session helpers: a shared scratch area for cutting lineage, and distributed ranks.

Everything heavy that a plan uses more than once is written as Parquet to the
folder that the session names in ``spark.checkpoint.dir``; executors share that
folder, so a lost executor costs a task retry and never a lost block.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOW_BITS = 33  # monotonically_increasing_id: partition above, row index below


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only where that is unset and the master
    is a local one (tests, a laptop) a temporary folder is made and recorded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set SQL settings for the length of a block. Names use ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Named Parquet tables of one query in the shared folder.

    A table stays until ``drop`` or the end of the process, since results are
    lazy and read it when they run.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        app = f"{shared_root(spark)}/gleaner/{spark.sparkContext.applicationId}"
        self.base = f"{app}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _clean_at_exit(spark, app)

    def write(self, df: DataFrame) -> DataFrame:
        """Run ``df``, keep it as a table and return a scan of that table."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # shuffle files go once the table is there
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path  # type: ignore[attr-defined]
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no lazy result reads any more."""
        for table in tables:
            delete_path(self.spark, table._scratch_path)  # type: ignore[attr-defined]


_registered: set[str] = set()


def _clean_at_exit(spark: SparkSession, app: str) -> None:
    if app in _registered:
        return
    _registered.add(app)

    def clean() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete_path(spark, app)

    atexit.register(clean)


def with_rank(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Add ``name``: the row's place from 0, without gaps, in its group by ``order``.

    No task gets a whole group. Rows are laid out by range over (group, order),
    numbered inside each partition, and each partition's first place comes from
    the counts of the partitions before it: one small row per partition and group.
    """
    columns = df.columns
    laid = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    laid = scratch.write(laid.withColumn("_mid", F.monotonically_increasing_id()))
    place = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    laid = laid.withColumn("_part", F.shiftright("_mid", _LOW_BITS)).withColumn("_place", place)
    counts = laid.groupBy(*group, "_part").agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).drop("_n", "_low")
    right = starts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_start")
    match = F.col("_part") == F.col("_p")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = laid.join(right, match, "inner").withColumn(name, F.col("_place") + F.col("_start"))
    return out.select(*columns, name)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Spark serves the archive to executors itself, so nothing has to be installed
    or mounted on them.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-code-")) / "gleaner.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, f"gleaner/{file.relative_to(package).as_posix()}")
    spark.sparkContext.addPyFile(str(archive))
