"""Indexing a source: walk, diff by hash, chunk, embed, commit, maintain."""

from __future__ import annotations

from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.errors import EmbedderError, StaleSchemaError
from gleaner.functions import text as tx
from gleaner.operators import chunking, schema
from gleaner.operators.status import CHANGES
from gleaner.operators.store import Store, file_hashes
from gleaner.runtime import Scratch, ship_code
from gleaner.sources import files as fs
from gleaner.sources.config import SourceConfig

RESULT_SCHEMA = "path string, status string, chunk_count long, error string"


def make_chunks(changed: DataFrame, source: SourceConfig, embedder) -> DataFrame:
    """Rows of CHUNK_SCHEMA for files of (path, file_hash, text)."""
    files = changed.select(F.col("path").alias("source_path"), "file_hash", "text")
    chunks = chunking.chunk_files(files, source.frontmatter)
    chunks = chunks.withColumn("vector", embedder.embed_column(F.col("text"))).withColumn("kind", F.lit("text"))
    return chunks.withColumn("id", tx.chunk_id(F.col("source_path"), F.col("chunk_index"))).select(*schema.CHUNK_SCHEMA.names)


def _embedding_fault(error: Exception) -> str | None:
    """What an embedder said is wrong, also from within a task; None for any other error."""
    if not isinstance(error, PythonException):
        return str(error).strip() or type(error).__name__
    said = [line.partition("EmbedderError:") for line in str(error).splitlines()]
    return next((what.strip()[:500] or EmbedderError.__name__ for _, mark, what in said if mark), None)


def index_source(store: Store, source: SourceConfig, embedder, force: bool = False) -> list[dict]:
    """Bring a source's table up to date; one result per file that was looked at.

    Files whose bytes are as stored are left alone unless ``force``. Oversize and
    unreadable files keep their old rows, as do all files if embedding fails, which
    is then their error. Files that are gone lose their rows. All changes go into
    one new version; a run without changes writes none.
    """
    spark = store.spark
    ship_code(spark)
    if store.stale([source.name]):
        if not force:
            raise StaleSchemaError(f"table {source.name!r} lacks columns; index it with force")
        store.recreate(source.name)
    store.ensure(source.name)
    scratch = Scratch(spark, "index")
    walked = fs.walk(spark, source.path, source.ignore, source.respect_gitignore)
    stored = file_hashes(store.table(source.name)).select(F.col("source_path").alias("path"), F.col("file_hash").alias("_old"))
    loaded = fs.read_files(walked.where(~F.col("oversize")).select("path")).join(stored, "path", "left")
    same = F.lit(not force) & F.coalesce(F.col("file_hash") == F.col("_old"), F.lit(False))
    state = F.when(F.col("error").isNotNull(), "skipped_unreadable").when(same, "unchanged").otherwise("changed")
    loaded = scratch.write(loaded.select("path", "file_hash", F.when(~same, F.col("text")).alias("text"), "error", state.alias("state")))
    changed = loaded.where("state = 'changed'")
    vanished = stored.join(walked.select("path"), "path", "left_anti").select("path")

    failed: str | None = None
    counts = spark.createDataFrame([], "path string, n long")
    try:
        chunks = scratch.write(make_chunks(changed, source, embedder))
        counts = chunks.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
        schema.check_width(chunks, store.dim)
    except (EmbedderError, PythonException, ValueError) as e:  # the service or its vectors; old rows stay
        failed = _embedding_fault(e)
        if failed is None:
            raise
    outcome = changed.select("path").join(counts, "path", "left").select(
        "path", F.lit("error").alias("status") if failed else F.when(F.col("n").isNull(), "empty").otherwise("embedded").alias("status"),
        F.coalesce("n", F.lit(0)).alias("chunk_count"), F.lit(failed).cast("string").alias("error"))
    zero = F.lit(0).cast("long").alias("chunk_count")
    others = loaded.where("state <> 'changed'").select("path", F.col("state").alias("status"), zero, "error")
    large = walked.where("oversize").select("path", F.lit("skipped_oversize").alias("status"), zero, F.lit(None).cast("string").alias("error"))
    gone = vanished.select("path", F.lit("deleted").alias("status"), zero, F.lit(None).cast("string").alias("error"))
    results = scratch.write(outcome.unionByName(others).unionByName(large).unionByName(gone).orderBy("path"))
    rows = [r.asDict() for r in results.orderBy("path").toLocalIterator()]
    if any(r["status"] in CHANGES for r in rows):
        paths = results.where(F.col("status").isin(*CHANGES)).select(F.col("path").alias("source_path"))
        new = spark.createDataFrame([], schema.CHUNK_SCHEMA) if failed else chunks
        store.commit(source.name, new, paths)
        store.optimize(source.name)
    return rows
