"""Snapshot store: tables as lists of immutable parts, and a manifest that names them.

A change writes one part: its new rows, the postings of their texts, and the paths
or ids whose older rows it hides. It costs what has changed, not what is stored. A
version is a list of parts; a row is seen unless a later part of the list hides it.
When a version has gathered ``MERGE_AT`` parts, ``optimize`` writes one part in
their place. Parts never change once they are there, and manifests are numbered
files of which a number is taken once, so that readers never see half a change and
of two writers the second builds on the first. Paths go through Hadoop's file
systems and may be in any store Spark can reach.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.errors import StaleSchemaError, StoreError
from gleaner.operators import schema
from gleaner.operators.ranking import TermIndex, count_terms
from gleaner.operators.status import CHANGES, FAILURES
from gleaner.runtime import delete_path

log = logging.getLogger(__name__)

KEEP_RUNS = 24
#: Rows a file of a part should have, and parts of a version from which ``optimize`` merges them.
ROWS_PER_FILE, MERGE_AT = 200_000, 16
#: Manifests that are kept, for readers that have just looked the newest one up.
KEPT_MANIFESTS = 10
_FOREVER = timedelta(days=36_500)
_TERMS = "source_path string, id string, dl int, term string, tf long"
_GONE = "source_path string, id string"


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace rows of equal id and join the others."""
    return current.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def replace_files(current: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the given source_paths give way to ``new``, in one step."""
    return current.join(paths.select("source_path"), "source_path", "left_anti").select(*new.columns).unionByName(new)


def without_file(current: DataFrame, path: str) -> DataFrame:
    return current.where(~F.col("source_path").eqNullSafe(F.lit(path)))


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (id); repeated ids don't repeat rows."""
    return chunks.join(ids.select("id"), "id", "left_semi").select(*chunks.columns)


def file_hashes(chunks: DataFrame) -> DataFrame:
    """One hash per path; only these two columns are read."""
    return chunks.groupBy("source_path").agg(F.min("file_hash").alias("file_hash"))


def keep_since(history: list[str], keep_runs: int, now: datetime) -> timedelta:
    """Age beyond which versions may go.

    Nothing goes while the log has fewer runs than are to be kept, or where the
    time of the oldest kept run can't be read.
    """
    if keep_runs <= 0:
        return timedelta(0)
    if len(history) < keep_runs:
        return _FOREVER
    try:
        return max(timedelta(0), now - datetime.fromisoformat(history[-keep_runs]))
    except (ValueError, TypeError):
        log.warning("run log: %r is no time, keeping all versions", history[-keep_runs])
        return _FOREVER


class Files:
    """Small files in whatever store a path is in. Errors are raised as ``StoreError``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        at = self.hadoop.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> bytes | None:
        """What is in a file, or None if there is no such file. Any other trouble is an error."""
        try:
            at, fs = self._fs(path)
            stream = fs.open(at)
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "NoSuchFileException"):
                return None
            raise StoreError(f"could not read {path}: {e.java_exception}") from e

    def names(self, folder: str) -> list[str]:
        try:
            at, fs = self._fs(folder)
            return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        except Py4JJavaError as e:
            raise StoreError(f"could not list {folder}: {e.java_exception}") from e

    def write(self, path: str, content: bytes, replace: bool) -> bool:
        """Write beside and rename. Without ``replace``, False if there is such a file already."""
        try:
            at, fs = self._fs(path)
            beside = self.hadoop.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
            fs.mkdirs(at.getParent())
            stream = fs.create(beside, True)
            try:
                stream.write(bytearray(content))
            finally:
                stream.close()
            rename = getattr(self.hadoop, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.OVERWRITE if replace else rename.NONE
            try:
                self.hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(at), how)
            except Py4JJavaError as e:
                fs.delete(beside, False)
                if not replace and e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    return False
                raise
            return True
        except Py4JJavaError as e:
            raise StoreError(f"could not write {path}: {e.java_exception}") from e


class JsonFile:
    """A small JSON object beside the tables. Losing it loses a report, so it never stops a run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files, self.path = Files(spark), path

    def read(self) -> dict:
        try:
            value = json.loads(self.files.read(self.path) or b"{}")
        except (StoreError, ValueError) as e:
            log.warning("%s is not used: %s", self.path, e)
            return {}
        return value if isinstance(value, dict) else {}

    def write(self, value: dict) -> None:
        try:
            self.files.write(self.path, json.dumps(value, indent=2).encode("utf-8"), replace=True)
        except StoreError as e:
            log.warning("%s", e)


class Manifest:
    """Which versions each table has, as numbered files; the largest number holds.

    Tables are lost if this is, so nothing is taken for empty that can't be read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files, self.folder = Files(spark), folder

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        for _ in range(3):  # the one looked up may have been cleared away by then
            numbers = self._numbers()
            if not numbers:
                return 0, {}
            content = self.files.read(f"{self.folder}/{numbers[-1]}.json")
            if content is not None:
                try:
                    return numbers[-1], json.loads(content)
                except ValueError as e:
                    raise StoreError(f"{self.folder}/{numbers[-1]}.json is damaged: {e}") from e
        raise StoreError(f"{self.folder} has no manifest that can be read")

    def change(self, edit: Callable[[dict], dict | None], tries: int = 20) -> dict:
        """Apply ``edit`` to the newest state, again if someone was faster; None from it leaves all as it is."""
        for _ in range(tries):
            number, tables = self.read()
            new = edit(tables)
            if new is None:
                return tables
            if self.files.write(f"{self.folder}/{number + 1}.json", json.dumps(new, indent=2).encode("utf-8"), replace=False):
                for old in self._numbers()[:-KEPT_MANIFESTS]:
                    delete_path(self.files.spark, f"{self.folder}/{old}.json")
                return new
        raise StoreError(f"{self.folder}: others were faster {tries} times")


class Store:
    """Tables of one database."""

    def __init__(self, spark: SparkSession, db_path: str, dim: int, keep_runs: int = KEEP_RUNS, clock=lambda: datetime.now(UTC), merge_at: int = MERGE_AT) -> None:
        self.spark, self.db, self.dim, self.keep_runs, self.clock, self.merge_at = spark, str(db_path).rstrip("/"), dim, keep_runs, clock, merge_at
        self.manifest = Manifest(spark, f"{self.db}/manifest")
        self.run_log = JsonFile(spark, f"{self.db}/run_log.json")

    def _path(self, name: str, part: dict) -> str:
        return f"{self.db}/{name}/{part['part']}"

    def names(self) -> list[str]:
        return sorted(self.manifest.read()[1])

    def versions(self, name: str) -> list[int]:
        return [r["v"] for r in self.manifest.read()[1].get(name, {}).get("versions", [])]

    def parts(self, name: str, version: int | None = None) -> list[dict]:
        entry = self.manifest.read()[1][name]
        wanted = entry["current"] if version is None else version
        return next(r["parts"] for r in entry["versions"] if r["v"] == wanted)

    def ensure(self, name: str) -> None:
        """An empty table, unless there is one."""
        if name not in self.manifest.read()[1]:
            empty = self._write(name, self.spark.createDataFrame([], schema.CHUNK_SCHEMA), None)
            self.manifest.change(lambda have: None if name in have else self._with(have, name, [empty]))

    def _seen(self, name: str, parts: list[dict], read: Callable[[dict], DataFrame]) -> DataFrame:
        """Rows of all parts, but for those whose path or id a later part hides.

        Parts without rows are left out, and rows that no later part can hide are not joined.
        """
        hiding = [i for i, part in enumerate(parts) if part["hides"] and any(p.get("rows", 1) for p in parts[:i])]
        rows = {i: read(part) for i, part in enumerate(parts) if part.get("rows", 1)}
        if not rows:
            return read(parts[0])
        union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        safe = [df for i, df in rows.items() if not hiding or i >= hiding[-1]]
        open_ = [df.withColumn("_at", F.lit(i)) for i, df in rows.items() if hiding and i < hiding[-1]]
        if open_:
            left = reduce(union, open_)
            gone = reduce(union, (self.spark.read.schema(_GONE).parquet(f"{self._path(name, parts[i])}/gone").withColumn("_from", F.lit(i)) for i in hiding))
            for key in ("source_path", "id"):
                last = gone.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("_from").alias("_from"))
                left = left.join(last, (F.col(key) == F.col("_key")) & (F.col("_at") < F.col("_from")), "left_anti")
            safe = [left.drop("_at"), *safe]
        return reduce(union, safe)

    def raw(self, name: str, version: int | None = None) -> DataFrame:
        """A version in the columns that its parts were written with."""
        rows = lambda part: self.spark.read.schema(T.StructType.fromJson(part["schema"])).parquet(f"{self._path(name, part)}/rows")
        return self._seen(name, self.parts(name, version), rows)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The current version (looked up now), in today's columns."""
        return schema.read_chunks(self.raw(name, version))

    def by_ids(self, name: str, ids: list[str]) -> DataFrame:
        """The rows of a few ids; the ids are a filter of the scan."""
        return self.table(name).where(F.col("id").isin(*dict.fromkeys(ids)))

    def stale(self, names: list[str]) -> list[str]:
        """Tables of which a part that is still in use lacks columns."""
        have = self.manifest.read()[1]
        lacks = lambda part: set(schema.CHUNK_SCHEMA.names) - {f["name"] for f in part["schema"]["fields"]}
        return [n for n in names if n in have and any(map(lacks, self.parts(n)))]

    def _chosen(self, names: list[str] | None) -> list[str]:
        have = self.names()
        return have if names is None else [n for n in dict.fromkeys(names) if n in have]

    def corpus(self, names: list[str] | None = None) -> DataFrame:
        """All named tables with their source_name; names without a table are ignored."""
        out = self.spark.createDataFrame([], schema.CHUNK_SCHEMA).where(F.lit(False)).withColumn("source_name", F.lit(""))  # the planner drops it
        for name in self._chosen(names):
            out = out.unionByName(self.table(name).withColumn("source_name", F.lit(name)), allowMissingColumns=True)
        return out

    def terms(self, names: list[str] | None = None) -> TermIndex:
        """The postings of ``corpus(names)``, as written with its rows; a query's words reach their scan."""
        out = self.spark.createDataFrame([], _TERMS).where(F.lit(False)).withColumn("source_name", F.lit(""))
        for name in self._chosen(names):
            read = lambda part, n=name: self.spark.read.schema(_TERMS).parquet(f"{self._path(n, part)}/terms")
            out = out.unionByName(self._seen(name, self.parts(name), read).withColumn("source_name", F.lit(name)))
        return TermIndex.over(out)

    def counts(self) -> dict[str, int]:
        return {n: self.raw(n).count() for n in self.names()}

    def commit(self, name: str, new: DataFrame, gone: DataFrame) -> None:
        """One version in which ``new`` replaces all rows of the source_paths in ``gone``."""
        if self.stale([name]):
            raise StaleSchemaError(f"table {name!r} lacks columns; index it with force")
        schema.check_width(new, self.dim)
        self._commit(name, new.select(*schema.CHUNK_SCHEMA.names), gone.select("source_path", F.lit(None).cast("string").alias("id")))

    def upsert(self, name: str, new: DataFrame) -> None:
        if new.isEmpty():
            return
        schema.check_width(new, self.dim)
        self._commit(name, new.select(*schema.CHUNK_SCHEMA.names), new.select(F.lit(None).cast("string").alias("source_path"), "id"))

    def delete_file(self, name: str, path: str) -> int:
        """Remove a file's rows and say how many there were."""
        n = self.table(name).where(F.col("source_path") == F.lit(path)).count()
        if n:
            self._commit(name, self.spark.createDataFrame([], schema.CHUNK_SCHEMA), self.spark.createDataFrame([(path, None)], _GONE))
        return n

    def recreate(self, name: str) -> None:
        """An empty table in place of the old one; the run log forgets it."""
        self.manifest.change(lambda have: {n: e for n, e in have.items() if n != name} if name in have else None)
        delete_path(self.spark, f"{self.db}/{name}")
        runs = self.run_log.read()
        if runs.pop(name, None) is not None:
            self.run_log.write(runs)
        self.ensure(name)

    def _write(self, name: str, rows: DataFrame, gone: DataFrame | None) -> dict:
        """Write a part that no version names yet. Postings are sorted, so that a search skips most of them."""
        part = {"part": f"part={uuid.uuid4().hex[:16]}", "schema": rows.schema.jsonValue(), "hides": gone is not None}
        path = self._path(name, part)
        rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{path}/rows")
        part["rows"] = written.count()
        terms = count_terms(written, ["source_path", "id"]).select("source_path", "id", "dl", "term", "tf")
        terms.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        if gone is not None:
            gone.select("source_path", "id").distinct().write.parquet(f"{path}/gone")
        return part

    def _with(self, have: dict, name: str, parts: list[dict]) -> dict:
        """The state with one more version of a table."""
        entry = have.get(name, {"versions": []})
        version = max([r["v"] for r in entry["versions"]], default=0) + 1
        return have | {name: {"current": version, "versions": [*entry["versions"], {"v": version, "at": self.clock().isoformat(), "parts": parts}]}}

    def _commit(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        part = self._write(name, rows, gone)

        def add(have: dict) -> dict:
            entry = have.get(name)
            before = next(r["parts"] for r in entry["versions"] if r["v"] == entry["current"]) if entry else []
            return self._with(have, name, [*before, part])

        self.manifest.change(add)

    def merge(self, name: str) -> None:
        """One part in place of all; dropped if someone else has changed the table meanwhile."""
        before = self.parts(name)
        part = self._write(name, self.raw(name), None)
        kept = []

        def swap(have: dict) -> dict | None:
            entry = have.get(name)
            now = next(r["parts"] for r in entry["versions"] if r["v"] == entry["current"]) if entry else None
            if now != before:
                return None
            kept.append(part)
            return self._with(have, name, [part])

        self.manifest.change(swap)
        if not kept:
            delete_path(self.spark, self._path(name, part))

    def optimize(self, name: str, keep_runs: int | None = None) -> None:
        """Merge parts, remove versions older than the kept runs, then note that a run has ended.

        The current version always stays, and so does the state at the start of
        the oldest kept run. Parts go once no version in the manifest names them,
        and only after that manifest is written.
        """
        if len(self.parts(name)) >= self.merge_at:
            self.merge(name)
        keep = self.keep_runs if keep_runs is None else keep_runs
        runs = self.run_log.read()
        history = [t for t in runs.get(name, []) if isinstance(t, str)] if isinstance(runs.get(name), list) else []
        now = self.clock()
        age, dropped = keep_since(history, keep, now), []

        def prune(have: dict) -> dict | None:
            entry = have[name]
            old = [r for r in entry["versions"] if now - datetime.fromisoformat(r["at"]) > age and r["v"] != entry["current"]]
            dropped[:] = old if age == timedelta(0) else old[:-1]
            return have | {name: entry | {"versions": [r for r in entry["versions"] if r not in dropped]}} if dropped else None

        left = self.manifest.change(prune)
        used = {p["part"] for r in left[name]["versions"] for p in r["parts"]}
        for part in {p["part"] for r in dropped for p in r["parts"]} - used:
            delete_path(self.spark, f"{self.db}/{name}/{part}")
        runs[name] = [*history, now.isoformat()][-(max(keep, 0) + 1) :]
        self.run_log.write(runs)


class FreshnessLog:
    """When each source was last tried, run and changed, and what failed."""

    FIELDS = ("last_attempt", "last_run", "last_change", "last_error", "embedding_model", "failures")

    def __init__(self, spark: SparkSession, db_path: str, clock=lambda: datetime.now(UTC)) -> None:
        self.file, self.clock = JsonFile(spark, f"{str(db_path).rstrip('/')}/freshness.json"), clock

    def read(self) -> dict[str, dict]:
        return {n: r for n, r in self.file.read().items() if isinstance(r, dict) and all(f in r for f in self.FIELDS)}

    def record_run(self, name: str, results: list[dict], embedding_model: str) -> None:
        now, all_ = self.clock().isoformat(), self.read()
        changed = any(r["status"] in CHANGES for r in results)
        groups: dict[str, dict] = {}
        for r in results:
            if r["status"] in FAILURES:
                what = r.get("error") or r["status"]
                groups.setdefault(what, {"error": what, "count": 0, "example_path": r["path"]})["count"] += 1
        before = all_.get(name, {}).get("last_change")
        all_[name] = {"last_attempt": now, "last_run": now, "last_change": now if changed else before, "last_error": None,
                      "embedding_model": embedding_model, "failures": list(groups.values())}
        self.file.write(all_)

    def record_error(self, names: list[str], error: str) -> None:
        now, all_ = self.clock().isoformat(), self.read()
        blank = dict.fromkeys(self.FIELDS) | {"failures": []}
        for name in names:
            all_[name] = all_.get(name, blank) | {"last_attempt": now, "last_error": error}
        self.file.write(all_)
