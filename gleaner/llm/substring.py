"""Substring deduplication with difference-cover anchors.

Two equal windows of W words need not start at like positions, but for every two
residues modulo the period v there is a shift below v that takes both into the
cover. So equal windows share an anchor: a window of W - v + 1 words at a cover
position of its own text. Only anchors are shuffled; where one occurs twice, the
full windows around it are hashed and counted. No pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table, wrapped
from gleaner.llm.words import slices, window_hashes
from gleaner.runtime import Scratch, ship_code

WINDOW = 35
#: A perfect difference set, each non-zero residue modulo 21 being one difference.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def _anchors(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text long enough: (text in slice, position, hash) at cover positions."""
    length = window - PERIOD + 1
    n = len(words.hashes)
    at = np.arange(n) - np.repeat(words.first[:-1], words.counts)
    size = np.repeat(words.counts, words.counts)
    in_cover = np.zeros(PERIOD, dtype=bool)
    in_cover[list(COVER)] = True
    pick = np.flatnonzero(in_cover[at % PERIOD] & (size >= window) & (at + length <= size))
    text = np.repeat(np.arange(len(words.rows)), words.counts)[pick]
    return text, at[pick], window_hashes(words.hashes, length)[pick] if len(pick) else np.zeros(0, np.uint64)


def _marked_runs(positions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of length n that covers [p, p + width) for each position, cut to [0, n)."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.clip(positions, 0, n), 1)
    np.add.at(steps, np.clip(positions + width, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if x.values is None else x.values.to_numpy().astype(np.int64) for x in column]


def _cut(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Results of a batch (text_key, text, copies, windows), a slice at a time, so that no batch of texts is held twice."""
    copies, gone = batch.column("copies").to_numpy(), _lists(batch.column("windows"))
    for words in slices(batch.column("text")):
        rows: list[tuple] = []
        own = batch.slice(words.rows.start, len(words.rows))
        for k, row in enumerate(words.rows):
            low, n = int(words.first[k]), int(words.counts[k])
            span = words.starts[low : low + n], words.ends[low : low + n]
            removed = np.ones(n, dtype=bool) if copies[row] > 1 and n >= window else _marked_runs(gone[row], window, n)
            kept = b" ".join(words.data[a:b].tobytes() for a, b in zip(span[0][~removed], span[1][~removed], strict=True))
            lost = int(removed.sum())
            rows.append((n, lost, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if lost else None))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        made[3] = pa.array([t if r is None else r for r, t in zip(columns[3], own.column("text").to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([own.column("text_key").cast(pa.binary()), *made], names=["text_key", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Results by text, and the rows of ``docs`` reduced to (doc_id, text_key).

    The first has one row per distinct text: text_key, n_words, n_removed,
    kept_sha256 and kept_text. A word goes if a window of ``window`` words that
    covers it also starts anywhere else, in the same or another document. The kept
    words are joined by one space; a text that loses nothing stays as it is.

    Equal texts are looked at once: with two copies every window occurs twice, so
    a copied text of ``window`` words or more loses all. Null texts have a null
    key and no result; empty and short texts lose nothing. Repeated rows and
    repeated or null doc_ids change nothing but the copies. Other columns are not
    looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "substring")
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    texts = docs.where(F.col("text").isNotNull()).select(key.alias("text_key"), "text")
    texts = texts.groupBy("text_key").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = scratch.write(texts.withColumn("tid", F.monotonically_increasing_id()))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tid").to_numpy()
            for words in slices(batch.column("text")):
                text, at, h = _anchors(words, window)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text + words.rows.start]), pa.array(at.astype(np.int32))], names=["h", "tid", "at"])

    found = texts.select("tid", "text").mapInArrow(anchors, "h long, tid long, at int")
    # Tables of their own, so that both sides of each join are plain shuffles: a hot
    # key's rows can then be split, and the counts' shuffle is gone before the join's.
    repeated = scratch.write(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("_h")))
    hits = found.join(repeated, F.col("h") == F.col("_h"), "left_semi").select("tid", "at")
    hits = scratch.write(hits.groupBy("tid").agg(F.collect_list("at").alias("hits")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, near = batch.column("tid").to_numpy(), _lists(batch.column("hits"))
            for words in slices(batch.column("text")):
                one, two = (window_hashes(words.hashes, window, k) for k in (0, 1))
                picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for k, row in enumerate(words.rows):
                    low, n = int(words.first[k]), int(words.counts[k]) - window + 1
                    if n > 0:
                        at = np.flatnonzero(_marked_runs(near[row] - (PERIOD - 1), PERIOD, n))
                        picked.append((low + at, np.full(len(at), ids[row]), at.astype(np.int32)))
                if picked:
                    where, tid, at = (np.concatenate(c) for c in zip(*picked, strict=True))
                    columns = [pa.array(one[where].view(np.int64)), pa.array(two[where].view(np.int64)), pa.array(tid), pa.array(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "tid", "at"])

    near = texts.select("tid", "text").join(hits, "tid").mapInArrow(windows, "w1 long, w2 long, tid long, at int")
    near = scratch.write(near)
    twice = scratch.write(near.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w1").alias("_1"), F.col("w2").alias("_2")))
    double = near.join(twice, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2")), "left_semi")
    double = scratch.write(double.groupBy("tid").agg(F.collect_list("at").alias("windows")))
    scratch.drop(hits, near, repeated, twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, window)

    joined = texts.join(double, "tid", "left").select("text_key", "text", "copies", "windows")
    results = joined.mapInArrow(cut, "text_key binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return results, docs.select("doc_id", key.alias("text_key"))


def remove_repeats_from(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents themselves with repeated windows cut out of ``text``; same columns."""
    results, _ = remove_repeats(docs, window)
    changed = results.where("n_removed > 0").select(F.col("text_key").alias("_key"), F.col("kept_text").alias("_kept"))
    rows = wrapped(docs, F.unhex(F.md5(F.col("text").cast("binary"))).alias("_own"))
    joined = rows.join(changed, F.col("_own") == F.col("_key"), "left")
    new = F.when(F.col("_key").isNotNull(), F.col("_kept")).otherwise(F.col("row.text"))
    return joined.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_cut_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = Scratch(spark, "substring-out").write(results.drop("kept_text"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(digest.withColumnRenamed("text_key", "_key"), F.col("text_key") == F.col("_key"), "left").select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", empty).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM docs WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY md5(win)) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM twice),
word AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
