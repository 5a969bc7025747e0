"""Registered queries over the test tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import frontmatter as fm
from gleaner.functions import text as tx
from gleaner.functions import vectors as vx
from gleaner.operators import chunking, embedding, evaluation, ranking, schema, status, store
from gleaner.plans.corpus import RANKINGS, VIEWS, benchmark_queries, corpus, files, notes, spans_sql, table
from gleaner.runtime import Scratch, ship_code
from gleaner.sources import files as fs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


@_query(VIEWS + "SELECT source_path, file_hash FROM files")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("source_path", "file_hash")


@_query(VIEWS + "SELECT source_path, min(file_hash) AS file_hash FROM (FROM files UNION ALL FROM files) GROUP BY ALL")
def file_hashes_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = files(spark, sf_dir)
    return store.file_hashes(chunks.unionByName(chunks))


_EXT = {"en": ".md", "fr": ".TXT", "de": ".py", "es": ".bin"}


@_query(VIEWS + """, walked AS (
  SELECT CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.py' ELSE '.bin' END AS ext, octet_length(encode(text)) AS size FROM documents)
SELECT ext, size >= 5000 AS oversize, count(*) AS n FROM walked WHERE ext <> '.bin' GROUP BY ALL""")
def walk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _EXT.items()], F.lit(".bin"))
    docs = table(spark, sf_dir, "documents")
    walked = docs.select(F.concat(F.col("doc_id").cast("string"), named).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return fs.eligible(walked, max_bytes=5000).groupBy("ext", "oversize").agg(F.count(F.lit(1)).alias("n"))


@_query(VIEWS + r""", p AS (SELECT source_path AS path FROM files)
SELECT path FROM p WHERE NOT (CASE WHEN regexp_matches(path, '^src10/5.*\.txt$') THEN FALSE WHEN regexp_matches(path, '^src1[^/]*/') THEN TRUE
  WHEN regexp_matches(path, '(^|/)[^/]*7\.txt$') THEN TRUE ELSE FALSE END)""")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = files(spark, sf_dir).select(F.col("source_path").alias("path"))
    return paths.where(~fs.ignored(F.col("path"), ["*7.txt", "/src1*/**", "!src10/5*.txt"]))


@_query(VIEWS + r""", l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM files)),
ended AS (SELECT doc_id, i, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS line FROM l)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
  CAST(length(line) AS INTEGER) AS n_chars FROM ended WHERE line <> ''""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = files(spark, sf_dir).select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "line_no", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).alias("char_start"), F.length("line").alias("n_chars"))


_CODE_PARTS = r""", l AS (SELECT source_path AS doc, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i < len(string_split(text, chr(10))) THEN x || chr(10) ELSE x END) AS a FROM files WHERE text <> ''),
lines AS (SELECT doc, CASE WHEN a[-1] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM l),
win AS (SELECT doc, a, unnest(generate_series(0, CASE WHEN len(a) <= 60 THEN 0 ELSE CAST(ceil((len(a) - 60) / 50.0) AS BIGINT) END)) AS part FROM lines),
parts AS (SELECT doc, part, length(array_to_string(a[1 : part * 50], '')) AS off, array_to_string(a[part * 50 + 1 : part * 50 + 60], '') AS t FROM win)
"""
_CHUNKS = "SELECT doc AS source_path, CAST(row_number() OVER (PARTITION BY doc ORDER BY part, s) - 1 AS BIGINT) AS chunk_index, CAST(off + s AS BIGINT) AS char_start, CAST(off + e AS BIGINT) AS char_end, {more}sha256(t[s + 1 : e]) AS text_hash FROM spans"


def _digest(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("source_path", "chunk_index", "char_start", "char_end", *more, F.sha2("text", 256).alias("text_hash"))


@_query(VIEWS + _CODE_PARTS + spans_sql(24_000, 0) + _CHUNKS.format(more=""))
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(chunking.chunk_code(files(spark, sf_dir)))


_NOTE_PARTS = r""", turns AS (SELECT conv_id, turn, role, '## ' || role || chr(10) || text || chr(10) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS part FROM conversations),
sections AS (
  SELECT conv_id, 0 AS part, '/conv ' || conv_id AS path, '# conv ' || conv_id || chr(10) AS t FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, part, '/conv ' || conv_id || '/' || role, t FROM turns),
parts AS (
  SELECT 'conv/' || conv_id || '.md' || chr(9) || path AS doc, part, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, t FROM sections)
"""
_NOTE_CHUNKS = r"""SELECT string_split(doc, chr(9))[1] AS source_path, string_split(doc, chr(9))[2] AS heading_path,
  CAST(row_number() OVER (PARTITION BY string_split(doc, chr(9))[1] ORDER BY part, s) - 1 AS BIGINT) AS chunk_index,
  CAST(off + s AS BIGINT) AS char_start, CAST(off + e AS BIGINT) AS char_end, sha256(t[s + 1 : e]) AS text_hash FROM spans"""


@_query(VIEWS + _NOTE_PARTS + spans_sql(1_200, 150) + _NOTE_CHUNKS)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(chunking.chunk_markdown(notes(spark, sf_dir)), "heading_path")


@_query(VIEWS + ", parts AS (SELECT source_path AS doc, 0 AS part, 0 AS off, text AS t FROM files WHERE text <> '')" + spans_sql(1_200, 150) + _CHUNKS.format(more=""))
def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = files(spark, sf_dir).where("text <> ''")
    rows = whole.select("source_path", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_at"), F.col("text").alias("_t"))
    return _digest(chunking.split_oversized(rows, 1_200, 150))


@_query("SELECT 'code' AS kind, CAST(0 AS BIGINT) AS mismatches UNION ALL SELECT 'markdown', 0")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are not the substring between their offsets."""

    def bad(chunks: DataFrame, source: DataFrame, kind: str) -> DataFrame:
        both = chunks.join(source.select("source_path", F.col("text").alias("whole")), "source_path")
        again = F.expr("substring(whole, int(char_start) + 1, int(char_end - char_start))")
        return both.agg(F.count_if(again != F.col("text")).alias("mismatches")).select(F.lit(kind).alias("kind"), "mismatches")

    texts, md = files(spark, sf_dir), notes(spark, sf_dir)
    return bad(chunking.chunk_code(texts), texts, "code").unionByName(bad(chunking.chunk_markdown(md), md, "markdown"))


_BLOCKS = [
    (0, "created: 2026-01-02\nupdated: 2026-10-19"), (1, "updated: 2026-13-40\ncreated: 2026-01-02"), (2, "created: 2026-10-1999"),
    (3, "status: 'Draft'\ntags: [#alpha, #beta]"), (4, 'status: " Draft "\ntags: "#a, b c, a"'), (5, "status:\n- a\ntags:\n- '#x'\n- y # why"),
    (6, "tags: #alpha"), (7, 'tags: ["a, b", c]'), (8, "status: |\n  more\ncreated: 2026-10-19T09:30"), (9, "no key here"), (10, "Review (Q3): x\nstatus: ok"),
]


@_query("""SELECT * FROM (VALUES
  (0, '2026-10-19', NULL, '', FALSE), (1, '2026-01-02', NULL, '', FALSE), (2, NULL, NULL, '', FALSE), (3, NULL, 'Draft', 'alpha|beta', FALSE),
  (4, NULL, 'Draft', 'a|b|c', FALSE), (5, NULL, NULL, 'x|y', FALSE), (6, NULL, NULL, '', FALSE), (7, NULL, NULL, 'a, b|c', FALSE),
  (8, '2026-10-19', NULL, '', FALSE), (9, NULL, NULL, '', TRUE), (10, NULL, 'ok', '', FALSE)) t(n, note_date, status, tags, warned)""")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\n"), F.col("block"), F.lit("\n---\n# Title\n"))
    rows = spark.createDataFrame(_BLOCKS, "n int, block string").select("n", fm.parse_column(fm.fence_block(text)).alias("m"))
    return rows.select("n", F.date_format("m.note_date", "yyyy-MM-dd").alias("note_date"), "m.status", F.array_join("m.tags", "|").alias("tags"), F.col("m.warning").isNotNull().alias("warned"))


_STORED = """, stored AS (
  SELECT source_path AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE file_hash END AS hash FROM files WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'gone/' || doc_id, file_hash FROM files WHERE doc_id % 13 = 0)"""


def _stored(now: DataFrame) -> DataFrame:
    kept = now.where("doc_id % 10 <> 0").select(F.col("source_path").alias("path"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("file_hash")).alias("hash"))
    gone = now.where("doc_id % 13 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"), F.col("file_hash").alias("hash"))
    return kept.unionByName(gone)


@_query(VIEWS + _STORED + """
SELECT coalesce(f.source_path, s.path) AS path, CASE WHEN f.source_path IS NULL THEN 'deleted' WHEN octet_length(encode(text)) >= 30000 THEN 'skipped_oversize'
  WHEN f.file_hash = s.hash THEN 'unchanged' WHEN s.path IS NULL THEN 'new' ELSE 'changed' END AS action
FROM files f FULL JOIN stored s ON f.source_path = s.path""")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir)
    seen = now.select(F.col("source_path").alias("path"), F.col("file_hash").alias("hash"), (F.octet_length("text") >= 30_000).alias("oversize"))
    return status.diff_files(seen, _stored(now))


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a table that hold all files between them: some are in both, some have gone, some are new."""
    rows = files(spark, sf_dir).select(tx.chunk_id(F.col("source_path"), F.lit(0)).alias("id"), "source_path", "file_hash", "doc_id")
    old = rows.where("doc_id % 3 <> 0").withColumn("file_hash", F.lit("old"))
    return old.drop("doc_id"), rows.where("doc_id % 2 = 0 or doc_id % 3 = 0").drop("doc_id")


_OLD_NEW = """, old AS (SELECT source_path || '::0' AS id, source_path, 'old' AS file_hash FROM files WHERE doc_id % 3 <> 0),
fresh AS (SELECT source_path || '::0' AS id, source_path, file_hash FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
"""


@_query(VIEWS + _OLD_NEW + "SELECT * FROM old ANTI JOIN fresh USING (id) UNION ALL SELECT * FROM fresh")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_old_and_new(spark, sf_dir))


@_query(VIEWS + _OLD_NEW + "SELECT * FROM old ANTI JOIN fresh USING (source_path) UNION ALL SELECT * FROM fresh")
def replace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    return store.replace_files(old, new.select("source_path").distinct(), new)


@_query(VIEWS + "SELECT source_path || '::0' AS id, source_path, file_hash FROM files WHERE source_path <> 'src1/1.txt'")
def delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(tx.chunk_id(F.col("source_path"), F.lit(0)).alias("id"), "source_path", "file_hash")
    return store.without_file(rows, "src1/1.txt")


@_query(VIEWS + """SELECT source_path || '::0' AS id, file_hash FROM files WHERE source_path || '::0' IN ('src1/1.txt::0', 'src2/2.txt::0', 'absent')
  OR file_hash IN (SELECT max(file_hash) FROM files GROUP BY source_name)""")
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few ids, one of them twice and one unknown, and those of each source's greatest hash."""
    rows = files(spark, sf_dir).select(tx.chunk_id(F.col("source_path"), F.lit(0)).alias("id"), "source_name", "file_hash")
    few = spark.createDataFrame([("src1/1.txt::0",), ("src1/1.txt::0",), ("src2/2.txt::0",), ("absent",)], "id string")
    most = rows.select("file_hash").join(rows.groupBy("source_name").agg(F.max("file_hash").alias("file_hash")).select("file_hash").distinct(), "file_hash", "left_semi")
    ids = few.unionByName(rows.join(most.distinct(), "file_hash", "left_semi").select("id"))
    return store.by_ids(rows, ids).select("id", "file_hash")


@_query(VIEWS + """, life AS (SELECT source_path, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS state FROM files)
SELECT source_path || '::0' AS id, source_path, state FROM life WHERE state > 0""")
def index_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, changed by file, by id and by a deletion of files, then merged: what is seen at the end.

    Of all files those that 3 divides are replaced, of the rest those that 5 divides
    are updated by id, and of what is left then those that 7 divides are taken out.
    """
    db = Scratch(spark, "life").base
    rows = files(spark, sf_dir)
    blank = F.array().cast("array<string>").alias("tags")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)

    def chunks(where: str, state: int) -> DataFrame:
        length = F.length("text").cast("long")
        zero = lambda name: F.lit(0).cast("long").alias(name)
        return rows.where(where).select(
            tx.chunk_id(F.col("source_path"), F.lit(0)).alias("id"), "source_path", "file_hash", zero("chunk_index"), zero("char_start"), length.alias("char_end"), F.lit("").alias("heading_path"),
            F.substring("text", 1, 200).alias("text"), F.array(F.lit(float(state))).cast("array<float>").alias("vector"), none("date", "note_date"), none("string", "status"), blank, F.lit("text").alias("kind"))

    table_ = store.Store(spark, db, 1, merge_at=4)
    table_.ensure("t")
    table_.commit("t", chunks("true", 3), rows.select("source_path"))
    table_.commit("t", chunks("doc_id % 3 = 0", 1), rows.where("doc_id % 3 = 0").select("source_path"))
    table_.upsert("t", chunks("doc_id % 3 <> 0 and doc_id % 5 = 0", 2))
    table_.commit("t", chunks("false", 0), rows.where("doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 7 = 0").select("source_path"))
    table_.optimize("t")
    return table_.table("t").select("id", "source_path", F.get("vector", F.lit(0)).cast("int").alias("state"))


@_query(VIEWS + "SELECT source_name, source_path, CAST(floor((row_number() OVER (PARTITION BY source_name ORDER BY source_path) - 1) / 64) AS BIGINT) AS batch FROM files")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.batch_numbers(files(spark, sf_dir).select("source_name", "source_path"), ["source_path"], group=["source_name"])


@_query("SELECT vec_id, len(embedding) = 64 AS valid, abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 1e-3 AS unit FROM embeddings")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", vx.is_valid(v, 64).alias("valid"), vx.is_unit(v).alias("unit"))


@_query(VIEWS + r""", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM files),
b AS (SELECT doc_id, CAST('0x' || md5(term)[1:8] AS BIGINT) % 64 AS bucket, count(*) AS n FROM w ANTI JOIN stop USING (term) GROUP BY ALL)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT), 4) AS value FROM b""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = files(spark, sf_dir).select("doc_id", F.posexplode(embedding.HashingEmbedder(64).embed_column(F.col("text"))).alias("bucket", "value"))
    return vectors.where("value > 0").select("doc_id", "bucket", F.round("value", 4).alias("value"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "source_name", "id", _r("score"), _r("cosine"), _r("bm25"))


@_query(VIEWS + RANKINGS.format(cut=50, k=10) + """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, source_name, id) AS INTEGER) AS rank,
  source_name, id, round(cosine, 6) AS score, round(cosine, 6) AS cosine, CAST(NULL AS DOUBLE) AS bm25 FROM cosines QUALIFY rank <= 10""")
def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(ranking.search_vector(corpus(spark, sf_dir), benchmark_queries(spark, sf_dir), 10))


@_query(VIEWS + RANKINGS.format(cut=50, k=10) + "SELECT query_id, source_name, id, round(cosine, 6) AS cosine, CAST(vector_rank AS INTEGER) AS vector_rank FROM vrank WHERE vector_rank <= 5")
def vector_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.vector_candidates(corpus(spark, sf_dir), benchmark_queries(spark, sf_dir), 5)
    return top.select("query_id", "source_name", "id", _r("cosine"), "vector_rank")


@_query(VIEWS + RANKINGS.format(cut=50, k=10) + "SELECT source_name, n_docs, round(avg_len, 6) AS avg_len FROM stats")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25_statistics(corpus(spark, sf_dir)).select("source_name", "n_docs", _r("avg_len"))


@_query(VIEWS + RANKINGS.format(cut=50, k=10) + "SELECT query_id, source_name, id, round(bm25, 6) AS bm25, CAST(lexical_rank AS INTEGER) AS lexical_rank FROM lrank WHERE lexical_rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.lexical_candidates(corpus(spark, sf_dir), benchmark_queries(spark, sf_dir), 10)
    return top.select("query_id", "source_name", "id", _r("bm25"), "lexical_rank")


@_query(VIEWS + RANKINGS.format(cut=20, k=10) + "SELECT query_id, source_name, id, round(rrf, 6) AS rrf FROM pool")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = corpus(spark, sf_dir), benchmark_queries(spark, sf_dir)
    fused = ranking.fuse(ranking.vector_candidates(c, q, 20), ranking.lexical_candidates(c, q, 20))
    return fused.select("query_id", "source_name", "id", _r("rrf"))


@_query(VIEWS + RANKINGS.format(cut=50, k=10) + "SELECT query_id, rank, source_name, id, round(score, 6) AS score, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25 FROM hybrid")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(ranking.search_hybrid(corpus(spark, sf_dir), benchmark_queries(spark, sf_dir), 10))


@_query(VIEWS + _CODE_PARTS.replace("60", "12").replace("50", "10") + spans_sql(24_000, 0) + """, chunks AS (
  SELECT doc AS source_path, row_number() OVER (PARTITION BY doc ORDER BY part, s) - 1 AS i, off + s AS a, off + e AS b FROM spans),
near AS (SELECT h.source_path, h.i, min(c.a) AS a, max(c.b) AS b FROM chunks h JOIN chunks c ON h.source_path = c.source_path AND abs(c.i - h.i) <= 1 GROUP BY ALL)
SELECT near.source_path, CAST(i AS BIGINT) AS chunk_index, CAST(a AS BIGINT) AS context_start, CAST(b AS BIGINT) AS context_end, sha256(text[a + 1 : b]) AS context_hash
FROM near JOIN files ON near.source_path = files.source_path""")
def search_tool_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its neighbours: what they cover is the text between their bounds."""
    chunks = chunking.chunk_code(files(spark, sf_dir), 12, 2).select("source_name", "source_path", "chunk_index", "text", "char_start", "char_end")
    hits = chunks.select("source_name", "source_path", "chunk_index")
    wide = ranking.expand_context(hits, chunks, 1)
    return wide.select("source_path", "chunk_index", "context_start", "context_end", F.sha2("context_text", 256).alias("context_hash"))


@_query(VIEWS + "SELECT name, coalesce(n, 0) AS chunk_count FROM (SELECT DISTINCT source_name AS name FROM files UNION SELECT 'empty') LEFT JOIN (SELECT source_name AS name, count(*) AS n FROM corpus GROUP BY 1) USING (name)")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.chunk_counts(_catalog(spark, sf_dir), corpus(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = files(spark, sf_dir).select(F.col("source_name").alias("name")).distinct()
    return named.unionByName(spark.createDataFrame([("empty",)], "name string"))


@_query(VIEWS + """, counts AS (SELECT name, coalesce(n, 0) AS chunk_count FROM (SELECT DISTINCT source_name AS name FROM files UNION SELECT 'empty') LEFT JOIN (SELECT source_name AS name, count(*) AS n FROM corpus GROUP BY 1) USING (name)),
runs(name, last_run, age) AS (VALUES ('src1', '2026-01-01T00:00:00+00:00', 86400), ('src2', 'broken', NULL)),
names AS (SELECT name FROM counts UNION SELECT 'later')
SELECT name, coalesce(chunk_count, 0) AS chunk_count, last_run, CAST(age AS BIGINT) AS last_run_age_seconds, CAST((SELECT sum(chunk_count) FROM counts) AS BIGINT) AS total_chunks
FROM names LEFT JOIN counts USING (name) LEFT JOIN runs USING (name)""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([("src1", "2026-01-01T00:00:00+00:00"), ("src2", "broken")], "name string, last_run string")
    configured = spark.createDataFrame([("src1",), ("later",)], "name string")
    out = status.index_status(status.chunk_counts(_catalog(spark, sf_dir), corpus(spark, sf_dir)), configured, runs, "2026-01-02T00:00:00+00:00")
    return out.select("name", "chunk_count", "last_run", "last_run_age_seconds", "total_chunks")


@_query("""SELECT * FROM (VALUES ('boom', CAST(2 AS BIGINT), 'b', CAST(2 AS BIGINT)), ('skipped_unreadable', 1, 'c', 3)) t(error, count, example_path, first_seen)""")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a", "embedded", None), (2, "b", "error", "boom"), (3, "c", "skipped_unreadable", None), (4, "d", "error", "boom"), (5, "e", "skipped_oversize", None)]
    return status.failure_groups(spark.createDataFrame(rows, "n long, path string, status string, error string"), "n")


@_query("SELECT source AS source_name, doc_id AS run FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 3")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.col("doc_id").alias("run"))
    return status.recent_runs(runs, 3)


@_query("""SELECT * FROM (VALUES ('p::0', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '', 'text'), ('q::0', '2026-01-02', 'done', 'a|b', 'text'), ('r::0', NULL, NULL, '', 'text'))
  t(id, note_date, status, tags, kind)""")
def stale_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without the note columns beside a current one with odd values."""
    base = "id string, source_path string, file_hash string, chunk_index long, char_start long, char_end long, heading_path string, text string, vector array<float>"
    old = spark.createDataFrame([("p::0", "p", "h", 0, 0, 1, "", "x", [1.0])], base)
    new = spark.createDataFrame([("q::0", "q", "h", 0, 0, 1, "", "x", [1.0], "2026-01-02", "done", ["a", "b"], "text"), ("r::0", "r", "h", 0, 0, 1, "", "x", [1.0], None, None, None, "")],
                                base + ", note_date string, status string, tags array<string>, kind string").withColumn("note_date", F.to_date("note_date"))
    both = schema.read_chunks(old).unionByName(schema.read_chunks(new))
    return both.select("id", F.date_format("note_date", "yyyy-MM-dd").alias("note_date"), "status", F.array_join("tags", "|").alias("tags"), "kind")


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur in documents expect those files; the others are negative.

    The passages travel with the tasks in blocks, and only those found leave them.
    """
    items = table(spark, sf_dir, "benchmark")
    passages = items.select("item_id", F.col("text").alias("passage"))
    hits = None
    for block in ranking.blocks(passages.select(F.col("item_id").alias("query_id"), "passage")):
        asked = F.lit([r["passage"] for r in block] or [""])
        here = files(spark, sf_dir).select("source_path", F.explode(F.filter(asked, lambda p: F.contains("text", p))).alias("passage"))
        hits = here if hits is None else hits.unionByName(here)
    found = hits.join(passages, "passage")
    paths = found.groupBy("item_id").agg(F.array_sort(F.collect_list("source_path")).alias("expected_paths"))
    joined = items.join(paths, "item_id", "left")
    return joined.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "expected_paths", F.when(F.col("expected_paths").isNull(), F.lit(0.5)).alias("expect_max_cosine"))


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden, queries = _golden(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return evaluation.query_results(golden, queries, corpus(spark, sf_dir), 5)


_EVAL = VIEWS + RANKINGS.format(cut=80, k=20) + """, expected AS (SELECT item_id AS query_id, source_path FROM benchmark JOIN files ON contains(files.text, benchmark.text)),
golden AS (SELECT item_id AS query_id, item_id NOT IN (SELECT query_id FROM expected) AS negative FROM benchmark),
filed AS (SELECT query_id, corpus.source_path, min(rank) AS r FROM hybrid JOIN corpus USING (source_name, id) GROUP BY ALL),
top AS (SELECT query_id, source_path, row_number() OVER (PARTITION BY query_id ORDER BY r) AS file_rank FROM filed QUALIFY file_rank <= 5),
best AS (SELECT query_id, min(file_rank) AS best_rank FROM top JOIN expected USING (query_id, source_path) GROUP BY ALL),
peak AS (SELECT query_id, max(cosine) AS max_cosine FROM hybrid GROUP BY ALL),
results AS (SELECT golden.*, best_rank, coalesce(max_cosine, 0) AS max_cosine FROM golden LEFT JOIN best USING (query_id) LEFT JOIN peak USING (query_id))
"""


@_query(_EVAL + """SELECT round(coalesce(avg(CASE WHEN NOT negative THEN CASE WHEN best_rank IS NOT NULL THEN 1.0 ELSE 0.0 END END), 0), 6) AS recall,
  round(coalesce(avg(CASE WHEN NOT negative THEN coalesce(1.0 / best_rank, 0.0) END), 0), 6) AS mrr FROM results""")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(_eval(spark, sf_dir)).select(_r("recall"), _r("mrr"))


@_query(_EVAL + "SELECT query_id, round(max_cosine, 6) AS max_cosine, max_cosine < 0.5 AS passed FROM results WHERE negative")
def eval_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir).where("negative").select("query_id", _r("max_cosine"), "passed")
