"""Views of the test tables as a chunk corpus, notes and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files: source_name, source_path, file_hash, text."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select(F.col("source").alias("source_name"), path.alias("source_path"), F.sha2("text", 256).alias("file_hash"), "text", "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document that has a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    joined = files(spark, sf_dir).join(vectors, "doc_id")
    return joined.select("source_name", "source_path", F.concat("source_path", F.lit("::0")).alias("id"), "file_hash", "text", "vector")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown note per conversation: its title, then a heading and text per turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    text = F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), body)
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_path"), text.alias("text")).select(
        "source_path", F.sha2("text", 256).alias("file_hash"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage with the vector of its number as a query."""
    items = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id"))
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").cast("array<double>").alias("query_vector"))


#: The same views for the oracle.
VIEWS = r"""
WITH RECURSIVE files AS (
  SELECT source AS source_name, source || '/' || doc_id || '.txt' AS source_path, sha256(text) AS file_hash, text, doc_id FROM documents WHERE text IS NOT NULL),
corpus AS (
  SELECT source_name, source_path, source_path || '::0' AS id, text, CAST(embedding AS DOUBLE[]) AS vector FROM files JOIN embeddings ON vec_id = doc_id),
queries AS (
  SELECT item_id AS query_id, text AS query_text, CAST(embedding AS DOUBLE[]) AS query_vector FROM benchmark JOIN embeddings ON vec_id = item_id),
stop AS (SELECT unnest(['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such',
  'that','the','their','then','there','these','they','this','to','was','will','with']) AS term)
"""
#: Rankings over corpus and queries; each name builds on those before it.
RANKINGS = r"""
, words AS (SELECT source_name, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM corpus),
terms AS (SELECT * FROM words ANTI JOIN stop USING (term)),
lens AS (SELECT source_name, corpus.id, count(term) AS dl FROM corpus LEFT JOIN terms USING (source_name, id) GROUP BY ALL),
stats AS (SELECT source_name, count(*) AS n_docs, avg(dl) AS avg_len FROM lens GROUP BY ALL),
qwords AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) AS term FROM queries) ANTI JOIN stop USING (term)),
tfs AS (SELECT source_name, id, term, count(*) AS tf FROM terms GROUP BY ALL),
dfs AS (SELECT source_name, term, count(*) AS df FROM tfs GROUP BY ALL),
lexical AS (
  SELECT query_id, source_name, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS bm25
  FROM qwords JOIN tfs USING (term) JOIN dfs USING (source_name, term) JOIN lens USING (source_name, id) JOIN stats USING (source_name) GROUP BY ALL),
cosines AS (SELECT query_id, source_name, id, list_cosine_similarity(vector, query_vector) AS cosine FROM corpus CROSS JOIN queries),
vrank AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_name ORDER BY round(cosine, 9) DESC, id) AS vector_rank FROM cosines),
lrank AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_name ORDER BY round(bm25, 9) DESC, id) AS lexical_rank FROM lexical),
pool AS (
  SELECT query_id, source_name, id, vector_rank, lexical_rank, bm25,
    coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS rrf
  FROM (SELECT * FROM vrank WHERE vector_rank <= {cut}) FULL JOIN (SELECT * FROM lrank WHERE lexical_rank <= {cut}) USING (query_id, source_name, id)),
scored AS (
  SELECT pool.*, cosines.cosine AS cosine, cosines.cosine + CASE WHEN bm25 > 0 THEN 0.15 * bm25 / (bm25 + 10) ELSE 0 END AS score
  FROM pool JOIN cosines USING (query_id, source_name, id)),
hybrid AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 9) DESC, source_name, vector_rank NULLS LAST, lexical_rank, id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= {k})
"""
#: Spans of texts over a cap: needs ``parts`` (doc, part, off, t); gives ``spans`` (doc, part, off, s, e, t).
SPANS = r"""
, cuts(doc, part, off, t, s, e) AS (
  SELECT doc, part, off, t, 0, {first} FROM parts
  UNION ALL
  SELECT doc, part, off, t, s, {rest} FROM (SELECT doc, part, off, t, greatest(e - {overlap}, s + 1) AS s FROM cuts WHERE e < length(t)) AS more),
spans AS (SELECT * FROM cuts)
"""


def _cut(cap: int) -> str:
    """End of a span that starts at s, as SQL."""
    end = f"least(length(t), s + {cap})"
    half = f"(s + ({end} - s) // 2)"
    second = f"reverse(t[{half} + 1 : {end}])"
    after = lambda mark: f"{half} + length({second}) - strpos({second}, {mark}) + 1"
    blank = f"length(regexp_extract(t[s + 1 : {end}], '(?s)^(.*\\s)', 1))"
    return (
        f"CASE WHEN {end} = length(t) THEN length(t) WHEN strpos({second}, chr(10) || chr(10)) > 0 THEN {after('chr(10) || chr(10)')} "
        f"WHEN strpos({second}, chr(10)) > 0 THEN {after('chr(10)')} WHEN {blank} > 0 THEN s + {blank} ELSE {end} END"
    )


def spans_sql(cap: int, overlap: int) -> str:
    rest = _cut(cap)
    first = rest.replace("(s + (", "(0 + (").replace("s + ", "0 + ").replace("[s + 1", "[0 + 1").replace(" - s)", " - 0)")
    return SPANS.format(first=first, rest=rest, overlap=overlap)
