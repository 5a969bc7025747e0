import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.errors import EvalError
from gleaner.functions import vectors as vx
from gleaner.operators import evaluation, ranking
from gleaner.operators.embedding import HashingEmbedder

E1 = [1.0, 0.0, 0.0, 0.0]
FAR = [0.0, 0.0, 0.0, 1.0]


def _corpus(spark, *rows):
    data = [(s, p, f"{p}::0", 0, t, [float(x) for x in v], 0, len(t)) for s, p, t, v in rows]
    return spark.createDataFrame(data, "source_name string, source_path string, id string, chunk_index long, text string, vector array<float>, char_start long, char_end long")


def _fillers(n=3, v=FAR):
    return [("s", f"f{i}", f"filler number{i} text", v) for i in range(n)]


def _hybrid(spark, text, k, *rows):
    hits = ranking.search_hybrid(_corpus(spark, *rows), ranking.make_queries(spark, [(0, text, E1)]), k)
    return hits.orderBy("rank").collect()


def test_nearest_over_sources(spark):
    corpus = _corpus(spark, ("vault", "v", "", E1), ("code", "c", "", [0.9, 0.1, 0, 0]), ("code", "z", "", FAR))
    hits = ranking.search_vector(corpus, ranking.make_queries(spark, [(0, "", E1)]), 2).orderBy("rank").collect()
    assert [(h["source_name"], h["bm25"]) for h in hits] == [("vault", None), ("code", None)] and hits[0]["score"] > hits[1]["score"]
    with pytest.raises(ValueError, match="k"):
        ranking.search_vector(corpus, ranking.make_queries(spark, []), 0)


def test_both_rankers_find(spark):
    hits = _hybrid(spark, "copper kettle steam", 10, ("s", "both", "copper kettle", E1), ("s", "lex", "steam only", FAR), ("s", "sem", "other topic", [0.9, 0.1, 0, 0]))
    assert hits[0]["id"] == "both::0" and {h["id"] for h in hits} == {"both::0", "lex::0", "sem::0"}
    assert {h["id"]: h["bm25"] is not None for h in hits} == {"both::0": True, "lex::0": True, "sem::0": False}


def test_weak_keyword_match_stays_below(spark):
    hits = _hybrid(spark, "copper kettle", 2, ("s", "sem", "nothing shared", E1), ("s", "key", "copper kettle", [0.3, 0.95, 0, 0]), *_fillers())
    assert [h["id"] for h in hits] == ["sem::0", "key::0"] and hits[1]["bm25"] > 0


def test_keyword_match_wins_near_ties(spark):
    hits = _hybrid(spark, "copper kettle", 3, ("s", "near", "unrelated words", [1, 0.05, 0, 0]), ("s", "exact", "the copper kettle sings on the stove", [1, 0.25, 0, 0]), *_fillers())
    assert hits[0]["id"] == "exact::0"
    tie = _hybrid(spark, "copper kettle", 4, *_fillers(3, E1), ("s", "match", "copper kettle", E1))
    assert tie[0]["id"] == "match::0"


def test_boost_is_bounded(spark):
    hits = {h["id"]: h for h in _hybrid(spark, "copper kettle", 4, ("s", "lex", "the copper kettle", E1), ("s", "sem", "words", [0.9, 0.1, 0, 0]), *_fillers(2))}
    assert hits["lex::0"]["cosine"] < hits["lex::0"]["score"] < hits["lex::0"]["cosine"] + 0.2
    assert hits["sem::0"]["score"] == hits["sem::0"]["cosine"]


def test_best_lexical_match_beyond_the_pool(spark):
    rows = [("s", f"f{i:02}", "otter and more filler words", [1, 0.001 * i, 0, 0]) for i in range(59)]
    hits = _hybrid(spark, "otter", 60, *rows, ("s", "raft", "otter otter otter otter raft", [0.9, 0.4, 0, 0]))
    found = {h["id"]: h["bm25"] for h in hits if h["bm25"] is not None}
    assert max(found, key=found.get) == "raft::0"


def test_guards(spark):
    corpus = _corpus(spark, *[("s", f"p{i:03}", f"word{i}", E1) for i in range(105)])
    embedder = HashingEmbedder(4)
    assert ranking.search(corpus, "  ", embedder).count() == 0
    assert ranking.search(corpus, "word", embedder, sources=[]).count() == 0
    assert ranking.search(corpus, "word", embedder, sources=["nope"]).count() == 0
    assert ranking.search(corpus, "word", embedder, k=-3).count() == 1
    assert ranking.search(corpus, "word", embedder, k=500).count() == 100


@pytest.mark.parametrize(("bounds", "center", "radius", "expected"), [
    ([(0, 8), (6, 14), (12, 20)], 1, 1, (0, 20)), ([(0, 5), (5, 10), (10, 14)], 0, 5, (0, 14)), ([(0, 5), (5, 10), (10, 14)], 1, 0, (5, 10)), ([(0, 9), (2, 5), (8, 12)], 1, 1, (0, 12)),
])
def test_stitching(spark, bounds, center, radius, expected):
    text = "0123456789ABCDEFGHIJ"
    rows = [("s", p, i, text[a:b], a, b) for p in ("x", "other") for i, (a, b) in enumerate(bounds)]
    chunks = spark.createDataFrame(rows, "source_name string, source_path string, chunk_index long, text string, char_start long, char_end long")
    hits = chunks.where(f"chunk_index = {center} and source_path = 'x'").select("source_name", "source_path", "chunk_index")
    (row,) = ranking.expand_context(hits, chunks, radius).collect()
    assert (row["context_text"], row["context_start"], row["context_end"]) == (text[slice(*expected)], *expected)


def test_stitching_over_a_gap(spark):
    chunks = spark.createDataFrame([("s", "x", 0, "ab", 0, 2), ("s", "x", 1, "ef", 4, 6)], "source_name string, source_path string, chunk_index long, text string, char_start long, char_end long")
    hits = chunks.where("chunk_index = 0").select("source_name", "source_path", "chunk_index")
    assert ranking.expand_context(hits, chunks, 1).first()["context_text"] == "ab\nef"


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.lexical_boost(F.lit(10.0)).alias("x")).collect()
    assert math.isclose(rows[0]["c"], 0.6, abs_tol=1e-7) and rows[1]["c"] == 0
    assert vx.unit_rows(pa.array([[3.0, 4.0], [0.0, 0.0]]), 2).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert rows[0]["x"] == 0.075


@given(st.lists(st.lists(st.sampled_from([0.0, 0.5, 0.5 + 1e-12, -1.0]), min_size=3, max_size=3), max_size=12), st.integers(1, 5))
def test_best_rows_of_a_batch(rows, cut):
    scores = np.array(rows).reshape(len(rows), 3)
    got = list(zip(*ranking.best_rows(scores, cut), strict=True))
    assert got == [(c, r) for c in range(3) for r in sorted(range(len(rows)), key=lambda r: (-round(rows[r][c], 9), r))[:cut]]


def test_blocks_of_queries_and_odd_vectors(spark, monkeypatch):
    """More queries than a block takes, vectors that are null or of another width, and a query without one."""
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [None, [1.0, 2.0], [0.0] * 4]
    corpus = spark.createDataFrame([(f"s{i % 3}", f"{i:02}", f"word{i % 5}", v) for i, v in enumerate(vectors)], "source_name string, id string, text string, vector array<float>")
    queries = ranking.make_queries(spark, [(i, f"word{i}", vectors[i]) for i in range(9)] + [(9, "word1", None)])
    best = lambda: sorted((r["query_id"], r["source_name"], r["vector_rank"], r["id"], round(r["cosine"], 9)) for r in ranking.vector_candidates(corpus, queries, 4).collect())
    whole = best()
    monkeypatch.setattr(ranking, "ASKED", 3)
    assert best() == whole
    assert len(whole) == 9 * 3 * 4 and {r[0] for r in whole} == set(range(9))
    monkeypatch.setattr(ranking, "LISTED_TERMS", 2)
    by_words = sorted((r["query_id"], r["id"]) for r in ranking.lexical_candidates(corpus, queries, 50).collect())
    assert by_words == sorted((q, f"{i:02}") for q, w in [(q, q) for q in range(5)] + [(9, 1)] for i in range(43) if i % 5 == w)


def test_evaluation(spark, tmp_path):
    corpus = _corpus(spark, ("s", "/n/a.md", "alpha topic", E1), ("s", "/n/b.md", "beta", [0.9, 0.1, 0, 0]), ("s", "/n/a.md", "alpha again", [0.99, 0.05, 0, 0]))
    corpus = corpus.withColumn("id", F.concat("source_path", F.lit("::"), F.length("text").cast("string")))
    file = tmp_path / "golden.toml"
    file.write_text('[[queries]]\nquery="alpha"\nexpected_paths=["b.md"]\n[[queries]]\nquery="none"\nexpected_paths=["x.md"]\n[[queries]]\nquery="far"\nexpect_max_cosine=0.5\n')
    golden = evaluation.load_golden(spark, file)
    queries = ranking.make_queries(spark, [(0, "alpha", E1), (1, "none", E1), (2, "far", FAR)])
    results = evaluation.query_results(golden, queries, corpus, 5)
    rows = {r["query_id"]: r for r in results.collect()}
    assert rows[0]["best_rank"] == 2 and rows[1]["best_rank"] is None and rows[2]["passed"]
    total = evaluation.report(results).first()
    assert (total["recall"], total["mrr"], total["negatives"], total["negatives_passed"]) == (0.5, 0.25, 1, 1)


@pytest.mark.parametrize("text", ["", "queries = []", "[[queries]]\nquery=' '\nexpected_paths=['a']", "[[queries]]\nquery='a'", "[[queries]]\nquery='a'\nexpected_paths=[]",
                                  "[[queries]]\nquery='a'\nexpect_max_cosine=1.5", "[[queries]]\nquery='a'\nexpect_max_cosine=0.5\nexpected_paths=['x']", "not toml"])
def test_bad_golden_files(spark, tmp_path, text):
    file = tmp_path / "g.toml"
    file.write_text(text)
    with pytest.raises(EvalError):
        evaluation.load_golden(spark, file)
    with pytest.raises(EvalError):
        evaluation.load_golden(spark, tmp_path / "absent.toml")
