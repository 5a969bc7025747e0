"""Forest and pivot searches."""

import numpy as np
from helpers import same_as_sql, save
from pyspark.sql import functions as F

from gleaner.llm import forest, pivots

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def _odd(spark, width=5, zero=True):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=width)], 1) for i in range(1, 400)]
    hot = [float(x) for x in rng.normal(size=width)]
    rows += [(i, hot, 1) for i in range(400, 440)]
    rows += [(500, hot, 1), (600, None, 1), (700, [], 1), (800, [1.0] * (width - 1) + [None], None), (900, [float("nan")] * width, 1), (1000, [float("inf")] * width, 1),
             (1100, [0.0] * width, 1), (1200, [1.0, 2.0], 1), (None, hot, 1), (100, rows[99][1], 2), (0, [-0.0] + rows[4][1][1:], 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("x")).withColumn("score", F.lit(1))


def _answers(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_forest_finds_nearest(spark):
    got = _answers(forest.op4_forest_search(spark, SF).collect())
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(data["embedding"].tolist(), dtype=float), data["vec_id"].to_numpy()
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        hits += len(best & {v for v, _ in found})
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
    assert set(got) == set(ids[ids % 100 == 0]) and hits >= 0.9 * 10 * len(got)


def test_forest_stops_early_but_well(spark):
    """With clustered vectors a small part of the candidates is enough."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 5
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(2_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = _answers(forest.search_forest(df, df.where("vec_id % 50 = 0"), share=0.0, least=600, leaf=16).collect())
    hits = sum(len({v for v, _ in f} & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11])) for q, f in got.items())
    assert len(got) == 40 and hits >= 0.9 * 400


def _recall(x, found, k):
    hits = 0
    for q, f in found.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({v for v, _ in f} & set(np.argsort(d)[:k]))
    return hits / (k * len(found))


def test_forest_learns_where_to_stop(spark):
    """Structureless vectors need most of all for their recall, clustered ones a small part; both reach 0.9 untold."""
    rng = np.random.default_rng(9)
    plain = rng.normal(size=(3_000, 64))
    grouped = np.repeat(rng.normal(size=(60, 64)) * 4, 50, axis=0) + rng.normal(size=(3_000, 64))
    shares = []
    for x in (plain, grouped):
        trees = [forest.grow_tree(x, 64, s) for s in range(16)]
        shares.append(forest.needed_share(trees, x, 10))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
        # A sample of a third, so that most queries and rows were not seen by the fit.
        got = _answers(forest.search_forest(df, df.where("vec_id % 50 = 0"), sample=1_000).collect())
        assert len(got) == 60 and _recall(x, got, 10) >= 0.9
    assert shares[1] < 0.35 * shares[0]


def test_costs_are_the_order_of_the_queue():
    x = np.random.default_rng(5).normal(size=(400, 6))
    trees = [forest.grow_tree(x, 16, s) for s in range(4)]
    sizes = [np.bincount(t.leaf_of(x), minlength=t.leaves) for t in trees]
    costs = [forest.leaf_costs(t, x[:7]) for t in trees]
    for q in range(7):
        walk = [costs[t][q, leaf] for t, leaf in forest.probe(trees, sizes, x[q], 10**9)]
        assert len(walk) == sum(t.leaves for t in trees) and walk == sorted(walk)
        assert walk[:4] == [-np.inf] * 4 and walk[4] > 0


def test_share_of_small_samples():
    x = np.random.default_rng(1).normal(size=(300, 4))
    for rows in (x[:0], x[:1], x[:2], np.ones((50, 4)), x):
        trees = [forest.grow_tree(rows, 8, s) for s in range(3)]
        assert 0 < forest.needed_share(trees, rows, 10) <= 3 + 1e-9


def test_forest_of_odd_rows(spark, tmp_path):
    folder = save(tmp_path, embeddings=_odd(spark))
    got = _answers(forest.op4_forest_search(spark, folder).collect())
    assert set(got) == {0, 100, 200, 300, 400, 500}
    assert got[400] == [(i, 0.0) for i in range(401, 411)] and got[500] == [(i, 0.0) for i in range(400, 410)]
    assert all(len(f) == 10 and q not in dict(f) for q, f in got.items())
    few = save(tmp_path / "few", embeddings=_odd(spark).where("vec_id in (100, 200, 300)"))
    assert {q: len(f) for q, f in _answers(forest.op4_forest_search(spark, few).collect()).items()} == {100: 2, 200: 2, 300: 2}
    none = save(tmp_path / "none", embeddings=_odd(spark).where("false"))
    assert forest.op4_forest_search(spark, none).collect() == []


def test_priority_queue_visits_everything_in_the_end():
    x = np.random.default_rng(0).normal(size=(300, 4))
    trees = [forest.grow_tree(x, 8, s) for s in range(3)]
    sizes = [np.bincount(t.leaf_of(x), minlength=t.leaves) for t in trees]
    leaves = forest.probe(trees, sizes, x[0], 10**9)
    assert len(leaves) == len(set(leaves)) == sum(t.leaves for t in trees)
    assert all((0, int(trees[0].leaf_of(x[:1])[0])) in forest.probe(trees, sizes, x[0], n) for n in (100, 200))
    same = forest.grow_tree(np.ones((50, 4)), 8, 0)
    assert same.leaves == 1 and (same.leaf_of(x) == 0).all()


def test_pivots_match_sql(spark, tmp_path):
    same_as_sql(pivots.op10_pivot_search(spark, SF), pivots.OP10_SQL, SF, "embeddings")
    good = _odd(spark).where("vec_id is not null and vec_id not in (700, 1200) and label = 1")
    folder = save(tmp_path, embeddings=good)
    same_as_sql(pivots.op10_pivot_search(spark, folder), pivots.OP10_SQL, folder, "embeddings")
    odd = save(tmp_path / "odd", embeddings=_odd(spark))
    got = _answers(pivots.op10_pivot_search(spark, odd).collect())
    assert set(got) == {0, 100, 200, 300, 400, 500, 1100} and all(len(f) == 10 and q not in dict(f) for q, f in got.items())
    none = save(tmp_path / "none", embeddings=_odd(spark).where("false"))
    assert pivots.op10_pivot_search(spark, none).collect() == []


def test_pivots_prune_and_stay_exact(spark):
    rng = np.random.default_rng(6)
    x = np.floor(np.repeat(rng.normal(size=(20, 8)) * 3_000, 60, axis=0) + rng.normal(size=(1_200, 8)) * 50)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = _answers(pivots.search_pivots(df, df.where("vec_id % 50 = 0"), k=5).collect())
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert found == [(int(i), int(s[i])) for i in np.lexsort((np.arange(len(x)), -s))[:5]]


def test_runs_are_ruled_out_only_without_answers():
    """No run that holds a score of the bar is ruled out; how many are differs by query, as short ones have low bars."""
    rng = np.random.default_rng(8)
    x = np.floor(np.repeat(rng.normal(size=(50, 16)) * 3_000, 80, axis=0) + rng.normal(size=(4_000, 16)) * 100)
    points = pivots.pick_pivots(x[:500], 32)
    d = pivots.distances(x, points)
    x, d = (a[np.lexsort((d.min(axis=1), d.argmin(axis=1)))] for a in (x, d))
    own, runs = (x**2).sum(axis=1), np.arange(0, len(x), pivots.RUN)
    low, high, longest = np.minimum.reduceat(d, runs, axis=0), np.maximum.reduceat(d, runs, axis=0), np.maximum.reduceat(own, runs)
    share = []
    for q in x[::100]:
        scores = x @ q
        bar = int(np.sort(scores)[-11])
        rows = pivots.rows_in_reach(low, high, longest, pivots.distances(q[None], points)[0], float(q @ q), bar, len(x))
        assert set(np.flatnonzero(scores >= bar)) <= set(rows)
        share.append(len(rows) / len(x))
    assert min(share) < 0.3 and np.mean(share) < 0.8


def test_large_products():
    big = float(1 << 40)
    assert pivots.inner_products(np.array([[big, 1.0]]), np.array([big, -1.0])).tolist() == [(1 << 63) - 1]
    assert pivots.inner_products(np.array([[float(1 << 30), 1.0]]), np.array([float(1 << 30), 1.0])).tolist() == [(1 << 60) + 1]


def test_scores_beyond_64_bits_stop_there(spark):
    """One huge component gives both the largest and the smallest long; order and ties stay right."""
    rng = np.random.default_rng(2)
    x = rng.integers(-1_000, 1_000, (300, 4)).astype(float)
    x[0, 0], x[100, 0], x[200, 1] = 1e16, -1e16, 1e16
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in pivots.search_pivots(df, df.where("vec_id % 50 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 50):
        exact = [min(max(sum(int(a) * int(b) for a, b in zip(x[q], row, strict=True)), -(1 << 63)), (1 << 63) - 1) for row in x]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-exact[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, exact[i]) for k, i in enumerate(order)]
