"""Tables with odd rows, and DuckDB over Spark tables."""

import math
import random

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("size", "score", "kept", "row", "shard", "slot", "u", "h", "copies", "text_key", "ids", "length")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows(seed=3):
    """Nulls in each column, empty, blank and very long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    base = words(rng, 120, 10**6)
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1), (3, " ".join(base[:118] + ["x", "y"]), "en", None, None), (4, " ".join(base[5:] + words(rng, 5)), None, "b", 2),
        (5, None, "en", "a", 0), (6, "", "de", "b", 0), (7, " \t\n", "de", "é", 0), (8, "one", "en", "a", 3), (9, "One", "en", "a", 3), (10, "one two three", None, None, None),
        (None, "an id that is null", "en", "b", 1), (None, " ".join(base), "en", "b", 1), (None, None, None, None, None), (11, "z " * 60, "en", "b", 2),
        (12, " ".join(words(rng, 20_000, 5_000)), "fr", "c", 1), (13, "é 日本\u00a0語 \U0001f600 x\u2028y", "ja", "日", 1), (14, " ".join(words(rng, 40) + base[20:70] + words(rng, 40)), "en", "c", 1),
        (15, " ".join(words(rng, 3) * 30), "en", "d", 9), (16, "<|endoftext|> a  b \n c", "en", "d", 9), (17, "one", "en", "a", 3), (17, "one", "en", "a", 3), (18, "ONE two\x0bthree", "en", "d", 1),
    ]
    for i in range(20, 60):
        near = base[:]
        for _ in range(rng.randrange(1, 7)):
            near[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(near if i % 2 else words(rng, rng.randrange(1, 80))), "en", rng.choice("abcd"), i))
    return rows


def odd_docs(spark, seed=3):
    return spark.createDataFrame(odd_rows(seed), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def with_extra(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


def save(tmp_path, **tables):
    """A folder of Parquet tables as the queries expect it."""
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _key(rows):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


def same_as_sql(df, sql, folder, *tables):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{'/*.parquet' if '/sf' not in folder else ''}')")
    expected = con.execute(sql)
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = _key(df.select(*columns).collect()), _key(expected.fetchall())
    assert got == want
    return got
