"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Native: DataFrame functions only. The texts are read where the sizes are counted;
all else runs on a narrow table of sizes and on one row per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import broadcast_if, table, word_count, wrapped
from gleaner.runtime import Scratch, with_rank

#: Sources up to which the per-source table is broadcast (about 200 bytes each).
BROADCAST_SOURCES = 20_000
#: Picks up to which their table is broadcast (about 100 bytes each).
BROADCAST_PICKS = 100_000
#: Hexadecimal digits of the seeded order by which the crossing document is sought, level by level. No window has more
#: than 16**3 rows a source before the last, whose rows share all these digits: a 16.8 millionth of their source.
LEVELS = (3, 6)


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and compares null equal to null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def cycled_weights(scratch: Scratch, sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by place in code point order. One row per source comes in; no task orders all of them."""
    placed = with_rank(scratch, sources, [], ["source_key"], "place")
    which = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    return placed.withColumn("weight", which.cast("long")).drop("place")


def fill_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Water-filling: add ``target`` to (source_key, source_size, weight).

    Each round gives the free sources their share of what the clamped ones leave
    at one common level per weight, then clamps those above ``max_epochs`` times
    their size. The level only rises, so the clamped set only grows; the loop
    ends when it stays. Only three numbers a round reach the driver.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    if not total["w"]:
        return sources.withColumn("target", F.col("source_size").cast("double"))
    level, clamped = total["t"] / total["w"], 0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        got = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("c"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w"),
            F.count_if(over).alias("n"),
        ).first()
        if got["n"] == clamped or not got["w"]:
            break
        clamped, level = got["n"], (total["t"] - got["c"]) / got["w"]
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


@dataclass
class Mix:
    """Decisions: one row per source, the documents that fill its gap, and how a document reads them."""

    sources: DataFrame
    picks: DataFrame
    base: DataFrame
    n_sources: int
    n_picks: int
    seed: int

    def apply(self, docs: DataFrame) -> DataFrame:
        """Add size, source_size, target, copies and taken to rows of (u, h, source_key, size)."""
        right = broadcast_if(self.sources.withColumnRenamed("source_key", "_sk"), self.n_sources, BROADCAST_SOURCES)
        joined = docs.join(right, F.col("source_key") == F.col("_sk"), "inner")
        picks = self.picks.select(F.col("source_key").alias("_ps"), F.col("u").alias("_pu"), F.col("h").alias("_ph"))
        same = (F.col("source_key") == F.col("_ps")) & (F.col("u") == F.col("_pu")) & (F.col("h") == F.col("_ph"))
        joined = joined.join(broadcast_if(picks, self.n_picks, BROADCAST_PICKS), same, "left")
        mine = F.struct("u", "h")
        below = F.col("u") < F.col("cross_bucket")
        extra = F.coalesce(below, F.lit(True)) | F.coalesce(mine <= F.col("cut"), F.lit(False)) | F.col("_ps").isNotNull()
        copies = F.col("whole") + F.when(extra & (F.col("goal") > 0), 1).otherwise(0)
        out = joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(1)).cast("long"))
        return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_sk", "weight", "whole", "goal", "cross_bucket", "cut", "_ps", "_pu", "_ph")


def _narrow_columns(seed: int) -> list[Column]:
    who = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return [
        F.md5(who.cast("binary")).alias("u"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h"),
        source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"),
    ]


#: Largest sizes first, as many documents of each as the gap still holds.
_TAKES = """aggregate(sizes, named_struct('gap', gap, 'takes', cast(array() as array<struct<w:bigint,k:bigint,n:bigint>>)),
  (a, s) -> if(s.w > a.gap, a, named_struct('gap', a.gap - s.w * least(s.n, a.gap div s.w), 'takes', concat(a.takes, array(named_struct('w', s.w, 'k', least(s.n, a.gap div s.w), 'n', s.n))))),
  a -> a.takes)"""


def fill_gaps(scratch: Scratch, left: DataFrame) -> DataFrame:
    """(source_key, u, h) of the largest documents that still fit, one after another until none does.

    ``left`` has (source_key, u, h, w, missing), with w above 0. Documents of a size are alike
    but for their order (u, h), so the choice runs over one row per source and size:
    the sizes of a source add up to its words at most, so they are few.
    """
    sizes = left.groupBy("source_key", "w").agg(F.count(F.lit(1)).alias("n"), F.first("missing").alias("missing"))
    by_source = sizes.groupBy("source_key").agg(F.floor(F.first("missing")).alias("gap"), F.sort_array(F.collect_list(F.struct("w", "n")), asc=False).alias("sizes"))
    takes = scratch.write(by_source.select("source_key", F.explode(F.expr(_TAKES)).alias("t")).select("source_key", "t.*"))
    chosen = left.drop("missing").join(broadcast_if(takes, takes.count(), BROADCAST_PICKS), ["source_key", "w"])
    some = with_rank(scratch, chosen.where("k < n"), ["source_key", "w"], ["u", "h"], "place").where("place < k")
    return chosen.where("k = n").select("source_key", "u", "h").unionByName(some.select("source_key", "u", "h"))


def _crossing(units: DataFrame, digits: int) -> DataFrame:
    """(source_key, cross_bucket, base, goal) of sources whose sums exceed the goal.

    ``units`` has (source_key, u, w, base, goal); base is what lies before all of them. The
    bucket is the first, by leading digits of u, whose sum does so, and its base lies before it.
    """
    buckets = units.groupBy("source_key", F.substring("u", 1, digits).alias("bucket")).agg(F.sum("w").alias("w"), F.first("base").alias("base"), F.first("goal").alias("goal"))
    upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.col("base") + F.sum("w").over(upto)).where(F.col("upto") > F.col("goal"))
    return buckets.groupBy("source_key").agg(F.min("bucket").alias("cross_bucket"), F.min_by(F.col("upto") - F.col("w"), "bucket").alias("base"), F.first("goal").alias("goal"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 7, cycle: tuple[int, ...] = (5, 2, 1)) -> Mix:
    """Decide how often each document of (doc_id, text, source) is taken.

    A source's target over its size gives whole repetitions of all its documents;
    the rest is a seeded sample: documents in the order of md5(seed, doc_id), as
    many as come before the missing words are exceeded, then the largest untaken
    document that still fits, again and again until none does.

    Null or empty texts have size 0, take nothing and stay once. Null sources are
    one source, last in order. Null doc_ids are ordered as the word null. Rows
    equal in doc_id and text are taken together. An empty table gives no rows.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = scratch.write(docs.select("doc_id", "source", *_narrow_columns(seed)))
    sources = base.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = scratch.write(cycled_weights(scratch, sources, cycle))
    n_sources = sources.count()
    plan = fill_targets(sources, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", F.least(whole, F.lit(max_epochs)))
    plan = plan.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))

    units = base.groupBy("source_key", "u", "h").agg(F.sum("size").alias("w"))
    small = lambda df: broadcast_if(df, n_sources, BROADCAST_SOURCES)
    inside = units.join(small(plan.select("source_key", "goal", F.lit(0).cast("long").alias("base"))), "source_key")
    for digits in LEVELS:
        crossing = _crossing(inside, digits)
        within = F.substring("u", 1, digits) == F.col("cross_bucket")
        inside = scratch.write(inside.drop("base", "goal").join(small(crossing), "source_key").where(within).drop("cross_bucket"))
    run = Window.partitionBy("source_key").orderBy("u", "h").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("base") + F.sum("w").over(run)).where(F.col("upto") <= F.col("goal"))
    cuts = inside.groupBy("source_key").agg(F.max(F.struct("u", "h")).alias("cut"), F.max("upto").alias("got"))
    plan = plan.join(crossing.drop("goal"), "source_key", "left").join(cuts, "source_key", "left")
    plan = scratch.write(plan.withColumn("missing", F.col("goal") - F.coalesce("got", "base", F.lit(0))))

    gaps = plan.select("source_key", "cross_bucket", "cut", "missing")
    left = units.join(small(gaps.where(F.col("missing") > 0)), "source_key")
    left = left.where((F.col("u") >= F.col("cross_bucket")) & ~F.coalesce(F.struct("u", "h") <= F.col("cut"), F.lit(False)))
    left = scratch.write(left.where((F.col("w") > 0) & (F.col("w") <= F.col("missing"))).select("source_key", "u", "h", "w", "missing"))
    picks = scratch.write(fill_gaps(scratch, left))
    decided = plan.select("source_key", "source_size", "weight", "target", "whole", "goal", "cross_bucket", "cut")
    return Mix(decided, picks, base, n_sources, picks.count(), seed)


def mix_documents(docs: DataFrame, **settings: object) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, same columns.

    Rows without words stay once: they add no words to any source.
    """
    decided = mix(docs, **settings)
    sized = wrapped(docs, "doc_id", "text", "source").select("row", *_narrow_columns(decided.seed))
    taken = decided.apply(sized).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return decided.apply(decided.base).select("doc_id", "source", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u, md5(coalesce(text, '')) AS h,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY 1),
src AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sums),
ord AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS k,
    CAST(coalesce(sum(3 * source_size) OVER p, 0) AS BIGINT) AS before_cap, CAST(coalesce(sum(weight) OVER p, 0) AS BIGINT) AS before_weight
  FROM src
  WINDOW o AS (ORDER BY 3.0 * source_size / weight, source_key),
    p AS (ORDER BY 3.0 * source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT k, weight, cap, CAST((SELECT sum(source_size) FROM src) - before_cap AS DOUBLE) / CAST((SELECT sum(weight) FROM src) - before_weight AS DOUBLE) AS level FROM ord),
lev AS (SELECT coalesce((SELECT level FROM levels WHERE weight * level <= cap ORDER BY k LIMIT 1), 1e300) AS level),
tgt AS (
  SELECT source_key, source_size, CASE WHEN weight * level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM src, lev),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM tgt),
goals AS (SELECT *, target - whole * source_size AS goal FROM pl),
units AS (SELECT source_key, u, h, CAST(sum(size) AS BIGINT) AS w FROM base GROUP BY 1, 2, 3),
run AS (
  SELECT units.*, goal, CAST(sum(w) OVER (PARTITION BY source_key ORDER BY u, h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM units JOIN goals USING (source_key)),
firsts AS (SELECT *, min(CASE WHEN upto > goal THEN u || h END) OVER (PARTITION BY source_key) AS stop FROM run),
marked AS (SELECT *, stop IS NULL OR u || h < stop AS below FROM firsts),
gaps AS (SELECT source_key, any_value(goal) - coalesce(max(CASE WHEN below THEN upto END), 0) AS missing FROM marked GROUP BY 1),
sizes AS (SELECT source_key, w, count(*) AS n FROM marked WHERE NOT below AND w > 0 GROUP BY 1, 2),
takes AS (
  SELECT source_key, CAST(floor(missing) AS BIGINT) AS gap, CAST(NULL AS BIGINT) AS w, CAST(0 AS BIGINT) AS k FROM gaps
  UNION ALL
  SELECT t.source_key, t.gap - s.w * least(s.n, t.gap // s.w), s.w, least(s.n, t.gap // s.w)
  FROM takes t JOIN sizes s ON s.source_key = t.source_key AND s.w <= t.gap AND (t.w IS NULL OR s.w < t.w)
  QUALIFY row_number() OVER (PARTITION BY t.source_key ORDER BY s.w DESC) = 1),
places AS (SELECT source_key, u, h, w, row_number() OVER (PARTITION BY source_key, w ORDER BY u, h) AS place FROM marked WHERE NOT below),
best AS (SELECT p.source_key, p.u, p.h FROM places p JOIN takes t ON t.source_key = p.source_key AND t.w = p.w WHERE p.place <= t.k),
extra AS (
  SELECT m.source_key, m.u, m.h, (m.below OR best.u IS NOT NULL) AND m.goal > 0 AS more
  FROM marked m LEFT JOIN best ON m.source_key = best.source_key AND m.u = best.u AND m.h = best.h)
SELECT b.doc_id, b.source, b.size, g.source_size, g.target, CAST(b.size * (g.whole + CASE WHEN e.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM base b JOIN goals g USING (source_key) JOIN extra e ON b.source_key = e.source_key AND b.u = e.u AND b.h = e.h
"""
