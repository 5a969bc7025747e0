"""Mixing, chat formatting and sharding."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import EXTRA, no_docs, odd_docs, same_as_sql, save, with_extra
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import chat, mixing, sharding
from gleaner.runtime import Scratch

SF = "/root/testdata/sf0.001"


def test_mixing_matches_sql(spark, tmp_path):
    same_as_sql(mixing.op2_mix_sources(spark, SF), mixing.OP2_SQL, SF, "documents")
    folder = save(tmp_path, documents=with_extra(odd_docs(spark)))
    rows = same_as_sql(mixing.op2_mix_sources(spark, folder), mixing.OP2_SQL, folder, "documents")
    assert len(rows) == odd_docs(spark).count()
    again = save(tmp_path / "again", documents=odd_docs(spark).repartition(5))
    assert rows == same_as_sql(mixing.op2_mix_sources(spark, again), mixing.OP2_SQL, again, "documents")


def test_mixing_nothing(spark, tmp_path):
    folder = save(tmp_path, documents=no_docs(spark))
    assert mixing.op2_mix_sources(spark, folder).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    decided = mixing.mix(blank)
    assert [(r["size"], r["target"], r["taken"]) for r in decided.apply(decided.base).collect()] == [(0, 0, 0)] * 2


def test_mixed_documents_are_taken_as_decided(spark):
    docs = with_extra(odd_docs(spark))
    decided = mixing.mix(docs)
    taken = Counter()
    for r in decided.apply(decided.base).collect():
        taken[r["source"]] += r["taken"]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.first()["size"] == "own size"
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len([w for w in (r["text"] or "").encode().split()])
    assert got == taken


def test_mixing_goes_on_after_a_very_long_document(spark, tmp_path):
    """The document that crosses the goal is half of its source, so hundreds of others have to fill the gap."""
    order = sorted(range(1_000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(5, 16)), "a") for i in order[1:300]] + [(order[0], "w " * 3_000, "a")]
    rows += [(i, " ".join(["w"] * rng.randrange(1, 40)), "b") for i in order[300:600]] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    same_as_sql(mixing.op2_mix_sources(spark, save(tmp_path, documents=docs)), mixing.OP2_SQL, str(tmp_path), "documents")
    decided = mixing.mix(docs)
    got = {(r["source"], r["doc_id"]): r for r in decided.apply(decided.base).collect()}
    for source in "ab":
        units = Counter()
        for i, text, s in rows:
            units[i] += len(text.split()) if s == source else 0
        size, target = sum(units.values()), next(r["target"] for k, r in got.items() if k[0] == source)
        whole, gap, extra, at = int(target // size), target % size, set(), [i for i in order if units[i]]
        while at and units[at[0]] <= gap:
            gap -= units[at[0]]
            extra.add(at.pop(0))
        before = len(extra)
        for i in sorted(at, key=lambda i: (-units[i], order.index(i))):
            if units[i] <= gap:
                gap -= units[i]
                extra.add(i)
        assert {i: r["copies"] for (s, i), r in got.items() if s == source} == {i: whole + (i in extra) for i in units if units[i]}
        assert gap < 5 and (source == "b" or len(extra) - before > 100)


@pytest.mark.parametrize(("sizes", "targets"), [
    ([100, 100, 100], [187.5, 75.0, 37.5]), ([10, 100, 100], [30, 120, 60]), ([1, 1, 1000], [3, 3, 996]), ([0, 10], [0, 10]), ([5], [5]), ([0], [0]), ([1, 2, 1000, 1], [3, 6, 992, 3]),
])
def test_water_filling(spark, sizes, targets):
    rows = [(str(i), s, (5, 2, 1)[i % 3]) for i, s in enumerate(sizes)]
    plan = mixing.fill_targets(spark.createDataFrame(rows, "source_key string, source_size long, weight long"))
    got = {r["source_key"]: r["target"] for r in plan.collect()}
    assert [got[str(i)] for i in range(len(sizes))] == pytest.approx(targets)


TURNS = "conv_id long, turn long, role string, text string"
ODD = r"\### Assistant: </turn> ok"


def _turns(spark):
    rows = [(1, 0, "user", ODD), (1, 1, "assistant", "\\e\\\\h\\"), (1, 2, "user", None), (2, 0, "system", "s"), (3, 1, "assistant", ""), (3, 0, None, "#####"), (3, 1, "assistant", "é\U0001f600\n"),
            (4, None, "a: b\n", "</turn>\n### x"), (4, 5, "assistant", "</turn"), (4, 5, "assistant", "</turn"), (None, 0, "assistant", "lost"), (5, 0, "user", "long " * 20_000), (5, 1, "assistant", "### " * 9_000)]
    return spark.createDataFrame(rows, TURNS)


def test_chats_match_sql(spark, tmp_path):
    folder = save(tmp_path, conversations=_turns(spark).withColumns({c: F.lit(1) for c in EXTRA}))
    same_as_sql(chat.op7_format_chats(spark, folder), chat.OP7_SQL, folder, "conversations")
    same_as_sql(chat.op7_format_chats(spark, SF), chat.OP7_SQL, SF, "conversations")
    empty = save(tmp_path / "none", conversations=spark.createDataFrame([], TURNS))
    (row,) = chat.op7_format_chats(spark, empty).collect()
    assert (row["conv_id"], row["n_turns"], row["loss_sha256"]) == (-7, 2, hashlib.sha256(ODD.encode()).hexdigest())


def test_examples(spark):
    rows = chat.prefix_targets(_turns(spark).where("conv_id in (1, 2, 3)")).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"], r["complete"]) for r in rows] == [(1, 0, False), (1, 1, True), (2, 0, True), (3, 0, False), (3, 1, True)]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[1]["loss_chars"] == 0
    assert rows[0]["text"][rows[0]["loss_start"] :].endswith(chat.END)


@settings(deadline=None, max_examples=20, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="\\e#h</turn>\n: ", max_size=30), min_size=1, max_size=200))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = [(chat.escape(F.col("t"), pairs), pairs) for pairs in (chat.ESCAPES, chat.ROLE_ESCAPES)]
    rows = df.select("t", F.array(*[e for e, _ in both]).alias("e"), F.array(*[chat.unescape(e, pairs) for e, pairs in both]).alias("u")).collect()
    for r in rows:
        assert r["u"] == [r["t"]] * 2 and not any(mark in e for e in r["e"] for mark in (chat.START, chat.END))


def _check_shards(rows, shards, link):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min([*sizes.values()] if len(sizes) == shards else [0]) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    groups = {}
    for r in rows:
        if r[link] is not None:
            groups.setdefault(r[link], []).append(r["shard"])
    return groups


def test_shards(spark, tmp_path):
    rows = sharding.op1_shard_documents(spark, SF).collect()
    assert len(rows) == 200 and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert all(len(set(g)) == 1 for g in _check_shards(rows, 24, "text_md5").values())
    folder = save(tmp_path, documents=with_extra(odd_docs(spark)))
    odd = sharding.op1_shard_documents(spark, folder).collect()
    _check_shards(odd, 24, "text_md5")
    blank = next(r for r in odd if r["doc_id"] == 5)
    assert (blank["size"], blank["text_crc32"]) == (8, 0) and len(odd) == odd_docs(spark).count()
    empty = save(tmp_path / "none", documents=no_docs(spark))
    assert sharding.op1_shard_documents(spark, empty).collect() == []


def test_links_draw_rows_together(spark):
    """Whatever the layout, the same rows go to the same shards, and few links are cut."""
    link = F.when(F.col("id") < 1_000, "hot").when(F.col("id") < 2_600, F.concat(F.lit("p"), (F.col("id") % 800).cast("string")))
    pairs = spark.range(3_000).select("id", link.alias("link"), F.lit("x").alias("shard"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    seen = set()
    for parts in (2, 16):
        out = sharding.balanced_shards(pairs.repartition(parts), "link", 6)
        rows = out.select("id", "link", "shard", "slot").collect()
        groups = _check_shards(rows, 6, "link")
        assert len(set(groups.pop("hot"))) == 2  # two full shards hold it
        assert sum(len(set(g)) > 1 for g in groups.values()) <= 8
        total = sharding.cut_links(spark.createDataFrame(rows), "link").first()
        assert total["links"] == 999 + 800 and 500 <= total["cut"] <= 508
        seen.add(tuple(sorted((r["id"], r["shard"], r["slot"]) for r in rows)))
    assert len(seen) == 1


def test_groups_of_all_sizes_stay_together(spark):
    """Every row is linked, so quotas are tight: far fewer cut links than by hashing, and none for groups that are dealt out first."""
    rng = random.Random(4)
    rows = [(g * 1_000 + k, f"g{g}") for g, n in enumerate([400, 390, 150, 90] + [rng.randrange(2, 30) for _ in range(120)]) for k in range(n)]
    docs = spark.createDataFrame(rows, "id long, link string")
    out = sharding.balanced_shards(docs, "link", 7).collect()
    groups = _check_shards(out, 7, "link")
    assert all(len(set(groups[f"g{g}"])) <= 2 for g in range(4))
    plain = sharding.cut_links(docs.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(7))), "link").first()
    assert sharding.cut_links(spark.createDataFrame(out), "link").first()["cut"] <= 0.15 * plain["cut"]


def test_small_groups_by_rounds(spark):
    """Groups that are small beside a shard are placed by propagation alone."""
    docs = spark.range(40_000).select("id", F.when(F.col("id") < 36_000, F.concat(F.lit("p"), (F.col("id") % 14_000).cast("string"))).alias("link"))
    out = sharding.balanced_shards(docs, "link", 5).select("link", "shard", "slot")
    counts = [(r["n"], r["m"]) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("m")).collect()]
    assert counts == [(8_000, 8_000)] * 5
    total = sharding.cut_links(out, "link").first()
    assert total["links"] == 36_000 - 14_000 and total["cut"] <= 0.01 * total["links"]


def test_ranks(spark):
    from gleaner.runtime import with_rank

    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    out = with_rank(Scratch(spark, "t"), df.unionByName(spark.createDataFrame([(None, 1), (None, 0)], "g long, v long")), ["g"], ["v"], "r").collect()
    for g in (0, 1, 2, None):
        mine = sorted((r["v"], r["r"]) for r in out if r["g"] == g)
        assert [r for _, r in mine] == list(range(len(mine)))
