"""Sharding by balanced label propagation.

Documents that are linked (by default: equal texts) move towards the shard that
most of their neighbours are in, as far as quotas allow; what finds it full asks
again elsewhere. Documents without links fill the shards up, so that row counts end
at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.runtime import Scratch, with_rank

_UNIT = float(1 << 53)
#: Groups of more than a shard's rows over this number are large. There are fewer
#: than that many per shard, however many rows, so the driver deals them out.
GRAIN = 64


def _unit(*columns: Column | str) -> Column:
    """A number from 0 up to 1 that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(_UNIT)


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _content(docs: DataFrame) -> list[Column]:
    """Columns that can be hashed and say all of a row; maps are taken as JSON."""
    return [F.to_json(F.struct(F.col(f"`{n}`"))) if "map<" in t else F.col(f"`{n}`") for n, t in docs.dtypes]


def deal_large(units: list[tuple[int, tuple, dict[int, int]]], quotas: list[int]) -> tuple[dict[tuple, int], list[int]]:
    """A shard for each (size, name, members by shard), and the rows that each shard has then.

    The largest go first, each to the shard with most of its members among those
    that have room for all of it, else to the one with most room.
    """
    room, where = list(quotas), {}
    for size, name, members in sorted(units, key=lambda u: (-u[0], str(u[1]))):
        fits = [s for s in range(len(room)) if room[s] >= size] or [max(range(len(room)), key=lambda s: room[s])]
        to = max(fits, key=lambda s: (members.get(s, 0), room[s], -s))
        where[name] = to
        room[to] -= size
    return where, [q - r for q, r in zip(quotas, room, strict=True)]


def _propagate(scratch: Scratch, units: DataFrame, load: list[int], quotas: list[int], rounds: int) -> DataFrame:
    """(_link, _shard): a shard for every group of (_link, _size, members), whole groups only.

    In each round every group that has no place yet asks for the shard with most
    of its members among those with room; shards without any of them come after,
    in proportion to their room. A shard accepts groups up to its quota, by a hash,
    and the next round sees the room that is left. The driver holds a number per shard.
    """
    load, settled = list(load), []
    for k in range(rounds):
        room = [max(0, q - n) for q, n in zip(quotas, load, strict=True)]
        last = k == rounds - 1 or not any(room)
        weights = [max(r, 1) if last else r for r in room]
        choice = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).cast("double").alias("w")) for s, w in enumerate(weights)])
        # Of shards alike to a group the one is taken that wins a draw weighted by room.
        scored = F.transform(F.filter(choice, lambda c: c["w"] > 0), lambda c: F.struct(
            F.coalesce(F.try_element_at("members", c["s"]), F.lit(0)).alias("n"), (F.log(F.greatest(_unit("_link", c["s"], F.lit(k)), F.lit(1e-18))) / c["w"]).alias("d"), c["s"].alias("s")))
        asked = scratch.write(units.withColumn("_to", F.array_max(scored)["s"]))
        wanted = {r["_to"]: r["n"] for r in asked.groupBy("_to").agg(F.sum("_size").alias("n")).collect()}
        if not wanted:
            break
        part = F.array(*[F.lit(1.0 if last or wanted.get(s, 0) <= room[s] else room[s] / wanted[s]) for s in range(len(room))])
        goes = _unit("_link", F.lit(-1 - k)) < F.element_at(part, F.col("_to") + 1)
        new = scratch.write(asked.where(goes).select("_link", "_size", F.col("_to").alias("_shard")))
        for r in new.groupBy("_shard").agg(F.sum("_size").alias("n")).collect():
            load[r["_shard"]] += r["n"]
        settled.append(new.select("_link", "_shard"))
        units = asked.where(~goes).drop("_to")
    out = units.select("_link", F.lit(0).alias("_shard")).where(F.lit(False)) if not settled else settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def balanced_shards(docs: DataFrame, link: str, shards: int = 24, rounds: int = 8) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row; ``link`` names the column that links rows.

    Rows begin in a shard that their content decides. A group of rows with equal
    links that fits one shard ends in one, unless quotas part it; a larger one fills
    as many shards as it needs. Large groups are cut into units of at most a shard
    and dealt out first, the others by rounds in which whole groups ask for the
    shard with most of their members and are accepted up to its quota. Rows that
    exceed a quota in the end, those without links first, go where rows are
    missing. Groups travel as histograms of at most ``shards`` numbers, and rows
    of large groups are never gathered by their link.

    The result depends on the rows' contents alone, not on their layout; rows that
    are equal throughout are interchangeable. Rows with a null link have no
    neighbours. Repeated rows and repeated or null ids are rows of their own. An
    empty table gives no rows. Other columns are carried along; columns that are
    called shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    scratch = Scratch(docs.sparkSession, "shards")
    names, content = docs.columns, _content(docs)
    rows = docs.withColumns({"_rid": F.monotonically_increasing_id(), "_key": F.xxhash64(*content), "_key2": F.xxhash64(F.lit(1), *content)})
    rows = scratch.write(rows.withColumnRenamed(link, "_link"))
    quotas = _quotas(rows.count(), shards)
    cap, grain = max(1, min(quotas)), max(1, min(quotas) // GRAIN)
    state = rows.select("_rid", "_key", "_key2", "_link", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(shards)).cast("int").alias("_shard"))
    sizes = scratch.write(state.where(F.col("_link").isNotNull()).groupBy("_link").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"))

    big = F.broadcast(sizes.where(F.col("_size") > grain).select(F.col("_link").alias("_l"), "_size"))  # at most a row per ``grain`` rows, and so GRAIN a shard
    large = with_rank(scratch, state.join(big, F.col("_link") == F.col("_l")).drop("_l"), ["_link"], ["_shard", "_key", "_key2", "_rid"], "_turn")
    large = scratch.write(large.withColumn("_unit", F.floor(F.col("_turn") / cap).cast("int")))
    found: dict[tuple, dict[int, int]] = {}
    for r in large.groupBy("_link", "_unit", "_shard").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``shards`` rows per unit
        found.setdefault((r["_link"], r["_unit"]), {})[r["_shard"]] = r["n"]
    dealt, load = deal_large([(sum(m.values()), name, m) for name, m in found.items()], quotas)
    columns = [large.schema["_link"], *docs.sparkSession.createDataFrame([], "_u int, _to int").schema]
    homes = docs.sparkSession.createDataFrame([(*name, s) for name, s in dealt.items()], type(large.schema)(columns)).withColumnRenamed("_link", "_l")
    of_large = large.join(F.broadcast(homes), (F.col("_link") == F.col("_l")) & (F.col("_unit") == F.col("_u")))
    kept = ["_rid", "_key", "_key2", "_link", "_size"]
    of_large = of_large.select(*kept, F.col("_to").alias("_shard"))

    others = state.join(big.drop("_size"), F.col("_link") == F.col("_l"), "left_anti")
    small = sizes.where(F.col("_size") <= grain)
    members = others.where(F.col("_link").isNotNull()).groupBy("_link", "_shard").agg(F.count(F.lit(1)).alias("n"))
    members = members.groupBy("_link").agg(F.sum("n").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_shard", "n"))).alias("members")).where("_size > 1")
    placed = _propagate(scratch, scratch.write(members), load, quotas, rounds)
    homes = placed.join(small, "_link").select(F.col("_link").alias("_l"), "_size", F.col("_shard").alias("_to"))
    linked = others.where(F.col("_link").isNotNull()).join(homes, F.col("_link") == F.col("_l"), "left")
    linked = linked.select(*kept, F.coalesce("_to", "_shard").alias("_shard"))
    alone = others.where(F.col("_link").isNull()).withColumn("_size", F.lit(None).cast("long")).select(*kept, "_shard")

    state = of_large.unionByName(linked).unionByName(alone)
    order = [F.col("_size").desc_nulls_last(), F.when(F.col("_size").isNotNull(), F.col("_link")), F.col("_key"), F.col("_key2"), F.col("_rid")]
    ranked = scratch.write(with_rank(scratch, state, ["_shard"], order, "_place"))
    load = [0] * shards
    for r in ranked.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect():
        load[r["_shard"]] = r["n"]
    quota = F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("_shard") + 1)
    over = F.col("_place") >= quota
    surplus = ranked.where(over).withColumn("_all", F.lit(0))
    surplus = with_rank(scratch, surplus, ["_all"], order, "_turn")
    goes, upto = F.lit(None).cast("int"), 0
    for s in range(shards):
        missing = max(0, quotas[s] - load[s])
        goes = F.when((F.col("_turn") >= upto) & (F.col("_turn") < upto + missing), F.lit(s)).otherwise(goes)
        upto += missing
    placed = ranked.where(~over).select("_rid", F.col("_shard").alias("shard")).unionByName(surplus.select("_rid", goes.alias("shard")))
    whole = rows.join(placed, "_rid").withColumnRenamed("_link", link)
    return with_rank(scratch, whole, ["shard"], [F.col("_key"), F.col("_key2"), F.col("_rid")], "slot").select(*names, "shard", "slot")


def cut_links(rows: DataFrame, link: str) -> DataFrame:
    """One row: ``links``, the rows that equal links tie to another one, and ``cut``, those that lie outside the shard with most of their group."""
    per_shard = rows.where(F.col(link).isNotNull()).groupBy(link, "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = per_shard.groupBy(link).agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    zero = F.lit(0).cast("long")
    return groups.agg(F.coalesce(F.sum(F.col("size") - 1), zero).alias("links"), F.coalesce(F.sum(F.col("size") - F.col("most")), zero).alias("cut"))


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"),
    )
    out = balanced_shards(docs, "text_md5")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "text_md5")
