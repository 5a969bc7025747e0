"""Near-duplicate detection: one-permutation MinHash, banded buckets, star edges.

Every document's set of word shingles gives one signature by one-permutation
hashing with optimal densification. Bands of it name buckets. In a bucket one
centre is paired with the other members, as a star, and pairs are confirmed on the
full sets. Members of a large star that are not in one component by then can only
be linked through shingles that are rare in it, or if what is common in it covers
most of both. First the latter are paired with hubs, which hold the most of what is
common; then they fall into groups by a prefix of the former and by sizes. Such a
group takes more centres until every pair of different components in it that can
be linked at all has been tested. So a text or passage that thousands of texts share costs a star
and not all their pairs, and no link between members of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import broadcast_if, table, wrapped
from gleaner.llm.words import Words, mix, slices, window_hashes
from gleaner.runtime import Scratch, ship_code

SHINGLE = 5
#: With 40 bands of 4 rows a pair of similarity 0.75 is missed about once in a million times.
BANDS, ROWS = 40, 4
SIMILARITY = 75  # per cent
#: Centres per group in the first round after the stars, and the factor from one to the next.
FIRST_CENTRES, MORE_CENTRES = 2, 8
#: Members up to which a star is one group; members of a larger one that tell what
#: is common in it; ratio of sizes in one size class. None changes a result.
SMALL_STAR, SAMPLED_MEMBERS, SIZE_STEP = 16, 64, 1.05
#: Ids up to which the texts that need full sets are picked by a broadcast (about
#: 10 MB); beyond it the texts are shuffled.
BROADCAST_IDS = 500_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's texts as (text, hash), sorted by both."""
    counts = words.counts
    n = len(words.hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n) - np.repeat(words.first[:-1], counts)
    length = np.repeat(counts, counts)
    full = np.flatnonzero(at + size <= length)
    texts, hashes = [text[full]], [window_hashes(words.hashes, size)[full] if len(full) else np.zeros(0, np.uint64)]
    for k in range(1, size):  # texts of fewer words are one shingle
        short = words.first[:-1][counts == k]
        if len(short):
            texts.append(np.flatnonzero(counts == k))
            hashes.append(window_hashes(words.hashes, k)[short])
    text, value = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def signatures(text: np.ndarray, value: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """One row of ``bins`` minima per text. A hash's high half picks its bin.

    An empty bin takes the minimum of the first filled bin in a random sequence
    that depends on the empty bin alone, and so is the same for all texts.
    """
    sig = np.full((texts, bins), _EMPTY, dtype=np.uint64)
    where = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    lead = np.ones(len(text), dtype=bool)
    lead[1:] = (text[1:] != text[:-1]) | (where[1:] != where[:-1])
    sig[text[lead], where[lead].astype(np.int64)] = value[lead]
    filled = sig != _EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    step = 0
    while len(row):
        probe = mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1))
        probe = ((probe >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        hit = filled[row, probe]
        sig[row[hit], col[hit]] = sig[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
        step += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weight = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    number = np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix((sig.reshape(len(sig), bands, rows) * weight).sum(axis=2, dtype=np.uint64) + number)


def _per_text(text: np.ndarray, x: np.ndarray, texts: int) -> np.ndarray:
    """Sums modulo 2**64 of x by text."""
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    edge = np.searchsorted(text, np.arange(texts + 1))
    return sums[edge[1:]] - sums[edge[:-1]]


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the shingle set (k1, k2), band keys."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), lower=True):
                ids = batch.column("doc_id").slice(words.rows.start, len(words.rows))
                text, value = shingle_sets(words)
                n = len(words.rows)
                keys = band_keys(signatures(text, value, n, bands * rows), bands, rows).view(np.int64)
                one, two = _per_text(text, mix(value), n), _per_text(text, mix(value ^ np.uint64(0x5851F42D4C957F2D)), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                size = np.bincount(text, minlength=n).astype(np.int64)
                columns = [ids, pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each row of (doc_id, text)."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), lower=True):
                text, value = shingle_sets(words)
                edge = np.searchsorted(text, np.arange(len(words.rows) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.rows.start, len(words.rows)), lists], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, shingles array<long>")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) with comp the smallest node of the component, for nodes of ``edges`` (u, v).

    Labels fall to the smallest among the neighbours' and then to that label's own
    label, so that they halve the distance to the smallest node each time.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = scratch.write(both)
    labels = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        theirs = labels.select(F.col("u").alias("v"), F.col("l").alias("theirs"))
        near = both.join(theirs, "v").groupBy("u").agg(F.min("theirs").alias("near"))
        step = labels.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "near").alias("l"))
        up = labels.select(F.col("u").alias("l"), F.col("l").alias("up"))
        jumped = scratch.write(step.join(up, "l", "left").select("u", "was", F.least("l", F.coalesce("up", "l")).alias("l")))
        changed = jumped.where("l < was").limit(1).count()
        scratch.drop(labels)
        labels = jumped.select("u", "l")
        labels._scratch_path = jumped._scratch_path  # type: ignore[attr-defined]
        if not changed:
            scratch.drop(both)
            out = labels.select(F.col("u").alias("node"), F.col("l").alias("comp"))
            out._scratch_path = labels._scratch_path  # type: ignore[attr-defined]
            return out


def linked(pairs: DataFrame, sets: DataFrame, per_cent: int = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("_x", "_y")))
    union = F.size("_x") + F.size("_y") - F.col("_i")
    return both.where(100 * F.col("_i") >= per_cent * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _enough(i: Column, n: Column, m: Column, per_cent: int) -> Column:
    """Whether ``i`` shared shingles link texts of ``n`` and ``m`` shingles."""
    return (100 + per_cent) * i >= per_cent * (n + m)


def _open_stars(scratch: Scratch, stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(c, node, n, comp, m) of the stars whose members are in several components; m counts members."""
    comps = labels.withColumnRenamed("node", "_n")
    named = stars.join(comps, F.col("node") == F.col("_n"), "left").select("c", "node", "n", F.coalesce("comp", "node").alias("comp"))
    several = named.groupBy("c").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"))
    several = several.where("x < y").select(F.col("c").alias("_c"), "m")
    return scratch.write(named.join(several, F.col("c") == F.col("_c")).drop("_c"))


def _size_class() -> Column:
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def _cored(scratch: Scratch, open_stars: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(c, node, n, k, u, first) of the members of large open stars.

    Let U be the shingles that an eighth of the star's members have, told from some
    of them. ``u`` counts a member's shingles in U; ``first`` are the first of its
    others, in hash order, of which linked texts share one if they share any; ``k``
    is the size class.
    """
    large = open_stars.where(F.col("m") > SMALL_STAR)
    some = large.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("node"), "node"))).where(F.col("_r") <= SAMPLED_MEMBERS)
    held = some.join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("c", "m", F.explode("shingles").alias("s"))
    often = held.groupBy("c", "s").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m")).where(8 * F.col("k") >= F.least("m", F.lit(SAMPLED_MEMBERS)))
    common = often.groupBy(F.col("c").alias("_u")).agg(F.collect_list("s").alias("_common"))
    both = large.join(common, F.col("c") == F.col("_u"), "left").join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    both = both.withColumn("_rest", F.array_except("shingles", F.coalesce("_common", F.array().cast("array<long>"))))
    first = F.slice("_rest", 1, (F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1).cast("int"))
    return scratch.write(both.select("c", "node", "n", _size_class().alias("k"), (F.size("shingles") - F.size("_rest")).alias("u"), first.alias("first")))


def _hub_pairs(open_stars: DataFrame, cored: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): members and the hub of each size class that they may be linked with through U alone.

    The hub has the most of U for its size. Texts x and y share u(x) + u(y) - |U|
    or more of U, so what is linked with anything by little but U is linked with a
    hub or nearly so, and few pairs are left for the groups. There is a hub per
    class and star, however many members.
    """
    share = per_cent / (100.0 + per_cent)
    rows = cored.drop("first").join(open_stars.select(F.col("c").alias("_c"), F.col("node").alias("_n"), "comp"), (F.col("c") == F.col("_c")) & (F.col("node") == F.col("_n"))).drop("_c", "_n")
    best = F.max_by(F.struct("node", "n", "u", "comp"), F.struct(F.col("u") - share * F.col("n"), -F.col("node")))
    hubs = rows.groupBy(F.col("c").alias("_c"), F.col("k").alias("_k")).agg(best.alias("h")).select("_c", "h")
    fits = (F.col("comp") != F.col("h.comp")) & _enough(F.least("u", F.col("h.u")), F.col("n"), F.col("h.n"), per_cent)
    return rows.join(hubs, (F.col("c") == F.col("_c")) & fits).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))


def _open_groups(scratch: Scratch, open_stars: DataFrame, cored: DataFrame, per_cent: int) -> DataFrame:
    """(bucket, node, n, comp, u, covered, side) of groups that hold all links left between members of a star.

    A small star is one group, with U empty. In a large one let x and y be linked,
    so that they share as many shingles as their sizes ask for. If one of them
    holds fewer of U, they share some of what is left of them, and the first of
    that in hash order is among ``first`` of either. If both hold as many, they
    meet in the covered group of their two size classes, where ``side`` keeps texts
    of one class from being paired unless both classes are the same, and where
    only such pairs count; elsewhere side is null. Any U gives right groups.
    """
    nothing = F.lit(None).cast("int").alias("side")
    small = open_stars.where(F.col("m") <= SMALL_STAR).select(F.xxhash64("c").alias("bucket"), "node", "n", "comp", F.lit(0).alias("u"), F.lit(False).alias("covered"), nothing)
    comps = open_stars.select(F.col("c").alias("_c"), F.col("node").alias("_n"), "comp")
    large = cored.join(comps, (F.col("c") == F.col("_c")) & (F.col("node") == F.col("_n"))).drop("_c", "_n")
    # Of a class it matters how few shingles a member has, and how many of U its members have at most.
    sizes = large.groupBy(F.col("c").alias("_z"), "k").agg(F.min("n").alias("low"), F.max("u").alias("most"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = sizes.groupBy("_z").agg(F.collect_list(F.struct("k", "low", "most", "x", "y")).alias("_sizes"))
    both = large.join(sizes, F.col("c") == F.col("_z"))

    def meets(z: Column) -> Column:
        """Whether a text of another component and this class may be linked by what U holds of both."""
        other = (z["x"] != F.col("comp")) | (z["y"] != F.col("comp"))
        return other & _enough(F.least(F.col("u"), z["most"]), F.col("n"), z["low"], per_cent)

    covered = F.transform(F.filter("_sizes", meets), lambda z: F.struct(
        F.xxhash64(F.lit("covered"), F.least(z["k"], F.col("k")), F.greatest(z["k"], F.col("k"))).alias("k"), F.lit(True).alias("covered"),
        F.when(z["k"] != F.col("k"), F.col("k")).alias("side")))
    shared = F.transform("first", lambda s: F.struct(F.xxhash64(F.lit("shingle"), s).alias("k"), F.lit(False).alias("covered"), nothing))
    rows = both.select("c", "node", "n", "comp", "u", F.explode(F.concat(shared, covered)).alias("_k"))
    grouped = small.unionByName(rows.select(F.xxhash64("c", "_k.k").alias("bucket"), "node", "n", "comp", "u", "_k.covered", "_k.side"))
    grouped = scratch.write(grouped)
    # Overlapping shingles make many groups of the same members: one of each is enough.
    who = F.xxhash64("node", "u", "covered", F.coalesce("side", F.lit(-1)))
    apart = grouped.groupBy("bucket").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), F.bit_xor(who).alias("s1"), F.bit_xor(F.xxhash64(who, F.lit(7))).alias("s2"))
    apart = apart.where("x < y").groupBy("m", "s1", "s2").agg(F.min("bucket").alias("_b")).select("_b")
    return grouped.join(apart, F.col("bucket") == F.col("_b"), "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, per_cent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id, text).

    Rows with equal shingle sets are one node, named by their smallest doc_id.
    Texts without words, null ones included, have no shingles and stay alone. A
    row with a null doc_id has a null component_id and is kept. Rows that share a
    doc_id are one document and in one component, whatever their texts. An empty
    table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.write(sketch(docs, bands, rows))
    usable = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = scratch.write(nodes)

    buckets = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("n").cast("int").alias("n"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    shared = scratch.write(shared.select(F.col("bucket").alias("_b"), F.col("a").alias("c")))
    stars = buckets.join(shared, F.col("bucket") == F.col("_b")).where("node <> c")
    stars = scratch.write(stars.select("c", "node", "n").distinct())
    scratch.drop(shared)
    wanted = stars.select(F.col("node").alias("_n")).unionByName(stars.select(F.col("c").alias("_n"))).distinct()
    wanted = scratch.write(wanted)
    wanted = broadcast_if(wanted, wanted.count(), BROADCAST_IDS)
    sets = scratch.write(full_sets(docs.join(wanted, F.col("doc_id") == F.col("_n"), "left_semi")))

    # Rows of one doc_id with different sets are linked from the start.
    same = usable.join(nodes.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "node"), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    of_row = scratch.write(same.select("doc_id", "node").distinct())
    links = [scratch.write(of_row.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).join(
        nodes.select(F.col("node").alias("u")).distinct(), "u", "left_semi"))]
    tested = stars.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"))
    links.append(scratch.write(linked(tested, sets, per_cent)))
    labels = components(scratch, _union(links))
    open_stars = _open_stars(scratch, stars, labels)
    cored = _cored(scratch, open_stars, sets, per_cent)
    pairs = scratch.write(_hub_pairs(open_stars, cored, per_cent).distinct().join(tested, ["a", "b"], "left_anti"))
    links.append(scratch.write(linked(pairs, sets, per_cent)))
    tested = tested.unionByName(pairs)
    scratch.drop(labels, open_stars)
    labels = components(scratch, _union(links))
    active = scratch.write(_open_groups(scratch, _open_stars(scratch, stars, labels), cored, per_cent))
    centres_each = FIRST_CENTRES
    while not active.isEmpty():
        held = active.groupBy(F.col("bucket").alias("_b"), "comp").agg(F.count(F.lit(1)).alias("k"))
        major = held.groupBy("_b").agg(F.max_by("comp", F.struct("k", "comp")).alias("_major"))
        order = Window.partitionBy("bucket").orderBy(F.col("comp") == F.col("_major"), "node")  # members of the largest component last
        ranked = active.join(major, F.col("bucket") == F.col("_b")).drop("_b").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= centres_each)
        centres = scratch.write(ranked.select(F.col("bucket").alias("_b"), F.col("node").alias("c"), F.col("n").alias("cn"), F.col("comp").alias("cc"), F.col("u").alias("cu"), F.col("side").alias("cs")))
        across = F.col("side").isNull() | (F.col("side") != F.col("cs"))
        inside, outside = F.least("u", "cu"), F.least(F.col("n") - F.col("u"), F.col("cn") - F.col("cu"))
        most = inside + F.when(F.col("covered"), F.lit(0)).otherwise(outside)  # shingles that the two can share, as far as this group has to tell
        fits = across & (F.col("comp") != F.col("cc")) & _enough(most, F.col("n"), F.col("cn"), per_cent)
        own = centres.select(F.col("_b").alias("_cb"), F.col("c").alias("_cn"), F.lit(True).alias("_is"))
        marked = active.join(own, (F.col("bucket") == F.col("_cb")) & (F.col("node") == F.col("_cn")), "left").drop("_cb", "_cn")
        once = F.col("_is").isNull() | (F.col("c") < F.col("node"))  # two centres meet once
        pairs = marked.join(centres, (F.col("bucket") == F.col("_b")) & fits & once)
        pairs = pairs.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()
        pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"))
        links.append(scratch.write(linked(pairs, sets, per_cent)))
        tested = tested.unionByName(pairs)
        scratch.drop(labels)
        labels = components(scratch, _union(links))
        left = marked.where(F.col("_is").isNull()).drop("comp", "_is").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        left = left.select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"), "u", "covered", "side")
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(F.col("bucket").alias("_b"))
        again = scratch.write(left.join(open_, F.col("bucket") == F.col("_b"), "left_semi"))
        scratch.drop(active, centres)
        active = again
        centres_each *= MORE_CENTRES
    scratch.drop(active, sets)

    named = nodes.select("k1", "k2", "node").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = named.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.coalesce("comp", "node").alias("component_id"))
    out = sketches.drop("bands").join(named, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id; same columns.

    Of rows that repeat a doc_id the first stays, in the order of their columns as
    JSON. Rows with a null doc_id stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id")
    kept = Scratch(docs.sparkSession, "kept").write(kept)
    ids = kept.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    rows = wrapped(docs, "doc_id")
    stay = rows.join(ids, F.col("doc_id") == F.col("_id"))
    if not ids.where("_rows > 1").isEmpty():
        first = stay.where("_rows > 1").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
        stay = stay.where("_rows = 1").select("row", "doc_id").unionByName(first)
    return stay.select("row").unionByName(rows.where(F.col("doc_id").isNull()).select("row")).select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
good AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edges AS (SELECT a AS u, b AS v FROM good UNION ALL SELECT b, a FROM good),
reach AS (
  WITH RECURSIVE r(doc_id, to_id) AS (
    SELECT u, v FROM edges UNION SELECT r.doc_id, e.v FROM r JOIN edges e ON e.u = r.to_id)
  SELECT doc_id, min(to_id) AS lowest FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(lowest, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(lowest, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.doc_id = d.doc_id
"""
