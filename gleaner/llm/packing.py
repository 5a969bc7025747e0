"""Best-fit packing of tokenised documents into fixed-length sequences.

Lengths are integers up to the sequence length, so how many pieces there are of
each length says all that packing needs. Best-two-fit runs on those counts and
yields bin patterns with multiplicities; the pieces then find their bins by their
rank among the pieces of their length. Work on the driver depends on the sequence
length, not on the number of documents.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.runtime import Scratch, ship_code, with_rank

#: Words a worker remembers the ids of; the memory starts anew beyond it.
MEMO_WORDS = 300_000
#: White space other than space and line feed. A text that has some is looked at closely.
_RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_BY_SPACE = re.compile(r"[\s\x1c-\x1f] | [\s\x1c-\x1f]")
_MEMO: dict[str, "_Memo"] = {}


def _words_stand_alone(text: str) -> bool:
    """Whether each space has other than white space on both sides."""
    if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _RARE_SPACE) or not _SPACE_BY_SPACE.search(text)


class _Memo(dict):
    """Ids, as little-endian bytes, of a word with the space before it.

    Byte-level BPE splits a text before each space that stands between other
    characters, so such words are encoded apart and a repeated one only once. A
    single word goes through the same vocabulary as ranks, which is several times
    faster and gives the same ids; all other texts go through the tokenizer.
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        from public_tokenizers import PATTERN
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.words = Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __bool__(self) -> bool:
        return True

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self.words.encode_ordinary(" " + word)
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or not _words_stand_alone(text):
            return self.direct(text)
        first, *rest = text.split(" ")
        return self.direct(first) + b"".join([self[w] for w in rest])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, length: int = 2048, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids of each document of (doc_id, text).

    A document is its ids and one ``end_id``; a null or empty text is the end id
    alone. Only longer ones are cut, so that all pieces but the first are full.
    ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit binary.
    Rows with equal or null doc_ids are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        memo = _MEMO.get(path) or _MEMO.setdefault(path, _Memo(path, tokenizer_path(ranks)))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memo.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % length or min(n, length)
                at = 0
                for piece in range(-(-n // length)):
                    size = first if piece == 0 else length
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, piece, at, size, zlib.crc32(part), part if with_ids else None))
                    at += size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds[:keep], strict=True)], names=names[:keep])

    ship_code(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns and how many bins follow each, for ``counts`` pieces by length.

    A bin takes the largest piece left, then again and again the largest that
    fits. Then its smallest piece m gives way to two unpacked pieces if two with
    a larger sum fit the gap that m leaves. A pattern is used as often as the
    counts allow, which leaves at least one length with too few pieces for it.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    patterns: list[tuple[list[int], int]] = []
    while True:
        largest = _largest_upto(left)
        if not largest[capacity]:
            return patterns
        free = left.copy()
        bin_: list[int] = []
        gap = capacity
        while True:
            size = int(_last_present(free, gap))
            if not size:
                break
            bin_.append(size)
            free[size] -= 1
            gap -= size
        if gap and len(bin_) > 0:
            pair = _best_pair(free, gap + bin_[-1])
            if pair and sum(pair) > bin_[-1]:
                free[bin_.pop()] += 1
                bin_ += pair
        use = np.bincount(bin_, minlength=capacity + 1)
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        patterns.append((bin_, times))


def _largest_upto(left: np.ndarray) -> np.ndarray:
    """For each x the largest length up to x that is left, or 0."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def _last_present(left: np.ndarray, upto: int) -> int:
    found = np.flatnonzero(left[1 : upto + 1] > 0)
    return int(found[-1]) + 1 if len(found) else 0


def _best_pair(left: np.ndarray, room: int) -> list[int] | None:
    """The two lengths left with the largest sum up to ``room``."""
    sizes = np.flatnonzero(left > 0)
    sizes = sizes[(sizes > 0) & (sizes < room)]
    if not len(sizes):
        return None
    other = _largest_upto(left)[np.minimum(room - sizes, len(left) - 1)]
    alone = (other == sizes) & (left[sizes] < 2)
    if alone.any():
        below = _largest_upto(left)[np.maximum(sizes - 1, 0)]
        other = np.where(alone, below, other)
    total = np.where(other > 0, sizes + other, 0)
    best = int(total.argmax())
    return sorted((int(sizes[best]), int(other[best])), reverse=True) if total[best] else None


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Per length and run of ranks: key of the first rank, first bin, offset in the bin."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            rank = taken.get(size, 0)
            rows.append((size << 48 | rank, rank, first_bin, offset))
            taken[size] = rank + times
            offset += size
        first_bin += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    Only the counts by length come to the driver: ``capacity`` numbers at most.
    Empty input gives no rows; equal pieces take any of their places.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    pieces = scratch.write(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, ranks, bins, offsets = _places(best_two_fit(counts, capacity))
    order = [c for c in pieces.columns if c != "length"]
    ranked = with_rank(scratch, pieces, ["length"], order, "_rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            new = [pa.array(bins[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=[*names, "sequence_id", "offset"])

    ship_code(pieces.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
