"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classic English stop words of full-text search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
#: Line ends that Python knows: after any of these a new line begins.
_LINE_END = "(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85  ])"
_BLANK = r"(?U)^[\s\x1C-\x1F]*$"


def decode_utf8(content: Column) -> Column:
    """Bytes as text: U+FFFD for what is not UTF-8, and every line end a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines with their ends kept; no empty line after the last end."""
    return F.filter(F.split(text, _LINE_END, -1), lambda line: line != "")


def is_blank(text: Column) -> Column:
    return text.rlike(_BLANK)


def tokens(text: Column) -> Column:
    """Search terms: lower-case runs of letters and digits without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def path_matches(path: Column, expected: Column) -> Column:
    """Equal, or ends with ``expected`` after a slash."""
    return (path == expected) | F.endswith(path, F.concat(F.lit("/"), expected))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or empty. A leading dot starts no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def chunk_id(source_path: Column, index: Column) -> Column:
    return F.concat_ws("::", source_path, index.cast("string"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def age_seconds(stamp: Column, now: Column) -> Column:
    """Whole seconds since an ISO time, cut towards zero; null if it is none."""
    at = F.try_to_timestamp(stamp)
    return ((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000).cast("long")
