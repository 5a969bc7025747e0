"""Chunkers: code by line windows, Markdown by headings, both with a size cap.

Offsets count characters of the decoded text, so that a chunk is always the
substring between its offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import frontmatter as fm
from gleaner.functions import text as tx

WINDOW_LINES, OVERLAP_LINES = 60, 10
CODE_CAP, CODE_OVERLAP = 24_000, 0
NOTE_CAP, NOTE_OVERLAP = 1_200, 150
HEADING = r"^(#{1,6}) +(.+?)[\s\x1C-\x1F]*$"

#: Columns every chunker adds to those of its input (source_path, file_hash, ...).
ADDED = ("chunk_index", "char_start", "char_end", "heading_path", "text")


def chunk_code(files: DataFrame, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, cap: int = CODE_CAP, cap_overlap: int = CODE_OVERLAP) -> DataFrame:
    """Windows of ``window`` lines that overlap by ``overlap``; the last one ends the text.

    ``files`` has source_path, file_hash and text. An empty text gives no chunk, a
    blank one does.
    """
    if window <= overlap:
        raise ValueError("window_lines must be larger than overlap_lines")
    step = window - overlap
    lines = files.where(F.col("text") != "").withColumn("_lines", tx.split_lines(F.col("text")))
    n = F.size("_lines")
    count = F.when(n <= window, 1).otherwise(F.ceil((n - window) / step) + 1).cast("int")
    lines = lines.withColumn("_starts", F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step))
    skipped = F.transform("_starts", lambda s: F.length(F.array_join(F.slice("_lines", s + 1, F.lit(step)), "")))
    lines = lines.withColumn("_skipped", skipped)
    windows = F.transform("_starts", lambda s, i: F.struct(
        F.aggregate(F.slice("_skipped", 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("at"),
        F.array_join(F.slice("_lines", s + 1, F.lit(window)), "").alias("text")))
    return _finish(lines, windows, F.lit(""), cap, cap_overlap, None)


def chunk_markdown(files: DataFrame, fields: fm.Fields = fm.Fields(), cap: int = NOTE_CAP, cap_overlap: int = NOTE_OVERLAP) -> DataFrame:
    """A chunk per heading with its body, and one for what stands before the first.

    Front matter is left out of the chunks; its date, status and tags go on each of
    them. Blank sections give no chunk.
    """
    body = files.withColumn("_lead", fm.fence_length(F.col("text")))
    body = body.withColumn("_body", F.expr("substring(text, _lead + 1)")).withColumn("_lines", tx.split_lines(F.col("_body")))
    bare = lambda line: F.regexp_replace(line, "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]+$", "")
    heads = F.filter(
        F.transform("_lines", lambda line, i: F.struct(
            i.alias("line"), F.length(F.regexp_extract(bare(line), HEADING, 1)).alias("level"),
            F.regexp_replace(F.regexp_extract(bare(line), HEADING, 2), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "").alias("title"))),
        lambda h: h["level"] > 0)
    body = body.withColumn("_heads", heads)
    begins = F.concat(F.array(F.lit(0)), F.transform("_heads", lambda h: h["line"]))
    body = body.withColumn("_begins", begins)
    until = lambda i: F.coalesce(F.get("_begins", i + 1), F.size("_lines"))
    texts = F.transform("_begins", lambda b, i: F.array_join(F.slice("_lines", b + 1, until(i) - b), ""))
    body = body.withColumn("_texts", texts).withColumn("_sizes", F.transform("_texts", lambda t: F.length(t)))
    nothing = F.expr("cast(array() as array<struct<line:int,level:int,title:string>>)")
    stack = lambda i: F.aggregate(F.slice("_heads", 1, i), nothing, lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(h)))
    named = lambda s: F.when(F.size(s) > 0, F.concat(F.lit("/"), F.array_join(F.transform(s, lambda h: h["title"]), "/"))).otherwise(F.lit(""))
    sections = F.transform("_texts", lambda t, i: F.struct(
        (F.col("_lead") + F.aggregate(F.slice("_sizes", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("at"),
        t.alias("text"), named(stack(i)).alias("path")))
    sections = F.filter(sections, lambda s: ~tx.is_blank(s["text"]))
    body = body.withColumn("_meta", fm.parse_column(fm.fence_block(F.col("text")), fields))
    return _finish(body, sections, None, cap, cap_overlap, "_meta")


def _finish(files: DataFrame, parts: Column, path: Column | None, cap: int, overlap: int, meta: str | None) -> DataFrame:
    """Explode the parts, cut those over the cap, and number the chunks of each file."""
    keep = [c for c in files.columns if not c.startswith("_") and c not in ADDED]
    extra = [F.col(f"{meta}.{n}").alias(n) for n in ("note_date", "status", "tags")] if meta else []
    rows = files.select(*keep, *extra, F.posexplode(parts).alias("_part", "_p"))
    heading = F.col("_p.path") if path is None else path
    rows = rows.select("*", F.col("_p.at").cast("long").alias("_at"), F.col("_p.text").alias("_t"), heading.alias("heading_path"))
    return split_oversized(rows, cap, overlap).drop("_part", "_p", "_at", "_t")


#: Where a text may be cut, best first: a mark, the part of a span that must come before it, and the mark's length.
BREAKS = ((re.compile(r"(?=\n\n)"), 2, 2), (re.compile(r"\n"), 2, 1), (re.compile(r"\s"), 0, 1))


def cut_spans(text: str, cap: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``cap`` characters that cover a text.

    A span that is not the last ends after the last paragraph break in its second
    half, else after the last line break there, else after the last white space
    anywhere in it, else at the cap. The next one starts ``overlap`` before its
    end, but always at least one character after its start.

    All marks of a text are listed once; a span's end is then a search in the lists.
    """
    if len(text) <= cap:
        return [(0, len(text))] if text else []
    listed = [([m.start() for m in mark.finditer(text)], part, size) for mark, part, size in BREAKS]

    def end_of(at: int) -> int:
        for places, part, size in listed:
            last = bisect_right(places, at + cap - size) - 1
            if last >= 0 and places[last] >= at + (cap // part if part else 0):
                return places[last] + size
        return at + cap

    spans = [(0, end_of(0))]
    while spans[-1][1] < len(text):
        at = max(spans[-1][0] + 1, spans[-1][1] - overlap)
        spans.append((at, end_of(at) if at + cap < len(text) else len(text)))
    return spans


def split_oversized(rows: DataFrame, cap: int, overlap: int) -> DataFrame:
    """Cut parts (_part, _at, _t) at the cap and number what results per source_path.

    Only parts over the cap meet Python.
    """

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"s": s, "e": e} for s, e in cut_spans(t, cap, overlap)] for t in texts])

    size = F.length("_t")
    whole = F.array(F.struct(F.lit(0).alias("s"), size.alias("e")))
    names = rows.columns
    long = rows.where(size > cap).withColumn("_spans", spans("_t"))
    cut = rows.where(size <= cap).withColumn("_spans", whole).unionByName(long)
    cut = cut.select(*names, F.posexplode("_spans").alias("_sub", "_span"))
    order = Window.partitionBy("source_path").orderBy("_part", "_sub")
    return cut.select(
        *names, (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), (F.col("_at") + F.col("_span.s")).alias("char_start"),
        (F.col("_at") + F.col("_span.e")).alias("char_end"), F.expr("substring(_t, _span.s + 1, _span.e - _span.s)").alias("text"),
    )


def chunk_files(files: DataFrame, fields: fm.Fields = fm.Fields()) -> DataFrame:
    """Markdown for names that end in .md, whatever the case; line windows for all others."""
    note = tx.extension(F.col("source_path")) == ".md"
    code = chunk_code(files.where(~note))
    empty = F.expr("cast(array() as array<string>)")
    code = code.withColumns({"note_date": F.lit(None).cast("date"), "status": F.lit(None).cast("string"), "tags": empty})
    return code.unionByName(chunk_markdown(files.where(note), fields))
