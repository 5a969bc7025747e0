import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleaner.operators.chunking import chunk_code, chunk_files, chunk_markdown, cut_spans


def _files(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), "h", v) for k, v in texts.items()], "source_path string, file_hash string, text string")


def _paths(spark, text):
    return [r["heading_path"] for r in chunk_markdown(_files(spark, a_md=text)).orderBy("chunk_index").collect()]


@pytest.mark.parametrize(("text", "paths"), [
    ("", []), (" \n\x1c", []), ("# A\nx\n## B\ny\n# C\nz\n", ["/A", "/A/B", "/C"]), ("# A\nx\n### B\n", ["/A", "/A/B"]),
    ("before\n# A\n", ["", "/A"]), ("# A\r\nx\r\n## B\r\n", ["/A", "/A/B"]), ("---\nnever closed\n", [""]), ("#  \nx", ["/"]), ("# \nx", [""]),
    ("####### no\n", [""]), ("# A ##\n", ["/A ##"]), ("#A\n", [""]),
])
def test_headings(spark, text, paths):
    assert _paths(spark, text) == paths


def test_front_matter_is_left_out_but_counts(spark):
    text = "---\nupdated: 2026-10-19\ntags: [a]\n---\n# T\nbody\n"
    (row,) = chunk_markdown(_files(spark, a_md=text)).collect()
    assert (row["char_start"], row["char_end"], str(row["note_date"]), row["tags"]) == (text.index("# T"), len(text), "2026-10-19", ["a"])


@pytest.mark.parametrize(("lines", "starts"), [(60, [0]), (61, [0, 50]), (110, [0, 50]), (111, [0, 50, 100])])
def test_line_windows(spark, lines, starts):
    text = "".join(f"{i:03}\n" for i in range(lines))
    rows = chunk_code(_files(spark, a_py=text)).orderBy("chunk_index").collect()
    assert [r["char_start"] // 4 for r in rows] == starts
    assert rows[-1]["char_end"] == len(text)
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in rows)


def test_windows_need_a_step(spark):
    with pytest.raises(ValueError, match="window"):
        chunk_code(_files(spark, a_py="x"), 10, 10)


def test_other_line_ends(spark):
    text = "a\x0bb\x85c d\x1ce"
    rows = chunk_code(_files(spark, a_py=text), 1, 0).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == text.splitlines(keepends=True)


def test_blank_files_and_dispatch(spark):
    rows = chunk_files(_files(spark, a_py=" \n", b_MD=" \n", c_mdx="# A\n")).collect()
    assert sorted((r["source_path"], r["heading_path"]) for r in rows) == [("a.py", ""), ("c.mdx", "")]


def test_caps(spark):
    rows = chunk_code(_files(spark, a_py="x" * 40_000)).orderBy("chunk_index").collect()
    assert [(r["char_start"], r["char_end"]) for r in rows] == [(0, 24_000), (24_000, 40_000)]
    text = "# Section\n\n" + "x" * 35_000 + "\n"
    rows = chunk_markdown(_files(spark, a_md=text)).orderBy("chunk_index").collect()
    spans = [(r["char_start"], r["char_end"]) for r in rows]
    assert len(spans) == 45 and spans[:11] == [(i, 11) for i in range(11)] and spans[11:13] == [(11, 1211), (1061, 2261)] and spans[-1][1] == 35_012
    assert all(text[a:b] == r["text"] for r, (a, b) in zip(rows, spans, strict=True))


@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 40), st.integers(0, 30))
def test_spans_cover_the_text(text, cap, overlap):
    spans = cut_spans(text, cap, overlap)
    assert all(0 < e - s <= cap for s, e in spans)
    covered = set().union(*(range(s, e) for s, e in spans)) if spans else set()
    assert covered == set(range(len(text)))
    assert [s for s, _ in spans] == sorted({s for s, _ in spans})
