"""Near duplicates, substrings, licenses, packing, quality."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, no_docs, odd_docs, odd_rows, same_as_sql, save, with_extra
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import licenses, neardup, packing, quality, substring
from gleaner.llm import words as wd
from gleaner.runtime import Scratch

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=SPACES + "aBé日\xa0", max_size=40)), max_size=12), st.integers(0, 3))
def test_words(texts, skip):
    column = pa.array([None] * skip + texts, pa.string()).slice(skip)
    got = [(words.data[a:b].tobytes(), int(h)) for words in wd.slices(column, lower=True) for a, b, h in zip(words.starts, words.ends, words.hashes, strict=True)]
    want = [w for t in texts for w in (t or "").encode().split()]
    assert [w for w, _ in got] == want
    by = {}
    for w, h in got:
        assert by.setdefault(w.lower(), h) == h
    assert len(set(by.values())) == len(by)


def test_long_texts_go_by_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5_000))
    (whole,) = wd.slices(pa.array([text]))
    monkeypatch.setattr(wd, "SLICE_BYTES", 1_000)
    (parts,) = wd.slices(pa.array([text]))
    assert (whole.hashes == parts.hashes).all()


def test_words_of_a_slice_take_little_memory(monkeypatch):
    """Blocks of any size give the same hashes, and a slice takes less than 32 times its bytes, powers included."""
    column = pa.array(["one two three " * 140_000 + "x" * 300_000])
    monkeypatch.setattr(wd, "_POWERS", {})
    tracemalloc.start()
    try:
        (words,) = wd.slices(column)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * wd.SLICE_BYTES
    for block in (1_000, 1 << 23):
        monkeypatch.setattr(wd, "BLOCK_BYTES", block)
        (again,) = wd.slices(column)
        assert (again.hashes == words.hashes).all()


def test_cut_goes_by_slices(monkeypatch):
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(60)) for i in range(40)]
    hits = [[3, 10] if i % 3 == 0 else None for i in range(40)]
    columns = {"text_key": pa.array([b"%d" % i for i in range(40)]), "text": pa.array(texts), "copies": pa.array([1 + (i == 5) for i in range(40)], pa.int64()), "windows": pa.array(hits, pa.list_(pa.int32()))}
    batch = pa.RecordBatch.from_pydict(columns)
    (whole,) = substring._cut(batch.slice(1), 35)
    monkeypatch.setattr(wd, "SLICE_BYTES", 1_000)
    parts = list(substring._cut(batch.slice(1), 35))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert whole.column("n_removed").to_pylist() == [60 if i == 5 else 42 if i % 3 == 0 else 0 for i in range(1, 40)]
    assert [t for t, n in zip(whole.column("kept_text").to_pylist(), whole.column("n_removed").to_pylist(), strict=True) if not n] == [t for i, t in enumerate(texts) if i % 3 and i != 5]


def test_window_hashes_tell_windows_apart():
    h = wd.mix(np.arange(1, 9, dtype=np.uint64))
    seq = np.concatenate([h, h, h[::-1]])
    w = wd.window_hashes(seq, 3)
    same = [(i, j) for i in range(len(w)) for j in range(i) if w[i] == w[j]]
    assert same == [(i, j) for i in range(len(w)) for j in range(i) if (seq[i : i + 3] == seq[j : j + 3]).all()]
    assert len(wd.window_hashes(h, 9)) == 0


def test_near_duplicates_match_sql(spark, tmp_path):
    same_as_sql(neardup.op6_near_duplicates(spark, SF), neardup.OP6_SQL, SF, "documents")


def _brute(rows):
    sets = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            inter = len(sets[i] & sets[j])
            linked = sets[i] and 100 * inter >= 75 * len(sets[i] | sets[j])
            if None not in (rows[i][0], rows[j][0]) and (linked or rows[i][0] == rows[j][0]):
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least[top(i)]) if r[0] is not None else "None") for i, r in enumerate(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_of_odd_rows(spark, seed):
    rows = odd_rows(seed) + [(8, "another text under an id that is taken already", "en", "a", 1)]
    got = neardup.near_duplicates(with_extra(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_chains_and_centres(spark, monkeypatch):
    """Each text is linked with the next only, and all share buckets: many rounds of centres."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows, now = [], base[:]
    for i in range(30):
        rows.append((100 - i, " ".join(now), "en", "a", 1))
        for _ in range(3):
            now[rng.randrange(200)] = f"c{rng.randrange(10**6)}"
    monkeypatch.setattr(neardup, "FIRST_CENTRES", 1)
    monkeypatch.setattr(neardup, "MORE_CENTRES", 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute(rows)


def _family(seed, copies, others):
    """Near copies with up to nine edits, of which many end near the threshold, and texts that share one passage."""
    rng = random.Random(seed)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(30)]
    rows = []
    for i in range(copies):
        now = base[:]
        for e in range(rng.randrange(10)):
            at = rng.randrange(len(now))
            now[at : at + 1] = rng.choice(([], [f"x{i}.{e}"], [now[at], f"y{i}.{e}"], [f"x{i}.{e}"]))
        rows.append((i, " ".join(now), "en", "a", 1))
    for i in range(others):
        rows.append((copies + i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice((2, 4, 60)))]), "en", "a", 1))
    rng.shuffle(rows)
    return rows


def test_large_families_cost_few_pairs(spark, monkeypatch):
    """No link is lost, and the rows of the joins that pair texts grow like the family and not like its square."""
    made = []
    write = Scratch.write

    def counted(self, df):
        out = write(self, df)
        if df.columns == ["a", "b"]:
            made[-1] += out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    for n in (150, 300):
        rows = _family(n, n, n // 3)
        made.append(0)
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute(rows)
    assert made[1] <= 3 * made[0] and made[1] <= 10 * 400


def test_one_of_rows_that_repeat_an_id_stays(spark):
    rows = [(1, "b b", "en", "a", 1), (1, "a a", "de", "a", 1), (1, "a a", "en", "a", 1), (2, "c", None, None, None)]
    for parts in (1, 3):
        out = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(1, "a a", "de"), (2, "c", None)]


def test_near_duplicate_filter(spark):
    docs = with_extra(odd_docs(spark))
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    want = {int(c) for d, _, c in _brute(odd_rows()) if c != "None"}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 3
    assert neardup.drop_near_duplicates(no_docs(spark)).collect() == []
    assert neardup.near_duplicates(no_docs(spark)).collect() == []


def test_signatures_keep_similarity():
    rng = np.random.default_rng(0)
    pool = wd.mix(rng.integers(1, 2**62, 4_000).astype(np.uint64))
    for n in (1, 2, 4, 40, 400):
        close = []
        for k in range(30):
            a, b = np.sort(pool[k : k + n]), np.sort(pool[k + max(1, n // 8) : k + max(1, n // 8) + n])
            text = np.repeat([0, 1], n)
            sig = neardup.signatures(text, np.concatenate([a, b]), 2, 160)
            close.append((sig[0] == sig[1]).mean())
        shared = max(0, n - max(1, n // 8))
        assert abs(np.mean(close) - shared / (2 * n - shared)) < 0.08


def test_substrings_match_sql(spark, tmp_path):
    same_as_sql(substring.op8_cut_repeats(spark, SF), substring.OP8_SQL, SF, "documents")
    folder = save(tmp_path, documents=with_extra(odd_docs(spark)))
    rows = same_as_sql(substring.op8_cut_repeats(spark, folder), substring.OP8_SQL, folder, "documents")
    assert len(rows) == odd_docs(spark).count()
    empty = save(tmp_path / "none", documents=no_docs(spark))
    assert substring.op8_cut_repeats(spark, empty).collect() == []


def test_substrings_at_all_shifts(spark, tmp_path):
    """One passage at every residue of the period, of lengths around the window."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(45):
        part = passage[: (34, 35, 36, 40)[i % 4]]
        rows.append((i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(i % 22)] + part + [f"z{rng.randrange(10**6)}" for _ in range(i % 7)]), "en", "a", 1))
    folder = save(tmp_path, documents=spark.createDataFrame(rows, DOCS))
    same_as_sql(substring.op8_cut_repeats(spark, folder), substring.OP8_SQL, folder, "documents")


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_substring_filter(spark):
    docs = with_extra(odd_docs(spark))
    out = substring.remove_repeats_from(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "" and texts[5] is None and texts[7] == " \t\n" and texts[16] == "<|endoftext|> a  b \n c"


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.lists(st.integers(0, 5), max_size=16))
def test_alignment(template, text):
    n, first, end = licenses.align(template, [-1] * len(template) + text, len(template) + len(text))
    assert n == _lcs(template, text)
    if n:
        assert _lcs(template, ([-1] * len(template) + text)[first:end]) == n


@given(st.lists(st.integers(0, 9), min_size=5, max_size=30), st.lists(st.integers(0, 9), max_size=10), st.lists(st.integers(0, 9), max_size=10))
def test_winnowing_guarantee(common, before, after):
    def prints(seq):
        grams = wd.window_hashes(wd.mix(np.array(seq, dtype=np.uint64) + np.uint64(1)), licenses.GRAM)
        return {int(grams[p]) for p in licenses.winnow(grams)}

    assert prints(common) & prints(before + common + after)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "at no charge").replace("merge, ", "").upper()
    rows = [(1, "é. Released under the MIT license", "en", "a", 1), (2, f"intro {edited} outro", "en", "a", 1), (3, "the license of a library, under the sun", "en", "a", 1), (None, "Licensed under CC\nBY-NC 4.0; Licensed under CC BY NC 4.0", "en", "a", 1)]
    docs = spark.createDataFrame(rows + odd_rows(), DOCS)
    got = licenses.scan_licenses(with_extra(docs)).collect()
    by = {(r["doc_id"], r["license"], r["start"]): r for r in got}
    text = {r[0]: r[1] for r in rows}
    one = next(r for r in got if r["doc_id"] == 1 and r["license"] == "mit-notice")
    assert text[1][one["start"] : one["end"]] == "Released under the MIT license" and one["coverage"] == 1.0
    two = next(r for r in got if r["license"] == "mit")
    assert licenses.scan_licenses(docs, {}).collect() == licenses.scan_licenses(docs, {"none": " . "}).collect() == []
    assert text[2][two["start"] : two["end"]].startswith("PERMISSION IS HEREBY") and 0.9 < two["coverage"] < 1
    assert len([r for r in got if r["doc_id"] is None]) == 2 and not [r for r in got if r["doc_id"] == 3] and len(by) == len(got) == 4
    assert licenses.scan_licenses(no_docs(spark)).collect() == []


def _license_rows(texts, templates=None):
    index = licenses.Index.of(templates or licenses.TEMPLATES)
    rows = []
    for words in wd.slices(pa.array(texts, pa.string()), lower=True, breaks=wd.PUNCTUATION):
        for text, t, first, last, n, _ in licenses._matches(words, index, licenses.BAND, licenses.MIN_COVERAGE):
            rows.append((words.rows.start + text, index.names[t], first - int(words.first[text]), last - int(words.first[text]), n))
    return rows


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_edited_license_is_found(name):
    """Each word misspelt, left out or preceded by another; as many misspelt as the threshold allows; at the start of a text and after words."""
    words = "".join(c if c.isalnum() else " " for c in licenses.TEMPLATES[name]).split()
    size, rng = len(words), random.Random(8)
    most = max(e for e in range(size) if size - e >= licenses.MIN_COVERAGE * size)
    edits = [(words[:i] + ["extra"] + words[i:], size) for i in range(size)]
    if most:
        edits += [(words[:i] + other + words[i + 1 :], size - 1) for i in range(size) for other in ([], ["misspelt"])]
    if size > 60:  # a long text's words are alike: some of the edits show as much
        edits = rng.sample(edits, 30)
    for _ in range(40 if size <= 60 else 8):
        out = set(rng.sample(range(size), most))
        edits.append((["misspelt" if i in out else w for i, w in enumerate(words)], size - most))
        edits.append(([w for i, w in enumerate(words) if i not in out], size - most))
    texts = [" ".join(before + edit) for edit, _ in edits for before in ([], ["some", "other", "words"])]
    best = {}
    for text, license, _, _, n in _license_rows(texts):
        if license == name:
            best[text] = max(best.get(text, 0), n)
    assert [k for k in range(len(texts)) if best.get(k, 0) < edits[k // 2][1]] == []


def test_few_words_over_and_over_are_no_license():
    assert _license_rows(["the " * 400, "license " * 50 + "under the " * 50, "", "the license of a library, under the sun"]) == []
    twice = "Released under MIT License. Released under the MIT Licence"
    assert [r[1:] for r in _license_rows([twice])] == [("mit-notice", 0, 4, 4), ("mit-notice", 4, 8, 4)]
    assert _license_rows(["x MIT y", "mit"], {"one": "MIT"}) == [(0, "one", 1, 2, 1), (1, "one", 0, 1, 1)]


def test_license_scan_against_every_place():
    """Each text has the licenses that aligning every template at every place finds, and each match is as long as it says."""
    rng = random.Random(11)
    short = {n: t for n, t in licenses.TEMPLATES.items() if len(t) < 320}
    texts = []
    for _ in range(90):
        words = "".join(c if c.isalnum() else " " for c in rng.choice(list(short.values()))).lower().split()
        for _ in range(rng.randrange(len(words) // 3 + 2)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice(([], ["noise"], ["the"], ["license", "under"]))
        texts.append(" ".join(rng.choices(["the", "of", "license", "under", "noise", "to"], k=rng.randrange(12)) + words + rng.choices(["the", "2", "noise"], k=rng.randrange(8))))
    index = licenses.Index.of(short)
    rows = _license_rows(texts, short)
    want = set()
    for words in wd.slices(pa.array(texts), lower=True, breaks=wd.PUNCTUATION):
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            have = words.hashes[a:b].tolist()
            for t, template in enumerate(index.words):
                size = len(template)
                need = -(-size * 8 // 10)
                width = licenses.reach(size, licenses.BAND, need)
                for low in range(-size, len(have)):
                    part = [-1] * max(0, -low) + have[max(0, low) : max(0, low + size + width)]
                    if licenses.align(template.tolist(), part, width)[0] >= need:
                        want.add((words.rows.start + i, index.names[t]))
                        break
            for row, name, first, end, n in [r for r in rows if r[0] == words.rows.start + i]:
                assert _lcs(index.words[index.names.index(name)].tolist(), have[first:end]) >= n >= 0.8 * len(index.words[index.names.index(name)])
    assert {(r[0], r[1]) for r in rows} == want and len(want) > 60


def _tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [0]


def test_packing(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), with_extra(odd_docs(spark))):
        rows = packing.pack(packing.token_pieces(docs, with_ids=True)).collect()
        want = {}
        for r in docs.collect():
            ids = _tokens(r["text"])
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                raw = np.array(ids[a:b], dtype="<u4").tobytes()
                want.setdefault((r["doc_id"], k, a, b - a, zlib.crc32(raw), raw), []).append(1)
        got = {}
        for r in rows:
            got.setdefault(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) + (bytes(r["ids"]),), []).append(1)
        assert got == want
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r["length"] for r in rows) // 2048)
        assert len(bins) <= least * 1.03 + 2
    assert packing.pack(packing.token_pieces(no_docs(spark))).collect() == []


@settings(deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_two_fit(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    patterns = packing.best_two_fit(counts, 50)
    used = {}
    for bin_, times in patterns:
        assert sum(bin_) <= 50
        for s in bin_:
            used[s] = used.get(s, 0) + times
    assert used == counts


def test_two_smaller_pieces_replace_the_smallest():
    assert packing.best_two_fit({7: 1, 2: 1, 1: 2}, 10)[0][0] in ([7, 2, 1], [7, 1, 2])
    assert sorted(packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]


def test_single_words_have_the_tokenizers_ids():
    memo = packing._Memo(packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for text in ("a b", "a  b", " a", "a ", "a\n b", "it's 'd ' s", "12 3 !!", "é ²½ Ⅷ 日本\u3000x", "a\x1c b", "a\xa0 b", "x <|endoftext|> y", "\U0001f600 \U0001f600", ".\nA b"):
        assert memo.ids(text) == memo.direct(text), text


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.op5_quality_rules(spark, folder).join(labels, "doc_id").where("held_out").collect()
    bad, good = [[r["score"] for r in rows if r["quality"] == q] for q in (0, 1)]
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_rules(docs, labels), quality.fit_rules(docs, flipped)
    assert a == b and 5 < len(a.rules) < 200


def test_rules_as_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    rules = quality.propose_rules(x, y, trees=5)
    intercept, w = quality.lasso_logistic(quality.rule_matrix(x, rules), y, 0.001)
    model = quality.RuleModel(["a", "b"], rules, w.tolist(), intercept)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "_f_a double, _f_b double")
    got = [r[0] for r in df.select(model.score()).collect()]
    want = 1 / (1 + np.exp(-(intercept + quality.rule_matrix(x[:50], rules) @ w)))
    assert np.allclose(got, want) and ((want > 0.5) == (y[:50] > 0)).mean() > 0.95


def test_quality_of_odd_rows(spark):
    docs = with_extra(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 0), (20, 1), (21, 0)], "doc_id long, quality int")
    model = quality.fit_rules(docs, labels)
    out = quality.score_documents(odd_docs(spark), model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = quality.keep_good_documents(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    none = quality.fit_rules(docs, labels.where("false"))
    assert none.rules == [] and quality.score_documents(odd_docs(spark), none).first()["score"] == pytest.approx(0.5)
    assert quality.keep_good_documents(no_docs(spark), labels).collect() == []
