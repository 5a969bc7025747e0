"""Each stage against a plain version over its own input."""

import numpy as np
from helpers import DOCS, no_docs, odd_docs, save, with_extra

import corpus_pipeline
from gleaner.llm import mixing, quality
from test_text import _brute

LABELS = "doc_id long, quality int, toxic int"


def _labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], LABELS)


def _plain_cut(rows, window=35):
    texts = [(r["text"] or "").encode().split() for r in rows]
    seen = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = {(i, k + d) for places in seen.values() if len(places) > 1 for i, k in places for d in range(window)}
    return [[x for k, x in enumerate(w) if (i, k) not in gone] for i, w in enumerate(texts)]


def test_stages(spark, tmp_path):
    folder = save(tmp_path, documents=odd_docs(spark), labels=_labels(spark))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        assert name == "packing" or out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{tmp_path}/stage_{name}")
        docs = spark.read.parquet(f"{tmp_path}/stage_{name}")
        after = docs.collect()
        if name == "quality":
            model = quality.fit_rules(spark.createDataFrame(before, DOCS), _labels(spark))
            scores = quality.score_documents(spark.createDataFrame(before, DOCS), model).collect()
            assert sorted(map(str, (r["doc_id"] for r in after))) == sorted(str(r["doc_id"]) for r in scores if r["score"] >= 0.3)
        elif name == "near_duplicates":
            want = {c for _, _, c in _brute([tuple(r) for r in before]) if c != "None"}
            assert {str(r["doc_id"]) for r in after if r["doc_id"] is not None} == want
        elif name == "substrings":
            kept = sorted(b" ".join(w) for w in _plain_cut(before))
            assert sorted(b" ".join((r["text"] or "").encode().split()) for r in after) == kept
        elif name == "mixing":
            decided = mixing.mix(spark.createDataFrame(before, DOCS))
            taken = sum(r["taken"] for r in decided.apply(decided.base).collect())
            assert sum(len((r["text"] or "").encode().split()) for r in after) == taken
        else:
            pieces = {}
            for r in after:
                pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sum(n for _, n in p) <= 2048 for p in pieces.values())
            assert len({(r["doc_id"], r["piece"], r["ids_crc32"]) for r in after}) <= len(after)
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    folder = save(tmp_path, documents=with_extra(odd_docs(spark)), labels=_labels(spark))
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = save(tmp_path / "none", documents=no_docs(spark), labels=_labels(spark).where("false"))
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = quality.keep_good_documents(docs, labels).select("doc_id")
    good = labels.where("quality = 1")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()
    assert np.isclose(labels.where("quality = 0").join(kept, "doc_id").count(), 0, atol=4)
