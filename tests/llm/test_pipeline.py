"""The pipeline against the brute-force versions of its stages, each over what the stage before kept."""

import hashlib
from collections import Counter

import corpus_pipeline
from tempovar.llm import langid

from . import test_decontaminate, test_linededup, test_packing, test_simhash
from .fixtures import SF, documents, empty


def without_repeats(docs):
    """Texts after line dedup, by the brute force's own line choice."""
    out = []
    for (doc_id, text), (_, n, gone, digest) in zip(docs, test_linededup.brute(docs, 50), strict=True):
        if gone == n:
            continue
        if not gone:
            out.append((doc_id, text))
            continue
        left = next(t for t in [test_linededup.LEFT[doc_id]] if hashlib.sha256(t.encode()).hexdigest() == digest)
        out.append((doc_id, left))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]

    kept = by["language_id"](spark, docs, SF)
    filters = langid.train(docs)
    want = []
    for r in docs.collect():
        lang, score = filters.predict([r.text or ""])[0]
        if lang != "und" and score >= 0.5:
            want.append((r.doc_id, r.text))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(rows) == Counter(want) and kept.columns == docs.columns

    lines = by["line_dedup"](spark, kept, SF)
    got = [(r.doc_id, r.text) for r in lines.collect()]
    expected = without_repeats(rows)
    assert Counter(got) == Counter(expected) and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = by["simhash_near_dedup"](spark, lines, SF)
    left = [(r.doc_id, r.text) for r in near.collect()]
    assert {i for i, _ in left} == {c for _, _, c in test_simhash.brute(got)} and near.columns == docs.columns

    clean = by["benchmark_decontamination"](spark, near, SF)
    final = [(r.doc_id, r.text) for r in clean.collect()]
    assert Counter(final) == Counter(d for d, r in zip(left, test_decontaminate.brute(left, bench), strict=True) if not r[-1])

    test_packing.check(by["packing"](spark, clean, SF).collect(), final, 1024)
    test_packing.check(corpus_pipeline.run(spark, SF).collect(), final, 1024)


def test_odd_and_empty(spark, tmp_path):
    for i, docs in enumerate((documents(spark), empty(spark))):
        folder = str(tmp_path / str(i))
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (i == 0)
