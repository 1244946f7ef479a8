from pyspark.sql import functions as F

from tempovar.llm import langid as G

from .fixtures import ODD, documents, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = G.predictions(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred)) as right").first()
    assert got.right >= 0.95, got


def test_bounded_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = G.train(docs, max_train=200)
    got = G.identify(docs, few).join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred)) as right").first()
    assert got.right >= 0.85, got


def test_a_rare_language_keeps_all_its_rows(spark):
    rows = [(i, f"the cat number {i % 50} sat on the mat and looked at house {i % 7}") for i in range(3000)]
    rare = [(10_000 + i, "zdrqvo wrpqa xyzzu qwvvk jjxqo zdrqvi") for i in range(12)]
    df = documents(spark, rows).withColumn("lang", F.lit("en")).unionByName(documents(spark, rare).withColumn("lang", F.lit("xx")))
    few = G.train(df, max_train=60)  # a uniform sample of 60 rows would have none or one of them
    assert few.languages == ["en", "xx"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(df, few).where("doc_id >= 10000 or doc_id < 5").collect()}
    assert all(got[10_000 + i][0] == "xx" and got[10_000 + i][1] > 0.9 for i in range(12)) and got[0][0] == "en"


def test_rows_without_an_id_are_thinned_one_by_one(spark, monkeypatch):
    same = documents(spark, [(None, f"text without an id {i} {i * 7919 % 1000}") for i in range(2000)]).withColumn("lang", F.lit("en"))
    rows = []
    real = G.gram_counts
    monkeypatch.setattr(G, "gram_counts", lambda docs: (rows.append(docs.count()), real(docs))[1])
    G.train(same, max_train=200)
    assert 120 < rows[0] < 300  # not all or none


def plain_filters(docs, min_count=2, min_share=0.1):
    """Trigram sets per language, without bits: what the filters stand for."""
    import zlib
    from collections import Counter
    counts = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(G.grams([text])[0].tolist())
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    most = {}
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(most.get(g, 0), x)
    return {lang: {g for g, n in c.items() if n >= min_count and rate[lang][g] >= min_share * most[g]} for lang, c in counts.items()}


def test_predictions_are_those_of_plain_sets(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    sets = plain_filters(docs)
    got = {r.doc_id: r for r in G.predictions(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    apart = 0
    for i, text, _ in docs:
        grams = G.grams([text or ""])[0].tolist()
        hits = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        best = max(hits.values())
        assert abs(got[i].score - best / len(grams)) < 0.02
        apart += hits.get(got[i].lang_pred, 0) < best
    assert apart <= len(docs) // 100  # a filter of bits lets a little through


def test_filters_have_no_false_negatives_and_correct_for_false_positives():
    import numpy as np
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 62, 3000).astype(np.uint64) for _ in range(2)]
    table = np.zeros((1, 1 << 14), dtype=np.uint64)
    for bit, s in enumerate(sets):
        for p in G.Filters.positions(s, 1 << 14):
            table[0][p] |= np.uint64(1 << bit)
    f = G.Filters(["x", "y"], table)
    other = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    at = G.Filters.positions(other, 1 << 14)
    hit = np.ones(len(other), dtype=bool)
    for p in at:
        hit &= (table[0][p] & np.uint64(1)) > 0
    assert abs(hit.mean() - f.false[0]) < 0.02
    inside = np.ones(3000, dtype=bool)
    for p in G.Filters.positions(sets[0], 1 << 14):
        inside &= (table[0][p] & np.uint64(1)) > 0
    assert inside.all()


def test_odd_and_empty(spark):
    rows = ODD + [(20, "12 34 !!"), (21, "12 \x00 34")]
    got = G.predictions(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 10, 20, 21):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[4].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert G.predictions(empty(spark)).collect() == []
    kept = G.accepted(documents(spark, rows))
    assert kept.columns == documents(spark).columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 10, 20, 21})
    unlabelled = documents(spark, rows).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r.lang_pred for r in G.predictions(unlabelled).collect()} == {"und"}


def test_texts_are_taken_apart_a_few_at_a_time():
    import tracemalloc

    import numpy as np
    filters = G.Filters(["en"], np.ones((1, 1 << 10), dtype=np.uint64))
    texts = [f"the cat number {i} sat on the mat " * 3000 for i in range(60)] + [None]  # 6 million characters
    G.letters()
    tracemalloc.start()
    got = filters.predict(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got == [g for t in texts for g in filters.predict([t])] and got[-1] == ("und", 0.0)
    assert peak < 100, peak
