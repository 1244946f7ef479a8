import random
from collections import Counter

from pyspark.sql import functions as F

from tempovar.llm import rules as R

from .fixtures import ODD, documents, empty, texts


def base(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
            len(w) < 50 or 100 * len(again) > 50 * len(w))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_columns(spark):
    docs = texts(spark) + [(1000, "a b c a b c d"), (1001, "x x x x x"), (1002, "a\n a\na\n\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, R.statistics(df).select(*COLUMNS).collect())) == Counter((i, *base(t)) for i, t in docs)
    assert Counter(map(tuple, R.statistics(documents(spark)).select(*COLUMNS).collect())) == Counter((i, *base(t)) for i, t in ODD)


def test_list_separates_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = R.quality(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False], n


def test_learned_rules_cover_by_threshold(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 100), rng.randint(0, 100)) for _ in range(600)]
    data = [(a, b, int(a > 50 and b <= 30), i % 3 == 0) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "f_a long, f_b long, bad int, prune boolean")
    rules = R.learn(df, ["f_a", "f_b"])
    assert rules
    wrong = df.withColumn("kept", R.decision_list(rules)).where((F.col("bad") == 1) == F.col("kept")).count()
    assert wrong == 0


def test_without_labels_only_the_base_rule(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = R.quality(documents(spark), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got) and len(got) == len(ODD)
    odd = spark.createDataFrame([(None, 0), (6, None), (99, 1)], "doc_id long, quality int")
    assert len(R.quality(documents(spark), odd).collect()) == len(ODD)
    assert R.quality(empty(spark), none).collect() == []


def test_thresholds_follow_the_rows(spark):
    """A cut at 41,000, far above any fixed grid."""
    rng = random.Random(5)
    rows = [rng.randint(30_000, 50_000) for _ in range(900)]
    df = spark.createDataFrame([(a, int(a > 41_000), i % 3 == 0) for i, a in enumerate(rows)], "f_a long, bad int, prune boolean")
    rules = R.learn(df, ["f_a"])
    assert rules and df.withColumn("kept", R.decision_list(rules)).where((F.col("bad") == 1) == F.col("kept")).count() <= 9


def test_a_rejected_rule_does_not_end_the_list(spark):
    """f_a is a better start on the growing rows but fails on the pruning rows; f_b holds on both."""
    data = []
    for i in range(600):
        prune, bad = i % 3 == 0, i % 4 == 0
        data.append((100 if bad and not prune or not bad and prune else 0, 100 if bad and i % 20 else 0, int(bad), prune))
    df = spark.createDataFrame(data, "f_a long, f_b long, bad int, prune boolean")
    rules = R.learn(df, ["f_a", "f_b"])
    assert [[c[:2] for c in r] for r in rules][:1] == [[("f_b", True)]]
