import random
import re
from collections import Counter

import numpy as np
import pytest

from tempovar.llm import queries, setjoin as S
from tempovar.llm.common import sifted

from .fixtures import LONG, ODD, SF, documents, empty, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent=90):
    bags = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(bags):
        for j in range(i):
            both = len(x & bags[j])
            if both and 100 * both >= percent * (len(x) + len(bags[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None and bags[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(bags[i]), least.get(find(i)) if bags[i] else d) for i, (d, _) in enumerate(docs))


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(map(tuple, df.collect()))


def test_whole_table(spark):
    assert found(queries.op13_jaccard_join(spark, SF)) == brute(texts(spark))


def test_odd_and_empty(spark):
    assert found(S.classes(documents(spark))) == brute(ODD)
    assert found(S.classes(empty(spark))) == Counter()


def variants_of(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], [f"n{rng.randrange(10_000)}"], [w[i], f"n{rng.randrange(10_000)}"]])
        out.append(" ".join(w))
    return out


def planted():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for k in range(12):  # classes at the edge of the threshold, most of them with a passage in common
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 9, 10, 11, 30, 120, 300]))] + (passage if k % 3 else [])
        out += variants_of(rng, words, 14, max(1, len(words) // 25))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)] + [(5, out[3]), (None, out[4]), (None, "alone without an id"), (900, LONG), (901, LONG + " more")]


@pytest.mark.parametrize(("stars", "most", "small"), [(True, 20_000, 64), (False, 6, 2)])
def test_classes_at_the_edge(spark, monkeypatch, stars, most, small):
    """With the defaults; and without stars, groups dealt into chunks, forests of groups however small."""
    monkeypatch.setattr(S, "SMALL", small)
    if not stars:
        monkeypatch.setattr(S, "stars", lambda known: known.select(known.id.alias("x"), known.id.alias("y")).where("x <> y"))
    docs = planted()
    want = brute(docs)
    assert len({r[2] for r in want}) > 20
    assert found(S.classes(documents(spark, docs), most=most)) == want


def test_a_class_just_below_the_threshold_gives_no_pairs(spark, monkeypatch):
    """Copies that differ from each other by more than the threshold allows meet in every group; few of them are let out."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(words)
        for at in rng.sample(range(120), 4):
            w[at] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, t) for i, t in enumerate(variants_of(rng, [f"v{i}" for i in range(100)], 60, 3))]
    seen = []
    real = S.candidates

    def watched(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(S, "candidates", watched)
    assert found(S.classes(documents(spark, docs))) == brute(docs)
    assert sum(seen) < 2000  # of 11,175 pairs of the first class


def test_prefixes_of_every_order_meet():
    rng = np.random.default_rng(1)
    for n in (1, 9, 10, 11, 57, 300):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        d = int(S.most_apart(2 * n, 90)) // 2
        y = np.concatenate([x[d:], rng.integers(0, 1 << 63, d, dtype=np.uint64)])
        p = int(S.prefix_sizes(np.array([n]), 90)[0])
        for k in range(S.ORDERS):
            a, b = (v[np.argsort(S.mix(v ^ S.SALT[k + 2]))][:p] for v in (x, y))
            assert len(np.intersect1d(a, b))
        for a, b in zip(S._sketch(x), S._sketch(y), strict=True):
            assert S.near_sketches(a, b, 2 * d)


def test_sifted_drops_nothing_that_is_wanted(spark):
    df = spark.range(0, 50_000).selectExpr("id * 7 - 1000 as k", "id")
    wanted = spark.range(0, 300).selectExpr("id * 700 - 1000 as k")
    got = {r.k for r in sifted(df, "k", wanted).collect()}
    assert {r.k for r in wanted.collect()} & {r.k for r in df.collect()} <= got
    assert len(got) < 10_000
    assert sifted(df, "k", wanted.where("false")).count() == 0
