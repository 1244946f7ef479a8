import math
import zlib
from collections import Counter

import numpy as np

from tempovar.llm import lm

from .fixtures import ODD, documents, empty, texts


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def base(docs):
    c = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    for i, text in docs:
        tok = tokens(text)
        yield i, held(i), len(tok), sum(c[t] > 0 for t in tok), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tok)


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def rounded(rows):
    return Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in rows)


def test_base_and_model(spark):
    docs = texts(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for t in (lm.Thresholds(), lm.Thresholds(p_word=1e-4)):  # with many rare words too
        got = lm.score(df, t).collect()
        assert rounded(got) == rounded(base(docs))
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_scores_do_not_depend_on_the_head(spark):
    """Words below the head are joined instead of looked up: same probabilities."""
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keep = dict(p_next=1e-3, p_state=1e-3, p_pair=1e-3)
    a, b = ({r.doc_id: r.score for r in lm.score(df, lm.Thresholds(p_word=p, **keep)).collect()} for p in (1e-9, 1e-3))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * max(1, abs(a[k])) for k in a)


def test_states_sum_to_one(spark):
    rows = spark.createDataFrame([("the cat sat on the mat and the dog sat on the log",)] * 30 + [("a cat and a dog",)] * 20, "text string")
    model, counts = lm.train(rows, lm.Thresholds())
    assert len(model.levels) == 2 and len(model.levels[0].states.keys) > 3 and len(model.levels[1].states.keys) > 0
    n = len(model.log_root)
    assert abs((10 ** model.log_root).sum() + 10 ** model.unknown() - 1) < 1e-9
    for a in range(n):
        for b in range(n):
            ids = np.array([x for w in range(n) for x in (a, b, w)])
            p = 10 ** lm.walk(model, ids, np.arange(n).repeat(3))[2::3]
            back = 10 ** lm.walk(model, np.array([a, b, -1]), np.zeros(3, int))[2] * 10 ** model.unknown()
            assert abs(p.sum() + back - 1) < 1e-6


def test_odd_and_empty(spark):
    assert rounded(lm.score(documents(spark)).collect()) == rounded(base(ODD))
    assert lm.score(empty(spark)).collect() == []
    only_held = [(i, "some words") for i in range(100) if held(i)]
    got = lm.score(documents(spark, only_held)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in got) and len(got) == len(only_held)


def tree(docs, t):
    """log10 probability of each text by a plain suffix tree of runs counted in full."""
    train = [tokens(x) for i, x in docs if not held(i)]
    count = [Counter(tuple(x[a:a + k]) for x in train for a in range(len(x) - k + 1)) for k in range(t.depth + 2)]
    n, c = sum(count[1].values()), Counter(count[1].values())
    d = min(0.9, max(0.1, c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5))
    kept, states = {}, {}
    for k in range(1, t.depth + 1):
        for g, m in count[k + 1].items():
            if m >= t.least_pair and count[k][g[:-1]] >= t.least_state:
                kept.setdefault(g[:-1], {})[g[-1]] = m

    def p(ctx, w):
        if not ctx:
            return (count[1][w,] - d) / n if (w,) in count[1] else d * len(count[1]) / n
        if ctx not in states:
            return p(ctx[1:], w)
        own, rest = states[ctx]
        return own[w] if w in own else rest * p(ctx[1:], w)

    for ctx in sorted(kept, key=len):
        own = {w: (m - lm.DISCOUNT) / count[len(ctx)][ctx] for w, m in kept[ctx].items()}
        below = {w: p(ctx[1:], w) for w in own}
        left, other = 1 - sum(own.values()), max(1 - sum(below.values()), 1e-12)
        if sum(x * math.log(x / below[w]) for w, x in own.items()) + left * math.log(left / other) >= t.divergence:
            states[ctx] = own, left / other
    for i, x in docs:
        tok = tokens(x)
        yield i, sum(math.log10(p(tuple(tok[max(0, a - t.depth):a]), w)) for a, w in enumerate(tok)), states


def test_every_context_with_evidence_counts(spark):
    """A corpus beyond 200,000 tokens: relative limits left out contexts of 20 occurrences and successors of few."""
    docs = texts(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = list(tree(docs, lm.Thresholds()))
    assert len([s for s in want[0][2] if len(s) == 1]) > 1000
    for p_word in (2.5e-7, 1e-4):  # all broadcast; most of the states and successors joined
        got = sorted((r.doc_id, r.score) for r in lm.score(df, lm.Thresholds(p_word=p_word)).collect())
        assert len(got) == len(want)
        assert all(a == b and abs(x - y) < 1e-6 * max(1, abs(y)) for (a, x), (b, y, _) in zip(got, sorted(want, key=lambda r: r[:2]), strict=True))


def test_the_head_is_bounded_by_its_rows(spark):
    """What is broadcast was cut by probability: of many tables far less than fits, and the rest went through joins that grew with the square of the input."""
    docs = texts(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.where(~lm.held_out(df.doc_id)).select("text")
    whole, _ = lm.train(rows, lm.Thresholds())
    assert len(whole.words.keys) == whole.v and whole.others is None
    want = sorted((i, p) for i, p, _ in tree(docs, lm.Thresholds()))
    for head in (2000, 0):
        t = lm.Thresholds(head=head)
        model, _ = lm.train(rows, t)
        sizes = [len(model.words.keys), *[len(x.keys) for level in model.levels for x in (level.states, level.pairs)]]
        assert max(sizes) <= head and model.others.count() > 0 and (not head or min(sizes) > 100)
        got = sorted((r.doc_id, r.score) for r in lm.score(df, t).collect())
        assert all(a == b and abs(x - y) < 1e-6 * max(1, abs(y)) for (a, x), (b, y) in zip(got, want, strict=True))
