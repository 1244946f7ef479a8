import math
import random
import re
from collections import Counter

import numpy as np

from tempovar.llm import queries, search as S

from .fixtures import LONG, ODD, SF, documents, empty, texts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return [w.translate(LOW) for w in TERM.findall(text or "")]


def brute(docs, items, top=20):
    bags = [(i, plain(t)) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    total, length = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in set(items):
        words, found = plain(text), []
        for i, n, c in bags:
            m = 100 - 25 + (25 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_whole_table(spark):
    docs = texts(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter(map(tuple, queries.op11_lexical_search(spark, SF).collect()))
    assert got == brute(docs, items)


def test_odd_rows_and_items_in_blocks(spark):
    items = [(1, "one Two line of it"), (1, "one Two line of it"), (2, None), (3, ""), (4, "... ,,"), (5, "the the the text line LINE x y"), (6, "w1x1 w2x2 w2x2 text"),
             (7, "straße 日本語"), (8, "nothing zzz of that"), (None, "a text without")]
    got = S.rank(documents(spark), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(ODD, [x for x in items if x[1]])
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, S.rank(documents(spark), items_of(spark, items), block=20).collect())) == want


def test_ties_and_copies(spark):
    docs = [(i, "same words in all of them") for i in range(60, 0, -1)] + [(None, "same words in all of them")] * 3 + [(7, "another"), (None, LONG)]
    items = [(1, "same words"), (2, "same same words another")]
    assert Counter(map(tuple, S.rank(documents(spark, docs), items_of(spark, items)).collect())) == brute(docs, items)


def test_empty(spark):
    assert S.rank(empty(spark), items_of(spark, [(1, "a b")])).collect() == []
    assert S.rank(documents(spark), items_of(spark, [])).collect() == []


def test_graph_adds_up_and_shares():
    rng = random.Random(3)
    queries_ = [[min(int(rng.expovariate(0.15)), 39) for _ in range(rng.randint(1, 30))] for _ in range(50)]
    graph = S.mine(queries_)
    base = np.array([[rng.randrange(1000) for _ in range(5)] for _ in range(40)], dtype=np.int64)
    want = np.array([base[q].sum(axis=0) for q in queries_])
    assert (graph.scores(base) == want).all()
    assert graph.levels and sum(len(left) for _, left, _ in graph.levels) + len(graph.items[0]) < sum(map(len, queries_))
    twice = S.mine([[0, 1, 2, 5], [0, 1, 2, 6], [0, 1, 2, 7]])
    assert (len(twice.items[0]), twice.n_nodes) == (6, 4)  # one shared atom, three private ones
