import hashlib
import re
from collections import Counter

from tempovar.llm import decontaminate as D

from .fixtures import ODD, documents, empty

ITEMS = [(1, "a b c d E f g h i j k l"), (2, "one"), (3, None), (None, "text under one"), (4, " .,; "), (4, "ünïcode äö"), (5, "Ünïcode ÄÖ"), (10, "tail")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    wins = [("null" if i is None else str(i), tuple(w[a:a + min(n, len(w))])) for i, t in items for w in [words(t)] if w for a in range(len(w) - min(n, len(w)) + 1)]
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(item)
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd(spark):
    docs = [(i, t) for i, t in ODD if t is None or len(t) < 10_000] + [(20, "A b c d e f g h i j k l, one text under one"), (21, "b c d e f g h i j k")]
    want = Counter(brute(docs, ITEMS))
    assert Counter(map(tuple, D.hits(documents(spark, docs), benchmark(spark)).collect())) == want
    # a benchmark beyond the bound goes block by block, with the same result
    assert Counter(map(tuple, D.hits(documents(spark, docs), benchmark(spark), max_windows=10).collect())) == want


def test_clean_keeps_columns_and_clean_documents(spark):
    docs = documents(spark)
    left = D.clean(docs, benchmark(spark))
    assert left.columns == docs.columns
    want = Counter((i, t) for (i, t), r in zip(ODD, brute(ODD, ITEMS), strict=True) if not r[-1])
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want


def test_empty(spark):
    assert D.hits(empty(spark), benchmark(spark)).collect() == []
    got = D.hits(documents(spark), benchmark(spark, [])).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
