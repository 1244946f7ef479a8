import random
from collections import Counter

import numpy as np
import xxhash

from tempovar.llm import simhash as S

from .fixtures import ODD, documents, empty, texts


def plain(text, k=4):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, k=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute(docs):
    fps = [plain(t) for _, t in docs]
    of, least = classes(fps), {}
    for (i, _), c in zip(docs, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(docs, fps, of, strict=True))


def test_whole_table(spark):
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, S.near_duplicates(df).collect())) == brute(docs)


def test_odd_and_empty(spark):
    assert Counter(map(tuple, S.near_duplicates(documents(spark)).collect())) == brute(ODD)
    assert S.near_duplicates(empty(spark)).collect() == []
    assert S.keep_first(empty(spark)).collect() == []


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len({c for c in (classes([plain(t) for _, t in ODD]))})
    assert set(got) >= {1, 4, 5, 6, 11}


def near(rng, n, spread):
    base = [rng.getrandbits(64) for _ in range(max(1, n // spread))]
    out = set()
    while len(out) < n:
        f = rng.choice(base)
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return np.array(sorted(out), dtype=np.uint64)


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_index_of_one_node():
    rng = random.Random(2)
    for n, spread in ((1, 1), (40, 40), (700, 20), (1500, 1500)):
        fps = near(rng, n, spread)
        assert same_classes(S.index_links(fps, 4).tolist(), classes([int(f) for f in fps]))


def test_large_nodes_are_dealt_into_chunks(spark):
    rng = random.Random(4)
    fps = near(rng, 600, 200)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = classes([int(f) for f in fps])
    for most in (20_000, 40):
        found = S.components(S.links(df, 4, most), "test").collect()
        root = {r.node: r.root for r in found}
        assert same_classes([root.get(int(f), int(f)) for f in fps.view(np.int64)], want)
