import math
import zlib
from collections import Counter, defaultdict

import xxhash

from tempovar.llm import sharding as H

from .fixtures import ODD, documents, empty, texts


def descend(key, node):
    while node.children:
        draws = []
        for c in node.children:
            bits = xxhash.xxh64_intdigest(f"{c.path}|{key}".encode(), 42) >> 11
            draws.append((-math.log((bits + 0.5) / 2 ** 53) / c.weight, c.path, c))
        node = min(draws, key=lambda d: d[:2])[2]
    return node.shard


def check(rows, docs, shards=24):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key",
                    descend("null" if i is None else i, H.tree(shards)), descend("null" if i is None else i, H.tree(shards + 1))) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, shards) for r in rows)


def test_whole_table(spark):
    docs = texts(spark, "/root/testdata/sf0.01")
    rows = H.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs)
    assert len({r.shard for r in rows}) == 24 and any(r.grown_shard == 24 for r in rows)


def test_odd_and_empty(spark):
    check(H.shard(documents(spark)).collect(), ODD)
    assert H.shard(empty(spark)).collect() == []


def test_growth_moves_rows_only_into_the_grown_subtree():
    leaf = lambda p, s, w=1.0: H.Node(p, shard=s, own=w)
    before = H.Node("", (H.Node("a", (H.Node("a/x", (leaf("a/x/0", 0), leaf("a/x/1", 1))),)), H.Node("b", (H.Node("b/x", (leaf("b/x/2", 2),)),))))
    after = H.Node("", (before.children[0], H.Node("b", (H.Node("b/x", (leaf("b/x/2", 2, 3.0),)),))))
    moved = [(descend(k, before), descend(k, after)) for k in range(2000)]
    assert all(a == b or b == 2 for a, b in moved) and any(a != b for a, b in moved)
    share = sum(b == 2 for _, b in moved) / len(moved)
    assert 0.55 < share < 0.65  # weight 3 of 5
