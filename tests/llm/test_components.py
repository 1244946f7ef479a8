import random

from tempovar.llm import components as C
from tempovar.llm import paradedup as P

from .test_paradedup import brute, variants


def roots(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in list(root) if find(i) != i}


def test_random_links_and_chains(spark):
    rng = random.Random(5)
    for links in ([(rng.randrange(99), rng.randrange(99)) for _ in range(60)] + [(i, i + 1) for i in range(100, 106)], [(9, 9), (4, -7), (-7, 4)], []):
        got = C.components(spark.createDataFrame(links, "a long, b long"), "test").collect()
        assert {r.node: r.root for r in got} == roots(links) and len(got) == len(roots(links))


def test_stages_are_written_where_they_are_needed(spark, monkeypatch):
    """Stars were confirmed by a round that wrote them again; shingle sets were written to be read once."""
    written = []

    def stored(df, name, real=C.stored):
        written.append(name)
        return real(df, name)

    monkeypatch.setattr(C, "stored", stored)
    monkeypatch.setattr(P, "stored", stored)
    assert C.components(spark.createDataFrame([(1, 2), (1, 3), (7, 5)], "a long, b long"), "stars").count() == 3
    assert written == ["stars-links"]
    written.clear()
    docs = list(variants(random.Random(1), 30))
    got = P.repeats(spark.createDataFrame(docs, "doc_id long, text string")).where("paragraph >= 0").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, 0.8, 5))
    assert sorted(set(written) - {"paragraphs-stars"}) == ["buckets", "line-clusters", "paragraphs", "paragraphs-links", "passages", "runs"]
