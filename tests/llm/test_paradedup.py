import random

from tempovar.llm import paradedup as P

from .fixtures import documents, empty, texts


def brute(docs, threshold, min_words, shingle=5):
    paras = []
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            w = [x.decode() for x in line.encode().lower().split()]
            if len(w) >= min_words:
                paras.append(((i is not None, i), p, len(w), frozenset(tuple(w[a:a + shingle]) for a in range(len(w) - shingle + 1))))
    root = list(range(len(paras)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for k, (_, _, _, s) in enumerate(paras):
        seen = set()
        for g in s:
            seen.update(by.get(g, ()))
            by.setdefault(g, []).append(k)
        for j in seen:
            both = len(s & paras[j][3])
            if both >= threshold * (len(s) + len(paras[j][3]) - both) - 1e-9:
                root[find(k)] = find(j)
    groups = {}
    for k, (i, p, n, _) in enumerate(paras):
        groups.setdefault(find(k), []).append((i, p, n))
    for g in groups.values():
        if len(g) > 1:
            first = min(g)
            for i, p, n in g:
                yield i[1], p, n, first[0][1], first[1], len(g), (i, p) != first[:2]


def test_whole_table(spark):
    docs = texts(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, P.clusters(df).collect())) == sorted(brute(docs, 0.8, 20))


def variants(rng, n):
    base = [f"w{i}" for i in range(60)]
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        yield i, "short\n" + " ".join(w)


def test_hot_bucket_in_chunks(spark):
    docs = list(variants(random.Random(1), 150))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs, 0.8, 20))
    for most in (4000, 30):
        assert sorted(map(tuple, P.clusters(df, most=most).collect())) == want


def test_bands():
    for t in (0.5, 0.8, 0.9):
        bands, rows = P.tune_bands(t)
        assert 1 - (1 - t ** rows) ** bands >= 0.999 and 1 - (1 - 0.05 ** rows) ** bands <= 0.002


def test_odd_and_empty(spark):
    got = {(r.doc_id, r.first_doc_id, r.removed) for r in P.clusters(documents(spark)).collect()}
    assert {(6, 6, False), (7, 6, True), (8, 6, True)} <= got
    assert (9, 9, False) in got and (9, 9, True) not in got  # equal rows are one document
    assert P.clusters(empty(spark)).collect() == []


def test_query_takes_every_line_with_a_shingle(spark, tmp_path):
    """Lines of 5 to 19 words too, alone and as a wrapped passage; the query's limit was 20 words."""
    from tempovar.llm.queries import op3_substring_dedup
    wrapped = "\n".join(" ".join(f"w{k}x{i}" for i in range(9)) for k in range(7))
    near = [f"n{i}" for i in range(18)]
    docs = [(1, "one two three four five\n" + wrapped), (2, "ONE two three four five\nfour words are none"), (3, wrapped + "\nfour words are none"),
            (4, " ".join(near)), (5, " ".join([*near, "more"]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op3_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted(brute(docs, 0.8, 5)) and len(got) == 2 + 14 + 2


def test_whole_table_of_short_lines(spark):
    docs = texts(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, P.clusters(df, min_words=5).collect())) == sorted(brute(docs, 0.8, 5))


def shared(docs, found):
    """Of each document, the words that lie in ``found`` words in a row which another document has too."""
    words = {i: (t or "").lower().split() for i, t in docs}
    at = {}
    for i, w in words.items():
        for a in range(len(w) - found + 1):
            at.setdefault(tuple(w[a:a + found]), set()).add(i)
    return {i: {k for a in range(len(w) - found + 1) if len(at[tuple(w[a:a + found])]) > 1 for k in range(a, a + found)} for i, w in words.items()}


def test_passages_inside_lines_and_across_them(spark):
    """Every document that shares 50 words in a row has a passage, and each passage stands in its first document too."""
    docs = texts(spark, "/root/testdata/sf0.01")
    words = {i: (t or "").lower().split() for i, t in docs}
    got = P.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        a, b = -1 - r.paragraph, -1 - r.first_paragraph
        assert r.n_words >= 25 and words[r.doc_id][a:a + r.n_words] == words[r.first_doc_id][b:b + r.n_words]
        assert r.removed == (r.doc_id != r.first_doc_id) and r.cluster_size > 1
    assert {i for i, w in shared(docs, 50).items() if w} <= {r.doc_id for r in got} <= {i for i, w in shared(docs, 25).items() if w}


def test_query_finds_a_passage_inside_longer_lines(spark, tmp_path):
    """60 words between others of the same line, and wrapped otherwise, were in no paragraph that had a copy."""
    from tempovar.llm.queries import op3_substring_dedup
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]

    def around(n):
        return [f"o{rng.randrange(10 ** 9)}" for _ in range(n)]

    alone = " ".join(around(200))
    docs = [(1, " ".join([*around(90), *passage, *around(80)])), (2, " ".join(around(100) + passage[:31]) + "\n\n" + " ".join(passage[31:] + around(70))), (3, alone), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_substring_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.first_doc_id, r.removed, r.cluster_size) for r in got} == {(1, 1, False, 2), (2, 1, True, 2)}
    for r in got:
        a = -1 - r.paragraph - {1: 90, 2: 100}[r.doc_id]
        assert 0 <= a and a + r.n_words <= 60 and r.n_words >= 25 and -1 - r.first_paragraph == a + 90


def test_passages_of_odd_and_empty_tables(spark):
    assert P.passages(empty(spark)).collect() == [] and P.repeats(empty(spark)).collect() == []
    said = " ".join(f"w{i}" for i in range(55))
    again = "x\n" + "El " * 300
    df = spark.createDataFrame([(5, said), (5, said), (None, "and " + said), (7, again), (7, again)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.paragraph, r.first_doc_id, r.removed) for r in P.passages(df).collect()) == sorted(
        (r.doc_id or 0, r.paragraph, None, r.doc_id == 5) for r in P.passages(df).collect())
    assert {r.doc_id for r in P.passages(df).collect()} == {5, None}
