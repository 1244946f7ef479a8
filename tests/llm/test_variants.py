import random
import re
import zlib
from collections import Counter, defaultdict

from tempovar.llm import queries, variants as V

from .fixtures import ODD, SF, documents, empty, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, letters=5, times=3, mutate=97):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % mutate == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= times}
    near = defaultdict(set)
    holes = defaultdict(set)  # a word with one place open, and a word without one letter
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if (short := w[:i] + w[i + 1:]) in n:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in ((w, x) for w, x in near.items() if x):
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        last = w
        while last in form:
            last = form[last]
        out.append((w, form.get(w), last, n[w], len(near.get(w, ())), n[form[w]] if w in form else None))
    return Counter(out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return Counter(map(tuple, df.collect()))


def test_whole_table(spark):
    got = found(queries.op12_spelling_variants(spark, SF))
    assert got == brute(texts(spark))
    assert sum(1 for r in got if r[1]) > 50


def test_odd_and_empty(spark):
    assert found(V.variants(documents(spark))) == brute(ODD)
    assert found(V.variants(empty(spark))) == Counter()


def planted():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["x" * 3000, "aaaaa", "aaaaaa", "ÀÉÿøñ"]
    words = set(base)
    for w in base * 8:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1:], w[i:] + w[:i]]))
    lines = [(w + " ") * (3 * 2 ** rng.randrange(8) + rng.randrange(3)) for w in sorted(words)]
    return [(k, line) for k, line in enumerate(lines)] + [(None, lines[0].upper()), (3, None)]


def test_planted_chains_ties_and_long_words(spark):
    docs = planted()
    want = brute(docs, mutate=7)
    assert any(r[1] != r[2] for r in want if r[1])  # a path of two steps
    assert found(V.variants(documents(spark, docs), mutate=7)) == want


def test_large_groups_are_dealt_into_chunks(spark):
    words = spark.createDataFrame([(w.lower().encode("latin-1"), 3) for w in sorted({w for _, t in planted() for w in (t or "").split()})], "w binary, n long")
    whole = Counter(map(tuple, V.near_pairs(words, 5).collect()))
    assert max(whole.values()) == 1
    for n_parts, most in ((5, 4), (6, 50_000), (8, 3)):
        assert Counter(map(tuple, V.near_pairs(words, n_parts, most).collect())) == whole


def test_near():
    assert V.near(b"abcde", b"abxde") and V.near(b"abcde", b"abccde") and V.near(b"abcde", b"abcdef") and V.near(b"abcde", b"xabcde")
    assert not V.near(b"abcde", b"abcde") and not V.near(b"abcde", b"abdce") and not V.near(b"abcde", b"abcdefg")
