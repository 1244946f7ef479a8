import hashlib
import random
from collections import Counter

from tempovar.llm import linededup as L

from .fixtures import ODD, documents, empty, texts


LEFT = {}  # the texts that stayed, by doc_id


def brute(docs, min_words):
    """A line goes if it is in a run of worded lines of min_words words whose same run starts earlier."""
    docs = [(i, t, [(p, x, len(x.encode().split())) for p, x in enumerate(t.split("\n")) if x.encode().split()]) for i, t in docs]
    runs = {}
    for i, _, lines in docs:
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= min_words:
                    at = runs.setdefault(tuple(x for _, x, _ in lines[a:b + 1]), (i, lines[a][0]))
                    runs[tuple(x for _, x, _ in lines[a:b + 1])] = min(at, (i, lines[a][0]))
    for i, t, lines in docs:
        gone = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= min_words:
                    if runs[tuple(x for _, x, _ in lines[a:b + 1])] < (i, lines[a][0]):
                        gone.update(range(lines[a][0], lines[b][0] + 1))
        every = t.split("\n")
        left = "\n".join(x for p, x in enumerate(every) if p not in gone)
        LEFT[i] = left
        yield i, len(every), len(gone), hashlib.sha256(left.encode()).hexdigest()


def test_random_lines(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))) for _ in range(14)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, L.report(df, min_words=6).collect())) == Counter(brute(docs, 6))


def test_whole_table(spark):
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, L.report(df).collect())) == Counter(brute(docs, 50))


def test_odd(spark):
    docs = documents(spark)
    got = L.clean(docs, min_words=6)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    # the later copy of the long line goes with its document; equal rows are one document; a null id comes first
    assert kept == Counter((i, "line one of it\nline two of it" if i == 12 else t) for i, t in ODD if i != 7)
    assert L.clean(empty(spark)).collect() == []


def test_same_text_under_a_later_id_goes(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, text), (1, text), (None, "short"), (3, "own\n" + text)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in L.clean(df).collect()} == {(1, text), (None, "short"), (3, "own")}
