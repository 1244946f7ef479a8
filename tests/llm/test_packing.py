import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tempovar.llm import packing, tokens
from tempovar.llm.tokens import Encoder, batches

from .fixtures import ODD, documents, empty, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, window):
    library, pieces = Tokenizer.from_file(PATH), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    got, want = Counter(), Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        body = np.array(ids, dtype="<u4").tobytes()
        want.update((doc_id, a, min(window, len(ids) - a), zlib.crc32(body[4 * a:4 * (a + window)]), len(ids)) for a in range(0, len(ids), window))
    got.update((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= window
    return sum(r.length for r in rows) / (window * max(1, len(sequences)))


def test_odd_and_empty(spark):
    check(packing.pack(documents(spark), PATH, window=64).collect(), ODD, 64)
    assert packing.pack(empty(spark), PATH).collect() == []


def test_whole_table(spark):
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert check(packing.pack(df, PATH).collect(), docs, 1024) > 0.97


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(3)
    for counts in (np.zeros(65, int), rng.integers(0, 50, 65), np.bincount(np.full(1000, 40), minlength=65)):
        used = np.zeros(65, int)
        for shape, n in packing.plan(counts, 64):
            assert sum(shape) <= 64 and n > 0
            for length in shape:
                used[length] += n
        assert (used[1:] == counts[1:]).all()


def test_fit_beats_no_fit():
    counts = np.zeros(65, int)
    counts[[20, 24, 40, 44]] = 100, 300, 300, 100
    shapes = packing.patterns(64, np.flatnonzero(counts))
    x = packing.nnls(shapes, counts)
    fitted = np.zeros(65)
    for k, shape in zip(x, shapes, strict=True):
        for v in shape:
            fitted[v] += k if v else 0
    assert (x >= 0).all() and np.abs(fitted - counts)[1:].sum() < 0.1 * counts.sum()


def test_ids_equal_the_library():
    code, rng = Encoder(PATH), np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "1", "é", "!", "<|endoftext|>", " ", "\x1c", "it's", "　", ".", ",", "ab.", " ab,", "x" * 70]
    for _ in range(300):
        some = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(8)]
        for text, ids in zip(some, code.ids(some), strict=True):
            assert ids == code.whole(text), text


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    code = Encoder(path)
    assert not code.by_word
    assert code.ids(["Some  Text here"])[0] == code.whole("Some  Text here")


def test_ids_of_whole_documents_equal_the_library(spark):
    code = Encoder(PATH)
    some = [t or "" for _, t in texts(spark)]
    for run in batches(some, 1 << 20):
        for text, ids in zip(run, code.ids(run), strict=True):
            assert ids == code.whole(text), text[:200]


def test_ids_around_line_feeds_and_white_space():
    code, rng = Encoder(PATH), np.random.default_rng(2)
    parts = [" ", "  ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", "\r\n", "ab", "Ab.", "x\ny", "12", "'ll", " ", "--", "é", "z)"]
    for _ in range(400):
        some = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(8)]
        for text, ids in zip(some, code.ids(some), strict=True):
            assert ids == code.whole(text), repr(text)


def test_texts_are_tokenized_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tempovar.llm import packing as P
    sizes = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, cut, _):
            return cut

    class Code:
        def ids(self, run):
            sizes.append(sum(map(len, run)))
            return [b"\1\0\0\0" * (len(t) // 100) for t in run]

    monkeypatch.setattr(P, "encoder", lambda path: Code())
    frame = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["x" * 100_000] * 39 + [None])], names=["doc_id", "text"])
    got = [r for b in P.pieces(Docs(), "")(iter([frame])) for r in b.to_pylist()]
    assert sum(sizes) == 3_900_000 and max(sizes) < P.CHARS + 100_000
    assert [(r["doc_id"], r["length"]) for r in got] == [(i, 1001) for i in range(39)] + [(39, 1)]


def test_every_white_space_around_spaces_and_line_feeds():
    """Texts that must not be cut are told apart in Arrow as ``re`` would tell them."""
    code = Encoder(PATH)
    white = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.match(r"\s", chr(c))]
    texts = [t for w in [*white, "a", "​", "é"] for t in (f"one{w} two", f"one {w}two", f"one{w} ", f"{w}one{w}\ntwo", f" one\n{w}two{w}", f"one {w} two", w, w + w)]
    assert code.ids(texts) == [code.whole(t) for t in texts]
    unsafe = re.compile(r"\s (?:\s|\Z)|[^\S\n]\n").search
    assert code._safe(texts) == [i for i, t in enumerate(texts) if not unsafe(t)]


def test_new_words_are_looked_at_many_at_once(monkeypatch):
    """White space was sought in each new word by itself: 2,000 searches for 2,000 words."""
    code, real, looks = Encoder(PATH), tokens._SPACE, []
    monkeypatch.setattr(tokens, "_SPACE", lambda text: looks.append(1) or real(text))
    text = " ".join(f"word{i}" for i in range(2000)) + "\nodd\tone " + " ".join(f"x{i}," for i in range(20))
    assert code.ids([text]) == [code.whole(text)] and len(looks) < 600
