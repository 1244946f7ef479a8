from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tempovar.llm import tokencount
from tempovar.llm.common import scratch

from .fixtures import ODD, documents, empty, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(docs):
    library = Tokenizer.from_file(PATH)
    n = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs]
    return Counter((i, b, k, k > 1024) for i, b, k in n)


def test_counts_and_cache(spark):
    cache = scratch(spark, "test-cache")
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    half = df.where("doc_id % 2 = 0")
    tokencount.token_counts(half, PATH, cache).collect()
    before = spark.read.parquet(cache).count()
    assert before == half.select("text").distinct().count()
    assert Counter(map(tuple, tokencount.token_counts(df, PATH, cache).collect())) == want(docs)
    after = spark.read.parquet(cache).count()
    assert after == df.select("text").distinct().count()  # only the distinct misses were appended
    tokencount.token_counts(df, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == after


def test_another_version_misses(spark):
    cache = scratch(spark, "test-cache")
    df = spark.createDataFrame([(1, "Some text")], "doc_id long, text string")
    other = public_tokenizers.path("word_bpe_49k.json")
    a = tokencount.token_counts(df, PATH, cache).collect()
    b = tokencount.token_counts(df, other, cache).collect()
    assert a[0].n_tokens == 2 and b[0].n_tokens == len(Tokenizer.from_file(other).encode("Some text", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_odd_and_empty(spark):
    assert Counter(map(tuple, tokencount.token_counts(documents(spark), PATH).collect())) == want(ODD)
    assert tokencount.token_counts(empty(spark), PATH).collect() == []


def test_repeated_rows_are_encoded_once(spark, tmp_path, monkeypatch):
    """500 equal rows, and copies under other ids: one cache row for the text."""
    docs = [(1, "the same row " * 20)] * 500 + [(i, "the same row " * 20) for i in range(2, 40)] + [(None, "the same row " * 20)] * 3 + [(50, "another")]
    folder = str(tmp_path / "cache")
    got = tokencount.token_counts(documents(spark, docs), PATH, folder).collect()
    assert len(got) == len(docs) and len({r.n_tokens for r in got}) == 2
    assert spark.read.parquet(folder).count() == 2
    encoded = []
    real = tokencount.encoded
    monkeypatch.setattr(tokencount, "encoded", lambda texts, *a: (encoded.append(texts.count()), real(texts, *a))[1])
    tokencount.token_counts(documents(spark, docs), PATH, folder).collect()
    assert encoded == [0]  # all known to the cache
