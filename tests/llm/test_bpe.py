import base64
import hashlib
import random
import time

import numpy as np
import pytest
import tiktoken

from panelflow.llm import bpe, queries


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.public_ranks(spark)


@pytest.fixture(scope="module")
def library(ranks):
    own = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=own, special_tokens={})


def test_agrees_with_the_public_library(odd_docs, ranks, library):
    got = bpe.round_trip(odd_docs, *ranks).collect()
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want


def test_decode_of_given_ids(spark, ranks, library):
    ids = library.encode_ordinary("Größe und Maß, 42!")
    df = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, ids[:1] * 3)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, *ranks).collect()}
    assert got == {1: "Größe und Maß, 42!".encode(), 2: b"", 3: b"", 4: library.decode_bytes(ids[:1] * 3)}


def test_dictionary_starts_afresh(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 3)
    monkeypatch.setattr(bpe, "QUERY_WORDS", 2)
    own = bpe.Coder(*ranks)
    for text in ("one two three four five", "six seven unbelievableness one", ""):
        ids, decoded = own.gather([text, text + "!"])
        assert ids.to_pylist() == [library.encode_ordinary(text), library.encode_ordinary(text + "!")]
        assert decoded.to_pylist() == [text.encode(), (text + "!").encode()]


def test_long_words(spark, ranks, library):
    """Single matches of the pattern that are long: any letters, and runs that overlap themselves."""
    rng = random.Random(2)
    words = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ACGT", 5000), ("ab", 1000), ("éßñ漢字", 3000), ("esnt", 3000))]
    words += ["a" * n for n in (199, 200, 201, 4097)] + ["ab" * 500, "aab" * 300, " " * 5000, "the" * 700]
    own = bpe.Coder(*ranks)
    began = time.perf_counter()
    ids, decoded = own.gather(words)
    assert time.perf_counter() - began < 30
    assert ids.to_pylist() == [library.encode_ordinary(w) for w in words]
    assert decoded.to_pylist() == [w.encode() for w in words]
    for w in words[:3]:
        assert b"".join(own.parts(w.encode())) == w.encode()


def test_query_agrees_with_the_library(spark, library):
    """The registered query on a whole table, digest by digest; what is decoded comes from the ids."""
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op1_byte_bpe(spark, sf).collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.Coder(*bpe.public_ranks(spark)).bytes_of(np.array([1, 10**8], np.int32), np.array([2]))


def test_empty_table(no_docs, ranks):
    assert bpe.round_trip(no_docs, *ranks).collect() == []
    assert bpe.encode(no_docs, *ranks).columns == ["doc_id", "ids"]
