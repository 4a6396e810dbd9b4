import random

import numpy as np
import pytest
import xxhash

from panelflow.llm import queries, simhash


def slow_fingerprint(text):
    words = simhash.WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, prints):
    """Smallest reachable id of each row."""
    fp = np.array(prints, np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, np.array(ids)
    while True:
        new = np.where(near, label[None], 1 << 60).min(1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += [texts[3]] * 40
    for i in range(60):
        words = texts[i % 5].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"]) == slow_fingerprint(r["text"])


def test_components_agree_with_all_pairs(corpus):
    rows = corpus.collect()
    want = brute([r["doc_id"] for r in rows], [slow_fingerprint(r["text"]) for r in rows])
    assert {r["doc_id"]: r["component"] for r in simhash.near_duplicates(corpus).collect()} == want
    kept = simhash.keep_first(corpus)
    assert kept.columns == corpus.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("tile", [7, 64])
def test_links_of_dense_tiles(spark, monkeypatch, tile):
    """Many fingerprints at all small distances, in tiles that are cut to grids."""
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "SMALL", 5)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 8, dtype=np.int64).astype(np.uint64)
    fps = []
    for _ in range(400):
        x = base[rng.integers(8)]
        for _ in range(rng.integers(0, 9)):
            x ^= np.uint64(1) << np.uint64(rng.integers(64))
        fps.append(int(x))
    fps = sorted(set(fps) | {0, 1, 2**64 - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        assert int(np.bitwise_count(np.int64(a).view(np.uint64) ^ np.int64(b).view(np.uint64))) >= 1
        root[find(a)] = find(b)
    want = brute(list(range(len(fps))), fps)
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(find(f), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}
    kept = simhash.keep_first(odd_docs).collect()
    assert [r["doc_id"] for r in kept].count(1) == 1 and sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_first(no_docs).collect() == []


def test_each_group_keeps_one_row(spark):
    """Ids that repeat with other texts, two groups with the same smallest id, and null ids."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white pink")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (5, "x y"), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.keep_first(df).collect()))) == sorted(map(str, [(1, a), (1, b), (None, c), (5, "x y")]))


def test_query_agrees_with_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    want = brute([r["doc_id"] for r in rows], prints)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == {(r["doc_id"], f"{p:016x}", want[r["doc_id"]]) for r, p in zip(rows, prints, strict=True)}
