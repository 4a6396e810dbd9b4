import random
import re
from collections import defaultdict

import pytest

from panelflow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by plain rounds of resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if most * sizes[s] <= weight[s] * level]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "c", "Z", "é", None]), "en") for i in range(600)]
    return spark.createDataFrame([*rows, rows[0], (None, "x y", "a", "en"), (700, None, "only null", "en")], "doc_id long, text string, source string, size string")


def test_targets_and_takes(corpus):
    rows = corpus.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = filled(sizes)
    got = mixing.mix(corpus, keep={"src": mixing.F.col("source")}).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["src"]] and abs(r["target"] - want[r["src"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["src"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = mixing.mix(corpus.repartition(7), keep={"src": mixing.F.col("source")}).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_order_is_by_key_and_cut_at_the_budget(corpus):
    by_source = defaultdict(list)
    for r in mixing.mix(corpus, keep={"src": mixing.F.col("source"), "k": mixing.random_key(mixing.F.col("doc_id"), 11)}).collect():
        if r["size"]:
            by_source[r["src"]].append((r["k"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]))
    for rows in by_source.values():
        extra = [t / s - int(min(x[4] // x[3] for x in rows)) for *_, s, t in sorted(rows)]
        assert extra == sorted(extra, reverse=True) and sum(0 < e < 1 for e in extra) <= 1


def test_the_mix_itself(corpus):
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    want = defaultdict(int)
    for r in mixing.mix(corpus, keep={"src": mixing.F.col("source")}).collect():
        want[r["src"]] += r["taken"]
    assert {s: n for s, n in want.items() if n} == dict(words)


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert all(r["taken"] == 0 for r in mixing.mix(odd_docs).where("doc_id in (2, 3, 4)").collect())
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
