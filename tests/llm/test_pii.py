import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from panelflow.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The rules as they are stated, with a library's own search."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_rules_agree_with_plain_searches():
    rng = random.Random(1)
    atoms = [*"0123456789012345@@@...---+ ()%_a", "a@b.c", "12.34.56.78", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", ".com", "é", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text)[0] == plain(text), text


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "a." * 100_000, "1." * 100_000, "a@" * 100_000, "1 " * 100_000, "+1(" * 70_000, "a1@" * 70_000, "+1" + "(" * 200_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.perf_counter()
    pii.found_in([text], pii.Field(np.zeros((pii.SIZE + 1, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), np.zeros((5, 5))), 0.9)
    assert time.perf_counter() - began < 20


def random_field(rng, scale=1.0):
    skip = rng.normal(size=(5, 5)) * scale
    field = pii.Field(rng.normal(size=(pii.SIZE + 1, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)) * scale, skip + skip.T)
    field.weight[pii.NONE] = 0
    return field


def test_message_passing_is_exact_without_loops():
    rng = np.random.default_rng(4)
    field = random_field(rng)
    w = pii.Words(rng.integers(0, pii.SIZE, (5, pii.N_FEATURES)), np.array([-1, 0, -1, 2, -1]), np.array([-1, -1, 1, -1, 3]), np.array([0, 3, 0, 0, 0]), np.ones(5, bool))
    given = np.array([False, True, False, False, False])
    unary, skips = field.unary(w), field.skips()
    total = np.zeros((5, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), [3], *[range(pii.LABELS)] * 3):
        s = unary[range(5), y].sum() + field.chain[y[0], y[1]] + field.chain[y[2], y[3]] + skips[y[1], y[2]] + skips[y[3], y[4]]
        for i, label in enumerate(y):
            total[i, label] += np.exp(s)
    want = total / total.sum(1, keepdims=True)
    assert np.allclose(field.marginals(w, given, rounds=200), want, atol=1e-5)


def test_gradient_of_the_pseudo_likelihood():
    rng = np.random.default_rng(5)
    field = random_field(rng, 0.5)
    w = pii.Words(rng.integers(0, 40, (30, pii.N_FEATURES)), np.where(rng.random(30) < 0.5, np.arange(30) - 1, -1), np.where(np.arange(30) > 9, np.arange(30) - 7, -1), rng.integers(0, pii.LABELS, 30), rng.random(30) < 0.8)
    _, grad = pii.pseudo_likelihood(field, w, 0.01)
    for name, at in [("weight", (5, 2)), ("weight", (31, 0)), ("chain", (0, 0)), ("chain", (0, 4)), ("chain", (3, 0)), ("chain", (2, 5)), ("skip", (1, 1))]:
        x, step = getattr(field, name), 1e-5
        x[at] += step
        high = pii.pseudo_likelihood(field, w, 0.01)[0]
        x[at] -= 2 * step
        low = pii.pseudo_likelihood(field, w, 0.01)[0]
        x[at] += step
        assert (high - low) / (2 * step) == pytest.approx(getattr(grad, name)[at], abs=1e-6), (name, at)


def phone(rng):
    return f"+1 ({rng.randint(100, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}"


def card(rng):
    while True:
        digits = "".join(str(rng.randint(0, 9)) for _ in range(16))
        if pii.luhn(digits):
            return digits


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(6), []
    some = ["the", "then", "of", "and", "on", "was", "Over", "it.", "river,"]
    talk = lambda n: " ".join(rng.choice(some) for _ in range(n))
    for i in range(900):
        octets = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        kinds = [phone(rng), card(rng), octets, f"{rng.choice(some).strip('.,')}{i}@mail{i % 9}.example.com", f"version {rng.randint(1, 20)}.{rng.randint(0, 9)}", f"{rng.randint(1, 10**16):016d}", f"in {rng.randint(1800, 2100)}", f'token = "{rng.getrandbits(160):040x}"']
        held = rng.sample(kinds, 3)
        held += [x for x in held if rng.random() < 0.3]
        rows.append((i, " ".join(f"{talk(6)} {x} {talk(3)}" for x in held), "en", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip long")


@pytest.fixture(scope="module")
def field(corpus):
    return pii.fit(corpus)


def spans_in(text, field):
    base, more = pii.found_in([text], field, 0.9)[0]
    assert base == plain(text)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in more]


def test_a_repeated_entity_is_found_in_other_spellings(field):
    """What the rules pass over, with what the document shows elsewhere."""
    found = spans_in("Call +1 (487) 555-7209 then of and it was on the river. Or 1 (487) 555-7209 then", field)
    assert [(k, x[-14:]) for k, x in found] == [("phone", "(487) 555-7209")]
    # a phone number that runs into a card number
    text = "the river, +1 (487) 555-7209 4556737586899855 then of it"
    assert plain(text) == [] and ("phone", "+1 (487) 555-7209") in spans_in(text, field)


def test_skips_carry_it(field):
    """Without the skip potentials the distant spelling isn't found."""
    text = "Call +1 (487) 555-7209 then of and it was on the river. Or 1 (487) 555-7209 then"
    cut = pii.Field(field.weight, field.chain, np.zeros_like(field.skip))
    w = pii.gathered([pii.words_of(text, *pii.base_spans(text), pii.words(text))])
    given = w.label > 0
    last = len(w.label) - 1
    phones = lambda f: f.marginals(w, given)[last, 7:9].sum()
    assert w.skip[last] >= 0 and phones(field) > phones(cut)
    assert field.skip[4, 4] > max(field.skip[4, 0], field.skip[4, 1])


def test_clean_words_stay(field):
    for text in ("Licensed under the Apache License, Version 2.0. In 1999, 3 of 4 were 12,000.", 'token = "7702344ead31d5951ffa625c69a7546f3a470a7f" on', "number 9807915762804491 of it", "1.2.3 and 10.11.12.999 on", "on @ the", ""):
        assert spans_in(text, field) == []


def test_odd_rows_and_columns(corpus, odd_docs, no_docs, field):
    rows = pii.personal_data(odd_docs, field).collect()
    assert len(rows) == odd_docs.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] != 7)
    assert pii.personal_data(no_docs, field).collect() == [] and pii.fit(no_docs) is None
    got = pii.personal_data(corpus, None).where("doc_id < 40").collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.where("doc_id < 40").collect()}
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert r["spans"] == pii.joined_spans(want) and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in want) for k in range(4)]


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined_spans(want).encode()).hexdigest()
        assert {s for s in pii.joined_spans(want).split(",") if s} <= set(r["spans"].split(","))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[1] == k for s in want) for k in range(4))
