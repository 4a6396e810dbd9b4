"""Personal data: spans by rule, and more by a skip-chain conditional random field.

Rules find e-mail addresses, internet addresses, card and phone numbers; a match that fails its
check is dropped. The field labels words that hold a digit or "@" (no others are in question) with a
kind, first or further word of it, or none. Potentials: a word's features; neighbouring words
(a chain; a word beside plain text neighbours "none"); and skips, which tie a word to the one
before in the same document that has the same key (address, or last seven digits), however far.
Words under a rule's span are given, so what a document has shown once pulls its repetitions, in other
spellings, to the same label. Marginals come from loopy message passing, all words of a batch at
once. A run of words that reach `threshold` becomes a span if its text holds something of that kind
(digits that pass the card check, four numbers up to 255, ...). The rules' spans stay.

The weights are learned by pseudo-likelihood from the rules' spans in a sample of about
`sample_docs` texts, of each at most NODES_PER_DOC words; words under a failed phone match are left
out, as such a match may have run into something else. Features are left out at random, so that
no single one is relied on.

Texts are scanned in time proportional to their length, whatever they hold. Cases: a null text is
empty, and has no span; each row is answered, repeated and null ids too; where nothing is found to
learn from, the rules' spans are all; an empty table gives an empty result; other columns aren't
looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: Labels: none, then first and further word of each kind.
LABELS = 1 + 2 * len(KINDS)
KIND_OF = np.array([0, *(1 + k for k in range(len(KINDS)) for _ in range(2))])
NODES_PER_DOC = 64
SIZE = 1 << 12
NONE = SIZE  # the number of no feature; its weights stay zero

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(NUMBER.findall(text))


def _octet(number: str) -> bool:
    short = number.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = last - 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) by rule, in order; and the phone matches that failed."""
    out, failed = [(a, EMAIL, b) for a, b in emails(text)], []
    for m in DOTTED.finditer(text):
        if "." in m[0]:
            parts = [(n.start() + m.start(), n.end() + m.start(), n[0]) for n in NUMBER.finditer(m[0])]
            for i in range(0, len(parts) - 3, 4):
                if all(_octet(p[2]) for p in parts[i : i + 4]):
                    out.append((parts[i][0], IP, parts[i + 3][1]))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in DIALLED.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
        else:
            failed.append(m.span())
    return sorted(out), failed


def words(text: str) -> list[tuple[int, int]]:
    """The places of words, as blanks part them, that hold a digit or "@"."""
    out, end = [], 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start, stop = m.start(), m.end()
        while start > end and not text[start - 1].isspace():
            start -= 1
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        out.append((start, stop))
        end = stop
    return out


def _shape(word: str, long: bool) -> str:
    word = NUMBER.sub(lambda m: str(min(len(m[0]), 9)) if long else "0", word[:48])
    return re.sub(r"[^\W\d_]+", "a", word)


def core(word: str) -> str:
    """The word without marks around it, but for a plus or a bracket at its front."""
    return re.sub(r"^[^\w+(@]+|[^\w)@]+$", "", word[:96])


def features(text: str, places: list[tuple[int, int]], i: int) -> list[int]:
    start, stop = places[i]
    word = core(text[start:stop])
    digits = _digits(word)
    before, after = text[max(0, start - 24) : start].split(), text[stop : stop + 24].split()
    held = [f"s{_shape(word, False)}", f"l{_shape(word, True)}", f"n{min(len(digits), 20)}", f"@{'@' in word}", f"+{word[:1]}" if word[:1] in ("+", "(") else "+", f"e{word[-1:] if not word[-1:].isalnum() else ''}"]
    held += [f"p{before[-1].lower()[-12:] if before else ''}", f"f{after[0].lower()[:12] if after else ''}"]
    held += [f"ps{_shape(core(before[-1]), True) if before else ''}", f"fs{_shape(core(after[0]), True) if after else ''}"]
    parts = word.split(".")
    held += [f"d{min(len(parts), 6)}{all(p.isascii() and p.isdigit() and _octet(p) for p in parts)}", f"u{14 <= len(digits) <= 19 and luhn(digits)}", f"a{any(c.isalpha() for c in word)}"]
    return [zlib.crc32(x.encode()) % SIZE for x in held]


N_FEATURES = 13


def key_of(word: str) -> str | None:
    """What makes words repetitions of each other: the address, or the last seven digits."""
    if "@" in word:
        return core(word).lower()
    digits = _digits(word)
    return digits[-7:] if len(digits) >= 7 else None


@dataclass
class Words:
    """The words in question of several texts. before, skip: the number of the neighbouring or similar earlier word, or -1."""

    features: np.ndarray
    before: np.ndarray
    skip: np.ndarray
    label: np.ndarray
    """By rule; 0: none of the rules' spans."""
    known: np.ndarray
    """False where the rules don't tell the label."""

    def edges(self, which: str) -> tuple[np.ndarray, np.ndarray]:
        other = getattr(self, which)
        here = np.flatnonzero(other >= 0)
        return other[here], here


def words_of(text: str, spans: list[tuple[int, int, int]], failed: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[tuple]:
    """Rows of Words for a text, numbered from 0."""
    rows, last, held, at, lost = [], {}, None, 0, 0
    for i, (start, stop) in enumerate(places):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        while lost < len(failed) and failed[lost][1] <= start:
            lost += 1
        over = [s for s in spans[at : at + 8] if s[0] < stop and s[2] > start]
        span = max(over, key=lambda s: (s[2] - s[0], -s[1])) if over else None
        label = 0 if span is None else 1 + 2 * span[1] + (span == held)
        held = span
        unsure = span is None and lost < len(failed) and failed[lost][0] < stop
        adjacent = i > 0 and text[places[i - 1][1] : start].isspace()
        key = key_of(text[start:stop])
        rows.append((features(text, places, i), i - 1 if adjacent else -1, last.get(key, -1) if key else -1, label, not unsure))
        if key:
            last[key] = i
    return rows


def gathered(texts: list[list[tuple]]) -> Words:
    """The rows of several texts in one."""
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    rows = [r for t in texts for r in t]
    shift = np.repeat(offsets[:-1], np.diff(offsets))
    column = lambda i: np.array([r[i] for r in rows], np.int64)
    moved = lambda x: np.where(x >= 0, x + shift, -1)
    return Words(np.array([r[0] for r in rows], np.int64).reshape(-1, N_FEATURES), moved(column(1)), moved(column(2)), column(3), column(4).astype(bool))


@dataclass
class Field:
    weight: np.ndarray
    """By feature and label."""
    chain: np.ndarray
    """By the earlier and the later word's label."""
    skip: np.ndarray
    """By kinds, 0 being none."""

    def skips(self) -> np.ndarray:
        return self.skip[KIND_OF][:, KIND_OF]

    def unary(self, w: Words) -> np.ndarray:
        """Scores by word and label: features, and plain text on either side."""
        out = self.weight[w.features].sum(1)
        after = np.zeros(len(out), bool)
        after[w.before[w.before >= 0]] = True
        return out + np.where(w.before[:, None] < 0, self.chain[0], 0) + np.where(~after[:, None], self.chain[:, 0], 0)

    def marginals(self, w: Words, given: np.ndarray, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
        """Probabilities by word and label, by loopy message passing. given: words whose label is w.label."""
        score = self.unary(w)
        score[given] = np.where(np.arange(LABELS) == w.label[given, None], score[given], -1e9)
        pairs = [w.edges("before"), w.edges("skip")]
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        kind = np.repeat([0, 1], [len(p[0]) for p in pairs])
        table = np.stack([self.chain, self.skips()])[kind]
        # messages along each edge, to b and to a
        sent = np.zeros((2, len(a), LABELS))
        for _ in range(rounds if len(a) else 0):
            belief = score.copy()
            np.add.at(belief, b, sent[0])
            np.add.at(belief, a, sent[1])
            new = np.stack([_logsumexp((belief[a] - sent[1])[:, :, None] + table, 1), _logsumexp((belief[b] - sent[0])[:, None, :] + table, 2)])
            new -= _logsumexp(new, 2)[:, :, None]
            change = np.abs(np.exp(new) - np.exp(sent)).max()
            sent = new if not sent.any() else np.logaddexp(np.log1p(-damping) + new, np.log(damping) + sent)
            if change < 1e-6:
                break
        np.add.at(score, b, sent[0])
        np.add.at(score, a, sent[1])
        return np.exp(score - _logsumexp(score, 1)[:, None])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def pseudo_likelihood(field: Field, w: Words, ridge: float) -> tuple[float, Field]:
    """The mean loss of each known word given its neighbours' labels, and its gradient."""
    y, n = w.label, max(int(w.known.sum()), 1)
    score = field.unary(w)
    (a, b), (c, d) = w.edges("before"), w.edges("skip")
    np.add.at(score, b, field.chain[y[a]])
    np.add.at(score, a, field.chain[:, y[b]].T)
    skips = field.skips()
    np.add.at(score, d, skips[y[c]])
    np.add.at(score, c, skips[y[d]])
    level = _logsumexp(score, 1)
    loss = float((level - score[np.arange(len(y)), y])[w.known].sum() / n)
    err = np.exp(score - level[:, None])
    err[np.arange(len(y)), y] -= 1
    err *= w.known[:, None] / n
    grad = Field(np.zeros_like(field.weight), np.zeros_like(field.chain), np.zeros_like(field.skip))
    np.add.at(grad.weight, w.features.ravel(), np.repeat(err, w.features.shape[1], 0))
    grad.weight[NONE] = 0
    after = np.zeros(len(y), bool)
    after[a] = True
    grad.chain[0] += err[w.before < 0].sum(0)
    grad.chain[:, 0] += err[~after].sum(0)
    np.add.at(grad.chain, y[a], err[b])
    np.add.at(grad.chain.T, y[b], err[a])
    by_kind = np.zeros((len(y), len(KINDS) + 1))
    np.add.at(by_kind.T, KIND_OF, err.T)
    half = np.zeros_like(field.skip)
    np.add.at(half, KIND_OF[y[c]], by_kind[d])
    np.add.at(half, KIND_OF[y[d]], by_kind[c])
    grad.skip += (half + half.T) / 2  # the table is symmetric
    for g, x in zip((grad.weight, grad.chain, grad.skip), (field.weight, field.chain, field.skip), strict=True):
        loss += ridge * float((x**2).sum()) / 2
        g += ridge * x
    return loss, grad


def learned(w: Words, turns: int = 120, rate: float = 0.2, ridge: float = 1e-4, dropout: float = 0.3, seed: int = 0) -> Field:
    """Weights by steps of adaptive size, each with other features left out."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((SIZE + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((len(KINDS) + 1,) * 2))
    first, second = ([np.zeros_like(x) for x in (field.weight, field.chain, field.skip)] for _ in range(2))
    for t in range(1, turns + 1):
        left = Words(np.where(rng.random(w.features.shape) < dropout, NONE, w.features), w.before, w.skip, w.label, w.known)
        _, grad = pseudo_likelihood(field, left, ridge)
        for x, g, m, v in zip((field.weight, field.chain, field.skip), (grad.weight, grad.chain, grad.skip), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return field


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000) -> Field | None:
    """The field learned from the rules' spans in about sample_docs texts; None where they hold no word in question."""
    share = sample_docs / max(df.count(), 1)
    unit = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) / F.lit(1e6)
    some = df.where(F.col(text_col).isNotNull() & (unit < share)).where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text")).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found = words_of(text, *base_spans(text), words(text))[:NODES_PER_DOC]
                out.append([{"f": r[0], "b": r[1], "s": r[2], "y": r[3], "k": bool(r[4])} for r in found])
            yield pa.RecordBatch.from_arrays([pa.array(out, ROWS)], names=["rows"])

    rows = some.mapInArrow(run, "rows array<struct<f: array<bigint>, b: bigint, s: bigint, y: bigint, k: boolean>>").collect()
    texts = sorted([(r["f"], r["b"], r["s"], r["y"], r["k"]) for r in row["rows"]] for row in rows)
    w = gathered(texts)
    return learned(w) if len(w.label) else None


ROWS = pa.list_(pa.struct([("f", pa.list_(pa.int64())), ("b", pa.int64()), ("s", pa.int64()), ("y", pa.int64()), ("k", pa.bool_())]))
NEAR_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
FOUR = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
PLAIN = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,18}(?![0-9])")
CALLED = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])+")


def plausible(text: str, kind: int) -> tuple[int, int] | None:
    """The part of the text that can be of the kind."""
    if kind == EMAIL:
        m = NEAR_EMAIL.search(text) if len(text) < 400 else None
        return m.span() if m else None
    if kind == IP:
        return next((m.span() for m in FOUR.finditer(text) if all(map(_octet, m[0].split(".")))), None)
    if kind == CARD:
        return next((m.span() for m in PLAIN.finditer(text) if luhn(_digits(m[0]))), None)
    m = CALLED.search(text)
    return m.span() if m and 10 <= len(_digits(m[0])) <= 15 else None


def added_spans(text: str, places: list[tuple[int, int]], spans: list[tuple[int, int, int]], prob: np.ndarray, before: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Spans of the words that the field gives a kind. prob: by word and label; before: the neighbouring earlier word, or -1."""
    by_kind = prob[:, 1::2] + prob[:, 2::2]
    taken, out, i, at = sorted((a, b) for a, _, b in spans), [], 0, 0
    while i < len(places):
        k = int(by_kind[i].argmax())
        start, stop = places[i]
        i += 1
        if by_kind[i - 1, k] < threshold:
            continue
        while i < len(places) and before[i] >= 0 and by_kind[i, k] >= threshold and prob[i, 2 + 2 * k] > prob[i, 1 + 2 * k]:
            stop = places[i][1]
            i += 1
        if (found := plausible(text[start:stop], k)) is None:
            continue
        a, b = start + found[0], start + found[1]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and y > a for x, y in taken[at : at + 8]):
            out.append((a, k, b))
    return out


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found_in(texts: list[str], field: Field | None, threshold: float) -> list[tuple[list, list]]:
    """For each text the rules' spans, and the field's."""
    out, at, rows, held = [([], []) for _ in texts], [], [], []
    for i, text in enumerate(texts):
        if MARK.search(text) is None:
            continue
        spans, failed = base_spans(text)
        out[i] = (spans, [])
        if field is not None:
            places = words(text)
            at.append(i)
            held.append(places)
            rows.append(words_of(text, spans, failed, places))
    if rows:
        w = gathered(rows)
        prob = field.marginals(w, w.label > 0)
        prob[w.label > 0] = 0  # the rules' words are spans already
        begin = 0
        for i, places in zip(at, held, strict=True):
            part = slice(begin, begin := begin + len(places))
            out[i] = (out[i][0], added_spans(texts[i], places, out[i][0], prob[part], w.before[part], threshold))
    return out


def personal_data(df: DataFrame, field: Field | None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each row; the first four count the rules' spans."""
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = found_in([x or "" for x in batch.column(1).to_pylist()], field, threshold)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(joined_spans(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([joined_spans(sorted(base + more)) for base, more in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, every, pa.array([len(more) for _, more in found], pa.int64())], names=names)

    long = [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *long[1:5], T.StructField(names[5], T.StringType()), T.StructField(names[6], T.StringType()), long[7]])
    return df.select(id_col, text_col).mapInArrow(run, schema)
