import hashlib
import random
import re
import zlib

import duckdb
import pytest

from panelflow.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos long, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sequences(rows):
    """Each conversation's turns, in the operator's order."""
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, v in own.items():
        h, stem = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(stem, [])[:h] + v[h:]
    return out


def brute(convs):
    members, rows = {}, []
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault((d, tuple(v[:d])), []).append(c)
    kids = {}
    for d, p in members:
        if d:
            kids.setdefault((d - 1, p[:-1]), []).append((d, p))

    def below(node):
        leaves, saved = 0, (len(members[node]) - 1) * (len(WORD.findall(node[1][-1][1])) if node[0] else 0)
        for k in kids.get(node, ()):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves or 1, saved

    for (d, p), m in members.items():
        parent = min(members[d - 1, p[:-1]]) if d else None
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == d)
        rows.append((min(m), d, parent, len(m), len(kids.get((d, p), ())), *below((d, p)), sha(ends)))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(5), []
    pool = [("user", "a b"), ("assistant", "c  d\ne"), ("user", ""), (None, "x"), ("", "x"), ("u", "ser x"), ("us", "er x")]
    for c in [*range(-45, 130), 4097, 9000, 10**12]:
        for k in range(rng.choice([0, 1, 1, 2, 3, 5])):
            role, text = rng.choice(pool[: rng.choice([2, 7])])
            rows.append((c, rng.choice([k, k, None, 1]), role, text, "n", 0, "w"))
    copy = [(k, "user", f"turn {k}") for k in range(6)]
    for c in (200, 201, 213, 8_000):  # long copies, one of which goes on
        rows += [(c, *t, "n", 0, "w") for t in copy]
    rows += [(8_000, 6, "user", "more"), (None, 0, "user", "no id", "n", 0, "w")[:4], (3, None, None, None), (3, None, None, None)]
    return [(*r, "n", 0, "w")[:7] for r in rows]


@pytest.mark.parametrize("convs", [0, 4, 256])
def test_trie_of_plain_conversations(spark, talks, monkeypatch, convs):
    """Of which groups up to some size are left to one task."""
    monkeypatch.setattr(prefix_trie, "SUBTREE_CONVS", convs)
    df = spark.createDataFrame(talks, SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(sequences(talks))


def test_trie_of_rebuilt_conversations_and_its_sql(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA)
    want = brute(rebuilt(sequences(talks)))
    assert rows_of(prefix_trie.grafted_trie(df)) == want
    db = duckdb.connect()
    db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(db.sql(queries.OP11_SQL).fetchall(), key=str) == want


def test_runs_of_ids_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 3)
    monkeypatch.setattr(prefix_trie, "SUBTREE_CONVS", 0)
    rows = [(c, 0, "user", "the same", "n", 0, "w") for c in (*range(-7, 30), 1_000)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(sequences(rows))


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, sf)) == brute(rebuilt(sequences(rows)))


def test_no_conversation(spark):
    none = spark.createDataFrame([(None, 0, "user", "x", "n", 0, "w")], SCHEMA)
    assert prefix_trie.prefix_trie(none).collect() == [] and prefix_trie.grafted_trie(none.limit(0)).collect() == []
