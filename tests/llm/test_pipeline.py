import hashlib

import corpus_pipeline
import pytest

from panelflow.llm import bpe, langid, mixing, simhash, toxicity
from panelflow.llm.common import crc_mod, read_table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_run_agrees_with_plain_steps(spark):
    """The stages' decisions, taken row by row from the operators' reports."""
    docs = read_table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, read_table(spark, SF, "labels").where(crc_mod("doc_id", 3) != 1))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.7}
    langs = langid.predict(docs, langid.fit(docs.where(crc_mod("doc_id", 4) != 2))).collect()
    unknown = {r["doc_id"] for r in langs if r["lang_pred"] == "und"}
    left = docs.where(~docs["doc_id"].isin([*toxic, *unknown]))
    component = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(left).collect()}
    first = left.where(left["doc_id"].isin([i for i, c in component.items() if i == c]))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(first).collect()}
    want = {}
    coder = bpe.Coder(*bpe.public_ranks(spark))
    for i, (n, size) in taken.items():
        parts = [rows[i]["text"]] * (n // size if size else 0)
        if size and n % size:
            cut = list(mixing_words(rows[i]["text"]))[n % size - 1]
            parts.append(cut)
        want[i] = sorted(hashlib.sha256(",".join(map(str, coder.gather([p])[0].to_pylist()[0])).encode()).hexdigest() for p in parts)
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r["doc_id"], []).append(r["ids_sha256"])
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def mixing_words(text):
    """The text's beginnings up to each word, with the blanks behind it."""
    import re

    for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text):
        yield text[: m.end()]


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "SimHash near-dedup", "source mixture", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op4_warc", "op6_license", "op7_balltree", "op9_mixing"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from panelflow.llm import queries

    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    relation = db.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([row[i] for i in at]) for row in relation.fetchall())
