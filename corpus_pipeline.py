"""A corpus pipeline: toxicity, language, near-duplicates, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import bpe, langid, mixing, simhash, toxicity
from panelflow.llm.common import crc_mod, read_table, shared_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, toxicity.fit(read_table(spark, sf_dir, "documents"), labels))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay."""
    model = langid.fit(read_table(spark, sf_dir, "documents").where(crc_mod("doc_id", 4) != 2))
    return langid.keep_identified(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate component stays."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last one of a source is cut at its budget."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to."""
    pairs = bpe.round_trip(docs, *bpe.public_ranks(spark))
    decoded = F.sha2("decoded", 256).alias("decoded_sha256")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256")
    return pairs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("SimHash near-dedup", one_of_each_group),
    ("source mixture", mix_sources),
    ("byte-level BPE", token_ids),
]

#: Learned stages can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage{i}")
    return docs
