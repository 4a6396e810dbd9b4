"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import additive, balltree, bpe, elkan, langid, licenses, mixing, pii, prefix_trie, simhash, token_files, toxicity, warc
from panelflow.llm.common import crc_mod, read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bpe.round_trip(read_table(spark, sf_dir, "documents"), *bpe.public_ranks(spark))
    return pairs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), least_bytes=1000)


def op5_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.integers(read_table(spark, sf_dir, "embeddings"), scale=64)
    return balltree.largest(vectors, F.col("id") % 20 == 0, k=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), token_files.public_spec(), end=2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.grafted_trie(read_table(spark, sf_dir, "conversations"), stems=20, most=3)


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.clusters(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dim=64, seed="3:")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs), threshold=0.9)


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
r AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM r)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('11:' || coalesce(doc_id::VARCHAR, 'null'))[:15] AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[place % 3 + 1] AS weight FROM s
), c AS (
  SELECT *, row_number() OVER o AS j, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free, (SELECT sum(size) FROM d)::BIGINT AS total
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, place)
), level AS (
  SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * held) / free AS level FROM c
  WHERE 2.0::DOUBLE * source_size > weight * ((1.5::DOUBLE * total - 2.0::DOUBLE * held) / free) ORDER BY j LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT level FROM level)) AS target FROM w
), r AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget, CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM r
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS k FROM t),
bits AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS r
  FROM (SELECT DISTINCT c FROM o)
), plan AS (SELECT c, xor(r, 4294967295::BIGINT) % 4 AS h, c - c % 20 AS stem FROM bits),
got AS (SELECT plan.c, h, stem, count(o.k) AS n FROM plan LEFT JOIN o ON o.c = stem AND o.k <= h GROUP BY ALL),
rebuilt AS (
  SELECT got.c, o.k AS pos, key, words FROM got JOIN o ON o.c = stem AND o.k <= h
  UNION ALL SELECT got.c, o.k - h + n, key, words FROM got JOIN o ON o.c = got.c AND o.k > h
), whole AS (
  SELECT got.c, coalesce(list(key ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS keys, coalesce(list(words ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS words
  FROM got LEFT JOIN rebuilt ON rebuilt.c = got.c GROUP BY got.c
), walk AS (SELECT c, keys, words, unnest(range(0, len(keys) + 1)) AS d FROM whole),
node AS (
  SELECT d, keys[1:d] AS prefix, min(c) AS id, count(*) AS n, coalesce(any_value(words[d]), 0) AS w,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(keys) = d), '') AS ends
  FROM walk GROUP BY d, keys[1:d]
), kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.prefix = node.prefix),
up AS (SELECT *, unnest(range(0, d + 1)) AS top FROM full_),
sums AS (SELECT top AS d, prefix[1:top] AS prefix, count(*) FILTER (WHERE children = 0) AS leaves, sum((n - 1) * w) AS saved FROM up GROUP BY ALL)
SELECT f.id AS conv_id, f.d AS depth, p.id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums ON sums.d = f.d AND sums.prefix = f.prefix LEFT JOIN node p ON p.d = f.d - 1 AND p.prefix = f.prefix[1:f.d - 1]
"""


def clusters_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:") -> str:
    """Rounds of assignment and means, one after the other."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (
  SELECT rid, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(mean ORDER BY p) AS c FROM (
    SELECT k, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM (SELECT a.k, unnest(v.x) AS x, unnest(range({dim})) AS p FROM a{i} a JOIN v ON v.rid = a.rid) GROUP BY k, p) GROUP BY k) m ON m.k = c{i}.k)""")
    last = f"""SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.rid = a.rid JOIN c{rounds} c ON c.k = a.k"""
    return "WITH " + ",\n".join(parts) + "\n" + last


def queries() -> dict:
    found = (op1_byte_bpe, op2_toxicity, op3_language, op4_warc, op5_additive, op6_license, op7_balltree, op8_token_files, op9_mixing, op10_simhash, op11_prefix_trie, op12_elkan, op13_pii)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op6_license": licenses.scan_sql(), "op7_balltree": OP7_SQL, "op9_mixing": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_elkan": clusters_sql()}
