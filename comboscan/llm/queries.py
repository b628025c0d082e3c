"""Thin queries over the operators of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, collocations, decontam, langid, lm, packing, pieces, pii, sharding, simhash, tokencount, topk, toxicity
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op2_simhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query("op5_exact_topk", """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


@query("op8_hash_tree_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


@query("op7_tiered_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_decontamination", r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM d),
b AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, text, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM b),
bn AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY ALL),
m AS (SELECT ds.doc_id, ds.text AS dt, bs.item_id, bs.text AS bt, count(*) AS matched FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT m.doc_id, m.item_id, m.matched, bn.n AS item_shingles, m.matched / bn.n AS containment
FROM m JOIN bn ON bn.item_id = m.item_id AND bn.text = m.bt WHERE m.matched * 10 >= bn.n * 8""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.sample(langid.training_rows(docs)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "distance", "rejected")


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), key="op4").select("doc_id", "text", "entities")


@query("op3_stupid_backoff", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
b AS (SELECT rid, p, w, lag(w) OVER (PARTITION BY rid ORDER BY p) AS v FROM t),
c1 AS (SELECT w, count(*) AS n FROM b GROUP BY w), o1 AS (SELECT rid, w, count(*) AS n FROM b GROUP BY rid, w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT rid, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY rid, v, w),
s AS (SELECT rid, count(*) AS n FROM b GROUP BY rid), tot AS (SELECT count(*) AS n FROM b),
x AS (
  SELECT b.rid, b.v, cw.n - ow.n AS l1, cv.n - ov.n AS lv, cb.n - ob.n AS l2, tot.n - s.n AS rest
  FROM b JOIN c1 cw ON cw.w = b.w JOIN o1 ow ON ow.rid = b.rid AND ow.w = b.w
  LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN o1 ov ON ov.rid = b.rid AND ov.w = b.v
  LEFT JOIN c2 cb ON cb.v = b.v AND cb.w = b.w LEFT JOIN o2 ob ON ob.rid = b.rid AND ob.v = b.v AND ob.w = b.w
  JOIN s ON s.rid = b.rid CROSS JOIN tot),
y AS (SELECT rid, CASE WHEN v IS NOT NULL AND l2 > 0 THEN ln(l2) - ln(lv) ELSE
  (CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE ln(0.4::DOUBLE) END) + (CASE WHEN l1 > 0 THEN ln(l1) - ln(rest) ELSE -ln(rest + 1) END) END AS ls FROM x),
z AS (SELECT rid, count(*) AS n, sum(ls) AS total FROM y GROUP BY rid)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS tokens, coalesce(round(z.total / z.n, 6), 0.0::DOUBLE) AS mean_log_score FROM d LEFT JOIN z USING (rid)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.stupid_backoff(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("tokens") > 0, F.round(F.col("log_score") / F.col("tokens"), 6)).otherwise(0.0)
    return out.select("doc_id", "tokens", mean.alias("mean_log_score"))


@query("op6_trie_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary, pattern)


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learnt = fold(F.col("doc_id"), 4) != 2  # nothing of the other fold is counted, labels neither
    model = toxicity.train(toxicity.sample(docs.where(learnt), labels.where(learnt)))
    out = toxicity.predict(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest(F.col("decoded").cast("binary")).alias("decoded_sha256"),
        digest("begins").alias("begins_sha256"), digest("ends").alias("ends_sha256"),
    )


@query("op11_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]+')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m AS m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, tot.n,
    ((1000::HUGEINT * k.a * tot.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k.k + 1:], ' ') JOIN tot ON tot.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, a, unnest(flatten(list_transform(range(1, m), lambda i:
  list_transform(list_filter(range(i + 1, m + 1), lambda j: j - i + 1 < m), lambda j: array_to_string(ws[i:j], ' '))))) AS phrase FROM c WHERE m > 2),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.lang = b.lang AND u.phrase = b.phrase AND 100 * u.a >= 100 * b.a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z)
SELECT * FROM o WHERE rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), max_n=5, at_least=100, cover=100, top=2000)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups="sha256")
    return out.withColumnRenamed("groups", "groups_sha256")
