"""The queries whose operators run Python on the executors, with the SQL of those whose result SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.llm import language, toxicity
from linkwright.llm.embedding_dedup import embedding_groups
from linkwright.llm.packing import pack
from linkwright.llm.secret_scan import scan
from linkwright.llm.simhash import simhash_groups
from linkwright.llm.training import fold
from linkwright.llm.warc import archived


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_simhash(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir).select("doc_id", "text"))


def word_tokenizer() -> str:
    """The definition of the public tokenizer, read where the driver runs and shipped to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op7_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), word_tokenizer(), with_ids=False)


def op3_warc(spark, sf_dir):
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, url, strlen(html) AS payload_bytes,
         array_to_string(list_transform([1, 11, 21, 31], lambda k: translate(to_base(('0x' || substr(x, k, 10))::BIGINT, 32, 8),
                         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url) = 1 AS first, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN low END AS refers_to
FROM r
"""


def op4_embeddings(spark, sf_dir):
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (
  SELECT r, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
k AS (SELECT a.r, b.r AS s FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r AND list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.98),
c(r, s) AS (SELECT r, r FROM e UNION SELECT c.r, k.s FROM c JOIN k ON k.r = c.s),
m AS (SELECT c.r, min(e.vec_id) AS low FROM c JOIN e ON e.r = c.s GROUP BY c.r)
SELECT vec_id, (SELECT count(*) FROM k WHERE k.r = e.r) AS n_links, low AS component_id, vec_id IS NOT DISTINCT FROM low AS kept FROM e JOIN m ON m.r = e.r
"""


def op5_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    return language.identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_secrets(spark, sf_dir):
    return scan(documents(spark, sf_dir), with_secrets=False)


def op9_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_embeddings": op4_embeddings, "op5_language": op5_language, "op6_secrets": op6_secrets, "op9_toxicity": op9_toxicity, "op3_warc": op3_warc, "op7_packing": op7_packing, "op8_simhash": op8_simhash}
ORACLES = {"op3_warc": OP3_SQL, "op4_embeddings": OP4_SQL}
