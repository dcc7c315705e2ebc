"""Queries over the driver's tables for the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import bpe, chat, dedup, langid, mixing, shard, simhash, tokenfile, urlfilter, winnow

END_ID = 2


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), keep=["doc_id"])
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns, tokenizer=tokenizer()), in_order=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), END_ID)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_langid, op3_winnow, op4_chat, op5_exact_dedup, op6_simhash, op7_urlfilter, op8_mixing, op9_shards, op10_tokenfile)}


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place
  FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '')), 1, 12) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w
  FROM t GROUP BY source),
l AS (
  SELECT *, 2.0 * source_size AS cap,
         (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(CAST(2.0 * source_size AS DOUBLE)) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
g AS (
  SELECT *, CASE WHEN level >= cap / w THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN level < cap / w THEN level END) OVER () * w END AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS epochs FROM g),
p AS (
  SELECT t.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source),
c AS (
  SELECT *, min(CASE WHEN start + size / 2.0 > rest THEN k END) OVER (PARTITION BY source) AS cut FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN cut IS NULL OR k < cut THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_mixing": OP8_SQL}
