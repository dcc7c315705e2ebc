"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, BPE encoding.

Each stage is (name, function(spark, docs, sf_dir)); run() writes each result as Parquet into the
shared folder and reads it again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import bpe, dedup, langid, mixing, simhash
from wordmill.llm.common import stage
from wordmill.llm.queries import tokenizer

#: A document goes if it has no letters or no text, if it is like nothing learned from (langid's gate), or if no
#: language scores this much (with four languages the gate alone does the work: the best score is hardly ever lower).
LEAST_SCORE = 0.25
#: Fingerprints of a document in the near-dedup stage, and their bits.
PRINTS, BITS = 20, 48


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known (operator 2)."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model, gate=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts (operator 5)."""
    return dedup.keep_first(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (operator 6).

    Five-word shingles; PRINTS independent fingerprints of BITS bits, four of which may differ: a pair that is
    similar by 0.8 is linked by one of them with probability 0.94, by 0.85 or more with 0.99 (see the README)."""
    return simhash.keep_one(docs, words=5, prints=PRINTS, bits=BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (operator 8)."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row (operator 1); ids are packed unsigned 32-bit little-endian."""
    return bpe.encode(docs, tokenizer(), keep=["doc_id", "lang", "source"], decode=False)


STAGES = [("language id", identify), ("exact dedup", deduplicate), ("simhash near-dedup", near_deduplicate), ("mixing", mix), ("bpe encoding", encode)]

#: Kernel ridge regression and BPE are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{number}")
    return docs
