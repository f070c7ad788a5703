"""The corpus pipeline: STAGES applied to documents, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airledger.llm import mixing, ngram_join, packing, secret_scan, toxicity
from airledger.llm.common import fresh

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Labels of documents that are not held out are learnt from; documents scored 0.7 or more go.

    Null and empty texts, texts without an id and, without any toxic label, all texts that
    hold no fixed insult stay; repeated rows fare alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out_column(F.col("doc_id")))
    lexicon, factors = toxicity.learn(docs, labels)
    score = fresh(docs, "_toxicity")
    return toxicity.score(docs, lexicon, factors, score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    The one of the smallest doc_id stays, one without an id only if there is no other;
    texts without words all stay; of one doc_id's texts only those go from which a chain of
    near copies leads to the one that stays. See ngram_join.keep_one().
    """
    return ngram_join.keep_one(docs, width=5, num=8, den=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Secret spans are replaced by a mark; all documents stay, null and empty texts as they are.

    n_chars is that of the new text (null of a null text), if the table has it.
    """
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Sources are weighted by the square root of their size; as many rows as before are expected.

    A null source is one source; repeated rows are drawn alike; an empty table stays empty.
    """
    return mixing.mix(docs, temper=0.5, factor=1.0).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Pieces of windows of 2048 ids; a null or empty text is the end id alone, repeated rows are packed again."""
    return packing.pack(docs, TOKENIZER, size=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The stages learn from text, link by similarity and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
