"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprints, mixing, ngram_join, oracles, packing, piece_codec, quality, secret_scan, token_align, topk_search, toxicity, url_filter, whitening
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's site is its source, its section the language there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality.score(docs, labels)


#: The schema of the tool that turns_as_calls() names: field -> (type, whether it must be there).
REPLY = {"reply": {"text": ("string", True), "n_chars": ("integer", True), "turn": ("integer", True)}}


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, contexts = chat_format.turns_as_calls(table(spark, sf_dir, "conversations"))
    return chat_format.link(calls, results, REPLY, contexts)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), temper=0.5, factor=1.0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the same number; a page is bad if it is toxic or of low quality."""
    bad = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality") == 1, 0).alias("bad")
    )
    return url_filter.judge(table(spark, sf_dir, "pages"), bad).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, factors = toxicity.learn(docs, labels.where(~toxicity.held_out_column(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "text"), lexicon, factors).select(
        "doc_id", toxicity.held_out_column(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def _written(kinds: tuple[str, ...] | None = None):
    own = F.col("spans") if kinds is None else F.filter("spans", lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_written(("assign", "access", "hex")), 256).alias("base_sha256"), _written().alias("spans"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.evidence(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).drop("text")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", wanted=4, scale=256.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_chat_formatting, op4_packing, op5_exact_top_k, op6_source_mixing, op7_fingerprints, op8_url_filters, op9_toxicity, op10_secret_scans, op11_token_alignment, op12_sentencepiece_codec, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    """The others learn from text, tokenize, chunk or scan with positions, which SQL can't express: see tests/llm."""
    return {"op1_ngram_jaccard_join": oracles.OP1, "op5_exact_top_k": oracles.OP5, "op6_source_mixing": oracles.OP6, "op8_url_filters": oracles.OP8}
