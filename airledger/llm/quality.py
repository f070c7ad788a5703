"""Operator 2: quality by hierarchical empirical Bayes.

Evidence of a document: features of its text, cut into bins, whose log-odds are learnt
from grouped counts of labelled documents. Most are shares of signs and words; one is
the mean log-odds of its words and pairs of words, hashed into buckets whose weights are
learnt from other labelled documents than the bins are. Each site (host) and section
(path) has a posterior rate of good documents: a site's counts are shrunk towards the
global rate and a section's towards its site's, through beta priors whose strength is
fitted by moments, so sparse sites stay near the prior. A labelled document's own label
is left out of its section's rate. The score is the logistic function of the evidence
plus the log-odds of the section.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import durable

#: Features of a text; each is cut into BINS equal parts of [0, 1].
FEATURES = ("upper", "sign", "digit", "bar", "space", "distinct", "long_word", "repeat", "grams")
BINS = 24
#: Labelled documents that evidence is learnt from, at most; one half gives weights of grams, the other those of the grams' bins.
SAMPLE = 20_000
#: Buckets of words and pairs of words, and how many witnesses halve the shrinking of a bucket's weight.
BUCKETS, FEW_WITNESSES = 1 << 16, 2.0
#: Bounds of the strength of a prior, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0


def _classes() -> np.ndarray:
    """One-hot rows of bytes: upper case (also of two-byte letters' second bytes no), signs, digits, bars, spaces."""
    out = np.zeros((5, 256), np.int64)
    out[0, ord("A") : ord("Z") + 1] = 1
    out[1, 33:48] = out[1, 58:65] = out[1, 91:97] = out[1, 123:127] = 1
    out[1, [ord("."), ord(",")]] = 0
    out[2, ord("0") : ord("9") + 1] = 1
    out[3, ord("|")] = 1
    out[4, [32, 9, 10, 13]] = 1
    return out


def grams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a text's distinct words and pairs of words."""
    pairs = wh.mix(hashes[:-1] * wh.U(0x9FB21C651E98DF25) + hashes[1:])
    return np.unique(np.concatenate([hashes, pairs]) >> wh.U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (good, text): in how many good and other texts each bucket occurs; bucket -1 counts all."""
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        good = batch.column(0).to_numpy()
        for lo, hi, data, offsets in wh.chunks(batch.column(1)):
            hashes, at = wh.words(data, offsets)
            for i in range(hi - lo):
                seen[int(good[lo + i]), grams(hashes[at[i] : at[i + 1]])] += 1
                seen[int(good[lo + i]), -1] += 1
    found = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(found == BUCKETS, -1, found)), pa.array(seen[1, found]), pa.array(seen[0, found])], names=["bucket", "g", "b"])


def gram_weights(own: DataFrame) -> np.ndarray:
    """Shrunk log-odds of each bucket from ``own(good, text)``; BUCKETS rows at most reach the driver."""
    counts = own.select("good", "text").mapInArrow(_counted, "bucket long, g long, b long").groupBy("bucket").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).toArrow()
    bucket, g, b = (counts.column(c).to_numpy() for c in ("bucket", "g", "b"))
    all_g, all_b = int(g[bucket < 0].sum()), int(b[bucket < 0].sum())
    out = np.zeros(BUCKETS, np.float64)
    at = bucket[bucket >= 0]
    g, b = g[bucket >= 0], b[bucket >= 0]
    if all_g and all_b:
        out[at] = (np.log((g + 0.5) / (all_g + 1)) - np.log((b + 0.5) / (all_b + 1))) * (g + b) / (g + b + FEW_WITNESSES)
    return out


def _shape(weights):
    """A mapInArrow function that replaces the text, the last column, by a bin number for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shapes(batches, weights.value)

    return run


def _shapes(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = _classes()
    for batch in batches:
        bins = []
        for lo, hi, data, offsets in wh.chunks(batch.column(batch.num_columns - 1)):
            sizes = np.maximum(1, np.diff(offsets))
            sums = np.zeros((5, len(data) + 1), np.int32)
            for i in range(5):
                np.cumsum(table[i][data], out=sums[i, 1:])
            counts = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
            hashes, at = wh.words(data, offsets)
            n_words = np.maximum(1, np.diff(at))
            distinct, repeat, odds = np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
            for i in range(hi - lo):
                own = hashes[at[i] : at[i + 1]]
                if len(own):
                    distinct[i] = len(np.unique(own)) / len(own) ** 0.75
                    repeat[i] = (own[1:] == own[:-1]).sum() / len(own)
                    odds[i] = weights[grams(own)].mean()
            shares = np.stack([*(counts / sizes), np.minimum(1, distinct / 3), np.minimum(1, sizes / n_words / 30), repeat, 0.5 + odds / 4])
            shares[[1, 3]] = np.sqrt(shares[[1, 3]])
            bins.append(np.minimum(BINS - 1, (np.clip(shares, 0, 1) * BINS).astype(np.int32)).T)
        flat = np.concatenate(bins) if bins else np.zeros((0, len(FEATURES)), np.int32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel(), pa.int32()), len(FEATURES)).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "bins"])


def shapes(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, host, path, bins`` of ``docs(doc_id, host, path, text)``; weights of gram_weights()."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers
    return docs.select("doc_id", "host", "path", "text").mapInArrow(_shape(sent), "doc_id long, host string, path string, bins array<int>")


def learn(shaped: DataFrame, labels: DataFrame) -> DataFrame:
    """``feature, bin, weight``: log-odds of good documents in each bin, at most BINS times the number of features rows.

    ``labels(doc_id, good, half)``; documents of the half that gave the weights of grams
    say nothing of how reliable these are.
    """
    known = shaped.join(labels, "doc_id").select("good", "half", F.posexplode("bins").alias("feature", "bin"))
    known = known.where((F.col("feature") != FEATURES.index("grams")) | ~F.col("half"))
    counts = known.groupBy("feature", "bin").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    whole = counts.groupBy("feature").agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
    return counts.join(whole, "feature").select(
        "feature", "bin", (F.log((F.col("g") + 0.5) / (F.col("all_g") + 1)) - F.log((F.col("b") + 0.5) / (F.col("all_b") + 1))).alias("weight")
    )


def _strength(children: DataFrame, by: str) -> DataFrame:
    """A prior's strength for each ``by``, by moments of its children's rates ``good / n``."""
    sums = children.groupBy(by).agg(F.count("*").alias("k"), F.sum("n").alias("n1"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum("good").alias("g1"), F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("g2"))
    p, n1 = F.col("g1") / F.col("n1"), F.col("n1")
    between = (F.col("g2") - n1 * p * p - (F.col("k") - 1) * p * (1 - p)) / (n1 - F.col("n2") / n1)
    return sums.select(by, F.when((n1 - F.col("n2") / n1 > 0) & (between > 0), F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), p * (1 - p) / between - 1))).otherwise(F.lit(STRONGEST)).alias("strength"))


def sites(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, path, mean, strength, good, n, rate``: a section's prior, counts and posterior mean of good documents, from grouped sums."""
    seen = (
        docs.select("doc_id", "host", "path").join(labels, "doc_id", "left").groupBy("host", "path")
        .agg(F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.count("good").alias("n"))
    ).withColumn("one", F.lit(0))
    known = seen.where("n > 0")
    top = seen.groupBy("one").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    by_host = known.groupBy("one", "host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    top = top.join(_strength(by_host, "one"), "one", "left").select("one", "mean", F.coalesce("strength", F.lit(WEAKEST)).alias("strength"))
    host = seen.groupBy("one", "host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).join(top, "one")
    shrunk = (F.col("mean") * F.col("strength") + F.col("good")) / (F.col("strength") + F.col("n"))
    host = host.select("host", shrunk.alias("mean")).join(_strength(known, "host"), "host", "left").select(F.col("host").alias("_host"), "mean", F.coalesce("strength", F.lit(WEAKEST)).alias("strength"))
    return seen.join(host, F.col("host") == F.col("_host")).select("host", "path", "mean", "strength", "good", "n", shrunk.alias("rate"))


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``doc_id, host, path, evidence, rate, score, keep`` for every row of ``docs(doc_id, host, path, text)``.

    ``labels(doc_id, good 0/1)``: rows with a null or another value are left out, of
    several for one id the lowest counts. Evidence is learnt from SAMPLE labelled documents
    at most, rates from all. A null host or path is its own (named empty); a null or empty
    text has the evidence of an empty text; without labels all evidence is 0 and all
    rates are one half. Repeated rows are scored alike; other columns are ignored.
    """
    labels = labels.where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").cast("long").alias("good"))
    own = docs.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "text")
    sample = durable(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("half", F.xxhash64(F.lit("half"), "doc_id") % 2 == 0))
    seen = own.join(F.broadcast(sample), "doc_id")  # SAMPLE rows of three numbers at most
    words = gram_weights(seen.where("half"))
    weights = {(r.feature, r.bin): r.weight for r in learn(shapes(seen, words), sample).collect()}  # BINS times the features at most
    table = F.array(*[F.array(*[F.lit(float(weights.get((f, b), 0.0))) for b in range(BINS)]) for f in range(len(FEATURES))])
    evidence = F.aggregate(F.zip_with(table, "bins", lambda row, b: row[b]), F.lit(0.0), lambda a, x: a + x)
    without = (F.col("mean") * F.col("strength") + F.col("good") - F.coalesce("own", F.lit(0))) / (F.col("strength") + F.col("n") - F.when(F.col("own").isNull(), 0).otherwise(1))
    scored = shapes(own, words).withColumn("evidence", evidence).drop("bins").join(labels.withColumnRenamed("good", "own"), "doc_id", "left")
    return (
        scored.join(sites(own, labels), ["host", "path"]).withColumn("rate", without)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("rate") / (1 - F.col("rate")))))))
        .select("doc_id", "host", "path", "evidence", "rate", "score", (F.col("score") >= limit).alias("keep"))
    )
