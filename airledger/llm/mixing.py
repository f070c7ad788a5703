"""Operator 6: mixing sources to target weights by Poisson replication, in DataFrame functions.

A source's mean repetition rate is its target share of the output over its rows. Each
row draws a number in [0, 1) from a hash of the seed and the row, and a Poisson
distribution with that mean is inverted at it: the row occurs as often as cumulative
probabilities lie at or below the number. Rows are exploded by their count and dealt
out and ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

#: Up to so many sources their rates are broadcast (their names and cumulative probabilities, a few hundred bytes each); more are joined.
FEW_SOURCES = 10_000


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, temper: float, factor: float) -> DataFrame:
    """``source, n, rate, cdf``: rows, mean repetitions and cumulative probabilities of each source.

    Weights not given are ``n ** temper``; given ones hold for the named sources alone,
    others count for nothing. The output has about ``factor`` times the rows.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        table = docs.sparkSession.createDataFrame(sorted(weights.items()), "source string, weight double")
        wanted = counts.join(table, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = wanted.groupBy(F.lit(0).alias("one")).agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    share = wanted.withColumn("one", F.lit(0)).join(whole, "one").withColumn(
        "rate", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_n") * factor / F.col("n")).otherwise(0.0)
    )
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = F.transform(F.sequence(F.lit(0), last), lambda j: F.exp(-F.col("rate") + j * F.log("rate") - _log_factorial(j)))
    start = F.array().cast("array<double>")
    cdf = F.aggregate(terms, start, lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + p)))
    return share.select("source", "n", "rate", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def _log_factorial(j: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, factor: float = 1.0, seed: str = "mix", parts: int | None = None) -> DataFrame:
    """All columns of the drawn rows and ``copy`` (from 1), in a random order over random partitions.

    A null source is a source of its own. Rows of one doc_id and source draw the same
    number; a null doc_id draws by its text. Repeated rows are each repeated. An empty
    table, or weights that name no present source, give no rows. If the table has a
    column ``copy`` it is kept and the number's name gets an underscore more. Texts are
    shuffled once, unless there are more than FEW_SOURCES sources.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = {c: fresh(docs, c) for c in ("copy", "_mix_source", "_mix_cdf", "_mix_drawn", "_mix_times", "_mix_order")}
    source, cdf, drawn, times, order, copy = (name[c] for c in ("_mix_source", "_mix_cdf", "_mix_drawn", "_mix_times", "_mix_order", "copy"))
    by_source = durable(rates(docs, weights, temper, factor).select(F.col("source").alias(source), F.col("cdf").alias(cdf)))
    if by_source.count() <= FEW_SOURCES:
        by_source = F.broadcast(by_source)
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    out = (
        docs.join(by_source, F.col("source").eqNullSafe(F.col(source)))
        .withColumn(drawn, unit(F.lit(seed), who, F.coalesce("source", F.lit(""))))
        .withColumn(times, F.size(F.filter(cdf, lambda c: c <= F.col(drawn))))
        .where(F.col(times) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
        .withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), who, F.coalesce("source", F.lit("")), F.col(copy).cast("string")).cast("binary")))
    )
    return out.repartition(parts, order).sortWithinPartitions(order).select(*docs.columns, copy)
