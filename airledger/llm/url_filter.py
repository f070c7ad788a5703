"""Operator 8: URL rules and empirical-Bayes host reputation, in DataFrame functions.

Fixed rules come first, the longest that fits decides. Otherwise labelled page
outcomes are pooled: the rate of bad pages of a suffix is shrunk towards that of all
pages, a registered domain's towards its suffix, and a host's towards its domain, each
through a beta prior whose strength is fitted to the spread among the children (by
moments). A page is blocked when the lower bound of its host's posterior lies above
the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the strength of a prior, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, rest).otherwise(F.lit(""))


def parts_of(pages: DataFrame) -> DataFrame:
    """Adds ``host, path, domain, suffix``: the last two labels of the host, and its last."""
    return (
        pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    )


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else nulls; first listed of equal length."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _level(below: DataFrame, key: list[str], prior: DataFrame, on: str) -> DataFrame:
    """Posterior (a, b) of each ``key`` from ``bad`` and ``n``, shrunk towards ``prior(mean, strength)`` by ``on``."""
    own = below.groupBy(*key).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    return own.join(prior, on).withColumn("a", F.col("mean") * F.col("strength") + F.col("bad")).withColumn("b", (1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("bad"))


def _strength(children: DataFrame, by: str) -> DataFrame:
    """By moments among the children: what a rate varies beyond chance says how strong the prior is."""
    return children.groupBy(by).agg(F.count("*").alias("k"), F.sum("n").alias("n1"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum("bad").alias("bad1"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("b2")).withColumn(
        "p", F.col("bad1") / F.col("n1")
    ).withColumn("ss", F.col("b2") - F.col("n1") * F.col("p") * F.col("p")).withColumn(
        "scale", F.col("n1") - F.col("n2") / F.col("n1")
    ).withColumn(
        "between", F.when(F.col("scale") > 0, (F.col("ss") - (F.col("k") - 1) * F.col("p") * (1 - F.col("p"))) / F.col("scale"))
    ).withColumn(
        "strength",
        F.when(F.col("between") > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.col("p") * (1 - F.col("p")) / F.col("between") - 1))).otherwise(F.lit(STRONGEST)),
    ).select(by, "strength")


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, mean, low``: posterior rate of bad pages and its lower bound (two standard deviations) of each host.

    ``outcomes(page_id, bad 0/1)``: a page may have several; nulls count for nothing.
    The levels are grouped sums; hosts without an outcome take their domain's, then
    suffix's, then all pages' prior. Without any outcome the rate is one half with the
    weakest prior, so nothing is blocked.
    """
    hosts = pages.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages"))
    seen = (
        pages.select("page_id", "host", "domain", "suffix").join(outcomes.where("bad is not null").select("page_id", F.col("bad").cast("long").alias("bad")), "page_id")
        .groupBy("host", "domain", "suffix").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    )
    counts = hosts.join(seen, ["host", "domain", "suffix"], "left").select(F.lit(0).alias("root"), "host", "domain", "suffix", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("n", F.lit(0)).alias("n"))
    known = counts.where("n > 0")
    sum_by = lambda *k: known.groupBy(*k).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = counts.groupBy("root").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean"))
    top = whole.join(_strength(sum_by("root", "suffix"), "root"), "root", "left")
    top = top.select("root", "mean", F.coalesce("strength", F.lit(WEAKEST)).alias("strength"))
    suffix = _level(counts, ["root", "suffix"], top, "root")
    prior = suffix.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")).join(_strength(sum_by("suffix", "domain"), "suffix"), "suffix", "left")
    prior = prior.select("suffix", "mean", F.coalesce("strength", F.lit(WEAKEST)).alias("strength"))
    domain = _level(counts, ["suffix", "domain"], prior, "suffix")
    prior = domain.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")).join(_strength(known, "domain"), "domain", "left")
    prior = prior.select("domain", "mean", F.coalesce("strength", F.lit(WEAKEST)).alias("strength"))
    host = _level(counts, ["domain", "host"], prior, "domain")
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    return host.select("host", mean.alias("rate"), (mean - 2 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, low`` for every page.

    A null url, or one without ``://``, has an empty host and path. Repeated pages
    are judged alike; pages and hosts of any number are joined by host, a hot host is
    split by the engine since each has one reputation row. Extra columns are ignored.
    """
    own = parts_of(pages.select("page_id", "url"))
    fame = reputation(own, outcomes)
    rule, verdict = rule_of(rules)
    return (
        own.join(fame, "host", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("low") > limit, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "rate", "low")
    )
