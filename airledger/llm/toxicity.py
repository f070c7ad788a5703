"""Operator 9: toxicity by a weighted finite-state pattern grammar.

The lexicon transducer turns a word into a symbol and a weight: the largest weight of
its known stems and forms, which are learnt from labels as log-odds (fixed ones serve
where there are none). Five small machines read the symbols of a clause and are composed
into one transition table, whose states are tuples of theirs:

* insults: a word with a weight;
* threats: a verb of harm followed by a target within a few words;
* targets: pronouns and nouns for people;
* negation: a negator within a few words before a hit;
* reported speech: a verb of saying, or a quotation mark, before a hit, or a verb of
  saying within a few words after it.

A clause ends at punctuation or a line end and yields its kinds of match with their
weights. Each kind has a factor, learnt from labels by shrinking the share of toxic
documents among those with such a clause towards a prior factor. A document's score
is a logistic function of the sum over its matched clauses. Labels are learnt from a
bounded sample; every document is scored in full.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import durable

#: Labelled documents of each class that are read for learning, at most.
SAMPLE = 4000
#: Words that a task remembers the reading of.
KNOWN = 100_000
#: Likelihood ratio statistic that a form or stem must reach, the share of the toxic documents that must have it at least, of the others at most, and how many witnesses halve the shrinking of its weight.
STANDOUT, TOXIC_SHARE, OTHER_SHARE, FEW_WITNESSES = 12.0, 0.01, 0.002, 4.0
#: Word lists of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
HARM = ("kill", "hurt", "destroy", "beat", "burn", "crush", "töte", "töten", "schlagen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "him", "her", "they", "them", "people", "du", "dich", "ihr", "euch", "er", "sie", "tu", "te", "vous", "toi", "il", "elle", "ils", "usted", "ustedes", "ellos")
NEGATORS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "ne", "nunca", "jamás")
SAYING = ("said", "says", "say", "wrote", "writes", "called", "quoted", "sagte", "sagt", "schrieb", "dit", "disait", "écrit", "dijo", "dice", "escribió")
#: Words between a negator and a hit, or a verb of harm and its target, at most.
REACH = 3
#: Factors of the kinds of match before any label is seen; KAPPA documents' worth.
FACTORS = {"insult": 1.0, "insult+target": 1.2, "threat": 1.2, "insult-negated": 0.4, "insult-reported": 0.5}
KAPPA = 5.0
#: A fixed insult's weight, the largest weight, and the weight of a threat.
FIXED, LARGEST, THREAT = 3.0, 6.0, 3.0
#: Logistic function: at no match, and for each unit of weight.
BIAS, SLOPE = -2.2, 0.6
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.,;:!?\n\"“”«»„]")
STOPS = frozenset(".,;:!?\n")
QUOTES = frozenset("\"“”«»„")


def features(word: str) -> list[str]:
    """A word's form and its stems: beginnings of 4 to 6 letters, marked."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


#: Symbols: what a word is to the machines, besides having a weight.
OTHER, HARMS, TARGET, NEGATES, SAYS, STOP, QUOTE = range(7)


def insult(hit: bool, weighted: bool, symbol: int) -> bool:
    return hit or weighted


def target(met: bool, weighted: bool, symbol: int) -> bool:
    return met or symbol == TARGET


def threat(since: int, weighted: bool, symbol: int) -> int:
    """Words since a verb of harm, REACH + 1 at most; -1 once a target followed in time."""
    if since < 0:
        return since
    since = min(since + 1, REACH + 1)
    return 0 if symbol == HARMS else -1 if symbol == TARGET and since <= REACH else since


def negation(state: tuple[int, int], weighted: bool, symbol: int) -> tuple[int, int]:
    """(words since a negator, whether all hits were negated: -1 before the first)."""
    since, negated = min(state[0] + 1, REACH + 1), state[1]
    if weighted:
        negated = int(since <= REACH and negated != 0)
    return 0 if symbol == NEGATES else since, negated


def report(state: tuple[int, bool], weighted: bool, symbol: int) -> tuple[int, bool]:
    """(words since the last hit, REACH + 1 at most, -1 before the first; whether speech is reported)."""
    since, reported = state
    since = 0 if weighted else since if since < 0 else min(since + 1, REACH + 1)
    if since < 0:
        reported = reported or symbol in (SAYS, QUOTE)
    elif not weighted:
        reported = reported or symbol == SAYS and since <= REACH
    return since, reported


#: (machine, its first state)
MACHINES = ((insult, False), (target, False), (threat, REACH + 1), (negation, (REACH + 1, -1)), (report, (-1, False)))


def outputs(state: tuple) -> tuple[str, ...]:
    """The kinds of match of a clause that ends in a composed state."""
    hit, target, since_harm, (_, negated), (_, reported) = state
    kind = "insult-negated" if negated == 1 else "insult-reported" if reported else "insult+target" if target else "insult"
    return (kind,) * hit + ("threat",) * (since_harm < 0)


@cache
def composed(machines=MACHINES) -> tuple[list[int], list[tuple[str, ...]], list[tuple]]:
    """(next state at ``state * 14 + 2 * symbol + weighted``, outputs of each state, the states): the product of the machines, as far as it is reached."""
    states = [tuple(start for _, start in machines)]
    number, table = {states[0]: 0}, []
    for state in states:  # it grows
        for symbol in range(7):
            for weighted in (False, True):
                after = tuple(step(own, weighted, symbol) for (step, _), own in zip(machines, state))
                if after not in number:
                    number[after] = len(states)
                    states.append(after)
                table.append(number[after])
    return table, [outputs(s) for s in states], states


class Grammar:
    """The lexicon transducer and the composed machines. lexicon: form or stem -> weight; factors: kind of match -> factor."""

    def __init__(self, lexicon: dict[str, float], factors: dict[str, float]) -> None:
        self.lexicon, self.factors = lexicon, factors
        self.known: dict[str, tuple[float, int]] = {}
        self.hits: set[tuple[float, int]] = set()  # what read() says of insults and verbs of harm
        self.symbols = {w: k for k, words in ((QUOTE, QUOTES), (STOP, STOPS), (SAYS, SAYING), (NEGATES, NEGATORS), (TARGET, TARGETS), (HARMS, HARM)) for w in words}
        self.table, self.outputs, _ = composed()

    def read(self, word: str) -> tuple[float, int]:
        """The lexicon transducer: (weight of an insult or 0, 2 * symbol + whether it has a weight)."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
            symbol = self.symbols.get(word, OTHER)
            got = self.known[word] = weight, 2 * symbol + (weight > 0)
            if weight > 0 or symbol == HARMS:
                self.hits.add(got)
        return got

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """(kind of match, weight) of each matched clause of the text."""
        words = WORD.findall(text.lower())
        once, hits = set(words), self.hits
        if not any([self.read(w) in hits for w in once]):
            return []
        out: list[tuple[str, float]] = []
        table, read, state, hit = self.table, self.read, 0, 0.0
        for w in [*words, "."]:
            weight, place = read(w)
            if place >> 1 == STOP:
                out += [(kind, THREAT if kind == "threat" else hit) for kind in self.outputs[state]]
                state, hit = 0, 0.0
            else:
                state = table[14 * state + place]
                hit += weight
        return out

    def score(self, text: str | None) -> float:
        total = sum(w * self.factors.get(k, 1.0) for k, w in self.clauses(text or ""))
        return 1 / (1 + exp(-min(30.0, BIAS + SLOPE * total)))


def sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Up to ``size`` labelled documents of each class, by a hash of the id; those with both labels or none are left out."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    by_hash = lambda x: rows.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return by_hash(1).unionByName(by_hash(0))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes of the five-word shingles of each text; near copies share most of them."""
    for batch in batches:
        for lo, hi, data, offsets in wh.chunks(batch.column(1)):
            hashes, at = wh.words(data, offsets)
            least = np.zeros((3, hi - lo), np.int64)
            for i in range(hi - lo):
                own = wh.shingles(hashes[at[i] : at[i + 1]], 5)
                for k in range(3 if len(own) else 0):
                    least[k, i] = wh.mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))).min().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, least)], names=["doc_id", "s0", "s1", "s2"])


def without_copies(own: DataFrame) -> DataFrame:
    """``doc_id`` of the sampled documents, one of those that share a signature: copies would count as many witnesses."""
    out = own.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, s0 long, s1 long, s2 long")
    for k in ("s0", "s1", "s2"):
        out = out.groupBy(k).agg(F.min(F.struct("doc_id", "s0", "s1", "s2")).alias("x")).select("x.*")
    return out.select("doc_id")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each task: in how many toxic and other documents each form and stem occurs."""
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for pdf in batches:
        for text, toxic in zip(pdf.text, pdf.toxic):
            found = {f for w in set(WORD.findall((text or "").lower())) if w not in STOPS and w not in QUOTES for f in features(w)}
            seen[int(toxic)].update(found)
            seen[int(toxic)][""] += 1
    keys = list(seen[0].keys() | seen[1].keys())
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        yield pd.DataFrame({"feature": part, "toxic": [seen[1][k] for k in part], "other": [seen[0][k] for k in part]})


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    """(lexicon, factors) from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A form or stem is kept if its toxic documents stand out (the likelihood ratio
    statistic is at least STANDOUT), at least TOXIC_SHARE of them have it (and three of them)
    and hardly any other document (OTHER_SHARE). Its weight is shrunk if few documents
    witness it. Near copies count once. All of this is decided in Spark; what reaches the
    driver is bounded by the words of the sample over the least number of witnesses. Without
    labelled toxic documents the fixed insults and factors are returned, which otherwise
    serve for nothing.
    Null texts have no words; labels of other values, or without an id or a text, count
    for nothing; of repeated rows one counts; other columns are ignored.
    """
    picked = F.broadcast(sample(labels, size))  # 2 * size rows of two numbers at most
    own = docs.select("doc_id", "text").join(picked, "doc_id")
    once = durable(without_copies(own).join(picked, "doc_id"))
    own = docs.select("doc_id", "text").join(F.broadcast(once), "doc_id").select("text", "toxic")
    counts = own.mapInPandas(_counts, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    counts = durable(counts)
    whole = counts.where("feature = ''").select("a", "b").first()
    if whole is None or not whole.a:
        return dict.fromkeys(INSULTS, FIXED), dict(FACTORS)
    rows = standouts(counts.where("feature <> ''"), whole.a, whole.b).collect()
    lexicon = {}
    for r in rows:
        weight = log((r.a + 0.5) / (whole.a + 1)) - log((r.b + 0.5) / (whole.b + 1))
        lexicon[r.feature] = min(LARGEST, weight * r.a / (r.a + FEW_WITNESSES))
    return lexicon, _factors(own, lexicon)


def standouts(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """Of ``counts(feature, a, b)``, documents of either kind that have a feature, those that a lexicon keeps."""
    a, b, both = F.col("a"), F.col("b"), float(toxic + other)
    part = lambda k, t: F.when(k > 0, k * F.log(k * both / ((a + b) * float(max(t, 1))))).otherwise(0.0)
    least = max(3.0, TOXIC_SHARE * toxic)
    return counts.where((a >= least) & (a > b) & (b <= OTHER_SHARE * other) & (2 * (part(a, toxic) + part(b, other)) >= STANDOUT))


def _factors(own: DataFrame, lexicon: dict[str, float]) -> dict[str, float]:
    """For each kind of match, the prior factor moved towards the share of toxic documents among those that have it."""

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon, FACTORS)
        for pdf in batches:
            rows = [(k, int(t)) for text, t in zip(pdf.text, pdf.toxic) for k in {k for k, _ in grammar.clauses(text or "")}]
            yield pd.DataFrame(rows, columns=["kind", "toxic"]).groupby("kind", as_index=False).toxic.agg(["sum", "size"]).rename(columns={"sum": "a", "size": "n"})[["kind", "a", "n"]]

    seen = own.mapInPandas(kinds, "kind string, a long, n long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect()
    out = dict(FACTORS)
    for r in seen:
        out[r.kind] = (KAPPA * FACTORS[r.kind] + r.a) / (KAPPA + r.n)
    return out


def score(docs: DataFrame, lexicon: dict[str, float], factors: dict[str, float], into: str = "score") -> DataFrame:
    """All columns of every row and ``into`` (0 to 1).

    A null or empty text has no match and the lowest score. Repeated rows are scored
    alike; rows and columns are kept as they are (a column named as ``into`` is
    replaced: see common.fresh() for a name that none has); an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast((lexicon, factors))  # as many as learn() takes from a bounded sample

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(*model.value)
        for texts in batches:
            yield texts.map(grammar.score).astype("float64")

    return docs.withColumn(into, scored(F.col("text")))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_column(column):
    return F.crc32(column.cast("string").cast("binary")) % 3 == 1
