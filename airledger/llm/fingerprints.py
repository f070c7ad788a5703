"""Operator 7: document fingerprints by content-defined chunking.

A gear hash (each step doubles the hash and adds a value of the byte) runs over the
UTF-8 bytes; a boundary is where its masked bits are zero. Normalised chunking asks
for more zero bits before the usual length and for fewer after it, so lengths gather
there. A fingerprint is the list of chunk digests with their lengths; boundaries move
with the text, so an insertion changes the chunks around it alone. A text is contained
in another by the length of the chunks that are shared, over the length of all its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk: least, usual, most.
LEAST, USUAL, MOST = 12, 32, 96
#: Bits that must be zero before and after the usual length.
STRICT_BITS, LOOSE_BITS = 6, 4
#: Bytes hashed at once.
PART = 1 << 20


def gear() -> np.ndarray:
    """A value for each byte, from a rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x.astype(np.uint32)


def hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte; as it has 32 bits, the last 32 bytes decide it. Doubled five times."""
    h = table[data]
    step = 1
    while step < 32:
        moved = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += moved
        step *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    raw, table = np.frombuffer(data, np.uint8), gear()
    strict, loose = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS)), np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))
    strict_at, loose_at = [], []
    for lo in range(0, len(raw), PART):
        before = min(lo, 31)
        h = hashes(raw[lo - before : lo + PART], table)[before:]
        hit = np.flatnonzero((h & loose) == 0)
        loose_at.append(hit + lo + 1)
        strict_at.append(hit[(h[hit] & strict) == 0] + lo + 1)
    rare = np.concatenate(strict_at).tolist() if strict_at else []
    often = np.concatenate(loose_at).tolist() if loose_at else []
    ends, start, i, j, n = [], 0, 0, 0, len(raw)
    while start < n:
        while i < len(rare) and rare[i] < start + LEAST:
            i += 1
        if i < len(rare) and rare[i] <= start + USUAL:
            end = rare[i]
        else:
            while j < len(often) and often[j] <= start + USUAL:
                j += 1
            end = min(often[j] if j < len(often) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def chunks(text: str) -> Counter:
    """(digest, length) of each chunk, with its count."""
    data, start, out = text.encode("utf-8", "surrogatepass"), 0, []
    for end in boundaries(data):
        out.append((xxhash.xxh3_64_intdigest(data[start:end]), end - start))
        start = end
    return Counter(out)


def written(own: Counter) -> str:
    """``digest:length`` or ``digest:length*count``, by digest, comma-joined."""
    return ",".join(f"{d:016x}:{n}" + (f"*{c}" if c > 1 else "") for (d, n), c in sorted(own.items()))


def likeness(a: Counter, b: Counter) -> float:
    """The smaller of the two containments, of a in b and of b in a."""
    return min(containment(a, b), containment(b, a))


def containment(a: Counter, b: Counter) -> float:
    """The share of a's bytes that lie in chunks which b has as well. An empty text is contained in any."""
    whole = sum(n * c for (_, n), c in a.items())
    return sum(min(c, b[k]) * k[1] for k, c in a.items() if k in b) / whole if whole else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the first characters, as many, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint(docs: DataFrame) -> DataFrame:
    """The same rows' ``doc_id`` and ``fingerprint``; a null text counts as empty and has an empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["fingerprint"] = [written(chunks(t or "")) for t in pdf.pop("text")]
            yield pdf

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


def _numbers(values: list[int | None]) -> Column:
    """A constant array of whole numbers, as one literal whatever its length."""
    return F.transform(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ","), lambda x: x.try_cast("long"))


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at or below the value: counted among every step-th one first, and then within the step."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda those: F.size(F.filter(those, lambda c: c <= value))
    heads = below(_numbers(cuts[::step]))
    inside = F.slice(_numbers(cuts), F.greatest(heads - 1, F.lit(0)) * step + 1, step)
    return F.when(heads > 0, (heads - 1) * step + below(inside)).otherwise(0)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, text, part, guest`` dealt so that every row stands before its follower, in one shuffle of the texts.

    Rows are dealt by ranges of doc_id. The first row of each range is also a guest
    of the range before it (of the last range for the first one), so that no range
    has to look into another. Only the ends of ranges, as many as partitions, and the
    first id of each meet on the driver. A null id comes first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    low = ids.agg(F.min("doc_id")).first()[0]
    cuts = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if low is not None and parts > 1 else []
    cuts = sorted({int(c) for c in cuts if c > low})
    part = F.coalesce(_place(cuts, F.col("doc_id")), F.lit(0))
    firsts = {r.part: r.first for r in ids.groupBy(part.alias("part")).agg(F.when(F.count("*") > F.count("doc_id"), None).otherwise(F.min("doc_id")).alias("first")).collect()}
    used = sorted(firsts)
    before = {p: used[at - 1] for at, p in enumerate(used)}
    every = range(len(cuts) + 1)
    host = F.when(F.col("doc_id").eqNullSafe(F.get(_numbers([firsts.get(p) for p in every]), part)), F.get(_numbers([before.get(p) for p in every]), part)).cast("int")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"), host.alias("host"))
    spread = own.withColumn(
        "to",
        F.explode(F.when(F.col("host").isNull(), F.array(F.struct("part", F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))))),
    ).select("doc_id", "text", "to.part", "to.guest")
    return (
        spread.repartitionById(max(len(cuts) + 1, 1), F.col("part").cast("int"))
        .sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")
    )


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("contained_edited", pa.float64()), ("contained_next", pa.float64()),
])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    last = None

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT, strict=True)], schema=OUT)
        rows.clear()
        return out

    for batch in batches:
        for doc, text, part, guest in zip(*(batch.column(i) for i in range(4)), strict=True):
            doc, text, part, guest = doc.as_py(), text.as_py(), part.as_py(), guest.as_py()
            if last is not None and last[0] != part:
                last = None
            if guest and last is None:
                continue
            own = chunks(text)
            if last is not None:
                before, before_chunks = last[2], last[3]
                changed = edited(before, text)
                other = chunks(changed)
                rows.append((last[1], len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(before_chunks), written(other), likeness(before_chunks, other), likeness(before_chunks, own), containment(before_chunks, other), containment(before_chunks, own)))
                size += len(before)
                if size > 4_000_000:
                    size = 0
                    yield batch_of()
            last = None if guest else (part, doc, text, own)
    if rows:
        yield batch_of()


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, how alike they are, and how much of the text is contained in the edited and in the next one.

    The next document is the one with the next doc_id (ties by text; after the last
    one the first). A null text is empty; repeated rows follow each other; a single
    row follows itself; an empty table gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    return with_next(docs, parts).mapInArrow(_compare, schema)
