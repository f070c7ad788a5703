"""Operator 1: n-gram Jaccard join by parity sketches.

Every document becomes its set of word shingles; equal sets form one class. A class
of ``n`` shingles falls into a size band, and a partner at least as large may reach
past the band, so it is also sketched for the band below. In a band two sets that
link differ in at most ``d`` shingles. Each shingle flips one bit of a sketch of
``2 d + 1`` words of 64 bits, so sketches differ in at most as many bits as the sets
differ in shingles, and by the pigeonhole principle more than half of the words agree.

Sets are joined by their first PICKED words that are not empty. Small sets have no more
than that, and a pair that links surely shares one; a small set with more than ``d``
empty words is also joined by its single shingles. Of large sets' words each is untouched
by ``d`` differences with a chance of exp(-1/2), so of those picked a linked pair shares
more than SPARE but for a chance below 1e-13. That many, the most frequent of the keys
that a class shares, may therefore be left out (prefix filtering), and words that hold
nothing but common passages seldom meet. Whoever meets is compared inside the task by a
second, smaller parity sketch of the whole set, whose Hamming distance is a lower bound
of the difference as well, and only pairs that pass are emitted and verified on the whole
sets. So no wrong link is given and none is lost, but for collisions of 64-bit hashes and
the chance above.

Near copies meet in most of their keys, so the join goes in rounds. The first looks at
one key in SAMPLED; of a key with many members a hub is compared with all others there.
What this links lies in one component, and the second round, over all keys, emits pairs
of different components only. Keys with more than BLOCK members which then still lie in
several components are compared last, in blocks of bounded size. Exact copies never
multiply, since classes and not documents are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import components, durable, release, shuffle_width, written

#: Ratio of a band's ends.
BAND_RATIO = 1.6
#: Words of a sketch by which a set is joined, at most, and how many of those shared may be left out.
PICKED, SPARE = 64, 8
#: Bits of the small sketch for each shingle.
SMALL_BITS = 0.6
#: The first round looks at one key in so many.
SAMPLED = 8
#: There up to so many members of a key are all compared with each other; of more, a hub is.
FEW = 16
#: Later up to so many are compared at once, more in blocks of this size.
BLOCK = 256
#: Members of a large key that a task holds at once.
HELD = 16_384
#: Shares of the keys that are dealt one after the other, so that less has to be on disk at once.
SHARES = 2
#: 64-bit words of small sketches that are compared at once.
AT_ONCE = 1 << 18
#: Pairs that a task remembers so as not to emit them again, at most.
REMEMBERED = 200_000
#: 64-bit words of the largest filter that tells which texts are needed for verification.
FILTER_WORDS = 1 << 19
KEY_BITS = (1 << 52) - 1
U = np.uint64


@cache
def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, most differing shingles) of the bands in which a set of this size is sketched."""
    if size < 1:
        return []
    out = [band_of(size)]
    while out[-1] and band_end(out[-1] - 1) * den // num >= size:  # as the larger partner of a set of the band below
        out.append(out[-1] - 1)
    return [(k, d) for k in out for d in [differ(band_end(k), num, den)] if d > 0]


def band_end(k: int) -> int:
    return ceil(4 * BAND_RATIO ** (k + 1)) - 1


def band_of(size: int) -> int:
    k = 0
    while band_end(k) < size:
        k += 1
    return k


def differ(small: int, num: int, den: int) -> int:
    """The most by which two linked sets differ, the smaller having ``small`` elements."""
    union = small * den // num
    return union * (den - num) // den


def sketch(own: np.ndarray, flips: np.ndarray, size: int, first: int | None = None) -> np.ndarray:
    """Parity words (the first ones only): the top bits of a hash choose the word (own is sorted), six bits of another (flips) the bit."""
    first = size if first is None else min(first, size)
    place = ((own >> U(32)) * U(size)) >> U(32)
    at = np.searchsorted(place, np.arange(first + 1, dtype=U))
    flip = U(1) << (flips[: at[-1]] & U(63))
    out = np.zeros(first, U)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.bitwise_xor.reduceat(flip, at[full])
    return out


def small_sketch(other: np.ndarray, band: int) -> np.ndarray:
    """One parity sketch of the whole set, of as many bits as the band asks for, as 64-bit words. other: other_hash() of the set."""
    bits = 64 * ceil(SMALL_BITS * band_end(band) / 64)
    place = ((other >> U(32)) * U(bits)) >> U(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def other_hash(own: np.ndarray) -> np.ndarray:
    return wh.mix(own ^ U(0x2545F4914F6CDD1D))


@cache
def salts(band: int) -> np.ndarray:
    """A number for each of the first words of a band's sketches."""
    return wh.mix(np.arange(8 * PICKED, dtype=U) + U((band + 1) << 32))


def keys_of(own: np.ndarray, flips: np.ndarray, band: int, d: int) -> tuple[np.ndarray, int]:
    """The keys by which a set is joined in a band, and how many of the shared ones may be left out."""
    size = 2 * d + 1
    words = sketch(own, flips, size, 8 * PICKED)  # at least one in two is full, so these are enough
    full = np.flatnonzero(words)[:PICKED]
    keys = wh.mix(words[full] ^ salts(band)[full])
    if len(full) == PICKED:
        return keys & U(KEY_BITS), SPARE
    spare = d - (size - len(full))
    if spare < 0:
        keys = np.append(keys, wh.mix(own + U(band)))
    return keys & U(KEY_BITS), min(SPARE, max(0, spare))


def classes(flat: np.ndarray, flips: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name for each of the sets that are joined in flat (0 for the empty set)."""
    size = np.diff(begin)
    out = np.zeros(len(size), U)
    full = size > 0
    if full.any():
        at = begin[:-1][full]
        both = wh.mix(np.bitwise_xor.reduceat(flat * U(0xD6E8FEB86659FD93), at) + size[full].astype(U))
        out[full] = wh.mix(np.add.reduceat(flips, at) ^ both)
    return out.view(np.int64)


HASHED = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
    ("band", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64())), ("small", pa.list_(pa.int64())),
])


def _lists(parts: list[np.ndarray], nulls: int) -> pa.Array:
    """So many nulls, and then an array for each part."""
    ends = np.cumsum([0] * (nulls + 1) + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *(p.view(np.int64) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(np.arange(len(ends) - 1) < nulls))


def _hashed(width: int, num: int, den: int):
    """A mapInArrow function over (doc_id, text_hash, text): a row for each text, and one for each band of each set (once in a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in wh.chunks(batch.column(2)):
                flat, begin = wh.shingle_sets(*wh.words(data, offsets), width)
                flips, other = wh.mix(flat), other_hash(flat)
                names = classes(flat, flips, begin)
                size = np.diff(begin)
                rows, keys, small = [], [], []
                for i, (cls, a, b) in enumerate(zip(names.tolist(), begin[:-1].tolist(), begin[1:].tolist())):
                    if cls in done:
                        continue
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(cls)
                    for band, d in bands(b - a, num, den):
                        own, spare = keys_of(flat[a:b], flips[a:b], band, d)
                        rows.append((i, band, spare))
                        keys.append(own)
                        small.append(small_sketch(other[a:b], band))
                n = hi - lo
                of, *others = np.array(rows, np.int64).reshape(-1, 3).T
                texts = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(size), pa.array(names)]
                none = pa.nulls(n, pa.int32())
                parts = [
                    *(pa.concat_arrays([c.cast(pa.int64()), pa.nulls(len(of), pa.int64())]) for c in texts[:2]),
                    pa.array(np.append(size, size[of])), pa.array(np.append(names, names[of])),
                    *(pa.concat_arrays([none, pa.array(x.astype(np.int32))]) for x in others),
                    _lists(keys, n), _lists(small, n),
                ]
                yield pa.RecordBatch.from_arrays(parts, schema=HASHED)

    return run


def _sets(width: int, wanted):
    """A mapInArrow function over (row, text): the whole sets of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            row = batch.column(0).to_numpy().view(U)
            batch = batch.filter(pa.array(_in_filter(bits, row)))
            for lo, hi, data, offsets in wh.chunks(batch.column(1)):
                flat, begin = wh.shingle_sets(*wh.words(data, offsets), width)
                items = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(classes(flat, wh.mix(flat), begin)), items], names=["row", "cls", "items"])

    return run


def _in_filter(bits: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (bits[(row >> U(6)) & U(len(bits) - 1)] >> (row & U(63))) & U(1) == 1


def _passes(num: int, den: int, n: np.ndarray, small: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which pairs of sets, of n and sizes shingles, may link by the bound of their small sketches."""
    gap = np.bitwise_count((small ^ others).view(U)).sum(axis=-1).astype(np.int64)  # of signed numbers it counts the absolute value's bits
    return (n + sizes - gap) * den >= num * (n + sizes + gap)


class Members:
    """Rows (key, cls, comp, n, small) of one width of small sketches."""

    def __init__(self, key: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, small: np.ndarray) -> None:
        self.key, self.cls, self.comp, self.n, self.small = key, cls, comp, n, small

    def __len__(self) -> int:
        return len(self.cls)

    def take(self, at) -> "Members":
        return Members(self.key[at], self.cls[at], self.comp[at], self.n[at], self.small[at])

    def pairs(self, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
        """Of the pairs of rows, those of different components that may link, as (smaller class, larger class)."""
        apart = np.flatnonzero(self.comp[left] != self.comp[right])
        step, found = max(1, AT_ONCE // self.small.shape[1]), [np.zeros(0, np.int64)]
        for lo in range(0, len(apart), step):
            at = apart[lo : lo + step]
            i, j = left[at], right[at]
            found.append(at[_passes(num, den, self.n[i], self.small[i], self.n[j], self.small[j])])
        near = np.concatenate(found)
        a, b = self.cls[left[near]], self.cls[right[near]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _read(batch: pa.RecordBatch | pa.Table) -> list[Members]:
    """The rows of a batch by width; the order is kept."""
    key, cls, comp, n = (batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("key", "cls", "comp", "n"))
    small = batch.column("small")
    width = np.asarray(pc.list_value_length(small))
    flat = np.asarray(pc.list_flatten(small))
    begin = np.cumsum(width) - width
    out = []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out.append(Members(key[at], cls[at], comp[at], n[at], flat[begin[at][:, None] + np.arange(w)]))
    return out


class Pairs:
    """What a task has emitted: pairs, each once as far as it remembers, and keys to be looked at again."""

    def __init__(self) -> None:
        self.seen = np.zeros(0, U)
        self.parts: list[np.ndarray] = []
        self.keys: list[int] = []
        self.waiting = 0

    def add(self, pairs: np.ndarray) -> None:
        if not len(pairs):
            return
        name = wh.mix(pairs[:, 0].view(U)) * U(0x9FB21C651E98DF25) + pairs[:, 1].view(U)
        name, first = np.unique(name, return_index=True)
        at = np.searchsorted(self.seen, name)
        fresh = np.ones(len(name), bool)
        inside = at < len(self.seen)
        fresh[inside] = self.seen[at[inside]] != name[inside]
        if fresh.any():
            self.parts.append(pairs[first[fresh]])
            self.waiting += int(fresh.sum())
            self.seen = np.sort(np.append(self.seen, name[fresh])) if len(self.seen) < REMEMBERED else name[fresh]

    def batch(self) -> pa.RecordBatch:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *self.parts])
        none = pa.nulls(len(self.keys), pa.int64())
        out = pa.RecordBatch.from_arrays(
            [*(pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, i])), none]) for i in (0, 1)), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(self.keys, pa.int64())])],
            names=["a", "b", "key"],
        )
        self.parts, self.keys, self.waiting = [], [], 0
        return out


def _met(num: int, den: int, first: bool):
    """Of rows (key, cls, comp, n, small) sorted by key: pairs of different components that may link.

    In the first round a hub stands for a key with more than FEW members: among 32 of
    the first ones held, the one that may link with most. Later a key with more than
    BLOCK members is only emitted itself, if they lie in several components.
    """
    limit = FEW if first else BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Pairs()
        waiting: dict[int, Members] = {}  # by width: the last key's members so far
        hubs: dict[int, Members] = {}  # by width: the hub of the last key, which is large
        spread: dict[int, int] = {}  # by width: the first component of the last key, which is large

        def large(width: int, own: Members, more: bool) -> None:
            if first:
                if not more:
                    some = np.argsort(own.cls, kind="stable")[:: max(1, len(own) // 32)]
                    all_rows = np.arange(len(own))
                    most = [len(own.pairs(np.full(len(own), i), all_rows, num, den)) for i in some.tolist()]
                    hubs[width] = own.take(some[[int(np.argmax(most))]])
                both = Members(*(np.concatenate([getattr(hubs[width], c), getattr(own, c)]) for c in ("key", "cls", "comp", "n", "small")))
                out.add(both.pairs(np.zeros(len(own), np.int64), np.arange(1, len(both)), num, den))
            else:
                if not more:
                    spread[width] = int(own.comp[0])
                if width in spread and (own.comp != spread[width]).any():
                    out.keys.append(int(own.key[0]))
                    del spread[width]

        def complete(own: Members) -> None:
            """Rows of whole keys, none of them large."""
            ends = np.append(np.flatnonzero(own.key[1:] != own.key[:-1]) + 1, len(own))
            left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(own)) - 1  # members of the key that follow
            at, step = np.flatnonzero(left > 0), 1
            while len(at):
                out.add(own.pairs(at, at + step, num, den))
                step += 1
                at = at[left[at] >= step]

        is_large: dict[int, int] = {}  # by width: the last key, if it is large
        for batch in batches:
            for own in _read(batch):
                width = own.small.shape[1]
                if width in is_large:
                    same = int(np.searchsorted(own.key != is_large[width], True))
                    if same:
                        large(width, own.take(slice(0, same)), True)
                    if same == len(own):
                        continue
                    del is_large[width]
                    own = own.take(slice(same, None))
                elif width in waiting:
                    held = waiting.pop(width)
                    own = Members(*(np.concatenate([getattr(held, c), getattr(own, c)]) for c in ("key", "cls", "comp", "n", "small")))
                starts = np.append(0, np.flatnonzero(own.key[1:] != own.key[:-1]) + 1)
                ends = np.append(starts[1:], len(own))
                size = ends - starts
                many = np.flatnonzero(size > limit)
                for k in many.tolist():
                    if k < len(size) - 1 or size[k] > HELD:
                        large(width, own.take(slice(starts[k], ends[k])), False)
                keep = np.repeat(size <= limit, size)
                keep[starts[-1] :] = False
                complete(own.take(keep))
                if size[-1] > HELD:
                    is_large[width] = int(own.key[-1])
                else:
                    waiting[width] = own.take(slice(starts[-1], None))
            if out.waiting > 50_000:
                yield out.batch()
        for width, own in waiting.items():
            if len(own) > limit:
                large(width, own, False)
            else:
                complete(own)
        yield out.batch()

    return run


def _blocks(num: int, den: int):
    """Of one pair of blocks of one key: pairs of different components that may link."""

    def run(table: pa.Table) -> pa.Table:
        inside = [np.asarray(pc.equal(table.column("block"), table.column(c))) for c in ("bi", "bj")]
        out = Pairs()
        own = _read(table)
        for members in own if len(own) == 1 else []:
            left, right = (np.flatnonzero(x) for x in inside)
            for lo in range(0, len(left), 64):
                part = left[lo : lo + 64]
                out.add(members.pairs(np.repeat(part, len(right)), np.tile(right, len(part)), num, den))
        return pa.Table.from_batches([out.batch()]).select(["a", "b"])

    return run


def row_id(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def hashed(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[], None]]:
    """Three tables, the last of which the function after them deletes.

    ``doc_id, text_hash, n, cls`` of every row; ``cls, band, n, small`` of every class;
    and ``key, cls, band, met``: the keys by which classes are joined.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    both, drop_both = written(own.mapInArrow(_hashed(width, num, den), "doc_id long, text_hash long, n long, cls long, band int, spare int, keys array<long>, small array<long>"))
    rows = durable(both.where("band is null").select("doc_id", "text_hash", "n", "cls"))
    sketches = both.where("band is not null")
    by_class = durable(sketches.groupBy("cls", "band").agg(F.any_value(F.struct(F.col("n").cast("int").alias("n"), "spare", "small")).alias("x")).select("cls", "band", "x.*"))
    keys = sketches.select(F.explode("keys").alias("key"), "cls", "band")
    by_key = Window.partitionBy("key")
    met, drops = [], [drop_both]
    for i in range(SHARES):
        table, drop = written(
            keys.where(F.col("key") % SHARES == i)
            .select("key", "cls", "band", F.count("*").over(by_key).cast("int").alias("met"), F.min("cls").over(by_key).alias("lo"), F.max("cls").over(by_key).alias("hi"))
            .where("lo < hi").drop("lo", "hi")
        )
        met.append(table)
        drops.append(drop)
        release(spark)
    drops.pop(0)()  # the sketches are done with
    rarest = Window.partitionBy("cls", "band").orderBy(F.col("met").desc(), "key")
    kept, drop_kept = written(
        reduce(DataFrame.unionByName, met).withColumns({"place": F.dense_rank().over(rarest), "again": F.lag("key").over(rarest) == F.col("key")})
        .where("not coalesce(again, false)")  # tasks repeat the keys of copies that they share
        .join(by_class.select("cls", "band", "spare"), ["cls", "band"]).where("place > spare").select("key", "cls", "band", "met")
    )
    for drop in drops:
        drop()
    release(spark)
    return rows, by_class.drop("spare"), kept, drop_kept


def links(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, labels): ``doc_id, text_hash, n, cls`` of every row; verified links ``a, b`` between classes, enough of them to connect every component; ``cls, label`` of the classes that have a link.

    Two sets A and B link when ``den * |A and B| >= num * |A or B|``.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    rows, by_class, kept, drop_kept = hashed(docs, width, num, den)
    texts = docs.select(row_id(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("row"), "text")

    def met(members: DataFrame, first: bool) -> DataFrame:
        out = durable(
            members.select("key", "cls", "comp", "n", "small").repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_met(num, den, first), "a long, b long, key long")
        )
        release(spark)
        return out

    def connected(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The pairs that hold on the whole sets, with the links before them, and the components of both."""
        found = _verified(pairs, _sets_of(texts, rows, pairs, width), num, den)
        found = durable(found if before is None else found.unionByName(before))
        release(spark)
        return found, components(found).withColumnRenamed("node", "cls")

    def with_comp(labels: DataFrame) -> DataFrame:
        return durable(by_class.join(labels, "cls", "left").select("cls", "band", F.coalesce("label", "cls").alias("comp"), "n", "small"))

    some = kept.where(F.col("key") % SAMPLED == 0).join(by_class, ["cls", "band"]).withColumn("comp", F.col("cls"))
    found, labels = connected(durable(met(some, True).select("a", "b").distinct()), None)
    parted = with_comp(labels)
    shares = [met(kept.where(F.col("key") % SHARES == i).join(parted, ["cls", "band"]), False) for i in range(SHARES)]
    again = reduce(DataFrame.unionByName, shares)
    near = durable(again.where("key is null").select("a", "b").distinct())
    if not near.isEmpty():
        found, labels = connected(near, found)
        parted = with_comp(labels)
    many = again.where("key is not null").select("key").distinct()
    rest = durable(kept.join(many, "key").join(parted, ["cls", "band"]))
    drop_kept()
    release(spark)
    several = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    if several.isEmpty():
        return rows, found, labels
    dealt = (
        rest.join(several, "key")
        .withColumn("nb", F.ceil(F.col("met") / BLOCK))
        .withColumn("block", F.pmod(F.xxhash64("cls"), "nb"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("key", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cls", "n", "comp", "small")
    )
    near = durable(dealt.groupBy("key", "band", "bi", "bj").applyInArrow(_blocks(num, den), "a long, b long").distinct())
    return rows, *connected(near, found)


def _sets_of(texts: DataFrame, rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(cls, items) once for each class of the pairs. A bit filter, of FILTER_WORDS words at most, spares most other texts the hashing."""
    spark = texts.sparkSession
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = rows.join(ids, "cls", "left_semi").groupBy("cls").agg(F.min(row_id(F.col("doc_id"), F.col("text_hash"))).alias("row"))
    named = durable(named)
    n, size = named.count(), 1 << 10
    while size < FILTER_WORDS and size * 8 < n:
        size *= 2
    place = F.shiftrightunsigned("row", 6).bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    set_bits = named.select(place.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    wanted = np.zeros(size, U)
    wanted[set_bits.column("at").to_numpy()] = set_bits.column("bits").to_numpy().view(U)
    found = texts.mapInArrow(_sets(width, spark.sparkContext.broadcast(wanted)), "row long, cls long, items array<long>")
    return durable(found.join(named, ["cls", "row"], "left_semi").groupBy("cls").agg(F.any_value("items").alias("items")))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(den * both >= num * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def near_groups(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    component_id is the smallest doc_id reachable by links, the document itself
    included. Null or empty texts and texts without words have no shingles and stand
    alone. Repeated rows are rows of one class; rows with a null doc_id are kept and
    stand alone if nothing with an id is reachable (component_id null). Extra columns
    are ignored. An empty table gives no rows.
    """
    rows, _, labels = links(docs, width, num, den)
    named = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("lo")).join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "lo")
    # durable, so that Spark may split a large component's rows in the join
    least = durable(named.groupBy("label").agg(F.min("lo").alias("component_id")))
    by_class = durable(named.join(least, "label").select("cls", "component_id"))
    return rows.join(by_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """All columns of one row of each component: the one with the smallest doc_id, of these the one with the smallest hash of its text.

    Rows without an id rank behind all others. A row goes if a chain of links leads from its
    own text to the one that stays, even where these two are less alike than the limit;
    rows of one doc_id with unlike texts all stay; of rows with the same id and text one
    stays. Null texts and texts without
    words are linked with nothing and all stay. Extra columns are kept, whatever their
    names; an empty table gives no rows.
    """
    rows, _, labels = links(docs, width, num, den)
    # the rows that stay or go are told apart by id and hash of the text, both never null
    who = [F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("_near_id"), F.col("text_hash").alias("_near_text")]
    own = rows.where("n > 0").groupBy("cls", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = own.groupBy("cls").agg(F.min(rank).alias("lo")).join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "lo")
    least = durable(named.groupBy("label").agg(F.min("lo").alias("lo")))
    by_class = durable(named.drop("lo").join(least, "label").select("cls", "lo"))
    ranked = own.join(by_class, "cls").withColumn("stays", rank.eqNullSafe(F.col("lo")))
    marked = durable(ranked.where("not stays or times > 1").select(*who, F.col("stays").alias("_near_stays")))
    release(docs.sparkSession)
    told = docs.withColumns({"_near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), "_near_text": F.xxhash64("text")})
    kept = told.join(marked.drop("_near_stays"), ["_near_id", "_near_text"], "left_anti")
    if not (repeated := marked.where("_near_stays").drop("_near_stays")).isEmpty():
        kept = kept.unionByName(told.join(repeated, ["_near_id", "_near_text"], "left_semi").dropDuplicates(["_near_id", "_near_text"]))
    return kept.select(*docs.columns)
