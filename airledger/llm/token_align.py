"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked.

Where a token ends is cut coarsely by the character offsets of a `tokenizers` file (A) and by
the byte spans of a `sentencepiece` proto (B). Cuts that fall inside a character, and tokens
that are single bytes, are refined by the lengths of the decoded bytes, counted from the last
clean cut. Bytes at which both sides end close a group; tokens whose bytes overlap are linked.

Texts are taken apart where a space stands between two characters that are not white: there
both tokenizers surely part words, so a chunk is tokenized once for each block of documents.
A block is a bounded run of rows of one task. It knows how many of its documents hold a pair of
ids linked; these counts are summed over the corpus by pair and come back to the block, which
never holds more pairs than its own.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, written

#: Rows are taken so many at a time; a block ends with those by which it holds so many different chunks, or so many chunks in all.
ROWS, CHUNKS, WORDS = 64, 150_000, 4_000_000
#: New chunks that are tokenized as one text.
TOGETHER = 64
#: A worker remembers so many chunks met last, and as many met before them.
KNOWN = 200_000
#: B's ids in a pair take so many bits.
SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        gc.disable()  # a worker keeps many small objects and none that refer to each other in a circle
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        of = {c: b for b, c in enumerate(byte_letters())}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(len(self.b)))]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.b_byte = np.array([self.b.is_byte(i) for i in range(len(self.b))])
        end = lambda n, sign: np.array([f"{i}{sign}" for i in range(n)], object)
        self.known: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.a_names, self.b_names = (np.concatenate([end(len(y), ","), end(len(y), last)]) for y, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.b.serialized_model_proto())
        spec = proto.normalizer_spec
        plain_b = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and not any(re.search("[^▁]▁", p.piece) for p in proto.pieces if p.type == p.NORMAL)
        plain_a = self.a.normalizer is None and self.a.post_processor is None and "ByteLevel(add_prefix_space=False" in str(self.a.pre_tokenizer) and "use_regex=True" in str(self.a.pre_tokenizer)
        white = r"\s᠎​﻿"
        self.white = re.compile(f"[{white}]")
        self.parted = re.compile(f" (?<=[^{white}] )(?=[^{white}])").split if plain_a and plain_b else lambda text: [text]

    @staticmethod
    def _ends(coarse: np.ndarray, clean: np.ndarray, sizes: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte ends of all tokens: clean cuts as they are, others by decoded bytes since the last clean cut (or the start of the chunk)."""
        total = np.cumsum(sizes)
        before = total - sizes
        at = np.where(clean, np.arange(len(coarse)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], at]))[:-1]  # the last clean cut before each token
        own = last < first  # none in this chunk
        base = np.where(own, starts, coarse[np.maximum(last, 0)])
        passed = np.where(own, before[first], total[np.maximum(last, 0)])
        return np.where(clean, coarse, base + total - passed)

    def chunks(self, chunks: list[str]) -> list[tuple[list[int], str, bytes] | None]:
        """For each chunk (its leading space left out): numbers of A and B tokens, groups and links; the groups written out, each with a ``;``; a pair of ids for each link, as 64-bit numbers. None if a side doesn't give its bytes back.

        Chunks without white at their ends are tokenized together as one text, others apart.
        """
        out: list = [None] * len(chunks)
        if not chunks:
            return out
        plain = [k for k, c in enumerate(chunks) if c and not self.white.search(c[0]) and not self.white.search(c[-1])]
        runs = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)] + [[k] for k in sorted(set(range(len(chunks))) - set(plain))]
        texts = [" ".join([chunks[k] for k in run]) for run in runs]
        ea = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        eb = [list(e.pieces) for e in self.b.encode(texts, return_type="proto", num_threads=1)]
        ia, ib, raw = [e.ids for e in ea], [[p.id for p in e] for e in eb], [(" " + t).encode() for t in texts]
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(ia, ib, raw)]
        for run in (run for run, g in zip(runs, good) if not g and len(run) > 1):  # some chunk there isn't given back
            for k in run:
                out[k] = self.chunks([chunks[k]])[0]
        use = [x for x, g in enumerate(good) if g]
        if not use:
            return out
        order = [k for x in use for k in runs[x]]
        start = np.cumsum([0] + [len(raw[x]) for x in use[:-1]])
        na, nb = (np.array([len(i[x]) for x in use], np.int64) for i in (ia, ib))
        first_a, first_b = np.repeat(np.cumsum(na) - na, na), np.repeat(np.cumsum(nb) - nb, nb)
        whole = b"".join([raw[x] for x in use])
        # character offsets to bytes
        byte_of = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) & 0xC0 != 0x80), len(whole))
        char0 = np.cumsum([0] + [len(texts[x]) + 1 for x in use[:-1]])
        ids_a = np.fromiter(chain.from_iterable(ia[x] for x in use), np.int64, int(na.sum()))
        off = np.fromiter(chain.from_iterable(chain.from_iterable(ea[x].offsets for x in use)), np.int64, 2 * int(na.sum())).reshape(-1, 2) + np.repeat(char0, na)[:, None]
        clean = np.append(off[1:, 0] >= off[:-1, 1], True)
        ends_a = self._ends(byte_of[off[:, 1]], clean, self.a_size[ids_a], np.repeat(start, na), first_a)
        ids_b = np.fromiter(chain.from_iterable(ib[x] for x in use), np.int64, int(nb.sum()))
        coarse = np.array([p.end for x in use for p in eb[x]], np.int64) + np.repeat(start, nb) + 1
        ends_b = self._ends(coarse, ~self.b_byte[ids_b], self.b_size[ids_b], np.repeat(start, nb), first_b)
        # groups
        shared = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]  # both end at the end of the last text
        ga, gb = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        words = np.empty(len(ids_a) + len(ids_b), object)
        words[np.arange(len(ids_a)) + np.searchsorted(gb, ga, "left")] = self.a_names[ids_a + last_a * len(self.a_bytes)]
        words[np.arange(len(ids_b)) + np.searchsorted(ga, gb, "right")] = self.b_names[ids_b + last_b * len(self.b_bytes)]
        # links
        begin_a = np.concatenate([[0], ends_a[:-1]])
        low, high = np.searchsorted(ends_b, begin_a, "right"), np.searchsorted(ends_b, ends_a, "left")
        n = high - low + 1
        which = np.repeat(np.arange(len(ids_a)), n)
        pairs = (ids_a[which] << SHIFT) + ids_b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]]
        # what belongs to each chunk
        stop = np.cumsum([len(chunks[k].encode()) + 1 for k in order])
        upto = [np.searchsorted(x, stop, "right") for x in (ends_a, ends_b, shared)]
        upto.append(np.cumsum(n)[upto[0] - 1])
        counts = np.stack([np.diff(x, prepend=0) for x in upto], 1).tolist()
        texts_out, cut, link = words.tolist(), (upto[0] + upto[1]).tolist(), upto[3].tolist()
        at = done = 0
        for k, c, to, upto_link in zip(order, counts, cut, link):
            out[k] = c, "".join(texts_out[at:to]), pairs[done:upto_link].tobytes()
            at, done = to, upto_link
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _places(numbers: list) -> list[int]:
    """Where a list holds None."""
    out, at = [], -1
    try:
        while True:
            out.append(at := numbers.index(None, at + 1))
    except ValueError:
        return out


class Block:
    """Chunks met in a run of documents, and how many of these hold each pair."""

    def __init__(self, own: Aligner):
        self.own, self.number, self.words = own, {}, 0
        self.counts: list[list[int]] = []
        self.texts: list[str] = []
        self.links: list[bytes] = []

    def documents(self, texts: list[str | None]) -> list[list[int] | None]:
        """For each text the numbers of its chunks; None for no text, and if its tokens don't give its bytes back."""
        parts = [self.own.parted(t) if t else [] for t in texts]
        self.words += sum(map(len, parts))
        number, own = self.number, self.own
        got = [list(map(number.get, p)) for p in parts]
        missing = [_places(g) for g in got]
        here = list(dict.fromkeys(p[i] for p, places in zip(parts, missing) for i in places))
        if len(own.known) > KNOWN:
            own.old, own.known = own.known, {}
        known, old = own.known, own.old
        known.update((c, old[c]) for c in here if c not in known and c in old)
        new = [c for c in here if c not in known]
        for at in range(0, len(new), 8192):
            known.update(zip(new[at : at + 8192], own.chunks(new[at : at + 8192])))
        for c in here:
            x = known[c]
            number[c] = -1 if x is None else len(self.counts)
            if x is not None:
                self.counts.append(x[0])
                self.texts.append(x[1])
                self.links.append(x[2])
        for p, g, places in zip(parts, got, missing):
            for i in places:
                g[i] = number[p[i]]
        return [None if not g or -1 in g else g for g in got]

    def said(self, numbers: list[int]) -> str:
        return "".join(map(self.texts.__getitem__, numbers))[:-1]

    def pairs(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs, how many documents hold each, links of each chunk and the number of each link's pair."""
        sizes = np.array([len(x) // 8 for x in self.links], np.int64)
        codes, which = np.unique(np.frombuffer(b"".join(self.links), np.int64), return_inverse=True)
        first, count, place = np.cumsum(sizes) - sizes, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for own in documents:
            n = sizes[own]
            met = which[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)]
            place[met] = at = np.arange(len(met))
            count[met[place[met] == at]] += 1  # each pair once
        return codes, count, sizes, which


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """All columns of the table and ``n_a, n_b, n_groups, n_links long, groups string``.

    ``groups`` has the ids of each group, `a1,a2|b1;a3|b2,b3`. One pass; nothing is shuffled. A
    text that is null or empty, or whose tokens on either side don't give space + text back, has
    zeros and ''. Texts are never cut. New columns get underscores where a name is taken.
    """
    names = []
    out = docs
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
        names.append(fresh(out, name))
        out = out.withColumn(names[-1], F.lit(None).cast("string" if name == "groups" else "long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(aligner(a, b))
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                for numbers in block.documents(texts.slice(at, ROWS).to_pylist()):
                    own = [block.counts[k] for k in numbers or []]
                    rows.append((*map(sum, zip(*own)), block.said(numbers)) if own else (0, 0, 0, 0, ""))
                if len(block.number) > CHUNKS:
                    block = Block(block.own)
                new = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, ROWS).columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(work, out.schema)


KEPT = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, pairs array<long>, held array<long>, sizes binary, links binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document (numbers of its chunks) and one for each block (``pairs`` and how many documents have them ``held``; links of chunks)."""
    schema = pa.schema([
        *[(c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("chunks", pa.binary()),
        ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("sizes", pa.binary()), ("links", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, rows = TaskContext.get().partitionId() << 24, Block(aligner(a, b)), []

        def closed() -> pa.RecordBatch:
            codes, count, sizes, which = block.pairs([own for _, _, own in rows if own is not None])
            counts, every = np.array(block.counts, np.int64).reshape(-1, 4), []
            for doc_id, said, own in rows:
                n = counts[own].sum(axis=0).tolist() if own is not None else [0] * 4
                every.append((number, doc_id, *n, said, b"" if own is None else own.astype("<u4").tobytes(), None, None, None, None))
            every.append((number, None, None, None, None, None, None, None, codes, count, sizes.astype("<u4").tobytes(), which.astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in every], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, numbers in zip(part.column(0).to_pylist(), block.documents(part.column(1).to_pylist())):
                    if numbers is None:
                        rows.append((doc_id, "", None))
                    else:
                        rows.append((doc_id, hashlib.sha256(block.said(numbers).encode()).hexdigest(), np.array(numbers, np.int64)))
                if len(block.number) > CHUNKS or block.words > WORDS:
                    yield closed()
                    number, block, rows = number + 1, Block(block.own), []
        if rows:
            yield closed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, KEPT)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n``: documents of the corpus that hold each pair linked; counted in blocks first."""
    rows = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    return rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))


def evidence(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id``, the numbers of align(), ``n_best``, ``count_sum`` and ``groups_sha256`` for each row of ``docs(doc_id, text)``.

    A pair's count is the number of documents (rows) that hold it linked; ``n_best`` links have
    the highest count of their A id in the corpus (ties included), ``count_sum`` adds the counts of
    all links. Rows without tokens (see align()) have zeros and ''; repeated rows count as often as
    they stand there, rows without an id are documents too; an empty table gives no rows; other
    columns are not looked at. Only A's vocabulary (a row for each of its ids) is broadcast.
    """
    stored, drop_blocks = written(_blocks(docs, a, b))
    drops = [drop_blocks]
    try:
        counts, drop = written(pair_counts(stored))
        drops.append(drop)
        best = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))  # at most the size of A's vocabulary
        marked = counts.join(F.broadcast(best), F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        asked = stored.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
        answers = asked.join(marked, "pair").select("of", "at", "n", "best")
        return durable(stored.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(_sums, RESULT))
    finally:
        for drop in drops:
            drop()


def _sums(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block with the sums over their links."""
    whole = rows["pairs"].notna()
    block, docs = rows[whole].iloc[0], rows[~whole]
    count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
    count[answers["at"]], best[answers["at"]] = answers["n"], answers["best"]
    sizes, links = (np.frombuffer(block[c], "<u4").astype(np.int64) for c in ("sizes", "links"))
    ends = np.cumsum(sizes)
    per = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], ends])]) for x in (best, count)]
    of = [np.frombuffer(c, "<u4") for c in docs["chunks"]]
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].astype("Int64")
    out["n_best"], out["count_sum"] = ([int(x[c].sum()) for c in of] for x in per)
    return out.assign(groups_sha256=docs["groups_sha256"])
