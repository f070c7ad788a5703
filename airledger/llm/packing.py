"""Operator 4: best-fit decreasing packing of token ids into windows.

Documents are tokenized and cut: every full window of a long document is a sequence
of its own. The rests, longest first, go to the open window with the least sufficient
room, found in a segment tree indexed by remaining capacity. Afterwards the emptiest
windows are cut up to fill the gaps of the others, and the last window is cut into
powers of two, which need no padding. Each task packs its own rows in blocks of
bounded size; nothing is shuffled. A sequence id holds the number of the partition,
so a task that runs again gives the same ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rests are packed whenever so many of their tokens have gathered in a task.
BLOCK_TOKENS = 8_000_000
#: Words whose ids a worker remembers.
CACHED_WORDS = 100_000


class Room:
    """A segment tree over capacities 0..size: how many open windows lie below each node."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int, n: int = 1) -> None:
        if n > 0:
            self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity) of the tightest open window with room for ``need``."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        self.add(capacity, window, -1)
        return window, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of item numbers. Lengths are 1..size; ties keep their order."""
    room, windows = Room(size), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = room.take(lengths[item])
        if got is None:
            windows.append([])
            got = len(windows) - 1, size
        window, capacity = got
        windows[window].append(item)
        if capacity > lengths[item]:
            room.add(capacity - lengths[item], window)
    return windows


def pack_lengths(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in it, length), without padding."""
    windows = [[(i, 0, lengths[i]) for i in w] for w in best_fit_decreasing(lengths, size)]
    fill = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: -fill[w])
    low, high = 0, len(order) - 1
    while low < high:
        to, donor = order[low], order[high]
        gap = size - fill[to]
        if gap == 0:
            low += 1
        elif not windows[donor]:
            high -= 1
        else:
            item, start, length = windows[donor].pop()
            part = min(gap, length)
            windows[to].append((item, start, part))
            if part < length:
                windows[donor].append((item, start + part, length - part))
            fill[to] += part
            fill[donor] -= part
    out = []
    for window, total in zip(windows, fill, strict=True):
        if total == size or total & (total - 1) == 0:
            out += [window] * (total > 0)
            continue
        pieces = window[::-1]
        while total:
            left = power = 1 << (total.bit_length() - 1)
            total -= power
            out.append([])
            while left:
                item, start, length = pieces.pop()
                part = min(left, length)
                out[-1].append((item, start, part))
                left -= part
                if part < length:
                    pieces.append((item, start + part, length - part))
    return out


class Words(dict):
    """chunk of text without spaces -> its ids as bytes; the last CACHED_WORDS to twice as many are remembered.

    A run of Latin letters is one token word of this tokenizer, and so is one sign
    after it, so such chunks go straight to the model; others take the whole way. (An
    array of kind I holds 32-bit numbers, little-endian on every machine that Spark
    runs its Arrow exchange on.)
    """

    def __init__(self, loaded) -> None:
        super().__init__()
        self.loaded, self.model, self.old = loaded, loaded.model, {}
        self.special = [t.content.lower() for t in loaded.get_added_tokens_decoder().values()]
        self.special_start = os.path.commonprefix(self.special)
        self.plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        others = iter(range(256, 512))
        self.letters = [chr(b) if b in kept else chr(next(others)) for b in range(256)]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.ids(chunk)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, chunk: str) -> bytes:
        if self.plain(chunk):
            own = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode()))
            return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()
        if len(chunk) > 1 and chunk[-1] in ".,;:!?" and chunk[-2].isalpha() and "\u0130" not in chunk:  # its lower case ends in a mark that joins the sign
            return self[chunk[:-1]] + self[chunk[-1]]
        return array("I", self.loaded.encode(chunk, add_special_tokens=False).ids).tobytes()


def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes.

    No pattern of this tokenizer reaches across a space, tab or line end, so ids of
    what stands between them are remembered. It lower-cases, which is done first where
    that is the same. A text that holds one of the tokenizer's special tokens is encoded
    as a whole. The memory is kept between the tasks of a worker.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_airledger", {})
    if path not in kept:
        loaded = tokenizers.Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        kept[path] = Words(loaded)
    words = kept[path]

    def encode(text: str) -> bytes:
        if words.special_start in text and any(t in text.lower() for t in words.special):
            return array("I", words.loaded.encode(text, add_special_tokens=False).ids).tobytes()
        if unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
            text = text.lower()
        return b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    return encode


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, size: int, end_id: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()
    arrow = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        gathered = 0
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        def flush() -> None:
            nonlocal number
            for sequence in pack_lengths([len(r[2]) // 4 for r in rests], size):
                at = 0
                for item, start, length in sequence:
                    doc, base, ids, total = rests[item]
                    rows.append((doc, base + start, length, ids[4 * start : 4 * (start + length)], total, number, at))
                    at += length
                number += 1
            rests.clear()

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                while total - start >= size:
                    rows.append((doc, start, size, ids[4 * start : 4 * (start + size)], total, number, 0))
                    number, start, held = number + 1, start + size, held + size
                if start < total:
                    rests.append((doc, start, ids[4 * start :], total))
                    gathered += total - start
                if gathered >= block_tokens:
                    flush()
                    held, gathered = held + gathered, 0
                if held >= 2_000_000 and rows:
                    held = 0
                    yield batch_of()
        flush()
        if rows:
            yield batch_of()

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit bytes. Every
    document ends with ``end_id``; a null or empty text is that id alone. A repeated
    row is packed again. No sequence needs padding but to its own length, which is
    ``size`` or a power of two. A null doc_id stays null; other columns are ignored;
    an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path, size, end_id, block_tokens), SCHEMA)
