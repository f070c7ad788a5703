"""Offset-preserving encoding with a SentencePiece BPE model, and its decoding.

A text is normalised first: at each place the longest prefix that the model's compiled
character map holds is replaced, else one character is kept. For every byte of the
normalised text the byte of the source it came from is recorded. The model's merges run on
the normalised text; every piece is then projected to the bytes of the source it stands for.

The compiled map is a double-array trie over bytes whose values are places in a block of
replacements that end with a zero byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = "▁"
#: The library looks at so many matches of the character map at one place.
MATCHES = 32


class CharacterMap:
    """Longest-prefix lookups in a compiled character map (``precompiled_charsmap``)."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of ``data[at:]`` and the prefix's length."""
        units, best, found = self.units, None, 0
        if not units:
            return None
        node = self._child(units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                best, found = (units[node] & 0x7FFFFFFF, i + 1 - at), found + 1
                if found == MATCHES:
                    break
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Codec:
    """One model. ``pieces()`` gives ids and spans of a text, ``decode()`` is the library's."""

    def __init__(self, model_file: str | None = None, model_proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model_proto if model_proto is not None else open(model_file, "rb").read())  # a vocabulary file on every machine
        trainer, spec = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models that mark spaces in front of words can be encoded")
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        if kinds & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.decode: Callable[[list[int]], str] = self.library.decode
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if trainer.byte_fallback else None
        self.sizes = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        #: The same merges on text that is normalised already.
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        spec.precompiled_charsmap = b""
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes, and for its end, the byte of the source it came from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            wide = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            where = np.repeat(np.arange(len(data)), wide)
            return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([np.zeros(3 * self.prefix, np.int64), where, [len(data)]])
        parts = list(self._parts(data))
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        if not parts:
            return "", np.zeros(1, np.int64)
        out, where = bytearray(), []
        mark = SPACE.encode()
        if self.prefix:
            out += mark
            where += [parts[0][1]] * 3
        after_space = self.squeeze
        for new, at, end in parts:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put = new.replace(b" ", mark)
                out += put
                where += [at] * len(put)
                after_space = new.endswith(b" ")
            after_space = after_space and self.squeeze
        end = parts[-1][2]
        while self.squeeze and out.endswith(mark):
            del out[-3:]
            end = where[len(out)]
            del where[len(out) :]
        return out.decode(errors="replace"), np.array([*where, end], np.int64)

    def _parts(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Replacement (or the character itself), first byte and end of each part of the source."""
        at = 0
        while at < len(data):
            met = self.map.longest(data, at)
            if met is None:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                met = data[at : at + n], n
            yield met[0], at, at + met[1]
            at += met[1]

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first bytes and ends in the source; the bytes of a character without a piece have the spans of their own bytes."""
        norm, where = self.normalize(text)
        if self.bytes is None:  # unknown characters have no length of their own
            own = self.merges.encode(norm, return_type="proto").pieces
            ids, ends = np.array([p.id for p in own], "<u4"), np.array([p.end for p in own], np.int64)
        else:
            ids = np.array(self.merges.encode(norm, num_threads=1), "<u4")
            ends = np.cumsum(self.sizes[ids])
        cuts = where[np.concatenate([[0], ends])]
        return ids, cuts[:-1], cuts[1:]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """All columns of the table and ``ids, starts, ends array<long>``: ids with begin and end id, and each id's byte span in the UTF-8 text.

    One pass, nothing is shuffled. A null text counts as empty: begin and end id alone, with
    empty spans. Texts are never cut; rows are taken as they come, repeated ones fare alike, an
    empty table gives no rows. The space that the model puts before a text has no bytes of its
    own. New columns get underscores where the table has a column of that name.
    """
    return _mapped(docs, model, [("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))], "ids array<long>, starts array<long>, ends array<long>", lambda c, i, a, b, t: (i, a, b))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """As encode(), with ``n_tokens``, and SHA-256 of the ids, of the decoded text and of the spans instead of the arrays.

    Ids and spans (start, end of each id) are hashed as little-endian unsigned 32- and 64-bit numbers.
    """

    def made(c: Codec, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> tuple:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), sha(ids.astype("<u4").tobytes()), sha(c.decode(ids.tolist()).encode()), sha(np.stack([starts, ends], 1).astype("<u8").tobytes())

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    return _mapped(docs, model, list(zip(names, kinds)), "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", made)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the library's decoding of ``ids``; null ids give a null text, no ids an empty one."""
    into = fresh(rows, into)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if x is None else own.decode([int(i) for i in x]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return rows.mapInArrow(work, rows.select("*", F.lit(None).cast("string").alias(into)).schema)


def _mapped(docs: DataFrame, model: str, fields: list, ddl: str, made: Callable[..., tuple]) -> DataFrame:
    names, out = [], docs
    for name, kind in (x.strip().split(" ") for x in ddl.split(",")):
        names.append(fresh(out, name))
        out = out.withColumn(names[-1], F.lit(None).cast(kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for at in range(0, batch.num_rows, 256):  # results of a few rows at a time
                rows = []
                for text in texts.slice(at, 256).to_pylist():
                    ids, starts, ends = own.pieces(text or "")
                    last = len((text or "").encode())
                    rows.append(made(own, np.concatenate([[own.begin], ids, [own.end]]), np.concatenate([[0], starts, [last]]), np.concatenate([[0], ends, [last]]), text or ""))
                new = [pa.array([r[k] for r in rows], f[1]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 256).columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(work, out.schema)
