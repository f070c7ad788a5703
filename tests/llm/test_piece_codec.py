"""Operator 12 against the sentencepiece library: ids, spans, decoded texts, and compiled character maps."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from airledger.llm import piece_codec, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b", " ▁ ▁▁", "漢字かな", "ﬁ ﬂ Å Å", "😀👍🏽", "ᚠᚢ", "\n\t\r\n", "\x00a\x00", "<s></s><unk><0x0A>", "éé", "½", " x　y", "aaaa" * 30, "x" * 200, "İı", "​﻿z", "①②", "ｱｲｳ", "  lead", "trail  ", "̈a"]


def _library(**spec):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    if "rule" in spec:
        own = sentencepiece_model_pb2.ModelProto()
        own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=spec["rule"]).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = spec.get("squeeze", False)
    proto.normalizer_spec.add_dummy_prefix = spec.get("prefix", True)
    proto.trainer_spec.byte_fallback = spec.get("fallback", True)
    if not spec.get("fallback", True):
        for p in proto.pieces:
            if p.type == p.BYTE:
                p.type = p.CONTROL
    raw = proto.SerializeToString()
    return piece_codec.Codec(model_proto=raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


def _texts(n, seed=7):
    r = random.Random(seed)
    alphabet = list("abcdeinorst  ,.'\n▁ßé漢字İﬁ①ｱ½𝔘ᚠ😀 　́​") + ["the ", "ing", "  ", "...", "www.", "Å", "  \t"]
    return ODD + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("spec", [{}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc_cf", "squeeze": True}, {"squeeze": True}, {"prefix": False}, {"rule": "nfkc", "fallback": False}, {"fallback": False, "squeeze": True}])
def test_ids_and_spans_are_the_librarys(spec):
    own, library = _library(**spec)
    for text in _texts(1500):
        ids, starts, ends = own.pieces(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces], text
        wanted = [(p.begin, p.end) for p in proto.pieces]
        i = 0
        while i < len(ids):  # byte pieces of one character share its span
            j = i
            while own.bytes and ids[j] in own.bytes and proto.pieces[j].surface == "" and j + 1 < len(ids):
                j += 1
            assert (starts[i], ends[j]) == (wanted[i][0], wanted[j][1]), text
            i = j + 1


def test_character_map_takes_the_longest_prefix():
    own, _ = _library(rule="nmt_nfkc")
    assert own.map.longest("ﬁx".encode(), 0) == (b"fi", 3)
    assert own.map.longest("é".encode(), 0) == ("é".encode(), 3)
    assert own.map.longest(b"plain", 0) is None
    norm, where = own.normalize("ﬁ é")
    assert norm == "▁fi▁é" and where.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 4, 6]


def test_long_texts_without_spaces():
    own, library = _library()
    text = "".join(random.Random(3).choices("abcdefghij漢字", k=60_000))
    assert own.pieces(text)[0].tolist() == library.encode(text)


def test_rejects_models_it_cannot_follow():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    with pytest.raises(ValueError):
        piece_codec.Codec(model_proto=proto.SerializeToString())


def test_whole_documents(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = queries.op12_sentencepiece_codec(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(rows)
    for r in found:
        ids = library.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing names, an empty table; spans rebuild the text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("IDS", T.StringType())])
    rows = [(1, None, "a"), (2, "", None), (None, "é 漢 x", "b"), (4, "a  b", "c"), (4, "a  b", "c"), (5, "wörd " * 50_000, "d")]
    found = piece_codec.encode(spark.createDataFrame(rows, schema), MODEL)
    assert found.columns == ["doc_id", "text", "IDS", "ids_", "starts", "ends"]
    found = found.collect()
    assert len(found) == 6
    for r in found:
        assert r.ids_[0] == 1 and r.ids_[-1] == 2
        data = (r.text or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data
    back = piece_codec.decode(piece_codec.encode(spark.createDataFrame(rows, schema), MODEL), MODEL, "ids_").collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]
    none = spark.createDataFrame([], schema)
    assert piece_codec.encode(none, MODEL).count() == piece_codec.digests(none, MODEL).count() == 0
    lone = spark.createDataFrame([(None,), ([],)], "ids array<long>")
    assert sorted((r.decoded for r in piece_codec.decode(lone, MODEL).collect()), key=str) == ["", None]
