"""Operator 11 against a plain alignment of whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from airledger.llm import queries, token_align

A, B = queries.BYTES, queries.PIECES


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, sides):
    """Rows of the contract by loops over whole texts; texts: [(doc_id, text)]."""
    a, b = sides
    of = {c: i for i, c in enumerate(token_align.byte_letters())}
    rows, held = [], Counter()
    for doc_id, text in texts:
        ta = tb = []
        if text:
            want = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in ia]
            tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ib]
            if b"".join(x for _, x in ta) != want or b"".join(x for _, x in tb) != want:
                ta = tb = []
        spans = []
        for side in (ta, tb):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in side if low <= s and t <= e) for side in spans))
            low = e
        links, j0 = [], 0
        for i, s, e in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((i, spans[1][j][0]))
                j += 1
        held.update(set(links))
        rows.append([doc_id, len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)])
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(d, na, nb, g, len(x), sum(held[p] == most[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if na else "") for d, na, nb, g, x, s in rows]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [None, "", " ", "   ", "a", " a b", "a  b ", "▁", "a ▁ b", "漢字 かな", "😀👍🏽 x😀", "ᚠᚢ a", "\n\t \r\n x", "<|endoftext|> <s> </s>", "é é", "a b   c", "x" * 300, "don't we'll I'm 's", "1234 56,7 a's  b", "a​ ​b", "a \x1fb", "a\x85 b", "﻿ a ﻿", "᠎ a᠎ b"]


def test_against_brute_force(spark, sides, monkeypatch):
    r = random.Random(5)
    alphabet = list("abcdeinorst  ,.'\n▁ßé漢字ıﬁ😀½𝔘ᚠ 　́​1239") + ["the ", "ing ", "  ", "...", " www.", "'s", "  \t", " don't "]
    texts = ODD + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(700)]
    texts = list(enumerate(texts)) + [(5, "a b a b"), (5, "a b a b"), (None, "the the the")]
    schema = "doc_id long, text string"
    monkeypatch.setattr(token_align, "CHUNKS", 200)  # many blocks
    found = token_align.evidence(spark.createDataFrame(texts, schema).repartition(3), A, B)
    assert _rows(found) == sorted(brute(texts, sides), key=str)


def test_documents_against_brute_force(spark, sf, sides):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert _rows(queries.op11_token_alignment(spark, sf)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], sides), key=str)


def test_groups_and_odd_rows(spark, sides):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Groups", T.LongType())])
    rows = [(1, "a 漢 b", 3), (2, None, 4), (2, "a▁b", 5), (3, "word " * 40_000, 6)]
    found = {r.Groups: r for r in token_align.align(spark.createDataFrame(rows, schema), A, B).collect()}
    own = brute([(1, "a 漢 b")], sides)[0]
    assert hashlib.sha256(found[3].groups_.encode()).hexdigest() == own[-1]
    assert (found[3].n_a, found[3].n_b, found[3].n_groups, found[3].n_links) == own[1:5]
    assert (found[4].n_a, found[4].groups_) == (found[5].n_a, found[5].groups_) == (0, "")
    assert found[6].n_groups > 40_000
    none = spark.createDataFrame([], schema)
    assert token_align.align(none, A, B).count() == token_align.evidence(none, A, B).count() == 0


def test_cuts_inside_characters():
    own = token_align.Aligner(A, B)
    (one,) = own.chunks(["漢😀x"])
    (na, nb, groups, links), text, pairs = one
    assert na == len(own.a.encode(" 漢😀x").ids) and nb == len(own.b.encode("漢😀x"))
    assert groups == text.count(";") and links == len(pairs) // 8
    assert own.chunks(["a▁"]) == [None]
    assert pd.Series(own.parted("a b  c\nd e")).tolist() == ["a", "b  c\nd", "e"]
