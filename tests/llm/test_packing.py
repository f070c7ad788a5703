import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airledger.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return t


ODD = ["", " ", "it's THE end.", "a!! b?? «c» d.e,f 12ab3", "Äé ñandú é İ ΣΑΣ İx", "x" * 3000, "tab\tand\r\nline  end", "don't I'LL we've", "ẞǅ ǆ ß ﬁ",
       "<|endoftext|> a<|startoftext|>b", "日本語 テスト。", "näive.", "'s 't", "a.", ".a", "...", "é.", "A."]


def test_ids_are_the_tokenizers(sf, spark):
    encode, t = packing.encoder(PATH), plain()
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == plain_once().encode(text, add_special_tokens=False).ids


_once = []


def plain_once():
    if not _once:
        _once.append(plain())
    return _once[0]


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 65, 40).tolist()
        windows, free = [], []
        for i in sorted(range(40), key=lambda i: -lengths[i]):
            fits = [f for f in free if f >= lengths[i]]
            if fits:
                free[free.index(min(fits))] -= lengths[i]
            else:
                free.append(64 - lengths[i])
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(64 - sum(lengths[i] for i in w) for w in got) == sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_lengths_are_whole_and_need_no_padding(lengths):
    seen = [[] for _ in lengths]
    for sequence in packing.pack_lengths(lengths, 32):
        total = sum(p[2] for p in sequence)
        assert 0 < total <= 32 and total & (total - 1) == 0
        for item, start, length in sequence:
            seen[item].append((start, length))
    for n, pieces in zip(lengths, seen):
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == n


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 3000])
def test_pieces_of_documents(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "a b", "x")], docs.schema))
    rows = packing.pack(docs, PATH, 2048, 1, block).collect()
    t, sequences, pieces = plain(), {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert pieces.keys() == texts.keys()
    for d, parts in pieces.items():
        want = t.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        assert np.concatenate([p[1] for p in sorted(parts, key=lambda p: p[0])]).tolist() == want
        assert all(p[2] == len(want) and p[3] == len(p[1]) for p in parts)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_of_letters_that_grow_in_lower_case():
    """A dotted capital I becomes a letter and a mark, which joins the sign after it."""
    import random

    r, t, encode = random.Random(1), plain(), packing.encoder(PATH)
    signs = ["T\u0130,", "\u0130,", "a\u0130.b\u0130!", "\u0130\u0130;\u0130", "x \u0130: y"]
    signs += ["".join(r.choices("aT\u0130i\u0307\u0131.,;:!? 'é9", k=r.randint(1, 9))) for _ in range(20_000)]
    for text, want in zip(signs, t.encode_batch(signs, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.ids, text


def test_extra_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "z"), (1, "a b c", 8, "y")], "doc_id long, text string, sequence_id long, ids string")
    rows = packing.pack(docs, PATH, 2048, 1).collect()
    assert sum(r.length for r in rows) == 2 * (len(plain().encode("a b c", add_special_tokens=False).ids) + 1)
