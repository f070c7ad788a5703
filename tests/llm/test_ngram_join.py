import re

import numpy as np
import pytest

from airledger.llm import ngram_join as nj
from airledger.llm import wordhash as wh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sets(rows, width):
    out = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def brute(rows, width, num, den):
    s = sets(rows, width)
    best = {d: d for d in s}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and min(len(s[a]), len(s[b])) * den >= num * max(len(s[a]), len(s[b])):
                both = len(s[a] & s[b])
                if den * both >= num * (len(s[a]) + len(s[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    best[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_documents_against_all_pairs(spark, sf, width, num, den):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(nj.near_groups(docs, width, num, den)) == brute(rows, width, num, den)


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_planted_edits_against_all_pairs(spark, width, num, den):
    rng = np.random.default_rng(width)
    rows, vocab = [], [f"w{i}" for i in range(400)]
    for base in range(12):
        text = list(rng.choice(vocab, int(rng.integers(4, 160))))
        for copy in range(14):
            own = list(text)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(99)}"
            own = own[: len(own) - int(rng.integers(0, 3))]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nj.near_groups(docs, width, num, den)) == brute(rows, width, num, den)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one TWO", "x"), (6, "two one", "x"),
            (7, "a b c d", "x"), (7, "a b c d", "x"), (8, "A b\tc\u000bd", "x"), (9, "é É   x", "x"), (None, "lonely words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.near_groups(docs, 3, 9, 10).collect())
    assert got == [(-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 2, 9)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_groups(docs).count() == 0


def test_linked_sets_share_more_keys_than_may_be_left_out():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10)):
        for n in [*range(1, 40), 75, 130, 300, 777, 5000]:
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                most = nj.differ(len(a), num, den)
                cut = int(rng.integers(0, most + 1))
                keep = a[rng.permutation(len(a))[: len(a) - cut]]
                b = np.unique(np.append(keep, rng.integers(0, 2**64, most - cut, dtype=np.uint64)))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    shared = dict(nj.bands(len(a), num, den)).items() & dict(nj.bands(len(b), num, den)).items()
                    assert shared
                    for band, d in shared:
                        if min(len(a), len(b)) > nj.band_end(band):
                            continue
                        x, y = (nj.sketch(s, wh.mix(s), 2 * d + 1) for s in (a, b))
                        assert (x == y).sum() > d and (nj.sketch(a, wh.mix(a), 2 * d + 1, 20) == x[:20]).all()
                        (left, spare), (right, other) = (nj.keys_of(s, wh.mix(s), band, d) for s in (a, b))
                        assert len(np.intersect1d(left, right)) > max(spare, other)
                        small = [nj.small_sketch(nj.other_hash(s), band) for s in (a, b)]
                        assert nj._passes(num, den, len(a), small[0], np.array([len(b)]), small[1][None])[0]


def test_chance_of_losing_a_pair():
    """Of PICKED words, each untouched with a chance of exp(-1/2), more than SPARE are."""
    from math import comb, exp

    p = exp(-0.5)
    assert sum(comb(nj.PICKED, k) * p**k * (1 - p) ** (nj.PICKED - k) for k in range(nj.SPARE + 1)) < 1e-13


def test_a_large_group_of_near_copies(spark):
    """One key with more members than FEW, several components among them, over tiny blocks."""
    rng = np.random.default_rng(5)
    text = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(text)
        for j in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            own[int(j)] = f"z{rng.integers(3)}"
        rows.append((i, " ".join(own)))
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows, 3, 9, 10)
    own = {k: getattr(nj, k) for k in ("FEW", "BLOCK", "HELD", "REMEMBERED", "SAMPLED")}
    try:
        for few, block, held, remembered, share in ((8, 16, 40, 10, 8), (4, 8, 9, 1000, 1), (2, 4, 1000, 5, 64)):
            nj.FEW, nj.BLOCK, nj.HELD, nj.REMEMBERED, nj.SAMPLED = few, block, held, remembered, share
            assert result(nj.near_groups(docs, 3, 9, 10)) == wanted
    finally:
        for k, v in own.items():
            setattr(nj, k, v)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, 5, dtype=np.uint64)))
        gap = int(np.bitwise_count(nj.sketch(a, wh.mix(a), 9) ^ nj.sketch(b, wh.mix(b), 9)).sum())
        assert gap <= len(np.setxor1d(a, b))


def test_word_hashes_match_words():
    import pyarrow as pa

    texts = ["Ab cd\nab", None, "", "x" * 5_000_000, "cd", "é ab"]
    seen, by_word = [], {}
    for lo, hi, data, offsets in wh.chunks(pa.array(texts)):
        h, at = wh.words(data, offsets)
        for i in range(hi - lo):
            words = WORD.findall(lower(texts[lo + i]))
            assert at[i + 1] - at[i] == len(words)
            for w, x in zip(words, h[at[i] : at[i + 1]].tolist()):
                assert by_word.setdefault(w, x) == x
            seen.append(lo + i)
    assert seen == list(range(len(texts))) and len(set(by_word.values())) == len(by_word)


def test_sets_of_many_rows_are_those_of_each():
    import pyarrow as pa

    texts = ["a b c d a b c d", "", "one", None, "x y", "a b c d e f g", " ", "b c d"]
    for lo, hi, data, offsets in wh.chunks(pa.array(texts)):
        h, at = wh.words(data, offsets)
        flat, begin = wh.shingle_sets(h, at, 3)
        for i in range(hi - lo):
            assert flat[begin[i] : begin[i + 1]].tolist() == wh.shingles(h[at[i] : at[i + 1]], 3).tolist()


def test_one_row_of_each_group_stays_and_nothing_else_goes(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near = long + " w40"
    alike = "quite another text that has nothing in common with it"
    rows = [(3, long), (5, near), (5, alike), (7, near), (7, near), (None, near), (None, "free of any id but long enough"), (None, "free of any id but long enough"),
            (None, None), (None, ""), (None, " "), (9, ""), (9, ""), (11, None), (12, "tiny"), (12, "tiny"), (13, "TINY ")]
    kept = [(r.doc_id, r.text) for r in nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    wanted = [(3, long), (5, alike), (None, "free of any id but long enough"), (None, None), (None, ""), (None, " "), (9, ""), (9, ""), (11, None), (12, "tiny")]
    assert sorted(kept, key=str) == sorted(wanted, key=str)


def test_tiny_sets_with_empty_words(spark):
    """Sets of a few shingles leave words of a sketch empty; they meet by single shingles."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        words = [f"t{rng.integers(30)}" for _ in range(int(rng.integers(5, 14)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: len(words) - int(rng.integers(0, 2))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, num, den in ((3, 9, 10), (2, 8, 10), (1, 6, 10)):
        assert result(nj.near_groups(docs, width, num, den)) == brute(rows, width, num, den)
