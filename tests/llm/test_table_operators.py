"""Top-k search, mixing, chat linking, URL rules and the pipeline against brute force."""

import json
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airledger.llm import chat_format, mixing, queries, topk_search, url_filter

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf)
    found = frame.select(*sorted(frame.columns)).collect()
    wanted = con.execute(f"SELECT {', '.join(sorted(frame.columns))} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


# ---- search


def brute_top(vectors, k, ask):
    out = []
    for q, a in vectors.items():
        if ask(q):
            near = sorted(((-int(np.dot(a, b)), d) for d, b in vectors.items() if d != q and len(a) == len(b)))[:k]
            out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(near)]
    return sorted(out)


def test_search_over_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "DATA_NODE", 40)
    monkeypatch.setattr(topk_search, "QUERY_NODE", 10)
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((6, 5))
    x = centers[rng.integers(0, 6, 600)] + 0.1 * rng.standard_normal((600, 5))
    x[100:160] = x[100]  # many equal vectors
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int")
    from pyspark.sql import functions as F

    want = brute_top({i: np.floor(256 * v).astype(int) for i, v in enumerate(x)}, 5, lambda q: q % 5 == 0)
    assert rows_of(topk_search.top_k(df, F.col("id") % 5 == 0, 5)) == want


def test_search_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (6, [2.0]), (7, []), (8, [-1e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk_search.top_k(df, F.col("id") == 0, 5)) == [(0, 1, 5, 65536), (0, 2, 8, -65536 * 10**9)]
    assert topk_search.top_k(df.limit(0), F.col("id") == 0, 5).count() == 0


def test_exact_beyond_doubles():
    big = np.array([[2**31, 3], [2**31, 5], [2**31 - 1, 2**30]], dtype=np.int64)
    s = topk_search.Search(big[:1], np.array([9]), big, np.array([0, 1, 2]), 3)
    s.run()
    assert s.rows().score.tolist() == sorted((int(sum(int(a) * int(b) for a, b in zip(big[0], v))) for v in big), reverse=True)


# ---- mixing


def test_counts_follow_a_poisson_law(spark):
    docs = spark.createDataFrame([(i, "t", "big" if i % 10 else "small") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0}).collect()
    by = Counter(r.source for r in out)
    assert abs(by["big"] - 2000) < 200 and abs(by["small"] - 2000) < 300
    times = Counter(Counter(r.doc_id for r in out if r.source == "small").values())
    assert abs(sum(times.values()) - 400 * (1 - math.exp(-5))) < 12
    assert all(Counter((r.doc_id, r.copy) for r in out).values()) and max(r.copy for r in out) < 25
    ids = [r.doc_id for r in out[:200]]
    assert ids != sorted(ids)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 9), (2, "a", "s", 9), (None, "b", "s", 9), (2, "a", "s", 9)], "doc_id long, text string, source string, rate int")
    out = mixing.mix(docs, factor=40.0)
    assert out.columns == ["doc_id", "text", "source", "rate", "copy"] and out.where("source is null").count() > 0
    assert mixing.mix(docs, {"absent": 1.0}).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    twice = [rows_of(mixing.mix(docs, factor=9.0).select("doc_id", "copy").na.fill(-1)) for _ in range(2)]
    assert twice[0] == twice[1]


# ---- chat


def test_chat_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    users = {(r.conv_id, r.turn): r.text for r in rows if r.role == "user"}
    answers = {(r.conv_id, r.turn - 1): r.text for r in rows if r.role == "assistant"}
    got = {r.call_id: r for r in queries.op3_chat_formatting(spark, SF).collect()}
    assert got.keys() == {f"{c}:{t}" for c, t in users.keys() | answers.keys()}
    for (c, t) in users.keys() | answers.keys():
        r, depth, up = got[f"{c}:{t}"], 0, t - 2
        while (c, up) in users:
            depth, up = depth + 1, up - 2
        status = "orphan" if (c, t) not in users else "linked" if (c, t) in answers else "unanswered"
        arguments = {"n_chars": len(users[c, t]), "text": users[c, t], "turn": t} if (c, t) in users else None
        want = {"arguments": arguments, "call_id": f"{c}:{t}", "depth": depth if arguments else None, "name": "reply" if arguments else None, "output": answers.get((c, t)), "status": status}
        assert r.status == status and r.errors == [] and json.loads(r.line) == want
        assert r.line == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_chat_validation_cycles_and_repeats(spark):
    calls = [("a", None, "f", '{"x":1,"y":"s"}'), ("b", "a", "f", '{"x":"1"}'), ("c", "d", "f", "{}"), ("d", "c", "f", "not json"), ("e", "zz", "g", "{}"), ("a", None, "f", '{"x":1,"y":"s"}'),
             ("h", "b", "f", '{"x":2.5,"z":true}'), (None, None, "f", "{}"), ("i", "i", "f", "[1]")]
    results = [("a", "ra"), ("a", "rb"), ("k", "alone"), (None, "r")]
    schemas = {"f": {"x": ("integer", True), "y": ("string", False)}}
    out = {r.call_id: r for r in chat_format.link(spark.createDataFrame(calls, "call_id string, parent_id string, name string, arguments string"), spark.createDataFrame(results, "call_id string, output string"), schemas).where("call_id is not null").collect()}
    assert (out["a"].status, out["a"].n_calls, out["a"].n_results, out["a"].depth, out["a"].errors) == ("linked", 2, 2, 0, [])
    assert out["b"].errors == ["x: not integer"] and out["b"].depth == 1 and out["h"].depth == 2
    assert out["h"].errors == ["x: not integer", "z: unknown"]
    assert out["c"].depth is None and out["d"].depth is None and out["i"].depth is None
    assert out["c"].errors == ["x: missing"] and out["d"].errors == ["arguments: no object"] and out["i"].errors == ["arguments: no object"]
    assert out["e"].errors == ["unknown tool"] and out["e"].depth == 0
    assert out["k"].status == "orphan" and json.loads(out["k"].line)["output"] == "alone"


def test_chat_long_chain(spark):
    n = 300
    calls = spark.createDataFrame([(str(i), str(i - 1)) for i in range(n)], "call_id string, parent_id string")
    assert {r.call_id: r.depth for r in chat_format.depths(calls).collect()} == {str(i): i for i in range(n)}


def test_chat_empty(spark):
    calls = spark.createDataFrame([], "call_id string, parent_id string, name string, arguments string")
    assert chat_format.link(calls, spark.createDataFrame([], "call_id string, output string"), {}).count() == 0


# ---- URLs

URLS = [
    ("http://A.Example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("https://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("x.example.net/de/8", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("ftp://h.org?x=/es/", "h.org", "", None, "allow"), ("http://h.org#/es/", "h.org", "", None, "allow"), ("a://b://c.com/en/", "b:", "//c.com/en/", None, "allow"), ("http://", "", "", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}


def test_rules_are_those_of_the_contract(spark, tmp_path):
    """The words of the contract's list, written out, against the query and its SQL."""
    wanted = {"http://a.com/en/7": ("com/en/", "block"), "http://a.example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"),
              "http://a.example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"), "http://a.org/es/": ("org/es/", "block")}
    spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op8_url_filters(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(wanted.values()))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = con.execute(queries.oracle_sql()["op8_url_filters"]).fetchall()
    assert {page: (rule, verdict) for page, _, _, rule, verdict in rows} == dict(enumerate(wanted.values()))


def test_reputation_blocks_what_is_surely_bad(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site.example.net/x/{i}") for i in range(200)] + [(500, "http://new.site.example.net/x")]
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), outcomes).collect()}
    assert got[1] == "block" and got[0] == "allow" and got[500] == "allow"


# ---- the pipeline


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def plain_components(texts, width, limit):
    """doc_id -> smallest doc_id reachable by pairs of similarity ``limit`` or more, all pairs compared."""
    sets = {d: shingles(t, width) for d, t in texts.items()}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in sets}


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        seen[name] = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = spark.read.parquet(f"{SF}/documents.parquet").join(seen["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("toxic = 0").count() == 0 and lost.where("toxic = 1").count() > 0
    from airledger.llm import ngram_join

    left = ngram_join.near_groups(seen["near_copies"], 5, 8, 10)
    assert left.where("component_id <> doc_id").count() == 0
    assert seen["secrets"].count() == seen["near_copies"].count() and seen["secrets"].where("n_chars <> length(text)").count() == 0
    pieces = cp.STAGES[-1][1](spark, seen["mixing"], SF)
    assert pieces.selectExpr("sum(length)").first()[0] > 0


def test_one_of_a_chain_of_near_copies_stays(spark):
    """A and B are alike, B and C too, A and C are not: the group is one, and A stays."""
    from airledger.llm import ngram_join

    words = [f"w{i}" for i in range(60)]
    b = words[:]
    a, c = [*words[4:], "x1", "x2"], [*words[:-4], "y1", "y2"]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b, c)]
    like = lambda x, y: len(x & y) / len(x | y)
    assert like(sets[0], sets[1]) >= 0.8 and like(sets[1], sets[2]) >= 0.8 and like(sets[0], sets[2]) < 0.9
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "quite another text of some words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 4]


def test_stages_against_plain_python(spark):
    """Each stage on what the one before it kept, by loops over all documents."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from airledger.llm import secret_scan, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, near, secrets, mixed, packed = (f for _, f in cp.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon, factors = toxicity.learn(docs, labels.where(~toxicity.held_out_column(F.col("doc_id"))))
    grammar = toxicity.Grammar(lexicon, factors)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = {d: t for d, t in texts.items() if grammar.score(t) < 0.7}
    kept = spark.createDataFrame(toxic(spark, docs, SF).toPandas(), docs.schema)
    assert {r.doc_id for r in kept.collect()} == set(clean)
    one = spark.createDataFrame(near(spark, kept, SF).toPandas(), docs.schema)
    least = plain_components(clean, 5, 0.8)
    assert {r.doc_id for r in one.collect()} == {d for d in clean if least[d] == d}
    safe = {r.doc_id: r.text for r in secrets(spark, one, SF).collect()}
    scanner = secret_scan.Scanner()
    assert safe.keys() == {r.doc_id for r in one.collect()}
    assert all((safe[d] == clean[d]) == (not scanner.spans(clean[d] or "")) for d in safe)
    before = spark.createDataFrame(one.toPandas(), docs.schema)
    drawn = mixed(spark, before, SF).select("doc_id").collect()
    assert {r.doc_id for r in drawn} <= set(safe) and abs(len(drawn) - len(safe)) < 6 * len(safe) ** 0.5
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {r.doc_id: r.n for r in packed(spark, before, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {d: len(t.encode(clean[d] or "", add_special_tokens=False).ids) + 1 for d in safe}


def test_keep_one_odd_rows(spark):
    from airledger.llm import ngram_join

    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (9, None, "c"), (None, text, "d"), (None, "", "e"), (None, "quite another text that stands alone here", "f")]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted(r.component_id for r in out.collect()) == ["b", "c", "e", "f"]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    import corpus_pipeline as cp

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "web", 48, 0.9, 7, "x"), (1, text, "en", "web", 48, 0.9, 7, "x"), (2, None, None, None, None, None, None, None), (3, "", "en", "web", 0, 0.1, 8, "y"),
            (None, "password=hunter22 and more", "en", "book", 25, 0.2, 9, "z"), (4, "word " * 100_000, "en", "book", 500_000, 0.3, 10, "w")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, copy long, _toxicity string"
    docs = spark.createDataFrame(rows, kind)
    for data in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            before = data
            data = stage(spark, data, SF)
            if name == "packing":
                assert data.count() >= (before.count() > 0)
                break
            assert data.columns == before.columns
            data = spark.createDataFrame([tuple(r) for r in data.collect()], kind)
            if name == "toxicity":
                assert {(r.score, r.copy, r._toxicity) for r in data.collect()} == {(r.score, r.copy, r._toxicity) for r in before.collect()}
            if name == "near_copies" and before.count():
                assert sorted((r.doc_id or -1 for r in data.collect())) == [-1, 1, 2, 3, 4]
            if name == "secrets" and before.count():
                assert {r.text for r in data.where("doc_id is null").collect()} == {"[SECRET] and more"}
            if name == "mixing":
                assert {r.copy for r in data.collect()} <= {7, 8, 9, 10, None}


def test_mixing_broadcasts_rates_and_keeps_a_column_named_copy(spark):
    from airledger.llm import mixing

    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}", "mine") for i in range(60)], "doc_id long, text string, source string, copy string")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_"] and all(r.copy == "mine" and r.copy_ >= 1 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    few, mixing.FEW_SOURCES = mixing.FEW_SOURCES, 1
    try:
        assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, out.collect()))
    finally:
        mixing.FEW_SOURCES = few


def test_cover_tree_levels():
    """All points lie within a node's reach, reaches fall, siblings' pivots stand apart, and a node's pivot is one of its children's."""
    rng = np.random.default_rng(1)
    for points in (rng.standard_normal((3000, 6)), np.repeat(rng.integers(0, 3, (400, 4)), 5, axis=0).astype(float), np.ones((500, 3))):
        left, met = [topk_search.Tree(points)], 0
        gap = lambda i, j: float(np.sqrt(((points[i] - points[j]) ** 2).sum()))
        while left:
            node = left.pop()
            assert node.pivot in node.members and max(gap(node.pivot, m) for m in node.members) <= node.reach + 1e-9
            assert np.sqrt(((points[node.members] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
            if node.children:
                assert sorted(m for c in node.children for m in c.members) == sorted(node.members) and node.pivot == node.children[0].pivot
                assert len({c.reach for c in node.children}) == 1 and node.children[0].reach <= node.reach
                pivots = [c.pivot for c in node.children]
                assert all(gap(a, b) >= node.children[0].reach - 1e-9 for i, a in enumerate(pivots) for b in pivots[:i])
            left += node.children
            met += 1
        assert met > 1 or len(np.unique(points, axis=0)) == 1
