"""No turn of a conversation is lost when calls and results are linked."""

import json

from airledger.llm import chat_format, queries

SF = "/root/testdata/sf0.01"


def test_every_turn_of_the_table_is_in_the_result(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = queries.op3_chat_formatting(spark, SF).collect()
    system = {(f"{r.conv_id}:{r.turn + 1}", r.text) for r in rows if r.role == "system"}
    assert system and {(r.call_id, json.loads(r.context)["text"]) for r in got if r.context} == system
    assert sum(r.n_calls + r.n_results + r.n_context for r in got) == len(rows)


def test_repeated_and_missing_ids_keep_all_texts(spark):
    turns = [
        (1, 0, "system", "s"), (1, 0, None, "t"), (1, 1, "user", "u1"), (1, 1, "user", "u0"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 2, "assistant", "a0"), (1, 2, "assistant", None),
        (None, 1, "user", "n0"), (None, 1, "user", "n1"), (2, None, "assistant", "m0"), (2, None, "assistant", "m1"), (None, None, "system", "x0"), (None, None, "tool", "x1"), (3, 0, "system", "lone"),
    ]
    parts = chat_format.turns_as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = chat_format.link(*parts[:2], queries.REPLY, parts[2]).collect()
    texts = []
    for r in got:
        line = json.loads(r.line)
        texts += [x for x in (line["arguments"] and line["arguments"]["text"], line["output"], r.context and json.loads(r.context)["text"]) if x]
    assert sorted(texts) == sorted({t[3] for t in turns if t[3]})
    one = [r for r in got if r.call_id == "1:1"]
    assert sorted(r.status for r in one) == ["linked", "repeat", "repeat", "repeat", "repeat"]
    linked = next(r for r in one if r.status == "linked")
    assert (linked.n_calls, linked.n_results, linked.n_context) == (3, 3, 2) and json.loads(linked.line)["output"] == "a0" and json.loads(linked.line)["arguments"]["text"] == "u0"
    assert max(r.n_calls for r in one if r.status == "repeat") == 2 and all(r.depth is None for r in one if r.status == "repeat")
    assert sorted(r.status for r in got if r.call_id is None) == ["context"] * 2 + ["orphan"] * 2 + ["unanswered"] * 2
    assert [r.status for r in got if r.call_id == "3:1"] == ["context"]
