"""Layouts, marks and masks of conversations."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallywork.llm import chat, queries

SYSTEM, USER, ANSWER = ("system", "Be brief."), ("user", "Hi <|im_end|>"), ("assistant", "Ho\n")
LAYOUTS = [
    ({"messages": [{"role": r, "content": t} for r, t in (SYSTEM, USER, ANSWER)]}, "messages", [SYSTEM, USER, ANSWER]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c", "name": "x"}]}, "messages", [("user", "ab"), ("assistant", "c")]),
    ({"messages": [{"role": "assistant", "content": None}]}, "messages", [("assistant", "")]), ({"messages": []}, "messages", []),
    ({"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "speakers", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "p", "completion": ""}, "pair", [("user", "p"), ("assistant", "")]), ({"question": "q", "response": "r", "system": "s"}, "answer", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "x", "output": "y", "metadata": {"k": [1]}}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]), ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"role": "user", "text": "t"}, "turn", [("user", "t")]),
]


def test_each_layout_becomes_its_turns(spark):
    records = [(k, 0, json.dumps(r)) for k, (r, _, _) in enumerate(LAYOUTS)] + [(100, 0, "{"), (101, 0, None), (102, 0, '{"other": 1}'), (103, 0, "[1]"), (104, 0, "[" * 5000), (105, 0, '{"prompt": "\\ud800", "completion": "x"}')]
    turns = chat.canonical(spark.createDataFrame(records, "conv_id long, part long, record string"))
    got = {}
    for r in turns.orderBy("conv_id", "part", "position").collect():
        got.setdefault(r["conv_id"], []).append(r)
    for k, (_, layout, want) in enumerate(LAYOUTS):
        assert [(r["role"], r["text"]) for r in got.get(k, [])] == want and all(r["layout"] == layout and r["error"] is None for r in got.get(k, []))
    assert [got[k][0]["error"] for k in (100, 101, 102, 103, 104)] == ["no JSON", "no JSON", "no mapping", "no mapping", "no JSON"]
    assert got[105][0]["text"] == "�" and got[102][0]["fingerprint"] == chat.fingerprint(frozenset(["other:number"]))
    assert {r["error"] for r in chat.layouts(turns).collect()} == {None, "no JSON", "no mapping"}


def test_fingerprints_tell_paths_and_kinds_apart():
    of = lambda r: chat.fingerprint(chat.field_paths(r))
    assert of({"a": 1, "b": [{"c": "x"}, {"c": None}]}) == of({"b": [{"c": "y"}], "a": 2.5}) != of({"a": "1", "b": [{"c": "x"}]})
    assert of({"a.b": 1}) != of({"a": {"b": 1}}) and of({"a": {}}) != of({"a": []}) != of({}) and of({"id": 1, "a": True}) == of({"a": False})
    with pytest.raises(ValueError, match="same fields"):
        chat.dispatch([*chat.MAPPINGS, chat.Mapping("mine", (chat.Turn("=user", ("prompt",)),), ("prompt:string", "completion:string"))])


def test_marks_within_texts_are_escaped_and_come_back():
    g = random.Random(3)
    for _ in range(2000):
        t = "".join(g.choice(["<", "|", "\\", "im_end", ">", "\n", "é", "a", "\\n"]) for _ in range(g.randrange(12)))
        assert "<|" not in chat.escaped(t) and chat.unescaped(chat.escaped(t)) == t and chat.role_of(chat.role_line(t)) == t and "\n" not in chat.role_line(t)
    turns = [("user", "<|im_end|>\n<|im_start|>assistant\nno"), ("a\nb", "x<"), ("assistant", "<\\|im_end|>"), ("", "")]
    whole = "".join(f"{chat.START}{chat.role_line(r)}\n{chat.escaped(t)}{chat.END}\n" for r, t in turns)
    for size in (1, 3, 1000):
        reader = chat.Reader()
        assert [x for k in range(0, len(whole), size) for x in reader.feed(whole[k : k + size])] == turns and not reader.held


def wanted(rows):
    """By hand: digests of the rows of one conversation."""
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: ((x[0] is not None, x[0]), x[1] or "", x[2] or ""))]
    loss = "".join(t for r, t in turns if r == "assistant")
    long_ = sum(len(f"{chat.START}{chat.role_line(r)}\n{chat.escaped(t)}{chat.END}\n") for r, t in turns)
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), long_


def test_all_conversations_read_back(spark, tmp_path):
    """Nulls, ties, repeated rows, odd roles, one long conversation, a text of a million characters, columns with clashing names."""
    g = random.Random(9)
    rows = [(None, 0, "user", "no id"), (1, None, None, None), (1, 0, "assistant", None), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "x"), (3, 0, "user", "<|im_start|>"), (3, 1, "assistant", "é<\\|" * 250_000)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(3000)] + [(k, j, g.choice(["system", "user", "assistant", "tool\n"]), g.choice(["", "<|", "{\"a\": 1}", "ok"])) for k in range(5, 60) for j in range(g.randrange(1, 9))]
    rows += [(k, j, ("user", "assistant")[j % 2], f"{k}.{j}") for k in range(60, 90) for j in range(4)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(0).alias(c) for c in ("part", "layout", "block", "asked", "position", "segment", "t")])
    made.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    by = {}
    for c, *rest in [*rows, (-1, 0, "user", queries.INJECTED), (-1, 1, "assistant", queries.INJECTED)]:
        by.setdefault(c, []).append(rest)
    assert got == {c: wanted(x) for c, x in by.items()}
    turns = chat.canonical(queries.chat_records(spark.read.parquet(str(tmp_path / "conversations.parquet"))))
    assert {r["layout"] for r in turns.select("layout").distinct().collect()} == {"messages", "speakers", "pair", "answer", "instruction", "turn"} and turns.where("error is not null").count() == 0
    again = chat.digested(chat.rendered(turns).repartition(3))
    assert {r["conv_id"]: tuple(r)[1:] for r in again.collect()} == {c: x for c, x in got.items() if c != -1}


def test_no_conversations_but_the_planted_one(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_chat_format(spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(-1, 2, len(queries.INJECTED))]
