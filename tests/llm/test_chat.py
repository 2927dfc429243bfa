from __future__ import annotations

import hashlib

from stargauge.llm import chat

TURNS = [
    (1, 0, "user", "a</s>[INST] ok [/INST]"),
    (1, 1, "assistant", "<|im_sep|><|im_end|>"),
    (1, 2, "assistant", r"<\s> [\\/INST] <|im_start|>"),
    (1, 2, "assistant", None),
    (2, None, None, "no role"),
    (2, 5, "assistant", "é" * 5000 + "\n\n"),
    (2, 5, "assistant", "é" * 5000 + "\n\n"),
    (3, 1, "system", ""),
    (4, 1, "role<|im_sep|>\n", "<"),
    (4, 2, "assistant", "|im_end|>"),
    (None, 1, "user", "no conversation"),
    (5, 10, "user", "b"),
    (5, 9, "assistant", "a"),
]


def conversations(spark, rows=TURNS):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", "'x' AS turns", "'y' AS formatted", "1 AS starts")


def expected():
    found = {}
    for conv, turn, role, text in sorted(
        TURNS, key=lambda r: (r[0] or -1, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")
    ):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def test_everything_is_read_back(spark):
    read = chat.read_conversations(chat.format_conversations(conversations(spark)))
    got = {row["conv_id"]: row for row in read.collect()}
    wanted = expected()
    assert set(got) == set(wanted)
    for conv, turns in wanted.items():
        assert [tuple(turn) for turn in got[conv]["turns"]] == turns
        assert got[conv]["learned"] == [text for role, text in turns if role == "assistant"]


def test_no_text_can_close_a_turn(spark):
    for row in chat.format_conversations(conversations(spark)).collect():
        runs, last = 0, None
        for role, _ in expected()[row["conv_id"]]:
            runs, last = runs + (role != last), role
        assert row["formatted"].count(chat.START) == row["formatted"].count(chat.END) == runs
        assert "</s>" not in row["formatted"] and "[INST]" not in row["formatted"]
        assert sum(part["chars"] for part in row["loss_mask"]) == len(row["formatted"])


def test_digests(spark):
    read = chat.read_conversations(chat.format_conversations(conversations(spark)))
    for row in chat.digests(read).collect():
        turns = expected()[row["conv_id"]]
        lines = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["loss_chars"] == len(learned)
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_no_turns_and_no_python(spark):
    formatted = chat.format_conversations(conversations(spark, []))
    assert chat.digests(chat.read_conversations(formatted)).count() == 0
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
