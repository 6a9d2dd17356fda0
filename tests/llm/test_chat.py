from __future__ import annotations

import collections
import hashlib
import random

import pytest

from pregao.llm import chat, queries

from .test_hilbert import save

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", queries.FORGED_TEXT), (-1, 1, "assistant", queries.FORGED_TEXT)]:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def check(spark, folder, rows):
    out = queries.op8_typed_chat(spark, folder).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out}
    assert got == expected(rows) and len(out) == len(got)
    return {r["conv_id"]: r["formatted_chars"] for r in out}


def test_query_over_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    bits = ["<|", "|>", "\\", "\\n", "\n", "<\\|", "im_end", "<|im_end|>", "<|image:0|>", "é", "🙂", " ", "<", "|", "assistant", "\r"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "to\nol", "<|x|>", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))))
        for c in range(60)
        for t in range(rng.randint(1, 6))
    ]
    rows += [(100, 1, "assistant", None), (100, 0, "assistant", ""), (None, 0, "user", "x"), (101, None, "user", "y"), (101, 0, "assistant", "z")]
    rows += [(102, 0, "user", "same"), (102, 0, "user", "same"), (103, 0, "assistant", "long " * 50_000)]
    chars = check(spark, save(spark, tmp_path / "a", rows, SCHEMA, "conversations"), rows)
    assert chars[102] == 2 * len("<|im_start|>user\nsame<|im_end|>\n")
    check(spark, save(spark, tmp_path / "b", [], SCHEMA, "conversations"), [])


def test_query_on_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    check(spark, folder, rows)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
        want = db.execute(queries.oracle_sql()["op8_typed_chat"])
        columns = [(d[0], str(d[1])) for d in want.description]
        rows = want.fetchall()
    got = queries.op8_typed_chat(spark, folder)
    types = {"bigint": "BIGINT", "string": "VARCHAR"}
    assert sorted((c, types[t]) for c, t in got.dtypes) == sorted(columns)
    assert sorted(tuple(r[c] for c, _ in columns) for r in got.collect()) == sorted(rows)


def part(type_, **values):
    return {"type": type_, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | values


def test_parts_become_ordered_placeholders(spark):
    user = [part("text", text="<"), part("text", text="|look "), part("image", ref="a.png", width=57, height=28), part("document", ref="d.pdf", pages=3)]
    answer = [part("text", text="It "), part("audio", ref="s.wav", seconds=1.5), part("text", text="says\\"), part("other", text="!"), part("image")]
    rows = [(1, 0, "user", user), (1, 1, "assistant", answer), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    one, two = sorted(chat.formatted(df).collect(), key=lambda r: r["conv_id"])
    text = one["formatted"]
    assert text == (
        "<|im_start|>user\n<\\|look <|image:0|><|document:1|><|im_end|>\n"
        "<|im_start|>assistant\nIt <|audio:2|>says\\\\!<|image:3|><|im_end|>\n"
    )
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        (0, "image", "a.png", 3),
        (1, "document", "d.pdf", 1536),
        (2, "audio", "s.wav", 38),
        (3, "image", "", 1),
    ]
    assert all(text[a["at"] :].startswith(f"<|{a['type']}:{a['number']}|>") for a in one["attachments"])
    assert one["expanded_tokens"] == 3 + 1536 + 38 + 1
    assert [text[s["start"] : s["stop"]] for s in one["loss"]] == ["It ", "says\\\\!"]
    assert chat.parse(text) == [("user", ["<|look ", 0, "", 1, ""]), ("assistant", ["It ", 2, "says\\!", 3, ""])]
    assert two["formatted"] == "<|im_start|>user\n<|im_end|>\n" and two["attachments"] == []


def test_durations_that_are_no_number_count_as_none():
    sizes = [{"type": "audio", "seconds": x} for x in (float("nan"), float("inf"), float("-inf"), None, -3.0, 2.0)]
    _, _, found = chat.format_turns([("user", sizes)])
    assert [a.tokens for a in found] == [1, 1, 1, 1, 1, 2 * chat.AUDIO_TOKENS_A_SECOND]


def test_rows_without_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")] + [(None, i, "assistant", "x" * (i % 3)) for i in range(300)]
    out = queries.op8_typed_chat(spark, save(spark, tmp_path / "a", rows, SCHEMA, "conversations")).collect()
    alone = [(r["n_turns"], r["loss_chars"]) for r in out if r["conv_id"] is None]
    assert sorted(alone) == [(1, n) for n in range(3) for _ in range(100)]
    assert {r["conv_id"]: r["n_turns"] for r in out if r["conv_id"] is not None} == {1: 2, -1: 2}
