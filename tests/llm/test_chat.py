"""Event folding and reversible rendering."""

from llm import chat

SCHEMA = "conv_id long, seq long, turn long, role string, kind string, text string, formatted string"


def folded(spark, rows):
    out = chat.fold(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    return sorted((r["conv_id"] or 0, r["turn"] or 0, r["role"], r["text"]) for r in out)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "user", "message", "helo"), (1, 5, 0, "user", "edit", "hello"),
        (1, 2, 1, "assistant", "delta", "Hi"), (1, 3, 1, "assistant", "delta", " there"), (1, 4, 1, "assistant", "delta", None),
        (2, 1, 0, "user", "message", "q"), (2, 2, 1, "assistant", "delta", "bad"), (2, 3, 2, "user", "message", "gone"),
        (2, 4, 1, "assistant", "regenerate", None), (2, 5, 1, "assistant", "delta", "go"), (2, 6, 1, "assistant", "delta", "od"),
        (2, 7, 2, "user", "message", "kept"),
    ]
    want = [(1, 0, "user", "hello"), (1, 1, "assistant", "Hi there"), (2, 0, "user", "q"), (2, 1, "assistant", "good"), (2, 2, "user", "kept")]
    assert folded(spark, rows) == want == folded(spark, rows[::-1])


def test_unknown_kinds_nulls_and_repeats(spark):
    rows = [(None, None, None, None, None, None), (1, 1, 0, "user", "note", "a"), (1, 1, 0, "user", "note", "a")]
    assert folded(spark, rows) == [(0, 0, None, ""), (1, 0, "user", "a")]
    assert folded(spark, []) == []


TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "<s>", "\\", "<\\s>", "<\\\\s>", "[\\/INST]", "<</s>>", "\\\\[INST]\\", "a\n\n", "é👍<s>", "[INST", "x" * 70_000]


def test_every_text_and_role_comes_back(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["assistant", "user", "</s>", None, "assistant\\"])
            for t, text in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.render(df)).collect()
    assert len(out) == 5
    for r in out:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["formatted"].count("</s>") == len(own) == r["formatted"].count("<s>")
        assert r["loss_text"] == "".join(text for role, text in own if role == "assistant")
        assert len(r["loss_spans"]) == sum(role == "assistant" for role, _ in own)


def test_rows_of_a_table_are_messages_each(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 0, "user", "a"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.parse(chat.format_chats(chat.as_events(df))).collect()}
    assert out == {1: [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.format_chats(chat.as_events(df)))
    assert "Python" not in out._jdf.queryExecution().toString() and out.count() == 0
