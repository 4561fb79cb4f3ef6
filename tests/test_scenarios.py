"""Small scenarios with the invariants that selection, sweep and filters must keep."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ctxsieve.config import SelectionConfig, keep_ratio
from ctxsieve.functions.text import last_json_object, marker_total
from ctxsieve.operators import admission, documents, freeze, messages, selection, sweep
from ctxsieve.operators.chunking import split_chunks

CFG = SelectionConfig()
QUESTION = "How does the zephyrite reactor cool down?"


def chunks_of(spark, text, least=4):
    return split_chunks(spark.createDataFrame([(text,)], "text string"), min_chunks=least).first().chunks


def select(spark, text, keep=0.6, query=QUESTION, cfg=CFG, embed=None):
    return selection.select_blocks(spark.createDataFrame([(1, text, query)], "block_id long, text string, query string"), keep, cfg, embed).first()


def passages(n, special=None, size=200):
    rows = [f"Passage {i} speaks about gardens and rivers. " + "filler words go on " * (size // 19) for i in range(n)]
    for i, text in (special or {}).items():
        rows[i] = text + " " + "padding text " * 12
    return "\n\n".join(r.strip() for r in rows)


@pytest.mark.parametrize("text, want", [
    ("alpha.\n\nbeta.\n\n\ngamma.", ["alpha.", "beta.", "gamma."]),
    ("intro\n## Head\nbody\n# Next\nmore", ["intro", "## Head\nbody", "# Next\nmore"]),
    ("[1] one cite [2] two cite", ["[1] one cite", "[2] two cite"]),
    ("top\n---\nrest", ["top", "---\nrest"]),
    ("One. Two! Three? Four.", ["One.", "Two!", "Three?", "Four."]),
    ("a\n\nb\n## ", ["a", "b", "##"]),
    ("x \x01 y\n\nz \x02 w", ["x \x01 y", "z \x02 w"]),
    ("", []),
])
def test_chunks(spark, text, want):
    assert chunks_of(spark, text) == want


def test_line_shapes(spark):
    numbered = "\n".join(f"{i}\t" + ("" if i % 5 == 0 else f"x = {i}") for i in range(1, 30))
    assert len(chunks_of(spark, numbered)) == 6
    assert chunks_of(spark, "diff --git a b\n@@ 1\n+a\n@@ 2\n+b\n@@ 3\n-c") == ["diff --git a b", "@@ 1\n+a", "@@ 2\n+b", "@@ 3\n-c"]
    assert len(chunks_of(spark, "\n".join(f"row {i}" for i in range(60)))) == 12
    assert len(chunks_of(spark, "{\n" + "\n".join(f"row {i}" for i in range(60)))) == 1


@pytest.mark.parametrize("text", ["a b. c d! e? f. g", "　wide. 　space! yes? no.", "tab\t. x\r\ny. z! w? q.", "é. ñ! ü? ß. 漢字。", "[9] x [10] y\n\n# h\n- i"])
def test_chunks_are_verbatim(spark, text):
    assert all(c in text for c in chunks_of(spark, text))


def test_guards_and_marker(spark):
    text = passages(8, {3: "The zephyrite core glows.", 5: "You must never open the valve."})
    row = select(spark, text, keep=0.25)
    assert row.changed and "zephyrite core" in row.new_text and "never open" in row.new_text
    assert row.new_text.startswith("Passage 0") and "Passage 7" in row.new_text
    assert row.n - row.kept == row.dropped > 0


def test_gates(spark):
    assert not select(spark, "short. text. is. left. alone.").changed
    assert not select(spark, passages(3)).changed
    assert not select(spark, passages(8), query="  ").changed
    assert not select(spark, passages(8), query=None).changed
    assert not select(spark, passages(8), keep=1.0).changed
    assert select(spark, None).new_text is None


def test_no_signal_leaves_the_budget(spark):
    row = select(spark, passages(8), keep=0.5, query="quantum entanglement")
    assert row.changed and row.kept == 5  # the first four, and the last


def test_half_even_budget(spark):
    got = spark.range(1).select(*(selection.budget(F.lit(n), F.lit(k)).alias(f"{n}_{i}") for i, (n, k) in enumerate([(5, 0.5), (7, 0.5), (4, 0.01), (4, 3.0)]))).first()
    assert list(got) == [2, 4, 1, 4]


def test_custom_marker_and_floor(spark):
    cfg = replace(CFG, min_message_chars=200, keep_lead_tail=False, drop_marker="[snip {n} |*]")
    row = select(spark, passages(6, {2: "The zephyrite reactor cools down.", 3: "zephyrite reactor cool facts."}), 0.5, cfg=cfg)
    assert "[snip 2 |*]" in row.new_text and row.new_text.count("snip") == row.runs
    total = spark.createDataFrame([(row.new_text,)], "t string").select(marker_total(F.col("t"), cfg.drop_marker)).first()[0]
    assert total == row.dropped


def test_own_embedder_and_negative_scores(spark):
    row = select(spark, passages(6), 0.5, embed=lambda texts: [[1.0, 0.0] if t.startswith("Passage 2") or t == QUESTION else [-1.0, 0.1] for t in texts])
    assert row.changed and "Passage 2" in row.new_text and row.kept == 3


def test_ratios():
    assert keep_ratio(CFG, "simple") == 0.45 and keep_ratio(CFG, "nonsense") == 0.55
    assert keep_ratio(CFG, "simple", 1.0) == pytest.approx(0.9) and keep_ratio(CFG.with_keep(0.1), "reasoning") == 0.1


def talk(spark, *rows):
    return spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(rows)], "conv_id long, msg_idx int, role string, content string")


def test_latest_user_message_stays(spark):
    big = passages(8)
    rows = talk(spark, ("user", big), ("assistant", big), ("tool", big), ("user", QUESTION + big))
    done = {r.msg_idx: r.changed for r in messages.trim_messages(rows).collect()}
    assert done == {0: True, 1: False, 2: True, 3: False}
    same = {r.new_content for r in messages.trim_messages(rows).where("changed").collect()}
    assert len(same) == 1
    summary = messages.trim_summary(messages.trim_messages(rows)).first()
    assert summary.changed and summary.chunks_dropped > 0 and summary.tokens_saved > 0


def test_json_parts(spark):
    import json

    big = passages(8)
    part = json.dumps([{"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": big, "x": 1}]}, {"type": "image", "data": "zz"}])
    rows = talk(spark, ("tool", part), ("tool", "not json"), ("tool", None), ("user", json.dumps(QUESTION)), ("user", json.dumps([{"type": "tool_result", "content": "later"}])))
    done = {r.msg_idx: r for r in messages.trim_parts(rows).collect()}
    new = json.loads(done[0].new_content)
    assert done[0].changed and "omitted" in new[0]["content"][0]["text"] and new[0]["content"][0]["x"] == 1 and new[1] == {"type": "image", "data": "zz"}
    assert [done[i].changed for i in (1, 2, 3, 4)] == [False] * 4 and done[1].new_content == "not json"


def test_freeze_replays_the_first_question(spark):
    text = passages(8, {2: "apples are red.", 5: "bridges are long."})
    rows = spark.createDataFrame([(1, text, "apples"), (2, text, "bridges"), (3, "tiny", "x")], "turn long, text string, query string")
    got = {r.turn: r.new_text for r in freeze.select_frozen(rows, 0.3).collect()}
    assert got[1] == got[2] and "apples" in got[1] and "bridges" not in got[2]
    none = spark.createDataFrame([], "block_key string, new_text string, changed boolean")
    _, made = freeze.with_decisions(rows.where("turn = 1"), none, 0.3)
    again, _ = freeze.with_decisions(rows.where("turn = 2"), made, 0.3)
    assert again.first().new_text == got[1]


def test_sweep_rules(spark):
    a, b = "a" * 500, "b" * 500
    rows = [
        (1, 0, "tool_use", "w1", "Write", "f", a), (1, 1, "tool_use", "r1", "Read", "f", None), (1, 2, "tool_result", "r1", None, None, b),
        (1, 3, "tool_result", "r1", None, None, b), (1, 4, "tool_use", "w2", "Write", "f", a), (1, 5, "tool_result", None, None, None, "c" * 500), (1, 6, "tool_result", "zz", None, None, "d" * 10),
    ]
    df = spark.createDataFrame(rows, "conv_id long, ord long, kind string, tool_use_id string, tool_name string, file_path string, body string")
    got = {r.ord: r for r in sweep.sweep(df).collect()}
    assert {k: v.reason for k, v in got.items()} == {0: "superseded", 1: None, 2: "stale", 3: "duplicate", 4: None, 5: None, 6: None}
    assert "f was rewritten" in got[0].new_body and got[4].new_body == a
    assert sweep.sweep(df, remaining_turns=1).where("reason is not null").count() <= 3
    assert sweep.sweep(df, remaining_turns=1000).where("reason is not null").count() == 3


def test_documents(spark):
    rows = [(1, i, p, QUESTION) for i, p in enumerate(passages(8, {4: "zephyrite reactor cool down"}).split("\n\n"))] + [(1, 8, " ", QUESTION), (2, 0, "alone", QUESTION)]
    df = spark.createDataFrame(rows, "set_id long, pos int, text string, query string")
    got = {(r.set_id, r.pos): r.kept for r in documents.select_documents(df, 0.3).collect()}
    assert got[1, 4] and got[1, 0] and got[1, 8] and got[2, 0] and not all(got.values())


def test_admission(spark):
    big = passages(8)
    rows = [(1, "Read", big, QUESTION, "Read x"), (2, "Write", big, QUESTION, ""), (3, "Read", "{" + big, QUESTION, ""), (4, "Read", None, None, None)]
    df = spark.createDataFrame(rows, "block_id long, tool string, text string, question string, arguments string")
    assert {r.block_id: r.envelope is not None for r in admission.admit(df, 0.4).collect()} == {1: True, 2: False, 3: False, 4: False}
    v = spark.sql("""SELECT parse_json('{"stdout": "", "output": "hi"}') AS a, parse_json('"plain"') AS b, parse_json('{"pattern": "p", "url": "u"}') AS i""")
    got = v.select(admission.output_text(F.col("a")), admission.output_text(F.col("b")), admission.arguments_text(F.lit("Grep"), F.col("i"))).first()
    assert list(got) == ["hi", "plain", "Grep p u"]


def test_last_json(spark):
    got = spark.createDataFrame([('x {"a": 1} y {bad} z',), ("none",)], "t string").select(last_json_object(F.col("t"))).collect()
    assert [r[0] for r in got] == ['{"a": 1}', None]
