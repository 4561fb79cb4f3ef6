"""Adapters, streams, transcripts, evaluation, the command line, and what is left as it is when something fails."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from ctxsieve import __main__ as cli
from ctxsieve.config import SelectionConfig, from_conf, keep_column
from ctxsieve.functions import calls, embedders, sql
from ctxsieve.functions.single import split_text, trim_one
from ctxsieve.operators import admission, documents, evaluation, freeze, messages, scoring, selection, sweep
from ctxsieve.operators.chunking import split_chunks
from ctxsieve.sources import transcripts

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"Sentence {i} speaks of {'rivers' if i % 3 else 'zephyrite'} and gardens, padding padding padding." for i in range(20))
SHAPES = [
    LONG, "\n\n".join(f"[{i}] passage {i} " + "word " * 30 for i in range(9)), "\n".join(f"{i}\t" + ("" if i % 5 == 0 else f"x = {i} zephyrite") for i in range(1, 90)),
    "diff --git a b\n" + "\n".join(f"@@ {i}\n+line {i} " + "y" * 90 for i in range(12)), "\n".join(f"row {i} of the long table of rivers" for i in range(60)), "{" + LONG.replace(". ", "\n"),
    "# Head\n" + "\n## Next\n".join("body text " * 12 for _ in range(8)), "東京 は 大きい。" * 90 + LONG, "a\n---\nb\n---\n" + LONG, LONG.replace("gardens", "you must never"),
]


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "block_id long, text string, query string")


def test_single_texts_as_tables(spark):
    texts = SHAPES + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    query = "Where is zephyrite, and what do rivers and the gardens do in 東京?"
    df = blocks_of(spark, [(i, t, query) for i, t in enumerate(texts)])
    for keep in (0.3, 0.6):
        for r in selection.select_blocks(df, keep).collect():
            assert r.new_text == trim_one(r.text, query, keep), r.block_id
    for r in split_chunks(df).collect():
        assert list(r.chunks) == split_text(r.text), r.block_id


def test_sql_functions_of_single_texts(spark):
    sql.register(spark)
    blocks_of(spark, [(1, LONG, "zephyrite"), (2, None, "q"), (3, "short", "q")]).createOrReplaceTempView("asked")
    got = {r.block_id: r for r in spark.sql("SELECT block_id, trim_text(text, query, 0.5D) AS t, split_chunks(text, 4) AS c FROM asked").collect()}
    assert got[1].t == trim_one(LONG, "zephyrite", 0.5) != LONG and got[2].t is None and got[3].t == "short" and len(got[1].c) == 20


def test_every_request_is_answered(spark):
    rows = [(i % 60, LONG, "zephyrite", 0.25 + i / 200, "trim") for i in range(100)] + [(7, None, "q", None, "trim"), (8, "t", "q", 7.0, "trim"), (9, "t", "q", None, "cut"), (10, "t", "q", None, "trim")]
    got = sql.trim_texts(spark.createDataFrame(rows, "id long, text string, query string, keep double, method string")).collect()
    assert len(got) == 104 and sorted(r.error for r in got if r.error) == [-32602, -32602, -32601]
    assert sorted(r.text for r in got if r.error is None and r.text != "t") == sorted(trim_one(LONG, "zephyrite", r[3]) for r in rows[:100])


@pytest.mark.parametrize("query", ["\n\t", " ", "", None])
def test_blank_questions_change_nothing(spark, query):
    assert not selection.select_blocks(blocks_of(spark, [(1, LONG, query)])).first().changed


def test_shared_block_ids_fail(spark):
    with pytest.raises(Exception, match="block ids repeat"):
        selection.select_blocks(blocks_of(spark, [(1, LONG, "zephyrite"), (1, LONG + " More.", "zephyrite")])).collect()


def test_embedder_failures_leave_blocks(spark):
    def moody(texts):
        if "gardens" in texts[0]:
            raise RuntimeError("down")
        return [[float(len(t)), 1.0] for t in texts]

    other = LONG.replace("gardens", "meadows")
    got = {r.block_id: r for r in selection.select_blocks(blocks_of(spark, [(1, LONG, "q?"), (2, other, "q?")]), 0.3, embed=moody).collect()}
    assert not got[1].changed and got[1].new_text == LONG and got[2].changed
    short = selection.select_blocks(blocks_of(spark, [(1, LONG, "q?")]), 0.3, embed=lambda texts: [[1.0]]).first()
    assert not short.changed

    async def later(texts):
        return []

    for bad in (later, None and later, 3):
        if bad is not None:
            with pytest.raises(TypeError):
                selection.select_blocks(blocks_of(spark, []), embed=bad)


def test_vectors_by_kind(spark):
    bags = lambda texts: [{w: 1.0 for w in t.lower().split()} for t in texts]
    row = selection.select_blocks(blocks_of(spark, [(1, LONG, "zephyrite")]), 0.3, embed=bags).first()
    assert row.changed and row.new_text.count("zephyrite") >= 6
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], [3.0, 0.0])], "v array<array<double>>, q array<double>")
    assert df.select(scoring.vector_scores(F.col("v"), F.col("q"))).first()[0] == [1.0, 0.0, 0.0]


def test_endpoint_in_batches(spark):
    sizes = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            sizes.append((len(asked["input"]), self.headers["Authorization"], asked["model"]))
            rows = [{"index": i, "embedding": [float(t.count("zephyrite")), 1.0]} for i, t in enumerate(asked["input"])]
            body = json.dumps({"data": rows[::-1]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("ctxsieve.embedder.url", f"http://127.0.0.1:{server.server_port}/v1")
    spark.conf.set("ctxsieve.embedder.batch", "8")
    row = selection.select_blocks(blocks_of(spark, [(1, LONG, "zephyrite")]), 0.3, embed=embedders.from_conf(spark)).first()
    spark.conf.unset("ctxsieve.embedder.url")
    server.shutdown()
    assert row.changed and [s[0] for s in sizes] == [8, 8, 5] and sizes[0][1] == "Bearer EMPTY" and embedders.from_conf(spark) is None


def test_local_encoder_is_loaded_once():
    loaded = []

    class Model:
        def encode(self, texts, normalize_embeddings, show_progress_bar):
            return [[float(len(t))] for t in texts]

    encoder = embedders.LocalEncoder("m", load=lambda name, trust: loaded.append((name, trust)) or Model())
    assert encoder(["ab", "c"]) == [[2.0], [1.0]] and encoder(["d"]) == [[1.0]] and loaded == [("m", False)]


def lines_of(spark, folder, rows):
    (folder / "t.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")
    return transcripts.json_lines(spark, str(folder / "t.jsonl"))


def test_real_transcripts(spark, tmp_path):
    part = lambda t: [{"type": "text", "text": t}, {"type": "image"}, {"type": "text", "text": "again"}]
    use = lambda i, name="Read": {"message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": name, "input": {"file_path": "f" * 300}}]}}
    result = lambda i, content, **more: {"message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": content}]}, **more}
    rows = [{"message": {"role": "user", "content": part("first")}}, use("a"), "broken {", result("a", "plain"), result("a", "told", toolUseResult={"stdout": "structured"}),
            result("a", "kept", toolUseResult={"n": 1}), result("zzz", "nobody asked"), {"message": {"role": "user", "content": " \n\t"}}, use("b", "Grep"), result("b", [{"type": "text", "text": "listed"}])]
    lines = lines_of(spark, tmp_path, rows)
    got = [(r.tool, r.text, r.question, len(r.arguments)) for r in transcripts.replay_outputs(lines).orderBy("block_id").collect()]
    assert got == [("Read", "plain", "first again", 205), ("Read", "structured", "first again", 205), ("Read", "kept", "first again", 205)]
    assert transcripts.latest_question(lines).first().question == "first again"
    assert transcripts.latest_question(lines, 9).first().question is None  # broken lines count


def test_sweep_on_messages(spark):
    body = "x" * 500
    write = lambda i, text: [{"type": "tool_use", "id": i, "name": "Write", "input": {"file_path": "f", "content": text, "é": 1}}]
    told = lambda i, content: [{"type": "tool_result", "tool_use_id": i, "content": content}]
    rows = [write("a", body), told("a", [{"type": "text", "text": body}, {"type": "text", "text": "z"}]), write("b", "new"), told("b", body + "\nz"), "plain text", told("c", "y" * 500)]
    df = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(rows)], "conv_id long, msg_idx long, content string")
    got = {r.msg_idx: (json.loads(r.new_content), r.tokens_saved) for r in sweep.sweep_messages(df).collect()}
    first, marker = got[0][0][0], sweep.MARKERS["superseded"].replace("{path}", "f")
    assert first["input"] == {"file_path": "f", "content": marker, "é": 1} and got[1][0][0]["content"] == marker and got[3][0][0]["content"] == sweep.MARKERS["duplicate"]
    assert [got[i][0] for i in (2, 4, 5)] == [rows[2], rows[4], rows[5]]
    size = lambda x: len(json.dumps(x, sort_keys=True)) // 4
    assert got[0][1] == size(rows[0][0]["input"]) - len(json.dumps(first["input"], sort_keys=True, ensure_ascii=False).replace("é", "\\u00e9")) // 4
    assert got[1][1] == (502 // 4) - len(marker) // 4
    assert all(json.loads(r.new_content) == rows[r.msg_idx] for r in sweep.sweep_messages(df, remaining_turns=1).collect())


def test_judged_pairs(spark):
    pairs = spark.createDataFrame([(f"q{i}", "full", "cut") for i in range(20)], "question string, answer_full string, answer_selected string")
    seen = evaluation.shown(pairs)
    reply = F.when(F.col("answer_a") == "full", '{"a_grade":"correct","b_grade":"incorrect","materially_worse":true,"worse_answer":"B"}').otherwise(
        '{"a_grade":"incorrect","b_grade":"correct","materially_worse":true,"worse_answer":"A"}')
    got = evaluation.unblinded(seen.withColumn("reply", reply)).collect()
    assert {r.answer_a for r in got} == {"full", "cut"} and all((r.grade_full, r.grade_selected, r.materially_worse) == ("correct", "incorrect", True) for r in got)
    one = spark.createDataFrame([('x {"grade": "partial", "reason": "r"}',), ('{"grade": "great"}',), (None,)], "reply string").select(evaluation.single_verdict(F.col("reply")).alias("v")).collect()
    assert [r.v.grade for r in one] == ["partial", None, None]
    titles = spark.createDataFrame([(["a b", "c d", "a b"], "[1] a b: text")], "t array<string>, c string").select(evaluation.gold_titles(F.col("t"), F.col("c"))).first()[0]
    assert titles == ["a b"]


def test_walk_goes_round(spark):
    pool = spark.createDataFrame([(f"t{i:02}", "x" * 37) for i in range(10)], "title string, text string")
    own = spark.createDataFrame([("q", 0, "t03", "own"), ("r", 0, "none", "own")], "question string, pos int, title string, text string")
    rows = evaluation.padded(own, pool, 60).collect()
    for q in "qr":
        got = [r.title for r in sorted((r for r in rows if r.question == q and r.pos), key=lambda r: r.pos)]
        at = [int(t[1:]) for t in got]
        assert len(got) == 6 and "t03" not in (got if q == "q" else []) and all((b - a) % 10 in ((1, 2) if q == "q" else (1,)) for a, b in zip(at, at[1:]))


def test_calls_are_repeated():
    waits, left = [], [429, 503]

    def call(system, prompt):
        if left:
            raise calls.CallFailed(left.pop(0))
        return prompt.upper(), False

    assert calls.with_retries(call, "s", "hi", sleep=waits.append) == ("HI", False) and waits == [5, 6]
    with pytest.raises(calls.CallFailed):
        calls.with_retries(lambda s, p: (_ for _ in ()).throw(calls.CallFailed(400)), "s", "x", sleep=waits.append)


def test_answers_of_a_model(spark):
    prompts = spark.createDataFrame([("q", "g", "a", "b")], "q string, g string, a string, b string").select(calls.judge_prompt(F.col("q"), F.col("g"), F.col("a"), F.col("b")).alias("prompt"))
    got = calls.answered(prompts, calls.JUDGE_SYSTEM, lambda system, prompt: (f" {prompt} ", True)).first()
    assert got.reply == "QUESTION:\nq\n\nREFERENCE:\ng\n\nANSWER A:\na\n\nANSWER B:\nb" and got.reply_truncated


def test_decisions_last(spark, tmp_path):
    kept = freeze.Decisions(spark, str(tmp_path / "made"))
    turns = lambda *rows: spark.createDataFrame(rows, "turn long, text string, query string")
    assert len(kept) == 0 and LONG not in kept
    one = kept.apply(turns((1, LONG, "zephyrite"))).first()
    two = kept.apply(turns((2, LONG, "rivers"), (3, LONG + " Late.", "rivers"))).orderBy("turn").collect()
    assert one.changed and two[0].new_text == one.new_text and LONG in kept and len(kept) == 2


def test_later_turns_change_no_earlier_output(spark):
    """With decisions frozen, what a conversation was trimmed to stays a prefix of what it becomes."""
    turns = [(i, LONG.replace("gardens", f"gardens{i % 3}"), f"question {i} about zephyrite" if i % 2 else "rivers") for i in range(6)]
    before: list = []
    for n in range(1, 7):
        df = spark.createDataFrame(turns[:n], "turn long, text string, query string")
        after = [r.new_text for r in freeze.select_frozen(df).orderBy("turn").collect()]
        assert after[: len(before)] == before
        before = after


def test_nodes_and_documents(spark):
    rows = [(1, i, f"Passage {i} " + ("zephyrite " if i == 2 else "") + "speaks of rivers. " * 15, {"k": "zephyrite" if i == 5 else "v"}, "zephyrite") for i in range(8)] + [(2, i, "text " * 60, {"k": "v"}, None) for i in range(4)]
    nodes = spark.createDataFrame(rows, "set_id long, pos long, text string, metadata map<string,string>, query string")
    plain = {(r.set_id, r.pos) for r in documents.postprocess_nodes(nodes, 0.3).collect()}
    assert {(2, i) for i in range(4)} <= plain and (1, 2) in plain and len(plain) < 12
    every = documents.postprocess_nodes(nodes, 0.3, "all")
    assert every.columns == nodes.columns and (1, 5) in {(r.set_id, r.pos) for r in every.collect()}
    assert documents.compress_documents(nodes.drop("metadata").where("false")).count() == 0


def test_settings_and_tiers(spark):
    assert from_conf(spark) == (0.8, SelectionConfig(), True)
    for k, v in (("ctxsieve.keep", "0.7"), ("ctxsieve.minChars", "100"), ("ctxsieve.disable", "1")):
        spark.conf.set(k, v)
    keep, cfg, on = from_conf(spark)
    for k in ("ctxsieve.keep", "ctxsieve.minChars", "ctxsieve.disable"):
        spark.conf.unset(k)
    assert (keep, cfg.min_message_chars, on) == (0.7, 100, False)
    df = spark.createDataFrame([("simple", None), ("other", None), (None, None), ("simple", 0.9)], "tier string, c double")
    assert [round(r[0], 4) for r in df.select(keep_column(SelectionConfig(), F.col("tier"), F.col("c"))).collect()] == [0.45, 0.55, 0.55, 0.84]
    name, trim = selection.make_selection_transform(tier=F.col("tier"))
    out = blocks_of(spark, [(1, LONG, "quantum"), (2, LONG, "quantum")]).withColumn("tier", F.when(F.col("block_id") == 1, "simple").otherwise("reasoning")).transform(trim)
    out, seen = selection.observed(out)
    kept = {r.block_id: r.kept for r in out.collect()}
    assert name == "context_selection" and kept[1] < kept[2] and seen.get["blocks"] == 2 and seen.get["chunks_kept"] == sum(kept.values())


def test_command_line(spark, tmp_path, capsys):
    rows = [{"role": "tool", "content": LONG}, {"role": "user", "content": "zephyrite"}]
    (tmp_path / "in.json").write_text(json.dumps({"messages": rows, "keep": 0.3}))
    cli.run(cli.parser().parse_args(["trim", str(tmp_path / "in.json"), str(tmp_path / "out"), "--pretty"]), spark)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    out = json.loads(text)
    assert "\n" in text.strip() and json.loads(out[0]["content"]) == trim_one(LONG, "zephyrite", 0.3) and "2 messages" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.run(cli.parser().parse_args(["trim", "a", "b", "--keep", "3"]), spark)
    lines_of(spark, tmp_path, [{"message": {"role": "user", "content": "zephyrite"}}, {"message": {"role": "assistant", "content": [{"type": "tool_use", "id": "a", "name": "Read", "input": {}}]}},
                               {"message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": LONG}]}}])
    cli.run(cli.parser().parse_args(["replay", str(tmp_path / "t.jsonl")]), spark)
    assert "0.6" in capsys.readouterr().out


def test_golden_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a")], "x long, y string")
    transcripts.write_golden(df, str(tmp_path / "g"))
    assert transcripts.golden_differences(df, str(tmp_path / "g")).isEmpty()
    got = transcripts.golden_differences(df.dropDuplicates(), str(tmp_path / "g")).collect()
    assert [(r.value, r.side) for r in got] == [('{"x":1,"y":"a"}', "golden")]


def test_transform_of_messages(spark):
    df = spark.createDataFrame([(1, 0, "tool", LONG), (1, 1, "user", "zephyrite")], "conv_id long, msg_idx long, role string, content string")
    name, trim = messages.make_transform(0.3)
    assert name == "ctxsieve" and [r.changed for r in df.transform(trim).orderBy("msg_idx").collect()] == [True, False]
    out = admission.admit(spark.createDataFrame([(1, "Read", LONG, "zephyrite", "x")], "block_id long, tool string, text string, question string, arguments string"), 0.3).first()
    assert json.loads(out.envelope)["hookSpecificOutput"]["updatedToolOutput"] == out.updated
