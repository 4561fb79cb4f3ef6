"""Sources, SQL functions and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from ctxsieve.functions import sql
from ctxsieve.sources import transcripts
from ctxsieve.streaming.freeze import recent_stream


def test_transcripts(spark, tmp_path):
    lines = [
        {"message": {"role": "user", "content": "first question"}},
        {"message": {"role": "assistant", "content": [{"type": "tool_use", "id": "a", "name": "Read", "input": {"file_path": "f"}}]}},
        {"message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": "body"}]}},
        {"message": {"role": "user", "content": "second question"}},
    ]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.jsonl").write_text("\n".join(map(json.dumps, lines[:2])) + "\nbroken {\n" + "\n".join(map(json.dumps, lines[2:])))
    (tmp_path / "s/two.jsonl").write_text("{}")
    rows = transcripts.json_lines(spark, str(tmp_path / "s/one.jsonl"))
    assert rows.count() == 4 and transcripts.latest_question(rows).first().question == "second question"
    got = transcripts.tool_results(rows).select("tool", F.to_json("response").alias("r"), "question").first()
    assert (got.tool, got.r, got.question) == ("Read", '"body"', "first question")
    assert transcripts.largest_per_folder(spark, str(tmp_path / "s"), 5).count() == 1


def test_message_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": [{"type": "text", "text": "x"}]}]}))
    got = transcripts.read_messages(spark, str(path)).orderBy("msg_idx").collect()
    assert [(r.role, r.content) for r in got] == [("user", '"hi"'), ("tool", '[{"text":"x","type":"text"}]')]
    path.write_text("{}")
    with pytest.raises(Exception, match="array of messages"):
        transcripts.read_messages(spark, str(path)).collect()


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT approx_tokens('12345678'), split_sentences(' One. Two! '), cosine(array(1D, 0D), array(1D, 1D))").first()
    assert got[0] == 2 and got[1] == ["One.", "Two!"] and abs(got[2] - 0.5**0.5) < 1e-9
    requests = spark.createDataFrame([(1, "text", "q", None), (2, None, "q", None), (3, "t", "q", 7.0)], "id long, text string, query string, keep double")
    assert {r.id: r.error for r in sql.trim_texts(requests).collect()} == {1: None, 2: -32602, 3: -32602}


def test_recent_blocks_are_evicted_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    spark.createDataFrame(rows, "scope string, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("scope string, turn long, text string").parquet(str(tmp_path / "in"))
    query = recent_stream(source, 2).writeStream.format("memory").queryName("recent").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.turn: r.first_turn for r in spark.table("recent").collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}
