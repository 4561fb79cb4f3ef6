"""What a task or a key costs doesn't grow with the input."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from ctxsieve.functions.text import strip, strip_left, strip_right
from ctxsieve.operators import documents, freeze, messages, placing, selection
from ctxsieve.streaming.admission import _Live
from ctxsieve.streaming.freeze import _Decided, _FirstSight

LONG = " ".join(f"Sentence {i} speaks of {'rivers' if i % 3 else 'zephyrite'} and gardens, padding padding padding." for i in range(20))


def test_partitions_grow_with_what_is_read(spark, tmp_path, monkeypatch):
    """Twice the files, twice the partitions, in each operator that counts terms; the rows stay."""
    for n in (100, 200):
        rows = [(i, i // 4, i % 4, "user" if i % 4 == 3 else "tool", f"{LONG} {i * 7919} Ends {i}.", "zephyrite") for i in range(n)]
        spark.createDataFrame(rows, "block_id long, set_id long, pos long, role string, text string, query string").repartition(2).write.parquet(f"{tmp_path}/{n}")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    chat = lambda n: read(n).select(F.col("set_id").alias("conv_id"), F.col("pos").alias("msg_idx"), "role", F.col("text").alias("content"))
    runs = {
        "select_blocks": lambda n: selection.select_blocks(read(n).select("block_id", "text", "query")).select("block_id", "new_text"),
        "select_documents": lambda n: documents.select_documents(read(n).select("set_id", "pos", "text", "query")).select("set_id", "pos", "kept"),
        "select_frozen": lambda n: freeze.select_frozen(read(n).select(F.col("block_id").alias("turn"), "text", "query")).select("turn", "new_text"),
        "trim_messages": lambda n: messages.trim_messages(chat(n)).select("conv_id", "msg_idx", "new_content"),
    }
    plain = {name: {n: sorted(map(tuple, run(n).collect())) for n in (100, 200)} for name, run in runs.items()}
    monkeypatch.setattr(placing, "PART_BYTES", placing.read_bytes(read(100)) // 10)
    for name, run in runs.items():
        for n, least in ((100, 10), (200, 15)):
            df = run(n)
            assert df.rdd.getNumPartitions() >= least or name == "trim_messages", (name, n)
            assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString(), name
            assert sorted(map(tuple, df.collect())) == plain[name][n], name
    assert placing.placed(read(200), "block_id").rdd.getNumPartitions() > placing.placed(read(100), "block_id").rdd.getNumPartitions() >= 10
    assert placing.placed(spark.createDataFrame([(1,)], "block_id long"), "block_id").count() == 1


def test_white_space_as_the_pattern_has_it(spark):
    white = r"[\s\x1c-\x1f]"
    texts = [(f"{c}a{c}b{c}{c}",) for c in map(chr, [*range(1, 0x3100), 0xFEFF]) if not c.isalnum()] + [("",), (" \t",), (None,)]
    df, t = spark.createDataFrame(texts, "text string"), F.col("text")
    same = strip(t).eqNullSafe(F.regexp_replace(t, rf"(?U)^{white}+|{white}+$", "")) & strip_left(t).eqNullSafe(F.regexp_replace(t, rf"(?U)^{white}+", ""))
    assert df.where(~(same & strip_right(t).eqNullSafe(F.regexp_replace(t, rf"(?U){white}+$", "")))).count() == 0


class _State:
    """A value state that notes what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = tuple(value)


def _given(processor):
    state = _State()
    processor.init(type("Handle", (), {"getValueState": lambda self, *a: state})())
    return state


def test_few_calls_of_the_state_store():
    """Two for a new key, one for a known one; rows in any order get the first turn of the first batch."""
    first = _FirstSight()
    state = _given(first)
    batch = [Row(turn=5, query="b"), Row(turn=2, query="a")]
    assert [tuple(r) for r in first.handleInputRows(("k",), iter(batch), None)] == [("k", 2, 2, "a"), ("k", 5, 2, "a")] and state.calls == ["get", "update"]
    assert [tuple(r) for r in first.handleInputRows(("k",), iter([Row(turn=1, query="c")]), None)] == [("k", 1, 2, "a")] and state.calls == ["get", "update", "get"]

    decided = _Decided(0.5, None)
    state = _given(decided)
    out = list(decided.handleInputRows(("k",), iter([Row(turn=1, text=LONG, query="zephyrite"), Row(turn=0, text=LONG, query="zephyrite")]), None))
    assert [(r.turn, r.first_turn, r.changed) for r in out] == [(0, 0, True), (1, 0, True)] and out[0].new_text == out[1].new_text != LONG and state.calls == ["get", "update"]

    live = _Live()
    state = _given(live)
    batch = [Row(ord=3, question=None), Row(ord=1, question="one?"), Row(ord=2, question=" ")]
    assert [tuple(r) for r in live.handleInputRows(("s",), iter(batch), None)] == [("s", i, "one?") for i in (1, 2, 3)] and state.calls == ["get", "update"]
    assert [r.live_question for r in live.handleInputRows(("s",), iter([Row(ord=4, question=None)]), None)] == ["one?"] and state.calls == ["get", "update", "get"]
