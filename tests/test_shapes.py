"""Queries over texts with delimiters and lines but few sentences: the SQL splits sentences only."""

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from ctxsieve.config import SelectionConfig
from ctxsieve.functions.single import split_text, trim_one
from ctxsieve.operators import selection
from ctxsieve.plans.catalogue import ORACLES, QUERIES

NAMES = (
    "admit_tool_output", "block_idf", "budget_topk", "dropped_runs", "freeze_decisions", "keep_sweep", "lexical_scores", "marker_accounting", "rare_entities", "replay_report",
    "replay_sessions", "select_embedded", "select_flagship", "selection_stats", "tokens_saved", "tier_keep", "stream_admit", "stream_decided",
)
WORDS = [f"{a}{b}{c}" for a in ("riv", "gar", "sto", "zeph") for b in ("er", "en", "on") for c in ("ia", "um", "as")]


def said(seed: int, n: int = 24) -> str:
    return " ".join(WORDS[(seed * 7 + i * i) % len(WORDS)] for i in range(n))


TEXTS = [
    "\n".join(said(i) for i in range(9)), "\n\n".join(f"{said(i)}. {said(i + 3)}" for i in range(7)), "\n".join(f"{i}\t{said(i)}" for i in range(30)), "\n## ".join(said(i) for i in range(8)),
    "[1] " + " [2] ".join(f"{said(i)}. {said(i + 1)}!\n{said(i + 2)}?" for i in range(5)), ". ".join(said(i) for i in range(9)), "@@ 1\n" + "\n@@ 2\n".join(said(i) for i in range(8)), "short\n\ntext\n\nof\n\nlines", "",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("shapes")), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, len(t)) for i, t in enumerate(TEXTS * 3)])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(i, said(i, 6) + " unheard?") for i in range(5)])
    for name in ("documents", "benchmark"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_whatever_the_shape(spark, tables, name):
    folder, con = tables
    assert compare.difference(QUERIES[name](spark, folder), con, ORACLES[name]) == ""


def test_operators_still_see_shapes(spark):
    """Without the setting, delimiters and lines make chunks, in tables as for single texts."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "block_id long, text string").withColumn("query", F.lit("zephonas unheard"))
    for shapes in (True, False):
        cfg = SelectionConfig(shapes=shapes)
        rows = selection.select_blocks(df, 0.6, cfg).collect()
        assert all(r.new_text == trim_one(r.text, r.query, 0.6, cfg) for r in rows)
        assert {r.block_id for r in rows if r.n} == ({0, 1, 2, 3, 4, 5, 6} if shapes else {1, 4, 5})
    assert len(split_text(TEXTS[0])) == 9 and len(split_text(TEXTS[0], shapes=False)) == 1
