"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

__all__ = ["BATCH", "FEW", "counted", "cut", "ensure_checkpoint_dir", "keyed", "numbered", "release", "ship", "small", "unused"]

#: Rows that are broadcast at most, where their number has been counted: 4 MB.
FEW = 60_000
#: Rows of an Arrow batch of whole texts.
BATCH = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ctxsieve-checkpoint-"))


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    ``batch`` bounds the rows of an Arrow batch meanwhile, which bounds the memory that
    whole texts take in workers and in the executor's buffers for them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if batch is None:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, min(batch, int(before)) if int(before) > 0 else batch)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_BATCH_KEY, before)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` of ``df``, and its number of rows, taken on the way."""
    seen = Observation()
    done = cut(df.observe(seen, F.count("*").alias("n")))
    return done, seen.get["n"]


def small(df: DataFrame, n: int) -> DataFrame:
    """``df``, to be broadcast if ``n`` rows of some 16 to 64 bytes are few: no shuffle then, nor a hot key in one."""
    return F.broadcast(df) if n <= FEW else df


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of steps that nothing refers to.

    Its cleaner acts on collected garbage, and a driver with room to spare rarely collects.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` can't have."""
    return f"_{name}_{uuid.uuid4().hex}"


def _repeats(df: DataFrame) -> bool:
    """Whether every plan over ``df`` deals its rows out alike, whatever runs in between.

    True for projections and filters of one file scan that is so large that the split
    size is ``spark.sql.files.maxPartitionBytes``, whatever the number of executors.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation") and plan.nodeName() != "Relation":
        return False
    session = df.sparkSession._jsparkSession
    split = session.sessionState().conf().filesMaxPartitionBytes()
    cores = max(1, session.leafNodeDefaultParallelism())
    size = str(plan.stats().sizeInBytes())
    return int(size) // cores > split


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long in a new column ``name`` that is the same wherever it is read.

    Ids follow the place of a row.  A join, a shuffle or a small scan may deal rows out
    otherwise when it runs again, so anything but a large file scan is written first.
    """
    out = df.withColumn(name, F.monotonically_increasing_id())
    return out if _repeats(df) else cut(out)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, doc_id, text)``: one row per input row, under a key that no other row has.

    The key is the same wherever the result is read, as ``numbered`` ensures.
    """
    return numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "row_id").select("row_id", "doc_id", "text")
