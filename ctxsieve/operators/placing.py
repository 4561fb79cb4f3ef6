"""How many tasks work on blocks: in proportion to what is read, so that a task's memory doesn't grow with the input."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame

#: Bytes of files to a partition; its terms are rows that take some fifty times as much.
PART_BYTES = 4 << 20
#: Sizes beyond this are Spark's way to say that it knows none.
_UNKNOWN = 1 << 50


def read_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and rows that ``df`` reads, or None where Spark can't tell; no job runs."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    try:
        total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Py4JJavaError:
        return None
    return total if total < _UNKNOWN else None


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys``: into a partition for each ``PART_BYTES`` read, once they are more than the cores.

    Without a number, Spark joins small partitions again until each holds 64 MB of compressed
    texts, or as many as there are cores: what becomes of a text in its task is not seen then.
    """
    total, cores = read_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    parts = 0 if total is None else -(-total // PART_BYTES)
    return df.repartition(parts, *keys) if parts > cores else df.repartition(*keys)
