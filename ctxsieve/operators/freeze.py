"""Freeze on first sight: the first turn that shows a block decides it for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SelectionConfig
from .placing import placed
from .selection import select_blocks


def block_key(text: str = "text") -> Column:
    return F.substring(F.md5(text), 1, 12)


def first_sight(blocks: DataFrame, scope: str | None = None) -> DataFrame:
    """``blocks (turn, text, ...)`` with ``block_key`` and ``is_first`` within the scope."""
    keys = [scope] if scope else []
    window = Window.partitionBy(*keys, "block_key").orderBy("turn")
    return blocks.withColumn("block_key", block_key()).withColumn("is_first", F.row_number().over(window) == 1)


def select_frozen(blocks: DataFrame, keep: float = 0.6, cfg: SelectionConfig | None = None, scope: str | None = None) -> DataFrame:
    """``blocks (turn, text, query)`` with ``new_text, changed`` of each block's first turn.

    The key is the block alone, so a later question replays the first decision.
    """
    keys = [scope, "block_key"] if scope else ["block_key"]
    seen = first_sight(placed(blocks.withColumn("block_key", block_key()), *keys), scope)
    first = seen.where("is_first").withColumn("block_id", F.concat_ws(":", *(F.col(k).cast("string") for k in keys)))
    decided = select_blocks(first, keep, cfg).select(*keys, "new_text", "changed")
    return seen.join(decided, keys, "left")


def with_decisions(blocks: DataFrame, decisions: DataFrame, keep: float = 0.6, cfg: SelectionConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Replay a table of decisions ``(block_key, new_text, changed)`` and extend it by new blocks."""
    seen = first_sight(blocks)
    fresh = seen.where("is_first").join(decisions, "block_key", "left_anti").withColumn("block_id", F.col("block_key"))
    made = decisions.select("block_key", "new_text", "changed").unionByName(select_blocks(fresh, keep, cfg).select("block_key", "new_text", "changed"))
    return seen.join(made, "block_key", "left"), made


class Decisions:
    """A folder of decisions ``(block_key, new_text, changed)`` that later turns replay, and new blocks extend."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """All decisions; none before the first turn."""
        schema = "block_key string, new_text string, changed boolean"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(conf).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def get(self, text: str) -> DataFrame:
        """The decision about one block: a row, or none."""
        return self.table().where(F.col("block_key") == F.substring(F.md5(F.lit(text)), 1, 12))

    def __contains__(self, text: str) -> bool:
        return not self.get(text).isEmpty()

    def __len__(self) -> int:
        return self.table().count()

    def apply(self, blocks: DataFrame, keep: float = 0.6, cfg: SelectionConfig | None = None) -> DataFrame:
        """``blocks (turn, text, query)`` with what is decided about them; what is new is decided and written first."""
        known = self.table()
        fresh = first_sight(blocks).where("is_first").join(known, "block_key", "left_anti").withColumn("block_id", F.col("block_key"))
        select_blocks(fresh, keep, cfg).select("block_key", "new_text", "changed").write.mode("append").parquet(self.path)
        return first_sight(blocks).join(self.table(), "block_key", "left")
