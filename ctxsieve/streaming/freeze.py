"""Streaming freeze on first sight, and exact LRU over the decided blocks of a scope."""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..workers import ship

# The process that starts a stateful query gets no shipped files, so the processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _FirstSight(StatefulProcessor):
    """Keeps the first turn and its query of a block; later turns get them again.

    Most blocks are seen once, so it takes rows, as a table of one row costs more than its
    state, and asks the state store once for a known block and twice for a new one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "turn long, query string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = sorted(((r["turn"], r["query"]) for r in rows), key=lambda r: r[0])
        first = self.first.get()
        if first is None:
            first = seen[0]
            self.first.update(first)
        for turn, _ in seen:
            yield Row(block_key=key[0], turn=turn, first_turn=first[0], first_query=first[1])

    def close(self) -> None:
        pass


class _Recent(StatefulProcessor):
    """Exact LRU of ``size`` blocks per scope; an evicted block is decided anew."""

    size = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "block_key string", "turn long, used long")
        self.clock = handle.getValueState("clock", "now long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("turn", kind="stable")
        now = self.clock.get()[0] if self.clock.exists() else 0
        held = {k[0]: [int(v[0]), int(v[1])] for k, v in self.known.iterator()}
        out = []
        for turn, block in zip(pdf["turn"], pdf["block_key"]):
            now += 1
            if block not in held:
                if len(held) >= self.size:
                    old = min(held, key=lambda k: held[k][1])
                    del held[old]
                    if self.known.containsKey((old,)):
                        self.known.removeKey((old,))
                held[block] = [int(turn), now]
            held[block][1] = now
            out.append((key[0], block, int(turn), held[block][0]))
        for k, (turn, used) in held.items():
            self.known.updateValue((k,), (turn, used))
        self.clock.update((now,))
        yield pd.DataFrame(out, columns=["scope", "block_key", "turn", "first_turn"])

    def close(self) -> None:
        pass


class _Decided(StatefulProcessor):
    """Keeps the text that the first turn decided for a block; later turns get it byte for byte."""

    def __init__(self, keep: float, cfg) -> None:
        self.keep, self.cfg = keep, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getValueState("made", "turn long, new_text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        from ctxsieve.functions.single import trim_one

        seen = sorted(rows, key=lambda r: r["turn"])
        made = self.made.get()
        if made is None:
            first = seen[0]
            try:
                new = trim_one(first["text"], first["query"], self.keep, self.cfg)
            except Exception:
                logging.getLogger("ctxsieve").warning("a block is left as it is", exc_info=True)
                new = first["text"]
            made = (first["turn"], new)
            self.made.update(made)
        for r in seen:
            yield Row(block_key=key[0], turn=r["turn"], first_turn=made[0], new_text=made[1], changed=r["text"] != made[1])

    def close(self) -> None:
        pass


def decided_stream(blocks: DataFrame, keep: float = 0.6, cfg=None) -> DataFrame:
    """``block_key, turn, first_turn, new_text, changed`` of a stream of ``turn, text, query``."""
    ship(blocks.sparkSession)
    keyed = blocks.select(F.substring(F.md5("text"), 1, 12).alias("block_key"), F.col("turn").cast("long").alias("turn"), "text", "query")
    return keyed.groupBy("block_key").transformWithState(
        _Decided(keep, cfg), "block_key string, turn long, first_turn long, new_text string, changed boolean", "Append", "None")


def frozen_stream(blocks: DataFrame) -> DataFrame:
    """``block_key, turn, first_turn, first_query`` of a stream of ``turn, text, query``."""
    keyed = blocks.select(F.substring(F.md5("text"), 1, 12).alias("block_key"), F.col("turn").cast("long").alias("turn"), "query")
    return keyed.groupBy("block_key").transformWithState(
        _FirstSight(), "block_key string, turn long, first_turn long, first_query string", "Append", "None")


def recent_stream(blocks: DataFrame, size: int = 4096) -> DataFrame:
    """``scope, block_key, turn, first_turn`` of a stream of ``scope, turn, text``."""
    processor = type("Recent", (_Recent,), {"size": size})()
    keyed = blocks.select("scope", F.substring(F.md5("text"), 1, 12).alias("block_key"), F.col("turn").cast("long").alias("turn"))
    return keyed.groupBy("scope").transformWithStateInPandas(processor, "scope string, block_key string, turn long, first_turn long", "Append", "None")
