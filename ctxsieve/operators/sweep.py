"""Sweep of tool transcripts: payloads that later writes or copies make dead."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CACHE_READ, CACHE_WRITE, FULL_WRITE_TOOLS, MUTATING_TOOLS
from ..functions.text import approx_tokens
from ..workers import ship

# What replaces a dead payload, by reason.
MARKERS = {
    "superseded": "[… body omitted: {path} was rewritten later in this conversation, so this is not its current content — read the file if you need it …]",
    "stale": "[… read omitted: {path} was modified after this read, so this is not its current content — read the file again if you need it …]",
    "duplicate": "[… identical to an earlier tool result in this conversation …]",
}


def classify(parts: DataFrame, min_chars: int = 400) -> DataFrame:
    """``parts`` with ``reason`` (null: alive) and ``target_path``.

    ``parts`` has ``conv_id, ord, kind`` (tool_use or tool_result), ``tool_use_id, tool_name,
    file_path, body``; results take name and path from the last call of their id.  A call's
    body dies by a later full write of its path; a result dies as the copy of an earlier
    body, else as a read before a change of its path, else as a change before a full write.
    """
    # rows without an id, a path or a body to compare meet nothing; a key of their own spreads them
    alone = F.concat(F.lit("\0"), F.to_json(F.struct("ord")))
    calls = parts.where((F.col("kind") == "tool_use") & F.col("tool_use_id").isNotNull()).groupBy("conv_id", F.col("tool_use_id").alias("_call")).agg(
        F.max_by(F.struct("tool_name", "file_path"), "ord").alias("call"))
    joined = parts.withColumn("_call", F.coalesce("tool_use_id", alone)).join(calls, ["conv_id", "_call"], "left").drop("_call")
    used = F.col("kind") == "tool_use"
    joined = joined.withColumn("_tool", F.when(used, F.col("tool_name")).otherwise(F.col("call.tool_name"))).withColumn(
        "_path", F.when(used, F.col("file_path")).otherwise(F.col("call.file_path"))).drop("call")
    path = Window.partitionBy("conv_id", F.when(F.col("_path") != "", F.col("_path")).otherwise(alone))
    last = lambda tools: F.max(F.when(used & F.col("tool_name").isin(*tools) & (F.col("file_path") != ""), F.col("ord"))).over(path)
    big = F.char_length("body") >= min_chars
    result = (F.col("kind") == "tool_result") & big
    copies = Window.partitionBy("conv_id", F.when(result, F.md5("body")).otherwise(alone)).orderBy("ord")
    staged = joined.withColumn("_written", last(FULL_WRITE_TOOLS)).withColumn("_touched", last(MUTATING_TOOLS)).withColumn("_copy", F.row_number().over(copies))
    later = lambda c: F.coalesce(F.col(c) > F.col("ord"), F.lit(False)) & (F.col("_path") != "")
    reason = (
        F.when(used & big & later("_written"), "superseded")
        .when(result & (F.col("_copy") > 1), "duplicate")
        .when(result & (F.col("_tool") == "Read") & later("_touched"), "stale")
        .when(result & F.col("_tool").isin(*MUTATING_TOOLS) & later("_written"), "superseded")
    )
    return staged.withColumn("reason", reason).withColumnRenamed("_path", "target_path").drop("_tool", "_written", "_touched", "_copy")


def cut_points(parts: DataFrame, remaining_turns: int) -> DataFrame:
    """``conv_id, cut, gain``: where rewriting from ``cut`` on pays back its lost prompt cache best.

    ``parts`` has ``conv_id, ord, tokens, saved``.  Only rows that save something are
    candidates, the gain must be positive, and of equal gains the later cut wins.
    """
    tail = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    staged = parts.withColumn("t", F.sum("tokens").over(tail)).withColumn("s", F.sum("saved").over(tail))
    read = F.lit(CACHE_READ * remaining_turns)
    gain = F.round(read * F.col("t") - (F.col("t") - F.col("s")) * (F.lit(CACHE_WRITE - CACHE_READ) + read), 6)
    paying = staged.withColumn("gain", gain).where((F.col("saved") != 0) & (F.col("gain") > 0))
    return paying.groupBy("conv_id").agg(F.max_by("ord", F.struct("gain", "ord")).alias("cut"), F.max("gain").alias("gain"))


def sweep(parts: DataFrame, min_chars: int = 400, remaining_turns: int | None = None) -> DataFrame:
    """``parts`` with ``reason, new_body, tokens_saved``; with remaining turns, only edits that pay stay."""
    marker = F.coalesce(*(F.when(F.col("reason") == r, F.replace(F.lit(m), F.lit("{path}"), F.coalesce("target_path", F.lit("")))) for r, m in MARKERS.items()))
    body = F.coalesce("body", F.lit(""))
    priced = classify(parts, min_chars).withColumn("marker", marker)
    if "json_chars" in parts.columns:  # calls cost their whole input as JSON; the rest of it stays
        after = F.col("json_chars") - F.col("body_json_chars") + F.char_length(F.to_json(F.struct("marker"))) - 11
        used = F.col("kind") == "tool_use"
        tokens = F.when(used, F.floor(F.col("json_chars") / 4)).otherwise(approx_tokens(body)).cast("long")
        left = F.when(used, F.floor(F.when(F.col("marker").isNotNull(), after) / 4)).otherwise(approx_tokens(F.col("marker"))).cast("long")
    else:
        tokens, left = approx_tokens(body), approx_tokens(F.col("marker"))
    priced = priced.withColumn("tokens", tokens).withColumn("saved", F.when(F.col("marker").isNotNull(), F.col("tokens") - left).otherwise(0))
    if remaining_turns is not None:
        cuts = cut_points(priced, remaining_turns).select("conv_id", "cut")
        priced = priced.join(cuts, "conv_id", "left").withColumn("reason", F.when(F.col("ord") >= F.col("cut"), F.col("reason"))).drop("cut")
    edited = F.col("reason").isNotNull()
    return priced.withColumn("new_body", F.when(edited, F.col("marker")).otherwise(F.col("body"))).withColumn(
        "tokens_saved", F.when(edited, F.col("saved")).otherwise(0)).drop("marker", "tokens", "saved")


def _body(content) -> str:
    """Text of a tool result: a string, or its text parts by line."""
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    return "\n".join(p.get("text") or "" for p in parts if isinstance(p, dict) and p.get("type") == "text")


def _as_json(value) -> str:
    """JSON with sorted keys, blanks after separators and ASCII escapes: the form whose length counts."""
    return json.dumps(value, sort_keys=True)


def message_parts(messages: DataFrame) -> DataFrame:
    """Parts, as ``sweep`` takes them, of ``messages (conv_id, msg_idx, content)`` with contents as JSON.

    A content that is a string is one part; list bodies of results are flattened; calls carry
    the length of their input as JSON.  Invalid JSON, and list items that are no objects, give nothing.
    """
    ship(messages.sparkSession)
    fields = "part_no long, kind string, id string, tool_use_id string, tool_name string, file_path string, body string, json_chars long, body_json_chars long"

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>")
    def parts(raw: pd.Series) -> pd.Series:
        out = []
        for text in raw:
            try:
                content = json.loads(text) if text is not None else None
            except ValueError:
                content = None
            rows = []
            for i, p in enumerate([{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []):
                if not isinstance(p, dict):
                    continue
                kind, given = p.get("type"), p.get("input") if isinstance(p.get("input"), dict) else {}
                body = given.get("content") if kind == "tool_use" else _body(p.get("content")) if kind == "tool_result" else p.get("text")
                body = body if isinstance(body, str) else None
                path, name = given.get("file_path"), p.get("name")
                rows.append({
                    "part_no": i, "kind": kind, "id": p.get("id"), "tool_use_id": p.get("id") if kind == "tool_use" else p.get("tool_use_id"), "tool_name": name if isinstance(name, str) else None,
                    "file_path": path if isinstance(path, str) else None, "body": body, "json_chars": len(_as_json(given)) if kind == "tool_use" else None,
                    "body_json_chars": len(_as_json(body)) if kind == "tool_use" and body is not None else None})
            out.append(rows)
        return pd.Series(out, dtype=object)

    rows = messages.select("conv_id", "msg_idx", F.explode(parts("content")).alias("p")).select("conv_id", "msg_idx", "p.*")
    return rows.withColumn("ord", F.struct("msg_idx", "part_no"))


def sweep_messages(messages: DataFrame, min_chars: int = 400, remaining_turns: int | None = None) -> DataFrame:
    """``messages`` with ``new_content, tokens_saved``: dead payloads are markers inside their parts.

    A call keeps its input but for ``content``; a result's content becomes the marker.  No part
    is removed.  Unlike trimming, a failure is not passed over.
    """
    edited = sweep(message_parts(messages), min_chars, remaining_turns).where("reason is not null")
    edits = edited.groupBy("conv_id", "msg_idx").agg(F.collect_list(F.struct("part_no", "new_body")).alias("_edits"), F.sum("tokens_saved").alias("tokens_saved"))

    @F.pandas_udf("string")
    def patched(raw: pd.Series, changes: pd.Series) -> pd.Series:
        out = []
        for text, new in zip(raw, changes):
            if new is not None:
                content = json.loads(text)
                for e in new:
                    part, i = content[e["part_no"]], e["part_no"]
                    content[i] = {**part, "input": {**part["input"], "content": e["new_body"]}} if part.get("type") == "tool_use" else {**part, "content": e["new_body"]}
                text = json.dumps(content, ensure_ascii=False)
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = messages.join(edits, ["conv_id", "msg_idx"], "left")
    return joined.select(*messages.columns, patched("content", "_edits").alias("new_content"), F.coalesce("tokens_saved", F.lit(0)).alias("tokens_saved"))
