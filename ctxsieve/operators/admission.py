"""Tool outputs on their way into a context: policy, envelope, and replay over old sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SelectionConfig
from ..functions.text import approx_tokens, strip, strip_left
from .placing import placed
from .selection import decide_blocks, rank_blocks, rebuild_blocks, score_blocks, select_blocks

# Tools whose output may be trimmed, fields that hold it, arguments that tell its purpose.
ADMITTED_TOOLS = ("Read", "Grep", "Glob", "Bash", "WebFetch", "WebSearch", "NotebookRead", "BashOutput")
OUTPUT_FIELDS = ("stdout", "content", "output", "text")
ARGUMENT_FIELDS = ("pattern", "query", "command", "file_path", "path", "glob", "url")
KEEPS = (0.6, 0.7, 0.8, 0.9)


def output_text(response: Column) -> Column:
    """Text of a tool response given as VARIANT: a string, else the first filled output field."""
    fields = [F.nullif(F.try_variant_get(response, f"$.{f}", "string"), F.lit("")) for f in OUTPUT_FIELDS]
    return F.when(F.schema_of_variant(response) == "STRING", F.try_variant_get(response, "$", "string")).otherwise(F.coalesce(*fields))


def arguments_text(tool: Column, tool_input: Column) -> Column:
    """Tool name and known arguments, each cut to 200 characters, from a VARIANT."""
    known = [F.nullif(F.substring(F.try_variant_get(tool_input, f"$.{f}", "string"), 1, 200), F.lit("")) for f in ARGUMENT_FIELDS]
    return F.concat_ws(" ", tool, *known)


def eligible(tool: Column, text: Column, min_chars: int = 800) -> Column:
    """Whether an output may be trimmed: an admitted tool, long, and not a JSON body."""
    plain = ~F.substr(strip_left(text), F.lit(1), F.lit(1)).isin("{", "[")
    return F.coalesce(tool.isin(*ADMITTED_TOOLS) & (F.char_length(text) >= min_chars) & plain, F.lit(False))


def live_question(events: DataFrame) -> DataFrame:
    """``events (session, ord, question)`` with the last question asked up to each row."""
    so_far = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("live_question", F.last("question", ignorenulls=True).over(so_far))


def _asked(outputs: DataFrame) -> DataFrame:
    question = F.concat_ws("\n", F.nullif(F.col("question"), F.lit("")), F.coalesce("arguments", F.lit("")))
    return outputs.withColumn("query", question)


def admit(outputs: DataFrame, keep: float = 0.8, cfg: SelectionConfig | None = None) -> DataFrame:
    """``outputs (block_id, tool, text, question, arguments)`` with ``updated, envelope``, null where nothing shrinks."""
    cfg = cfg or SelectionConfig()
    fit = _asked(outputs).where(eligible(F.col("tool"), F.col("text"), cfg.min_message_chars))
    cut = select_blocks(fit.select("block_id", "text", "query"), keep, cfg).where(F.col("changed") & (F.char_length("new_text") < F.char_length("text")))
    updated = F.col("updated")
    envelope = F.to_json(F.struct(F.struct(F.lit("PostToolUse").alias("hookEventName"), updated.alias("updatedToolOutput")).alias("hookSpecificOutput")))
    joined = outputs.join(cut.select("block_id", F.col("new_text").alias("updated")), "block_id", "left")
    return joined.withColumn("envelope", F.when(updated.isNotNull(), envelope))


def replay(outputs: DataFrame, keeps: tuple[float, ...] = KEEPS, cfg: SelectionConfig | None = None) -> DataFrame:
    """``session, keep, eligible_tokens, fired, removed`` for sessions with an eligible output.

    ``outputs`` has ``session, block_id, tool, text, question, arguments``.  Chunks are scored
    once for all keeps.
    """
    cfg = cfg or SelectionConfig()
    fit = _asked(outputs).where(eligible(F.col("tool"), F.col("text"), cfg.min_message_chars) & (strip(F.col("query")) != ""))
    grid = F.explode(F.array(*(F.lit(float(k)) for k in keeps)))
    ranked = rank_blocks(score_blocks(placed(fit.select("session", "block_id", "text", "query"), "block_id"), cfg))
    built = rebuild_blocks(decide_blocks(ranked.withColumn("keep", grid), cfg, F.col("keep")), cfg)
    rows = built.select("session", "keep", "text", F.when(F.col("dropped") > 0, F.col("new_text")).alias("new_text"))
    fired = F.coalesce(F.char_length("new_text") < F.char_length("text"), F.lit(False))
    less = F.greatest(F.lit(0).cast("long"), approx_tokens(F.col("text")) - approx_tokens(F.col("new_text")))
    return rows.groupBy("session", "keep").agg(
        F.sum(approx_tokens(F.col("text"))).alias("eligible_tokens"), F.count_if(fired).alias("fired"), F.coalesce(F.sum(F.when(fired, less)), F.lit(0)).alias("removed"))



def replay_report(replayed: DataFrame) -> DataFrame:
    """Per keep: fires, removed tokens, share of eligible ones, median share of a session."""
    share = F.when(F.col("eligible_tokens") > 0, 100.0 * F.col("removed") / F.col("eligible_tokens"))
    return replayed.groupBy("keep").agg(
        F.sum("fired").alias("fired"), F.sum("removed").alias("removed"),
        F.round(100.0 * F.sum("removed") / F.nullif(F.sum("eligible_tokens"), F.lit(0)), 6).alias("removed_pct"), F.round(F.median(share), 6).alias("median_pct"))
