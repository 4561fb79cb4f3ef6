"""Sources and sinks of conversations: JSON arrays, JSON lines, hook events, judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, strip
from ..operators.admission import arguments_text, output_text


def said(value: Column, path: str = "$.message.content", glue: str = " ") -> Column:
    """The text of a content that is a string or a list of parts: text parts, joined; other shapes are null."""
    content = F.try_variant_get(value, path, "variant")
    parts = F.try_variant_get(value, path, "array<variant>")
    texts = F.transform(
        F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(texts, glue))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, n_lines, value`` (VARIANT) of each line that parses; others are counted and skipped.

    Files are split like any others: lines are numbered by the place of their part in the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    file = Window.partitionBy("file")
    placed = raw.withColumn("line_no", F.row_number().over(file.orderBy("start", "at")) - 1).withColumn("n_lines", F.count("*").over(file))
    return placed.select("file", "line_no", "n_lines", F.try_parse_json("value").alias("value")).where("value is not null")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, msg_idx, role, content, keep`` of files that hold an array of messages or ``{"messages": [...], "keep": x}``.

    ``content`` is JSON text; ``keep`` is null unless the file gives one.  Invalid JSON and
    other shapes raise an error.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("conv_id"), F.parse_json("value").alias("v"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    held = F.when(listed, F.variant_get("v", "$", "array<variant>")).otherwise(F.variant_get("v", "$.messages", "array<variant>"))
    checked = F.when(held.isNull(), F.raise_error(F.lit("expected an array of messages"))).otherwise(held)
    keep = F.when(~listed, F.try_variant_get("v", "$.keep", "double"))
    rows = whole.select("conv_id", keep.alias("keep"), F.posexplode(checked).alias("msg_idx", "m"))
    return rows.select("conv_id", "msg_idx", F.try_variant_get("m", "$.role", "string").alias("role"), F.to_json(F.try_variant_get("m", "$.content", "variant")).alias("content"), "keep")


def write_messages(messages: DataFrame, path: str, content: str = "new_content", pretty: bool = False) -> Observation:
    """Write each conversation as a JSON array of its messages in order: one line each, or indented.

    Returns an observation with the number of messages and the approximate tokens written.
    """
    seen = Observation("written")
    counted = messages.observe(seen, F.count("*").alias("messages"), F.coalesce(F.sum(approx_tokens(F.col(content))), F.lit(0)).alias("tokens"))
    rows = counted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "role", F.col(content).alias("content")))).alias("rows"))
    shown = F.to_json(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))), {"pretty": str(pretty).lower()})
    rows.select(shown.alias("value")).write.text(path)
    return seen


def latest_question(lines: DataFrame, recent: int = 400) -> DataFrame:
    """``file, question``: the newest user text, in a string or in parts, among the last ``recent`` lines of each transcript."""
    text = said(F.col("value"))
    asked = (F.try_variant_get("value", "$.message.role", "string") == "user") & (strip(text) != "")
    near = F.col("line_no") >= F.col("n_lines") - recent
    return lines.groupBy("file").agg(F.max_by(F.when(asked & near, text), F.when(asked & near, F.col("line_no"))).alias("question"))


def tool_results(lines: DataFrame) -> DataFrame:
    """``file, ord, tool, arguments, response, content, question`` of each tool result with a known call before it.

    ``response`` is the line's structured result if it has one, else the part's content; the
    question is the newest user text up to and with the result's line.
    """
    content = F.coalesce(F.try_variant_get("value", "$.message.content", "array<variant>"), F.array())
    role, text = F.try_variant_get("value", "$.message.role", "string"), said(F.col("value"))
    asked = F.when((role == "user") & (strip(text) != ""), text)
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = lines.withColumn("question", F.last(asked, ignorenulls=True).over(so_far))
    parts = live.select("file", "line_no", role.alias("role"), "question", F.try_variant_get("value", "$.toolUseResult", "variant").alias("structured"), F.posexplode(content).alias("part_no", "part"))
    get = lambda f, t="string": F.try_variant_get("part", f"$.{f}", t)
    flat = parts.select("file", F.struct("line_no", "part_no").alias("ord"), "role", "question", "structured", get("type").alias("kind"), get("id").alias("id"),
                        get("tool_use_id").alias("of"), get("name").alias("tool"), get("input", "variant").alias("input"), get("content", "variant").alias("content"))
    calls = flat.where("kind = 'tool_use' and role = 'assistant' and tool <> ''").select("file", F.col("id").alias("of"), F.col("ord").alias("called"), F.col("tool").alias("t"), F.col("input").alias("arguments"))
    met = flat.where("kind = 'tool_result' and role = 'user'").drop("tool", "input").join(calls, ["file", "of"]).where("called < ord")
    latest = met.withColumn("_rank", F.row_number().over(Window.partitionBy("file", "ord").orderBy(F.desc("called")))).where("_rank = 1")
    return latest.select("file", "ord", F.col("t").alias("tool"), "arguments", F.coalesce("structured", "content").alias("response"), "content", "question")


def replay_outputs(lines: DataFrame) -> DataFrame:
    """``session, block_id, tool, text, question, arguments`` of the results with a text, as ``admission.replay`` takes them."""
    rows = tool_results(lines)
    plain = F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get("content", "$", "string"))
    text = F.coalesce(output_text(F.col("response")), plain)
    block = F.concat_ws(":", "file", F.col("ord.line_no").cast("string"), F.col("ord.part_no").cast("string"))
    return rows.select(F.col("file").alias("session"), block.alias("block_id"), "tool", text.alias("text"), "question", arguments_text(F.col("tool"), F.col("arguments")).alias("arguments")).where("text <> ''")


def largest_per_folder(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """``path, length`` of the largest file of each folder, the ``limit`` largest of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    best = Window.partitionBy(folder).orderBy(F.desc("length"), "path")
    return files.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank").orderBy(F.desc("length"), "path").limit(limit)


def dataset_slice(rows: DataFrame, order: str, offset: int, n: int) -> DataFrame:
    """Rows ``offset`` to ``offset + n - 1`` in the order of a column."""
    return rows.orderBy(order).offset(offset).limit(n)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Append judged pairs as JSON lines."""
    pairs.write.mode("append").json(path)


def write_golden(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lines with sorted keys, in their own order, as a fixture to compare with later."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def golden_differences(rows: DataFrame, path: str) -> DataFrame:
    """``value, side`` of the rows that only the fixture (``golden``) or only ``rows`` (``new``) has, copies counted."""
    new = rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    golden = rows.sparkSession.read.text(path)
    return golden.exceptAll(new).withColumn("side", F.lit("golden")).union(new.exceptAll(golden).withColumn("side", F.lit("new")))
