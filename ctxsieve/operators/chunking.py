"""Text splitting: delimiters, else sentences, else line shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_left, strip_right

_DELIMITER = r"(?U)(\n\s*\n)|\n(-{3,}\n)|\n(#{1,6}\s)|(\[\d+\]\s)"
_SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
_LINE_NUMBER, _HUNK = r"(?U)^\s*\d+\t", r"^(?:diff --git |@@ )"
#: Two pairs of marks for the places of delimiters; a text that has one pair gets the other.
_MARKS = (("\x01", "\x02"), ("", ""))
_PARTS = "cast(array() as array<string>)"


def sentences(text: Column) -> Column:
    """Parts of the stripped text after sentence ends."""
    return F.filter(F.split(strip(text), _SENTENCE_END, -1), lambda x: x != "")


def _delimited(text: Column, begin: str, end: str) -> Column:
    """Structs (part, is_body) of the text between delimiters, which a mark replaces.

    Headings, rules and citation anchors are groups 2 to 4 of the pattern, without the
    line feed in front: they stay with the part they introduce.  A blank line leaves nothing.
    """
    pieces = F.split(F.regexp_replace(text, _DELIMITER, f"{begin}$2$3$4{end}"), begin, -1)

    def part(piece: Column, i: Column) -> Column:
        lead = F.when(i > 0, F.substring_index(piece, end, 1)).otherwise("")
        raw = F.when(i > 0, F.substr(piece, F.char_length(lead) + 2)).otherwise(piece)
        body = F.when(strip(raw) == "", "").when(lead != "", strip_right(raw)).otherwise(strip(raw))
        return F.struct(F.when(body == "", strip(lead)).otherwise(F.concat(lead, body)).alias("part"), (body != "").alias("is_body"))

    return F.filter(F.transform(pieces, part), lambda x: x["part"] != "")


def _grouped(lines: Column, boundary, drop: bool) -> Column:
    """Runs of lines between boundary lines, which are dropped or begin the next run."""
    start = F.expr(f"named_struct('done', {_PARTS}, 'run', {_PARTS})")
    flush = lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(F.array_join(s["run"], "\n")))).otherwise(s["done"])
    nothing = F.expr(_PARTS)

    def step(s: Column, line: Column) -> Column:
        after = nothing if drop else F.array(line)
        return F.when(boundary(line), F.struct(flush(s).alias("done"), after.alias("run"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["run"], F.array(line)).alias("run")))

    return F.aggregate(lines, start, step, flush)


def line_windows(lines: Column) -> Column:
    """About twelve windows of equally many lines."""
    step = F.greatest(F.lit(1), F.floor(F.size(lines) / 12).cast("int"))
    return F.transform(F.sequence(F.lit(1), F.size(lines), step), lambda i: F.array_join(F.slice(lines, i, step), "\n"))


def line_chunks(text: Column, min_chunks: int) -> Column:
    """Chunks of numbered listings, diffs or other lines; empty where none applies."""
    lines = F.split(text, "\n", -1)
    head = F.slice(lines, 1, 40)
    numbered = _grouped(lines, lambda x: strip(F.regexp_replace(x, _LINE_NUMBER, "")) == "", True)
    hunks = _grouped(lines, lambda x: x.rlike(_HUNK), False)
    windows = line_windows(lines)
    none = F.expr(_PARTS)
    return (
        F.when(F.substr(strip_left(text), F.lit(1), F.lit(1)).isin("{", "["), none)
        .when(F.size(lines) < min_chunks, none)
        .when((F.size(F.filter(head, lambda x: x.rlike(_LINE_NUMBER))) >= F.size(head) * F.lit(0.8)) & (F.size(numbered) >= min_chunks), numbered)
        .when(F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(_HUNK)) & (F.size(hunks) >= min_chunks), hunks)
        .when(F.size(windows) >= min_chunks, windows)
        .otherwise(none)
    )


def split_chunks(df: DataFrame, text_col: str = "text", min_chunks: int = 4, name: str = "chunks") -> DataFrame:
    """``df`` with the chunks of a text in a new array column; a null text has none.

    Parts between delimiters if at least two have content, else sentences if there are
    ``min_chunks``, else line chunks, else the sentences after all.  Chunks are verbatim.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.when(text.rlike("[\x01\x02]"), _delimited(text, *_MARKS[1])).otherwise(_delimited(text, *_MARKS[0]))
    bodies = F.size(F.filter("_parts", lambda x: x["is_body"]))
    staged = df.withColumn("_parts", marked).withColumn("_sentences", F.when(bodies < 2, sentences(text)))
    short = F.size("_sentences") < min_chunks
    lines = F.when(short & (bodies < 2), line_chunks(text, min_chunks)).otherwise(F.expr(_PARTS))
    staged = staged.withColumn("_lines", lines)
    chosen = (
        F.when(bodies >= 2, F.transform("_parts", lambda x: x["part"]))
        .when(~short | (F.size("_lines") == 0), F.col("_sentences"))
        .otherwise(F.col("_lines"))
    )
    return staged.withColumn(name, chosen).drop("_parts", "_sentences", "_lines")
