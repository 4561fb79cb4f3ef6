"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted by turn; adjacent turns of one
role merge under one header.  The template, with ``\\n`` a line feed::

    ### Role: text<|next|>text of the next row of that role</turn>\\n

``<|next|>`` parts the texts of merged rows.  Inside texts and roles the backslash and
the control strings are written as two characters, so that no control string can stand
in a text and ``read_back`` restores every row exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, NEXT, END = "### ", ": ", "<|next|>", "</turn>\n"
#: Places of a stretch of a running sum.
_STRETCH = 256
#: What stands in texts as backslash and letter; the backslash itself first.
ESCAPES = (("\\", "\\e"), ("###", "\\h"), ("<|next|>", "\\n"), ("</turn>", "\\t"))


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def _before(sizes: Column) -> Column:
    """For each place of a non-empty array of longs, the sum of what stands before it.

    An aggregation that appends copies its array each time, so it runs over short stretches,
    and once over the sums of these.
    """
    nothing = F.expr("cast(array() as array<bigint>)")

    def running(xs: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(xs, F.struct(start.alias("at"), nothing.alias("seen")), step, lambda s: s["seen"])

    stretches = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(_STRETCH)), lambda k: F.slice(sizes, k, _STRETCH))
    sums = F.transform(stretches, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n))
    return F.flatten(F.zip_with(stretches, running(sums, F.lit(0).cast("long")), running))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation.

    ``loss_spans`` holds (start, end) in code points, end exclusive, of each text of a
    role in ``learn``; no control string lies in a span.  A null text or role is empty, a
    null turn comes first, rows with equal turns go by role and text, repeated rows stay,
    and rows with a null ``id_col`` form one conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("row")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    role = lambda i: F.get("rows", i)["role"]
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    heads = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("rows")))
    run = lambda a, b: F.struct(role(a).alias("role"), F.transform(F.slice("rows", a + 1, b - a), lambda r: escape(r["text"])).alias("texts"))
    head = lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(COLON))
    pieces = F.transform("merged", lambda t: F.concat(head(t), F.array_join(t["texts"], NEXT), F.lit(END)))
    sizes = F.transform("merged", lambda t: F.transform(t["texts"], lambda x: F.char_length(x).cast("long") + len(NEXT)))
    lengths = F.transform("pieces", lambda p: F.char_length(p).cast("long"))

    def spans_of(t: Column) -> Column:
        first = t["start"] + F.char_length(head(t["merged"]))
        return F.zip_with(_before(t["sizes"]), t["sizes"], lambda at, n: F.struct((first + at).alias("start"), (first + at + n - len(NEXT)).alias("end")))

    spans = F.flatten(F.transform(F.filter("each", lambda t: t["merged"]["role"].isin(*learn)), spans_of))
    return (
        turns.select("conv_id", "rows", heads.alias("heads"))
        .select("conv_id", F.zip_with("heads", ends, run).alias("merged"))
        .select("conv_id", "merged", pieces.alias("pieces"), sizes.alias("sizes"))
        .select("conv_id", "merged", "sizes", F.array_join("pieces", "").alias("formatted"), lengths.alias("lengths"))
        .select("conv_id", "formatted", F.arrays_zip(F.col("merged"), F.col("sizes"), _before(F.col("lengths")).alias("start")).alias("each"))
        .select("conv_id", "formatted", spans.alias("loss_spans"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text of each original row) and ``loss_texts``."""
    blocks = F.slice(F.split("formatted", F.lit(END), -1), 1, F.size(F.split("formatted", F.lit(END), -1)) - 1)
    colon = lambda b: F.instr(b, COLON)
    body = lambda b: F.substr(b, colon(b) + len(COLON))
    texts = lambda b: F.split(body(b), F.lit(r"<\|next\|>"), -1)
    role = lambda b: unescape_role(F.substr(b, F.lit(len(HEAD) + 1), colon(b) - len(HEAD) - 1))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)
