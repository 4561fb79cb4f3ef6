"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions.

Every window of ``window`` item words must be contained whole, so one of its words is a
sufficient prefix: its rarest in the corpus.  Document words are exploded and joined with
the prefix words only; where one meets, positional and length bounds place the window in
the document, and its words are compared exactly.

The windows table grows with the benchmark, not the corpus.  It is broadcast if its bytes
are counted as ``broadcast_bytes`` at most.  Beyond that the join is shuffled: each word
that may be a prefix takes the words around it along, so that a match is verified where
it is found, and the most frequent words are dealt to as many parts as their counts ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, keyed, numbered, unused

#: What parts words, once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after a document's last word, so that each document keeps a row.
_END = "\x01"
#: A word is dealt to one part for so many of its occurrences, or for a 2000th of all words.
_PART, _PARTS = 100_000, 2000


def _words(text: Column) -> Column:
    """Lower-cased words; splitting at the gaps is several times faster than extracting the words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAPS), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``words, item_ids``: each different window, and the items that have it."""
    n = F.size("words")
    starts = F.when(n > window, F.sequence(F.lit(1), n - window + 1)).when(n > 0, F.array(F.lit(1)))
    return (
        items.withColumn("start", F.explode(starts))
        .select("item_id", F.slice("words", F.col("start"), F.lit(window)).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``token, at, length, wanted, item_ids, df``: each window under its rarest word."""
    rarest = Window.partitionBy("words").orderBy("df", "token", "at")
    return (
        windows.select("words", "item_ids", F.posexplode("words").alias("at", "token"))
        .join(counts, "token", "left")
        .withColumn("df", F.coalesce("count", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest))
        .where("rank = 1")
        .select("token", "at", F.size("words").alias("length"), F.array_join("words", " ").alias("wanted"), "item_ids", "df")
    )


def _met_by_broadcast(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``row_id, doc_id, n_words, span, item_ids``: a row per occurrence, and one with ``n_words`` per document."""
    ends = rows.sparkSession.range(1).select(
        F.lit(_END).alias("token"), F.lit(0).alias("at"), F.lit(0).alias("length"), F.expr("cast(null as string)").alias("wanted"), F.expr("cast(null as array<string>)").alias("item_ids")
    )
    table = prefixes.drop("df").unionByName(ends)
    placed = rows.select("row_id", "doc_id", "words", F.posexplode(F.array_append("words", F.lit(_END))).alias("pos", "token"))
    # Slices and joins of strings, unlike higher-order functions, stay in the join's generated
    # code, which then makes no row that holds a document's words.
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("length") <= F.size("words"))
    here = F.array_join(F.slice("words", start + 1, F.col("length")), " ")
    found = F.when(F.col("wanted").isNull(), True).when(fits, here == F.col("wanted")).otherwise(False)
    return placed.join(F.broadcast(table), "token").where(found).select(
        "row_id", "doc_id", F.when(F.col("wanted").isNull(), F.col("pos")).alias("n_words"),
        F.when(F.col("wanted").isNotNull(), F.struct(start.alias("start"), (start + F.col("length")).alias("end"))).alias("span"), "item_ids")


def _met_by_shuffle(rows: DataFrame, prefixes: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """As ``_met_by_broadcast``, for windows tables of any size."""
    counted = prefixes.groupBy("token").agg(F.first("df").alias("df"))
    bound = counted.agg(F.sum(F.octet_length("token") + 64), F.sum("df")).first()
    part = max(_PART, (bound[1] or 0) // _PARTS)
    hot = counted.where(F.col("df") > part).select("token", F.ceil(F.col("df") / F.lit(part)).cast("int").alias("parts"))  # at most _PARTS rows
    placed = rows.select("row_id", "doc_id", "words", F.posexplode("words").alias("pos", "token"))
    if (bound[0] or 0) <= broadcast_bytes:
        placed = placed.join(F.broadcast(counted.select("token")), "token", "left_semi")
    first = F.greatest(F.lit(0), F.col("pos") - (window - 1))
    around = placed.select("row_id", "doc_id", "token", "pos", first.alias("first"), F.slice("words", first + 1, F.lit(2 * window - 1)).alias("around"))
    dealt = lambda side, salt: side.join(F.broadcast(hot), "token", "left").withColumn("salt", salt)
    one = dealt(around, F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row_id", "pos"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")
    two = dealt(prefixes.drop("df"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    start = F.col("pos") - F.col("at")
    fits = (start >= F.col("first")) & (start - F.col("first") + F.col("length") <= F.size("around"))
    here = F.array_join(F.slice("around", start - F.col("first") + 1, F.col("length")), " ")
    met = one.join(two, ["token", "salt"]).where(F.when(fits, here == F.col("wanted")).otherwise(False))
    met = met.select("row_id", "doc_id", F.lit(None).cast("int").alias("n_words"), F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span"), "item_ids")
    nothing = [F.expr("cast(null as struct<start: int, end: int>)").alias("span"), F.expr("cast(null as array<string>)").alias("item_ids")]
    return met.unionByName(rows.select("row_id", "doc_id", F.size("words").alias("n_words"), *nothing))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``row_id, doc_id, n_words, n_hit, item_ids``, one row per row of ``docs``.

    A word is hit if it lies in an occurrence of a window; ``item_ids`` are the items with
    occurring windows, as sorted strings.  An item of fewer words is one window; null or
    empty texts have no words, a null item id reads "null", rows that repeat an id or a
    text are judged alone.
    """
    return _found(keyed(docs, id_col, text_col), benchmark, window, item_col, item_text_col, broadcast_bytes)


def _found(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame:
    """``find_contamination`` of ``rows (row_id, doc_id, text)``, whose ids are the same wherever it is read."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), _words(F.col(item_text_col).cast("string")).alias("words"))
    windows = cut(_windows(items, window))
    bound = windows.agg(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("item_ids", " ")) + 16 * F.size("item_ids") + 128)).first()[0] or 0
    small = bound <= broadcast_bytes
    vocabulary = windows.select(F.explode("words").alias("token")).distinct()
    rows = rows.select("row_id", "doc_id", _words(F.col("text")).alias("words"))
    spoken = rows.select(F.explode("words").alias("token"))
    # of a vocabulary that may not fit, all words are counted, which their partial sums keep small
    counts = spoken.join(F.broadcast(vocabulary), "token").groupBy("token").count() if small else spoken.groupBy("token").count().join(vocabulary, "token")
    prefixes = cut(_prefixes(windows, counts))
    hits = _met_by_broadcast(rows, prefixes) if small else _met_by_shuffle(rows, prefixes, window, broadcast_bytes)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).alias("hit"), F.greatest(s["end"], x["end"]).alias("end")
        ),
        lambda s: s["hit"],
    )
    return (
        hits.groupBy("row_id", "doc_id")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item_ids").alias("items"))
        .select(
            "row_id", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("item_ids"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    row = unused(docs, "row")
    copy = numbered(docs, row)
    rows = copy.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    clean = _found(rows, benchmark, window, item_col, item_text_col, broadcast_bytes).where("n_hit = 0").select(F.col("row_id").alias(row))
    return copy.join(clean, row, "left_semi").drop(row)
