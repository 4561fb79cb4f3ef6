"""A/B evaluation: contexts with distractors, judge replies, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, last_json_object

SIZE_TOKENS = {"small": 0, "medium": 4000, "large": 12000}


def paragraphs(examples: DataFrame) -> DataFrame:
    """``question, pos, title, text`` of ``examples (question, titles, sentences)``."""
    zipped = F.arrays_zip(F.col("titles").alias("title"), F.transform("sentences", lambda s: F.array_join(s, " ")).alias("text"))
    return examples.select("question", F.posexplode(zipped).alias("pos", "p")).select("question", "pos", F.col("p").getField("title").alias("title"), F.col("p").getField("text").alias("text"))


def padded(own: DataFrame, pool: DataFrame, target: int, pool_limit: int = 3000) -> DataFrame:
    """``own (question, pos, title, text)`` and the pool's paragraphs that fill it up to ``target`` tokens.

    ``pool`` has ``title, text``; its first ``pool_limit`` paragraphs by title are used, in a
    circle.  Each question walks on from a place that its hash gives, skips its own titles,
    and stops at the paragraph that reaches the target.  Sums of costs bound each walk, so
    only paragraphs near its end are met in vain.
    """
    cost = approx_tokens(F.concat("title", F.lit(": "), "text"))
    place = Window.partitionBy(F.lit(0)).orderBy("title", "text")  # of pool_limit rows at most
    ring = pool.orderBy("title", "text").limit(pool_limit).withColumn("cost", cost).withColumn("at", F.row_number().over(place) - 1)
    ring = ring.withColumn("before", F.sum("cost").over(place) - F.col("cost"))
    size, total = ring.agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0))).first()
    base = own.groupBy("question").agg(F.sum(cost).alias("base"))
    start = F.pmod(F.conv(F.substring(F.md5("question"), 1, 8), 16, 10).cast("long"), F.lit(max(1, size)))
    skipped = own.select("question", "title").distinct().join(F.broadcast(ring.groupBy("title").agg(F.sum("cost").alias("cost"))), "title").groupBy("question").agg(F.sum("cost").alias("skipped"))
    walks = base.join(skipped, "question", "left").withColumn("start", start).join(F.broadcast(ring.select(F.col("at").alias("start"), F.col("before").alias("from"))), "start")
    rounds = ring.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "title", "text", "cost", (F.col("at") + F.col("round") * size).alias("at"), (F.col("before") + F.col("round") * total).alias("before"))
    near = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + size) & (F.col("before") - F.col("from") < F.lit(target) - F.col("base") + F.coalesce("skipped", F.lit(0)))
    free = walks.join(F.broadcast(rounds), near).join(own.select("question", "title"), ["question", "title"], "left_anti")
    order = Window.partitionBy("question").orderBy("at")
    walked = free.withColumn("used", F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(order))
    added = walked.where(F.col("base") + F.col("used") < target).select("question", (F.col("nth") + 100_000).alias("pos"), "title", "text")
    return own.select("question", "pos", "title", "text").unionByName(added)


def contexts(rows: DataFrame) -> DataFrame:
    """``question, context``: numbered paragraphs, shuffled by a hash and joined by blank lines."""
    order = Window.partitionBy("question").orderBy(F.md5(F.concat("title", "question")), "title", "pos")
    numbered = rows.withColumn("i", F.row_number().over(order))
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "title", F.lit(": "), "text")
    lines = numbered.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"))
    return lines.select("question", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def gold_titles(titles: Column, context: Column) -> Column:
    """The titles that stand in a context."""
    return F.filter(F.array_distinct(titles), lambda t: F.contains(context, t))


def swapped(question: Column) -> Column:
    """Whether a pair is shown to the judge in reverse."""
    return F.pmod(F.conv(F.substring(F.md5(question), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1


def shown(pairs: DataFrame) -> DataFrame:
    """``pairs (question, answer_full, answer_selected)`` with ``answer_a, answer_b`` as the judge sees them."""
    swap = swapped(F.col("question"))
    return pairs.withColumn("answer_a", F.when(swap, F.col("answer_selected")).otherwise(F.col("answer_full"))).withColumn(
        "answer_b", F.when(swap, F.col("answer_full")).otherwise(F.col("answer_selected")))


def verdict(reply: Column) -> Column:
    """Verdict in a judge's reply, its last flat JSON object; null where there is none."""
    return F.from_json(last_json_object(reply), "a_grade string, b_grade string, materially_worse boolean, worse_answer string, reason string")


def unblinded(judged: DataFrame) -> DataFrame:
    """``judged (question, reply, ...)`` with ``parsed, grade_full, grade_selected, materially_worse, judge_reason``.

    Grades go back to the answers that were shown; the selected answer is materially worse
    if the judge says that one is and names it.  Replies without a verdict have null grades.
    """
    swap, v = swapped(F.col("question")), verdict(F.col("reply"))
    staged = judged.withColumn("_v", v)
    grade = lambda plain, turned: F.when(swap, F.col(f"_v.{turned}_grade")).otherwise(F.col(f"_v.{plain}_grade"))
    worse = F.coalesce(F.col("_v.materially_worse") & (F.col("_v.worse_answer") == F.when(swap, "A").otherwise("B")), F.lit(False))
    return staged.withColumn("parsed", F.col("_v").isNotNull()).withColumn("grade_full", grade("a", "b")).withColumn("grade_selected", grade("b", "a")).withColumn(
        "materially_worse", worse).withColumn("judge_reason", F.coalesce("_v.reason", F.lit(""))).drop("_v")


def single_verdict(reply: Column) -> Column:
    """``grade, reason`` of a reply about one answer; the grade is null unless it is one of the three."""
    v = F.from_json(last_json_object(reply), "grade string, reason string")
    return F.struct(F.when(v["grade"].isin("correct", "partial", "incorrect"), v["grade"]).alias("grade"), F.coalesce(v["reason"], F.lit("")).alias("reason"))


def reply_rates(replies: DataFrame) -> DataFrame:
    """One row over ``replies (parsed, truncated)``: replies, those judged, dropped as unreadable, and cut off."""
    return replies.agg(
        F.count("*").alias("replies"), F.count_if("parsed").alias("judged"), F.count_if(~F.col("parsed")).alias("parse_dropped"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated"),
        F.round(100.0 * F.count_if(~F.col("parsed")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("parse_dropped_pct"),
        F.round(100.0 * F.count_if(F.coalesce("truncated", F.lit(False))) / F.nullif(F.count("*"), F.lit(0)), 6).alias("truncated_pct"))


def baseline_metrics(graded: DataFrame) -> DataFrame:
    """``grade, n, share_pct`` of all three grades over ``graded (grade)``, rows without a grade apart: the ceiling of the A/B."""
    grades = graded.sparkSession.createDataFrame([("correct",), ("partial",), ("incorrect",)], "grade string")
    counted = graded.where(F.col("grade").isin("correct", "partial", "incorrect")).groupBy("grade").agg(F.count("*").alias("n"))
    rows = F.broadcast(grades).join(counted, "grade", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("share_pct", F.round(100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(0)), 6))


def grade_histogram(graded: DataFrame, grade: str = "grade") -> DataFrame:
    n = graded.groupBy(grade).agg(F.count("*").alias("n"))
    return n.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def ab_metrics(pairs: DataFrame) -> DataFrame:
    """One row of rates over ``pairs (tokens_full, tokens_selected, gold_kept, gold_total, grade_full, grade_selected, materially_worse)``."""
    right = lambda c: F.col(c) == "correct"
    pct = lambda part, whole: F.round(100.0 * part / F.nullif(whole, F.lit(0)), 6)
    n = F.count("*")
    return pairs.agg(
        n.alias("judged"), pct(F.sum("tokens_full") - F.sum("tokens_selected"), F.sum("tokens_full")).alias("tokens_saved_pct"),
        pct(F.sum("gold_kept"), F.sum("gold_total")).alias("gold_recall_pct"), pct(F.count_if(right("grade_full")), n).alias("control_pct"),
        pct(F.count_if(right("grade_selected")), n).alias("treatment_pct"), pct(F.count_if(right("grade_full") & ~right("grade_selected")), n).alias("regression_pct"),
        pct(F.count_if(~right("grade_full") & right("grade_selected")), n).alias("improvement_pct"), pct(F.count_if("materially_worse"), n).alias("worse_pct"))
