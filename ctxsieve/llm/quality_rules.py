"""Quality rules as weak supervision, in DataFrame functions.

Each rule votes good, bad or abstains.  Documents are counted by their pattern of votes,
of which there are at most 3**rules, so expectation-maximisation runs on the driver over
a bounded table: it estimates how often each rule votes either way on good and on bad
documents, and the share of good ones.  A document's verdict is the posterior
probability of its pattern, instead of a test that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, keyed

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 5


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, doc_id`` and the counts that the rules use, one row per input row."""
    empty = F.expr("cast(array() as array<bigint>)")
    rows = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "row_id", "doc_id",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANKS, "") != "").alias("lines"),
        F.char_length("text").alias("n_chars"),
        F.char_length(F.translate("text", _BLANKS, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )
    n = F.size("words")
    hashes = F.when(n >= _WINDOW, F.transform(F.sequence(F.lit(1), n - _WINDOW + 1), lambda i: F.struct(F.xxhash64(F.slice("words", i, _WINDOW)).alias("h"), i.alias("i"))))
    rows = rows.select(
        "row_id", "doc_id", n.alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_chars", "word_chars", "n_symbols", "n_upper", F.array_sort(hashes).alias("sorted"),
    )
    same = lambda e, other: F.get("sorted", other)["h"] == e["h"]
    twice = F.filter("sorted", lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False)))
    rows = rows.withColumn("at", F.coalesce(F.array_sort(F.transform(twice, lambda e: e["i"].cast("long"))), empty)).drop("sorted")
    steps = F.transform("at", lambda p, k: F.least(F.lit(_WINDOW).cast("long"), F.coalesce(F.get("at", k + 1) - p, F.lit(_WINDOW).cast("long"))))
    repeated = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))
    counts = ["n_words", "n_lines", "n_dup_lines", "n_chars", "word_chars", "n_symbols", "n_upper"]
    return rows.select("row_id", "doc_id", *(F.col(c).cast("long").alias(c) for c in counts), repeated.alias("n_repeat_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, "b").when(good, "g").otherwise("-")


def rules() -> dict[str, Column]:
    """The vote of each rule as a column of ``counted``: b, g, or - for none."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        "word_length": _vote((letters < 2 * n) | (letters > 15 * n), (letters >= 3 * n) & (letters <= 10 * n)),
        "symbols": _vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "lines": _vote(2 * F.col("n_dup_lines") > F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeats": _vote(100 * F.col("n_repeat_words") > 20 * n, 100 * F.col("n_repeat_words") <= 5 * n),
        "capitals": _vote(2 * F.col("n_upper") > letters, 5 * F.col("n_upper") <= letters),
    }


def fit_votes(patterns: dict[str, int], n_rules: int, rounds: int = 50, most_false: float = 0.01) -> dict[str, float]:
    """Posterior probability of "good" for each pattern of votes.

    Documents are good or bad in one of as many ways as there are rules; one kind of bad
    begins near each rule, as junk of one kind often trips one rule only.  Of the documents
    of a class on which a rule votes, ``alarm[class][rule]`` is the share with a bad vote;
    an abstention is no evidence.  Alarms on good documents are held to ``most_false``,
    which also keeps the classes from changing places.
    """
    total = sum(patterns.values())
    share = [0.85, *[0.15 / n_rules] * n_rules]
    alarm = [[0.005] * n_rules, *([0.7 if r == k else 0.1 for r in range(n_rules)] for k in range(n_rules))]

    def posterior(pattern: str) -> list[float]:
        logs = [
            math.log(w) + sum(math.log(p if v == "b" else 1 - p) for p, v in zip(row, pattern) if v != "-")
            for w, row in zip(share, alarm)
        ]
        top = max(logs)
        likely = [math.exp(x - top) for x in logs]
        return [x / sum(likely) for x in likely]

    for _ in range(rounds if total else 0):
        weight = {p: posterior(p) for p in patterns}
        mass = [sum(n * weight[p][c] for p, n in patterns.items()) + 0.5 for c in range(n_rules + 1)]
        share = [m / sum(mass) for m in mass]
        for c in range(n_rules + 1):
            for r in range(n_rules):
                voted = [(p[r] == "b", n * weight[p][c]) for p, n in patterns.items() if p[r] != "-"]
                rate = (sum(w for bad, w in voted if bad) + 0.05) / (sum(w for _, w in voted) + 0.1)
                rate = max(rate, 0.5) if r == c - 1 else rate
                alarm[c][r] = min(0.995 if c else most_false, max(0.002, rate))
    return {p: posterior(p)[0] for p in patterns}


def judge_quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, doc_id``, the counts, ``votes``, ``base_failed``, ``p_good`` and ``kept``.

    ``kept`` is false where the base test fails (under 10 words, or over 20 % of them in
    repeated windows), else whether ``p_good`` reaches ``threshold``.  A null or empty text
    has no words and fails; each input row is judged alone.
    """
    votes = rules()
    rows = cut(counted(docs, id_col, text_col).withColumn("votes", F.concat(*votes.values())))
    patterns = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    fitted = fit_votes(patterns, len(votes))
    table = docs.sparkSession.createDataFrame(sorted(fitted.items()), "votes string, p_good double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        rows.join(F.broadcast(table), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )
