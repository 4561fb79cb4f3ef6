"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models, for low quality and for toxic text, are fitted on at most
``max_train`` labelled documents: measures of style, and the presence of the words most
tied to a label, or of words that begin alike.  They give each document the log-odds that
its text adds for "reject".  Grouped sums then give each host, and each path of a host, the
posterior mean of its reject share: a host's is shrunk toward the global one as if it had
some more documents of that share, a path's toward its host's.  How many is estimated from
all documents by moments: the variance within sites over the variance between them, beyond
what chance alone would give.  A document's verdict combines its own evidence with the prior
of its path.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import BATCH, cut, numbered, ship, unused

_STYLE = 12
_STARTS = (5, 7)
_ENDS = tuple(".,!?;:")
#: The most documents that a prior counts for, as where sites do not differ.
_MOST = 1e6
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS, _CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS, _POINTS = b"#*$%&|<>{}[]\\^~=_@", b".,;:!?'\"()-"


def style(text: str) -> list[float]:
    """Measures of a text's form; an empty text has those of no words."""
    words, n, raw = text.split(), max(1, len(text)), text.encode(errors="replace")
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols, capitals, digits, points = (len(raw) - len(raw.translate(None, x)) for x in (_SYMBOLS, _CAPITALS, _DIGITS, _POINTS))
    return [
        math.log1p(len(words)), len(text) / w, symbols / w, capitals / n, digits / n, points / w, text.count("!!") / w, text.count(" | ") / w,
        1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / w, sum(x.endswith(_ENDS) for x in words) / w, len(lines) / w,
    ]


def words_of(text: str) -> set[str]:
    """Different words of a text, and the beginnings of its longer ones, marked by a tilde."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}~" for w in words for n in _STARTS if len(w) > n}


class Known:
    """Finds the members of a vocabulary among the words of a text, without making all marked beginnings."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.at = {w: i for i, w in enumerate(vocabulary)}
        self.whole = {w for w in vocabulary if not w.endswith("~")}
        self.starts = [(n, {w[:-1] for w in vocabulary if w.endswith("~") and len(w) == n + 1}) for n in _STARTS]

    def of(self, text: str) -> set[int]:
        words = set(_WORD.findall(text.lower()))
        found = {self.at[w] for w in words & self.whole}
        for n, starts in self.starts:
            if starts:
                found |= {self.at[f"{w}~"] for w in {w[:n] for w in words if len(w) > n} & starts}
        return found


class Evidence:
    """Fitted models: log-odds for "reject" that a text adds to the base rate."""

    def __init__(self, vocabulary: list[str], mean: np.ndarray, scale: np.ndarray, heads: list[tuple[np.ndarray, float]], base: float) -> None:
        self.known = Known(vocabulary)
        self.mean, self.scale, self.heads, self.base = mean, scale, heads, base

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(_STYLE + len(self.known.at))
        x[:_STYLE] = np.clip((np.array(style(text)) - self.mean) / self.scale, -6, 6)
        for i in self.known.of(text) if self.known.at else ():
            x[_STYLE + i] = 1.0
        return x

    def added(self, text: str) -> float:
        """Log-odds of either fault, less the base rate's."""
        if not self.heads:
            return 0.0
        x, fine = self.features(text), 0.0
        for weights, bias in self.heads:
            fine -= np.logaddexp(0, x @ weights + bias)  # log of 1 - p
        p = min(1 - 1e-9, max(1e-9, -math.expm1(fine)))
        return math.log(p / (1 - p)) - math.log(self.base / (1 - self.base))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the last weight is the bias, free of the ridge."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int, max_words: int) -> Evidence:
    """Fit on the ``max_train`` labelled ids that come first by their hash; of rows with one id, the least text counts."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    low, toxic = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    sample = cut(sample.select("text", low.alias("low"), toxic.alias("toxic")))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [list(words_of(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), batch.column(1), batch.column(2)], ["words", "low", "toxic"])

    total = sample.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n = total[0]
    vocabulary: list[str] = []
    if n:
        seen = sample.mapInArrow(presence, "words array<string>, low int, toxic int").select(F.explode("words").alias("word"), "low", "toxic")
        seen = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).where("n >= 5")
        surplus = lambda c, share: (F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-6)))
        for c, s in (("low", total[1] / n), ("toxic", total[2] / n)):
            vocabulary += [r.word for r in seen.withColumn("z", surplus(c, s)).where("z > 5").orderBy(F.desc("z"), "word").limit(max_words).collect()]
        vocabulary = sorted(set(vocabulary))
    empty = Evidence(vocabulary, np.zeros(_STYLE), np.ones(_STYLE), [], 0.5)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [empty_features(t.as_py(), vocabulary) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "low", "toxic"])

    rows = sample.mapInArrow(measured, "x array<double>, low int, toxic int").collect() if n else []
    if not rows:
        return empty
    raw = np.zeros((len(rows), _STYLE + len(vocabulary)))
    for i, r in enumerate(rows):
        raw[i, :_STYLE] = r.x[:_STYLE]
        raw[i, _STYLE + np.array(r.x[_STYLE:], int)] = 1.0
    mean, scale = raw[:, :_STYLE].mean(0), raw[:, :_STYLE].std(0) + 1e-6
    raw[:, :_STYLE] = np.clip((raw[:, :_STYLE] - mean) / scale, -6, 6)
    heads = []
    for y in (np.array([r.low for r in rows], float), np.array([r.toxic for r in rows], float)):
        if 0 < y.sum() < len(y):
            heads.append(_logistic(raw, y))
    bad = np.mean([r.low or r.toxic for r in rows])
    return Evidence(vocabulary, mean, scale, heads, min(0.99, max(0.01, float(bad))))


def empty_features(text: str, vocabulary: list[str]) -> list[float]:
    """Style measures, then the indices of the vocabulary's words that the text has."""
    return [*style(text), *map(float, Known(vocabulary).of(text))]


def strengths(sites: DataFrame) -> tuple[float, float, float]:
    """Global share, and the documents that a host's and a path's prior count for.

    ``sites`` has ``host, path`` and the sum ``s``, sum of squares ``q`` and number ``n`` of its
    documents' shares.  With variance v within groups and t between them (by moments, as in
    an analysis of variance), a group of n documents weighs n / (n + v / t).
    """
    hosts = sites.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"))
    total = hosts.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("a"), F.sum(F.col("n") * F.col("n").cast("double")).alias("b"), F.sum("c").alias("c"), F.sum(F.col("nn") / F.col("n")).alias("d")).first()
    if not total["n"]:
        return 0.5, _MOST, _MOST
    n, share = total["n"], total["s"] / total["n"]

    def strength(between: float, within: float, groups: int, above: int, spread: float) -> float:
        v = max(within, 0.0) / max(1, n - groups)
        t = (between - (groups - above) * v) / spread if spread > 0 else 0.0
        return min(_MOST, max(1.0, v / t)) if t > 0 else _MOST

    host = strength(total["a"] - n * share * share, total["q"] - total["a"], total["hosts"], 1, n - total["b"] / n)
    path = strength(total["c"] - total["a"], total["q"] - total["c"], total["paths"], total["hosts"], n - total["d"])
    return share, host, path


def classify_quality(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
    max_train: int = 6000, max_words: int = 64, host_prior: float | None = None, path_prior: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """``row_id, doc_id, host, path, added, p_host, p_path, p_reject, kept``, one row per input row.

    ``labels`` has ``doc_id, quality, toxic`` (1 is good, 1 is toxic); without labels of both
    values nothing is rejected.  ``host`` defaults to ``source`` and ``path`` to ``lang``; null
    ones, or all where there is no such column, form a site of their own.  ``host_prior`` and
    ``path_prior`` are estimated unless given.  Null and empty texts are judged by their site
    and the style of no words; rows that repeat an id are judged alone; an empty table gives
    no rows.
    """
    return _classified(docs.withColumn(row := unused(docs, "row"), F.monotonically_increasing_id()), row, labels, host, path, threshold, max_train, max_words, host_prior, path_prior, id_col, text_col, broadcast_bytes)


def _classified(docs, row, labels, host, path, threshold, max_train, max_words, host_prior, path_prior, id_col, text_col, broadcast_bytes) -> DataFrame:
    """``classify_quality`` of ``docs`` with ids in the column ``row``, which are read once."""
    ship(docs.sparkSession)
    model = fit_evidence(docs, labels, id_col, text_col, max_train, max_words)
    site = lambda given, name: given if given is not None else F.col(name) if name in docs.columns else F.lit("")
    rows = docs.select(
        F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(site(host, "source").cast("string"), F.lit("")).alias("host"),
        F.coalesce(site(path, "lang").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [model.added(t.as_py()) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(added, pa.float64())], ["row_id", "doc_id", "host", "path", "added"])

    found = cut(rows.mapInArrow(judged, "row_id long, doc_id long, host string, path string, added double"), batch=BATCH)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    logit = lambda p: F.log(p / (1 - p))
    base = math.log(model.base / (1 - model.base)) if model.heads else -10.0
    share = logistic(F.col("added") + base)
    paths = cut(found.groupBy("host", "path").agg(F.sum(share).alias("s"), F.sum(share * share).alias("q"), F.count("*").alias("n")))
    overall, by_host, by_path = strengths(paths)
    by_host, by_path = by_host if host_prior is None else host_prior, by_path if path_prior is None else path_prior
    hosts = paths.groupBy("host").agg(((F.sum("s") + by_host * overall) / (F.sum("n") + by_host)).alias("p_host"))
    sites = paths.join(hosts, "host").select("host", "path", "p_host", ((F.col("s") + by_path * F.col("p_host")) / (F.col("n") + by_path)).alias("p_path"))
    # a site may hold a third of the rows: its key is broadcast if the sites' bytes allow, else left to skew joins
    small = (paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0) <= broadcast_bytes
    bounded = lambda p: F.least(F.lit(0.999), F.greatest(F.lit(1e-5), p))
    return (
        found.join(F.broadcast(sites) if small else sites, ["host", "path"])
        .withColumn("p_reject", logistic(F.col("added") + logit(bounded(F.col("p_path")))))
        .withColumn("kept", F.col("p_reject") < threshold)
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
    max_train: int = 6000, max_words: int = 64, host_prior: float | None = None, path_prior: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    row = unused(docs, "row")
    copy = numbered(docs, row)
    found = _classified(copy, row, labels, host, path, threshold, max_train, max_words, host_prior, path_prior, id_col, text_col, broadcast_bytes)
    return copy.join(found.where("kept").select(F.col("row_id").alias(row)), row, "left_semi").drop(row)
