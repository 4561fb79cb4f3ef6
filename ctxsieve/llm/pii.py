"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

Seeds are the base matches, and strings with the shape of a secret: 20 characters or more,
letters and digits mixed.  What stands in front of a seed is its lexical pattern: a name
with an equals sign or a colon (``token = "``, ``phone:``), else the one or two words before
together with the value's shape.  The same patterns in front of other number-like values
make a graph of patterns and instances, which Spark scores in rounds: a pattern's
confidence is the mean score of its instances, shrunk by ``shrink`` imaginary failures, and
an instance's score is the noisy-or of its trusted patterns.  Trusted patterns (confidence
and distinct seeds over their bounds) add spans of kind ``id`` for what no base pattern knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import BATCH, cut, keyed, numbered, ship, unused

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
#: Number-like values: digit groups parted by single blanks, and runs of letters and digits.
_GROUPS = re.compile(r"(?<![0-9A-Za-z_+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,5}(?![0-9A-Za-z_])")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+/@%-]*")
_KEY = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{1,39})[\x20\x09-\x0D]{0,3}(?:=|:|:=|=>)[\x20\x09-\x0D]{0,3}$")
_WORDS = re.compile(r"(?:([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]+)?([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]+$")
_OPENING, _CLOSING = "\"'`([{<", "._+/@%-"
_BEFORE = 100


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches: each at sign takes the local characters before it, then a domain."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, 0, done))
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all base matches, sorted."""
    if not _MARKED.search(text):
        return []
    found = _emails(text) if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def _shape(value: str) -> str:
    """Runs of digits as 9, runs of letters as a, other characters as they are."""
    return re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", value))


def _context(text: str, start: int, value: str) -> str | None:
    """The lexical pattern in front of a value, whatever quotes or brackets open it."""
    before = text[max(0, start - _BEFORE) : start].rstrip(_OPENING)
    key = _KEY.search(before)
    if key:
        return f"key {key[1].lower()}"
    words = _WORDS.search(before)
    if not words:
        return None
    pair = [re.sub("[0-9]+", "0", (w or "").lower()) for w in words.groups()]
    return f"words {pair[0]} {pair[1]} {_shape(value)}"


def _secret(value: str) -> bool:
    digits = sum(map(str.isdigit, value))
    return len(value) >= 20 and digits >= 4 and sum(map(str.isalpha, value)) >= 4 and len(set(value)) >= 8


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, bool, bool]]:
    """(pattern, instance, start, end, seed, known) of the base spans, which are known, and of other number-like values."""
    out = []

    def add(start: int, end: int, known: bool) -> None:
        value = text[start:end]
        pattern = _context(text, start, value)
        if pattern:
            out.append((pattern, value.lower(), start, end, known or _secret(value), known))

    taken: list[tuple[int, int]] = []  # in order, overlapping ones merged
    for s, _, e in spans:
        add(s, e, True)
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    if not _MARKED.search(text):
        return out
    for found in (_GROUPS, _VALUE):
        i, more = 0, []
        for m in found.finditer(text):
            start, end = m.start(), m.end()
            while end > start and text[end - 1] in _CLOSING:
                end -= 1
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if i < len(taken) and taken[i][0] < end or end - start < 6 or sum(c.isdigit() for c in text[start:end]) < 3:
                continue
            if start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"):
                continue
            add(start, end, False)
            more.append((start, end))
        taken = sorted(taken + more)
    return out


_SPANS = "array<struct<start: long, kind: int, end: long>>"
_LINKS = "array<struct<pattern: string, instance: string, start: long, end: long, seed: boolean, known: boolean>>"


def _scanned(rows: DataFrame) -> DataFrame:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    links_type = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("known", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, links = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = base_spans(text)
                spans.append([dict(zip(("start", "kind", "end"), s)) for s in found])
                links.append([dict(zip(("pattern", "instance", "start", "end", "seed", "known"), c)) for c in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(links, links_type)], ["row_id", "doc_id", "spans", "links"])

    return rows.mapInArrow(run, f"row_id long, doc_id long, spans {_SPANS}, links {_LINKS}")


def trusted_patterns(links: DataFrame, rounds: int = 3, least_confidence: float = 0.7, least_seeds: int = 3, shrink: float = 1.0) -> DataFrame:
    """``pattern, confidence, seeds`` of the trusted patterns of ``links (pattern, instance, seed)``."""
    edges = cut(links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("known"))
    scores = known.withColumnRenamed("known", "score")
    for i in range(rounds):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + shrink)).alias("confidence"), F.count_if("seed").alias("seeds"))
        trusted = rated.where((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds))
        if i < rounds - 1:
            raised = edges.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("raised"))
            scores = cut(known.join(raised, "instance", "left").select("instance", F.greatest("known", F.coalesce("raised", F.lit(0.0))).alias("score")))
    return cut(trusted)


def _found(rows: DataFrame, broadcast_bytes: int, **bootstrap) -> DataFrame:
    """``find_pii`` of ``rows (row_id, doc_id, text)``."""
    ship(rows.sparkSession)
    found = cut(_scanned(rows), batch=BATCH)
    links = found.select("row_id", F.explode("links").alias("link")).select("row_id", "link.*")
    trusted = trusted_patterns(links.select("pattern", "instance", "seed"), **bootstrap).select("pattern")
    # broadcast, as a frequent pattern would make a hot key; larger tables leave that to skew joins
    small = (trusted.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0) <= broadcast_bytes
    added = (
        links.where("not known").join(F.broadcast(trusted) if small else trusted, "pattern", "left_semi")
        .groupBy("row_id").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("added"))
    )
    spans = F.array_sort(F.concat("spans", F.coalesce("added", F.expr(f"cast(array() as {_SPANS})"))))
    return found.drop("links").join(added, "row_id", "left").select("row_id", "doc_id", F.col("spans").alias("base"), spans.alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16 << 20, **bootstrap) -> DataFrame:
    """``row_id, doc_id, base, spans``: arrays of (start, kind, end), one row per input row.

    Offsets are code points, end exclusive; ``kind`` indexes ``KINDS``; ``spans`` holds the
    base spans and those that trusted patterns add.  A null or empty text has none; each
    input row is searched alone, and equal values in many rows count once as evidence.
    """
    return _found(keyed(docs, id_col, text_col), broadcast_bytes, **bootstrap)


def written(spans: str):
    """A column of spans as ``kind:start:end``, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16 << 20, **bootstrap) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind, such as ``<EMAIL>``.

    Overlapping spans become one, named after the first.  Other columns stay; a null text
    stays null.
    """
    row, marks_col = unused(docs, "row"), unused(docs, "spans")
    copy = numbered(docs, row)
    rows = copy.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = _found(rows, broadcast_bytes, **bootstrap).where(F.size("spans") > 0).select(F.col("row_id").alias(row), F.col("spans").alias(marks_col))

    text, kinds = F.col(text_col).cast("string"), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    between = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    redacted = F.aggregate(
        marks_col,
        F.expr("named_struct('done', 0L, 'out', cast(array() as array<string>))"),
        lambda s, x: F.struct(
            F.greatest(s["done"], x["end"]).alias("done"),
            F.when(x["start"] >= s["done"], F.concat(s["out"], F.array(between(s["done"], x["start"]), F.get(kinds, x["kind"])))).otherwise(s["out"]).alias("out")),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["done"] + 1).cast("int"))),
    )
    joined = copy.join(spans, row, "left")
    return joined.withColumn(text_col, F.when(F.col(marks_col).isNotNull(), redacted).otherwise(text)).select(*docs.columns)
