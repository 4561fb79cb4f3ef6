"""Exact removal of long repeated word passages, found by difference-cover anchors.

A *window* is ``window`` consecutive words of one document; it is repeated when its
word sequence also starts anywhere else.  Hashing every window would shuffle a row
per word.  Instead, only windows of ``window - period + 1`` words that start at the
positions of a difference cover modulo ``period`` are hashed ("anchors").  For any two
positions i and j some shift d < period puts both i+d and j+d on the cover, so two
equal windows always share an aligned anchor.  Where an anchor repeats, the match is
extended: the full windows around it, and only those, are hashed and counted.

Data flow (one shuffle of the texts, reused by all three passes over them)::

    texts by bucket -> anchors per (bucket, hash range) -> repeated? bits per bucket
    texts + bits    -> full windows per (bucket, range)  -> repeated? bits per bucket
    texts + both    -> kept words

A bucket holds some MB of texts picked by row key.  It sends each distinct hash once,
with a flag for "twice in here", so thousands of copies of a passage become one entry
per bucket and no range or bucket grows with a passage's popularity.  What comes back
is one bit per hash, in the order of the sorted hashes.  Anchors are 64-bit (a
collision costs work, never a result), full windows 96-bit, of two independent hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import keyed, ship
from .words import U64, hash_windows, hashed, utf8

#: Difference covers: for every d some two members differ by d modulo the period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_SENT = "bucket long, hash_range long, hashes binary, more binary, twice binary"
_BITS = "bucket long, kind int, hash_range long, repeated binary"


def _anchors(table: pa.Table, window: int, period: int):
    """Word hashes, document bounds, cover positions and the hashes there."""
    words, first = hashed(table.column("text"))
    n = np.diff(first)
    here = np.arange(len(words)) - np.repeat(first[:-1], n)
    left = np.repeat(n, n) - here
    on_cover = np.zeros(period, bool)
    on_cover[list(COVERS[period])] = True
    length = window - period + 1
    at = np.flatnonzero(on_cover[here % period] & (left >= length) & (np.repeat(n, n) >= window))
    return words, left, first, at, hash_windows(words, length)[at]


def _sorted_distinct(high: np.ndarray, low: np.ndarray | None):
    """Distinct hashes in order, the index among them of each input, and which came twice."""
    order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
    if not len(order):
        return high, low, np.zeros(0, np.int64), np.zeros(0, bool)
    h, w = high[order], None if low is None else low[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if w is not None:
        new[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new) - 1
    index = np.empty(len(order), np.int64)
    index[order] = group
    return h[new], None if w is None else w[new], index, np.bincount(group) > 1


def _range_of(high: np.ndarray, ranges: int) -> np.ndarray:
    return ((high >> U64(32)) * U64(ranges)) >> U64(32)


def _send(bucket: int, high: np.ndarray, low: np.ndarray | None, ranges: int) -> pa.Table:
    high, low, _, twice = _sorted_distinct(high, low)
    bounds = np.searchsorted(_range_of(high, ranges), np.arange(ranges + 1))
    full = [r for r in range(ranges) if bounds[r] < bounds[r + 1]]
    cut = lambda x: [x[bounds[r] : bounds[r + 1]].tobytes() for r in full]
    return pa.table({
        "bucket": pa.array([bucket] * len(full), pa.int64()),
        "hash_range": pa.array(full, pa.int64()),
        "hashes": pa.array(cut(high), pa.binary()),
        "more": pa.array([b""] * len(full) if low is None else cut(low), pa.binary()),
        "twice": pa.array([np.packbits(twice[bounds[r] : bounds[r + 1]]).tobytes() for r in full], pa.binary()),
    })


def _repeated(table: pa.Table, kind: int) -> pa.Table:
    """Of one hash range, for each bucket's hashes: does it come twice in all buckets?"""
    highs = [np.frombuffer(x.as_py(), U64) for x in table.column("hashes")]
    lows = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("more")]
    sizes = [len(h) for h in highs]
    flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(table.column("twice"), sizes)]
    low = np.concatenate(lows)
    high, _, index, many = _sorted_distinct(np.concatenate(highs), low if len(low) else None)
    twice = np.zeros(len(high), bool)
    twice[index[np.concatenate(flags)]] = True
    found = (many | twice)[index]
    ends = np.cumsum(sizes)
    return pa.table({
        "bucket": table.column("bucket"),
        "kind": pa.array([kind] * len(sizes), pa.int32()),
        "hash_range": table.column("hash_range"),
        "repeated": pa.array([np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary()),
    })


def _bits(table: pa.Table, kind: int, high: np.ndarray, ranges: int) -> np.ndarray:
    """The answers for the sorted distinct hashes ``high`` of one bucket."""
    bounds = np.searchsorted(_range_of(high, ranges), np.arange(ranges + 1))
    out = np.zeros(len(high), bool)
    for k, r, raw in zip(*(table.column(c).to_pylist() for c in ("kind", "hash_range", "repeated"))):
        if k == kind:
            out[bounds[r] : bounds[r + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=bounds[r + 1] - bounds[r])
    return out


def _extended(table: pa.Table, bits: pa.Table, window: int, period: int, ranges: int):
    """Starts of the full windows that hold a repeated anchor, and their hashes."""
    words, left, first, at, anchor = _anchors(table, window, period)
    high, _, index, _ = _sorted_distinct(anchor, None)
    total = np.zeros(len(words) + 1, np.int64)
    marked = np.zeros(len(words), bool)
    marked[at] = _bits(bits, 0, high, ranges)[index]
    np.cumsum(marked, out=total[1:])
    starts = np.flatnonzero(left >= window)
    starts = starts[total[starts + period] > total[starts]]
    high, low = hash_windows(words, window)[starts], hash_windows(hashed(table.column("text"), second=True)[0], window)[starts]
    return first, len(words), starts, high, (low >> U64(32)).astype(np.uint32)


def _send_anchors(table: pa.Table, window: int, period: int, ranges: int) -> pa.Table:
    return _send(table.column("bucket")[0].as_py(), _anchors(table, window, period)[-1], None, ranges)


def _bucket_of(table: pa.Table, bits: pa.Table) -> int:
    return (table if table.num_rows else bits).column("bucket")[0].as_py()


def _send_windows(table: pa.Table, bits: pa.Table, window: int, period: int, ranges: int) -> pa.Table:
    _, _, _, high, low = _extended(table, bits, window, period, ranges)
    return _send(_bucket_of(table, bits), high, low, ranges)


def _keep(table: pa.Table, bits: pa.Table, window: int, period: int, ranges: int, with_text: bool) -> pa.Table:
    first, n, starts, high, low = _extended(table, bits, window, period, ranges)
    distinct, _, index, _ = _sorted_distinct(high, low)
    edge = np.zeros(n + 1, np.int64)
    hit = starts[_bits(bits, 1, distinct, ranges)[index]]
    edge[hit] += 1
    np.add.at(edge, hit + window, -1)
    gone = np.cumsum(edge)[:n] > 0
    data, offsets = utf8(table.column("text"))
    raw = data.tobytes()
    removed, shas, texts = [], [], []
    for d in range(table.num_rows):
        words, out = raw[offsets[d] : offsets[d + 1]].split(), gone[first[d] : first[d + 1]]
        removed.append(int(out.sum()))
        text = b" ".join([w for w, g in zip(words, out.tolist()) if not g] if removed[-1] else words)
        shas.append(hashlib.sha256(text).hexdigest())
        texts.append(text.decode() if with_text else None)
    return pa.table({
        "row_id": table.column("row_id"), "doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(texts, pa.string()),
    })


def dedup_substrings(
    docs: DataFrame, window: int = 35, period: int = 21, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = 4 << 20, range_hashes: int = 1 << 20, with_text: bool = True,
) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    Returns ``row_id, doc_id, n_words, n_removed, kept_sha256, kept_text`` (null unless
    ``with_text``; kept words joined by one space), one row per input row.  All copies
    of a passage go, and windows are judged on the input.  A null or empty text has no
    words; rows with one id are separate documents; other columns are ignored.
    """
    if window <= period:
        period = max(p for p in COVERS if p <= max(1, window // 2))
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // bucket_bytes))
    ranges = max(8, -(-size * len(COVERS[period]) // period // 6 // range_hashes))
    by = {"window": window, "period": period, "ranges": ranges}
    texts = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets))).groupBy("bucket")
    out = "row_id long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def send_anchors(table: pa.Table) -> pa.Table:
        return _send_anchors(table, **by)

    def send_windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        return _send_windows(table, bits, **by)

    def keep(table: pa.Table, bits: pa.Table) -> pa.Table:
        return _keep(table, bits, with_text=with_text, **by)

    def judged(sent: DataFrame, kind: int) -> DataFrame:
        def repeated(table: pa.Table) -> pa.Table:
            return _repeated(table, kind)

        return sent.groupBy("hash_range").applyInArrow(repeated, _BITS)

    anchors = judged(texts.applyInArrow(send_anchors, _SENT), 0)
    windows = judged(texts.cogroup(anchors.groupBy("bucket")).applyInArrow(send_windows, _SENT), 1)
    bits = anchors.unionByName(windows).groupBy("bucket")
    return texts.cogroup(bits).applyInArrow(keep, out)
