"""Near-duplicate groups by b-bit MinHash, with links confirmed on full shingle sets.

1. One pass over the texts gives each document its set size, a 128-bit BLAKE2 digest of its
   words, ``bands`` band keys of ``rows`` minima each, and the two low bits of all minima
   packed into longs.  At the similarity asked for, a pair misses every band with a chance
   of (1 - 0.8**4)**32 = 5e-8.
2. Equal word sequences collapse to a class; copies meet no other step until the end.
3. Classes that share a band key meet in its bucket.  Each member is paired with the pivot
   of its bucket, and with a few pivots of the narrower buckets of three bands together,
   not with all members.  Packed signatures are compared by bit counts: similarity is
   (share of equal fields - 1/4) / (3/4), and only pairs far below the threshold are let
   go.  The others are confirmed on full sets, and links give components.
4. Buckets that still hold several components go on.  Small ones pair up the members of
   different components.  Of large ones, blocks of signatures are compared inside tasks,
   which give one pair for each two components that seem linked; their sets decide.  What
   this leaves apart goes through the full sets of all pairs that pass the bit counts, again
   block by block inside tasks, which give out only links that join components.  So no link
   between components is lost however large a bucket is, and no group is written as pairs.

Loops cut their lineage with checkpoints in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import session
from .session import BATCH, FEW, keyed, numbered, release, ship, small, unused
from .words import U64, chunks, hash_windows, hash_words, mix, utf8, word_spans

BANDS, ROWS = 32, 4
_MINIMA = BANDS * ROWS
_BITS = 2
_LONGS = _MINIMA * _BITS // 64
_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, _MINIMA + ROWS, dtype=U64) * U64(2) + U64(1)
#: Estimates lie under this for a pair at 0.8 once in about 1e9 (six standard deviations).
_FLOOR = 0.55
_SIGNATURE = [f"s{i}" for i in range(_LONGS)]
#: Pivots of a bucket, members of one that is paired up, signatures and texts of a block.
_PIVOTS, _SMALL_BUCKET, _BLOCK, _TEXTS = 2, 32, 2048, 128


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """``session.cut``; then the driver collects garbage, as many short jobs in a row fill its heap."""
    done = session.cut(df, batch)
    release(df.sparkSession)
    return done


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    done = session.counted(df)
    release(df.sparkSession)
    return done


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the bounds between documents."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    words, n = hash_words(data, starts, ends, lower=True), np.diff(first)
    left = np.repeat(first[1:], n) - np.arange(len(words))
    whole = left[: max(0, len(words) - k + 1)] >= k
    doc, hashes = np.repeat(np.arange(len(n)), n)[: len(whole)][whole], hash_windows(words, k)[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        few = [hash_windows(words[first[d] : first[d + 1]], int(n[d]))[0] + U64(int(n[d])) for d in short]
        doc, hashes = np.concatenate((doc, short)), np.concatenate((hashes, mix(np.array(few, U64))))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray):
    """For each set: band keys, and packed low bits of the minima."""
    n = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds))
    keys, packed = np.zeros((n, BANDS), U64), np.zeros((n, _LONGS), U64)
    if len(full):
        at, minima = bounds[full], np.empty((_MINIMA, len(full)), U64)
        for i in range(_MINIMA):
            minima[i] = np.minimum.reduceat(hashes * _FACTORS[i], at)
        for b in range(BANDS):
            joined = sum(minima[b * ROWS + r] * _FACTORS[_MINIMA + r] for r in range(ROWS))
            keys[full, b] = mix(joined + U64(b + 1))
        fields = mix(minima) & U64((1 << _BITS) - 1)
        for i in range(_MINIMA):
            packed[full, i * _BITS // 64] |= fields[i] << U64(i * _BITS % 64)
    return keys, packed


def sequence_digests(column) -> np.ndarray:
    """Two longs of a digest of each text's lower-cased words, joined by one space."""
    data, offsets = utf8(column)
    raw = data.tobytes().lower()
    ends = offsets.tolist()
    digests = b"".join(blake2b(b" ".join(raw[i:j].split()), digest_size=16).digest() for i, j in zip(ends, ends[1:]))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _features(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "doc_id", "n_shingles", "seq_a", "seq_b", *_SIGNATURE, "bands"]
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                hashes, bounds = shingle_sets(part.column(2), k)
                keys, packed = signatures(hashes, bounds)
                n, digests = np.diff(bounds), sequence_digests(part.column(2))
                sizes = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), *(pa.array(digests[:, x].copy()) for x in range(2)),
                     *(pa.array(packed[:, x].copy().view(np.int64)) for x in range(_LONGS)),
                     pa.ListArray.from_arrays(sizes, pa.array(keys[n > 0].reshape(-1).view(np.int64)))], names)

    longs = ", ".join(f"{c} long" for c in ("row_id", "doc_id", "n_shingles", "seq_a", "seq_b", *_SIGNATURE))
    return rows.mapInArrow(run, f"{longs}, bands array<long>")


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of the packed signatures of two structs."""
    differ = F.lit(0)
    for s in _SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / (1 << _BITS)
    return ((1 - differ / F.lit(float(_MINIMA))) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b, linked`` of the pairs (a, b) that pass the bit counts: do their full sets pass?"""
    side = lambda name: nodes.select(F.col("rep").alias(name), F.struct(*_SIGNATURE).alias(f"sig_{name}"))
    # ``nodes`` carries its own hint to be broadcast where it is small
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(estimate("sig_a", "sig_b") >= _FLOOR).select("a", "b")
    with_texts = likely.join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, one = utf8(batch.column(2))
            _, two = utf8(batch.column(3))
            for i, j in chunks(one + two, 1 << 20):
                (x, at), (y, to) = (shingle_sets(batch.column(c).slice(i, j - i), k) for c in (2, 3))
                good = []
                for d in range(j - i):
                    p, q = x[at[d] : at[d + 1]], y[to[d] : to[d + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return with_texts.mapInArrow(run, "a long, b long, linked boolean")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _stars(reps: DataFrame, active: DataFrame) -> DataFrame:
    """Different pairs (a, b) of members with pivots of their buckets, of one band and of three neighbouring ones.

    Three bands together hold mostly linked classes, and few unlinked pairs share them.
    """
    three = lambda i: F.xxhash64(i, *(F.get("bands", (i + j) % BANDS) for j in range(3)))
    keys = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), three)).alias("key"))
    chosen = F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(_PIVOTS)))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), chosen.alias("pivots")).where("x != y")
    narrow = keys.join(pivots.select("key", F.explode(F.array_distinct("pivots")).alias("pivot")), "key").where("rep != pivot")
    wide = active.where("rep != pivot")
    return narrow.select(*_ordered("rep", "pivot")).union(wide.select(*_ordered("rep", "pivot"))).distinct()


def _block_pairs(members: DataFrame, group: str, size: int, columns: list[str]) -> DataFrame:
    """``group, i, j, block`` and columns of the members of ``group``, of ``n`` members, once for each two blocks that a member's block meets."""
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / F.lit(size)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)


class _Compared:
    """The members of two blocks: which pairs of different components pass sizes and bit counts."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        column = lambda c: np.asarray(table.column(c))
        self.percent, self.rep, self.size = percent, column("rep"), column("n_shingles")
        names, self.component = np.unique(column("component"), return_inverse=True)
        self.packed = np.stack([column(c).view(U64) for c in _SIGNATURE], 1)
        self.root = np.arange(len(names))
        i, j, block = table.column("i")[0].as_py(), table.column("j")[0].as_py(), column("block")
        self.one, self.two, self.same = np.flatnonzero(block == i) if len(names) > 1 else np.zeros(0, int), np.flatnonzero(block == j), i == j
        self.most_differ = int((1 - _FLOOR) * (1 - 1 / (1 << _BITS)) * _MINIMA)

    def near(self, a: int) -> np.ndarray:
        """Members that may be linked with ``a``, the most alike first."""
        fits = (self.root[self.component[self.two]] != self.root[self.component[a]]) & (
            100 * np.minimum(self.size[self.two], self.size[a]) >= self.percent * np.maximum(self.size[self.two], self.size[a]))
        near = self.two[fits & ((self.rep[self.two] > self.rep[a]) if self.same else True)]
        x = self.packed[near] ^ self.packed[a]
        differ = np.bitwise_count((x | x >> U64(1)) & U64(0x5555555555555555)).sum(1)
        return near[differ <= self.most_differ][np.argsort(differ[differ <= self.most_differ], kind="stable")]

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[self.component[b]]] = self.root[self.component[a]]


def _pairs_table(rep: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = (rep[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _spanning_pairs(large: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within large buckets ``(key, n, rep, component)`` that would join all components that seem linked.

    Each two blocks of a bucket are one group of signatures.  Of each two components met, the
    pair most alike is given, as if it were a link, until nothing more is to be joined.
    """

    def compare(table: pa.Table) -> pa.Table:
        met, pairs = _Compared(table, percent), []
        for a in met.one:
            near = met.near(a)
            for b in near[np.sort(np.unique(met.component[near], return_index=True)[1])]:
                if met.root[met.component[b]] != met.root[met.component[a]]:
                    met.join(a, b)
                    pairs.append((a, b))
        return _pairs_table(met.rep, pairs)

    blocks = _block_pairs(large.join(nodes, "rep"), "key", _BLOCK, ["rep", "component", "n_shingles", *_SIGNATURE])
    return blocks.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _joining_links(large: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components that links within large buckets join.

    What seemed linked and was not is looked at pair by pair, inside tasks: large buckets
    that share members are one cluster, each two blocks of a cluster are one group, bit
    counts choose the pairs whose full sets are compared, and only links that join
    components are given out, fewer than a group has members.
    """
    first = large.groupBy("key").agg(F.min("rep").alias("pivot"))
    ties = large.join(first, "key").where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    cluster = components(ties).toDF("rep", "cluster")
    member = cut(large.select("rep", "component").distinct().join(cluster, "rep"))
    sizes = member.groupBy("cluster").agg(F.count("*").alias("n"))
    members = member.join(sizes, "cluster").join(nodes, "rep").join(texts.withColumnRenamed("row_id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        met, links = _Compared(table, percent), []
        if len(met.one):
            hashes, bounds = shingle_sets(table.column("text"), k)
            _, ids = np.unique(hashes, return_inverse=True)
            sets = [ids[bounds[d] : bounds[d + 1]] for d in range(len(met.rep))]
            held = np.zeros(len(ids) + 1, bool)
            for a in met.one:
                held[sets[a]] = True
                for b in met.near(a):
                    if met.root[met.component[b]] != met.root[met.component[a]]:
                        both = int(held[sets[b]].sum())
                        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                            met.join(a, b)
                            links.append((a, b))
                held[sets[a]] = False
        return _pairs_table(met.rep, links)

    blocks = _block_pairs(members, "cluster", _TEXTS, ["rep", "component", "n_shingles", *_SIGNATURE, "text"])
    return cut(blocks.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), batch=BATCH)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; the label is some node of the component."""
    return _labelled(links)[0]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, parent`` of all links: the node itself and one node of its component."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while root.setdefault(node, node) != node:
            root[node] = node = root[root[node]]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root[find(a)] = find(b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "parent"])


def _labelled(links: DataFrame) -> tuple[DataFrame, int]:
    """``components`` of ``links``, and the number of nodes.

    Each round gives every node the neighbour that comes first in a hashed order, if that
    comes before the node itself, and contracts the links to those between different
    labels.  The hashed order keeps chains short, and links shrink from round to round;
    as soon as they are counted as few, one task joins what is left.
    """
    links, left = counted(links.where("a != b").select(*_ordered("a", "b")).distinct())
    labels, nodes = None, 0
    while left or labels is None:
        if left <= FEW:
            parent, n = counted(links.coalesce(1).mapInArrow(_united, "node long, parent long"))
        else:
            both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
            nearest = both.groupBy("node").agg(F.min_by("other", F.xxhash64("other")).alias("first"))
            parent, n = counted(nearest.select("node", F.when(F.xxhash64("first") < F.xxhash64("node"), F.col("first")).otherwise(F.col("node")).alias("parent")))
        if labels is None:
            labels, nodes = parent.toDF("node", "component"), n
        else:
            labels = labels.join(small(parent.toDF("component", "parent"), n), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        if left <= FEW:
            break
        ends = links.join(small(parent.toDF("a", "x"), n), "a").join(small(parent.toDF("b", "y"), n), "b")
        links, left = counted(ends.where("x != y").select(*_ordered("x", "y")).distinct())
    return small(cut(labels), nodes), nodes


def _joined(labels: DataFrame, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """``labels`` of ``n`` nodes after further ``links`` between nodes, and the number of nodes.

    Only the links between different components, as links of their labels, go through rounds.
    """
    label = lambda end, name: labels.select(F.col("node").alias(end), F.col("component").alias(name))
    ends = links.select("a", "b").join(small(label("a", "x"), n), "a", "left").join(small(label("b", "y"), n), "b", "left")
    merged, m = _labelled(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    if not m:
        return labels, n
    moved = labels.join(small(merged.toDF("component", "target"), m), "component", "left").select("node", F.coalesce("target", "component").alias("component"))
    new = merged.join(small(labels.select("node"), n), "node", "left_anti").select("node", "component")
    done, n = counted(moved.union(new))
    return small(done, n), n


def _placed(active: DataFrame, labels: DataFrame, least_size: int) -> DataFrame:
    """``key, n, rep, component`` of the buckets of ``least_size`` members or more that hold several components."""
    placed = active.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where((F.col("x") != F.col("y")) & (F.col("n") >= least_size))
    return placed.join(several.select("key", "n"), "key")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, doc_id, n_shingles, component, component_id, kept``, one row per input row.

    Words are blank-separated, with A-Z lower-cased; a document's set holds its distinct
    shingles of ``shingle`` words, or its whole sequence if it is shorter.  Documents
    are linked when 100 * intersection >= percent * union; ``component_id`` is the least
    doc_id reachable and ``kept`` marks it.  Null and empty texts have an empty set, are
    linked with nothing and kept.  Rows that repeat an id are linked through their texts
    like any others; a null id is never least unless its whole component is null.
    ``component`` is a row_id of the component, so it tells groups apart whatever their ids.
    """
    return _grouped(keyed(docs, id_col, text_col), shingle, percent)


def _grouped(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` of ``rows (row_id, doc_id, text)``, whose ids are the same wherever it is read."""
    spark = rows.sparkSession
    ship(spark)
    features = cut(_features(rows, shingle), batch=BATCH)
    same = ["seq_a", "seq_b"]
    classes = cut(features.where("n_shingles > 0").groupBy(*same).agg(F.min("row_id").alias("rep"), F.min("doc_id").alias("low")))
    reps = cut(features.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "rep"))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot != last").select("key", "pivot")
    active = cut(keys.join(shared, "key"))
    nodes, n = counted(reps.join(active.select("rep"), "rep", "left_semi").select("rep", "n_shingles", *_SIGNATURE, "bands"))
    texts = cut(rows.join(nodes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select("row_id", "text"))
    nodes, bands = small(nodes.drop("bands"), n), nodes.select("rep", "bands")

    tried = cut(_confirmed(_stars(bands, active), nodes, texts, shingle, percent), batch=BATCH)
    labels, known = _labelled(tried.where("linked"))

    open_, n = counted(_placed(active, labels, 3))  # a pair alone in a bucket has been tried
    few, large = open_.where(F.col("n") <= _SMALL_BUCKET), open_.where(F.col("n") > _SMALL_BUCKET)
    one, two = (few.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component"))) for s in ("a", "b"))
    pairs = one.join(two, "key").where("rep_a < rep_b and component_a != component_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    if not large.isEmpty():
        pairs = pairs.union(_spanning_pairs(large, nodes, percent)).distinct()
    if n:
        more = cut(_confirmed(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), nodes, texts, shingle, percent), batch=BATCH)
        labels, known = _joined(labels, known, more.where("linked"))
        large, n = counted(_placed(active.join(large.select("key").distinct(), "key", "left_semi"), labels, _SMALL_BUCKET + 1))
        if n:
            labels, known = _joined(labels, known, _joining_links(large, nodes, texts, shingle, percent))

    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = cut(of_class.join(least, "component").select(*same, "component", "component_id"))
    return (
        features.select("row_id", "doc_id", "n_shingles", *same)
        .join(of_class, same, "left")
        .select("row_id", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("row_id")).alias("component"),
                F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group, with all its columns; every row without a word stays."""
    row = unused(docs, "row")
    copy = numbered(docs, row)
    rows = copy.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _grouped(rows, shingle, percent).where("kept")
    first = found.groupBy("component").agg(F.min("row_id").alias(row)).select(row)
    return copy.join(first, row, "left_semi").drop(row)
