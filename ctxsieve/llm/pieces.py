"""SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces and scores of a model are read as a unigram lexicon: an encoding is the path
of pieces with the greatest sum of scores.  The search reads a text from left to right
and keeps only the boundaries within the longest piece's reach.  Whenever the
backpointer paths of all of them meet in one boundary, the ids up to it are final: they
are given out and forgotten, so the state of a text of any length stays small.  Between
two neighbouring characters that stand side by side in no piece every path has a
boundary, so long runs without a space are cut there, and the stretches between are cached
as short runs are.  What the cache lacks of a slice of rows is searched side by side: arrays
hold the boundaries of many short texts, and all of them move on together.

Characters without a piece become their UTF-8 bytes' pieces.  The space mark itself, if
it stands in a text, is written that way too, so that decoding restores every text.  In a
model without byte pieces they become the unknown piece, and ``round_trip`` is false.  A
model with pieces that span words is rejected, as texts are cut into words first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .words import U64, chunks, utf8

MARK = "▁"
#: Stands for the mark as a character of the text; in no piece, and put into bytes.
_OWN_MARK = "▁"
#: Characters read before the first look for a common boundary, and between looks.
_WINDOW = 64
#: Entries of each of the two generations of the cache, and the longest stretch kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Fewer texts than this are searched one by one; characters that are searched side by side.
FEW, _SIDE_BY_SIDE = 500, 1 << 16
#: Bytes of the texts that are encoded together; a longer text stands alone.
_SLICE = 1 << 19
#: Stands behind each of the texts that are searched side by side; no character's number.
_END = 0x1FFFFF
_RUN = re.compile(r" +[^ ]*")
_OWN_MARK = re.compile(f"({MARK})")


class _Steps:
    """The trie of the pieces for arrays of nodes: a hash table with linear probing.

    Node 0 is the root, the last one stands for no piece's beginning.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]]) -> None:
        number = {"": 0}
        for piece in pieces:
            for j in range(1, len(piece) + 1):
                number.setdefault(piece[:j], len(number))
        self.none = n = len(number)
        begins = list(number)[1:]
        parents = np.array([number[x[:-1]] for x in begins], np.int64)
        keys = parents << 21 | np.array([ord(x[-1]) for x in begins], np.int64)
        self.inner = np.zeros(n + 1, bool)
        self.inner[parents] = True
        self.gain, self.piece = np.full(n + 1, -np.inf), np.full(n + 1, -1, np.int32)
        for piece, (score, i) in pieces.items():
            self.gain[number[piece]], self.piece[number[piece]] = score, i
        bits = (4 * n).bit_length()
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, n, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.to[slot[won]] = left[won] + 1
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to."""
        keys = nodes << 21 | codes
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], self.none)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Lexicon:
    """Pieces, scores and byte pieces of a SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        self.pieces, self.bytes = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(b"")
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (model.get_score(i), i)
                self.text[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans words; words can't be encoded alone")
        self.unknown_id = model.unk_id()
        self.unknown = min((s for s, _ in self.pieces.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        self.trie: dict[str, list] = {}  # character: [what follows, score and id of the piece that ends here]
        for piece, (score, i) in self.pieces.items():
            node = [self.trie, 0.0, None]
            for c in piece:
                node = node[0].setdefault(c, [{}, 0.0, None])
            node[1:] = score, i
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.steps = _Steps(self.pieces)
        self.cache: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.older: dict[str, bytes] = {}

    def spell(self, char: str) -> tuple[int, ...]:
        spelt = tuple(self.bytes.get(b, self.unknown_id) for b in char.encode())
        return (self.unknown_id,) if self.unknown_id in spelt else spelt

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` (with marks for spaces), given out as paths converge.

        Of equal paths the one whose last piece is longest wins.
        """
        trie, longest, unknown = self.trie, self.longest, self.unknown
        low = float("-inf")
        n, base = len(text), 0  # lists begin at boundary ``base``
        room = min(n, _WINDOW + longest) + 1
        best, back, last = [low] * room, [0] * room, [None] * room
        best[0] = 0.0
        for i in range(n):
            at = i - base
            if at >= _WINDOW:
                met = self._meeting(best, back, at, min(n - base, at + longest - 1), low)
                yield self._ids(text, back, last, met, base)
                base, at = base + met, at - met
                grow = max(0, min(n - base, at + _WINDOW + longest) + 1 - (len(best) - met))
                best, back, last = best[met:] + [low] * grow, [x - met for x in back[met:]] + [0] * grow, last[met:] + [None] * grow
            score = best[at]
            if score == low:
                continue
            after, to, single = trie, at, False
            for c in text[i : i + longest]:
                node = after.get(c)
                if node is None:
                    break
                after, gain, piece = node
                to += 1
                if piece is not None:
                    if score + gain > best[to]:
                        best[to], back[to], last[to] = score + gain, at, piece
                    single = single or to == at + 1
            if not single and score + unknown > best[at + 1]:
                best[at + 1], back[at + 1], last[at + 1] = score + unknown, at, None
        yield self._ids(text, back, last, n - base, base)

    def _ids(self, text: str, back: list[int], last: list, to: int, base: int) -> list[int]:
        """Ids of the best path from the lists' beginning to boundary ``to``."""
        out: list[int] = []
        while to > 0:
            if last[to] is None:
                out.extend(reversed(self.spell(text[base + back[to]])))
            else:
                out.append(last[to])
            to = back[to]
        return out[::-1]

    @staticmethod
    def _meeting(best: list[float], back: list[int], first: int, end: int, low: float) -> int:
        """The last boundary that the paths of all live boundaries have in common."""
        live = {x for x in range(first, min(end + 1, len(best))) if best[x] != low}
        while len(live) > 1:
            x = max(live)
            live.remove(x)
            live.add(back[x])
        return live.pop()

    def stretches(self, text: str) -> list[str]:
        """``text`` cut between characters that no piece has side by side."""
        pairs = self.pairs
        cuts = [i + 1 for i in range(len(text) - 1) if text[i : i + 2] not in pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def search_all(self, texts: list[str]) -> list[bytes]:
        """What ``search`` gives for each of many short texts, found side by side.

        A text of n characters has n + 1 places in the arrays, one for each boundary.  In
        step i the paths of all texts go on from boundary i, so ties end as in ``search``.
        """
        n = np.array(list(map(len, texts)), np.int64)
        order = np.argsort(-n, kind="stable")
        n, order = n[order], order.tolist()
        starts = np.concatenate(([0], np.cumsum(n + 1)))
        codes = np.frombuffer(("\0".join([texts[k] for k in order]) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[starts[1:] - 1] = _END
        room = len(codes) + 1  # one more, for steps that end at the last ``_END``
        best, size, last = np.full(room, -np.inf), np.zeros(room, np.int64), np.full(room, -1, np.int32)
        best[starts[:-1]] = 0.0
        steps = self.steps
        for i in range(int(n.max(initial=0))):
            at = starts[: np.searchsorted(-n, -i)] + i
            node, score = np.zeros(len(at), np.int64), best[at]
            for d in range(max(1, self.longest)):
                node, to = steps.follow(node, codes[at + d]), at + d + 1
                gain, piece = steps.gain[node], steps.piece[node]
                total = score + (gain if d else np.where(piece < 0, self.unknown, gain))
                better = total > best[to]
                to = to[better]
                best[to], size[to], last[to] = total[better], d + 1, piece[better]
                more = steps.inner[node]
                at, node, score = at[more], node[more], score[more]
                if not len(at):
                    break
        reached = np.zeros(len(codes), bool)
        place, first = starts[1:] - 1, starts[:-1]
        while len(place):
            more = place > first
            place, first = place[more], first[more]
            reached[place] = True
            place = place - size[place]
        ends = np.flatnonzero(reached)
        ids, lengths = last[ends], np.ones(len(ends), np.int64)
        if (ids < 0).any():
            unknown = codes[ends[ids < 0] - 1].tolist()
            spelt = {c: self.spell(chr(c)) for c in set(unknown)}
            lengths[ids < 0] = [len(spelt[c]) for c in unknown]
            ids = np.repeat(ids, lengths)
            ids[ids < 0] = list(chain.from_iterable(spelt[c] for c in unknown))
        bounds = 4 * np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(ends, starts)]
        raw, out = ids.astype("<i4").tobytes(), [b""] * len(texts)
        for k, a, b in zip(order, bounds.tolist(), bounds[1:].tolist()):
            out[k] = raw[a:b]
        return out

    def _solve(self, texts: set[str]) -> dict[str, bytes]:
        """Ids of different texts (with marks for spaces); long ones are read one by one."""
        found: dict[str, bytes] = {}
        short = sorted((t for t in texts if len(t) <= CACHE_CHARS), key=len)
        if len(short) >= FEW:
            ends = np.cumsum([len(t) + 1 for t in short])
            edges = [0, *(np.flatnonzero(np.diff(ends // _SIDE_BY_SIDE)) + 1).tolist(), len(short)]
            for a, b in zip(edges, edges[1:]):
                found.update(zip(short[a:b], self.search_all(short[a:b])))
        for t in texts:
            if t not in found:
                found[t] = np.array(list(chain.from_iterable(self.search(t))), "<i4").tobytes()
        return found

    def _run_ids(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of runs of spaces and what follows."""
        found = dict(zip(runs, map(self.cache.get, runs)))
        missing = [run for run, ids in found.items() if ids is None]
        older = {run: ids for run, ids in zip(missing, map(self.older.get, missing)) if ids is not None}
        new = [run for run in missing if run not in older]
        odd = [run for run in new if MARK in run or len(run) > CACHE_CHARS]
        cut = {}
        for run in odd:
            parts = [(part == MARK, part.replace(" ", MARK)) for part in _OWN_MARK.split(run) if part]
            cut[run] = [x for own, part in parts for x in ([None] if own else self.stretches(part))]
        plain = {run: run.replace(" ", MARK) for run in new if run not in cut}
        stretches = set(chain.from_iterable(cut.values())) - {None}
        known = {x: self.cache.get(x) or self.older.get(x) for x in stretches}
        known.update(self._solve({x for x in stretches if known[x] is None}.union(plain.values())))
        kept = older | {x: known[x] for x in stretches} | dict(zip(plain, map(known.__getitem__, plain.values())))
        known[None] = np.array(self.spell(MARK), "<i4").tobytes()
        kept.update((run, b"".join([known[x] for x in parts])) for run, parts in cut.items())
        self._keep([(key, ids) for key, ids in kept.items() if len(key) <= CACHE_CHARS])
        found.update(kept)
        return found

    def _keep(self, entries: list[tuple[str, bytes]]) -> None:
        at = 0
        while at < len(entries):
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            end = at + CACHE_ENTRIES - len(self.cache)
            self.cache.update(entries[at:end])
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each read with one space in front, as little-endian 32-bit numbers."""
        runs = [_RUN.findall(" " + t) if t else [] for t in texts]
        ids = self._run_ids(set(chain.from_iterable(runs)))
        return [b"".join(map(ids.__getitem__, r)) for r in runs]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, which is read with one space in front."""
        return np.frombuffer(self.encode_all([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


_lexicons: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """The lexicon of the model at ``path``, read once per process."""
    if path not in _lexicons:
        _lexicons[path] = Lexicon(path)
    return _lexicons[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_crc32, round_trip``, one row per input row.

    ``ids_crc32`` is over the ids as little-endian 32-bit numbers; ``round_trip`` says that
    decoding them gives the text again.  A null text is empty and has no ids; ``ids`` is
    null unless ``with_ids``.
    """
    import zlib

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lexicon(model_path)
        for batch in batches:
            for start, end in chunks(utf8(batch.column(1))[1], _SLICE):
                part = batch.slice(start, end - start)
                texts = part.column(1).to_pylist()
                ids = model.encode_all(texts)
                same = [model.decode(np.frombuffer(i, "<i4").tolist()) == t for i, t in zip(ids, texts)]
                ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4") if with_ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(ends, flat) if with_ids else pa.nulls(len(ids), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends), pa.int64()), lists, pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
                )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the decoded text in a new column; null ids give a null text."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        model = lexicon(model_path)
        return pd.Series([None if x is None else model.decode(list(x)) for x in ids], dtype=object)

    return encoded.withColumn(name, decoded(F.col(ids_col)))
