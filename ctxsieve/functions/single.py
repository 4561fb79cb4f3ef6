"""Selection of one text at a time in Python, for SQL functions and for streams, where no terms can be counted across rows.

The result is that of ``operators.selection``, which is the form for tables.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from ..config import SEPARATOR, SelectionConfig

_DELIMITER = re.compile(r"\n\s*\n|\n(?P<rule>-{3,}\n)|\n(?P<head>#{1,6}\s)|(?P<cite>\[\d+\]\s)")
_TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W_]+")
_NUMBERED, _HUNK = re.compile(r"\s*\d+\t"), re.compile(r"diff --git |@@ ")


def _sections(text: str) -> tuple[list[str], int]:
    """Parts between delimiters, each with the heading, rule or citation that leads it, and how many have a body."""
    found, lead, at, bodies = [], "", 0, 0
    marks = [(m.start(), m["rule"] or m["head"] or m["cite"] or "", m.end()) for m in _DELIMITER.finditer(text)]
    for stop, following, resume in [*marks, (len(text), "", len(text))]:
        raw = text[at:stop]
        if raw.strip():
            bodies += 1
            found.append(lead + raw.rstrip() if lead else raw.strip())
        elif lead.strip():
            found.append(lead.strip())
        lead, at = following, resume
    return found, bodies


def _runs(lines: list[str], starts: list[bool], keep_boundary: bool) -> list[str]:
    """Runs of lines between boundary lines, which begin the next run or fall away."""
    bounds = [-1, *(i for i, b in enumerate(starts) if b), len(lines)]
    cuts = [lines[(a if keep_boundary and a >= 0 else a + 1) : b] for a, b in zip(bounds, bounds[1:])]
    return ["\n".join(x) for x in cuts if x]


def _line_shapes(text: str, least: int) -> list[str]:
    lines = text.split("\n")
    if text.lstrip()[:1] in ("{", "[") or len(lines) < least:
        return []
    head, shapes = lines[:40], []
    if sum(bool(_NUMBERED.match(x)) for x in head) >= 0.8 * len(head):
        shapes.append(_runs(lines, [not _NUMBERED.sub("", x, count=1).strip() for x in lines], False))
    if any(_HUNK.match(x) for x in lines[:5]):
        shapes.append(_runs(lines, [bool(_HUNK.match(x)) for x in lines], True))
    step = max(1, len(lines) // 12)
    shapes.append(["\n".join(lines[i : i + step]) for i in range(0, len(lines), step)])
    return next((x for x in shapes if len(x) >= least), [])


def split_text(text: str | None, least: int = 4, shapes: bool = True) -> list[str]:
    """Verbatim chunks of a text; none of a null one.  Without ``shapes`` they are its sentences."""
    sections, bodies = _sections(text or "") if shapes else ([], 0)
    if bodies >= 2:
        return sections
    said = [x for x in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if x]
    return said if len(said) >= least or not shapes else _line_shapes(text or "", least) or said


def _scores(chunks: list[str], query: str) -> list[float]:
    counts = [Counter(_TOKEN.findall(t.lower())) for t in [*chunks, query]]
    df = Counter(w for c in counts for w in c)
    weights = [{w: c / sum(n.values()) * math.log((len(counts) + 1) / df[w]) for w, c in n.items()} for n in counts]
    norms = [math.sqrt(math.fsum(x * x for x in w.values())) for w in weights]
    asked = weights[-1]
    dots = [math.fsum(x * asked[w] for w, x in weight.items() if w in asked) for weight in weights[:-1]]
    return [round(dot / (norm * norms[-1]), 12) if norm * norms[-1] else 0.0 for dot, norm in zip(dots, norms)]


def _python_pattern(java: str) -> re.Pattern:
    return re.compile(java.replace("(?iu)", "(?i)").replace(r"\p{L}\p{N}_", r"\w"))


def trim_one(text: str | None, query: str | None, keep: float = 0.6, cfg: SelectionConfig | None = None) -> str | None:
    """``text`` with the chunks that matter least to ``query`` replaced by markers, or as it is."""
    cfg = cfg or SelectionConfig()
    if text is None or not (query or "").strip() or len(text) < cfg.min_message_chars:
        return text
    chunks = split_text(text, cfg.min_chunks, cfg.shapes)
    n = len(chunks)
    if n < cfg.min_chunks:
        return text
    scores, low = _scores(chunks, query), [c.lower() for c in chunks]
    rare = [w for w in set(_TOKEN.findall(query.lower())) if len(w) >= 4 and 1 <= sum(w in c for c in low) <= 2]
    pins = [_python_pattern(p) for p in cfg.pin_patterns]
    first = set(sorted(range(n), key=lambda i: (-scores[i], i))[: max(1, min(n, round(n * keep)))])
    floor = max(0.0, max(scores)) * cfg.relative_floor

    def stays(i: int) -> bool:
        pinned, edge = any(p.search(chunks[i]) for p in pins) or any(w in low[i] for w in rare), i in (0, n - 1)
        return (i in first or pinned or edge and cfg.keep_lead_tail) and (scores[i] >= floor or pinned or edge)

    kept = [i for i in range(n) if stays(i)]
    if len(kept) == n:
        return text
    out = []
    for before, here in zip([-1, *kept], [*kept, n]):
        if here - before > 1:
            out.append(cfg.drop_marker.replace("{n}", str(here - before - 1)))
        out += chunks[here : here + 1]
    return SEPARATOR.join(out)
