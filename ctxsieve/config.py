"""Selection settings and fixed texts."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Markers, patterns, roles, tiers and names that results depend on.
DROP_MARKER = "[… {n} passage(s) omitted as not relevant to this question — the remaining context is sufficient …]"
NEUTRAL_MARKER = "[… {n} lower-relevance passage(s) omitted …]"
DEONTIC_WORDS = ("must", "never", "do not", "don't", "shall not", "prohibited", "required", "only if")
SENSITIVE_WORDS = ("PII", "HIPAA", "PCI", "SSN", "password", "secret", "api[_ ]?key")
SELECTABLE_ROLES = ("user", "tool", "function")
TIER_KEEP = {"simple": 0.45, "mid": 0.55, "medium": 0.55, "complex": 0.70, "reasoning": 0.85}
DEFAULT_TIER_KEEP = 0.55
FULL_WRITE_TOOLS = ("Write", "NotebookEdit")
MUTATING_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
CACHE_WRITE, CACHE_READ = 1.25, 0.10
SEPARATOR = "\n\n"


def _bounded(words: tuple[str, ...]) -> str:
    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class SelectionConfig:
    """Gates, budget bounds and guards of a selection; patterns are Java regular expressions.

    Without ``shapes`` a text is split into sentences only, whatever delimiters or lines it has.
    """

    min_message_chars: int = 800
    min_chunks: int = 4
    shapes: bool = True
    min_keep_ratio: float = 0.25
    max_keep_ratio: float = 1.0
    relative_floor: float = 0.35
    keep_lead_tail: bool = True
    drop_marker: str = DROP_MARKER
    selectable_roles: tuple[str, ...] = SELECTABLE_ROLES
    pin_patterns: tuple[str, ...] = (_bounded(DEONTIC_WORDS), _bounded(SENSITIVE_WORDS))

    def with_keep(self, keep: float) -> SelectionConfig:
        """Pin both bounds to ``keep``, which makes tiers and complexity inert."""
        return replace(self, min_keep_ratio=keep, max_keep_ratio=keep)


def keep_ratio(cfg: SelectionConfig, tier: str | None = None, complexity: float | None = None) -> float:
    """Clamped keep ratio; a complexity score overrides the tier."""
    wanted = TIER_KEEP.get(tier or "", DEFAULT_TIER_KEEP) if complexity is None else 0.30 + 0.6 * complexity
    return max(cfg.min_keep_ratio, min(cfg.max_keep_ratio, wanted))


def keep_column(cfg: SelectionConfig, tier, complexity=None):
    """``keep_ratio`` of a tier and a complexity that are columns or plain values."""
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    tier = tier if isinstance(tier, Column) else F.lit(tier)
    wanted = F.lit(DEFAULT_TIER_KEEP)
    for name, share in TIER_KEEP.items():
        wanted = F.when(tier == name, F.lit(share)).otherwise(wanted)
    if complexity is not None:
        score = complexity if isinstance(complexity, Column) else F.lit(float(complexity))
        wanted = F.coalesce(0.30 + 0.6 * score.cast("double"), wanted)
    return F.greatest(F.lit(cfg.min_keep_ratio), F.least(F.lit(cfg.max_keep_ratio), wanted))


def from_conf(spark, prefix: str = "ctxsieve."):
    """``keep, cfg, enabled`` of the session's settings ``ctxsieve.keep``, ``ctxsieve.minChars`` and ``ctxsieve.disable``."""
    get = lambda k: spark.conf.get(prefix + k, None)
    cfg = replace(SelectionConfig(), **({"min_message_chars": int(get("minChars"))} if get("minChars") else {}))
    return float(get("keep") or 0.8), cfg, (get("disable") or "").lower() not in ("1", "true", "yes")
