"""Scalar text expressions with the Unicode meaning that selection needs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space and the four separators: what ``(?U)[\s\x1c-\x1f]`` matches, without a pattern to search whole texts for.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A token is one character of the CJK blocks, else a run of letters and digits.
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_SINGLE, _BETWEEN = f"[{_CJK}]", rf"[^\p{{L}}\p{{N}}{_CJK}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order.

    Splitting at what lies between tokens is several times faster than extracting them;
    blanks are put around single characters only where there are any.
    """
    low = F.lower(text)
    apart = F.when(low.rlike(_SINGLE), F.regexp_replace(low, f"({_SINGLE})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(apart, _BETWEEN, -1), "")


def has_token(text: Column) -> Column:
    return text.rlike(rf"[\p{{L}}\p{{N}}{_CJK}]")


def approx_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("long")


def marker_text(template: str, n: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{n}"), n.cast("string"))


def marker_pattern(template: str) -> str:
    """Pattern that finds markers made from ``template``, with the number as group 1."""
    return r"(\d+)".join(re.escape(x) for x in template.split("{n}"))


def marker_total(text: Column, template: str) -> Column:
    """Sum of the numbers in a text's markers."""
    found = F.regexp_extract_all(text, F.lit(marker_pattern(template)), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def last_json_object(text: Column) -> Column:
    """The last flat JSON object in a text that parses."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    good = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return F.try_element_at(good, F.lit(-1))
