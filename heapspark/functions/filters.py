"""Filters as typed above a result's columns: ranges and comparisons of numbers, patterns of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .values import smart_fix, whole

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _number(text: str, percent: bool) -> float:
    text = text.strip()
    return float(text[:-1]) / 100 if percent and text.endswith("%") else float(text)


def numeric(x: Column, text: str, percent: bool = False) -> Column:
    """`a..b` (ends included, either may be open), `!a..b` (outside, NaN passes), `U\\a..b` (outside,
    NaN fails), a comparison, or a number alone for equality.  A null value counts as NaN.  percent: `10%` is 0.1.
    """
    text = text.strip()
    v = F.coalesce(x.cast("double"), F.lit(float("nan")))
    some = ~F.isnan(v)
    outside, universe = text.startswith("!") and not text.startswith("!="), text.startswith("U\\")
    body = text[1:] if outside else text[2:] if universe else text
    if ".." in body:
        low, high = body.split("..", 1)
        inside = some
        if low.strip():
            inside = inside & (v >= _number(low, percent))
        if high.strip():
            inside = inside & (v <= _number(high, percent))
        return ~inside if outside else some & ~inside if universe else inside
    m = re.fullmatch(r"(>=|<=|<>|!=|>|<|=)?\s*(.+)", body)
    op, n = m[1] or "=", _number(m[2], percent)
    if n != n:
        same = F.isnan(v)
        return ~same if op in ("<>", "!=") else same if op in ("=", ">=", "<=") else F.lit(False)
    return {">": some & (v > n), ">=": some & (v >= n), "<": some & (v < n), "<=": some & (v <= n), "<>": ~(some & (v == n)), "!=": ~(some & (v == n)), "=": some & (v == n)}[op]


def text(x: Column, pattern: str) -> Column:
    """A pattern found anywhere unless it is anchored; null fails."""
    return F.coalesce(x.cast("string").rlike(whole(smart_fix(pattern, anywhere=True))), F.lit(False))
