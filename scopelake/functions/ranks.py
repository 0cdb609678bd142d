"""Fractional ranks: strings over 62 digits that sort by code point, with room between any two.

A rank is read as a fraction written in base 62. The helpers are plain Python; rank_between_column applies them to
columns in Arrow batches.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_AT = {c: i for i, c in enumerate(DIGITS)}


def is_valid_rank(rank: str | None) -> bool:
    """Not empty, digits only, and not ending in the zero digit (which would leave no room before it)."""
    return bool(rank) and all(c in _AT for c in rank) and rank[-1] != DIGITS[0]


def between(low: str | None, high: str | None) -> str:
    """A shortest rank strictly between two ranks; None is the open end on its side. In whole numbers, a digit at a time."""
    a, b = [_AT[c] for c in low or ""], [_AT[c] for c in high or ""]
    ends = len(high.rstrip(DIGITS[0])) if high else 0
    if high and (low or "").rstrip(DIGITS[0]) >= high.rstrip(DIGITS[0]):
        raise ValueError("the lower rank must come before the upper one")
    length, x, y = 0, 0, 0 if high else 1
    while True:
        x = x * 62 + (a[length] if length < len(a) else 0)
        y = y * 62 + (b[length] if length < len(b) else 0)
        length += 1
        first, last = x + 1, y if length < ends else y - 1
        if first <= last:
            whole = (first + last + 1) // 2
            break
    out = ""
    for _ in range(length):
        whole, digit = divmod(whole, 62)
        out = DIGITS[digit] + out
    return out.rstrip(DIGITS[0])


def rank_between(low: str | None, high: str | None, rng: random.Random | None = None) -> str:
    """between() with two random digits appended, so that ranks made at once on both sides rarely clash."""
    for r in (low, high):
        if r is not None and not is_valid_rank(r):
            raise ValueError(f"not a rank: {r!r}")
    if low is not None and high is not None and low >= high:
        raise ValueError("the lower rank must come before the upper one")
    rng = rng or random.Random()
    middle = between(low, high)
    while True:
        out = middle + rng.choice(DIGITS) + rng.choice(DIGITS[1:])
        if (low is None or low < out) and (high is None or out < high):
            return out
        middle = between(middle, high)


def rebalance(count: int) -> list[str]:
    """count ascending ranks, evenly spread; they depend on the count alone."""
    out: list[str | None] = [None] * count
    stack = [(0, count, None, None)]
    while stack:
        a, b, low, high = stack.pop()
        if a < b:
            mid = (a + b) // 2
            out[mid] = between(low, high)
            stack += [(a, mid, low, out[mid]), (mid + 1, b, out[mid], high)]
    return out


def rank_at(position: int, count: int) -> str:
    """rebalance(count)[position], by the halves that lead there alone."""
    a, b, low, high = 0, count, None, None
    while True:
        mid = (a + b) // 2
        rank = between(low, high)
        if mid == position:
            return rank
        a, b, low, high = (a, mid, low, rank) if position < mid else (mid + 1, b, rank, high)


def rebalanced_column(position: Column, count: Column) -> Column:
    """rank_at() of two columns: new ranks of lists of any length, each row by itself."""

    @F.pandas_udf("string")
    def run(at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rank_at(int(i), int(k)) for i, k in zip(at, n)], dtype=object)

    return run(position, count)


def is_valid_rank_column(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\A[0-9A-Za-z]*[1-9A-Za-z]\z"), F.lit(False))


def rank_between_column(low: Column, high: Column) -> Column:
    """between() of two columns."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([between(x, y) for x, y in zip(a.where(a.notna(), None), b.where(b.notna(), None))], dtype=object)

    return run(low, high)
