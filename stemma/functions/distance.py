"""Edit distances by bit-parallel columns on Python's own large integers: no limit to lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; one pass over the longer text, all rows of a column at once."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    full, top, d = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        hit = rows.get(c, 0)
        zero = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        d += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 | (full & ~(zero | plus))) & full, plus & zero
    return d


def best_match(query: str, text: str, barriers: str = "▯\n") -> int:
    """The fewest edits that turn the query into some substring of the text that holds no barrier; at most its length."""
    m = len(query)
    if not m:
        return 0
    rows: dict[str, int] = {}
    for i, c in enumerate(query):
        rows[c] = rows.get(c, 0) | 1 << i
    full, top, best = (1 << m) - 1, 1 << (m - 1), m
    up, down, d = full, 0, m
    for c in text:
        if c in barriers:
            up, down, d = full, 0, m
            continue
        hit = rows.get(c, 0)
        zero = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        d += bool(plus & top) - bool(minus & top)
        if d < best:
            best = d
            if not best:
                return 0
        plus = plus << 1 & full  # a match may begin anywhere: the first row stays 0
        up, down = (minus << 1 | (full & ~(zero | plus))) & full, plus & zero
    return best


@F.pandas_udf(IntegerType())
def edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(IntegerType())
def best_match_udf(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or t is None else best_match(q, t) for q, t in zip(query, text)], dtype="Int32")
