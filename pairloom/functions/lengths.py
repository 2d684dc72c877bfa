"""Length features of two raw texts, by characters; ``unit`` gives them by tokens of another kind instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chars


def _ratio(x: Column, y: Column) -> Column:
    """Null if y is 0; y / x if x isn't 0, else 0."""
    return F.when(y == 0, F.lit(None).cast("double")).when(x == 0, 0.0).otherwise(y / F.nullif(x, F.lit(0)))


def features(q1: Column, q2: Column, stops: list[str], unit=chars) -> dict[str, Column]:
    """The twelve length features; a null text is taken for empty by the caller."""
    a, b = unit(q1), unit(q2)
    less = lambda x: F.filter(x, lambda w: ~w.isin(stops))
    n1, n2 = F.size(a), F.size(b)
    u1, u2 = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    s1, s2 = F.size(less(F.array_distinct(a))), F.size(less(F.array_distinct(b)))
    either = F.array_union(a, b)
    empty = (n1 == 0) | (n2 == 0)
    first = F.when(empty, F.lit(None).cast("int")).otherwise((F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("int"))
    return {
        "total_unique": F.size(either),
        "total_unique_stop": F.size(less(either)),
        "wc_diff": F.abs(n1 - n2),
        "wc_ratio": _ratio(n1, n2),
        "wc_diff_unique": F.abs(u1 - u2),
        "wc_ratio_unique": _ratio(u1, u2),
        "wc_diff_unique_stop": F.abs(s1 - s2),
        "wc_ratio_unique_stop": _ratio(s1, s2),
        "same_start": first,
        "char_diff": F.abs(F.length(q1) - F.length(q2)),
        "char_ratio": _ratio(F.length(q1), F.length(q2)),
        "char_diff_unique_stop": F.abs(s1 - s2),
    }
