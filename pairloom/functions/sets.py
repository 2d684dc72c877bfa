"""Overlap of two token arrays. Arrays are bags: repeats count unless a function says otherwise.

All take Columns of arrays and give a Column; null arrays give null. ``a`` and ``b`` should be plain columns or come through
:func:`pairloom.functions.text.let`, so that they aren't computed again within lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators.
EPS = 1e-6


def equal_pairs(a: Column, b: Column) -> Column:
    """Pairs of equal tokens, one of each array: the sum over words of the products of their counts."""
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.size(F.filter(b, lambda y: y == x)))


def _sizes(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) + 1


def bag_jaccard(a: Column, b: Column) -> Column:
    """same / (n1 + n2 + 1 - same + eps); more than 1 or below 0 is possible with repeats."""
    same = equal_pairs(a, b)
    return same / ((_sizes(a, b) - same) + EPS)


def bag_dice(a: Column, b: Column) -> Column:
    """2 same / (n1 + n2 + 1 + eps)."""
    return 2 * equal_pairs(a, b) / (_sizes(a, b) + EPS)


def bag_ochiai(a: Column, b: Column) -> Column:
    """same / (sqrt(n1 n2 + 1) + eps)."""
    return equal_pairs(a, b) / (F.sqrt(F.size(a) * F.size(b) + 1) + EPS)


def only_in(a: Column, b: Column) -> Column:
    """Tokens of ``a`` that ``b`` lacks, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def match_count(a: Column, b: Column) -> Column:
    """Tokens of ``a`` that stand in ``b``, repeats counted."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def word_match_share(a: Column, b: Column) -> Column:
    """Shared tokens of both sides over all tokens; 0 if a side is empty. Give sets for the set form, bags for the bag form."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.try_divide(match_count(a, b) + match_count(b, a), F.size(a) + F.size(b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Distinct common tokens over all distinct tokens; null if there are none."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def _sum_of(f, a: Column, b: Column) -> Column:
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    return F.aggregate(F.array_union(a, b), F.lit(0), lambda acc, w: acc + f(count(a, w), count(b, w)))


def min_over_sum(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of all counts; null if there are none."""
    return F.try_divide(_sum_of(F.least, a, b), F.size(a) + F.size(b))


def ruzicka(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater counts; null if there are none."""
    return F.try_divide(_sum_of(F.least, a, b), _sum_of(F.greatest, a, b))
