"""Overlap of the character grams of two texts.

A text has about as many grams as characters, so comparing each with each within lambdas costs their product, and exploding
them sends every gram through a shuffle. Counting them in Arrow batches is linear and leaves the rows where they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

FIELDS = ["same", "n1", "n2", "common", "either", "lesser", "greater"]


def gram_codes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each gram of ``n`` characters, 1 to 3, in order; a code is the gram's code points, 21 bits each. Null texts have none."""
    if not 1 <= n <= 3:
        raise ValueError("a code holds 1 to 3 characters")
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    points = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
    code = np.zeros(len(at), np.int64)
    for i in range(n):
        code = code << 21 | points[at + i]
    return row[at], code


def gram_of(code: int, n: int) -> str:
    """The gram of a code of :func:`gram_codes`."""
    return "".join(chr(code >> 21 * i & 0x1FFFFF) for i in reversed(range(n)))


def gram_counts(q1: Column, q2: Column, n: int) -> Column:
    """For the grams of ``n`` characters: pairs of equal grams, grams of each side, distinct common and distinct grams of both,
    sums of the lesser and of the greater counts. Null texts have none."""

    def one(a: str | None, b: str | None) -> tuple:
        x, y = (Counter([s[i : i + n] for i in range(len(s) - n + 1)]) if s else Counter() for s in (a, b))
        both = [(x[g], y[g]) for g in x.keys() & y.keys()]
        n1, n2, lesser = sum(x.values()), sum(y.values()), sum(min(c) for c in both)
        return sum(c * d for c, d in both), n1, n2, len(both), len(x) + len(y) - len(both), lesser, n1 + n2 - lesser

    @F.pandas_udf(StructType([StructField(f, LongType()) for f in FIELDS]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            yield pd.DataFrame([one(a, b) for a, b in zip(x, y)], columns=FIELDS)

    return run(q1, q2)


def mismatch(vocabulary: list[str], q1: Column, q2: Column) -> Column:
    """-1 for each gram of ``vocabulary`` that one text has and the other lacks, else 0. Null texts have none."""
    at = {g: i for i, g in enumerate(vocabulary)}
    sizes = sorted({len(g) for g in vocabulary})

    def known(s: str | None) -> set[int]:
        return {at[g] for n in sizes for i in range(len(s) - n + 1) if (g := s[i : i + n]) in at} if s else set()

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out = np.zeros((len(x), len(at)), dtype=np.int32)
            for row, a, b in zip(out, x, y):
                row[list(known(a) ^ known(b))] = -1
            yield pd.Series(list(out))

    return run(q1, q2)
