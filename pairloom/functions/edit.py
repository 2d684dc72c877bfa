"""Edit, sequence and hash distances of two texts."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .grams import gram_codes, gram_of


def levenshtein(a: str, b: str) -> int:
    """Levenshtein distance of two words by code points, outside of Spark's expressions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def inverse_distance(a: Column, b: Column) -> Column:
    """1 / Levenshtein distance; 0 for equal texts."""
    d = F.levenshtein(a, b)
    return F.when(d == 0, 0.0).otherwise(1 / F.nullif(d, F.lit(0)))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def edit_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(n1 + n2 - d) / (n1 + n2) with a substitution counted as two edits; 1 for two empty texts, null for a null one."""
    for x, y in batches:
        yield pd.Series([None if a is None or b is None else 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in zip(x, y)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of the texts in lower case (the standard library's SequenceMatcher)."""
    for x, y in batches:
        yield pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(x, y)], dtype="float64")


#: Tokens whose bits are laid out at once.
_AT_ONCE = 250_000


def simhash(row: np.ndarray, at: np.ndarray, words: list[str | None], rows: int) -> np.ndarray:
    """64-bit SimHash of each of ``rows`` texts, a column for each bit: tokens whose MD5 (its low 64 bits) has it set against those without;
    a tie clears the bit. ``row`` and ``at`` are the text, in order, and the place in ``words`` of each token.

    Tokens are counted with repeats; a null token has no bit set. The hash of a text without tokens is 0.
    """
    hashes = b"".join(bytes(8) if w is None else hashlib.md5(w.encode()).digest()[8:] for w in words)
    signs = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1
    votes = np.zeros((rows, 64), np.int64)
    for i in range(0, len(at), _AT_ONCE):
        own = row[i : i + _AT_ONCE]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[first]] += np.add.reduceat(signs[at[i : i + _AT_ONCE]], first, axis=0, dtype=np.int64)
    return votes > 0


def _of_tokens(tokens: pa.Array) -> np.ndarray:
    words = pc.list_flatten(tokens).dictionary_encode("encode")
    row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    return simhash(row, words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist(), len(tokens))


def _of_grams(texts: pa.Array, n: int) -> np.ndarray:
    row, code = gram_codes(texts, n)
    codes, at = np.unique(code, return_inverse=True)
    return simhash(row, at, [gram_of(c, n) for c in codes.tolist()], len(texts))


def _distance(a: pa.Array, b: pa.Array, hashes) -> pa.Array:
    differ = np.count_nonzero(hashes(a) != hashes(b), axis=1).astype(np.int32)
    return pa.array(differ, mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))


@F.arrow_udf(IntegerType())
def simhash_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits in which the SimHashes of two token arrays differ; null if an array is null."""
    return _distance(a, b, _of_tokens)


def gram_simhash_distance(q1: Column, q2: Column, n: int) -> Column:
    """Bits in which the SimHashes of two texts' grams of ``n`` characters, 1 to 3, differ; null if a text is null."""

    @F.arrow_udf(IntegerType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _distance(a, b, lambda t: _of_grams(t, n))

    return run(q1, q2)
