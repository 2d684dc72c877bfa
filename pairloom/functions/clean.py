"""Text cleaners: ordered rules as one chain of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import tokens


def chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply ``rules`` (pattern, replacement) one after the other; each sees what the one before left."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def drop_words(text: Column, stops: list[str]) -> Column:
    """The words of a text that aren't in ``stops``, single blanks between; case matters."""
    return F.array_join(F.filter(tokens(text), lambda w: ~w.isin(stops)), " ")


def clean_v1(text: Column, stops: list[str] | None = fixed.CLEAN_STOPS) -> Column:
    """First cleaner: ASCII letters and digits only, rules, no stop words. Null stays null."""
    c = F.regexp_replace(chain(text, fixed.CLEAN_V1), fixed.PUNCTUATION, "")
    return drop_words(c, stops) if stops else c


def clean_v2(text: Column, stops: list[str] | None = fixed.CLEAN_STOPS) -> Column:
    """Second cleaner: rules on the whole text, then punctuation and stop words go; stemming is a step of its own."""
    c = F.regexp_replace(chain(text, fixed.CLEAN_V2), fixed.PUNCTUATION, "")
    return drop_words(c, stops) if stops else c


def clean_sequence(text: Column) -> Column:
    """Cleaner of the sequence models: lower case, rules that set punctuation apart."""
    return chain(F.array_join(tokens(F.lower(text)), " "), fixed.CLEAN_SEQUENCE)


def document_words(text: Column) -> Column:
    """Tokens of the document-vector models: \\w+ runs but full stops, stop words tested before lower case, two letters at least."""
    c = F.regexp_replace(text, r"[^a-zA-Z0-9 \n\.]", " ")
    ws = F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(fixed.ENGLISH_STOPS) & (F.length(w) >= 2))
    return F.transform(ws, F.lower)
