"""Words of a text, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters and decimal digits.
WORD = r"[\p{L}\p{Nd}]+"


def words(text: Column | str) -> Column:
    """The words of a text in lower case, in order, with repeats; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens between runs of white space; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: A run of word characters that are no decimal digits; the underscore is one of them.
ALPHABETIC = r"[\p{L}\p{Nl}\p{No}_]+"
#: Two or more blanks, of any kind.
BLANKS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2,}"


def plain_words(text: Column) -> Column:
    """Alphabetic tokens of 2 to 15 characters, in lower case; none that begin with an underscore."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(ALPHABETIC), F.lit(0))
    return F.filter(ws, lambda w: F.length(w).between(2, 15) & ~F.startswith(w, F.lit("_")))


def one_blank(text: Column) -> Column:
    """The text with each run of two or more blanks as one."""
    return F.regexp_replace(text, BLANKS, " ")


def vectorizer_words(text: Column, stops: list[str] | None = None) -> Column:
    """Tokens of two or more word characters, in lower case, without ``stops``."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]{2,}"), F.lit(0))
    return F.filter(ws, lambda w: ~w.isin(stops)) if stops else ws


def alphabetic(text: Column) -> Column:
    """Runs of word characters other than digits, case kept."""
    return F.regexp_extract_all(text, F.lit(ALPHABETIC), F.lit(0))


#: Contractions and punctuation that a treebank tokenizer sets apart.
TREEBANK = r"""'(?i:s|re|ve|ll|d|m)\b|(?i:n't)\b|\.\.\.|--|[\p{L}\p{Nd}]+?(?=(?i:n't)\b)|[\p{L}\p{Nd}]+(?:[-.,:/&][\p{L}\p{Nd}]+)*|[^\s\p{L}\p{Nd}]"""


def treebank_words(text: Column) -> Column:
    """Words, contractions (n't, 's) and punctuation marks as tokens of their own, in the manner of treebank tokenizers.

    Numbers and words joined by a hyphen, full stop, comma, colon or slash stay whole.
    """
    return F.regexp_extract_all(text, F.lit(TREEBANK), F.lit(0))


def word_ngrams(a: Column, n: int) -> Column:
    """n-grams of a token array, a blank between their tokens; none if there are fewer than n tokens."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(s: Column, n: int) -> Column:
    """n-grams of the characters (code points) of a text; none if it is shorter than n."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def chars(s: Column) -> Column:
    """Characters of a text."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def let(fn, *columns: Column) -> Column:
    """``fn`` of ``columns``, each of them computed once per row even where ``fn`` uses them within lambdas."""
    bound = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(bound), lambda s: fn(*[s[f"_{i}"] for i in range(len(columns))])), F.lit(0))
