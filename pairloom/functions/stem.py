"""Stemmers. They run over distinct words; :func:`stem_words` joins the stems back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

_VOWELS = "aeiou"


def _shape(stem: str) -> str:
    """The stem as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Endings of steps 2 to 4 of Porter's published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def porter(w: str) -> str:
    """Porter's algorithm of 1980 on a word in lower case."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP2, STEP3):
        e = _longest(w, step)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + step[e]
    e = _longest(w, STEP4)
    if e:
        stem = w[: -len(e)]
        if _measure(stem) > 1 and (e != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Endings of steps 2 to 4 of the published English Snowball algorithm, and its exceptions.
SNOWBALL2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
SNOWBALL3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
SNOWBALL4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
SNOWBALL_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
SNOWBALL_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _after(w: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in "aeiouy" and w[i - 1] in "aeiouy":
            return i + 1
    return len(w)


def _short(w: str) -> bool:
    """The word ends in a short syllable."""
    v = "aeiouy"
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v


def snowball(word: str) -> str:
    """The English Snowball algorithm (Porter 2) on a word in lower case."""
    if len(word) <= 2:
        return word
    if word in SNOWBALL_WORDS:
        return SNOWBALL_WORDS[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy") else c for i, c in enumerate(w))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in "aeiouy" for c in w[:-2]):
        w = w[:-1]
    if w in SNOWBALL_KEPT:
        return w
    e = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if e in ("eedly", "eed"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in "aeiouy" for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    e = _longest(w, SNOWBALL2)
    if e and len(w) - len(e) >= r1:
        stem = w[: -len(e)]
        if (e != "ogi" or stem.endswith("l")) and (e != "li" or stem[-1:] in set("cdeghkmnrt")):
            w = stem + SNOWBALL2[e]
    e = _longest(w, SNOWBALL3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + SNOWBALL3[e]
    e = _longest(w, SNOWBALL4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_RULE = re.compile(r"^([a-z]+)(\*?)(\d)([a-z]*)([>.])$")
_RULES: dict[str, list[tuple]] = {}
for _r in fixed.LANCASTER:
    _end, _intact, _cut, _add, _on = _RULE.match(_r).groups()
    _RULES.setdefault(_end[0], []).append((_end[::-1], bool(_intact), int(_cut), _add, _on == ">"))


def lancaster(word: str) -> str:
    """The Lancaster (Paice/Husk) algorithm on a word in lower case."""
    w, intact = word, True
    while w:
        for end, only_intact, cut, add, more in _RULES.get(w[-1], ()):
            if not w.endswith(end) or (only_intact and not intact):
                continue
            stem = w[: len(w) - cut]
            kept = stem + add
            if w[0] in "aeiouy":
                ok = len(stem) + len(add) >= 2 if cut or add else True
            else:
                ok = len(kept) >= 3 and any(c in "aeiouy" for c in kept) if cut or add else True
            if not ok:
                continue
            w, intact = kept, False
            if not more:
                return w
            break
        else:
            return w
    return w


def _udf(f):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for words in batches:
            for w in words.dropna().unique():
                if w not in known:
                    known[w] = f(w)
            yield words.map(known, na_action="ignore")

    return run


porter_udf, lancaster_udf, snowball_udf = _udf(porter), _udf(lancaster), _udf(snowball)


def porter_tail(text: Column) -> Column:
    """Porter's algorithm on a whole text in lower case, taken for one word: only its end changes."""
    return porter_udf(F.lower(text))


def stem_words(rows: DataFrame, key: str, array: Column, stemmer=lancaster_udf) -> DataFrame:
    """(key, stems): stems of a row's tokens in order. Each distinct word is stemmed once; stems are joined back."""
    long = rows.select(key, F.posexplode(array).alias("pos", "word"))
    stems = long.select("word").distinct().withColumn("stem", stemmer(F.lower("word")))
    back = long.join(stems, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("x"))  # the tokens of one text
    return rows.select(key).join(back, key, "left").select(key, F.coalesce(F.transform("x", lambda s: s["stem"]), F.array().cast("array<string>")).alias("stems"))
