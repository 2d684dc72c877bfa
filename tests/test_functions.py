import difflib
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import clean, edit, fixed, grams, lengths, sets, stem
from pairloom.functions import text as tx
from pairloom.functions import vectors as V

PAIRS = [
    ("how do i cook rice", "how do i cook rice"),
    ("a a b", "a b b"),
    ("cat", "dog"),
    ("", "x"),
    ("what is the", "is it"),
    ("a  b", "a b"),
    ("café", "cafe"),
    ("", ""),
]


@pytest.fixture(scope="module")
def df(spark):
    d = spark.createDataFrame(PAIRS, "q1 string, q2 string")
    return d.select("q1", "q2", tx.tokens(F.col("q1")).alias("a"), tx.tokens(F.col("q2")).alias("b"))


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_bag_metrics_by_hand(df):
    out = rows(df, sets.bag_jaccard(F.col("a"), F.col("b")), sets.bag_dice(F.col("a"), F.col("b")), sets.bag_ochiai(F.col("a"), F.col("b")))
    for (q1, q2), (j, d, o) in zip(PAIRS, out):
        a, b = q1.split(), q2.split()
        same = sum(x == y for x in a for y in b)
        tot = len(a) + len(b) + 1
        assert j == pytest.approx(same / ((tot - same) + 1e-6))
        assert d == pytest.approx(2 * same / (tot + 1e-6))
        assert o == pytest.approx(same / (math.sqrt(len(a) * len(b) + 1) + 1e-6))


def test_sets_and_shares(df):
    out = rows(df, sets.word_match_share(F.col("a"), F.col("b")), sets.set_jaccard(F.col("a"), F.col("b")), sets.min_over_sum(F.col("a"), F.col("b")), sets.ruzicka(F.col("a"), F.col("b")), sets.only_in(F.col("a"), F.col("b")))
    assert out[0] == (1.0, 1.0, 0.5, 1.0, [])
    assert out[1] == (1.0, 1.0, pytest.approx(2 / 6), 0.5, [])
    assert out[2] == (0.0, 0.0, 0.0, 0.0, ["cat"])
    assert out[3] == (0.0, 0.0, 0.0, 0.0, [])
    assert out[7][:4] == (0.0, None, None, None)


def test_ngrams(spark):
    d = spark.createDataFrame([("a b c",), ("a",), ("",)], "q string").withColumn("t", tx.tokens(F.col("q")))
    assert rows(d, tx.word_ngrams(F.col("t"), 2), tx.char_ngrams(F.col("q"), 3)) == [(["a b", "b c"], ["a b", " b ", "b c"]), ([], []), ([], [])]


def test_cleaners(spark):
    d = spark.createDataFrame([("can't I'm 60k, the US??",), (None,), ("What is the best ios in india?",)], "q string")
    out = rows(d, clean.clean_v1(F.col("q")), clean.clean_v2(F.col("q")), clean.clean_sequence(F.col("q")))
    assert out[1] == (None, None, None)
    assert out[0] == ("can t I am 60000 America", "cannot I am 60000 America", "cannot i am 60000 the us ")
    assert out[2][0] == "best operating system in India"


def test_lengths(df):
    f = lengths.features(F.col("q1"), F.col("q2"), fixed.ENGLISH_STOPS)
    out = rows(df, *f.values())
    names = list(f)
    second = dict(zip(names, out[2]))
    assert second["wc_diff"] == 0 and second["wc_ratio"] == 1.0 and second["same_start"] == 0 and second["total_unique"] == 6
    third = dict(zip(names, out[3]))
    assert third["wc_ratio"] == 0.0 and third["same_start"] is None
    assert dict(zip(names, out[7]))["wc_ratio"] is None


def test_character_grams(spark):
    d = spark.createDataFrame([("aab", "aba"), (None, "x"), ("", ""), ("añ", "ña")], "q1 string, q2 string")
    out = [tuple(r.g) for r in d.select(grams.gram_counts(F.col("q1"), F.col("q2"), 2).alias("g")).collect()]
    assert out == [(1, 2, 2, 1, 3, 1, 3), (0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), (0, 1, 1, 0, 2, 0, 2)]
    assert [list(r[0]) for r in d.select(grams.mismatch(["a", "b", "ba", "x"], F.col("q1"), F.col("q2"))).collect()] == [[0, 0, -1, 0], [0, 0, 0, -1], [0] * 4, [0] * 4]


def test_edit(df):
    out = rows(df, edit.edit_ratio("q1", "q2"), edit.sequence_ratio("q1", "q2"), edit.simhash_distance(F.col("a"), F.col("b")), edit.inverse_distance(F.col("q1"), F.col("q2")))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    for (a, b), (er, sr, sh, inv) in zip(PAIRS, out):
        assert er == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
        assert sr == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
        assert 0 <= sh <= 64
        if a == b:
            assert sh == 0 and inv == 0.0


def test_stemmers():
    for w, s in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "electricity": "electr", "adjustment": "adjust", "controlling": "control", "sky": "sky", "a": "a"}.items():
        assert stem.porter(w) == s, w
    for w, s in {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "ear": "ear", "saying": "say", "crying": "cry", "string": "string", "meant": "meant", "cement": "cem"}.items():
        assert stem.lancaster(w) == s, w


def test_snowball():
    for w, s in {"consistently": "consist", "generously": "generous", "knightly": "knight", "skies": "sky", "proceed": "proceed", "cried": "cri", "ties": "tie", "gaps": "gap", "hoping": "hope", "hopping": "hop", "luxuriating": "luxuri", "kneeled": "kneel", "relational": "relat", "by": "by", "say": "say", "nationality": "nation", "knocks": "knock"}.items():
        assert stem.snowball(w) == s, w


def test_tokenizers(spark):
    d = spark.createDataFrame([("I don't know; it's 3.5 state-of-the-art... Über x2?",)], "q string")
    out = d.select(tx.treebank_words(F.col("q")), tx.alphabetic(F.col("q"))).first()
    assert out[0] == ["I", "do", "n't", "know", ";", "it", "'s", "3.5", "state-of-the-art", "...", "Über", "x2", "?"]
    assert out[1][:4] == ["I", "don", "t", "know"] and out[1][-1] == "x"


def test_stem_words_keep_order(spark):
    d = spark.createDataFrame([(1, ["running", "maximum", "running"]), (2, [])], "id long, t array<string>")
    assert {r.id: r.stems for r in stem.stem_words(d, "id", F.col("t")).collect()} == {1: ["run", "maxim", "run"], 2: []}


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 3.0], [2.0, 1.0, 4.0, 0.0]), ([0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    a, b = rows(d, V.cosine(x, y), V.manhattan(x, y), V.sum_difference(x, y), V.euclidean(x, y), V.minkowski3(x, y), V.canberra(x, y), V.pearson(x, y), V.spearman(x, y), V.kendall("x", "y"), V.skewness(x), V.kurtosis(x))
    assert a[:5] == (pytest.approx(16 / math.sqrt(23 * 21)), 6.0, 2.0, pytest.approx(math.sqrt(12)), pytest.approx(30 ** (1 / 3)))
    assert a[5] == pytest.approx(1 / 3 + 1 / 3 + 1 / 7 + 1)
    assert a[7] == pytest.approx(-0.105409, abs=1e-6) and a[8] == pytest.approx(-0.182574, abs=1e-6)
    assert b[0] is None and b[6] is None and b[7] is None and b[8] is None and b[9] is None


def test_simhash_of_grams_and_of_long_texts(spark, monkeypatch):
    def bits(words):
        votes = [0] * 64
        for w in words:
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[8:])
            votes = [v + (1 if h >> (63 - i) & 1 else -1) for i, v in enumerate(votes)]
        return [v > 0 for v in votes]

    monkeypatch.setattr(edit, "_AT_ONCE", 3)  # a text is laid out in several parts
    words = [["a", "b", "a", "c", "d", "e"], [], ["x"], ["añ", "😀"]]
    known = sorted({c for w in words for c in w})
    row = [i for i, w in enumerate(words) for _ in w]
    at = [known.index(c) for w in words for c in w]
    assert edit.simhash(np.array(row), np.array(at), known, 4).tolist() == [bits(w) for w in words]
    texts = [("abcabcabc", "abd"), ("", "a"), ("a", "b"), ("añ😀b", "ñ😀b"), (None, "ab")]
    d = spark.createDataFrame(texts, "q1 string, q2 string")
    split = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    for n in (1, 2, 3):
        got = [r[0] for r in d.select(edit.gram_simhash_distance(F.col("q1"), F.col("q2"), n)).collect()]
        assert got == [None if a is None else sum(x != y for x, y in zip(bits(split(a, n)), bits(split(b, n)))) for a, b in texts]


def test_similarities_are_those_of_the_expressions(spark):
    rng = np.random.default_rng(7)
    data = [(rng.normal(size=n).round(1).tolist(), rng.normal(size=n).round(1).tolist()) for n in (5, 5, 32, 32, 2)] + [([0.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, [1.0]), ([1.0, 2.0], [1.0])]
    x, y = F.col("x"), F.col("y")
    each = {f: getattr(V, f)(x, y) for f in V.SIMILARITIES if f != "spearman"} | {"spearman": tx.let(V.spearman, x, y)}
    df = spark.createDataFrame(data, "x array<double>, y array<double>").select(V.similarities("x", "y").alias("got"), *[c.alias(f) for f, c in each.items()])
    for row in df.collect():
        for f in V.SIMILARITIES:
            want = row[f]
            assert row.got[f] == (None if want is None or want != want else pytest.approx(want, abs=1e-9)), f
