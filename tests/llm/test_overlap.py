import random
import re
from collections import Counter
from functools import lru_cache

import pytest

from pairloom.llm import overlap
from pairloom.plans.work import Workspace

WORD = re.compile(r"[^\W_]+")


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def near(a, b):
    x, y = WORD.findall((a or "").lower()), WORD.findall((b or "").lower())
    if len(x) < 5 or len(y) < 5:
        return False
    cx, cy = Counter(x), Counter(y)
    digits = lambda w: sorted(t for t in w if t.isdecimal())
    return sum((cx - cy).values()) <= 2 and sum((cy - cx).values()) <= 2 and digits(x) == digits(y)


def texts(n, seed, vocabulary=9):
    rng = random.Random(seed)
    ws = ["the", "of", "cat", "dog", "12", "7", "röd", "x", "why"][:vocabulary]
    out = [" ".join(rng.choice(ws) for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return out + [None, "", "  ", "!!!", "a_b_c_d_e", "ha ha ha ha ha", "ha ha ha ha ho hi", "A, b; c: D e", "e d c b a", "word " * 3000, "word " * 2999 + "end"]


@pytest.mark.parametrize("cell, known, held", [(50_000, 50_000, 1_000_000), (3, 50_000, 5), (2, 4, 1)])
def test_found_against_brute_force(spark, work, monkeypatch, cell, known, held):
    for name, value in (("CELL", cell), ("KNOWN", known), ("HELD", held)):
        monkeypatch.setattr(overlap, name, value)
    train = list(enumerate(texts(120, 1), 1)) + [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")]
    test = [(i, a, b) for i, (a, b) in enumerate(zip(texts(60, 2), texts(60, 3)), 1)] + [(None, "a b c d e", None), (1, texts(60, 2)[0], texts(60, 3)[0])]
    t = spark.createDataFrame(train, "qid1 long, question1 string").selectExpr("*", "1 as bag", "2 as head")
    q = spark.createDataFrame(test, "test_id long, question1 string, question2 string").selectExpr("*", "1 as bag", "2 as qid1")
    want = {(x, i, f) for x, s in train for i, a, b in test for f, r in (("question1", a), ("question2", b)) if x is not None and i is not None and near(s, r)}
    rows = [tuple(r) for r in overlap.found(t, q, work).collect()]
    assert set(rows) == want and len(rows) == len(want) > 50


def test_empty_tables(spark, work):
    t = spark.createDataFrame([], "qid1 long, question1 string")
    q = spark.createDataFrame([(1, "a b c d e", None)], "test_id long, question1 string, question2 string")
    assert overlap.found(t, q, work).collect() == []


@lru_cache
def grams(others, n):
    return {tuple(w[i : i + n]) for w in (o.split(" ") for o in others) for i in range(len(w) - n + 1)}


def brute_cover(text, others, n):
    w = text.split(" ")
    hit = set()
    known = grams(tuple(others), n)
    for i in range(len(w) - n + 1):
        if tuple(w[i : i + n]) in known:
            hit |= set(range(i, i + n))
    return len(hit)


@pytest.mark.parametrize("cell, known", [(50_000, 50_000), (3, 50_000), (3, 2)])
def test_spans_and_coverage_against_brute_force(spark, monkeypatch, cell, known):
    monkeypatch.setattr(overlap, "CELL", cell)
    monkeypatch.setattr(overlap, "KNOWN", known)
    rng = random.Random(4)
    make = lambda k: sorted({" ".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for _ in range(k)})
    train, test = make(40), make(40)
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "key long, text string")
    for mine, others in ((train, test), (test, train)):
        got = {r.key: r.covered for r in overlap.covered_words(frame(mine), frame(others), 4).collect()}
        assert {t: got.get(i, 0) for i, t in enumerate(mine)} == {t: brute_cover(t, others, 4) for t in mine}


def test_report(spark, work):
    train = spark.createDataFrame([("one two three four five six seven",), (None,)], "question1 string")
    rows = [(1, "One two three four five six seven", "nothing of that stands in the other one", "test", " Web "), (2, None, "", "valid", None), (1, "One two three four five six seven", "nothing of that stands in the other one", "test", " Web ")]
    test = spark.createDataFrame(rows, "test_id long, question1 string, question2 string, split string, source string")
    got = {(r.split, r.source): tuple(r)[2:] for r in overlap.report(train, test, work).collect()}
    assert got == {("test", "web"): (1, 2, 1, 1, 1), ("valid", None): (1, 0, 0, 0, 0)}
    lost = spark.createDataFrame([(None, "one two three four five", None, "test", "a"), (None, "one two three four five", None, "test", "a")], test.schema)
    assert [tuple(r)[2:] for r in overlap.report(train, lost, work).collect()] == [(2, 2, 2, 2, 2)]


def test_report_counts_near_same_questions(spark, work):
    base = "one two three four five six seven"
    changed = ["one two three other five six seven", "seven six five four three two one", "one two three four new five six seven", "one two three a b c seven"]
    mine, train = changed + texts(60, 5), [base, *texts(120, 1)]
    said = lambda s: " ".join(WORD.findall((s or "").lower()))
    others = [said(s) for s in train]
    want = {}
    for i, s in enumerate(mine):
        n = len(said(s).split())
        want[i] = (int(any(near(s, o) for o in others)), int(n >= 5 and brute_cover(said(s), others, 5) >= 0.8 * n))
    assert [want[i][0] for i in range(4)] == [1, 1, 1, 0]
    t = spark.createDataFrame(list(enumerate(train)), "qid1 long, question1 string")
    q = spark.createDataFrame([(i, s, None, str(i), None) for i, s in enumerate(mine)], "test_id long, question1 string, question2 string, split string, source string")
    got = {int(r.split): (r.overlapping, r.mostly_covered) for r in overlap.report(t, q, work).collect()}
    assert got == want
    assert all(got[r.test_id][0] == 1 for r in overlap.found(t, q, work).collect())


def test_found_takes_texts_of_more_words_than_a_short_counts(spark, work):
    long = "word " * 39_999
    t = spark.createDataFrame([(1, long + "end"), (2, "word " * 30_000)], "qid1 long, question1 string")
    q = spark.createDataFrame([(1, long + "other", None), (2, long + "a b c", None)], "test_id long, question1 string, question2 string")
    assert [tuple(r) for r in overlap.found(t, q, work).collect()] == [(1, 1, "question1")]
