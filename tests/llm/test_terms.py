import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import terms
from pairloom.plans.work import Workspace

WORD = re.compile(r"[^\W_]+")


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def records(n=80):
    rng = random.Random(9)
    ws = ["the", "of", "cat", "dog", "12", "röd", "x", "why", "Dog", "rare1", "rare2", "é"]
    out = [(i, " ".join(rng.choices(ws, k=rng.randint(0, 7))), " ".join(rng.choices(ws, [9, 9, 2, 2, 1, 1, 1, 1, 1, 0.1, 0.1, 1], k=rng.randint(0, 7)))) for i in range(n)]
    return out + [(1000, None, None), (1001, "", "  "), (1002, None, "only_here a_b"), (3, *out[3][1:]), (1003, "long " * 4000 + "cat", None)]


def bags(rows):
    return {i: Counter(WORD.findall(((a or "") + " " + (b or "")).lower())) for i, a, b in rows}


@pytest.mark.parametrize("known", [50_000, 5, 1])
def test_most_distinctive_against_brute_force(spark, work, monkeypatch, known):
    monkeypatch.setattr(terms, "KNOWN", known)
    rows = records()
    b = bags(rows)
    d = Counter(w for c in b.values() for w in c)
    want = {}
    for i, c in b.items():
        s = [(-round(m * math.log(len(b) / d[w]), 6), w) for w, m in c.items() if d[w] >= 2]
        if s:
            want[i] = min(s)[1]
    df = spark.createDataFrame(rows, "id long, question1 string, question2 string").selectExpr("*", "1 as term", "2 as text")
    got = [tuple(r) for r in terms.most_distinctive(df, "id", ["question1", "question2"], work).collect()]
    assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("known", [50_000, 5, 1])
def test_log_likelihood_ratio(spark, work, monkeypatch, known):
    monkeypatch.setattr(terms, "KNOWN", known)
    rows = records(20)
    b = bags(rows)
    total, tm = sum(sum(c.values()) for c in b.values()), Counter()
    for c in b.values():
        tm += c
    df = spark.createDataFrame(rows, "id long, question1 string, question2 string")
    got = {(r.id, r.term): r.g2 for r in terms.distinctive(df, "id", ["question1", "question2"], work).collect()}
    assert len(got) == sum(len(c) for c in b.values())
    for (i, w), g in got.items():
        a, size = b[i][w], sum(b[i].values())
        t = [[a, size - a], [tm[w] - a, total - size - tm[w] + a]]
        n = sum(map(sum, t))
        e = lambda r, c: sum(t[r]) * (t[0][c] + t[1][c]) / n
        want = 2 * sum(t[r][c] * math.log(t[r][c] / e(r, c)) for r in (0, 1) for c in (0, 1) if t[r][c])
        sign = 1 if a * (total - size) >= (tm[w] - a) * size else -1
        assert g == pytest.approx(sign * want, abs=1e-5)


def test_ngrams_against_brute_force(spark, work):
    rows = records()
    occ, rec = Counter(), defaultdict(set)
    for i, a, _ in dict((r[0], r) for r in rows).values():
        w = WORD.findall((a or "").lower())
        for n in (1, 2, 3):
            for j in range(len(w) - n + 1):
                g = (n, " ".join(w[j : j + n]))
                occ[g] += 1
                rec[g].add(i)
    df = spark.createDataFrame([(i, i % 3 or None, a) for i, a, _ in rows], "id long, qid1 long, question1 string").selectExpr("*", "1 as kind", "2 as suffix")
    out = terms.value_frequencies(df, 3, work).collect()
    assert {(r.n, r.term): (r.occurrences, r.records) for r in out if r.kind == "word"} == {g: (occ[g], len(rec[g])) for g in occ}
    n = sum(a is not None for _, a, _ in {r[0]: r for r in rows}.values())
    for r in out:
        if r.kind == "word":
            assert r.mark == ("rare" if r.records == 1 else "common" if r.records >= 0.05 * n else None)
    values = Counter(i % 3 for i in {r[0] for r in rows} if i % 3)
    assert {int(r.term): r.records for r in out if r.kind == "qid1"} == values


def test_intervals_are_added_up_over_partitions(spark, work):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = spark.createDataFrame([("word", f"same {i % 50:02d} end", 1) for i in range(200)], "kind string, text string, records long").repartition(7)
        got = {r.term: (r.occurrences, r.records) for r in terms.ngram_counts(t, 2, work).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got["same"] == (200, 200) and got["same 07"] == (4, 4) and got["end"] == (200, 200)


@pytest.mark.parametrize("deepest", [64, 3])
def test_intervals_hold_all_ngrams(spark, work, deepest):
    rng = random.Random(5)
    docs = [(" ".join(rng.choices("abc", k=rng.randint(0, 9))), rng.randint(1, 3)) for _ in range(40)] + [("a " * 30 + "b", 2), ("", 1)]
    occ, rec = Counter(), Counter()
    for text, k in docs:
        w = text.split()
        grams = Counter(" ".join(w[i : i + n]) for n in range(1, min(deepest, len(w)) + 1) for i in range(len(w) - n + 1))
        for g, m in grams.items():
            occ[g] += m * k
            rec[g] += k
    t = spark.createDataFrame([("word", *d) for d in docs], "kind string, text string, records long")
    got_o, got_r, rows = Counter(), Counter(), terms.ngram_intervals(t, work, deepest).collect()
    for r in rows:
        for n in range(r.n_from, r.n_to + 1):
            g = " ".join(r.term.split(" ")[:n])
            got_o[g] += r.occurrences
            got_r[g] += r.records
    assert got_o == occ and got_r == rec
    assert len(rows) == len({(r.n_to, r.term) for r in rows}) < sum(len(d[0].split()) for d in docs) * 2 + 64 * 16


def long_texts():
    """(kind, text, records): texts of far more than 64 words, alone, alike in part, repetitive, equal, of another kind."""
    rng = random.Random(3)
    once, page = [f"w{i}" for i in range(150)], rng.choices("abcdefgh", k=140)
    docs = [once, [*once[:100], "x", *once[:90]], page, [*page[:70], "x", *page[70:]], [*page[3:], *page[:135]], ["a"] * 90 + ["b"], ["a"] * 80, ["röd", "b"] * 40, once[:64], once[:65], ["b"], []]
    return [("word", " ".join(w), 1 + i % 3) for i, w in enumerate([*docs, once])] + [("other", " ".join(once[:80]), 2)]


def all_ngrams(texts, above=0):
    occ, rec = Counter(), Counter()
    for kind, text, k in texts:
        w = text.split()
        for g, m in Counter((kind, " ".join(w[i : i + n])) for n in range(above + 1, len(w) + 1) for i in range(len(w) - n + 1)).items():
            occ[g] += m * k
            rec[g] += k
    return occ, rec


def told_ngrams(rows):
    occ, rec = Counter(), Counter()
    for r in rows:
        w = r.term.split(" ")
        assert len(w) == r.n_to
        for n in range(r.n_from, r.n_to + 1):
            occ[r.kind, " ".join(w[:n])] += r.occurrences
            rec[r.kind, " ".join(w[:n])] += r.records
    return occ, rec


@pytest.mark.parametrize("first_depth, held", [(64, 4_000_000), (64, 300), (2, 4_000_000)])
def test_ngrams_of_any_length(spark, work, monkeypatch, first_depth, held):
    monkeypatch.setattr(terms, "FIRST_DEPTH", first_depth, raising=False)
    monkeypatch.setattr(terms, "HELD", held, raising=False)
    t = spark.createDataFrame(long_texts(), "kind string, text string, records long").selectExpr("*", "1 as starts").repartition(3)
    rows = terms.ngram_intervals(t, work).collect()
    assert told_ngrams(rows) == all_ngrams(long_texts())
    assert len(rows) == len({(r.kind, r.n_to, r.term) for r in rows})
    assert sum(r.kind == "other" for r in rows) <= 2 * 80  # what stands alone is one row on either side of the first depth
    assert max(r.n_to for r in terms.ngram_intervals(t, work, deepest=70).collect()) == 70


def test_ngrams_of_a_long_question(spark, work):
    said = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, said), (2, f"And {said}!"), (2, f"And {said}!"), (3, None)], "id long, question1 string")
    occ, rec = told_ngrams(terms.text_intervals(df, work).withColumn("kind", F.lit("word")).collect())
    assert (occ, rec) == all_ngrams([("word", said, 1), ("word", f"and {said}", 1)])
    assert occ["word", said] == 2 and occ["word", f"and {said}"] == 1


def test_empty(spark, work):
    df = spark.createDataFrame([], "id long, qid1 long, question1 string, question2 string")
    assert terms.value_frequencies(df, 2, work).collect() == []
    assert terms.most_distinctive(df, "id", ["question1", "question2"], work).collect() == []
    assert terms.distinctive(df.withColumn("x", F.lit(1)), "id", ["question1"], work).collect() == []
