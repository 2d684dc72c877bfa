import datetime as dt
import re
from collections import defaultdict

import pytest

from pairloom.llm import ledger
from pairloom.plans.work import Workspace

WORD = re.compile(r"[^\W_]+")
A, B = "What is the Best of all?", "how do I cook  the rice"
ROWS = [
    (5, A, B, 1),
    (3, B.upper(), "what is the best... OF all", 2),
    (9, A.replace(" ", " "), B, 3),
    (9, A.replace(" ", " "), B, 9),
    (4, "best of all what is the", B, 4),
    (6, "too short", B, 5),
    (7, None, B, 6),
    (8, "", "", 7),
    (None, A, B, 8),
    (10, "x " * 5000, "y " * 5000, None),
    (11, "Y " * 5000, "X, " * 5000, 5),
    (12, B, B, 5),
    (13, B, B, 6),
]


def frame(spark, rows):
    at = lambda i: i and dt.datetime(2020, 1, i)
    return spark.createDataFrame([(i, a, b, at(t)) for i, a, b, t in rows], "id long, question1 string, question2 string, loaded_at timestamp").selectExpr("*", "1 as h1", "2 as copies")


def brute(rows):
    groups = defaultdict(set)
    for i, a, b, _ in rows:
        x, y = WORD.findall((a or "").lower()), WORD.findall((b or "").lower())
        if i is not None and min(len(x), len(y)) >= 5:
            groups[tuple(sorted([tuple(x), tuple(y)]))].add(i)
    return groups.values()


@pytest.mark.parametrize("batches, few", [(1, 200_000), (3, 200_000), (3, 0), (7, 2)])
def test_ledger_is_the_same_for_any_batches(spark, monkeypatch, batches, few):
    monkeypatch.setattr(ledger, "FEW", few)
    led = ledger.ledger_of(frame(spark, ROWS), Workspace(spark, "test"), batches)
    assert sorted((r.keep_id, r.copies) for r in led.counts().collect()) == sorted((min(g), len(g)) for g in brute(ROWS))
    assert sorted(map(tuple, led.copies().collect())) == sorted((min(g), i) for g in brute(ROWS) for i in g if i != min(g))


def test_empty(spark):
    led = ledger.ledger_of(frame(spark, []), Workspace(spark, "test"))
    assert led.counts().collect() == [] and led.copies().collect() == []


def test_buckets_follow_the_size(spark):
    sizes = [(w.buckets, w.parts) for w in (ledger.Ledger(Workspace(spark, "t"), n) for n in (0, 10**7, 10**12))]
    assert sizes == [(8, 1), (16, 2), (4096, 64)]
