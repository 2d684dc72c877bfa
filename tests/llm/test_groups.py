from collections import Counter, defaultdict
from functools import partial

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairloom.llm import groups
from pairloom.operators import skew
from pairloom.plans.work import Workspace


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def union(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        elif a is not None or b is not None:
            root(a if a is not None else b)
    return {x: root(x) for x in up}


CASES = {
    "chain": [(i, i + 1) for i in range(1, 60)],
    "star": [(1000, i) for i in range(50)],
    "two": [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5)],
    "nulls": [(None, 1), (1, None), (None, None), (1, 2), (2, 1), (1, 2)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("share", [0.005, 2.0])
def test_components(spark, work, monkeypatch, name, share):
    monkeypatch.setattr(groups, "hot_keys", partial(skew.hot_keys, share=share))
    monkeypatch.setattr(skew, "EASY", 0)
    df = spark.createDataFrame(CASES[name], "a long, b long")
    want = {x: r for x, r in union([p for p in CASES[name] if None not in p and p[0] != p[1]]).items()}
    assert dict(map(tuple, groups.hash_to_min(df, "a", "b", work).collect())) == want
    roots, forest = groups.boruvka(df, "a", "b", work)
    got = defaultdict(set)
    for r in roots.collect():
        got[r.root].add(r.v)
    by = defaultdict(set)
    for x, r in want.items():
        by[r].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))
    tree = [tuple(r) for r in forest.collect()]
    assert len(tree) == len(want) - len(by)  # no circle
    assert union(tree) == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_of_any_graph(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    want = union([p for p in pairs if p[0] != p[1]])
    assert dict(map(tuple, groups.hash_to_min(df, "a", "b", Workspace(spark, "t")).collect())) == want
    roots = groups.boruvka(df, "a", "b", Workspace(spark, "t"))[0].collect()
    assert len({(want[r.v], r.root) for r in roots}) == len(set(want.values())) and len(roots) == len(want)


TRAIN = [(1, 10, 11, 1), (2, 11, 12, 0), (3, 12, None, None), (4, 20, 20, 1), (5, 20, None, 1), (6, None, None, 1), (7, 30, 31, 1), (7, 30, 31, 1), (8, 40, None, 0), (9, 30, 10, 0)]


def test_found_groups_and_ties(spark, work):
    df = spark.createDataFrame(TRAIN, "id long, qid1 long, qid2 long, is_duplicate int").selectExpr("*", "1 as grp", "2 as root", "3 as load", "4 as q")
    got = sorted(map(tuple, groups.found_groups(df, work).collect()))
    assert got == [(1, 10), (2, 10), (3, 10), (4, 20), (5, 20), (7, 10), (9, 10)]
    assert sorted(map(tuple, groups.found_ties(df, work).collect())) == [(10, 11), (30, 31)]


def test_splits_keep_groups_whole_and_reach_targets(spark, work):
    rows = [(i, i // 3 + 1000, 5 if i < 300 else None) for i in range(3000)] + [(5000 + i, None, None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, qid1 long, qid2 long")
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), (None, 0.5)], "split string, target_share double")
    out = groups.split_records(df, targets, work).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    by = defaultdict(set)
    for r in out:
        by[r.grp].add(r.split)
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r.split for r in out)
    for s, t in (("train", 0.8), ("valid", 0.1), ("test", 0.1)):
        assert share[s] / len(out) == pytest.approx(t, abs=0.03)


def test_splits_of_nothing(spark, work):
    df = spark.createDataFrame([], "id long, qid1 long, qid2 long")
    targets = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    assert groups.split_records(df, targets, work).collect() == []
