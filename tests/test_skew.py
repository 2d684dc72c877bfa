from collections import defaultdict

from pyspark.sql import functions as F

from pairloom.operators import skew


def brute(pairs):
    out = defaultdict(lambda: [0, 0, set()])
    for a, b, label in pairs:
        for k, p in {(a, b), (b, a)}:
            if k is not None:
                out[k][0] += 1
                out[k][1] += label == 1
                if p is not None:
                    out[k][2].add(p)
    return {k: (n, pos, len(p)) for k, (n, pos, p) in out.items()}


def test_per_key_results_hot_null_self_and_ties(spark):
    pairs = [(1, i, i % 3) for i in range(2, 400)] + [(None, 5, 1), (5, None, None), (7, 7, 1), (1, 2, 1), (None, None, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, a long, b long, label int").withColumn("key", F.lit("clash"))
    got = {r.key: (r.pairs, r.positive, r.partners) for r in skew.per_key_results(df, "id", "a", "b", "label", bins=4).collect()}
    assert got == brute(pairs)


def test_per_key_results_empty(spark):
    df = spark.createDataFrame([], "id long, a long, b long, label int")
    assert skew.per_key_results(df, "id", "a", "b", "label").collect() == []


def test_large_keys_are_split_in_proportion(spark):
    loads = spark.createDataFrame([(1, 1000), (2, 500), *[(k, 1) for k in range(3, 100)]], "key long, load long")
    plan = skew.plan_shards(loads, "key", bins=8)
    assert set(plan.split) == {1, 2}
    assert len(plan.split[1]) > len(plan.split[2]) > 1
    assert all(0 <= b < 8 for v in plan.split.values() for b in v)


def test_fragment_replicate_join_is_the_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (3, 1), (None, 9)], "key long, x long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d")], "key long, y string")
    plan = skew.plan_shards(left.groupBy("key").agg(F.count("*").alias("load")).filter("key is not null"), "key", bins=5)
    got = skew.fragment_replicate_join(left, right, "key", ["x"], plan).drop("_task")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_hot_cold_join(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 2)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, y string")
    for how in ("inner", "left"):
        got = skew.hot_cold_join(left, right, "k", [1], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    loads = left.groupBy("k").agg(F.count("*").alias("load"))
    assert skew.hot_keys(loads, "k", share=0.5) == []
    monkeypatch.setattr(skew, "EASY", 0)
    assert skew.hot_keys(loads, "k", share=0.5) == [1]


def test_join_by_load(spark):
    left = spark.createDataFrame([(1, 1, i) for i in range(50)] + [(1, 2, 1), (None, 2, 2)], "k long, l long, x long")
    right = spark.createDataFrame([(1, 1, 50, "a"), (1, 2, 1, "b"), (3, 3, 0, "c")], "k long, l long, n long, y string")
    want = sorted(map(tuple, left.join(right.drop("n"), ["k", "l"]).collect()))
    for share in (0.005, 0.5, 2.0):
        assert sorted(map(tuple, skew.join_by_load(left, right, ["k", "l"], "n", 51, share).collect())) == want


def test_hot_keys_without_partner_and_hot_pairs_are_even_tasks(spark):
    rows = [(i, 1, None if i % 10 else 2, 1) for i in range(9000)] + [(10_000 + i, 3, 4, 0) for i in range(3000)] + [(20_000 + i, i, i + 1, 0) for i in range(100, 600)]
    df = spark.createDataFrame(rows, "id long, a long, b long, label int")
    long = skew.key_pairs(df, "id", "a", "b", "label")
    loads = long.groupBy("key").agg(F.count("*").alias("load"))
    plan = skew.plan_shards(loads, "key", bins=8)
    joined = skew.fragment_replicate_join(long, loads, "key", ["ident"], plan)
    tasks = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) == 8 and max(tasks) < 1.5 * sum(tasks) / 8
    got = {r.key: (r.pairs, r.positive, r.partners) for r in skew.per_key_results(df, "id", "a", "b", "label", bins=8).collect()}
    assert got == brute([r[1:] for r in rows])


def test_salted_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 5), (None, 2), ("z", 9)], "k string, x long")
    right = spark.createDataFrame([("a", 300, 1.5), ("b", 1, 2.5), ("c", None, 3.5)], "k string, n long, y double")
    for how in ("inner", "left"):
        got = skew.salted_join(left, right, "k", "n", how)
        assert got.columns == ["k", "x", "y"]
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right.drop("n"), "k", how).collect()))
    assert skew.salted_join(left, right.limit(0), "k", "n", "left").count() == left.count()
