"""Queries of the catalogue on small tables of their own."""

import random

import pytest

import __spark_entry__ as e
from pairloom import catalog
from pairloom.operators import learn, rows

PAIRS = [("röd", "rod"), ("ö", "é"), ("naïve café", "naive cafe"), ("日本語", "日本"), ("a😀b", "ab"), ("same", "same"), (None, "x"), (None, None), ("", "né"), ("kitten", "sitting")]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_takes_whole_texts(spark, tmp_path):
    train = [(i, a, b, 0) for i, (a, b) in enumerate(PAIRS)]
    spark.createDataFrame(train, "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    got = {r.id: (r.distance, r.inverse) for r in e.queries()["levenshtein_distance"](spark, str(tmp_path)).collect()}
    want = {i: brute_distance(a or "", b or "") for i, a, b, _ in train}
    assert got == {i: (d, pytest.approx(1 / d if d else 0, abs=1e-6)) for i, d in want.items()}


def test_learners_are_registered_whole(spark, monkeypatch):
    seen, cells = [], []
    frame = spark.createDataFrame([(1, 1, 0.5, 0)], "id long, label int, z double, fold int")
    monkeypatch.setattr(catalog, "features", lambda s, d: frame)
    monkeypatch.setattr(learn, "out_of_fold", lambda df, key, label, names, learner, k: seen.append((learner, k)))
    monkeypatch.setattr(learn, "stacked", lambda levels, key, label, folds, k: None)
    monkeypatch.setattr(learn, "grid_search", lambda df, label, names, grid, make, k=5: [cells.append((c, k)) or (c, 0.5) for c in grid])
    for name in ("rf_predict", "gbt_predict", "gbc_predict", "mlp_predict", "rf_balanced_predict", "svc_predict", "cv_grid"):
        e.queries()[name](spark, "")
    whole = [learn.forest("label"), learn.boosted("label", held="held"), learn.boosted("label", depth=4, features="sqrt"), learn.perceptron("label", 5), learn.forest("label", weight="weight"), learn.support_vector("label")]
    values = lambda x: {p.name: v for p, v in x.extractParamMap().items()}
    assert [values(x) for x, _ in seen] == [values(x) for x in whole]
    assert all(k == 5 for _, k in seen + cells) and len(cells) == 8 + 18


def _table(spark, n=400):
    rng = random.Random(3)
    rows_ = [(i, int(z + 0.3 * rng.random() > 0.65), z, rng.random(), i % 5) for i in range(n) for z in [rng.random()]]
    return spark.createDataFrame(rows_, "id long, label int, z1 double, z2 double, fold int")


def test_logistic_regression_takes_the_rows_it_is_fitted_on(spark):
    df = _table(spark)
    assert learn.logistic("label")(400).getRegParam() == pytest.approx(1 / 1.2 / 400)
    models = learn.fold_models(df, "label", ["z1", "z2"], learn.logistic("label"), 5)
    assert all(m.stages[-1].getRegParam() == pytest.approx(1 / 1.2 / 320) for m in models)


def test_saved_models_fold_means_and_scores(spark, tmp_path):
    df = _table(spark)
    models = learn.fold_models(df, "label", ["z1", "z2"], learn.logistic("label"), 5)
    learn.save_model(models[0], str(tmp_path / "m"))
    p = lambda m: [(r.id, round(r.p, 9)) for r in learn.probability(m.transform(df)).orderBy("id").collect()]
    assert p(learn.load_model(str(tmp_path / "m"))) == p(models[0])
    for r in learn.fold_means(df, "id", models).collect():
        assert r.prediction == pytest.approx((r.p1 + r.p2 + r.p3 + r.p4 + r.p5) / 5)
    scores = learn.out_of_fold(df, "id", "label", ["z1", "z2"], learn.support_vector("label"), 5)
    assert scores.count() == 400 and rows.log_loss(scores, "label", "p").first()[0] < 0.6
    weighted = learn.balanced_weight(df, "label").groupBy("label").agg({"weight": "sum"}).collect()
    assert all(x[1] == pytest.approx(200) for x in weighted)


def test_feature_matrix_keeps_the_scores_of_all_ids(spark, tmp_path):
    spark.createDataFrame([(i, "a", "b c", i % 2) for i in range(1, 9)], "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    got = {x.id: x.f1 for x in e.queries()["feature_matrix_whole"](spark, str(tmp_path)).collect()}
    want = {x.id: round(x.p1, 6) for x in catalog._scores(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 8 and any(want[i] for i in (1, 3, 5, 7))


def test_gaps_of_a_feature_table_are_zero(spark):
    test, submission = spark.createDataFrame([(1,), (2,)], "test_id long"), spark.createDataFrame([(1, 0.7)], "test_id long, f1 double")
    assert {tuple(x) for x in rows.join_features(test, [submission], ["test_id"]).select("test_id", "f1").collect()} == {(1, 0.7), (2, 0.0)}


def test_equal_forests_of_a_grid_are_fitted_once(spark, monkeypatch):
    df, fitted = _table(spark), []
    fit = learn.RandomForestClassifier.fit
    monkeypatch.setattr(learn.RandomForestClassifier, "fit", lambda self, *a: fitted.append(self) or fit(self, *a))
    cells = [{"trees": t, "features": m} for t in (2, 3) for m in ("auto", "sqrt", "all")]
    out = learn.grid_search(df, "label", ["z1", "z2"], cells, lambda **c: learn.forest("label", depth=2, **c), 2)
    assert [c for c, _ in out] == cells and out[0][1] == out[1][1] and len(fitted) == 2 * 2  # both rules, and all, try two of two features
    df = df.filter("fold < 2")
    out = learn.grid_search(df, "label", ["z1", "z2"], [{"c": 0.5}, {"c": 1.2}], lambda **c: learn.logistic("label", **c), 2)
    for cell, loss in out:
        each = [learn._fit(df.filter(f"fold <> {i}"), ["z1", "z2"], learn.logistic("label", **cell)).transform(df.filter(f"fold = {i}")) for i in (0, 1)]
        assert loss == pytest.approx(sum(rows.log_loss(learn.probability(x), "label", "p").first()[0] for x in each) / 2)


def test_the_first_level_is_made_once(spark):
    df = _table(spark)
    levels = [learn.out_of_fold(df, "id", "label", ["z1", "z2"], m, 5) for m in (learn.logistic("label"), learn.logistic("label", 0.1))]
    out = learn.stacked(levels, "id", "label", df, 5)
    assert out.count() == 400 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
