"""Learners on feature tables: classifiers, out-of-fold predictions, grid search, stacking, learned vectors, decomposition."""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import Workspace
from .embed import nearest
from .rows import log_loss, mean_of_folds

SEED = 1632


def boosted(label: str, rounds: int = 40, step: float = 0.05, depth: int = 6, share: float = 0.8, features: str = "all", held: str | None = None):
    """Gradient-boosted trees; with ``held`` (column, true for held-out rows) boosting stops when the loss on these rows no longer falls."""
    model = GBTClassifier(labelCol=label, featuresCol="scaled", maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=share, featureSubsetStrategy=features, seed=SEED)
    return model.setValidationIndicatorCol(held) if held else model


def logistic(label: str, c: float = 1.2, weight: str | None = None):
    """L2 logistic regression with inverse strength ``c``, as a function of the number of rows that it is fitted on."""

    def of(rows: int) -> LogisticRegression:
        lr = LogisticRegression(labelCol=label, featuresCol="scaled", regParam=1 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)
        return lr.setWeightCol(weight) if weight else lr

    return of


def forest(label: str, trees: int = 100, depth: int = 8, leaf: int = 20, features: str = "auto", weight: str | None = None):
    rf = RandomForestClassifier(labelCol=label, featuresCol="scaled", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=features, seed=SEED)
    return rf.setWeightCol(weight) if weight else rf


def perceptron(label: str, inputs: int, hidden: int = 100):
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol="scaled", layers=[inputs, hidden, 2], maxIter=50, seed=SEED)


def support_vector(label: str):
    """Linear support vectors; their scores become probabilities by the logistic function."""
    return LinearSVC(labelCol=label, featuresCol="scaled", maxIter=50)


def balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``df`` with ``name``: rows / (classes * rows of the own class), so that all classes weigh the same."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    share = F.broadcast(n.crossJoin(whole).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(name)))  # one row for each class
    return df.join(share, label)


def scaling(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]


def pipeline(features: list[str], learner) -> Pipeline:
    """Assemble, scale, learn. Missing features are filled with 0 by the caller."""
    return Pipeline(stages=[*scaling(features), learner])


def probability(df: DataFrame) -> DataFrame:
    """``df`` with ``p``, the probability of label 1."""
    if "probability" in df.columns:
        return df.withColumn("p", vector_to_array("probability")[1])
    return df.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))


def _fit(df: DataFrame, features: list[str], learner) -> PipelineModel:
    """``learner``: an estimator, or a function of the number of rows that gives one."""
    return pipeline(features, learner(df.count()) if not hasattr(learner, "fit") else learner).fit(df)


def fold_models(df: DataFrame, label: str, features: list[str], learner, k: int, parallelism: int = 4) -> list[PipelineModel]:
    """For each fold (column ``fold``) a model that was fitted on the other folds; fits run side by side."""
    df = _labelled(df, label).persist()
    try:
        with ThreadPool(min(k, parallelism)) as pool:
            return pool.map(lambda i: _fit(df.filter(F.col("fold") != i), features, learner), range(k))
    finally:
        df.unpersist()


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], learner, k: int) -> DataFrame:
    """(key, fold, label, p): each row predicted by a model that was fitted on the other folds (column ``fold``)."""
    models = fold_models(df, label, features, learner, k)
    df = _labelled(df, label)
    return reduce(DataFrame.unionByName, [probability(m.transform(df.filter(F.col("fold") == i))).select(key, "fold", label, "p") for i, m in enumerate(models)])


def fold_means(df: DataFrame, key: str, models: list[PipelineModel]) -> DataFrame:
    """(key, p1 ... pk, prediction): what each fold's model says of every row, and the mean."""
    out = df
    for i, m in enumerate(models, 1):
        p = probability(m.transform(out))
        out = p.withColumnRenamed("p", f"p{i}").drop("raw", "scaled", "rawPrediction", "probability", "prediction")
    names = [f"p{i}" for i in range(1, len(models) + 1)]
    return mean_of_folds(out, names).select(key, *names, "prediction")


def _same_trees(learner, inputs: int):
    """What tells a forest's models apart: its parameters, with the number of features tried at a split in place of the rule's name."""
    if not isinstance(learner, RandomForestClassifier):
        return None
    tried = {"sqrt": math.ceil(math.sqrt(inputs)), "log2": max(1, math.ceil(math.log2(inputs))), "all": inputs}
    rule = learner.getFeatureSubsetStrategy()
    rule = ("sqrt" if learner.getNumTrees() > 1 else "all") if rule == "auto" else rule
    values = {p.name: v for p, v in learner.extractParamMap().items()} | {"featureSubsetStrategy": tried.get(rule, rule)}
    return tuple(sorted((k, str(v)) for k, v in values.items()))


def grid_search(df: DataFrame, label: str, features: list[str], cells: list[dict], make, k: int = 5, parallelism: int = 4) -> list[tuple[dict, float]]:
    """(cell, mean log-loss over the ``k`` folds of column ``fold``) of each of ``cells``; ``make(**cell)`` gives the learner.

    A fold's rows are scaled and laid into memory once for all cells. Cells that ask for the same forest (rules that try the same number
    of features) are fitted once.
    """
    df = _labelled(df, label)
    learners = [make(**c) for c in cells]
    first: dict = {}
    of = [c if (t := _same_trees(x, len(features))) is None else first.setdefault(t, c) for c, x in enumerate(learners)]
    scale = Pipeline(stages=scaling(features))
    losses: dict[int, list[float]] = {c: [] for c in of}
    for i in range(k):
        own = scale.fit(df.filter(F.col("fold") != i))
        train, held = (own.transform(x).drop("raw", *features).persist() for x in (df.filter(F.col("fold") != i), df.filter(F.col("fold") == i)))
        rows = train.count()

        def loss(cell: int) -> float:
            learner = learners[cell]
            model = (learner if hasattr(learner, "fit") else learner(rows)).fit(train)
            return log_loss(probability(model.transform(held)), label, "p").first()[0]

        try:
            with ThreadPool(parallelism) as pool:
                for c, said in zip(losses, pool.map(loss, losses)):
                    losses[c].append(said)
        finally:
            train.unpersist()
            held.unpersist()
    return [(cell, sum(losses[of[c]]) / k) for c, cell in enumerate(cells)]


def stacked(levels: list[DataFrame], key: str, label: str, folds: DataFrame, k: int) -> DataFrame:
    """(key, label, p): a second level, fitted fold by fold on the first level's out-of-fold predictions, which are made once, as a working table."""
    parts = [df.select(key, F.col("p").alias(f"p{i}")) for i, df in enumerate(levels)]
    joined = reduce(lambda x, y: x.join(y, key), parts).join(folds.select(key, "fold", label), key)
    joined = Workspace(folds.sparkSession, "stacked").save(joined, "first")
    names = [f"p{i}" for i in range(len(parts))]
    return out_of_fold(joined, key, label, names, logistic(label), k).select(key, label, "p")


def learned_vectors(docs: DataFrame, tokens: str, size: int = 32, least: int = 2, rounds: int = 2):
    """A word2vec model of the token arrays; stands in for document-vector models, whose training has no counterpart in Spark.

    Every core trains on a part of the documents, and the parts' vectors are averaged after each of ``rounds``.
    """
    parts = docs.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(vectorSize=size, minCount=least, maxIter=rounds, seed=SEED, inputCol=tokens, outputCol="vec", numPartitions=parts).fit(docs)


def document_vectors(docs: DataFrame, model, columns: dict[str, str]) -> DataFrame:
    """``docs`` with the mean of the vectors of the tokens of each of ``columns`` (column of tokens -> new name)."""
    for tokens, name in columns.items():
        docs = model.setInputCol(tokens).setOutputCol(name).transform(docs).withColumn(name, vector_to_array(name))
    return docs


def synonym_table(model, k: int = 5) -> DataFrame:
    """(word, syns): the k nearest words of every word of the model."""
    v = model.getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("vec"))
    near = nearest(v.withColumnRenamed("item", "query"), v, k, model.getVectorSize())
    best = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))  # k rows
    return best.select(F.col("query").alias("word"), F.transform("x", lambda s: s["item"]).alias("syns"))


def hash_cells(grams: Column, size: int) -> Column:
    """The hash cell, 0 to ``size`` - 1, of each gram."""
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))


def _counts(cells: pd.Series, size: int) -> np.ndarray:
    """Rows of L2-scaled counts of the cells."""
    x = np.stack([np.bincount(np.asarray(c, dtype=int), minlength=size) for c in cells]).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def truncated_svd(df: DataFrame, key: str, cells: str, size: int, k: int) -> DataFrame:
    """(key, components): projections of the rows' cell counts on their k first right singular vectors, without centring.

    The Gram matrix (size * size numbers, whatever the rows) is added up within partitions before it is sent; signs are set so
    that each singular vector's largest entry is positive. A row without cells is all zeros.
    """

    def gram(batches):
        g = np.zeros((size, size))
        for b in batches:
            if len(b):
                x = _counts(b[cells], size)
                g += x.T @ x
        yield pd.DataFrame({"i": np.arange(size), "row": list(g)})

    parts = df.select(cells).mapInPandas(gram, "i int, row array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(size)]).orderBy("i").collect()
    g = np.array([list(r)[1:] for r in rows]) if rows else np.eye(size)
    _, v = np.linalg.eigh(g)
    v = v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])

    def project(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "components": list(_counts(b[cells], size) @ v)})

    return df.select(key, cells).mapInPandas(project, f"{key} {df.schema[key].dataType.simpleString()}, components array<double>")
