"""Row numbers, splits, folds, resampling and predictions, all by explicit keys and without a single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import Workspace


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2 ... in the order of ``by`` (a unique key).

    Rows are range-partitioned and sorted, and each row's partition and place are written with it: a second computation might draw
    other bounds, so all that follows reads what was written. A row's number is its place after the counts of the partitions
    before its own, of which there are as many as partitions.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = Workspace(df.sparkSession, "numbered").save(ordered.withColumn("_m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, (place + F.col("_o")).cast("long")).drop("_p", "_o", "_m")


def bucket(key: str, seed: str, n: int = 1_000_000) -> Column:
    """A number from 0 to n - 1 for each key, from the MD5 of the key and a seed: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), 1, 8), 16, 10).cast("long") % n


def shuffle_order(key: str, seed: str) -> Column:
    """A sort key that shuffles rows, the same way for the same seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))


def hash_split(df: DataFrame, key: str, share: float, seed: str = "split", name: str = "part") -> DataFrame:
    """``df`` with ``name``: 'valid' for about ``share`` of the keys, else 'train'."""
    return df.withColumn(name, F.when(bucket(key, seed) < int(share * 1_000_000), "valid").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, seed: str = "fold", label: str | None = None) -> DataFrame:
    """``df`` with ``fold`` 0 to k - 1 by hash of the key; with ``label`` the hash also depends on it (stratified in expectation)."""
    c = F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string")) if label else F.col(key).cast("string")
    return df.withColumn("_f", c).withColumn("fold", (bucket("_f", seed) % k).cast("int")).drop("_f")


def fold_parts(df: DataFrame, test: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(fold, part, key): for each fold the rows of ``df`` (with ``fold``) to train on, those held out, and all rows of ``test``."""
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = df.select(key, F.col("fold").alias("_own"), each.alias("fold"))
    part = F.when(F.col("_own") == F.col("fold"), "held out").otherwise("train").alias("part")
    return own.select("fold", part, key).unionByName(test.select(each.alias("fold"), F.lit("test").alias("part"), key))


def contiguous_folds(df: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """``df`` with ``fold``: k runs of floor(n / k) rows in the order of ``by``; the last has the remainder."""
    n = df.count()
    return numbered(df, by, "_n").withColumn("fold", F.least(F.floor(F.col("_n") / max(1, n // k)), F.lit(k - 1)).cast("int")).drop("_n")


def oversample(df: DataFrame, key: str, label: str, scale: float) -> DataFrame:
    """``df`` with copies of its negatives: floor(scale) whole copies and the first part (by key) of one more.

    The column ``copy`` is 0 for the rows themselves.
    """
    whole = int(scale)
    neg = df.filter(F.col(label) == 0)
    out = df.withColumn("copy", F.explode(F.when(F.col(label) == 0, F.sequence(F.lit(0), F.lit(whole))).otherwise(F.array(F.lit(0)))))
    rest = int((scale - whole) * neg.count())
    if rest:
        out = out.unionByName(numbered(neg, [key], "_n").filter(F.col("_n") < rest).drop("_n").withColumn("copy", F.lit(whole + 1)))
    return out


def oversample_to_prior(df: DataFrame, key: str, label: str, prior: float = 0.165) -> DataFrame:
    """Negatives are doubled, as a whole, until the positives' share is near ``prior``; the last step takes the first part of them.

    While scale = share / prior - 1 is above 1 the negatives double and scale drops by 1; then floor(scale * negatives) of the
    doubled negatives, in the order of copies and key, are added.
    """
    pos, n = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label).isin(0, 1))).first()
    scale = pos / max(n, 1) / prior - 1
    times = 1
    while scale > 1:
        times, scale = times * 2, scale - 1
    negatives = n - pos
    extra = int(max(scale, 0) * negatives * times)
    whole, rest = divmod(extra, max(negatives, 1))
    out = df.withColumn("copy", F.explode(F.when(F.col(label) == 0, F.sequence(F.lit(0), F.lit(times + whole - 1))).otherwise(F.array(F.lit(0)))))
    if rest:
        out = out.unionByName(numbered(df.filter(F.col(label) == 0), [key], "_n").filter(F.col("_n") < rest).drop("_n").withColumn("copy", F.lit(times + whole)))
    return out


def prior_weight(label: Column, positive: float = 0.472001959, negative: float = 1.309028344) -> Column:
    """Weight of a row by its class."""
    return F.when(label == 1, positive).otherwise(negative)


def pair_swap(df: DataFrame, a: str = "question1", b: str = "question2") -> DataFrame:
    """``df`` and its rows with the two texts in exchanged places; ``swapped`` tells which."""
    sides = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(0).alias("s")), F.struct(F.col(b).alias("x"), F.col(a).alias("y"), F.lit(1).alias("s")))
    return df.withColumn("_s", F.explode(sides)).withColumns({a: F.col("_s.x"), b: F.col("_s.y"), "swapped": F.col("_s.s")}).drop("_s")


def log_loss(df: DataFrame, label: str, p: str, eps: float = 1e-15) -> DataFrame:
    """One row (log_loss): the mean of -(y ln p + (1 - y) ln(1 - p)), p kept within eps and 1 - eps; rows with a null are left out."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return df.filter(F.col(label).isNotNull() & F.col(p).isNotNull()).agg(F.avg(-(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q))).alias("log_loss"))


def mean_of_folds(df: DataFrame, columns: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with the mean of the folds' predictions, 0 if one of them is missing or NaN."""
    bad = reduce(lambda x, y: x | y, [F.col(c).isNull() | F.isnan(c) for c in columns])
    return df.withColumn(name, F.when(bad, 0.0).otherwise(reduce(lambda x, y: x + y, [F.col(c) for c in columns]) / len(columns)))


def blend(frames: list[tuple[DataFrame, float]], key: str, p: str) -> DataFrame:
    """(key, p): the weighted sum of several predictions; a key must be in all of them."""
    parts = [df.select(key, (F.col(p) * w).alias(f"_{i}")) for i, (df, w) in enumerate(frames)]
    return reduce(lambda x, y: x.join(y, key), parts).select(key, reduce(lambda x, y: x + y, [F.col(f"_{i}") for i in range(len(parts))]).alias(p))


def join_features(base: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """``base`` with the columns of all ``tables``, joined on ``keys``; missing features are 0."""
    out = reduce(lambda x, y: x.join(y, keys, "left"), tables, base)
    new = [c for c, t in out.dtypes if c not in base.columns and t in ("double", "float", "int", "bigint")]
    return out.fillna(0, new)


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are features by their name: those that begin with z or f."""
    return [c for c in df.columns if c[:1] in ("z", "f")]


def with_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """train and test in one table with ``split``; columns that one lacks are null there."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def standardize(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """``df`` with each column less its mean, over its standard deviation; 0 for a constant column."""
    sd = F.stddev_pop if population else F.stddev_samp
    s = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", sd))])
    out = df.crossJoin(F.broadcast(s))  # s is one row
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}).select(*df.columns)
