"""Per-key results and joins where a few keys hold most of the rows.

* :func:`hot_keys` - the keys whose load is above a share of the whole; their number is bounded by the share.
* :func:`hot_cold_join` - join a large side to one row per key; hot keys are joined by broadcast of their (bounded)
  rows, all others by a shuffle.
* :func:`join_by_load` - the same where the joined rows carry the load of their key, for keys of several columns.
* :func:`salted_join` - the same without counting first: hot keys are spread over salts.
* :func:`plan_shards` - fragment-replicate plan by estimated load: keys larger than a task's share are split into shards
  in proportion to their load, the shards are bin-packed to tasks, all other keys are hashed to tasks.
* :func:`fragment_replicate_join` - join by such a plan: the loaded side is fragmented, the matching side is
  replicated only to the shards of the keys that were split.
* :func:`per_key_results` - pairs, positive labels, partners and the share of each key in all pairs.

No row is dropped or sampled; a null key belongs to no result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.005
#: Rows that a task takes in its stride; a key that has no more of them is split nowhere, whatever its share.
EASY = 10_000
#: Salts of a key at most.
MOST_SALTS = 200


def hot_keys(loads: DataFrame, key: str, load: str = "load", share: float = HOT_SHARE, total: int | None = None) -> list:
    """Keys of ``loads`` (one row per key) with more than ``share`` of the whole load, and than :data:`EASY`: at most ``1 / share`` values.

    ``total`` is the whole load where the caller knows it.
    """
    if total is None:
        total = loads.agg(F.sum(load)).first()[0] or 0
    return [r[0] for r in loads.filter(F.col(load) > max(EASY, share * total)).select(key).collect()]


def hot_cold_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined on ``key`` to ``right``, which has one row per key; ``hot`` are keys with very many rows in left.

    The rows of ``right`` for hot keys are as many as ``hot`` and are broadcast, so that the rows of ``left`` with such a key
    stay where they are; all other rows meet in a merge join, so nothing that grows with the data is broadcast. ``how`` is inner or left; a null key matches nothing.
    """
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how)
    far = left.filter(~is_hot).join(right.filter(~F.col(key).isin(hot)).hint("merge"), key, how)
    return near.unionByName(far)


def join_by_load(left: DataFrame, right: DataFrame, on: list[str], load: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has one row per key with ``load``, the key's rows in ``left`` (``total`` in all).

    Rows of ``right`` with more than ``share`` of the total, at most 1 / share, are broadcast; all others are joined by a shuffle in
    which the rows of ``left`` for those keys take no part. ``load`` isn't in the result.
    """
    hot = F.col(load) > share * total
    big = right.filter(hot).drop(load)
    near = left.join(F.broadcast(big), on)
    return near.unionByName(left.join(F.broadcast(big.select(*on)), on, "left_anti").join(right.filter(~hot).drop(load), on))


def salted_join(left: DataFrame, right: DataFrame, key: str, load: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """``left`` joined on ``key`` to ``right``, which has one row per key with ``load``, about the key's rows in ``left``.

    Nothing is counted beforehand: a key with more than ``share`` of all load (at most 1 / share of them are broadcast) gets a salt for each such
    share. Its rows of ``left`` are spread over the salts by the hash of their other columns, its row of ``right`` is repeated for
    each salt. ``how`` is inner or left; ``load`` isn't in the result.
    """
    whole = F.broadcast(right.agg(F.sum(load).alias("_whole")))  # one row
    part = F.coalesce(F.ceil(F.try_divide(F.col(load), F.lit(share) * F.col("_whole"))), F.lit(0))
    table = right.crossJoin(whole).withColumn("_salts", F.greatest(F.lit(1), F.least(F.lit(MOST_SALTS), part)).cast("int")).drop("_whole", load)
    hot = F.broadcast(table.filter("_salts > 1").select(key, "_salts"))
    others = [c for c in left.columns if c != key]
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*others), F.col("_salts"))).otherwise(0).cast("int")
    spread = left.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


@dataclass
class ShardPlan:
    """Task ``bins``; ``split`` maps each key that is split to the task of each of its shards."""

    bins: int
    split: dict


def plan_shards(loads: DataFrame, key: str, load: str = "load", bins: int | None = None) -> ShardPlan:
    """Plan of ``bins`` tasks from the load of each key.

    A key is split if it has more than a fourth of a task's mean load, so at most 4 * bins keys reach the driver. A split
    key gets a shard for each such fourth; the shards go, largest first, to the task with the least load so far.
    """
    bins = bins or max(2, int(loads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = loads.agg(F.sum(load)).first()[0] or 0
    quantum = max(1.0, total / bins / 4)
    large = [(r[0], r[1]) for r in loads.filter(F.col(load) > quantum).select(key, load).collect()]
    rest = (total - sum(n for _, n in large)) / bins  # the other keys are hashed evenly
    tasks = [(rest, i) for i in range(bins)]
    shards = sorted(((n / s, k, i) for k, n in large for s in [math.ceil(n / quantum)] for i in range(s)), key=lambda x: (-x[0], str(x[1]), x[2]))
    split: dict = {k: {} for k, _ in large}
    for size, k, i in shards:
        at, b = heapq.heappop(tasks)
        split[k][i] = b
        heapq.heappush(tasks, (at + size, b))
    return ShardPlan(bins, {k: [v[i] for i in range(len(v))] for k, v in split.items()})


def _split_table(df: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(k, v) for k, v in plan.split.items()], f"`{key}` {kind}, _tasks array<int>")


def fragment(df: DataFrame, key: str, spread_by: list[str], plan: ShardPlan) -> DataFrame:
    """``df`` with ``_task``: rows of a split key go to one of its shards by the hash of ``spread_by``, others by key."""
    t = F.broadcast(_split_table(df, key, plan))  # at most 4 * bins rows
    shard = F.pmod(F.xxhash64(*spread_by), F.size("_tasks"))
    task = F.when(F.col("_tasks").isNull(), F.pmod(F.xxhash64(key), F.lit(plan.bins)).cast("int")).otherwise(F.col("_tasks")[shard])
    return df.join(t, key, "left").withColumn("_task", task).drop("_tasks")


def replicate(df: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """``df`` with ``_task``: a row of a split key once for each task that has a shard of it, others once."""
    t = F.broadcast(_split_table(df, key, plan))
    own = F.array(F.pmod(F.xxhash64(key), F.lit(plan.bins)).cast("int"))
    return df.join(t, key, "left").withColumn("_task", F.explode(F.coalesce(F.array_distinct("_tasks"), own))).drop("_tasks")


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], plan: ShardPlan) -> DataFrame:
    """Inner join on ``key``: ``left`` is fragmented by ``plan``, ``right`` replicated to the shards. Keeps ``_task``.

    Rows of both sides are sent to the partition whose number is ``_task``, so the plan's tasks are the tasks that run.
    """
    sides = (x.repartitionById(plan.bins, F.col("_task")) for x in (fragment(left, key, spread_by, plan), replicate(right, key, plan)))
    a, b = sides
    return a.join(b.hint("merge"), ["_task", key])


def key_pairs(pairs: DataFrame, ident: str, a: str, b: str, label: str) -> DataFrame:
    """(ident, key, partner, label) of every pair, once for each of its two keys; a pair of a key with itself counts once."""
    both = F.array(F.struct(F.col(a).alias("key"), F.col(b).alias("partner")), F.struct(F.col(b).alias("key"), F.col(a).alias("partner")))
    one = F.array(F.struct(F.col(a).alias("key"), F.col(b).alias("partner")))
    return (
        pairs.select(F.col(ident).alias("ident"), F.explode(F.when(F.col(a).eqNullSafe(F.col(b)), one).otherwise(both)).alias("x"), F.col(label).alias("label"))
        .select("ident", "x.key", "x.partner", "label")
        .filter(F.col("key").isNotNull())
    )


def per_key_results(pairs: DataFrame, ident: str, a: str, b: str, label: str, bins: int | None = None) -> DataFrame:
    """Per key of ``a`` or ``b``: pairs, positive labels, distinct partners, and the share of positive labels.

    ``pairs`` has one row per record, told apart by ``ident``. A null label is not positive, a null partner is none, a key paired
    with itself is its own partner. An empty table gives no rows. Loads are counted first; the pairs of a large key are
    fragmented by record, so neither a missing partner nor one partner with very many pairs makes a large shard; the load row of
    a key is replicated to its shards and gives each pair its weight within the key. What a shard has of a partner is added up,
    then partners are counted per key.
    """
    long = key_pairs(pairs, ident, a, b, label)
    loads = long.groupBy("key").agg(F.count(F.lit(1)).alias("load"))
    plan = plan_shards(loads, "key", bins=bins)
    joined = fragment_replicate_join(long, loads, "key", ["ident"], plan)
    by_partner = joined.groupBy("key", "partner").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("positive"), F.max("load").alias("load")
    )
    return by_partner.groupBy("key").agg(
        F.sum("pairs").alias("pairs"),
        F.sum("positive").alias("positive"),
        F.count("partner").alias("partners"),
        F.round(F.sum("positive") / F.max("load"), 6).alias("positive_rate"),
    )
