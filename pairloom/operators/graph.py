"""Features of the graph whose vertices are texts (or ids) and whose edges are pairs.

An edge table has (src, dst); :func:`both_ways` gives each pair in both directions. Iterations write their state to a working
table, so that no lineage grows. Hubs: neighbour counts join adjacency rows, not arrays, and vertices with very many
rows are joined by :func:`pairloom.operators.skew.hot_cold_join` or salted where one side has a row per vertex.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import Workspace
from .rows import numbered
from .skew import hot_cold_join, hot_keys, salted_join


def both_ways(pairs: DataFrame, a: str, b: str, *extra: str) -> DataFrame:
    """(src, dst, extra) of every pair in both directions; repeats stay, pairs with a null end go."""
    ends = F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(ends).alias("x"), *extra).select("x.src", "x.dst", *extra)


def frequency(pairs: DataFrame, a: str, b: str, *others: DataFrame) -> DataFrame:
    """(text, n): how often a text stands on either side, over all tables."""
    one = lambda df: df.select(F.explode(F.array(a, b)).alias("text"))
    out = one(pairs)
    for df in others:
        out = out.unionByName(one(df))
    return out.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def look_up(pairs: DataFrame, keys: dict[str, str], table: DataFrame, on: str, value: str, default=0) -> DataFrame:
    """``pairs`` with a column for each entry (column of pairs -> new name) of ``keys``, looked up in ``table`` (one row per key)."""
    total = None
    for c, name in keys.items():
        right = table.select(F.col(on).alias(c), F.col(value).alias(name))
        loads = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("load"))
        pairs = hot_cold_join(pairs, right, c, [k for k in hot_keys(loads, c, total=total) if k is not None], "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return pairs


def degree(edges: DataFrame) -> DataFrame:
    """(src, degree): distinct neighbours."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def common_neighbours(pairs: DataFrame, a: str, b: str, edges: DataFrame) -> DataFrame:
    """(a, b, common) of the distinct pairs: how many vertices are neighbours of both; 0 where there is none.

    The smaller adjacency of a pair is expanded and probed in the edges of the other end: work is the lesser degree per pair.
    """
    e = edges.select("src", "dst").distinct()
    deg = degree(e)
    p = pairs.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    for c, d in ((a, "da"), (b, "db")):
        # a pair table has about as many rows of a vertex as the vertex has neighbours
        p = salted_join(p, deg.select(F.col("src").alias(c), F.col("degree").alias(d), F.col("degree").alias("load")), c, "load")
    near, far = F.when(F.col("da") <= F.col("db"), F.col(a)).otherwise(F.col(b)), F.when(F.col("da") <= F.col("db"), F.col(b)).otherwise(F.col(a))
    q = p.select(a, b, near.alias("src"), far.alias("far"))
    hit = q.join(e, "src").join(e.select(F.col("src").alias("far"), "dst"), ["far", "dst"], "left_semi").groupBy(a, b).agg(F.count(F.lit(1)).alias("common"))
    return p.select(a, b).join(hit, [a, b], "left").withColumn("common", F.coalesce("common", F.lit(0)))


def weighted_common_ratio(pairs: DataFrame, a: str, b: str, edges: DataFrame) -> DataFrame:
    """(a, b, common, ratio): weight of the edges of both ends to common neighbours over the weight of all their edges.

    ``edges`` has (src, dst, weight), one row per src and dst. 0 without common neighbours or weight.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("degree"))
    p = pairs.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    for c, x in ((a, "a"), (b, "b")):
        p = salted_join(p, total.select(F.col("src").alias(c), F.col("total").alias(f"t{x}"), F.col("degree").alias(f"d{x}"), F.col("degree").alias("load")), c, "load", "left")
    # the smaller adjacency is expanded and probed in the edges of the other end
    less = F.coalesce("da", F.lit(0)) <= F.coalesce("db", F.lit(0))
    q = p.select(a, b, F.when(less, F.col(a)).otherwise(F.col(b)).alias("src"), F.when(less, F.col(b)).otherwise(F.col(a)).alias("far"))
    near = q.join(edges.select("src", "dst", F.col("weight").alias("wa")), "src")
    hit = near.join(edges.select(F.col("src").alias("far"), "dst", F.col("weight").alias("wb")), ["far", "dst"])
    hit = hit.groupBy(a, b).agg(F.count(F.lit(1)).alias("common"), F.sum(F.col("wa") + F.col("wb")).alias("w"))
    ratio = F.try_divide(F.col("w"), F.col("ta") + F.col("tb"))
    return p.join(hit, [a, b], "left").select(a, b, F.coalesce("common", F.lit(0)).alias("common"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))


def pagerank(edges: DataFrame, work: Workspace, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(v, pr) after ``rounds`` simultaneous rounds over a multigraph; parallel edges count as often as they stand.

    Starts at 1 / N, adds (1 - damping) / N each round; ``edges`` has both directions, so every vertex has an edge.
    """
    e = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    out = e.groupBy("src").agg(F.sum("k").alias("load"))
    out = work.save(out, "out")
    n, total = out.agg(F.count(F.lit(1)), F.sum("load")).first()
    hot = hot_keys(out, "src", total=total or 0)
    e = work.save(hot_cold_join(e, out, "src", hot).select("src", "dst", (F.col("k") / F.col("load")).alias("share")), "shares")
    # laid out by source once, the edges of hubs spread over salts, so that a round moves the ranks and not the edges; lost parts are
    # read again from the table
    is_hot, salts = F.col("src").isin(hot), max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.when(is_hot, F.pmod(F.xxhash64("dst"), F.lit(salts))).otherwise(0).cast("int")
    e = e.withColumn("salt", salt).repartition("src", "salt").sortWithinPartitions("src", "salt").persist(StorageLevel.DISK_ONLY)
    rank = out.select(F.col("src").alias("v"), F.lit(1.0 / max(n, 1)).alias("pr"))
    for i in range(rounds):
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        known = rank.withColumnRenamed("v", "src").select("src", "pr", F.explode(copies).alias("salt"))
        sent = e.join(known.hint("merge"), ["src", "salt"])
        rank = sent.groupBy(F.col("dst").alias("v")).agg((F.lit((1 - damping) / max(n, 1)) + damping * F.sum(F.col("pr") * F.col("share"))).alias("pr"))
        if i % 4 == 3 or i == rounds - 1:
            rank = work.save(rank, f"rank-{i}")
    e.unpersist()
    return rank


#: Bytes of the keys of a graph that one task takes whole.
SMALL = 64_000_000


def _peel(src: np.ndarray, dst: np.ndarray, n: int) -> list[int]:
    """Cores of the vertices 0 to ``n`` - 1 of a graph that fits into a task: the vertex with the least degree goes first."""
    order = np.argsort(src, kind="stable")
    near, start = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    deg = [b - a for a, b in zip(start, start[1:])]
    by = np.argsort(deg, kind="stable").tolist()
    place = np.argsort(by).tolist()
    first = np.searchsorted(np.sort(deg), np.arange(max(deg, default=0) + 2)).tolist()  # of each degree in ``by``
    for i in range(n):
        v = by[i]
        for u in near[start[v] : start[v + 1]]:
            if deg[u] > deg[v]:
                # u changes places with the first of its degree, which then belongs to the degree below
                at, to = place[u], max(first[deg[u]], i + 1)
                w = by[to]
                by[at], by[to], place[w], place[u] = w, u, at, to
                first[deg[u]] = to + 1
                deg[u] -= 1
    return deg


def kcore(edges: DataFrame, work: Workspace, most_rounds: int = 10_000) -> DataFrame:
    """(v, core): the largest k for which the vertex is in a subgraph where every vertex has k distinct neighbours.

    Each vertex starts with its degree and is lowered to the largest k such that k neighbours have at least k, until nothing
    changes. The counts that settle k are a histogram per vertex, summed from above, so a hub's neighbours aren't gathered.
    Vertices with the least value of a round have their core, as all others have so many neighbours among themselves and them; they
    go with their edges. As soon as what is left fits into a task (:data:`SMALL`), it is peeled there.
    """
    e = work.save(edges.filter("src <> dst").select("src", "dst").distinct(), "edges-0")
    core = work.save(e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("core")), "core-0")
    n, rows = core.agg(F.count(F.lit(1)), F.sum("core")).first()
    hot = hot_keys(core, "v", "core", total=rows or 0)
    kind, laid, done, last = core.schema["v"].dataType.simpleString(), 0, [core.limit(0)], None

    def peeled(batches):
        t = pa.Table.from_batches(batches)
        if t.num_rows:
            ends = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).combine_chunks().dictionary_encode()
            at = ends.indices.to_numpy()
            cores = _peel(at[: t.num_rows], at[t.num_rows :], len(ends.dictionary))
            yield pa.RecordBatch.from_arrays([ends.dictionary, pa.array(cores, pa.int64())], ["v", "core"])

    for i in range(most_rounds):
        low = core.agg(F.min("core")).first()[0]
        live = core.filter(F.col("core") > low) if low is not None else core
        left, now = live.agg(F.count(F.lit(1)), F.sum("core")).first()
        if low is None or last == (now or 0) + low * (n - left):  # nothing is left, or nothing changed
            done.append(core)
            break
        done.append(core.filter(F.col("core") == low))
        if not i or 2 * left < laid:
            # edges between those left
            ends = live.select("v")
            for end in ("src", "dst"):
                e = hot_cold_join(e, ends.withColumnRenamed("v", end), end, hot)
            e, laid = work.save(e, f"edges-{i + 1}"), left
            size = e.agg(F.sum(F.octet_length(F.col("src").cast("string")) + F.octet_length(F.col("dst").cast("string")))).first()[0] or 0
            if size <= SMALL:
                inner = e.coalesce(1).mapInArrow(peeled, f"v {kind}, core long")
                done.append(live.select("v").join(inner, "v", "left").select("v", F.greatest(F.lit(low), F.coalesce("core", F.lit(0))).alias("core")))
                break
        # neighbours' values, cut at the vertex's own value: a histogram of at most core + 1 steps
        near = hot_cold_join(e.select(F.col("dst").alias("v"), "src"), live, "v", hot).select(F.col("src").alias("v"), F.col("core").alias("c"))
        hist = near.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("v").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
        new = hist.withColumn("reach", F.sum("n").over(above)).groupBy("v").agg(F.max(F.least("c", "reach")).alias("h"))
        new = live.join(new, "v", "left").select("v", F.greatest(F.lit(low), F.least(F.coalesce("h", F.lit(0)), "core")).alias("core"))
        core, n, last = work.save(new, f"core-{i + 1}"), left, now or 0
    else:
        raise RuntimeError(f"not stable after {most_rounds} rounds")
    return reduce(DataFrame.unionByName, done)


def first_seen_ids(texts: DataFrame, text: str, position: list[str]) -> DataFrame:
    """(text, n): 0, 1, 2 ... in the order of first appearance by ``position``, without a single-task sort.

    See :func:`pairloom.operators.rows.numbered`.
    """
    first = texts.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(F.struct(*position)).alias("at"))
    return numbered(first, ["at"], "n").select(F.col(text).alias("text"), "n")


def allocate_ids(wanted: DataFrame, known: DataFrame, key: str, ident: str, start: int) -> DataFrame:
    """(key, ident): the known id of each key, else a new one above ``start``, in the order of the keys."""
    w = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    old = w.join(known.select(key, ident), key)
    new = numbered(w.join(known.select(key), key, "left_anti"), [key], ident).withColumn(ident, F.col(ident) + start + 1)
    return old.select(key, ident).unionByName(new.select(key, ident))
