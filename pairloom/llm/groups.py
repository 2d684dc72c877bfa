"""Records that belong together: groups from pairwise matches, and splits that keep groups whole.

* :func:`hash_to_min` - every vertex sends its cluster to the cluster's smallest member, and that member to all others,
  until nothing changes. Clusters are rows (vertex, member), so that no cluster has to fit into one task.
* :func:`boruvka` - every component takes its smallest outgoing edge; the components joined by these edges become one. The edges
  taken are the spanning forest, which is kept as a table.
* :func:`assign_splits` - the roots of the forest, in bands of size, are dealt to the splits.

Edges with a null end, and edges from a vertex to itself, tie nothing. Repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_cold_join, hot_keys
from ..plans.work import Workspace


def edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (u, v) with u < v."""
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def hash_to_min(pairs: DataFrame, a: str, b: str, work: Workspace, most_rounds: int = 100) -> DataFrame:
    """(member, grp): the smallest vertex of its component for each vertex that has an edge."""
    e = edges(pairs, a, b)
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("m")) for x, y in (("u", "v"), ("v", "u"), ("u", "u"), ("v", "v"))]))
    rows = work.save(e.select(ends.alias("x")).select("x.v", "x.m").distinct(), "clusters-0")
    seen = None
    for i in range(most_rounds):
        mins = work.save(rows.groupBy("v").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("load")), f"least-{i}")
        sent = hot_cold_join(rows, mins.select("v", "least"), "v", hot_keys(mins, "v"))
        out = F.explode(F.array(F.struct(F.col("least").alias("v"), F.col("m").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m"))))
        new = work.save(sent.select(out.alias("x")).select("x.v", "x.m").distinct(), f"clusters-{i + 1}")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        work.drop(f"clusters-{i}", f"least-{i}")
        rows = new
        if now == seen:
            return rows.groupBy("v").agg(F.min("m").alias("grp")).withColumnRenamed("v", "member")
        seen = now
    raise RuntimeError(f"not stable after {most_rounds} rounds")


def _hot(df: DataFrame, column: str, rows: int) -> list:
    """Hot values of a column of a table of ``rows`` rows."""
    return hot_keys(df.groupBy(column).agg(F.count(F.lit(1)).alias("load")), column, total=rows)


def _jump(parents: DataFrame, rows: int) -> DataFrame:
    """Each vertex's parent's parent."""
    up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return hot_cold_join(parents, up, "p", _hot(parents, "p", rows)).select("v", F.col("pp").alias("p"))


def boruvka(pairs: DataFrame, a: str, b: str, work: Workspace, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(root of each vertex: v, root), (forest: u, v), which stay in ``work`` as tables "roots" and "forest".

    Edges are ordered by a hash of their ends, which keeps trees shallow.
    """
    live = edges(pairs, a, b).select("u", "v", F.xxhash64("u", "v").alias("w"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    live = work.save(live, "edges-0")
    maps, trees, sizes = [], [], []
    for i in range(most_rounds):
        half = live.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("p")), F.struct(F.col("v").alias("v"), F.col("u").alias("p")))).alias("x"), "w", "ou", "ov")
        # edges are ordered by weight, then by their ends, so no two are equal and no circle can close
        best = half.select("x.v", F.struct("w", "ou", "ov", "x.p").alias("e")).groupBy("v").agg(F.min("e").alias("e"))
        best = work.save(best.select("v", "e.p", "e.ou", "e.ov"), f"best-{i}")
        vertices = best.count()
        if not vertices:
            break
        sizes.append(vertices)
        trees.append(best.select(F.col("ou").alias("u"), F.col("ov").alias("v")))
        # two components that take the same edge point at each other; the smaller one becomes the root
        up = best.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hot = _hot(best, "p", vertices)
        own = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
        parents = work.save(hot_cold_join(best.select("v", "p"), up, "p", hot).select("v", F.when(own, F.col("v")).otherwise(F.col("p")).alias("p")), f"up-{i}-0")
        for j in range(1, most_rounds):
            new = work.save(_jump(parents, vertices), f"up-{i}-{j}")
            # at the end every parent is its own parent: as many parents as roots
            n = new.agg(F.count_distinct("p"), F.count_if(F.col("v") == F.col("p"))).first()
            work.drop(f"up-{i}-{j - 1}")
            parents = new
            if n[0] == n[1]:
                break
        else:
            raise RuntimeError("the parents don't come to an end")
        maps.append(parents)
        to, rows = live, live.count()
        for c in ("u", "v"):
            hot = _hot(live, c, rows)
            to = hot_cold_join(to, parents.select(F.col("v").alias(c), F.col("p").alias(f"{c}_to")), c, hot)
        to = to.filter("u_to <> v_to").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"), "w", "ou", "ov")
        to = to.groupBy("u", "v").agg(F.min(F.struct("w", "ou", "ov")).alias("e")).select("u", "v", "e.w", "e.ou", "e.ov")
        live = work.save(to, f"edges-{i + 1}")
        work.drop(f"edges-{i}")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    forest = trees[0].distinct() if trees else live.select("u", "v")
    for t in trees[1:]:
        forest = forest.unionByName(t.distinct())
    forest = work.save(forest, "forest")
    work.drop(*[f"best-{i}" for i in range(len(trees))])
    if not maps:
        return live.select("v", F.col("u").alias("root")), forest
    roots = maps[-1].select("v", F.col("p").alias("root"))
    for i in range(len(maps) - 2, -1, -1):
        m = maps[i].select("v", F.col("p").alias("at"))
        hot = _hot(m, "at", sizes[i])
        roots = hot_cold_join(m, roots.select(F.col("v").alias("at"), "root"), "at", hot, "left").select("v", F.coalesce("root", "at").alias("root"))
    return work.save(roots, "roots"), forest


def record_groups(train: DataFrame, work: Workspace) -> DataFrame:
    """(id, group_qid) of every record with a question id; group_qid is the smallest question id of the record's group.

    A record with one question id, or twice the same, stands in the group of that id. Records without any have no group here.
    """
    rows = train.filter(F.col("id").isNotNull()).select("id", "qid1", "qid2")
    roots, _ = boruvka(rows, "qid1", "qid2", work)
    least = roots.groupBy("root").agg(F.min("v").alias("grp"), F.count(F.lit(1)).alias("load"))
    least = work.save(least, "least")
    groups = hot_cold_join(roots, least.select("root", "grp"), "root", hot_keys(least, "root")).select(F.col("v").alias("q"), "grp")
    groups = work.save(groups, "groups")
    own = work.save(rows.select("id", F.coalesce("qid1", "qid2").alias("q")).filter("q is not null").distinct(), "own")
    hot = hot_keys(own.groupBy("q").agg(F.count(F.lit(1)).alias("load")), "q")
    return work.save(hot_cold_join(own, groups, "q", hot, "left").select("id", F.coalesce("grp", "q").alias("group_qid")), "record_groups")


def found_groups(train: DataFrame, work: Workspace) -> DataFrame:
    """The records of groups of at least two records."""
    rec = record_groups(train, work)
    sizes = work.save(rec.groupBy("group_qid").agg(F.count_distinct("id").alias("load")), "sizes")
    return hot_cold_join(rec, sizes.filter("load > 1").select("group_qid"), "group_qid", hot_keys(sizes, "group_qid")).select("id", "group_qid")


def found_ties(train: DataFrame, work: Workspace) -> DataFrame:
    """(group_qid, qid) of every question id tied to a smaller one by pairs with is_duplicate = 1."""
    tied = hash_to_min(train.filter("is_duplicate = 1").select("qid1", "qid2"), "qid1", "qid2", work)
    return tied.filter("member <> grp").select(F.col("grp").alias("group_qid"), F.col("member").alias("qid"))


#: A group above this share of all records is dealt by itself; there are at most 1 / LARGE such groups.
LARGE = 0.001


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], seed: int = 7) -> DataFrame:
    """(grp, split) for ``groups`` (grp, n): whole groups, in the proportions of ``targets`` as far as whole groups allow.

    Large groups (at most 1 / LARGE by definition) go, largest first, to the split that lacks most. The others lie in bands
    of size (powers of two) and, within a band, in cells of the hash of the root; a cell's groups, in hash order, are dealt
    systematically: its records are a line that is cut in the shares the large ones left, and a group goes where its middle lies.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("n")).first()[0] or 0
    lack = {s: share * total for s, share in targets}
    taken = []
    if lack:
        for g, n in sorted(((r.grp, r.n) for r in groups.filter(F.col("n") > LARGE * total).collect()), key=lambda x: (-x[1], x[0])):
            s = max(lack, key=lambda k: (lack[k], k))
            lack[s] -= n
            taken.append((g, s))
    rest = {s: max(0.0, x) for s, x in lack.items()}
    whole = sum(rest.values()) or 1.0
    marks, upto = [], 0.0
    for s, x in rest.items():
        if x:
            upto += x / whole
            marks.append((s, upto))
    kind = groups.schema["grp"].dataType.simpleString()
    large = spark.createDataFrame(taken, f"grp {kind}, split string")
    small = groups.filter(F.col("n") <= LARGE * total).withColumns({"band": F.floor(F.log2("n")), "h": F.xxhash64("grp", F.lit(seed))})
    bands = {r.band: r.load for r in small.groupBy("band").agg(F.sum("n").alias("load")).collect()}  # at most 63 rows
    per_cell = 100_000
    cells = F.coalesce(*[F.when(F.col("band") == b, max(1, n // per_cell)) for b, n in bands.items()], F.lit(1))
    small = small.withColumn("cell", F.pmod(F.shiftright("h", 32), cells))
    w = Window.partitionBy("band", "cell").orderBy("h", "grp")
    small = small.withColumn("mid", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2)
    small = small.withColumn("sum_", F.sum("n").over(Window.partitionBy("band", "cell")))
    # systematic with a random start: a cell's span of records, begun at a point that its hash draws, is cut at the marks
    start = F.pmod(F.xxhash64("band", "cell", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    at = F.pmod(F.col("mid") / F.col("sum_") + start, F.lit(1.0))
    split = F.coalesce(*[F.when(at < m, s) for s, m in marks[:-1]], F.lit(marks[-1][0])) if marks else F.lit(None).cast("string")
    return small.select("grp", split.alias("split")).unionByName(large)


def split_records(train: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """(id, split) for every record; a record without question ids is a group of its own."""
    rec = record_groups(train, work).select("id", F.concat(F.lit("q"), "group_qid").alias("grp"))
    lone = train.filter("id is not null and qid1 is null and qid2 is null").select("id", F.concat(F.lit("r"), "id").alias("grp")).distinct()
    rec = work.save(rec.unionByName(lone), "all_groups")
    sizes = work.save(rec.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "all_sizes")
    shares = [(r.split, r.target_share) for r in targets.filter("split is not null and target_share > 0").orderBy("split").collect()]  # one row per split
    dealt = work.save(assign_splits(sizes, shares), "dealt")
    return hot_cold_join(rec, dealt, "grp", hot_keys(sizes, "grp", "n")).select("id", "grp", "split")
