"""Word vectors: sentence vectors, relaxed word-mover distances and nearest words.

``vectors`` has (word, vec). A word table of at most :data:`SMALL` bytes is sent to all tasks, which is checked, and rows are worked on where
they lie; with a larger one tokens meet their vectors by a join, and the sums of a row are aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .skew import EASY, HOT_SHARE, salted_join

#: Bytes of a table of vectors that may be sent to all tasks.
SMALL = 64_000_000
#: Bytes of vectors on which the centres of an index are fitted, at most; every row is indexed.
SAMPLE = 64_000_000


def unique_words(vectors: DataFrame) -> DataFrame:
    """One row per word in lower case: the vector of the spelling that sorts first."""
    return vectors.filter("word is not null and vec is not null").groupBy(F.lower("word").alias("word")).agg(F.min_by("vec", "word").alias("vec"))


def _is_small(vectors: DataFrame, dims: int) -> bool:
    most = SMALL // (8 * dims)
    return vectors.limit(most + 1).count() <= most


def _matrix(words: DataFrame, dims: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Place of each word, vectors, weights (column w, else 1) of a small table."""
    table = words.filter("word is not null and vec is not null").toArrow()
    at = {w: i for i, w in enumerate(table["word"].to_pylist())}
    matrix = pc.cast(pc.list_flatten(table["vec"]), pa.float64()).to_numpy().reshape(len(at), dims)
    return at, matrix, table["w"].to_numpy() if "w" in table.column_names else np.ones(len(at))


def add_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sentence_vectors(rows: DataFrame, keys: list[str], array: Column, words: DataFrame, dims: int, weight: DataFrame | None = None, missing: float = 0.0) -> DataFrame:
    """(keys, vec): the mean of the vectors of a row's known tokens, repeats counted; weighted by ``weight`` (token, w) if given.

    All components of a row without known tokens are ``missing``: 0, or NaN as where a sum is divided by no tokens unguarded. A small
    table is sent to all tasks, which take the means where the rows lie; a larger one is joined and the mean is
    taken component by component.
    """
    if weight is not None:
        words = words.join(weight.select(F.col("token").alias("word"), "w"), "word")
    if _is_small(words, dims):
        return _means_small(rows, keys, array, words, dims, missing)
    long = rows.select(*keys, F.explode(array).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).cast("double").alias("w"))
    own = F.col("_w") if weight is not None else F.lit(1.0)
    table = words.select(F.col("word").alias("token"), "vec", *([F.col("w").alias("_w")] if weight is not None else []))
    loads = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = salted_join(long, table.join(loads, "token"), "token", "n").withColumn("w", F.col("w") * own)
    comps = [(F.sum(F.col("w") * F.get("vec", F.lit(i))) / F.nullif(F.sum("w"), F.lit(0.0))).alias(f"_{i}") for i in range(dims)]
    mean = known.groupBy(*keys).agg(*comps).select(*keys, F.array(*[F.coalesce(f"_{i}", F.lit(missing)) for i in range(dims)]).alias("vec"))
    return rows.select(*keys).distinct().join(mean, keys, "left").select(*keys, F.coalesce("vec", F.array_repeat(F.lit(missing), dims)).alias("vec"))


def _means_small(rows: DataFrame, keys: list[str], array: Column, words: DataFrame, dims: int, missing: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_matrix(words, dims))

    def run(batches):
        at, matrix, weights = shared.value
        for b in batches:
            out = np.full((b.num_rows, dims), missing)
            for i, ts in enumerate(b.column("_tokens").to_pylist()):
                known = [at[t] for t in ts or () if t in at]
                if known:
                    w = weights[known]
                    total = w.sum()
                    if total:
                        out[i] = w @ matrix[known] / total
            ends = pa.array(np.arange(0, (b.num_rows + 1) * dims, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*keys, "vec"])

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "vec array<double>"])
    return rows.select(*keys, array.alias("_tokens")).mapInArrow(run, schema)


def relaxed_distance(pairs: DataFrame, key: str, a: Column, b: Column, words: DataFrame, dims: int, restart: bool = False, weight: DataFrame | None = None) -> DataFrame:
    """(key, distance): for each token of one side the least distance to a token of the other; the mean of these, both directions added.

    With ``weight`` (word, w) the least distances are not averaged but summed, each times its token's weight (0 for a word without one).
    Only known words count. A side without known tokens gives 0. With ``restart`` a running minimum of 0 is overwritten by
    the next distance in the order of the other side, as formulas that take 0 for 'none yet' do.
    """
    if weight is not None:
        words = words.join(weight.select("word", "w"), "word", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    if _is_small(words, dims):
        return _relaxed_small(pairs, key, a, b, words, dims, restart, weight is not None)
    w = words.select("word")
    side = lambda c, n: pairs.select(key, F.posexplode(c).alias(n, "word"))

    def known(n: str, c: Column) -> DataFrame:
        s = side(c, n)
        return salted_join(s, w.join(s.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "word"), "word", "_n").withColumnRenamed("word", f"w{n}")

    both = known("i", a).join(known("j", b), key)
    # the distance of two words is computed once, however many pairs of texts have them
    apart = both.groupBy(F.struct("wi", "wj").alias("two")).agg(F.count(F.lit(1)).alias("_n"))
    for n in ("i", "j"):
        apart = apart.join(words.select(F.col("word").alias("_w"), F.col("vec").alias(f"v{n}")), F.col(f"two.w{n}") == F.col("_w")).drop("_w")
    apart = apart.select("two", "_n", V.euclidean(F.col("vi"), F.col("vj")).alias("d"))
    d = salted_join(both.select(key, "i", "j", F.struct("wi", "wj").alias("two")), apart, "two", "_n")
    d = d.select(key, "i", "j", F.col("two.wi").alias("wi"), F.col("two.wj").alias("wj"), "d")

    def least(own: str, other: str) -> DataFrame:
        if restart:
            ordered = F.transform(F.array_sort(F.collect_list(F.struct(other, "d"))), lambda s: s["d"])  # the tokens of one text
            m = F.aggregate(ordered, F.lit(0.0), lambda acc, v: F.when(acc == 0, v).otherwise(F.least(acc, v)))
        else:
            m = F.min("d")
        each = d.groupBy(key, own, F.col(f"w{own}").alias("word")).agg(m.alias("m"))
        if weight is None:
            return each.groupBy(key).agg(F.avg("m").alias("s"))
        loads = each.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
        return salted_join(each, words.select("word", "w").join(loads, "word"), "word", "_n").groupBy(key).agg(F.sum(F.col("m") * F.col("w")).alias("s"))

    total = least("i", "j").unionByName(least("j", "i")).groupBy(key).agg(F.sum("s").alias("distance"))
    return pairs.select(key).join(total, key, "left").select(key, F.coalesce("distance", F.lit(0.0)).alias("distance"))


#: Words up to which all their distances are computed at once.
TABLE = 2000


def _relaxed_small(pairs: DataFrame, key: str, a: Column, b: Column, words: DataFrame, dims: int, restart: bool, weighted: bool) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(_matrix(words, dims))

    def run(batches):
        at, matrix, weights = shared.value
        between = lambda x, y: np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        table = np.concatenate([between(matrix[i : i + 16], matrix) for i in range(0, len(at), 16)]) if 0 < len(at) <= TABLE else None

        def least(d: np.ndarray) -> np.ndarray:
            if not restart:
                return d.min(axis=1)
            m = np.zeros(len(d))
            for col in d.T:
                m = np.where(m == 0, col, np.minimum(m, col))
            return m

        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch["_a"].to_pylist(), batch["_b"].to_pylist())):
                p, q = [at[t] for t in x or () if t in at], [at[t] for t in y or () if t in at]
                if p and q:
                    d = table[np.ix_(p, q)] if table is not None else between(matrix[p], matrix[q])
                    m, n = least(d), least(d.T)
                    out[i] = weights[p] @ m + weights[q] @ n if weighted else m.mean() + n.mean()
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(out)], [key, "distance"])

    return pairs.select(key, a.alias("_a"), b.alias("_b")).mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, distance double")


def nearest(queries: DataFrame, index: DataFrame, k: int, dims: int) -> DataFrame:
    """(query, item, rank, score): the ``k`` items with the highest cosine of each query, ties by item; the item itself is left out.

    ``queries`` (query, vec) is the stated query set against all rows of ``index`` (item, vec). A small set is sent to all
    tasks, which multiply it with their batches and keep the k best of each; a larger one is joined block by block, with as many blocks
    of the index as there are shuffle partitions. Zero vectors have no cosine.
    """
    if _is_small(queries, dims):
        best = _nearest_small(queries, index, k)
    else:
        unit = lambda df: df.withColumn("n", V.norm(F.col("vec"))).filter("n > 0").withColumn("vec", F.transform("vec", lambda x: x / F.col("n"))).drop("n")
        blocks = max(8, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        x = unit(index).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        q = unit(queries).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        best = x.join(q.withColumnRenamed("vec", "qv"), "block").filter("query <> item")
        best = best.select("query", "item", "block", V.dot(F.col("vec"), F.col("qv")).alias("score"))
        best = _best(best, k, "block").drop("rank", "block")
    return _best(best, k).select("query", "item", "rank", "score")


def fit_lists(index: DataFrame, dims: int, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit vectors of ``lists`` centres, fitted by k-means on :data:`SAMPLE` bytes of rows at most, the first by the hash of their item."""
    rows = index.filter("vec is not null").orderBy(F.xxhash64("item")).limit(SAMPLE // (8 * dims)).select("vec").toArrow()
    x = pc.cast(pc.list_flatten(rows["vec"]), pa.float64()).to_numpy().reshape(-1, dims)
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0, None]
    centres = x[:: max(1, len(x) // lists)][:lists]
    for _ in range(rounds if len(x) else 0):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _in_lists(df: DataFrame, ident: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(ident, vec, list): unit vectors, each in the ``probes`` lists whose centres are nearest. Zero vectors are in none."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for b in batches:
            if not b.num_rows or not len(c):
                continue
            x = pc.cast(pc.list_flatten(b["vec"]), pa.float64()).to_numpy().reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            keep = np.flatnonzero(n > 0)
            x = x[keep] / n[keep, None]
            near = np.argpartition(-(x @ c.T), min(probes, len(c)) - 1, axis=1)[:, :probes]
            at = np.repeat(np.arange(len(keep)), near.shape[1])
            ends = pa.array(np.arange(0, (len(at) + 1) * x.shape[1], x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b[ident].take(pa.array(keep[at])), pa.ListArray.from_arrays(ends, pa.array(x[at].ravel())), pa.array(near.ravel(), pa.int32())], [ident, "vec", "list"])

    return df.filter("vec is not null").select(ident, "vec").mapInArrow(run, f"{ident} {df.schema[ident].dataType.simpleString()}, vec array<double>, list int")


def nearest_by_lists(queries: DataFrame, index: DataFrame, k: int, dims: int, lists: int = 256, probes: int = 48) -> DataFrame:
    """:func:`nearest` through an inverted index: every row lies in the list of its nearest centre, a query looks into ``probes`` lists.

    Work is about probes / lists of the whole product; what it misses depends on the data, so measure it against :func:`nearest`
    on a part of the queries. A list with very many rows is cut into salts, to which its queries are repeated.
    """
    centres = fit_lists(index, dims, lists)
    x = _in_lists(index, "item", centres, 1)
    sizes = x.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    cuts = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all"))))  # one row
    cuts = F.broadcast(cuts.select("list", F.ceil(F.col("n") / F.greatest(F.lit(EASY), F.lit(HOT_SHARE) * F.col("all"))).cast("int").alias("cuts")))  # a row a list
    x = x.join(cuts, "list").withColumn("salt", F.pmod(F.xxhash64("item"), F.col("cuts")).cast("int")).drop("cuts")
    q = _in_lists(queries, "query", centres, probes).join(cuts, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    both = x.join(q.withColumnRenamed("vec", "qv"), ["list", "salt"]).filter("query <> item")
    best = _best(both.select("query", "item", "list", "salt", V.dot(F.col("vec"), F.col("qv")).alias("score")), k, "list", "salt").drop("rank", "list", "salt")
    return _best(best, k).select("query", "item", "rank", "score")


def _best(df: DataFrame, k: int, *part: str) -> DataFrame:
    w = Window.partitionBy("query", *part).orderBy(F.desc(F.round("score", 9)), "item")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest_small(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    rows = queries.filter("vec is not null").select("query", F.transform("vec", lambda x: x.cast("double")).alias("vec")).collect()  # at most SMALL bytes of vectors
    names = [r.query for r in rows]
    m = np.array([r.vec for r in rows]) if rows else np.zeros((0, 1))
    norms = np.linalg.norm(m, axis=1)
    shared = queries.sparkSession.sparkContext.broadcast(([n for n, x in zip(names, norms) if x > 0], m[norms > 0] / norms[norms > 0, None]))
    kind = index.schema["item"].dataType.simpleString()

    def run(batches):
        ids, q = shared.value
        for b in batches:
            items = b.column("item").to_pylist()
            if not items or not ids:
                continue
            x = np.array(b.column("vec").to_pylist(), dtype=float)
            n = np.linalg.norm(x, axis=1)
            keep = n > 0
            items = [i for i, ok in zip(items, keep) if ok]
            x = x[keep] / n[keep, None]
            out = ([], [], [])
            for lo in range(0, len(ids), 1000):
                score = q[lo : lo + 1000] @ x.T
                # ties with the k-th best (and the item itself) stay in, so that the order by item is settled later
                cut = -np.partition(-score, min(k, score.shape[1] - 1), axis=1)[:, min(k, score.shape[1] - 1)] - 1e-9
                for i, j in zip(*np.nonzero(score >= cut[:, None])):
                    if ids[lo + i] != items[j]:
                        out[0].append(ids[lo + i])
                        out[1].append(items[j])
                        out[2].append(float(score[i, j]))
            t = b.schema.field("item").type
            yield pa.RecordBatch.from_arrays([pa.array(out[0], t), pa.array(out[1], t), pa.array(out[2], pa.float64())], ["query", "item", "score"])

    return index.filter("vec is not null").select("item", "vec").mapInArrow(run, f"query {kind}, item {kind}, score double")


def embedding_matrix(vocabulary: DataFrame, words: DataFrame, dims: int) -> DataFrame:
    """``vocabulary`` (word, k) with the word's vector, zeros for an unknown word."""
    return vocabulary.join(words.select("word", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "word", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)))


def expand(rows: DataFrame, key: str, array: Column, synonyms: DataFrame) -> DataFrame:
    """(key, tokens): each token replaced by its synonyms (word, syns) in order, unknown ones kept."""
    said = rows.select(key, F.posexplode(array).alias("pos", "word"))
    long = salted_join(said, synonyms.join(said.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "word"), "word", "_n", "left")
    each = F.coalesce("syns", F.array("word"))
    back = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", each.alias("s")))).alias("x"))  # the tokens of one text
    return rows.select(key).join(back, key, "left").select(key, F.coalesce(F.flatten(F.transform("x", lambda s: s["s"])), F.array().cast("array<string>")).alias("tokens"))
