"""Statistics of a collection of texts, and features that weigh tokens by them.

Token tables are long: one row per (row, token). Sums over them are aggregations with a map-side part; a weight is looked up by a
join on the token in which frequent tokens are salted. No vocabulary is collected but for :func:`top_grams`, whose size is its parameter.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import gram_codes
from ..functions.text import one_blank, tokens
from ..plans.work import Workspace
from .rows import numbered
from .skew import salted_join


def both_texts(pairs: DataFrame, *others: DataFrame) -> DataFrame:
    """(text): question1 and question2 of every row of all tables, one below the other; nulls left out."""
    one = lambda df: df.select(F.explode(F.array("question1", "question2")).alias("text"))
    out = one(pairs)
    for df in others:
        out = out.unionByName(one(df))
    return out.filter("text is not null")


def token_table(df: DataFrame, keys: list[str], array: Column) -> DataFrame:
    """(keys, token, cnt): how often each token stands in each row's array."""
    return df.select(*keys, F.explode(array).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("cnt"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, lower case, split at white space."""
    return texts.select(F.explode(tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def inverse_weights(counts: DataFrame, eps: float = 10000.0, least: int = 2) -> DataFrame:
    """(word, n, weight): 1 / (n + eps), 0 below ``least`` occurrences."""
    return counts.withColumn("weight", F.when(F.col("n") < least, 0.0).otherwise(1 / (F.col("n") + F.lit(eps))))


def document_frequency(long: DataFrame, keys: list[str]) -> DataFrame:
    """(token, df, n_docs) of a token table with the document keys ``keys``."""
    n = long.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    return long.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # n is one row


def idf_log2(df: Column, n: Column) -> Column:
    """log2(n / df)."""
    return F.log2(n / df)


def idf_smooth(df: Column, n: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.ln((1 + n) / (1 + df)) + 1


def pair_tokens(pairs: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """(key, token, c1, c2): counts of each token on both sides of each pair."""
    side = F.explode(F.concat(F.transform(left, lambda t: F.struct(t.alias("token"), F.lit(1).alias("s"))), F.transform(right, lambda t: F.struct(t.alias("token"), F.lit(2).alias("s"))))).alias("x")
    return pairs.select(key, side).groupBy(key, F.col("x.token").alias("token")).agg(F.count_if(F.col("x.s") == 1).alias("c1"), F.count_if(F.col("x.s") == 2).alias("c2"))


def weighted_pairs(long: DataFrame, key: str, idf) -> DataFrame:
    """``long`` of :func:`pair_tokens` with the token's ``idf``; each side of a pair is a document."""
    docs = long.agg(F.lit(0).alias("_"), F.count_distinct(F.when(F.col("c1") > 0, F.col(key))).alias("d1"), F.count_distinct(F.when(F.col("c2") > 0, F.col(key))).alias("d2"))
    n = docs.select((F.col("d1") + F.col("d2")).alias("n"))
    df = long.groupBy("token").agg(F.sum((F.col("c1") > 0).cast("int") + (F.col("c2") > 0).cast("int")).alias("df"))
    df = df.crossJoin(F.broadcast(n)).select("token", "df", idf(F.col("df"), F.col("n")).alias("idf"))  # n is one row
    return salted_join(long, df, "token", "df")


#: Grams whose weights go to all tasks at most, the most frequent ones; all others meet their weights in a join.
MOST_GRAMS = 1_000_000
#: Characters of a batch that are taken apart at once.
AT_ONCE = 2_000_000
_SUMS = ["xx", "yy", "xy", "x1", "y1", "cc", "dd", "cd"]


def _gram_pairs(batch: pa.RecordBatch, n: int):
    """Pieces of ``batch`` with their grams: (piece, codes, row, place in codes, c1, c2), in the order of the rows."""
    size = np.cumsum(sum(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_a", "_b")))
    cuts = [0, *(np.flatnonzero(np.diff(size // AT_ONCE)) + 1), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        piece = batch.slice(i, j - i)
        (r1, g1), (r2, g2) = (gram_codes(piece.column(c), n) for c in ("_a", "_b"))
        codes, at = np.unique(np.concatenate([g1, g2]), return_inverse=True)
        if len(codes):
            both, where = np.unique(np.concatenate([r1, r2]) * len(codes) + at, return_inverse=True)
            c1, c2 = (np.bincount(w, minlength=len(both)) for w in (where[: len(r1)], where[len(r1) :]))
            yield piece, codes, both // len(codes), both % len(codes), c1, c2


def tfidf_distances(pairs: DataFrame, key: str, left: Column, right: Column, n: int, idf, work: Workspace) -> DataFrame:
    """Per pair of texts with grams of ``n`` characters (1 to 3): cosine distance (0 where a side is empty), Euclidean distances of the
    sides' vectors with L2-scaled tf-idf, L1-scaled tf-idf and L2-scaled tf. Each side of a pair is a document.

    Grams are counted where the pair lies and don't go through a shuffle: a first scan adds up their document frequencies, a second one
    the products of the two sides, of which the distances are made.
    """
    if not 1 <= n <= 3:
        raise ValueError("a code holds 1 to 3 characters")
    kind = pairs.schema[key].dataType.simpleString()
    texts = work.save(pairs.select(F.monotonically_increasing_id().alias("_row"), key, left.alias("_a"), right.alias("_b")), "texts")

    def tally(batches):
        # grams of a piece are added up before they are sent; the code -1 counts the documents
        for batch in batches:
            for _, codes, row, at, c1, c2 in _gram_pairs(batch, n):
                docs = sum(len(np.unique(row[c > 0])) for c in (c1, c2))
                df = np.bincount(at, (c1 > 0).astype(int) + (c2 > 0)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, -1)), pa.array(np.append(df, docs))], ["gram", "df"])

    df = work.save(texts.select("_a", "_b").mapInArrow(tally, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")), "df")
    docs = df.filter("gram < 0").select("df").first()
    weights = df.filter("gram >= 0").select("gram", "df", idf(F.col("df"), F.lit(docs.df if docs else 0)).cast("double").alias("idf"))
    whole = weights.count() <= MOST_GRAMS
    top = (weights if whole else weights.orderBy(F.desc("df"), "gram").limit(MOST_GRAMS)).select("gram", "idf").toArrow()
    order = np.argsort(top["gram"].to_numpy())
    sent = pairs.sparkSession.sparkContext.broadcast((top["gram"].to_numpy()[order], top["idf"].to_numpy()[order]))

    def add_up(batches):
        known, idfs = sent.value
        for batch in batches:
            for piece, codes, row, at, c1, c2 in _gram_pairs(batch, n):
                place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[place] == codes
                w, here = np.where(hit, idfs[place], 0.0)[at], hit[at]
                x, y, c, d = c1 * w, c2 * w, (c1 * here).astype(float), (c2 * here).astype(float)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                sums = [pa.array(np.add.reduceat(v, first)) for v in (x * x, y * y, x * y, x, y, c * c, d * d, c * d)]
                ends = np.append(0, np.cumsum(np.add.reduceat((~here).astype(np.int32), first)))
                rest = pa.StructArray.from_arrays([pa.array(v[~here]) for v in (codes[at], c1, c2)], ["gram", "c1", "c2"])
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
                own = [piece.column(c).take(pa.array(row[first])) for c in ("_row", key)]
                yield pa.RecordBatch.from_arrays([*own, *sums, rest], ["_row", key, *_SUMS, "rest"])

    out = texts.mapInArrow(add_up, f"_row long, `{key}` {kind}, {', '.join(f'{s} double' for s in _SUMS)}, rest array<struct<gram: long, c1: long, c2: long>>")
    if not whole:
        out = work.save(out, "sums")
        rare = out.select("_row", F.inline("rest")).join(weights.select("gram", "idf"), "gram")
        x, y, c, d = F.col("c1") * F.col("idf"), F.col("c2") * F.col("idf"), F.col("c1"), F.col("c2")
        more = rare.groupBy("_row").agg(*[F.sum(v).alias(f"_{s}") for s, v in zip(_SUMS, (x * x, y * y, x * y, x, y, c * c, d * d, c * d))])
        out = out.join(more, "_row", "left").select(key, *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0.0))).alias(s) for s in _SUMS])
    part = lambda v, s: F.coalesce(F.try_divide(v, s), F.lit(0.0))
    # the square of a / s - b / r is aa / ss - 2 ab / sr + bb / rr
    d = lambda a, b, ab, s, r: F.sqrt(F.greatest(F.lit(0.0), part(F.col(a), s * s) + part(F.col(b), r * r) - 2 * part(F.col(ab), s * r)))
    cos = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return out.select(
        key,
        (1 - F.coalesce(cos, F.lit(1.0))).alias("cosine_distance"),
        d("xx", "yy", "xy", F.sqrt("xx"), F.sqrt("yy")).alias("l2_tfidf"),
        d("xx", "yy", "xy", F.col("x1"), F.col("y1")).alias("l1_tfidf"),
        d("cc", "dd", "cd", F.sqrt("cc"), F.sqrt("dd")).alias("l2_tf"),
    )


def tfidf_row_stats(long: DataFrame, key: str) -> DataFrame:
    """Sum, mean and number of the non-zero weights of each side's L2-scaled tf-idf vector."""
    x, y = F.col("c1") * F.col("idf"), F.col("c2") * F.col("idf")
    norm = lambda v: F.sqrt(F.sum(v * v))
    out = []
    for i, v in ((1, x), (2, y)):
        n = F.count_if(v > 0)
        s = F.coalesce(F.try_divide(F.sum(v), norm(v)), F.lit(0.0))
        out += [s.alias(f"sum{i}"), F.coalesce(F.try_divide(s, n), F.lit(0.0)).alias(f"mean{i}"), n.alias(f"len{i}")]
    return long.groupBy(key).agg(*out)


def weight_share(long: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, share): weight of the tokens on both sides over the weight of all tokens, repeats counted; 0 if nothing is shared."""
    t = salted_join(long, weights.select(F.col("word").alias("token"), "n", "weight"), "token", "n", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    each = F.col("weight") * (F.col("c1") + F.col("c2"))
    shared = F.sum(F.when((F.col("c1") > 0) & (F.col("c2") > 0), each).otherwise(0.0))
    return t.groupBy(key).agg(F.coalesce(F.try_divide(shared, F.sum(each)), F.lit(0.0)).alias("share"))


def weighted_overlap(long: DataFrame, key: str, weights: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(key, overlap): sum of 2 e^w over pairs of equal tokens, over the sum of e^w of all tokens + eps; known tokens only."""
    t = salted_join(long, weights.select(F.col("word").alias("token"), "n", F.exp("weight").alias("e")), "token", "n")
    return t.groupBy(key).agg((F.sum(2 * F.col("e") * F.col("c1") * F.col("c2")) / (F.sum(F.col("e") * (F.col("c1") + F.col("c2"))) + eps)).alias("overlap"))


def top_grams(texts: DataFrame, sizes: tuple[int, ...], most: int, least_df: int, share: float) -> list[str]:
    """The ``most`` frequent character grams in at least ``least_df`` and at most ``share`` of the distinct texts; ties by gram.

    Texts are in lower case, with runs of blanks as one.
    """
    docs = texts.select(one_blank(F.lower("text")).alias("text")).distinct()

    def tally(batches):
        # grams of a batch are added up before they are sent; the marker row counts the texts
        for batch in batches:
            n, df = Counter(), Counter()
            for t in batch.column("text").to_pylist():
                own = Counter(t[i : i + k] for k in sizes for i in range(len(t) - k + 1)) if t else Counter()
                n.update(own)
                df.update(own.keys())
            cols = ([*n, None], [*n.values(), 0], [*(df[g] for g in n), batch.num_rows])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["gram", "n", "df"])

    grams = docs.mapInArrow(tally, "gram string, n long, df long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).persist()
    whole = grams.filter("gram is null").select("df").first()
    kept = grams.filter("gram is not null").filter((F.col("df") >= least_df) & (F.col("df") <= share * (whole.df if whole else 0))).orderBy(F.desc("n"), "gram").limit(most)
    out = [r.gram for r in kept.collect()]
    grams.unpersist()
    return out


def padded_sequences(df: DataFrame, key: str, array: str, vocabulary: list[str], length: int, most: int) -> DataFrame:
    """(key, seq): ranks of a row's tokens, the last ``length`` of them, filled with 0 in front.

    Ranks go from 1 by falling count in the arrays ``vocabulary``, ties by token; tokens from rank ``most`` on are left out.
    """
    all_ = df.select(F.explode(F.concat(*vocabulary)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rank = numbered(all_.withColumn("_k", -F.col("n")), ["_k", "token"], "k").select("token", "n", (F.col("k") + 1).alias("k")).filter(F.col("k") < most - 1)
    long = salted_join(df.select(key, F.posexplode(array).alias("pos", "token")), rank, "token", "n")
    seq = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("x"))  # the tokens of one text
    ids = F.coalesce(F.transform("x", lambda s: s["k"]), F.array().cast("array<bigint>"))
    out = df.select(key).join(seq, key, "left").select(key, ids.alias("ids"))
    fill = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), length - F.size("ids")))
    return out.select(key, F.concat(fill, F.when(F.size("ids") > length, F.slice("ids", -length, length)).otherwise(F.col("ids"))).alias("seq"))
