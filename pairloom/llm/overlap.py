"""Same or near-same records across splits, by a suffix array over the texts of both splits.

An array has one entry for each suffix that a match can begin with: its first words (the words themselves, no hash), the split, the
text and the place where it begins. Entries are partitioned by these words, prefixes with very many entries are cut into cells, each
partition is sorted, and one scan compares every entry with its neighbour (:func:`scan`). Neighbours with the same first words form a
common-prefix interval; an interval with entries of both splits is a shared span. Spans are merged into coverage per record.

* :func:`near_pairs` - words in any order. A text is its words sorted from rare to common, and its suffixes may leave words out
  (:func:`gapped_suffixes`). Spans of two words name candidates; their texts are compared word by word into the coverage of both
  records, which decides.
* :func:`covered_words` - words in the order of the text. Every suffix of at least five words is an entry; longer spans show at
  further starts, so no span is cut.

Texts equal word for word are one text in the arrays, however often they occur; copies are put back by their key.
A null or empty text has no words and no suffixes; nothing is cut from long ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words
from ..plans.work import Workspace
from ..sources.tables import one_per_id

#: How many words a text may have that the other lacks, and how many words two suffixes of :func:`near_pairs` must have in common.
MISSING, DEPTH = 2, 2
#: Words whose frequency the tasks know: the most frequent ones. All others are rarer, and taken for as frequent as the last of these.
KNOWN = 50_000
#: A prefix is cut into cells if a split has more entries of it than CELL and than one for each PART texts; at most PART * entries a text are.
CELL, PART = 50_000, 20_000
#: Pairs that a scan holds at a time.
HELD = 1_000_000


def bag(text: str) -> Column:
    """The words of a text, sorted, as one string; null below five words."""
    return let(lambda w: F.when(F.size(w) >= 5, F.array_join(F.array_sort(w), " ")), words(text))


# ---- the array


def known_words(texts: DataFrame, column: str = "text") -> tuple[dict[str, int], int]:
    """The KNOWN most frequent words with the number of texts that have them, and the number of texts."""
    n = texts.count()
    d = texts.select(F.explode(F.array_distinct(F.split(column, " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("d"))
    return {r.w: r.d for r in d.orderBy(F.desc("d"), "w").limit(KNOWN).collect()}, n


def gapped_suffixes(ws: list[str], known: dict[str, int], floor: int) -> Iterator[tuple[int, tuple[str, ...], int]]:
    """(start, first DEPTH words, in how many texts the rarest of them is at most) of the suffixes of a text's distinct words, rare before common.

    Up to MISSING words are left out before the DEPTH words are complete. If two texts lack at most MISSING words of each other, then no
    more than these stand before their first DEPTH common words, so one of their suffixes begins alike; suffixes that start later
    than the MISSING + 1st word can't be the first common one and are no entries. DEPTH fillers, equal for all texts, end
    each text, which makes this hold for texts with few distinct words too.
    """
    first = sorted((known.get(w, 0), w) for w in set(ws))[: DEPTH + MISSING]
    first += [(1 << 62, chr(i + 1)) for i in range(DEPTH)]
    first = first[: DEPTH + MISSING]
    for c in combinations(range(len(first)), DEPTH):
        yield c[0], tuple(first[i][1] for i in c), max(first[c[0]][0], floor)


def runs(ws: list[str], known: dict[str, int], floor: int, length: int) -> Iterator[tuple[int, tuple[str, ...], int]]:
    """(start, first ``length`` words, in how many texts the rarest of them is at most) of every suffix of at least ``length`` words."""
    freq = [max(known.get(w, 0), floor) for w in ws]
    for i in range(len(ws) - length + 1):
        yield i, tuple(ws[i : i + length]), min(freq[i : i + length])


def _entries(texts: DataFrame, known: dict[str, int], least: int, suffixes, digits: bool) -> DataFrame:
    """(prefix, side, key, start, n) of the suffixes of ``texts`` (side, key, text) whose rarest word may be in more than ``least`` texts."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        floor = min(freq.values(), default=0)
        for batch in batches:
            at, start, prefix, size = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                ws = text.split(" ")
                end = "\0" + " ".join(w for w in ws if w.isdecimal()) if digits else ""
                for s, head, d in suffixes(ws, freq, floor):
                    if d > least:
                        at.append(i)
                        start.append(s)
                        prefix.append(" ".join(head) + end)
                        size.append(len(ws))
            own = pa.array(at, pa.int32())
            cols = [pa.array(prefix, pa.string()), batch["side"].take(own), batch["key"].take(own), pa.array(start, pa.int32()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["prefix", "side", "key", "start", "n"])

    return texts.select("side", "key", "text").mapInArrow(run, "prefix string, side int, key long, start int, n int")


def suffix_array(texts: DataFrame, known: dict[str, int], n: int, suffixes, digits: bool = False) -> DataFrame:
    """The array of ``texts`` (side 0 or 1, key, text: words, blank between; ``n`` texts): partitions that are sorted by prefix, side and key.

    A prefix stands in no more texts than its rarest word, so only prefixes of words that are frequent enough are counted.
    A prefix with more than ``cell`` entries of a split gets a grid of cells: entries of side 0 lie in one row of it each and are repeated
    for its columns, entries of side 1 the other way round, so every two entries of the two sides meet in one cell.
    """
    cell = max(CELL, n // PART)
    loads = _entries(texts, known, cell, suffixes, digits).groupBy("prefix", "side").agg(F.count(F.lit(1)).alias("load")).filter(F.col("load") > cell)
    cuts = F.ceil(F.col("load") / F.lit(cell)).cast("int")
    grid = loads.groupBy("prefix").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, cuts)), F.lit(1)).alias(f"cuts{s}") for s in (0, 1)])
    # at most PART prefixes for each entry that a text has
    told = _entries(texts, known, -1, suffixes, digits).join(F.broadcast(grid), "prefix", "left")
    mine, other = F.when(F.col("side") == 0, F.col("cuts0")).otherwise(F.col("cuts1")), F.when(F.col("side") == 0, F.col("cuts1")).otherwise(F.col("cuts0"))
    own = F.pmod(F.xxhash64("key", "start"), mine).cast("int")
    place = lambda j: F.when(F.col("side") == 0, own * F.col("cuts1") + j).otherwise(j * F.col("cuts1") + own)
    cells = F.when(F.col("cuts0").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), other - 1), place))
    entries = told.select("prefix", F.explode(cells).alias("cell"), "side", "key", "start", "n")
    return entries.repartition("prefix", "cell").sortWithinPartitions("prefix", "cell", "side", "key")


def scan(array: DataFrame, pairs: bool) -> DataFrame:
    """Common-prefix intervals with entries of both sides.

    With ``pairs``, (left, right): keys of every two entries of such an interval whose texts differ by at most MISSING in
    length. Without, (key, start) of its entries of side 1.
    """
    if pairs:
        names, kinds = ["left", "right"], [pa.int64(), pa.int64()]
    else:
        names, kinds = ["key", "start"], [pa.int64(), pa.int32()]

    def spans(key: np.ndarray, last: np.ndarray, lefts: int) -> Iterator[list[np.ndarray]]:
        if not pairs:
            yield [key[lefts:], last[lefts:]]
            return
        step = max(1, HELD // (len(key) - lefts))
        for lo in range(0, lefts, step):
            hi = min(lefts, lo + step)
            a, b = np.nonzero(np.abs(last[lo:hi, None] - last[None, lefts:]) <= MISSING)
            yield [key[lo:hi][a], key[lefts:][b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        held, kept = 0, None  # the interval that the last batch left open

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out)] or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def intervals(whole: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held
            side, key, last = (whole[c].to_numpy() for c in ("side", "key", "n" if pairs else "start"))
            ends = np.append(at[1:], len(side))
            lefts = np.add.reduceat(side == 0, at, dtype=np.int64) if len(at) else np.array([], int)
            for s, e, left in zip(*(x[(lefts > 0) & (lefts < ends - at)] for x in (at, ends, lefts))):
                for found in spans(key[s:e], last[s:e], left):
                    out.append(found)
                    held += len(found[0])
                    if held >= HELD:
                        held = 0
                        yield flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0] if kept is not None else batch
            # does the entry before begin with the same words, in the same cell?
            fresh = pc.or_(pc.not_equal(whole["prefix"][1:], whole["prefix"][:-1]), pc.not_equal(whole["cell"][1:], whole["cell"][:-1]))
            at = np.append(0, np.flatnonzero(fresh.to_numpy(zero_copy_only=False)) + 1)
            kept = whole.slice(at[-1])
            done = whole.slice(0, at[-1])
            if done.num_rows:
                yield from intervals(done, at[:-1])
        if kept is not None:
            yield from intervals(kept, np.array([0]))
        yield flush()

    return array.mapInArrow(run, "left long, right long" if pairs else "key long, start int")


# ---- words in any order


def shared(a: list[str], b: list[str]) -> int:
    """Words, counted with repeats, that lie in the common spans of two sorted texts."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, n = i + 1, j + 1, n + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def _check(candidates: DataFrame) -> DataFrame:
    """The candidates (left_bag, right_bag) that are near-same, with the words of right that left covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, covered = [], []
            for i, (x, y) in enumerate(zip(batch["left_bag"].to_pylist(), batch["right_bag"].to_pylist())):
                a, b = sorted(x.split(" ")), sorted(y.split(" "))
                n = len(b) if x == y else shared(a, b)
                if len(a) - n <= MISSING and len(b) - n <= MISSING and [w for w in a if w.isdecimal()] == [w for w in b if w.isdecimal()]:
                    at.append(i)
                    covered.append(n)
            own = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["left_bag"].take(own), batch["right_bag"].take(own), pa.array(covered, pa.int32())], ["left_bag", "right_bag", "covered"])

    return candidates.mapInArrow(run, "left_bag string, right_bag string, covered int")


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_bag, right_bag, covered) of texts of two splits that are near-same; covered: words of right that left has.

    Both inputs have the distinct texts as ``bag`` (sorted words, blank between). The words made of digits must agree and end each
    prefix of the array. The spans of a pair, up to six, are merged into one; texts that share a key by chance are told apart by the check.
    """
    sides = {s: df.select(F.xxhash64("bag").alias("key"), F.col("bag").alias("text")) for s, df in enumerate((left, right))}
    texts = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1)))
    known, n = known_words(texts)
    spans = scan(suffix_array(texts, known, n, gapped_suffixes, digits=True), pairs=True).distinct()
    a = sides[0].select(F.col("key").alias("left"), F.col("text").alias("left_bag"))
    b = sides[1].select(F.col("key").alias("right"), F.col("text").alias("right_bag"))
    return _check(spans.join(a, "left").join(b, "right").select("left_bag", "right_bag"))


def found(train: DataFrame, test: DataFrame, work: Workspace) -> DataFrame:
    """(qid1, test_id, test_field) of every question of ``test`` that stands in ``train.question1``, or nearly so.

    Rows without qid1 or without test_id name no case. Extra columns are ignored.
    """
    # bags are computed within generators and tested after them, so that no filter computes them a second time
    t = train.filter(F.col("qid1").isNotNull()).select("qid1", F.explode(F.array(bag("question1"))).alias("bag")).filter("bag is not null").distinct()
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("test_field"), bag(f).alias("bag")) for f in ("question1", "question2")]))
    q = test.filter(F.col("test_id").isNotNull()).select("test_id", fields.alias("x")).select("test_id", "x.test_field", "x.bag").filter("bag is not null")
    t, q = work.save(t, "train_texts"), work.save(q, "test_texts")
    pairs = work.save(near_pairs(t.select("bag").distinct(), q.select("bag").distinct()), "pairs")
    a = t.join(pairs.withColumnRenamed("left_bag", "bag"), "bag").select("qid1", "right_bag")
    return a.distinct().join(q.withColumnRenamed("bag", "right_bag"), "right_bag").select("qid1", "test_id", "test_field").distinct()


# ---- words in the order of the text


def covered_words(texts: DataFrame, others: DataFrame, length: int = 5) -> DataFrame:
    """(key, covered) of the ``texts`` that share a span of at least ``length`` words with ``others``: words that lie in such spans.

    Both have key and text (words, blank between), distinct. Spans that overlap are merged.
    """
    both = others.select("key", "text", F.lit(0).alias("side")).unionByName(texts.select("key", "text", F.lit(1).alias("side")))
    known, n = known_words(both)
    starts = scan(suffix_array(both, known, n, lambda ws, freq, floor: runs(ws, freq, floor, length)), pairs=False)
    s = starts.distinct().groupBy("key").agg(F.array_sort(F.collect_list("start")).alias("s"))  # places within one text
    steps = F.zip_with(F.slice("s", 2, F.size("s")), "s", lambda nxt, at: F.least(F.coalesce(nxt - at, F.lit(length)), F.lit(length)))
    return s.select("key", F.aggregate(steps, F.lit(0), lambda acc, x: acc + x).cast("long").alias("covered"))


def report(train: DataFrame, test: DataFrame, work: Workspace, share: float = 0.8, length: int = 5) -> DataFrame:
    """Per split and source of test: records, questions of at least ``length`` words, and how many of these

    * overlapping - are near-same to a text of ``train.question1``, as in :func:`found`,
    * mostly_covered - have at least ``share`` of their words in spans of ``length`` words or more that stand in train,
    * covered_whole - have all of them there.

    source is trimmed and in lower case with ``_`` for ``-``; null stays null. A test record that arrives again counts once;
    records without test_id count each.
    """
    said = lambda c: F.array_join(words(c), " ")
    source = F.replace(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), F.lit("-"), F.lit("_"))
    rows = one_per_id(test.select("test_id", "split", "source", "question1", "question2"), "test_id")
    rows = rows.select("split", source.alias("source"), F.explode(F.array(*[F.struct(F.lit(i).alias("field"), said(f"question{i + 1}").alias("text")) for i in (0, 1)])).alias("x"))
    rows = work.save(rows.select("split", "source", "x.field", "x.text"), "test_rows")
    t = work.save(train.select(said("question1").alias("text")).filter("text <> ''").distinct(), "train_texts")
    size = lambda c: F.size(F.split(c, " "))
    q = work.save(rows.filter(size("text") >= length).select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "test_texts")
    covered = covered_words(q, t.select(F.xxhash64("text").alias("key"), "text"), length)
    sort = lambda df: df.filter(size("text") >= 5).select(F.array_join(F.array_sort(F.split("text", " ")), " ").alias("bag"))
    near = near_pairs(sort(t).distinct(), sort(q).distinct()).select(F.col("right_bag").alias("bag"), F.lit(True).alias("near")).distinct()
    told = q.select("key", "text", size("text").alias("n")).join(work.save(covered, "covered"), "key", "left")
    told = told.withColumn("bag", F.array_join(F.array_sort(F.split("text", " ")), " ")).join(work.save(near, "near"), "bag", "left")
    told = told.select("text", "near", (F.coalesce("covered", F.lit(0)) >= share * F.col("n")).alias("mostly"), (F.coalesce("covered", F.lit(0)) == F.col("n")).alias("entire"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return (
        rows.groupBy("split", "source", "text")
        .agg(F.count_if(F.col("field") == 0).alias("records"), F.count(F.lit(1)).alias("times"))
        .join(told, "text", "left")
        .groupBy("split", "source")
        .agg(
            F.sum("records").alias("records"),
            F.coalesce(F.sum(F.when(F.col("mostly").isNotNull(), F.col("times"))), F.lit(0)).alias("questions"),
            *[F.coalesce(F.sum(F.when(F.col(c), F.col("times"))), F.lit(0)).alias(name) for c, name in (("near", "overlapping"), ("mostly", "mostly_covered"), ("entire", "covered_whole"))],
        )
    )
