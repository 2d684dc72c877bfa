"""How distinctive a term is per record, and how often every term occurs.

:func:`distinctive` tests every term of a record by the log-likelihood ratio of the two-by-two table

    term in the record (a)          other words of the record (b)
    term in the rest (c)            other words of the rest (d)

G2 = 2 * sum(O * ln(O / E)). Beside it stands the record's own cell, O * ln(O / E), with the expectation taken over records,
E = m * d / n: m occurrences where a share d / n of all records has the term at all.

:func:`ngram_counts` counts n-grams by a suffix array with common-prefix intervals. A record that arrives again is one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.work import Workspace
from ..sources.tables import one_per_id

#: Terms whose totals all tasks know: the most frequent ones, none longer than LONGEST characters, so at most a few megabytes.
KNOWN, LONGEST = 50_000, 64
#: Words to which all suffixes are compared; those that share so many with another are compared further, to twice as many each time.
FIRST_DEPTH = 64
#: Words in the rows that a task holds before it hands them on.
HELD = 4_000_000


def record_words(pairs: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """(id, text): the words of all fields of each record, blank between. Null and empty fields have none."""
    one = one_per_id(pairs.select(ident, *fields), ident)
    return one.select(F.col(ident).alias("id"), F.array_join(F.concat(*[words(f) for f in fields]), " ").alias("text"))


def _split(c: str = "text") -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def term_totals(records: DataFrame) -> DataFrame:
    """(term, total_m, d): occurrences in all records and records that have the term."""
    ws = _split()
    mark = lambda a, i: F.transform(a, lambda w: F.struct(w.alias("term"), F.lit(i).alias("d")))
    long = records.select(F.explode(F.concat(mark(ws, 0), mark(F.array_distinct(ws), 1))).alias("x")).select("x.term", "x.d")
    return long.groupBy("term").agg(F.count_if(F.col("d") == 0).alias("total_m"), F.sum("d").alias("d"))


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood ratio of a two-by-two table of counts; a cell of 0 adds 0. Columns or arrays of numpy."""
    n = a + b + c + d
    if isinstance(a, np.ndarray):
        cell = lambda o, r, k: np.where(o > 0, o * np.log(np.where(o > 0, o, 1) * n / np.where(o > 0, r * k, n)), 0.0)
    else:
        cell = lambda o, r, k: F.when(o > 0, o * F.ln(o * n / (r * k))).otherwise(0.0)
    return 2 * (cell(a, a + b, a + c) + cell(b, a + b, b + d) + cell(c, c + d, a + c) + cell(d, c + d, b + d))


def _scored(table: DataFrame, total: int, n: int) -> DataFrame:
    """(id, term, m, d, g2, cell) of ``table`` (id, term, m, size, total_m, d)."""
    a, size, tm, d = (F.col(c).cast("double") for c in ("m", "size", "total_m", "d"))
    sign = F.when(a * (total - size) >= (tm - a) * size, 1.0).otherwise(-1.0)
    return table.select("id", "term", "m", "d", (sign * g2(a, size - a, tm - a, total - size - tm + a)).alias("g2"), (a * F.ln(a / (a * d / n))).alias("cell"))


def contingency(records: DataFrame, work: Workspace, best: int | None = None) -> DataFrame:
    """(id, term, m, d, g2, cell) of every term of every record: the two-by-two table of each, scored.

    Terms are counted where the record lies. Those that all tasks know get their table there and then; the others, rarer than
    all of these, meet their totals in a shuffle. With ``best``, a record's known terms that at least ``best`` records have are cut down to the one
    with the highest cell (rounded to six decimals, among equals the first by code points) before anything is sent.
    """
    totals = work.save(term_totals(records), "totals")
    n, total = records.count(), int(totals.agg(F.coalesce(F.sum("total_m"), F.lit(0))).first()[0])
    top = totals.filter(F.length("term") <= LONGEST).orderBy(F.desc("d"), "term").limit(KNOWN).collect()
    shared = work.spark.sparkContext.broadcast(([r.term for r in top], [r.total_m for r in top], [r.d for r in top]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known_m, known_d = pa.array(shared.value[0], pa.string()), np.array(shared.value[1] or [0], float), np.array(shared.value[2] or [0], float)
        for batch in batches:
            # an empty text is one empty word, which is no term
            said = pc.split_pattern(batch["text"], " ")
            rows = pa.table({"row": pc.list_parent_indices(said), "term": pc.list_flatten(said)}).filter(pc.field("term") != "")
            size = np.bincount(rows["row"].to_numpy(), minlength=batch.num_rows)
            t = rows.append_column("one", pa.array(np.ones(rows.num_rows, np.int64))).group_by(["row", "term"]).aggregate([("one", "sum")]).combine_chunks()
            row, m, term = t["row"].to_numpy(), t["one_sum"].to_numpy(), t["term"]
            at = pc.index_in(term, value_set=terms)
            seen = pc.is_valid(at).to_numpy()
            at = pc.fill_null(at, 0).to_numpy()
            tm, d, a, whole = known_m[at], known_d[at], m.astype(float), size[row].astype(float)
            with np.errstate(all="ignore"):
                cell = a * np.log(a / (a * d / n))
            if best is None:
                score = g2(a, whole - a, tm - a, total - whole - tm + a) * np.where(a * (total - whole) >= (tm - a) * whole, 1.0, -1.0)
                keep = np.arange(len(row))
            else:
                score = cell
                ranked = np.flatnonzero(seen & (d >= best))
                # in every record the highest cell first, then the first term (terms are ranked by their bytes)
                place = pc.rank(term.take(pa.array(ranked)), sort_keys="ascending", tiebreaker="dense").to_numpy()
                ranked = ranked[np.lexsort((place, -np.round(cell[ranked], 6), row[ranked]))]
                first = ranked[np.append(True, row[ranked][1:] != row[ranked][:-1])] if len(ranked) else ranked
                keep = np.concatenate([first, np.flatnonzero(~seen)])
            own = pa.array(keep)
            some = lambda x, kind: pa.array(x[keep], kind, mask=~seen[keep])
            cols = [batch["id"].take(pa.array(row[keep])), term.take(own), pa.array(m[keep]), pa.array(size[row[keep]]), some(d.astype(int), pa.int64()), some(score, pa.float64()), some(cell, pa.float64())]
            whole_ = pa.table(cols, names=["id", "term", "m", "size", "d", "g2", "cell"])
            yield from whole_.combine_chunks().to_batches()

    told = work.save(records.mapInArrow(run, "id long, term string, m long, size long, d long, g2 double, cell double"), "cells")
    known = told.filter("d is not null").drop("size")
    return known.unionByName(_scored(told.filter("d is null").drop("d").join(totals, "term"), total, n))


def distinctive(pairs: DataFrame, ident: str, fields: list[str], work: Workspace) -> DataFrame:
    """(id, term, m, d, g2, cell) of every term of every record, not rounded.

    g2 is signed: negative where the term is rarer in the record than in the rest. A record without words has no rows.
    """
    return contingency(work.save(record_words(pairs, ident, fields), "records"), work)


def most_distinctive(pairs: DataFrame, ident: str, fields: list[str], work: Workspace, least_d: int = 2) -> DataFrame:
    """(id, term): the term with the highest cell of each record, among equals the first by code points.

    Terms in fewer than ``least_d`` records don't count.
    """
    cells = contingency(work.save(record_words(pairs, ident, fields), "records"), work, least_d).filter(F.col("d") >= least_d)
    best = F.min(F.struct((-F.round("cell", 6)).alias("s"), "term")).alias("x")
    return cells.groupBy("id").agg(best).select("id", "x.term")


# ---- n-grams


def _suffixes(texts: DataFrame, deepest: int) -> DataFrame:
    """(kind, suffix, dup, records) of every word of ``texts``: the suffix that begins there, of at most ``deepest`` words, and the depth
    of its common prefix with the one before it in the order of its own record (duplicate adjacency), in words.

    With a column ``starts`` only of the words at these places: all whose first words, to some depth, stand elsewhere too. Duplicate
    adjacencies are right beyond that depth."""
    placed = "starts" in texts.columns

    def all_sorted(ws: list[str], deepest: int) -> Iterator[tuple[list[str], int]]:
        """Sorted suffixes of one text, each with the depth of its common prefix with the one before."""
        last: list[str] = []
        for s in sorted(ws[j : j + deepest] for j in range(len(ws))):
            dup = 0
            for x, y in zip(last, s):
                if x != y:
                    break
                dup += 1
            yield s, dup
            last = s

    def some_sorted(ws: list[str], starts: list[int], deepest: int) -> Iterator[tuple[list[str], int]]:
        """Those suffixes that begin at ``starts``, of a long text: ranks of 1, 2, 4 ... words, prefixes by Kasai's scan."""
        place = {w: i for i, w in enumerate(sorted(set(ws)))}
        rank, k, n = np.array([place[w] for w in ws]), 1, len(ws)
        while True:
            after = np.append(rank[k:], np.full(k, -1))
            order = np.lexsort((after, rank))
            a, b = rank[order], after[order]
            rank[order] = np.append(0, np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            k *= 2
            if k >= n or rank.max() == n - 1:
                break
        common, h = [0] * n, 0
        before = np.append(-1, order)[rank].tolist()
        for j, i in enumerate(before):
            h = max(h - 1, 0) if i >= 0 else 0
            while i >= 0 and max(i, j) + h < n and ws[i + h] == ws[j + h]:
                h += 1
            common[j] = h
        for j in sorted(starts, key=rank.tolist().__getitem__):
            yield ws[j : j + deepest], min(common[j], deepest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            suffix: list[str] = []
            dups: list[int] = []

            def flush() -> pa.RecordBatch:
                own = pa.array(at, pa.int32())
                done = pa.RecordBatch.from_arrays([batch["kind"].take(own), pa.array(suffix, pa.string()), pa.array(dups, pa.int32()), batch["records"].take(own)], ["kind", "suffix", "dup", "records"])
                for c in (at, suffix, dups):
                    c.clear()
                return done

            for i, text in enumerate(batch["text"].to_pylist()):
                ws = text.split(" ") if text else []
                for s, dup in some_sorted(ws, batch["starts"][i].as_py(), deepest) if placed else all_sorted(ws, deepest):
                    at.append(i)
                    suffix.append(" ".join(s))
                    dups.append(dup)
                    if len(at) * deepest >= HELD:
                        yield flush()
            yield flush()

    return texts.select("kind", "text", "records", *["starts"] * placed).mapInArrow(run, "kind string, suffix string, dup int, records long")


def ngram_intervals(texts: DataFrame, work: Workspace, deepest: int | None = None, most: int | None = None) -> DataFrame:
    """(kind, n_from, n_to, term, occurrences, records): all n-grams of ``texts`` by the common-prefix intervals of their suffix array.

    An interval stands for the n-grams of n_from to n_to words that begin ``term`` (n_to words), which all have its occurrences and
    records. ``texts``: kind, text (words, blank between), records (how many records have this text). Every word starts a suffix.
    Suffixes are compared to FIRST_DEPTH words, and by :func:`_longer` beyond; an interval that goes on beyond a depth has a row on either
    side of it. With ``most``, n-grams of up to ``most`` words come one by one (n_from = n_to), longer ones not at all; with ``deepest``
    those of up to ``deepest`` words, in intervals.
    """
    texts = texts.select("kind", "text", "records")
    asked = min((n for n in (deepest, most) if n), default=None)
    pieces, told = _intervals(_suffixes(texts, asked or FIRST_DEPTH), work, "pieces", one_by_one=bool(most))
    # a text of more words than that has prefixes of as many
    if asked or pieces.filter(F.col("n_to") == FIRST_DEPTH).isEmpty():
        return told
    return reduce(DataFrame.unionByName, _longer(texts, work), told)


def _longer(texts: DataFrame, work: Workspace) -> Iterator[DataFrame]:
    """Intervals of the n-grams of more than FIRST_DEPTH words.

    Round by round, for a depth that doubles: what begins with as many words as nothing else does is one interval up to the end of its
    text, which is put together when the result is read. The others are sorted to twice that depth.
    """
    size = F.size(F.split("text", " "))
    one = texts.filter(size > FIRST_DEPTH).groupBy("kind", "text").agg(F.sum("records").alias("records"))
    long = work.save(one.withColumns({"no": F.monotonically_increasing_id(), "size": size}), "long")
    depth, left = FIRST_DEPTH, long.select("no", F.sequence(F.lit(0), F.col("size") - FIRST_DEPTH - 1).alias("starts"))
    while not left.isEmpty():
        alone = _prefixes(long.join(left, "no"), depth).groupBy("kind", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no"), F.min("start").alias("start"))
        alone = alone.filter("n = 1").groupBy("no").agg(F.collect_list("start").alias("alone"))
        told = left.join(alone, "no", "left").withColumn("alone", F.coalesce("alone", F.array().cast("array<int>")))
        told = work.save(told.select("no", "alone", F.array_except("starts", "alone").alias("starts")), f"starts_{depth}")
        ends = long.join(told.select("no", F.explode("alone").alias("start")), "no")
        yield ends.select(
            "kind",
            F.lit(depth + 1).alias("n_from"),
            F.expr("size - start").alias("n_to"),
            F.expr("substring_index(text, ' ', start - size)").alias("term"),
            F.col("records").alias("occurrences"),
            "records",
        )
        shared = long.join(told.filter("size(starts) > 0").select("no", "starts"), "no")
        if not shared.isEmpty():
            yield _intervals(_suffixes(shared, 2 * depth), work, f"pieces_{depth}", above=depth)[1]
        depth *= 2
        left = shared.select("no", F.filter("starts", lambda s: s + depth < F.col("size")).alias("starts")).filter("size(starts) > 0")


def _prefixes(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, prefix, no, start): the first ``depth`` words of the suffixes of ``texts`` that begin at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, text, no, starts in zip(*(batch[c].to_pylist() for c in ("kind", "text", "no", "starts"))):
                ws = text.split(" ")
                for some in (starts[i : i + max(1, HELD // depth)] for i in range(0, len(starts), max(1, HELD // depth))):
                    cols = [pa.array([kind] * len(some), pa.string()), pa.array([" ".join(ws[j : j + depth]) for j in some], pa.string()), pa.array([no] * len(some), pa.int64()), pa.array(some, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["kind", "prefix", "no", "start"])

    return texts.select("kind", "text", "no", "starts").mapInArrow(run, "kind string, prefix string, no long, start int")


def _intervals(suffixes: DataFrame, work: Workspace, name: str, above: int = 0, one_by_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table ``name`` of all pieces, and the intervals (kind, n_from, n_to, term, occurrences, records) of more than ``above`` words.

    Equal suffixes are added up and sorted over all partitions; a scan compares each with the one before it and closes the
    intervals that end there: occurrences are the sum over the interval, records that sum less the duplicate adjacencies. An interval that a
    single suffix makes is one row however long that suffix is. Prefixes of a partition's first and last suffix may go on in the next partition;
    their pieces, at most as many at each end as a suffix has words, are told n by n and added up.
    """
    array = suffixes.groupBy("kind", "suffix", "dup").agg(F.sum("records").alias("occ"))
    array = array.repartitionByRange("kind", "suffix").sortWithinPartitions("kind", "suffix", "dup")

    def common(x: list[str], y: list[str]) -> int:
        n = 0
        for a, b in zip(x, y):
            if a != b:
                break
            n += 1
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0  # words in out
        open_: list[list] = []  # nodes from the root down: [depth, occurrences, occurrences of duplicates by their depth]
        first = kind = None
        ws: list[str] = []

        def add(to: dict, depth: int, n: int) -> None:
            to[depth] = to.get(depth, 0) + n

        def emit(lo: int, hi: int, occ: int, rec: int, edge: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            lo = max(lo, above + 1)
            for n in range(lo, (hi if one_by_one else min(hi, edge)) + 1):
                out.append((n <= edge, kind, n, n, " ".join(ws[:n]), occ, rec))
                held += n
                if held >= HELD:
                    yield flush()
            if not one_by_one and hi >= max(lo, edge + 1):
                out.append((False, kind, max(lo, edge + 1), hi, " ".join(ws[:hi]), occ, rec))
                held += hi
                if held >= HELD:
                    yield flush()

        def close(depth: int, last: bool = False) -> Iterator[pa.RecordBatch]:
            """Close the nodes deeper than ``depth``; a node whose parent lies above ``depth`` leaves a node there."""
            edge = len(ws) if last else common(ws, first[1]) if first and first[0] == kind else 0
            while open_ and open_[-1][0] > depth:
                n, occ, dup = open_.pop()
                parent = max(depth, open_[-1][0] if open_ else 0)
                # depths parent + 1 to n are one interval as long as no duplicate adjacency ends within
                upto = n
                for d in sorted((d for d in dup if parent < d < n), reverse=True):
                    yield from emit(d + 1, upto, occ, occ - sum(o for e, o in dup.items() if e > d), edge)
                    upto = d
                yield from emit(parent + 1, upto, occ, occ - sum(o for e, o in dup.items() if e >= upto), edge)
                if parent:
                    if not open_ or open_[-1][0] < parent:
                        open_.append([parent, 0, {}])
                    open_[-1][1] += occ
                    for d, o in dup.items():
                        add(open_[-1][2], min(d, parent), o)

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            cols = list(zip(*out)) or [[]] * 7
            types = [pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["edge", "kind", "n_from", "n_to", "term", "occurrences", "records"])
            out.clear()
            return done

        for b in batches:
            for own, suffix, dup, occ in zip(*(b[c].to_pylist() for c in ("kind", "suffix", "dup", "occ"))):
                w = suffix.split(" ")
                yield from close(common(ws, w) if own == kind else 0)
                kind, ws = own, w
                first = first or (kind, w)
                if open_ and open_[-1][0] == len(w):
                    open_[-1][1] += occ
                else:
                    open_.append([len(w), occ, {}])
                if dup:
                    add(open_[-1][2], dup, occ)
                if len(out) >= 50_000:
                    yield flush()
        yield from close(0, last=True)
        yield flush()

    pieces = work.save(array.mapInArrow(run, "edge boolean, kind string, n_from int, n_to int, term string, occurrences long, records long"), name)
    sums = [F.sum(c).alias(c) for c in ("occurrences", "records")]
    return pieces, pieces.filter("not edge").drop("edge").unionByName(pieces.filter("edge").groupBy("kind", "n_from", "n_to", "term").agg(*sums))


def ngram_counts(texts: DataFrame, most: int, work: Workspace) -> DataFrame:
    """(kind, n, term, occurrences, records) of every n-gram of 1 to ``most`` words, from :func:`ngram_intervals`."""
    return ngram_intervals(texts, work, most=most).select("kind", F.col("n_to").alias("n"), "term", "occurrences", "records")


def text_intervals(train: DataFrame, work: Workspace) -> DataFrame:
    """(n_from, n_to, term, occurrences, records): the n-grams of any length of question1, see :func:`ngram_intervals`."""
    one = work.save(one_per_id(train.select("id", "question1")), "records")
    q = one.filter("question1 is not null").groupBy("question1").agg(F.count(F.lit(1)).alias("records"))
    return ngram_intervals(q.select(F.lit("word").alias("kind"), F.array_join(words("question1"), " ").alias("text"), "records"), work).drop("kind")


def value_frequencies(train: DataFrame, most: int, work: Workspace, common: float = 0.05) -> DataFrame:
    """(kind, n, term, occurrences, records, mark) of words of question1 and of values of qid1 in ``train``.

    mark is 'rare' for one record, 'common' for at least ``common`` of the records whose question1 (qid1) isn't null, else null.
    Equal texts are counted first and are one text of the array. Null fields have no terms.
    """
    one = work.save(one_per_id(train.select("id", "qid1", "question1")), "records")
    q = one.filter("question1 is not null").groupBy("question1").agg(F.count(F.lit(1)).alias("records"))
    q = q.select(F.lit("word").alias("kind"), F.array_join(words("question1"), " ").alias("text"), "records")
    v = one.filter("qid1 is not null").groupBy("qid1").agg(F.count(F.lit(1)).alias("records")).select(F.lit("qid1").alias("kind"), F.col("qid1").cast("string").alias("text"), "records")
    whole = one.agg(F.count("question1").alias("word"), F.count("qid1").alias("qid1")).first()
    counts = ngram_counts(q.unionByName(v), most, work)
    n = F.when(F.col("kind") == "word", whole.word).otherwise(whole.qid1)
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") >= common * n, "common")
    return counts.withColumn("mark", mark)
