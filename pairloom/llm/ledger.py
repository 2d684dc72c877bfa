"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger is a table in buckets of the key's hash. A batch is aggregated by key and joined, full outer, to the buckets that it
touches: counts are added and the earliest representative stays; untouched buckets are not read. A second table holds the
members (key, id) in the same buckets, so that a record that arrives again is not counted again.

The canonical key of a pair is its two questions' words, each in order, the lesser question first: white space, letter case,
punctuation and the order of the two fields make no difference. A pair counts if both questions have at least ``least`` words;
null and empty questions have none. Whole texts are compared, through a 128-bit hash of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words
from ..operators.skew import join_by_load
from ..plans.work import Workspace

#: Members of a bucket, and the most buckets; members that one task writes; members of a small batch.
BUCKET_ROWS, MOST_BUCKETS, PART_ROWS, FEW = 1_000_000, 4096, 250_000, 20_000


def keyed(pairs: DataFrame, ident: str = "id", a: str = "question1", b: str = "question2", least: int = 5) -> DataFrame:
    """(h1, h2, id) of every pair that counts; rows without id are left out, since nothing names them."""

    def key(x: Column, y: Column) -> Column:
        lo, hi = F.array_join(x, " "), F.array_join(y, " ")
        ok = (F.size(x) >= least) & (F.size(y) >= least)
        return F.when(ok, let(lambda p, q: F.struct(F.xxhash64(p, q).alias("h1"), F.xxhash64(F.lit(1), q, p).alias("h2")), F.least(lo, hi), F.greatest(lo, hi)))

    # keys are computed within a generator and tested after it, so that no filter computes them a second time
    said = pairs.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.explode(F.array(let(key, words(a), words(b)))).alias("k"))
    return said.filter("k is not null").select("k.h1", "k.h2", "id")


class Ledger:
    """Counts of canonical keys in buckets, kept in ``work``; every update writes new versions of the entries of touched buckets.

    ``rows`` is about how many members are expected in all and sets the number of buckets, each of which several tasks write.
    """

    def __init__(self, work: Workspace, rows: int = 0, buckets: int | None = None):
        self.work = work
        self.buckets = buckets or min(MOST_BUCKETS, max(8, 1 << max(0, rows // BUCKET_ROWS).bit_length()))
        self.parts = max(1, min(64, rows // self.buckets // PART_ROWS))
        self.entries: dict[int, str] = {}  # bucket -> path that holds it
        self.members: dict[int, list[str]] = {}  # bucket -> paths of its members
        self.version = 0

    def _save(self, df: DataFrame, name: str) -> None:
        laid = df.withColumn("bucket", F.pmod("h1", F.lit(self.buckets)).cast("int"))
        self.work.save(laid.repartition("bucket", F.pmod("h2", F.lit(self.parts))), name, partition_by="bucket")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        spark = self.work.spark
        return spark.read.schema(schema).parquet(*sorted(paths)) if paths else spark.createDataFrame([], schema)

    def _entries(self, touched: list[int]) -> DataFrame:
        return self._read([f"{self.entries[b]}/bucket={b}" for b in touched if b in self.entries], "h1 long, h2 long, copies long, keep_id long")

    def _members(self, touched: list[int]) -> DataFrame:
        return self._read([f"{p}/bucket={b}" for b in touched for p in self.members.get(b, [])], "h1 long, h2 long, id long")

    def update(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, id)."""
        v, self.version = self.version, self.version + 1
        new = batch.distinct()
        if self.members:
            new = self.work.save(new, f"batch-{v}")
            sizes = {r.bucket: r["count"] for r in new.groupBy(F.pmod("h1", F.lit(self.buckets)).alias("bucket")).count().collect()}  # at most ``buckets`` rows
            seen = self._members(sorted(sizes))
            if sum(sizes.values()) <= FEW:  # of a small batch's buckets only its own members are sent on
                seen = seen.join(F.broadcast(new), ["h1", "h2", "id"], "left_semi")
            new = new.join(seen.hint("merge"), ["h1", "h2", "id"], "left_anti")
        self._save(new, f"members-{v}")
        at = self.work.path(f"members-{v}")
        new = self.work.spark.read.schema("h1 long, h2 long, id long, bucket int").parquet(at)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets`` rows
        for b in touched:
            self.members.setdefault(b, []).append(at)
        counts = new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id"))
        if any(b in self.entries for b in touched):
            o = self._entries(touched).select("h1", "h2", F.col("copies").alias("c0"), F.col("keep_id").alias("k0"))
            both = counts.join(o.hint("merge"), ["h1", "h2"], "full_outer")
            counts = both.select("h1", "h2", (F.coalesce("copies", F.lit(0)) + F.coalesce("c0", F.lit(0))).alias("copies"), F.least("keep_id", "k0").alias("keep_id"))
        self._save(counts, f"entries-{v}")
        before = {self.entries.get(b) for b in touched}
        self.entries |= {b: self.work.path(f"entries-{v}") for b in touched}
        old = [p.rsplit("/", 1)[1] for p in before - set(self.entries.values()) - {None}]
        self.work.drop(*old, *([f"batch-{v}"] if v else []))

    def counts(self) -> DataFrame:
        """(h1, h2, copies, keep_id) of every key."""
        return self._entries(sorted(self.entries))

    def copies(self) -> DataFrame:
        """(keep_id, id) of every member but the one kept."""
        again = self.counts().filter("copies > 1").select("h1", "h2", "keep_id", "copies")
        total = self.counts().agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        told = join_by_load(self._members(sorted(self.members)), again, ["h1", "h2"], "copies", total)
        return told.filter("id <> keep_id").select("keep_id", "id")


def ledger_of(pairs: DataFrame, work: Workspace, batches: int = 3, by: str = "loaded_at") -> Ledger:
    """The ledger after ``batches`` batches of about equal spans of ``by``, oldest first; rows without it come first of all."""
    lo, hi, rows = pairs.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    ledger = Ledger(work, rows)
    cuts = [lo + (hi - lo) * i / batches for i in range(1, batches)] if lo is not None else []
    at = F.col(by)
    for i in range(len(cuts) + 1):
        ok = F.lit(True)
        if i:
            ok = ok & (at >= F.lit(cuts[i - 1]))
        if i < len(cuts):
            ok = ok & ((at < F.lit(cuts[i])) | (at.isNull() if i == 0 else F.lit(False)))
        ledger.update(keyed(pairs.filter(ok)))
    return ledger
