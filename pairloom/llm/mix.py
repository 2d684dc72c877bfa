"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is as large as all documents together. It is cut into blocks of equal numbers of tokens; each block goes to the source with
the highest quotient share / (2 * blocks so far + 1), as long as the source's documents, repeated as often as allowed, can fill
it. A source's blocks are apportioned in the same way to its shards (documents by hash), which gives each shard an integer
quota. Within a shard, documents come in a seeded order: as many whole passes as fit into the quota, then the documents that
still fit into the rest of it. What a shard can't fill, because its next documents are longer, is dealt once more to the others.

A shard has about SHARD tokens, more only where a source would have over MOST_SHARDS shards, so a bounded plan reaches the driver however
large the corpus is. A block is at most 1 / PER_SHARD of a source's mean shard, so that what is lost to whole blocks stays small.

Sources without a target, null sources and documents without tokens are not in the mix; their tokens count for its size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import Workspace
from .tokens import token_counts

#: Least blocks of a mix; tokens of a shard; shards of a source; blocks of a shard.
BLOCKS, SHARD, MOST_SHARDS, PER_SHARD = 10_000, 4_000_000, 4096, 100


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Seats of each key by highest quotients, at most ``most[key]``; ties go to the key that sorts first.

    With a divisor D, every key has round(weight / D) seats; the least D that gives no more than ``seats`` is searched, and the last
    few seats are dealt one by one.
    """
    live = {k: w for k, w in weights.items() if w > 0 and (most is None or most[k] > 0)}
    got = {k: 0 for k in weights}

    def at(divisor: float) -> dict:
        return {k: min(int(w / divisor + 0.5), seats if most is None else most[k]) for k, w in live.items()}

    if live and seats:
        low, high = min(live.values()) / (4 * seats + 4), 4.0 * max(live.values())  # too many or all that may be; none
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if sum(at(mid).values()) <= seats else (mid, high)
        got |= {k: max(0, n - 1) for k, n in at(high).items()}
    queue = [(-w / (2 * got[k] + 1), str(k), k) for k, w in live.items() if most is None or got[k] < most[k]]
    heapq.heapify(queue)
    rest = seats - sum(got.values())
    while rest > 0 and queue:
        _, name, k = heapq.heappop(queue)
        got[k] += 1
        rest -= 1
        if most is None or got[k] < most[k]:
            heapq.heappush(queue, (-weights[k] / (2 * got[k] + 1), name, k))
    return got


def source_tokens(documents: DataFrame, targets: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens) of every document; per source of ``targets``: share, max_repeats, tokens, whole.

    A source that stands twice in targets has the sum of its shares and the least of its repeats; one without documents has 0 tokens.
    """
    docs = work.save(token_counts(documents.select("doc_id", "source", "text")), "tokens")
    whole = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole"))
    by = docs.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    t = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    return docs, t.join(by, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).crossJoin(F.broadcast(whole))


def _shards(tokens: int) -> int:
    return max(1, min(MOST_SHARDS, -(-tokens // SHARD)))


def _block(rows: list, blocks: int) -> int:
    """Tokens of a block."""
    return max(1, min([rows[0].whole // blocks, *[r.tokens // _shards(r.tokens) // PER_SHARD for r in rows if r.tokens]])) if rows else 1


def short_sources(documents: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """(source): sources that can't reach their share even if every document is used as often as allowed.

    A source is short if the blocks that it gets by its quotients alone are more than its documents can fill. As blocks are whole,
    sources that come near that are looked at too, and the tokens decide.
    """
    _, t = source_tokens(documents, targets, work)
    rows = t.collect()  # one row for each target
    size = _block(rows, BLOCKS)
    share = {r.source: r.target_share or 0.0 for r in rows}
    blocks = rows[0].whole // size if rows else 0
    quota = sainte_lague(share, round(blocks * sum(w for w in share.values() if w > 0)))
    # a quota is less than one block a source away from the exact share of all blocks, and one block is lost at the mix's end
    near = [r.source for r in rows if quota[r.source] + len(rows) + 1 >= (r.max_repeats or 0) * r.tokens // size]
    short = F.col("target_share") * F.col("whole") > F.coalesce("max_repeats", F.lit(0)) * F.col("tokens")
    return t.filter(F.col("source").isin(near) & short).select("source")


def _select(documents: DataFrame) -> DataFrame:
    """(doc_id, source, shard, tokens, uses) of ``documents`` (with passes, rest), a shard's documents in order in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rest = None, 0
        for batch in batches:
            uses = []
            for source, s, n, passes, first in zip(*(batch[c].to_pylist() for c in ("source", "shard", "tokens", "passes", "rest"))):
                if (source, s) != shard:
                    shard, rest = (source, s), first
                fits = n <= rest
                rest -= n * fits
                uses.append(passes + fits)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "source", "shard", "tokens")), pa.array(uses, pa.int32())], ["doc_id", "source", "shard", "tokens", "uses"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, source string, shard long, tokens long, uses int").filter("uses > 0")


def mix(documents: DataFrame, targets: DataFrame, work: Workspace, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document is used."""
    spark = documents.sparkSession
    docs, t = source_tokens(documents, targets, work)
    rows = t.collect()  # one row for each target
    size = _block(rows, blocks)
    repeats = {r.source: max(0, r.max_repeats or 0) for r in rows}
    shards = spark.createDataFrame([(r.source, _shards(r.tokens)) for r in rows], "source string, shards long")
    kept = docs.filter("tokens > 0").join(F.broadcast(shards), "source")
    kept = work.save(kept.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).drop("shards"), "kept")
    own: dict = {}
    for r in kept.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect():  # at most MOST_SHARDS a target
        own.setdefault(r.source, {})[r.shard] = r.tokens
    most = {s: {k: repeats[s] * n // size for k, n in by.items()} for s, by in own.items()}
    share = {r.source: r.target_share or 0.0 for r in rows if r.source in own}
    quota = sainte_lague(share, rows[0].whole // size if rows else 0, {s: sum(most[s].values()) for s in share})
    wanted = {}
    for s, by in own.items():
        seats = sainte_lague(by, quota[s], most[s])
        wanted |= {(s, k): seats[k] * size for k in by}

    def select() -> DataFrame:
        given = [(s, k, t // own[s][k], t % own[s][k]) for (s, k), t in wanted.items()]
        q = spark.createDataFrame(given, "source string, shard long, passes int, rest long")
        laid = kept.join(F.broadcast(q), ["source", "shard"]).repartition("source", "shard")
        return _select(laid.sortWithinPartitions("source", "shard", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))

    # a shard whose next documents are all longer than the rest of its quota leaves that to the source's other shards
    used = {(r.source, r.shard): r.used for r in select().groupBy("source", "shard").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used")).collect()}
    for s, by in own.items():
        left = {k: wanted[s, k] - used.get((s, k), 0) for k in by}
        full = [k for k in by if left[k] <= sorted(left.values())[len(left) // 2]]
        more = sainte_lague({k: by[k] for k in full}, sum(left.values()), {k: repeats[s] * by[k] - wanted[s, k] for k in full})
        for k, n in more.items():
            wanted[s, k] += n
    return select().select("doc_id", "source", "tokens", "uses")


def shares(documents: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """Per source of the targets: target share, share reached, tokens used, documents used, most uses of a document."""
    used = mix(documents, targets, work).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("uses").alias("most_uses")
    )
    t = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    told = t.join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_uses"])
    whole = used.agg(F.sum("used_tokens").alias("whole"))
    return told.crossJoin(F.broadcast(whole)).select("source", "target_share", F.round(F.try_divide("used_tokens", "whole"), 6).alias("share"), "used_tokens", "used_documents", "most_uses")
