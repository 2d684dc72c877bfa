"""Similarity of words by a lexicon that the user brings: senses with glosses and their more general senses.

Tables: ``senses`` (lemma, sense, gloss) and ``parents`` (sense, parent). Both may be large; all steps are joins.

* :func:`ancestors` - every more general sense and how many steps away it is.
* :func:`similarities` - path similarity 1 / (steps + 1) and Wu-Palmer similarity 2 depth(common) / (depth(a) + depth(b)).
* :func:`disambiguate` - the sense of each word whose gloss shares most words with the text (Lesk), ties by sense.
* :func:`look_up_words` - lemmas or tags of a text's words by a dictionary.
* :func:`semantic_similarity` - tags, senses and overall similarity of two texts in one chain.
* :func:`from_vectors` - a lexicon from word vectors, for collections without one.
* :func:`overall` - for each word of one text its best counterpart's similarity, summed, over the words of both texts.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit import inverse_distance, levenshtein
from ..functions.text import tokens
from ..plans.work import Workspace
from .embed import nearest
from .skew import salted_join


#: Rows of a lexicon's tables, and characters of its words, that go to all tasks at most.
SMALL = (500_000, 32_000_000)


def _walked(parents: DataFrame, most: int) -> list[tuple] | None:
    """The rows of :func:`ancestors`, or None if there are too many, or ends that are null."""
    long = F.length(F.col("sense").cast("string")) + F.length(F.col("parent").cast("string"))
    n, chars, gaps = parents.agg(F.count(F.lit(1)), F.sum(long), F.count_if(long.isNull())).first()
    if n > SMALL[0] or (chars or 0) > SMALL[1] or gaps:
        return None
    up: dict = {}
    for s, p in parents.select("sense", "parent").collect():
        up.setdefault(s, set()).add(p)
        up.setdefault(p, set())
    out: list[tuple] = []
    for s in up:
        seen, front, steps = {s}, [s], 0
        while front:
            if steps >= most:
                raise RuntimeError(f"ancestors are left after {most} steps")
            out += [(s, a, steps) for a in front]
            if len(out) > SMALL[0]:
                return None
            front = list({p for a in front for p in up[a]} - seen)
            seen.update(front)
            steps += 1
    return out


def ancestors(parents: DataFrame, work: Workspace, most: int = 64) -> DataFrame:
    """(sense, above, steps): the sense itself (0 steps) and all above it, by the shortest way.

    Tables of at most :data:`SMALL` are walked at once, larger ones by a join for each step."""
    few = _walked(parents, most)
    if few is not None:
        kind = parents.schema["sense"].dataType.simpleString()
        return parents.sparkSession.createDataFrame(few, f"sense {kind}, above {kind}, steps int")
    nodes = parents.select(F.col("sense")).unionByName(parents.select(F.col("parent").alias("sense"))).distinct()
    known = nodes.select("sense", F.col("sense").alias("above"), F.lit(0).alias("steps"))
    front = known
    for i in range(most):
        front = front.join(parents.select(F.col("sense").alias("above"), "parent"), "above").groupBy("sense", F.col("parent").alias("above")).agg((F.min("steps") + 1).alias("steps"))
        front = work.save(front.join(known, ["sense", "above"], "left_anti"), f"front-{i}")
        if front.isEmpty():
            return work.save(known, "ancestors")
        known = known.unionByName(front)
    raise RuntimeError(f"ancestors are left after {most} steps")


def similarities(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """``pairs`` (a, b: senses) with ``path`` and ``wup``; null without a common ancestor."""
    depth = up.groupBy("sense").agg((F.max("steps") + 1).alias("depth"))
    p = pairs.select("a", "b").distinct()
    side = lambda c, n: up.select(F.col("sense").alias(c), "above", F.col("steps").alias(n))
    common = p.join(side("a", "sa"), "a").join(side("b", "sb"), ["b", "above"]).join(depth.select(F.col("sense").alias("above"), "depth"), "above")
    best = common.groupBy("a", "b").agg(F.min(F.col("sa") + F.col("sb")).alias("steps"), F.max(F.struct("depth", (-F.col("sa") - F.col("sb")).alias("near"))).alias("x"))
    wup = 2 * F.col("x.depth") / (2 * F.col("x.depth") - F.col("x.near"))
    return pairs.join(best.select("a", "b", (1 / (F.col("steps") + 1)).alias("path"), wup.alias("wup")), ["a", "b"], "left")


def look_up_words(texts: DataFrame, key: str, words: Column, dictionary: DataFrame, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, found): for each word, in order, its ``value`` in ``dictionary`` (word, value; one row per word).

    Without ``keep`` an unknown word stands for itself (lemmas); with ``keep`` the words whose value begins with one of its entries
    are returned (parts of speech).
    """
    said = texts.select(key, F.posexplode(words).alias("pos", "word"))
    entries = dictionary.select("word", F.col(value).alias("v")).join(said.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    long = salted_join(said, entries, "word", "n", "left")
    if keep:
        ok = F.lit(False)
        for k in keep:
            ok = ok | F.coalesce(F.startswith("v", F.lit(k)), F.lit(False))
        long = long.filter(ok).withColumn("v", F.col("word"))
    back = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("v", "word").alias("v")))).alias("x"))  # the words of one text
    return texts.select(key).join(back, key, "left").select(key, F.coalesce(F.transform("x", lambda s: s["v"]), F.array().cast("array<string>")).alias("found"))


def disambiguate(texts: DataFrame, key: str, words: Column, senses: DataFrame) -> DataFrame:
    """(key, pos, word, sense) of the words that the lexicon has."""
    long = texts.select(key, F.posexplode(words).alias("pos", "word"))
    context = long.select(key, F.col("word").alias("w")).distinct()
    own = senses.groupBy(F.col("lemma").alias("word")).agg(F.collect_list(F.struct("sense", "gloss")).alias("x"))  # a lemma's senses
    options = salted_join(long, own.join(long.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "word"), "word", "_n").select("*", F.inline("x")).drop("x")
    gloss = options.select(key, "pos", "word", "sense", F.explode(F.array_distinct(tokens(F.lower("gloss")))).alias("w"))
    hits = gloss.join(context, [key, "w"]).filter("w <> word").groupBy(key, "pos", "word", "sense").agg(F.count(F.lit(1)).alias("n"))
    scored = options.select(key, "pos", "word", "sense").join(hits, [key, "pos", "word", "sense"], "left")
    return scored.groupBy(key, "pos", "word").agg(F.min_by("sense", F.struct(-F.coalesce("n", F.lit(0)), "sense")).alias("sense"))


def overall(left: DataFrame, right: DataFrame, key: str, up: DataFrame) -> DataFrame:
    """(key, similarity) from :func:`disambiguate` of both texts: sum over the left words of the best mean of path and Wu-Palmer
    similarity (inverse edit distance where senses have no common ancestor), over the words of both sides."""
    x = left.select(key, F.col("pos").alias("i"), F.col("word").alias("wa"), F.col("sense").alias("a"))
    y = right.select(key, F.col("pos").alias("j"), F.col("word").alias("wb"), F.col("sense").alias("b"))
    both = x.join(y, key)
    s = both.join(similarities(both.select("a", "b").distinct(), up), ["a", "b"], "left")
    r = F.coalesce((F.col("path") + F.col("wup")) / 2, inverse_distance(F.col("wa"), F.col("wb")))
    best = s.withColumn("r", r).groupBy(key, "i").agg(F.max("r").alias("m")).groupBy(key).agg(F.sum("m").alias("m"))
    n = x.select(key).unionByName(y.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(best, key, "left").select(key, F.coalesce(F.col("m") / F.col("n"), F.lit(0.0)).alias("similarity"))


def _at_hand(tags: DataFrame, senses: DataFrame, up: DataFrame, keep: tuple[str, ...]):
    """Words with a tag of ``keep``, (lemma, sense, gloss's words) and ancestors as tables of the driver, or None if they are too many."""
    kept = tags.filter(reduce(lambda x, y: x | y, [F.startswith("tag", F.lit(k)) for k in keep])).select("word") if keep else tags.select("word")
    own = senses.select("lemma", "sense", "gloss")
    rows = chars = 0
    for t in (kept, own, up.select("sense", "above")):
        long = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in t.columns), F.lit(0))
        n, c = t.agg(F.count(F.lit(1)), F.sum(long)).first()
        rows, chars = rows + n, chars + (c or 0)
    if rows > SMALL[0] or chars > SMALL[1]:
        return None
    told = own.select("lemma", "sense", F.array_distinct(tokens(F.lower("gloss"))).alias("w"))
    return [t.toArrow().to_pylist() for t in (kept, told, up.select("sense", "above", "steps"))]


class _Chain:
    """The chain of :func:`semantic_similarity` for one pair after another."""

    def __init__(self, kept: list[dict], senses: list[dict], up: list[dict]):
        self.kept = Counter(r["word"] for r in kept)
        self.senses: dict = {}
        for r in senses:
            self.senses.setdefault(r["lemma"], {}).setdefault(r["sense"], []).extend(r["w"] or [])
        self.up: dict = {}
        for r in up:
            self.up.setdefault(r["sense"], {})[r["above"]] = r["steps"]
        self.depth = {s: max(x.values()) + 1 for s, x in self.up.items()}
        self.alike = lru_cache(200_000)(self._alike)

    def told(self, words: list[str]) -> list[tuple]:
        """(word, sense) of the words that are kept and that the lexicon has."""
        found = [w for w in words if w in self.kept for _ in range(self.kept[w])]
        context = set(found)
        hits = lambda w, gloss: sum(g in context and g != w for g in gloss)
        return [(w, min(own, key=lambda s: (-hits(w, own[s]), s))) for w in found if (own := self.senses.get(w))]

    def _alike(self, x: tuple, y: tuple) -> float:
        (wa, a), (wb, b) = x, y
        one, other = self.up.get(a, {}), self.up.get(b, {})
        common = [(self.depth.get(s, 0), -(one[s] + other[s])) for s in one.keys() & other.keys()]
        if not common:
            return 1 / d if (d := levenshtein(wa, wb)) else 0.0
        depth, near = max(common)
        return (1 / (1 - max(n for _, n in common)) + 2 * depth / (2 * depth - near)) / 2

    def pair(self, a: list[str], b: list[str]) -> float:
        x, y = self.told(a), self.told(b)
        return sum(max(self.alike(w, v) for v in y) for w in x) / (len(x) + len(y)) if x and y else 0.0


def semantic_similarity(pairs: DataFrame, key: str, a: Column, b: Column, tags: DataFrame, senses: DataFrame, parents: DataFrame, work: Workspace, keep: tuple[str, ...] = ("NN", "JJ", "VB")) -> DataFrame:
    """(key, similarity) of the word arrays ``a`` and ``b``: words with a tag of ``keep`` in ``tags`` (word, tag), the sense of each within its
    text, and the :func:`overall` similarity of both texts' senses. A pair without such words has 0.

    A lexicon of at most :data:`SMALL` rows and characters goes to all tasks, so that pairs stay where they lie; a larger one is joined."""
    up = ancestors(parents, work)
    known = _at_hand(tags, senses, up, keep)
    if known is not None:
        kind = pairs.schema[key].dataType.simpleString()
        sent = pairs.sparkSession.sparkContext.broadcast(known)

        def compare(batches):
            one = _Chain(*sent.value)
            for batch in batches:
                said = [one.pair(x or [], y or []) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(said, pa.float64())], [key, "similarity"])

        # all that is known of a word are its tag and senses; others take no part
        return pairs.select(key, a.alias("_a"), b.alias("_b")).mapInArrow(compare, f"`{key}` {kind}, similarity double")
    sides = []
    for name, words in (("left", a), ("right", b)):
        kept = look_up_words(pairs.select(key, words.alias("_w")), key, F.col("_w"), tags, "tag", keep)
        sides.append(work.save(disambiguate(kept, key, F.col("found"), senses), name))
    return pairs.select(key).join(overall(*sides, key, up), key, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def from_vectors(words: DataFrame, dims: int, work: Workspace, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(senses, parents) of a lexicon made from word vectors (word, vec): a word is a sense, its gloss are its ``k`` nearest words, its parent
    is the nearest of these that sorts before it, or else the root ``*``; so no word is above itself."""
    w = words.select(F.col("word").alias("item"), "vec")
    near = work.save(nearest(w.withColumnRenamed("item", "query"), w, k, dims), "near")
    ordered = near.groupBy(F.col("query").alias("word")).agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))  # k rows
    told = words.select("word").join(ordered, "word", "left")
    items = F.coalesce(F.transform("x", lambda s: s["item"]), F.array().cast("array<string>"))
    senses = told.select(F.col("word").alias("lemma"), F.col("word").alias("sense"), F.array_join(items, " ").alias("gloss"))
    before = F.get(F.filter(items, lambda i: i < F.col("word")), F.lit(0))
    return senses, told.select(F.col("word").alias("sense"), F.coalesce(before, F.lit("*")).alias("parent"))
