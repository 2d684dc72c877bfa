import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import corpus, embed, graph, learn, lexicon, rows
from pairloom.plans.work import Workspace
from pairloom.sources import files
from pairloom.streaming import arrivals


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


EDGES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (1, 2)]


def edge_table(spark):
    return graph.both_ways(spark.createDataFrame(EDGES + [(None, 3), (9, None)], "a long, b long"), "a", "b")


def neighbours():
    adj = defaultdict(set)
    for a, b in EDGES:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def test_kcore_by_peeling(spark, work):
    adj = neighbours()
    want = {}
    for k in range(1, 10):
        live = dict(adj)
        while True:
            gone = [v for v in live if sum(u in live for u in live[v]) < k]
            if not gone:
                break
            for v in gone:
                live.pop(v)
        want |= dict.fromkeys(live, k)
    assert dict(map(tuple, graph.kcore(edge_table(spark), work).collect())) == want


def test_pagerank_keeps_mass_and_counts_parallel_edges(spark, work):
    out = {1: [2, 3, 2], 2: [1, 3, 1], 3: [2, 1, 4], 4: [3, 5, 6], 5: [4, 6], 6: [5, 4], 7: [8], 8: [7]}
    pr = dict.fromkeys(out, 1 / 8)
    for _ in range(20):
        new = dict.fromkeys(out, 0.15 / 8)
        for v, to in out.items():
            for u in to:
                new[u] += 0.85 * pr[v] / len(to)
        pr = new
    got = dict(map(tuple, graph.pagerank(edge_table(spark), work).collect()))
    assert got == pytest.approx(pr) and sum(got.values()) == pytest.approx(1)


def test_common_neighbours(spark):
    adj = neighbours()
    p = spark.createDataFrame(EDGES, "a long, b long")
    got = {(r.a, r.b): r.common for r in graph.common_neighbours(p, "a", "b", edge_table(spark)).collect()}
    assert got == {(a, b): len(adj[a] & adj[b]) for a, b in EDGES}


def test_numbers_and_allocation(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert sorted((r.k, r.n) for r in rows.numbered(df, ["k"], "n").collect()) == [(i, i) for i in range(101)]
    known = spark.createDataFrame([("b", 5)], "t string, i long")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "t string")
    assert dict(map(tuple, graph.allocate_ids(wanted, known, "t", "i", 100).collect())) == {"a": 101, "b": 5, "c": 102}


def test_folds_and_oversampling(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1003)], "id long, label int")
    f = rows.contiguous_folds(df, ["id"]).collect()
    assert Counter(r.fold for r in f) == {0: 200, 1: 200, 2: 200, 3: 200, 4: 203}
    neg = sum(i % 4 != 0 for i in range(1003))
    assert rows.oversample(df, "id", "label", 1.5).count() == 1003 + neg + neg // 2
    assert set(map(tuple, rows.folds(df, "id").select("id").collect())) == {(i,) for i in range(1003)}
    assert rows.mean_of_folds(spark.createDataFrame([(0.1, 0.3), (float("nan"), 1.0), (None, 1.0)], "a double, b double"), ["a", "b"]).select("prediction").collect() == [(0.2,), (0.0,), (0.0,)]


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 1.5), (0, -1.0), (1, 0.5), (None, 0.1)], "y int, p double")
    assert rows.log_loss(df, "y", "p").first()[0] == pytest.approx(math.log(2) / 3, abs=1e-9)


def test_padded_sequences(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"] * 40)], "id long, t array<string>")
    got = {r.id: list(r.seq) for r in corpus.padded_sequences(df, "id", "t", ["t"], 5, 100).collect()}
    assert got == {1: [0, 0, 2, 3, 2], 2: [0] * 5, 3: [1] * 5}


def test_relaxed_distance_and_restart(spark, monkeypatch):
    words = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    p = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, ["x"], ["a"]), (3, [], [])], "id long, x array<string>, y array<string>")
    weight = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 5.0)], "word string, w double")
    for small, all_ in ((64_000_000, 2000), (64_000_000, 0), (1, 0)):
        monkeypatch.setattr(embed, "SMALL", small)
        monkeypatch.setattr(embed, "TABLE", all_)
        said = lambda **more: {r.id: r.distance for r in embed.relaxed_distance(p, "id", F.col("x"), F.col("y"), words, 2, **more).collect()}  # noqa: E731, B023
        assert said() == {1: pytest.approx((0 + math.sqrt(18)) / 2 + (0 + 1) / 2), 2: 0.0, 3: 0.0}
        assert said(restart=True)[1] == pytest.approx((1 + math.sqrt(18)) / 2 + (5 + 1) / 2)
        assert said(weight=weight)[1] == pytest.approx(3 * math.sqrt(18) + 5 * 1)


def test_sentence_vectors_without_known_words(spark, monkeypatch):
    words = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vec array<double>")
    p = spark.createDataFrame([(1, ["a", "x", "a"]), (2, ["x"])], "id long, t array<string>")
    for small in (64_000_000, 1):
        monkeypatch.setattr(embed, "SMALL", small)
        got = {r.id: r.vec for r in embed.sentence_vectors(p, ["id"], F.col("t"), words, 2, missing=float("nan")).collect()}
        assert got[1] == [1.0, 2.0] and all(math.isnan(x) for x in got[2])


def test_nearest_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(60, [0.0] * 5), (61, None)], "item long, vec array<double>")
    q = df.filter("item % 10 = 0").withColumnRenamed("item", "query")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 60, 10) for j in [j for j in np.argsort(-u @ u[i]) if j != i][:3]}
    for small in (64_000_000, 1):
        monkeypatch.setattr(embed, "SMALL", small)
        assert {(r.query, r.item) for r in embed.nearest(q, df, 3, 5).collect()} == want


def test_lists_find_nine_tenths_of_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(40, 16)), *[c + 0.4 * rng.normal(size=(40, 16)) for c in rng.normal(size=(20, 16))]])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(9000, [0.0] * 16), (9001, None)], "item long, vec array<double>")
    q = df.filter("item % 10 = 0").withColumnRenamed("item", "query")
    want = {(r.query, r.item): round(r.score, 9) for r in embed.nearest(q, df, 5, 16).collect()}
    for easy in (10_000, 20):
        monkeypatch.setattr(embed, "EASY", easy)
        rows_ = embed.nearest_by_lists(q, df, 5, 16, 16, 6).collect()
        got = {(r.query, r.item): round(r.score, 9) for r in rows_}
        assert len(got) == len(rows_) == len(want) and len(got.items() & want.items()) >= 0.9 * len(want)
    whole = {(r.query, r.item): round(r.score, 9) for r in embed.nearest_by_lists(q, df, 5, 16, 16, 16).collect()}
    assert whole == want
    assert embed.nearest_by_lists(q, df.limit(0), 5, 16).collect() == []


def test_svd(spark):
    rng = np.random.default_rng(5)
    cells = [rng.integers(0, 8, size=20).tolist() for _ in range(50)] + [[]]
    df = spark.createDataFrame(list(enumerate(cells)), "key long, cells array<int>")
    x = np.stack([np.bincount(np.array(c, dtype=int), minlength=8) for c in cells]).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.linalg.svd(x)[1][:2]
    got = np.array([r.components for r in learn.truncated_svd(df, "key", "cells", 8, 2).orderBy("key").collect()])
    assert np.linalg.norm(got, axis=0) == pytest.approx(s)


def test_lexicon(spark, work):
    parents = spark.createDataFrame([("dog", "canine"), ("canine", "animal"), ("cat", "feline"), ("feline", "animal")], "sense string, parent string")
    up = lexicon.ancestors(parents, work)
    got = lexicon.similarities(spark.createDataFrame([("dog", "cat"), ("dog", "dog"), ("dog", "x")], "a string, b string"), up)
    assert {(r.a, r.b): (r.path, r.wup) for r in got.collect()} == {("dog", "cat"): (0.2, pytest.approx(2 / 6)), ("dog", "dog"): (1.0, 1.0), ("dog", "x"): (None, None)}
    senses = spark.createDataFrame([("bank", "money", "a house that keeps money"), ("bank", "river", "land along a river"), ("cat", "cat", "a pet")], "lemma string, sense string, gloss string")
    texts = spark.createDataFrame([(1, ["river", "bank"]), (2, ["bank", "money"])], "id long, w array<string>")
    found = lexicon.disambiguate(texts, "id", F.col("w"), senses)
    assert {(r.id, r.word, r.sense) for r in found.collect()} == {(1, "bank", "river"), (2, "bank", "money")}
    one = found.filter("id = 1")
    both = lexicon.overall(one.withColumn("sense", F.lit("dog")), one.withColumn("sense", F.lit("cat")), "id", up).collect()
    assert both[0].similarity == pytest.approx((0.2 + 1 / 3) / 2 / 2)


def test_dictionary(spark):
    texts = spark.createDataFrame([(1, ["cats", "run", "x"]), (2, [])], "id long, w array<string>")
    lemmas = spark.createDataFrame([("cats", "cat", "NNS"), ("run", "run", "VB")], "word string, lemma string, tag string")
    assert {r.id: r.found for r in lexicon.look_up_words(texts, "id", F.col("w"), lemmas, "lemma").collect()} == {1: ["cat", "run", "x"], 2: []}
    assert {r.id: r.found for r in lexicon.look_up_words(texts, "id", F.col("w"), lemmas, "tag", ("N", "J")).collect()} == {1: ["cats"], 2: []}


def test_files(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text('id,qid1,qid2,question1,question2,is_duplicate\n1,2,3,"a ""b""\nc",,0\n')
    assert files.read_csv(spark, str(p), files.PAIRS_TRAIN).collect() == [(1, 2, 3, 'a "b"\nc', None, 0)]
    g = tmp_path / "glove.txt"
    g.write_text("the 0.5 1.0\n. . . 2.0 3.0\n")
    assert sorted(map(tuple, files.read_glove(spark, str(g), 2).collect())) == [(". . .", [2.0, 3.0]), ("the", [0.5, 1.0])]
    b = tmp_path / "w2v.bin"
    b.write_bytes(b"2 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + b"\n" for w, v in (("é", (1, 2, 3)), ("b", (4, 5, 6)))))
    assert sorted(map(tuple, files.read_word2vec(spark, str(b)).collect())) == [("b", [4.0, 5.0, 6.0]), ("é", [1.0, 2.0, 3.0])]
    assert files.word2vec_to_parquet(str(b), str(tmp_path / "w2v"), 1) == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w2v")).collect())) == [("b", [4.0, 5.0, 6.0]), ("é", [1.0, 2.0, 3.0])]
    files.write_npy(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>"), str(tmp_path / "npy"), "v")
    assert sorted(r.vec for r in files.read_npy(spark, str(tmp_path / "npy")).collect()) == [[1.0, 2.0], [3.0, 4.0]]
    np.save(tmp_path / "x.npy", np.arange(6).reshape(3, 2))
    assert [r.vec for r in files.read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    df = spark.createDataFrame([(1, 0.5, None, 1e-9), (0, -2.0, float("nan"), 3.0)], "y int, a double, b double, c double")
    files.write_sparse(df, str(tmp_path / "out"), ["a", "b", "c"], "y")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0 0:-2.000000 1:-1.000000 2:3.000000", "1 0:0.500000 1:-1.000000"]
    files.write_submission(spark.createDataFrame([(1, 0.5)], "test_id long, is_duplicate double"), str(tmp_path / "sub"))
    assert files.read_csv(spark, str(tmp_path / "sub"), "test_id long, is_duplicate double").collect() == [(1, 0.5)]


def test_arrivals(spark, tmp_path):
    rows_ = [(1, "2020-01-01 00:00:00"), (1, "2020-01-01 10:00:00"), (2, "2020-01-02 00:00:00")]
    df = spark.createDataFrame(rows_, "id long, t string").select("id", F.to_timestamp("t").alias("loaded_at"))
    df.write.parquet(str(tmp_path / "in"))
    got = []
    stream = arrivals.first_arrivals(arrivals.read_stream(spark, str(tmp_path / "in"), "id long, loaded_at timestamp"))
    arrivals.feed(stream, lambda b: got.extend(r.id for r in b.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(got) == [1, 2]


def test_semantic_similarity_chain(spark, work):
    words = spark.createDataFrame([(w, v) for w, v in (("bank", [1.0, 0.0]), ("cash", [0.9, 0.1]), ("river", [0.0, 1.0]), ("shore", [0.1, 0.9]), ("the", [0.7, 0.7]))], "word string, vec array<double>")
    senses, parents = lexicon.from_vectors(words, 2, work, 2)
    up = {r.sense: r.parent for r in parents.collect()}
    assert up == {"bank": "*", "cash": "bank", "river": "*", "shore": "river", "the": "*"} or all(p == "*" or p < s for s, p in up.items())
    assert {r.lemma: len(r.gloss.split()) for r in senses.collect()} == dict.fromkeys(up, 2)
    tags = spark.createDataFrame([("bank", "NN"), ("cash", "NN"), ("river", "NN"), ("shore", "VB"), ("the", "DT")], "word string, tag string")
    p = spark.createDataFrame([(1, ["the", "bank"], ["bank", "the"]), (2, ["the", "bank"], ["the", "cash"]), (3, ["the"], []), (4, None, ["bank"])], "id long, a array<string>, b array<string>")
    got = {r.id: r.similarity for r in lexicon.semantic_similarity(p, "id", F.col("a"), F.col("b"), tags, senses, parents, work).collect()}
    assert got[1] == pytest.approx(0.5) and 0 < got[2] < got[1] and got[3] == got[4] == 0.0


def test_gram_distances_leave_the_grams_where_they_lie(spark, work, monkeypatch):
    texts = [("abcabc", "abcd"), ("abc", "abc"), ("añ😀b", "xañ😀"), ("ab", ""), (None, "abcx"), ("zzzz", "yyy")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id long, q1 string, q2 string")
    count = lambda t: Counter(t[i : i + 3] for i in range(len(t or "") - 2))
    both = [(count(a), count(b)) for a, b in texts]
    n, freq = sum(bool(c) for x in both for c in x), Counter(g for x in both for c in x for g in c)
    weigh = lambda c: {g: k * (math.log((1 + n) / (1 + freq[g])) + 1) for g, k in c.items()}
    norm = lambda v: math.sqrt(sum(k * k for k in v.values()))
    away = lambda v, w, s, r: math.sqrt(sum(((v.get(g, 0) / s if s else 0) - (w.get(g, 0) / r if r else 0)) ** 2 for g in {*v, *w}))
    want = {}
    for i, (c, d) in enumerate(both):
        x, y = weigh(c), weigh(d)
        if x or y:
            cos = sum(x[g] * y.get(g, 0) for g in x) / (norm(x) * norm(y)) if x and y else 1
            want[i] = (1 - cos, away(x, y, norm(x), norm(y)), away(x, y, sum(x.values()), sum(y.values())), away(c, d, norm(c), norm(d)))
    for most in (1_000_000, 2):  # all weights at hand, or two of them and a join for the rest
        monkeypatch.setattr(corpus, "MOST_GRAMS", most)
        out = corpus.tfidf_distances(df, "id", F.col("q1"), F.col("q2"), 3, corpus.idf_smooth, work)
        assert {r[0]: tuple(r[1:]) for r in out.collect()} == {i: pytest.approx(v, abs=1e-7) for i, v in want.items()}
    monkeypatch.setattr(corpus, "AT_ONCE", 6)  # a batch in pieces
    pieces = list(corpus._gram_pairs(pa.RecordBatch.from_arrays([pa.array(t, pa.string()) for t in zip(*texts)], ["_a", "_b"]), 3))
    assert len(pieces) > 2 and sum(c.sum() for _, _, _, _, *cs in pieces for c in cs) == sum(sum(c.values()) for x in both for c in x)


def test_kcore_in_rounds_and_in_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 60, (260, 2)) ** 2 // 60 if a != b} | {(i, i + 1) for i in range(100, 130)} | {(200 + i, 200 + j) for i in range(9) for j in range(i)}
    adj = defaultdict(set)
    for a, b in links:
        adj[a].add(b)
        adj[b].add(a)
    want, live, k = {}, {v: set(n) for v, n in adj.items()}, 0
    while live:
        v = min(live, key=lambda u: len(live[u]))
        k = max(k, len(live[v]))
        want[v] = k
        for u in live.pop(v):
            live[u].discard(v)
    e = graph.both_ways(spark.createDataFrame(list(links), "a long, b long"), "a", "b")
    for small in (graph.SMALL, -1):
        monkeypatch.setattr(graph, "SMALL", small)
        out = graph.kcore(e, Workspace(spark, "kcore"))
        assert dict(map(tuple, out.collect())) == want and out.count() == len(want)
    assert graph.kcore(e.limit(0), Workspace(spark, "kcore")).count() == 0
    jobs = []
    monkeypatch.setattr(graph, "SMALL", 64_000_000)
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, f=Workspace.save: jobs.append(name) or f(self, df, name))
    graph.kcore(e, Workspace(spark, "kcore"))
    assert jobs == ["edges-0", "core-0", "edges-1"]  # no rounds for what fits into a task


def test_semantic_similarity_of_a_lexicon_at_hand_and_of_a_joined_one(spark, monkeypatch):
    senses = spark.createDataFrame([("bank", "money", "a house that keeps money"), ("bank", "river", "land along a river"), ("cat", "cat", "a pet"), ("money", "money", "what a bank keeps"), ("river", "stream", "water"), ("pet", "alone", "a cat")], "lemma string, sense string, gloss string")
    parents = spark.createDataFrame([("money", "thing"), ("river", "land"), ("land", "thing"), ("stream", "land"), ("cat", "animal")], "sense string, parent string")
    tags = spark.createDataFrame([(w, "NN") for w in ("bank", "cat", "money", "river", "house", "pet")] + [("the", "DT")], "word string, tag string")
    texts = [(["the", "bank", "river"], ["money", "bank"]), (["cat", "cat", "bank"], ["bank", "cat", "pet", "x"]), (["the"], ["cat"]), ([], []), (None, ["bank"]), (["pet"], ["pet"]), (["river"], ["river", "house"])]
    p = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, a array<string>, b array<string>")
    got = []
    for small in (lexicon.SMALL, (0, 0)):
        monkeypatch.setattr(lexicon, "SMALL", small)
        out = lexicon.semantic_similarity(p, "id", F.col("a"), F.col("b"), tags, senses, parents, Workspace(spark, "chain"))
        got.append({r.id: round(r.similarity, 9) for r in out.collect()})
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (small == (0, 0))
    assert got[0] == got[1] and len(got[0]) == len(texts) and got[0][0] > 0 and got[0][5] == 0 and got[0][6] == 0.5
