import itertools
import os
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import lookalike, mix, tokens
from pairloom.plans.work import Workspace

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer here")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", None, " ", "\n\n", "Hello  world", "aaaaaaaaaaa", "ababababab aba", "<|endoftext|> x", "I'll don't", "naïve façade 日本語 हिन्दी", "😀👍🏽‍", "x" * 30_000, "word " * 20_000, "\x1c\x85  a"]


@needs
@pytest.mark.parametrize("most, remembered", [(100_000, 1_000_000), (2, 3), (0, 0)])
def test_ids_equal_the_library(spark, monkeypatch, most, remembered):
    monkeypatch.setattr(tokens, "MOST", most)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    lib = library()
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()}
    assert got == {i: lib(t) if t else [] for i, t in enumerate(TEXTS)}
    n = {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokens.token_ids(df.limit(0)).collect() == []


@needs
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("aabt heT'\n 's")), max_size=40), max_size=5))
def test_replay_of_any_texts(texts):
    enc, lib = tokens._encoder(tokens.read_vocabulary(PATH)), library()
    flat, sizes = enc.encode(texts)
    at = list(itertools.accumulate([0, *sizes]))
    assert [flat[a:b] for a, b in itertools.pairwise(at)] == [lib(t) if t else [] for t in texts]


@needs
def test_cutting_agrees_where_it_is_said_to():
    enc = tokens._encoder(tokens.read_vocabulary(PATH))
    for cp in range(0x110000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or enc._unsure(c):
            continue
        s = f"ab1{c}{c}c 2 {c}"
        assert enc.cut(s) == [s[a:b] for _, (a, b) in enc._library.pre_tokenize_str(s)], hex(cp)


def test_sainte_lague():
    assert mix.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mix.sainte_lague({"a": 0.5, "b": 0.5}, 10, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert mix.sainte_lague({"a": 0.5}, 10, {"a": 3}) == {"a": 3}
    assert mix.sainte_lague({}, 5) == {}


@needs
def test_mix_reaches_targets_within_caps(spark):
    docs = [(i, "big", "some words of a text " * 3) for i in range(400)] + [(1000 + i, "small", "other words here") for i in range(10)] + [(2000, None, "x y z"), (2001, "none", "x y z"), (2002, "big", None), (2003, "big", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("shard", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 3), ("small", 0.5, 4), ("absent", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    assert sorted(r.source for r in mix.short_sources(df, targets, Workspace(spark, "t")).collect()) == ["absent", "small"]
    used = mix.mix(df, targets, Workspace(spark, "t")).collect()
    assert len({r.doc_id for r in used}) == len(used)
    assert all(1 <= r.uses <= {"big": 3, "small": 4}[r.source] for r in used)
    assert {r.source for r in used} == {"big", "small"}
    small = sum(r.tokens * r.uses for r in used if r.source == "small")
    assert small >= 0.9 * 4 * sum(r.tokens for r in used if r.source == "small")
    told = {r.source: r for r in mix.shares(df, targets, Workspace(spark, "t")).collect()}
    assert told["absent"].used_tokens == 0 and told["big"].share + told["small"].share == pytest.approx(1, abs=1e-5)


def test_sainte_lague_with_very_many_seats():
    got = mix.sainte_lague({"a": 5, "b": 3, "c": 2, "d": 0}, 10**11 + 1, {"a": 10**12, "b": 10**10, "c": 10**12, "d": 5})
    assert got["b"] == 10**10 and sum(got.values()) == 10**11 + 1 and got["d"] == 0
    assert abs(got["a"] / got["c"] - 2.5) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 50), st.integers(0, 30)), max_size=6), st.integers(0, 120))
def test_sainte_lague_gives_the_highest_quotients(weights, seats):
    w, most = {k: v[0] for k, v in weights.items()}, {k: v[1] for k, v in weights.items()}
    quotients = sorted((-w[k] / (2 * i + 1), k, i) for k in w if w[k] for i in range(most[k]))[:seats]
    assert mix.sainte_lague(w, seats, most) == {k: sum(x[1] == k for x in quotients) for k in w}


@needs
def test_mix_where_blocks_are_far_more_than_a_shard_holds(spark, monkeypatch):
    # 40 shards and more a source, and 10,000 blocks would each be larger than a shard
    for name, value in (("SHARD", 200), ("BLOCKS", 20)):
        monkeypatch.setattr(mix, name, value)
    docs = [(i, "big" if i % 4 else "small", "some words of a text " * (1 + i % 3)) for i in range(2000)] + [(5000, "big", "a very long one " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    told = {r.source: r for r in mix.shares(df, targets, Workspace(spark, "t")).collect()}
    whole = sum(r.used_tokens for r in told.values())
    assert whole > 0.97 * sum(r.tokens for r in tokens.token_counts(df).collect())
    assert told["small"].share == pytest.approx(0.4, abs=0.01) and told["small"].most_uses <= 3


@needs
def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix.mix(df, targets, Workspace(spark, "t")).collect() == []
    assert mix.short_sources(df, targets, Workspace(spark, "t")).collect() == []


SAME = [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"),
    ("café", "café"),
    ("ze​ro wi­dth﻿", "zero width"),
    ("a b c", "a b c"),
    ("Соѕtу", "Costy"),
    ("пό", "пó"),
    ("ό", "ό"),
    ("ё", "ë"),
    ("ﬁne oﬃce", "fine office"),
    ("金", "金"),
    ("ｶﾞ", "ガ"),
    ("e​́", "é"),
]
OTHER = [("x2", "x²"), ("resume", "résumé"), ("a b", "a  b"), ("cat", "Cat"), ("1a", "la"), ("a\nb", "a b"), ("👨‍👩", "👨👩"), ("и", "n"), ("o", "0")]


@pytest.fixture(scope="module")
def forms(spark):
    ts = sorted({t for p in SAME + OTHER for t in p})
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.id: r.form for r in lookalike.printed_forms(df).collect()}
    return {t: got[i] for i, t in enumerate(ts)}


def test_same_and_other(forms):
    assert [p for p in SAME if forms[p[0]] != forms[p[1]]] == []
    assert [p for p in OTHER if forms[p[0]] == forms[p[1]]] == []
    assert all(unicodedata.normalize("NFC", f) == f for f in forms.values())


def test_pairs_nulls_copies_and_long(spark):
    long = "word " * 20_000
    rows = [(1, "ab c"), (2, "ab c"), (3, "ab c"), (4, None), (5, ""), (6, "​"), (7, "１２"), (8, "12"), (9, long), (10, long + "​"), (None, "ａb c"), (3, "ab c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(map(tuple, lookalike.same_in_print(df, Workspace(spark, "t")).collect()))
    assert got == [(1, 3), (2, 3), (9, 10)]
    assert lookalike.same_in_print(df.limit(0), Workspace(spark, "t")).collect() == []
