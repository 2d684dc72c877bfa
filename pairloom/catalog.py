"""Queries of the core operators and their SQL, by name. Every query runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import clean, edit, fixed, grams, lengths, sets, stem
from .functions import text as tx
from .functions import vectors as V
from .operators import corpus, embed, graph, learn, lexicon, rows, skew
from .plans.work import Workspace
from .sources import files
from .sources.tables import one_per_id, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


def pairs(spark, d):
    """(id, q1, q2, label) of every record of train; null texts are empty."""
    one = one_per_id(table(spark, d, "train", "id", "question1", "question2", "is_duplicate"))
    return one.select("id", F.coalesce("question1", F.lit("")).alias("q1"), F.coalesce("question2", F.lit("")).alias("q2"), F.col("is_duplicate").alias("label"))


def token_pairs(spark, d, lower: bool = True):
    q = (lambda c: F.lower(c)) if lower else F.col
    return pairs(spark, d).select("id", "q1", "q2", "label", tx.tokens(q("q1")).alias("a"), tx.tokens(q("q2")).alias("b"))


def bound(df, fn, names: dict, *cols: str):
    """``df``'s id and the named results of ``fn(*cols)``; the columns are computed once per row."""
    whole = tx.let(lambda *c: F.struct(*[e.alias(n) for n, e in zip(names, fn(*c))]), *[F.col(c) for c in cols])
    return df.select("id", whole.alias("_x")).select("id", *[f"_x.{n}" for n in names])


P = """P AS (SELECT id, coalesce(question1, '') AS q1, coalesce(question2, '') AS q2, is_duplicate AS label
FROM (SELECT DISTINCT id, question1, question2, is_duplicate FROM train))"""
TOK = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
T = f"{P}, T AS (SELECT id, q1, q2, label, {TOK.format('lower(q1)')} AS a, {TOK.format('lower(q2)')} AS b FROM P)"
SAME = "coalesce(list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: y = x)))), 0)"
STOPS = "['" + "', '".join(w.replace("'", "''") for w in fixed.ENGLISH_STOPS) + "']"


def sql_chain(expr: str, rules: list[tuple[str, str]]) -> str:
    q = lambda s: s.replace("'", "''")
    for p, to in rules:
        expr = f"regexp_replace({expr}, '{q(p)}', '{q(to.replace('$1', chr(92) + '1'))}', 'g')"
    return expr


# ---- per-key results


def _p7(spark, d):
    p = one_per_id(table(spark, d, "train", "id", "qid1", "qid2", "is_duplicate"))
    return p, skew.per_key_results(p, "id", "qid1", "qid2", "is_duplicate")


_LONG = """WITH o AS (SELECT DISTINCT id, qid1, qid2, is_duplicate FROM train), k AS (
SELECT qid1 AS qid, qid2 AS partner, is_duplicate FROM o WHERE qid1 IS NOT NULL
UNION ALL SELECT qid2, qid1, is_duplicate FROM o WHERE qid2 IS NOT NULL AND qid1 IS DISTINCT FROM qid2)"""


@query(f"""{_LONG} SELECT qid, count(*) AS pairs, CAST(count(*) FILTER (is_duplicate = 1) AS BIGINT) AS positive,
count(DISTINCT partner) AS partners, round(count(*) FILTER (is_duplicate = 1) / count(*), 6) AS positive_rate FROM k GROUP BY qid""")
def p7_results(spark, d):
    """Pairs, positive labels and partners of every question id."""
    return _p7(spark, d)[1].withColumnRenamed("key", "qid")


@query(f"{_LONG} SELECT qid FROM k GROUP BY qid HAVING count(*) >= 0.02 * (SELECT count(*) FROM o)")
def p7_found(spark, d):
    """Question ids in at least 2 % of the records."""
    p, results = _p7(spark, d)
    return results.filter(results.pairs >= 0.02 * p.count()).select(results.key.alias("qid"))


# ---- cleaning and tokens

_V1 = lambda c: "array_to_string(list_filter({}, lambda x: x NOT IN ({})), ' ')".format(TOK.format(f"regexp_replace({sql_chain(c, fixed.CLEAN_V1)}, '{fixed.PUNCTUATION}', '', 'g')"), ", ".join(f"'{w}'" for w in fixed.CLEAN_STOPS))
_V2 = lambda c: "array_to_string(list_filter({}, lambda x: x NOT IN ({})), ' ')".format(TOK.format(f"regexp_replace({sql_chain(c, fixed.CLEAN_V2)}, '{fixed.PUNCTUATION}', '', 'g')"), ", ".join(f"'{w}'" for w in fixed.CLEAN_STOPS))
_V4 = lambda c: sql_chain(f"array_to_string({TOK.format(f'lower({c})')}, ' ')", fixed.CLEAN_SEQUENCE)


@query(f"WITH {P} SELECT id, {_V1('q1')} AS c1, {_V1('q2')} AS c2 FROM P")
def clean_v1(spark, d):
    return pairs(spark, d).select("id", clean.clean_v1(F.col("q1")).alias("c1"), clean.clean_v1(F.col("q2")).alias("c2"))


@query(f"WITH {P} SELECT id, {_V2('q1')} AS c1, {_V2('q2')} AS c2 FROM P")
def clean_v2(spark, d):
    return pairs(spark, d).select("id", clean.clean_v2(F.col("q1")).alias("c1"), clean.clean_v2(F.col("q2")).alias("c2"))


@query(f"WITH {P} SELECT id, {_V4('q1')} AS c1, {_V4('q2')} AS c2 FROM P")
def clean_sequence(spark, d):
    return pairs(spark, d).select("id", clean.clean_sequence(F.col("q1")).alias("c1"), clean.clean_sequence(F.col("q2")).alias("c2"))


_DOC = lambda c: rf"list_transform(list_filter(regexp_extract_all(regexp_replace({c}, '[^a-zA-Z0-9 \n\.]', ' ', 'g'), '[A-Za-z0-9_]+'), lambda w: length(w) >= 2 AND NOT list_contains({STOPS}, w)), lambda w: lower(w))"


@query(f"WITH {P} SELECT id, array_to_string({_DOC('q1')}, ' ') AS w1, array_to_string({_DOC('q2')}, ' ') AS w2 FROM P")
def document_words(spark, d):
    said = lambda c: F.array_join(clean.document_words(F.col(c)), " ")
    return pairs(spark, d).select("id", said("q1").alias("w1"), said("q2").alias("w2"))


_PLAIN = lambda c: f"array_to_string(list_filter(regexp_extract_all(lower({c}), '{tx.ALPHABETIC}'), lambda w: length(w) BETWEEN 2 AND 15 AND w[1] <> '_'), ' ')"
_VECTORIZED = lambda c: rf"array_to_string(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{Nd}}_]{{2,}}'), lambda w: NOT list_contains({STOPS}, w)), ' ')"


@query(f"WITH {P} SELECT id, {_PLAIN('q1')} AS plain1, {_PLAIN('q2')} AS plain2, {_VECTORIZED('q1')} AS vectorized1, {_VECTORIZED('q2')} AS vectorized2 FROM P")
def tokenizers(spark, d):
    """Plain words, and words of two or more characters without stop words; the list of stop words is a parameter."""
    said = lambda f, *more: [F.array_join(f(F.col(q), *more), " ").alias(f"{f.__name__.split('_')[0].replace('vectorizer', 'vectorized')}{q[1]}") for q in ("q1", "q2")]
    return pairs(spark, d).select("id", *said(tx.plain_words), *said(tx.vectorizer_words, fixed.ENGLISH_STOPS))


@query(f"WITH {P} SELECT id, array_to_string(string_split(q1, ''), ' ') AS x1, array_to_string(string_split(q2, ''), ' ') AS x2 FROM P")
def spaced_characters(spark, d):
    """The characters of a text, a blank between."""
    said = lambda c: F.array_join(tx.chars(F.col(c)), " ")
    return pairs(spark, d).select("id", said("q1").alias("x1"), said("q2").alias("x2"))


@query(f"""WITH {T} SELECT id, CAST(length(q1) AS INTEGER) AS len1, CAST(length(q2) AS INTEGER) AS len2, CAST(len(a) AS INTEGER) AS words1, CAST(len(b) AS INTEGER) AS words2,
CAST(strlen(q1) AS INTEGER) AS bytes1 FROM T""")
def tokens_len(spark, d):
    return token_pairs(spark, d).select("id", F.length("q1").alias("len1"), F.length("q2").alias("len2"), F.size("a").alias("words1"), F.size("b").alias("words2"), F.octet_length("q1").alias("bytes1"))


# ---- overlap

_SHARE = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE (len(list_filter({a}, lambda x: list_contains({b}, x))) + len(list_filter({b}, lambda x: list_contains({a}, x)))) / (len({a}) + len({b})) END"


@query(f"""WITH {T}, S AS (SELECT id, list_filter(list_distinct(a), lambda x: NOT list_contains({STOPS}, x)) AS a, list_filter(list_distinct(b), lambda x: NOT list_contains({STOPS}, x)) AS b FROM T)
SELECT id, round({_SHARE.format(a='a', b='b')}, 6) AS share FROM S""")
def word_match_share(spark, d):
    """Shared words of the two sets without stop words."""
    less = lambda c: F.filter(F.array_distinct(c), lambda w: ~w.isin(fixed.ENGLISH_STOPS))
    df = token_pairs(spark, d).select("id", less("a").alias("a"), less("b").alias("b"))
    return bound(df, lambda a, b: [r(sets.word_match_share(a, b))], {"share": 0}, "a", "b")


@query(f"""WITH {P}, T AS (SELECT id, {TOK.format('q1')} AS a, {TOK.format('q2')} AS b FROM P)
SELECT id, round({_SHARE.format(a='a', b='b')}, 6) AS share, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS INTEGER) AS matches,
array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS only1, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS only2 FROM T""")
def word_match_bag(spark, d):
    """Share, match count and words of one side only, for the bags of words as written."""
    df = token_pairs(spark, d, lower=False)
    out = lambda a, b: [r(sets.word_match_share(a, b)), sets.match_count(a, b), F.array_join(sets.only_in(a, b), " "), F.array_join(sets.only_in(b, a), " ")]
    return bound(df, out, {"share": 0, "matches": 0, "only1": 0, "only2": 0}, "a", "b")


def _bag_sql(a: str, b: str, source: str) -> str:
    return f"""WITH {T}, G AS (SELECT id, {a} AS a, {b} AS b FROM {source}), S AS (SELECT id, {SAME.format(a='a', b='b')} AS same, len(a) AS n1, len(b) AS n2 FROM G)
SELECT id, round(same / ((n1 + n2 + 1 - same) + 1e-6), 6) AS jaccard, round(2 * same / ((n1 + n2 + 1) + 1e-6), 6) AS dice, round(same / (sqrt(n1 * n2 + 1) + 1e-6), 6) AS ochiai FROM S"""


def _bag(df):
    return bound(df, lambda a, b: [r(sets.bag_jaccard(a, b)), r(sets.bag_dice(a, b)), r(sets.bag_ochiai(a, b))], {"jaccard": 0, "dice": 0, "ochiai": 0}, "a", "b")


@query(_bag_sql("a", "b", "T"))
def bag_metrics(spark, d):
    return _bag(token_pairs(spark, d))


def _grams(n: int):
    g = f"list_transform(range(1, len({{}}) - {n} + 2), lambda i: array_to_string({{}}[i : i + {n - 1}], ' '))"

    def f(spark, d):
        df = token_pairs(spark, d)
        return _bag(df.select("id", tx.word_ngrams(F.col("a"), n).alias("a"), tx.word_ngrams(F.col("b"), n).alias("b")))

    f.__name__ = f"ngram_word{n}"
    query(_bag_sql(g.format("a", "a"), g.format("b", "b"), "T"))(f)


_grams(2)
_grams(3)

_CHARS = "list_transform(range(1, length({q}) - {n} + 2), lambda i: substr({q}, i, {n}))"


_ONE_BLANK = lambda q: f"regexp_replace(lower({q}), '{tx.BLANKS}', ' ', 'g')"


def _gram_sql(n: int, select: str, counted: bool = False) -> str:
    """Grams of the texts in lower case; with ``counted`` runs of blanks are one, as counting vectorizers have it."""
    side = lambda q, s: f"SELECT id, unnest({_CHARS.format(q=_ONE_BLANK(q) if counted else f'lower({q})', n=n)}) AS token, {s} AS s FROM P"
    return f"""WITH {P}, X AS ({side('q1', 1)} UNION ALL {side('q2', 2)}),
L AS (SELECT id, token, count(*) FILTER (s = 1) AS c1, count(*) FILTER (s = 2) AS c2 FROM X GROUP BY ALL) {select}"""


def _char_grams(n: int):
    def counted(spark, d, form=lambda c: c):
        return pairs(spark, d).select("id", grams.gram_counts(form(F.lower("q1")), form(F.lower("q2")), n).alias("g")).select("id", "g.*")

    def bags(spark, d):
        tot, same = F.col("n1") + F.col("n2") + 1, F.col("same")
        return counted(spark, d).select(
            "id", r(same / ((tot - same) + 1e-6)).alias("jaccard"), r(2 * same / (tot + 1e-6)).alias("dice"), r(same / (F.sqrt(F.col("n1") * F.col("n2") + 1) + 1e-6)).alias("ochiai")
        )

    bags.__name__ = f"ngram_char{n}"
    query(_gram_sql(n, """, S AS (SELECT P.id, coalesce(sum(c1 * c2), 0) AS same, coalesce(sum(c1), 0) AS n1, coalesce(sum(c2), 0) AS n2 FROM P LEFT JOIN L USING (id) GROUP BY P.id)
SELECT id, round(same / ((n1 + n2 + 1 - same) + 1e-6), 6) AS jaccard, round(2 * same / ((n1 + n2 + 1) + 1e-6), 6) AS dice, round(same / (sqrt(n1 * n2 + 1) + 1e-6), 6) AS ochiai FROM S"""))(bags)

    def overlaps(spark, d):
        return counted(spark, d, tx.one_blank).select(
            "id", r(F.try_divide("common", "either")).alias("set_jaccard"), r(F.try_divide("lesser", F.col("n1") + F.col("n2"))).alias("min_over_sum"), r(F.try_divide("lesser", "greater")).alias("ruzicka")
        )

    overlaps.__name__ = f"gram_overlap{n}"
    query(_gram_sql(n, """SELECT P.id, round(count(*) FILTER (c1 > 0 AND c2 > 0) / nullif(count(token), 0), 6) AS set_jaccard,
round(sum(least(c1, c2)) / nullif(sum(c1 + c2), 0), 6) AS min_over_sum, round(sum(least(c1, c2)) / nullif(sum(greatest(c1, c2)), 0), 6) AS ruzicka FROM P LEFT JOIN L USING (id) GROUP BY P.id""", counted=True))(overlaps)


for _n in (1, 2, 3):
    _char_grams(_n)

_IDF_SQL = """, N AS (SELECT count(DISTINCT id) FILTER (c1 > 0) + count(DISTINCT id) FILTER (c2 > 0) AS n FROM L),
D AS (SELECT token, ln((1 + (SELECT n FROM N)) / (1 + sum(CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT)))) + 1 AS idf FROM L GROUP BY token),
W AS (SELECT id, c1, c2, c1 * idf AS x, c2 * idf AS y FROM L JOIN D USING (token)) """


@query(_gram_sql(3, _IDF_SQL + """, Z AS (SELECT id, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, sum(x) AS sx, sum(y) AS sy, sqrt(sum(c1 * c1)) AS nc, sqrt(sum(c2 * c2)) AS nd FROM W GROUP BY id)
SELECT id, round(1 - coalesce(sum(x * y) / nullif(any_value(nx) * any_value(ny), 0), 1), 6) AS cosine_distance,
round(sqrt(sum(pow(coalesce(x / nullif(nx, 0), 0) - coalesce(y / nullif(ny, 0), 0), 2))), 6) AS l2_tfidf,
round(sqrt(sum(pow(coalesce(x / nullif(sx, 0), 0) - coalesce(y / nullif(sy, 0), 0), 2))), 6) AS l1_tfidf,
round(sqrt(sum(pow(coalesce(c1 / nullif(nc, 0), 0) - coalesce(c2 / nullif(nd, 0), 0), 2))), 6) AS l2_tf FROM W JOIN Z USING (id) GROUP BY id""", counted=True))
def gram_tfidf(spark, d):
    """Distances of the tf-idf vectors of character trigrams."""
    text = lambda c: tx.one_blank(F.lower(c))
    out = corpus.tfidf_distances(pairs(spark, d), "id", text("q1"), text("q2"), 3, corpus.idf_smooth, Workspace(spark, "grams"))
    return out.select("id", *[r(F.abs(c) if c == "-" else F.col(c)).alias(c) for c in out.columns[1:]])


def _word_long(spark, d):
    df = token_pairs(spark, d)
    return df, corpus.pair_tokens(df, "id", F.col("a"), F.col("b"))


_WORD_L = f"""WITH {T}, X AS (SELECT id, unnest(a) AS token, 1 AS s FROM T UNION ALL SELECT id, unnest(b), 2 FROM T),
L AS (SELECT id, token, count(*) FILTER (s = 1) AS c1, count(*) FILTER (s = 2) AS c2 FROM X GROUP BY ALL)"""
_LOG2 = _IDF_SQL.replace("ln((1 + (SELECT n FROM N)) / (1 + sum(CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT)))) + 1", "log2((SELECT n FROM N) / sum(CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT)))")


@query(_WORD_L + _LOG2 + "SELECT id, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0), 6) AS similarity FROM W GROUP BY id")
def tfidf_cosine(spark, d):
    """Cosine of the words' tf-idf vectors with log2(n / df)."""
    w = corpus.weighted_pairs(_word_long(spark, d)[1], "id", corpus.idf_log2)
    x, y = F.col("c1") * F.col("idf"), F.col("c2") * F.col("idf")
    cos = F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))
    return w.groupBy("id").agg(r(F.coalesce(cos, F.lit(0.0))).alias("similarity"))


@query(_WORD_L + _IDF_SQL + """SELECT id, round(coalesce(sum(x) / nullif(sqrt(sum(x * x)), 0), 0), 6) AS sum1, round(coalesce(sum(x) / nullif(sqrt(sum(x * x)), 0) / count(*) FILTER (x > 0), 0), 6) AS mean1, count(*) FILTER (x > 0) AS len1,
round(coalesce(sum(y) / nullif(sqrt(sum(y * y)), 0), 0), 6) AS sum2, round(coalesce(sum(y) / nullif(sqrt(sum(y * y)), 0) / count(*) FILTER (y > 0), 0), 6) AS mean2, count(*) FILTER (y > 0) AS len2 FROM W GROUP BY id""")
def tfidf_row_stats(spark, d):
    out = corpus.tfidf_row_stats(corpus.weighted_pairs(_word_long(spark, d)[1], "id", corpus.idf_smooth), "id")
    return out.select("id", *[F.col(c) if c.startswith("len") else r(F.col(c)).alias(c) for c in out.columns[1:]])


_COUNTS = "C AS (SELECT word, count(*) AS n FROM (SELECT unnest(a) AS word FROM T UNION ALL SELECT unnest(b) FROM T) GROUP BY word), V AS (SELECT word, n, CASE WHEN n < 2 THEN 0.0 ELSE 1 / (n + 10000.0) END AS weight FROM C)"


def _weights(df):
    return corpus.inverse_weights(corpus.word_counts(df.select(F.explode(F.array("q1", "q2")).alias("text"))))


@query(f"WITH {T}, {_COUNTS} SELECT word, n, round(weight, 12) AS weight FROM V")
def word_weights(spark, d):
    out = _weights(pairs(spark, d))
    return out.select("word", "n", r("weight", 12).alias("weight"))


@query(_WORD_L + f", {_COUNTS} SELECT id, round(coalesce(sum(weight * (c1 + c2)) FILTER (c1 > 0 AND c2 > 0) / nullif(sum(weight * (c1 + c2)), 0), 0), 6) AS share FROM L JOIN V ON token = word GROUP BY id")
def tf_weight_share(spark, d):
    df, long = _word_long(spark, d)
    return corpus.weight_share(long, "id", _weights(df)).select("id", r("share").alias("share"))


@query(_WORD_L + f", {_COUNTS} SELECT id, round(sum(2 * exp(weight) * c1 * c2) / (sum(exp(weight) * (c1 + c2)) + 1e-6), 6) AS overlap FROM L JOIN V ON token = word GROUP BY id")
def weighted_overlap(spark, d):
    df, long = _word_long(spark, d)
    return corpus.weighted_overlap(long, "id", _weights(df)).select("id", r("overlap").alias("overlap"))


@query(_WORD_L + """, N AS (SELECT count(DISTINCT (id, s)) AS n FROM X), F AS (SELECT token, sum(CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT)) AS df FROM L GROUP BY token)
SELECT token, CAST(df AS BIGINT) AS df, round(log2(n / df), 6) AS idf, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf_smooth FROM F, N""")
def document_frequency(spark, d):
    df = token_pairs(spark, d)
    docs = df.select("id", F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("t")), F.struct(F.lit(2).alias("s"), F.col("b").alias("t")))).alias("x")).select("id", "x.s", "x.t")
    t = corpus.document_frequency(corpus.token_table(docs, ["id", "s"], F.col("t")), ["id", "s"])
    n, k = F.col("n_docs"), F.col("df")
    return t.select("token", "df", r(corpus.idf_log2(k, n)).alias("idf"), r(corpus.idf_smooth(k, n)).alias("idf_smooth"))


_VOCAB = f"""WITH {P}, Q AS (SELECT DISTINCT {_ONE_BLANK('t')} AS t FROM (SELECT q1 AS t FROM P UNION ALL SELECT q2 FROM P)),
G AS (SELECT t, unnest(list_concat({_CHARS.format(q='t', n=1)}, {_CHARS.format(q='t', n=2)}, {_CHARS.format(q='t', n=3)})) AS gram FROM Q),
V AS (SELECT gram, count(*) AS n, count(DISTINCT t) AS df FROM G GROUP BY gram), K AS (SELECT gram FROM V WHERE df >= 1000 AND df <= 0.999 * (SELECT count(*) FROM Q) ORDER BY n DESC, gram LIMIT 400)"""


@query(_VOCAB + " SELECT gram FROM K")
def gram_vocabulary(spark, d):
    """The 400 most frequent character grams that are neither rare nor everywhere."""
    t = pairs(spark, d).select(F.explode(F.array("q1", "q2")).alias("text"))
    return spark.createDataFrame([(g,) for g in corpus.top_grams(t, (1, 2, 3), 400, 1000, 0.999)], "gram string")


@query(_VOCAB + ", A AS (SELECT coalesce(list(gram ORDER BY gram), []) AS g FROM K) SELECT id, array_to_string(list_transform(g, lambda x: CAST(-CAST(contains(" + _ONE_BLANK('q1') + ", x) <> contains(" + _ONE_BLANK('q2') + ", x) AS INT) AS VARCHAR)), ' ') AS mismatch FROM P, A")
def bag_mismatch(spark, d):
    df = pairs(spark, d)
    kept = corpus.top_grams(df.select(F.explode(F.array("q1", "q2")).alias("text")), (1, 2, 3), 400, 1000, 0.999)
    if not kept:
        return df.select("id", F.lit("").alias("mismatch"))
    m = grams.mismatch(sorted(kept), tx.one_blank(F.lower("q1")), tx.one_blank(F.lower("q2")))
    return df.select("id", F.array_join(F.transform(m, lambda x: x.cast("string")), " ").alias("mismatch"))


# ---- lengths

_LEN = """WITH {base}, C AS (SELECT id, q1, q2, {a} AS a, {b} AS b FROM {source}),
U AS (SELECT *, list_distinct(a) AS ua, list_distinct(b) AS ub, list_distinct(list_concat(a, b)) AS uu FROM C),
N AS (SELECT *, len(a) AS n1, len(b) AS n2, len(ua) AS u1, len(ub) AS u2, len(list_filter(ua, lambda x: NOT list_contains({stops}, x))) AS s1, len(list_filter(ub, lambda x: NOT list_contains({stops}, x))) AS s2 FROM U)
SELECT id, CAST(len(uu) AS INT) AS total_unique, CAST(len(list_filter(uu, lambda x: NOT list_contains({stops}, x))) AS INT) AS total_unique_stop, CAST(abs(n1 - n2) AS INT) AS wc_diff, round({wc}, 6) AS wc_ratio,
CAST(abs(u1 - u2) AS INT) AS wc_diff_unique, round({wu}, 6) AS wc_ratio_unique, CAST(abs(s1 - s2) AS INT) AS wc_diff_unique_stop, round({ws}, 6) AS wc_ratio_unique_stop,
CASE WHEN n1 > 0 AND n2 > 0 THEN CAST(a[1] = b[1] AS INT) END AS same_start, CAST(abs(length(q1) - length(q2)) AS INT) AS char_diff, round({wq}, 6) AS char_ratio, CAST(abs(s1 - s2) AS INT) AS char_diff_unique_stop FROM N"""
_RATIO = "CASE WHEN {y} = 0 THEN NULL WHEN {x} = 0 THEN 0.0 ELSE {y} / {x} END"


def _len_sql(base, source, a, b):
    ra = {k: _RATIO.format(x=x, y=y) for k, x, y in (("wc", "n1", "n2"), ("wu", "u1", "u2"), ("ws", "s1", "s2"), ("wq", "length(q1)", "length(q2)"))}
    return _LEN.format(base=base, source=source, a=a, b=b, stops=STOPS, **ra)


def _lengths(df, unit):
    names = lengths.features(F.col("q1"), F.col("q2"), [], unit)
    fn = lambda a, b: [r(e) if "ratio" in n else e for n, e in lengths.features(a, b, fixed.ENGLISH_STOPS, unit).items()]
    return bound(df, fn, names, "q1", "q2")


@query(_len_sql(P, "P", _CHARS.format(q="q1", n=1), _CHARS.format(q="q2", n=1)))
def char_stats(spark, d):
    """Twelve length features by characters."""
    return _lengths(pairs(spark, d), tx.chars)


@query(_len_sql(T, "T", "a", "b").replace("length(q1)", "length(lower(q1))").replace("length(q2)", "length(lower(q2))"))
def word_stats(spark, d):
    """The same features by words."""
    return _lengths(pairs(spark, d).select("id", F.lower("q1").alias("q1"), F.lower("q2").alias("q2")), tx.tokens)


# ---- edit, sequence and hash distances

# The SQL function counts bytes: each character of a pair that has several is put as a control character that neither text has.
_ONE_BYTE = "translate({}, array_to_string(w, ''), substr(array_to_string(f, ''), 1, len(w)))"


@query(f"""WITH {P}, W AS (SELECT id, q1, q2, list_distinct(list_filter(string_split(q1 || q2, ''), lambda c: strlen(c) > 1)) AS w,
list_filter(list_transform(range(1, 128), lambda i: chr(i::INTEGER)), lambda c: NOT contains(q1 || q2, c)) AS f FROM P),
A AS (SELECT id, CAST(levenshtein({_ONE_BYTE.format('q1')}, {_ONE_BYTE.format('q2')}) AS INT) AS d FROM W) SELECT id, d AS distance, round(CASE WHEN d = 0 THEN 0 ELSE 1 / d END, 6) AS inverse FROM A""")
def levenshtein_distance(spark, d):
    """Distance and its inverse of the whole texts, by code points."""
    df = pairs(spark, d)
    return df.select("id", F.levenshtein("q1", "q2").alias("distance"), r(edit.inverse_distance(F.col("q1"), F.col("q2"))).alias("inverse"))


@query()
def edit_ratio(spark, d):
    return pairs(spark, d).select("id", r(edit.edit_ratio("q1", "q2")).alias("ratio"))


@query()
def sequence_ratio(spark, d):
    return pairs(spark, d).select("id", r(edit.sequence_ratio("q1", "q2")).alias("ratio"))


_BITS = "list_transform(range(0, 64), lambda i: CASE WHEN coalesce(list_sum(list_transform({h}, lambda m: CASE WHEN (('0x' || m[17 + 4 * (i // 16) : 20 + 4 * (i // 16)])::INT >> (15 - i % 16)) & 1 = 1 THEN 1 ELSE -1 END)), 0) > 0 THEN 1 ELSE 0 END)"


@query(f"""WITH {T}, H AS (SELECT id, list_transform(a, lambda w: md5(w)) AS ha, list_transform(b, lambda w: md5(w)) AS hb FROM T),
B AS (SELECT id, {_BITS.format(h='ha')} AS x, {_BITS.format(h='hb')} AS y FROM H)
SELECT id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) AS INT) AS distance FROM B""")
def simhash_distance(spark, d):
    return token_pairs(spark, d).select("id", edit.simhash_distance(F.col("a"), F.col("b")).alias("distance"))


def _simhash_sql(a: str, b: str) -> str:
    return f"""WITH {T}, H AS (SELECT id, list_transform({a}, lambda w: md5(w)) AS ha, list_transform({b}, lambda w: md5(w)) AS hb FROM T),
B AS (SELECT id, {_BITS.format(h='ha')} AS x, {_BITS.format(h='hb')} AS y FROM H)
SELECT id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) AS INT) AS distance FROM B"""


def _simhash_grams(kind: str, n: int):
    def f(spark, d):
        if kind == "char":
            return pairs(spark, d).select("id", edit.gram_simhash_distance(F.lower("q1"), F.lower("q2"), n).alias("distance"))
        df = token_pairs(spark, d).select("id", tx.word_ngrams(F.col("a"), n).alias("a"), tx.word_ngrams(F.col("b"), n).alias("b"))
        return df.select("id", edit.simhash_distance(F.col("a"), F.col("b")).alias("distance"))

    f.__name__ = f"simhash_{kind}{n}"
    w = f"list_transform(range(1, len({{}}) - {n} + 2), lambda i: array_to_string({{}}[i : i + {n - 1}], ' '))"
    sql = _simhash_sql(w.format("a", "a"), w.format("b", "b")) if kind == "word" else _simhash_sql(_CHARS.format(q="lower(q1)", n=n), _CHARS.format(q="lower(q2)", n=n))
    query(sql)(f)


for _kind in ("word", "char"):
    for _n in (2, 3):
        _simhash_grams(_kind, _n)


# ---- stems


@query()
def porter_tail(spark, d):
    return pairs(spark, d).select("id", stem.porter_tail(F.col("q1")).alias("s1"), stem.porter_tail(F.col("q2")).alias("s2"))


def _stemmed(spark, d, cleaner, *udf):
    """(id, s1, s2): the stems of both texts' tokens, one text below the other while they are looked up."""
    p = pairs(spark, d)
    sides = p.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(f"q{i}").alias("q")) for i in (1, 2)])).alias("x"))
    long = sides.select(F.concat_ws(":", "id", "x.s").alias("key"), tx.tokens(cleaner(F.col("x.q"))).alias("t"))
    out = stem.stem_words(long, "key", F.col("t"), *udf).select(F.split("key", ":").alias("k"), F.array_join("stems", " ").alias("stems"))
    side = lambda i: F.max(F.when(F.get("k", F.lit(1)) == str(i), F.col("stems"))).alias(f"s{i}")
    return out.groupBy(F.get("k", F.lit(0)).cast("long").alias("id")).agg(side(1), side(2))


@query()
def lancaster_words(spark, d):
    return _stemmed(spark, d, clean.clean_v2)


@query()
def clean_v3(spark, d):
    """The third cleaner: the first, with Lancaster stems."""
    return _stemmed(spark, d, clean.clean_v1)


@query()
def snowball_words(spark, d):
    return _stemmed(spark, d, clean.clean_sequence, stem.snowball_udf)


_ALPHA = lambda c: f"array_to_string(regexp_extract_all({c}, '{tx.ALPHABETIC}'), ' ')"


@query(f"WITH {P} SELECT id, {_ALPHA('q1')} AS a1, {_ALPHA('q2')} AS a2 FROM P")
def alphabetic_tokens(spark, d):
    return pairs(spark, d).select("id", *[F.array_join(tx.alphabetic(F.col(f"q{i}")), " ").alias(f"a{i}") for i in (1, 2)])


@query()
def treebank_tokens(spark, d):
    return pairs(spark, d).select("id", *[F.array_join(tx.treebank_words(F.col(f"q{i}")), " ").alias(f"tokens{i}") for i in (1, 2)])


# ---- graph


def _nodes(spark, d, texts: bool = False):
    """Pairs of train and test with the MD5 of their texts (and the texts), as a working table; null texts are empty."""
    tr = one_per_id(table(spark, d, "train", "id", "question1", "question2")).withColumn("split", F.lit("train"))
    te = one_per_id(table(spark, d, "test", "test_id", "question1", "question2"), "test_id").withColumnRenamed("test_id", "id").withColumn("split", F.lit("test"))
    q1, q2 = (F.coalesce(c, F.lit("")) for c in ("question1", "question2"))
    both = tr.unionByName(te).select("split", "id", F.md5(q1).alias("k1"), F.md5(q2).alias("k2"), *([q1.alias("q1"), q2.alias("q2")] if texts else []))
    return Workspace(spark, "nodes").save(both, "nodes")


_N = """N AS (SELECT split, id, md5(q1) AS k1, md5(q2) AS k2, q1, q2 FROM (SELECT DISTINCT 'train' AS split, id, coalesce(question1, '') AS q1, coalesce(question2, '') AS q2 FROM train
UNION ALL SELECT DISTINCT 'test', test_id, coalesce(question1, ''), coalesce(question2, '') FROM test)), E AS (SELECT k1 AS src, k2 AS dst FROM N UNION ALL SELECT k2, k1 FROM N)"""


@query(f"WITH {_N}, C AS (SELECT src AS k, count(*) AS n FROM E GROUP BY src) SELECT split, id, x.n AS q1_freq, y.n AS q2_freq FROM N JOIN C x ON x.k = k1 JOIN C y ON y.k = k2")
def question_freq(spark, d):
    """How often each of a pair's texts stands anywhere in train and test."""
    n = _nodes(spark, d)
    f = graph.frequency(n, "k1", "k2")
    return graph.look_up(n, {"k1": "q1_freq", "k2": "q2_freq"}, f, "text", "n").select("split", "id", "q1_freq", "q2_freq")


@query(f"""WITH {_N}, S AS (SELECT k1 AS k, CASE split WHEN 'train' THEN 0 ELSE 2 END AS s, id FROM N UNION ALL SELECT k2, CASE split WHEN 'train' THEN 1 ELSE 3 END, id FROM N),
M AS (SELECT k, min((s, id)) AS pos FROM S GROUP BY k) SELECT k AS text, row_number() OVER (ORDER BY pos) - 1 AS n FROM M""")
def first_seen_id(spark, d):
    """Numbers of the texts in the order of first appearance: question1 and question2 of train, then of test."""
    n = _nodes(spark, d)
    s = F.when(F.col("split") == "train", 0).otherwise(2)
    stack = n.select(F.explode(F.array(F.struct(F.col("k1").alias("k"), s.alias("s"), "id"), F.struct(F.col("k2").alias("k"), (s + 1).alias("s"), "id"))).alias("x")).select("x.k", "x.s", "x.id")
    return graph.first_seen_ids(stack, "k", ["s", "id"])


@query("""WITH K AS (SELECT md5(question1) AS t, min(qid1) AS i FROM train WHERE question1 IS NOT NULL AND qid1 IS NOT NULL GROUP BY ALL), W AS (SELECT DISTINCT md5(question1) AS t FROM test WHERE question1 IS NOT NULL),
N AS (SELECT t, row_number() OVER (ORDER BY t) + 10000000 AS i FROM W WHERE t NOT IN (SELECT t FROM K)) SELECT t, i FROM K JOIN W USING (t) UNION ALL SELECT t, i FROM N""")
def allocated_ids(spark, d):
    """Question ids for the texts of test: those of train where it has the text, new ones else."""
    known = table(spark, d, "train", "qid1", "question1").filter("question1 is not null and qid1 is not null").groupBy(F.md5("question1").alias("t")).agg(F.min("qid1").alias("i"))
    return graph.allocate_ids(table(spark, d, "test", "question1").select(F.md5("question1").alias("t")), known, "t", "i", 10_000_000)


@query(f"WITH {_N}, K AS (SELECT DISTINCT src, dst FROM E) SELECT src, count(*) AS degree FROM K GROUP BY src")
def degree(spark, d):
    return graph.degree(graph.both_ways(_nodes(spark, d), "k1", "k2"))


@query(f"""WITH {_N}, K AS (SELECT DISTINCT src, dst FROM E), Q AS (SELECT DISTINCT k1, k2 FROM N)
SELECT Q.k1, Q.k2, count(y.dst) AS common FROM Q JOIN K x ON x.src = k1 LEFT JOIN K y ON y.src = k2 AND y.dst = x.dst GROUP BY Q.k1, Q.k2""")
def common_neighbors(spark, d):
    n = _nodes(spark, d)
    return graph.common_neighbours(n, "k1", "k2", graph.both_ways(n, "k1", "k2"))


_WM = f"""WITH {_N}, S AS (SELECT k1, k2, list_filter(list_distinct({TOK.format('lower(q1)')}), lambda x: NOT list_contains({STOPS}, x)) AS a, list_filter(list_distinct({TOK.format('lower(q2)')}), lambda x: NOT list_contains({STOPS}, x)) AS b FROM N),
M AS (SELECT k1, k2, {_SHARE.format(a='a', b='b')} AS w FROM S), G AS (SELECT src, dst, max(w) AS w FROM (SELECT k1 AS src, k2 AS dst, w FROM M UNION ALL SELECT k2, k1, w FROM M) GROUP BY ALL),
Z AS (SELECT src, sum(w) AS t FROM G GROUP BY src), Q AS (SELECT DISTINCT k1, k2 FROM N),
I AS (SELECT Q.k1, Q.k2, count(*) AS c, sum(x.w + y.w) AS w FROM Q JOIN G x ON x.src = k1 JOIN G y ON y.src = k2 AND y.dst = x.dst GROUP BY ALL)
SELECT Q.k1, Q.k2, coalesce(c, 0) AS common, round(coalesce(I.w / nullif(a.t + b.t, 0), 0), 6) AS ratio FROM Q LEFT JOIN I ON I.k1 = Q.k1 AND I.k2 = Q.k2 JOIN Z a ON a.src = Q.k1 JOIN Z b ON b.src = Q.k2"""


@query(_WM)
def wm_ratio(spark, d):
    """Word-match weight of the edges to common neighbours."""
    n = _nodes(spark, d, texts=True)
    less = lambda c: F.filter(F.array_distinct(tx.tokens(F.lower(c))), lambda w: ~w.isin(fixed.ENGLISH_STOPS))
    w = n.select("k1", "k2", tx.let(sets.word_match_share, less("q1"), less("q2")).alias("weight"))
    e = graph.both_ways(w, "k1", "k2", "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return graph.weighted_common_ratio(n, "k1", "k2", e).withColumn("ratio", r("ratio"))


def _pagerank_sql(rounds: int) -> str:
    s = f"WITH {_N}, O AS MATERIALIZED (SELECT src, count(*) AS o FROM E GROUP BY src), X AS MATERIALIZED (SELECT src, dst, count(*) AS k FROM E GROUP BY ALL), R0 AS MATERIALIZED (SELECT src AS v, 1.0 / (SELECT count(*) FROM O)::DOUBLE AS pr FROM O)"
    for i in range(rounds):
        s += f", R{i + 1} AS MATERIALIZED (SELECT dst AS v, 0.15 / (SELECT count(*) FROM O) + 0.85 * sum(pr * k / o) AS pr FROM X JOIN O USING (src) JOIN R{i} ON v = src GROUP BY dst)"
    return s + f" SELECT v, round(pr, 12) AS pr FROM R{rounds}"


@query(_pagerank_sql(20))
def pagerank(spark, d):
    return graph.pagerank(graph.both_ways(_nodes(spark, d), "k1", "k2"), Workspace(spark, "pagerank")).select("v", r("pr", 12).alias("pr"))


@query(_pagerank_sql(20).replace("SELECT v, round(pr, 12) AS pr FROM R20", "SELECT split, id, round(a.pr, 12) AS q1_pr, round(b.pr, 12) AS q2_pr FROM N JOIN R20 a ON a.v = k1 JOIN R20 b ON b.v = k2"))
def pagerank_pairs(spark, d):
    """PageRank of both texts of every pair of train and test."""
    n = _nodes(spark, d)
    work = Workspace(spark, "pagerank")
    ranks = work.save(graph.pagerank(graph.both_ways(n, "k1", "k2"), work), "ranks")
    out = graph.look_up(n, {"k1": "q1_pr", "k2": "q2_pr"}, ranks, "v", "pr", default=0.0)
    return out.select("split", "id", r("q1_pr", 12).alias("q1_pr"), r("q2_pr", 12).alias("q2_pr"))


def _kcore_sql(rounds: int) -> str:
    """Each round lowers a vertex to the largest k such that k neighbours have at least k."""
    s = f"WITH {_N}, K AS MATERIALIZED (SELECT DISTINCT src, dst FROM E WHERE src <> dst), C0 AS MATERIALIZED (SELECT src AS v, count(*) AS core FROM K GROUP BY src)"
    for i in range(rounds):
        s += f""", H{i} AS MATERIALIZED (SELECT src AS v, core AS c, row_number() OVER (PARTITION BY src ORDER BY core DESC) AS n FROM K JOIN C{i} ON v = dst),
C{i + 1} AS MATERIALIZED (SELECT v, least(core, h) AS core FROM C{i} JOIN (SELECT v, max(least(c, n)) AS h FROM H{i} GROUP BY v) USING (v))"""
    return s + f" SELECT v, core FROM C{rounds}"


@query(_kcore_sql(20))
def kcore(spark, d):
    return graph.kcore(graph.both_ways(_nodes(spark, d), "k1", "k2"), Workspace(spark, "kcore"))


# ---- vectors


def _vec_pairs(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.withColumnRenamed("embedding", "x").join(y, "vec_id")


_VP = "WITH V AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_ZIP = "list_transform(list_zip(x, y), lambda p: {})"
_DOT = "list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"


@query(f"""{_VP} SELECT vec_id, round({_DOT.format(x='x', y='y')} / (sqrt({_DOT.format(x='x', y='x')}) * sqrt({_DOT.format(x='y', y='y')}) + 1e-6), 6) AS cosine_guarded,
round({_DOT.format(x='x', y='y')} / (sqrt({_DOT.format(x='x', y='x')}) * sqrt({_DOT.format(x='y', y='y')})), 6) AS cosine,
round(list_sum({_ZIP.format('abs(p[1] - p[2])')}), 6) AS manhattan, round(abs(list_sum({_ZIP.format('p[1] - p[2]')})), 6) AS sum_difference,
round(sqrt(list_sum({_ZIP.format('pow(p[1] - p[2], 2)')})), 6) AS euclidean, round(pow(list_sum({_ZIP.format('pow(abs(p[1] - p[2]), 3)')}), 1.0 / 3), 6) AS minkowski3,
round(list_sum({_ZIP.format('coalesce(abs(p[1] - p[2]) / nullif(abs(p[1]) + abs(p[2]), 0), 0)')}), 6) AS canberra FROM V""")
def vec_distances(spark, d):
    df = _vec_pairs(spark, d)
    x, y = F.col("x"), F.col("y")
    fs = ("cosine_guarded", "cosine", "manhattan", "sum_difference", "euclidean", "minkowski3", "canberra")
    return df.select("vec_id", *[r(getattr(V, f)(x, y)).alias(f) for f in fs])


_RANK = "list_transform({x}, lambda v: len(list_filter({x}, lambda w: w < v)) + (len(list_filter({x}, lambda w: w = v)) + 1) / 2)"


@query(f"""{_VP}, R AS (SELECT *, {_RANK.format(x='x')} AS rx, {_RANK.format(x='y')} AS ry FROM V), M AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_avg(rx) AS ma, list_avg(ry) AS mb FROM R),
C AS (SELECT vec_id, list_transform(x, lambda v: v - mx) AS x, list_transform(y, lambda v: v - my) AS y, list_transform(rx, lambda v: v - ma) AS rx, list_transform(ry, lambda v: v - mb) AS ry FROM M)
SELECT vec_id, round({_DOT.format(x='x', y='y')} / (sqrt({_DOT.format(x='x', y='x')}) * sqrt({_DOT.format(x='y', y='y')})), 6) AS pearson,
round({_DOT.format(x='rx', y='ry')} / (sqrt({_DOT.format(x='rx', y='rx')}) * sqrt({_DOT.format(x='ry', y='ry')})), 6) AS spearman FROM C""")
def vec_correlations(spark, d):
    df = _vec_pairs(spark, d)
    return df.select("vec_id", r(tx.let(V.pearson, F.col("x"), F.col("y"))).alias("pearson"), r(tx.let(V.spearman, F.col("x"), F.col("y"))).alias("spearman"))


@query(f"""{_VP}, E AS (SELECT vec_id, i, x[i] AS x, y[i] AS y FROM (SELECT vec_id, x, y, unnest(range(1, len(x) + 1)) AS i FROM V)),
S AS (SELECT a.vec_id, sign(a.x - b.x) AS a, sign(a.y - b.y) AS b FROM E a JOIN E b ON a.vec_id = b.vec_id AND a.i < b.i)
SELECT vec_id, round(sum(a * b) / sqrt(count(*) FILTER (a <> 0) * count(*) FILTER (b <> 0)), 6) AS kendall FROM S GROUP BY vec_id""")
def vec_kendall(spark, d):
    return _vec_pairs(spark, d).select("vec_id", r(V.kendall("x", "y")).alias("kendall"))


@query("""WITH V AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v FROM embeddings), M AS (SELECT vec_id, avg(v) AS m FROM V GROUP BY vec_id),
C AS (SELECT vec_id, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM V JOIN M USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / pow(m2, 2) - 3, 6) AS kurtosis FROM C""")
def vec_moments(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", r(tx.let(V.skewness, F.col("embedding"))).alias("skewness"), r(tx.let(V.kurtosis, F.col("embedding"))).alias("kurtosis"))


_WV = "WV AS (SELECT lower(word) AS word, min_by(vec, word)::DOUBLE[] AS vec FROM word_vectors GROUP BY lower(word))"
_CLEANED = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
_KNOWN = f"""WITH {P}, {_WV}, X AS (SELECT id, 1 AS s, unnest({_CLEANED.format('q1')}) AS w FROM P UNION ALL SELECT id, 2, unnest({_CLEANED.format('q2')}) FROM P),
K AS (SELECT id, s, w, vec FROM X JOIN WV ON w = word)"""


def _words_of(spark, d):
    return pairs(spark, d).select("id", tx.words("q1").alias("a"), tx.words("q2").alias("b")), embed.unique_words(table(spark, d, "word_vectors", "word", "vec"))


def _sent_sql(w: str) -> str:
    return _KNOWN + f""", I AS (SELECT w, log2((SELECT count(DISTINCT (id, s)) FROM X) / count(DISTINCT (id, s))) AS idf FROM X GROUP BY w),
D AS (SELECT id, s, i, sum(vec[i] * {w}) / nullif(sum({w}), 0) AS v FROM (SELECT id, s, w, vec, unnest(range(1, 301)) AS i FROM K) JOIN I USING (w) GROUP BY ALL),
J AS (SELECT id, sum(v) FILTER (s = 1) AS x, sum(v) FILTER (s = 2) AS y FROM D GROUP BY id, i),
R AS (SELECT id, sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x * x, 0))) * sqrt(sum(coalesce(y * y, 0))) + 1e-6) AS c, sum(abs(coalesce(x, 0) - coalesce(y, 0))) AS m FROM J GROUP BY id)
SELECT P.id, round(coalesce(c, 0), 6) AS cosine, round(coalesce(m, 0), 4) AS manhattan FROM P LEFT JOIN R USING (id)"""


def _sentences(df, words, weight=None):
    side = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("t")), F.struct(F.lit(2).alias("s"), F.col("b").alias("t")))).alias("x")
    docs = df.select("id", side).select("id", "x.s", "x.t")
    v = embed.sentence_vectors(docs, ["id", "s"], F.col("t"), words, 300, weight(docs) if weight else None)
    both = v.groupBy("id").agg(F.max(F.when(F.col("s") == 1, F.col("vec"))).alias("x"), F.max(F.when(F.col("s") == 2, F.col("vec"))).alias("y"))
    return both.select("id", r(V.cosine_guarded(F.col("x"), F.col("y"))).alias("cosine"), r(V.manhattan(F.col("x"), F.col("y")), 4).alias("manhattan"))


@query(_sent_sql("1"))
def sent_vector_mean(spark, d):
    """Similarity of the means of the two texts' word vectors."""
    return _sentences(*_words_of(spark, d))


@query(_sent_sql("idf"))
def sent_vector_idf(spark, d):
    """The same with words weighted by log2(n / df)."""

    def weight(docs):
        t = corpus.document_frequency(corpus.token_table(docs, ["id", "s"], F.col("t")), ["id", "s"])
        return t.select("token", corpus.idf_log2(F.col("df"), F.col("n_docs")).alias("w"))

    return _sentences(*_words_of(spark, d), weight)


_APART = _KNOWN.replace("X AS (", "X0 AS (").replace("K AS (SELECT id, s, w, vec FROM X JOIN", "X AS (SELECT id, s, w, row_number() OVER () AS t FROM X0), K AS (SELECT id, s, w, t, vec FROM X JOIN") + """,
D AS (SELECT a.id, a.t AS i, b.t AS j, a.w AS wi, b.w AS wj, list_distance(a.vec, b.vec) AS d FROM K a JOIN K b ON a.id = b.id AND a.s = 1 AND b.s = 2),
M AS (SELECT id, 1 AS s, wi AS w, min(d) AS m FROM D GROUP BY id, i, wi UNION ALL SELECT id, 2, wj, min(d) FROM D GROUP BY id, j, wj)"""


@query(_APART + """, S AS (SELECT id, avg(m) AS m FROM M GROUP BY id, s),
Z AS (SELECT id, sum(m) AS d FROM S GROUP BY id) SELECT P.id, round(coalesce(d, 0), 6) AS distance FROM P LEFT JOIN Z USING (id)""")
def relaxed_wmd(spark, d):
    """Mean least distance between the words of the two texts, both directions added."""
    df, words = _words_of(spark, d)
    return embed.relaxed_distance(df, "id", F.col("a"), F.col("b"), words, 300).select("id", r("distance").alias("distance"))


def _weighted_wmd(spark, d, weight):
    df, words = _words_of(spark, d)
    return embed.relaxed_distance(df, "id", F.col("a"), F.col("b"), words, 300, weight=weight(df)).select("id", r("distance", 9).alias("distance"))


_WEIGHTED = " SELECT P.id, round(coalesce(sum(m * wt), 0), 9) AS distance FROM P LEFT JOIN (M JOIN G USING (w)) USING (id) GROUP BY P.id"


@query(_APART + ", G AS (SELECT w, CASE WHEN count(*) < 2 THEN 0.0 ELSE 1 / (count(*) + 10000.0) END AS wt FROM X GROUP BY w)" + _WEIGHTED)
def relaxed_wmd_tf(spark, d):
    """Sum of the least distances, each times 1 / (count of its word + 10,000)."""

    def weight(df):
        n = df.select(F.explode(F.concat("a", "b")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return corpus.inverse_weights(n).select("word", F.col("weight").alias("w"))

    return _weighted_wmd(spark, d, weight)


@query(_APART + ", G AS (SELECT w, log2((SELECT count(DISTINCT (id, s)) FROM X) / count(DISTINCT (id, s))) AS wt FROM X GROUP BY w)" + _WEIGHTED)
def relaxed_wmd_idf(spark, d):
    """The same with the words' log2(n / df)."""

    def weight(df):
        side = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("t")), F.struct(F.lit(2).alias("s"), F.col("b").alias("t")))).alias("x")
        t = corpus.document_frequency(corpus.token_table(df.select("id", side).select("id", "x.s", "x.t"), ["id", "s"], F.col("t")), ["id", "s"])
        return t.select(F.col("token").alias("word"), corpus.idf_log2(F.col("df"), F.col("n_docs")).alias("w"))

    return _weighted_wmd(spark, d, weight)


_NEAR = """, S AS (SELECT q.item AS query, x.item, list_cosine_similarity(q.vec, x.vec) AS score FROM U q JOIN U x ON q.item <> x.item WHERE {where})
SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS INTEGER) AS rank, round(score, 6) AS score FROM S QUALIFY rank <= 5"""


@query(f"WITH {_WV}, U AS (SELECT word AS item, vec FROM WV WHERE list_dot_product(vec, vec) > 0)" + _NEAR.format(where="true"))
def synonyms_topk(spark, d):
    """The five nearest words of every word of word_vectors."""
    w = embed.unique_words(table(spark, d, "word_vectors", "word", "vec")).withColumnRenamed("word", "item")
    return embed.nearest(w.withColumnRenamed("item", "query"), w, 5, 300).withColumn("score", r("score"))


@query("WITH U AS (SELECT vec_id AS item, embedding::DOUBLE[] AS vec FROM embeddings)" + _NEAR.format(where="q.item % 100 = 0"))
def nearest_vectors(spark, d):
    """The five nearest vectors of the query set (ids divisible by 100) among all."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    return embed.nearest(e.filter("item % 100 = 0").withColumnRenamed("item", "query"), e, 5, 64).withColumn("score", r("score"))


@query()
def nearest_by_lists(spark, d):
    """The same through an inverted index; recall against nearest_vectors is measured in the tests."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    return embed.nearest_by_lists(e.filter("item % 100 = 0").withColumnRenamed("item", "query"), e, 5, 64, lists=32, probes=20).withColumn("score", r("score"))


# ---- rows, splits, folds, predictions

_BUCKET = "('0x' || md5(CAST({k} AS VARCHAR) || ':{seed}')[1:8])::BIGINT % 1000000"


@query(f"WITH {P} SELECT id, CASE WHEN {_BUCKET.format(k='id', seed='split')} < 200000 THEN 'valid' ELSE 'train' END AS part FROM P")
def hash_split(spark, d):
    return rows.hash_split(pairs(spark, d), "id", 0.2).select("id", "part")


@query(f"WITH {P} SELECT id, CAST({_BUCKET.format(k='id', seed='fold')} % 5 AS INTEGER) AS fold FROM P")
def kfold5(spark, d):
    return rows.folds(pairs(spark, d), "id").select("id", "fold")


@query(f"""WITH {P}, F AS (SELECT id, CAST({_BUCKET.format(k='id', seed='fold')} % 5 AS INTEGER) AS f FROM P), K AS (SELECT unnest(range(5))::INTEGER AS fold)
SELECT fold, CASE WHEN f = fold THEN 'held out' ELSE 'train' END AS part, id FROM F, K UNION ALL SELECT fold, 'test', test_id FROM (SELECT DISTINCT test_id FROM test), K""")
def folds_with_test(spark, d):
    """For each fold its training rows, and the rows to predict: those held out and the whole test."""
    te = one_per_id(table(spark, d, "test", "test_id"), "test_id").withColumnRenamed("test_id", "id")
    return rows.fold_parts(rows.folds(pairs(spark, d).select("id"), "id"), te, "id")


@query(f"WITH {P}, N AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS c FROM P) SELECT id, CAST(least(n // (c // 5), 4) AS INTEGER) AS fold FROM N")
def kfold_contiguous(spark, d):
    return rows.contiguous_folds(pairs(spark, d), ["id"]).select("id", "fold")


@query(f"WITH {P} SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':shuffle'), id) - 1 AS place FROM P")
def shuffled(spark, d):
    df = pairs(spark, d).select("id", rows.shuffle_order("id", "shuffle").alias("k"))
    return rows.numbered(df, ["k", "id"], "place").select("id", "place")


@query(f"""WITH {P}, G AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS n, count(*) OVER (PARTITION BY label) AS c FROM P)
SELECT id, label, 0 AS copy FROM P UNION ALL SELECT id, label, 1 FROM G WHERE label = 0 AND n <= CAST(floor(0.8 * c) AS BIGINT)""")
def oversample_08(spark, d):
    return rows.oversample(pairs(spark, d), "id", "label", 0.8).select("id", "label", "copy")


@query(f"""WITH {P}, C AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM P), S AS (SELECT neg, pos / (pos + neg) / 0.165 - 1 AS s FROM C),
K AS (SELECT neg, CASE WHEN s > 1 THEN pow(2, ceil(s) - 1) ELSE 1 END AS times, CASE WHEN s > 1 THEN s - (ceil(s) - 1) ELSE greatest(s, 0) END AS rest FROM S),
G AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS n FROM P WHERE label = 0), M AS (SELECT G.*, times, CAST(floor(rest * neg * times) AS BIGINT) AS extra, neg FROM G, K)
SELECT id, label, 0 AS copy FROM P WHERE label IS DISTINCT FROM 0 UNION ALL SELECT id, label, CAST(unnest(range(0, CAST(CAST(times AS BIGINT) + extra // neg + CASE WHEN n < extra % neg THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) FROM M""")
def oversample_prior(spark, d):
    """The rows, with copies of the negatives that bring the positives' share to the prior."""
    return rows.oversample_to_prior(pairs(spark, d), "id", "label").select("id", "label", "copy")


def _scores(spark, d):
    """A made-up score of each record from the hash of its id."""
    return pairs(spark, d).select("id", "label", *[(rows.bucket("id", f"p{i}") / 1e6).alias(f"p{i}") for i in range(1, 6)])


_P = lambda i: f"({_BUCKET.format(k='id', seed=f'p{i}')}) / 1e6"


@query(f"WITH {P} SELECT id, round(({' + '.join(_P(i) for i in range(1, 6))}) / 5, 6) AS prediction FROM P")
def oof_average(spark, d):
    return rows.mean_of_folds(_scores(spark, d), [f"p{i}" for i in range(1, 6)]).select("id", r("prediction").alias("prediction"))


@query(f"WITH {P}, S AS (SELECT label, greatest(1e-15, least(1 - 1e-15, {_P(1)})) AS p FROM P WHERE label IS NOT NULL) SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM S")
def logloss(spark, d):
    return rows.log_loss(_scores(spark, d), "label", "p1").select(r("log_loss").alias("log_loss"))


@query("""WITH S AS (SELECT test_id, avg(least(1, greatest(0, is_duplicate))) AS p FROM submission WHERE is_duplicate IS NOT NULL GROUP BY test_id),
H AS (SELECT DISTINCT test_id, """ + _BUCKET.format(k="test_id", seed="other") + """ / 1e6 AS p FROM test) SELECT test_id, round(0.5 * S.p + 0.5 * H.p, 9) AS p FROM S JOIN H USING (test_id)""")
def blend(spark, d):
    """Half the submission (mean of repeated ids, within 0 and 1), half another score."""
    s = table(spark, d, "submission").filter("is_duplicate is not null").groupBy("test_id").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "is_duplicate"))).alias("p"))
    h = table(spark, d, "test", "test_id").distinct().withColumn("p", rows.bucket("test_id", "other") / 1e6)
    return rows.blend([(s, 0.5), (h, 0.5)], "test_id", "p").select("test_id", r("p", 9).alias("p"))


@query(f"WITH {T} SELECT id, round((len(a) / (len(b) + 1) + len(b) / (len(a) + 1)) / 2, 6) AS score FROM T")
def pair_swap_avg(spark, d):
    """A score that isn't symmetric, averaged over both orders of the texts."""
    s = rows.pair_swap(pairs(spark, d), "q1", "q2").select("id", tx.tokens(F.lower("q1")).alias("a"), tx.tokens(F.lower("q2")).alias("b"))
    return s.groupBy("id").agg(r(F.avg(F.size("a") / (F.size("b") + 1))).alias("score"))


@query(f"""WITH {T}, X AS (SELECT id, label, [length(q1) / 7.0, len(list_filter(a, lambda x: list_contains(b, x))), CASE WHEN len(b) = 0 THEN NULL ELSE len(a) / len(b) END] AS v FROM T)
SELECT id, concat_ws(' ', CAST(label AS VARCHAR), array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x IS NULL THEN (i - 1) || ':-1.000000' WHEN abs(x) > 1e-6 THEN (i - 1) || ':' || printf('%.6f', x) END), lambda x: x IS NOT NULL), ' ')) AS line FROM X""")
def libsvm_rows(spark, d):
    t = token_pairs(spark, d)
    f = lambda a, b: F.array(F.size(F.filter(a, lambda x: F.array_contains(b, x))).cast("double"), F.try_divide(F.size(a).cast("double"), F.size(b)))
    v = F.concat(F.array(F.length("q1") / 7.0), tx.let(f, F.col("a"), F.col("b")))
    return t.select("id", files.sparse_line(v, F.col("label")).alias("line"))


_SEQ = "array_to_string(list_concat(list_transform(range(len(coalesce({0}, [])), 30), lambda x: 0), list_reverse(list_reverse(coalesce({0}, []))[1:30])), ' ')"


@query(f"""WITH {T}, X AS (SELECT id, 1 AS s, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM T UNION ALL SELECT id, 2, unnest(b), generate_subscripts(b, 1) FROM T), B AS (SELECT w, count(*) AS n FROM X GROUP BY w),
R AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS k FROM B), S AS (SELECT id, list(k ORDER BY i) FILTER (k < 200000 AND s = 1) AS x, list(k ORDER BY i) FILTER (k < 200000 AND s = 2) AS y FROM X JOIN R USING (w) GROUP BY id)
SELECT T.id, {_SEQ.format('x')} AS seq1, {_SEQ.format('y')} AS seq2 FROM T LEFT JOIN S USING (id)""")
def pad_sequences(spark, d):
    """Word ranks of both texts, the last 30 of each, filled with 0 in front."""
    t = token_pairs(spark, d)
    said = lambda a, to: corpus.padded_sequences(t, "id", a, ["a", "b"], 30, 200_000).select("id", F.array_join(F.transform("seq", lambda x: x.cast("string")), " ").alias(to))
    return said("a", "seq1").join(said("b", "seq2"), "id")


@query("""WITH B AS (SELECT DISTINCT test_id, length(coalesce(question1, '')) AS z1, length(coalesce(question2, '')) AS z2 FROM test), S AS (SELECT test_id, avg(is_duplicate) AS f1 FROM submission GROUP BY test_id)
SELECT test_id, CAST(z1 AS INTEGER) AS z1, CAST(z2 AS INTEGER) AS z2, round(coalesce(f1, 0), 6) AS f1 FROM B LEFT JOIN S USING (test_id)""")
def feature_matrix_join(spark, d):
    """Feature tables of test joined by key; a record without a prediction has 0."""
    p = one_per_id(table(spark, d, "test", "test_id", "question1", "question2"), "test_id")
    z = p.select("test_id", *[F.length(F.coalesce(f"question{i}", F.lit(""))).alias(f"z{i}") for i in (1, 2)])
    f = table(spark, d, "submission", "test_id", "is_duplicate").groupBy("test_id").agg(F.avg("is_duplicate").alias("f1"))
    return rows.join_features(p.select("test_id"), [z, f], ["test_id"]).select("test_id", "z1", "z2", r("f1").alias("f1"))


@query(f"""WITH {P}, L AS (SELECT id, label, length(q1) AS z1, length(q2) AS z2 FROM P), S AS (SELECT id, {_P(1)} AS f1 FROM P)
SELECT id, CAST(z1 AS INTEGER) AS z1, CAST(z2 AS INTEGER) AS z2, round(coalesce(f1, 0), 6) AS f1, CAST(CASE WHEN label = 1 THEN 0.472001959 ELSE 1.309028344 END AS DOUBLE) AS weight FROM L LEFT JOIN S USING (id)""")
def feature_matrix_whole(spark, d):
    """Feature tables of train joined by key, with the weight of the row's class."""
    p = pairs(spark, d)
    z = p.select("id", F.length("q1").alias("z1"), F.length("q2").alias("z2"))
    f = _scores(spark, d).select("id", F.col("p1").alias("f1"))
    return rows.join_features(p.select("id", "label"), [z, f], ["id"]).select("id", "z1", "z2", r("f1").alias("f1"), rows.prior_weight(F.col("label")).alias("weight"))


@query(f"""WITH {T}, {_WV}, B AS (SELECT w, count(*) AS n FROM (SELECT unnest(a) AS w FROM T UNION ALL SELECT unnest(b) FROM T) GROUP BY w), R AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS k FROM B)
SELECT w AS word, k, array_to_string(list_transform(coalesce(vec, list_transform(range(300), lambda x: 0.0::DOUBLE)), lambda x: CAST(round(x * 1e6) AS BIGINT)), ' ') AS vec FROM R LEFT JOIN WV ON w = word""")
def embedding_matrix(spark, d):
    """The vocabulary by falling frequency, each word with its vector or zeros, in millionths."""
    t = token_pairs(spark, d)
    counts = t.select(F.explode(F.concat("a", "b")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = rows.numbered(counts.withColumn("_k", -F.col("n")), ["_k", "word"], "k").select("word", "k")
    m = embed.embedding_matrix(vocabulary, embed.unique_words(table(spark, d, "word_vectors", "word", "vec")), 300)
    return m.select("word", "k", F.array_join(F.transform("vec", lambda x: F.round(x * 1e6).cast("long").cast("string")), " ").alias("vec"))


@query("""SELECT split, CAST(is_null AS BOOLEAN) AS no_label, count(*) AS n FROM (SELECT DISTINCT 'train' AS split, id, is_duplicate IS NULL AS is_null FROM train
UNION ALL SELECT DISTINCT 'test', test_id, true FROM test) GROUP BY ALL""")
def train_and_test(spark, d):
    tr = one_per_id(table(spark, d, "train", "id", "question1", "is_duplicate"))
    te = one_per_id(table(spark, d, "test", "test_id", "question1"), "test_id")
    return rows.with_test(tr, te).groupBy("split", F.col("is_duplicate").isNull().alias("no_label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T}, X AS (SELECT id, len(a) AS za, len(b) AS zb, abs(length(q1) - length(q2)) AS fd FROM T)
SELECT id, round((za - avg(za) OVER ()) / stddev_pop(za) OVER (), 6) AS za, round((zb - avg(zb) OVER ()) / stddev_pop(zb) OVER (), 6) AS zb, round((fd - avg(fd) OVER ()) / stddev_pop(fd) OVER (), 6) AS fd FROM X""")
def standardized(spark, d):
    df = token_pairs(spark, d).select("id", F.size("a").alias("za"), F.size("b").alias("zb"), F.abs(F.length("q1") - F.length("q2")).alias("fd"))
    return rows.standardize(df, rows.feature_columns(df)).select("id", *[r(c).alias(c) for c in ("za", "zb", "fd")])


_PROFILE = f"""WITH {P}, S AS (SELECT DISTINCT id, replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '-', '_') AS source FROM train),
C AS (SELECT id, string_split({_V1('q1')}, ' ') AS a, string_split({_V1('q2')}, ' ') AS b FROM P), W AS (SELECT id, list_filter(a, lambda x: x <> '') AS a, list_filter(b, lambda x: x <> '') AS b FROM C)
SELECT source, count(*) AS n, round(avg({_SHARE.format(a='a', b='b')}), 6) AS share, round(avg(2 * {SAME.format(a='a', b='b')} / (len(a) + len(b) + 1 + 1e-6)), 6) AS dice, round(avg(abs(len(a) - len(b))), 6) AS wc_diff FROM W JOIN S USING (id) GROUP BY source"""


@query(_PROFILE)
def pair_profile(spark, d):
    """Per source: mean word share, Dice and length difference of the cleaned texts."""
    t = one_per_id(table(spark, d, "train", "id", "source", "question1", "question2"))
    c = lambda q: tx.tokens(clean.clean_v1(F.coalesce(q, F.lit(""))))
    source = F.replace(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), F.lit("-"), F.lit("_")).alias("source")
    m = tx.let(lambda a, b: F.struct(sets.word_match_share(a, b).alias("s"), sets.bag_dice(a, b).alias("d"), F.abs(F.size(a) - F.size(b)).alias("w")), c("question1"), c("question2"))
    return t.select(source, m.alias("m")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.avg("m.s")).alias("share"), r(F.avg("m.d")).alias("dice"), r(F.avg("m.w")).alias("wc_diff"))


# ---- lexicon and files


@query("""WITH N AS (SELECT n_nationkey AS i, n_name AS a, n_regionkey AS r FROM nation)
SELECT x.a AS a, y.a AS b, round(CASE WHEN x.i = y.i THEN 1.0::DOUBLE WHEN x.r = y.r THEN 1.0 / 3 ELSE 1.0 / 5 END, 6) AS path, round(CASE WHEN x.i = y.i THEN 1.0::DOUBLE WHEN x.r = y.r THEN 2.0 / 3 ELSE 1.0 / 3 END, 6) AS wup FROM N x, N y WHERE x.i <= y.i""")
def taxonomy_similarity(spark, d):
    """Path and Wu-Palmer similarity of nations below regions below one root."""
    n, g = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, d, "region", "r_regionkey")
    region = lambda c: F.concat(F.lit("region "), c)
    parents = n.select(F.col("n_name").alias("sense"), region("n_regionkey").alias("parent")).unionByName(g.select(region("r_regionkey").alias("sense"), F.lit("world").alias("parent")))
    up = lexicon.ancestors(parents, Workspace(spark, "lexicon"))
    k = n.select("n_nationkey", "n_name")
    both = k.toDF("i", "a").join(k.toDF("j", "b"), F.col("i") <= F.col("j")).select("a", "b")  # 25 nations
    return lexicon.similarities(both, up).select("a", "b", r("path").alias("path"), r("wup").alias("wup"))


#: Endings that tell a word's part of speech, else it is a noun (fixed values).
ENDINGS = {"VB": ("ing", "ed", "ize", "ise", "ify"), "JJ": ("ous", "ful", "ive", "able", "ible", "al", "ic"), "RB": ("ly",)}


def tag_by_ending(word):
    """Part of speech by the ending of a word; a stand-in for a tagger's dictionary, which the user may bring."""
    out = F.lit("NN")
    for tag, ends in ENDINGS.items():
        out = F.when(F.length(word) > 4, F.when(word.rlike(f"({'|'.join(ends)})$"), tag).otherwise(out)).otherwise(out)
    return out


_TAG = "CASE WHEN length({0}) > 4 AND {0} LIKE '%ly' THEN 'RB'" + "".join(f" WHEN length({{0}}) > 4 AND regexp_matches({{0}}, '({'|'.join(ENDINGS[t])})$') THEN '{t}'" for t in ("JJ", "VB")) + " ELSE 'NN' END"
_FOUND = lambda s: f"coalesce(string_agg(w, ' ' ORDER BY i) FILTER (s = {s}), '')"


@query(f"""WITH {P}, {_WV}, X AS (SELECT id, 1 AS s, unnest({_CLEANED.format('q1')}) AS w, generate_subscripts({_CLEANED.format('q1')}, 1) AS i FROM P UNION ALL SELECT id, 2, unnest({_CLEANED.format('q2')}), generate_subscripts({_CLEANED.format('q2')}, 1) FROM P),
K AS (SELECT id, s, i, w FROM X JOIN WV ON w = word WHERE {_TAG.format('w')} IN ('NN', 'VB')) SELECT P.id, {_FOUND(1)} AS found1, {_FOUND(2)} AS found2 FROM P LEFT JOIN K USING (id) GROUP BY P.id""")
def dictionary_words(spark, d):
    """The nouns and verbs of both texts, by a dictionary of word_vectors' words with tags."""
    p = pairs(spark, d)
    known = embed.unique_words(table(spark, d, "word_vectors", "word", "vec")).select("word", tag_by_ending(F.col("word")).alias("tag"))
    found = lambda q, to: lexicon.look_up_words(p.select("id", tx.words(q).alias("t")), "id", F.col("t"), known, "tag", ("NN", "VB")).select("id", F.array_join("found", " ").alias(to))
    return found("q1", "found1").join(found("q2", "found2"), "id")


@query()
def semantic_similarity(spark, d):
    """The lexicon's chain over both texts: words, tags, senses by their glosses, path and Wu-Palmer similarity of the best counterparts.

    The lexicon is built from word_vectors: a word is a sense, its gloss are its five nearest words, and its parent is the nearest of
    these that sorts before it, or else the root.
    """
    words = embed.unique_words(table(spark, d, "word_vectors", "word", "vec"))
    work = Workspace(spark, "semantics")
    senses, parents = lexicon.from_vectors(words, 300, work)
    tags = words.select("word", tag_by_ending(F.col("word")).alias("tag"))
    p = pairs(spark, d).select("id", tx.words("q1").alias("a"), tx.words("q2").alias("b"))
    return lexicon.semantic_similarity(p, "id", F.col("a"), F.col("b"), tags, senses, parents, work).select("id", r("similarity").alias("similarity"))


@query("SELECT id, qid1, qid2, nullif(question1, '') AS question1, nullif(question2, '') AS question2, is_duplicate FROM (SELECT DISTINCT id, qid1, qid2, question1, question2, is_duplicate FROM train)")
def csv_round_trip(spark, d):
    """The pairs written as CSV and read again with the schema of a training file; CSV has one form for null and empty."""
    path = Workspace(spark, "csv").path("train")
    files.write_csv(one_per_id(table(spark, d, "train", "id", "qid1", "qid2", "question1", "question2", "is_duplicate")), path)
    return files.read_csv(spark, path, files.PAIRS_TRAIN)


@query("SELECT word, CAST(len(vec) AS INTEGER) AS dims, round(list_sum(vec::DOUBLE[]), 3) AS total FROM word_vectors")
def glove_round_trip(spark, d):
    """Word vectors written as lines of text and read again."""
    path = Workspace(spark, "glove").path("vectors")
    table(spark, d, "word_vectors").select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    v = files.read_glove(spark, path, 300)
    return v.select("word", F.size("vec").alias("dims"), r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


# ---- learners: no SQL says what they do

FOLDS = 5


def pair_features(pairs_, *keys: str):
    """``keys`` and features of the texts q1 and q2."""
    m = tx.let(
        lambda a, b, x, y: F.struct(
            sets.word_match_share(a, b).alias("z_share"),
            sets.bag_dice(a, b).alias("z_dice"),
            sets.bag_ochiai(tx.word_ngrams(a, 2), tx.word_ngrams(b, 2)).alias("z_ochiai2"),
            F.abs(F.size(a) - F.size(b)).cast("double").alias("z_wc_diff"),
            F.levenshtein(x, y).cast("double").alias("f_distance"),
        ),
        tx.tokens(F.lower("q1")),
        tx.tokens(F.lower("q2")),
        F.col("q1"),
        F.col("q2"),
    )
    return pairs_.select(*keys, m.alias("m")).select(*keys, "m.*").fillna(0.0, ["z_share", "z_dice", "z_ochiai2", "z_wc_diff", "f_distance"])


def features(spark, d):
    """A small feature table of train with labels and folds."""
    return Workspace(spark, "features").save(rows.folds(pair_features(pairs(spark, d), "id", "label"), "id", FOLDS), "features")


def _oof(spark, d, learner, form=lambda f: f):
    f = form(features(spark, d))
    return learn.out_of_fold(f, "id", "label", _names(f), learner, FOLDS)


def _names(f):
    return [c for c in rows.feature_columns(f) if c != "fold"]


@query()
def lr_predict(spark, d):
    return _oof(spark, d, learn.logistic("label"))


@query()
def rf_predict(spark, d):
    return _oof(spark, d, learn.forest("label"))


@query()
def rf_balanced_predict(spark, d):
    """A forest in which both classes weigh the same."""
    form = lambda f: learn.balanced_weight(f.filter("label is not null"), "label")
    return _oof(spark, d, learn.forest("label", weight="weight"), form)


@query()
def gbt_predict(spark, d):
    """Boosting that stops early by a tenth of each fold's training rows."""
    return _oof(spark, d, learn.boosted("label", held="held"), lambda f: f.withColumn("held", rows.bucket("id", "held") < 100_000))


@query()
def gbc_predict(spark, d):
    """Boosting with the square root of the features at each split."""
    return _oof(spark, d, learn.boosted("label", depth=4, features="sqrt"))


@query()
def svc_predict(spark, d):
    return _oof(spark, d, learn.support_vector("label"))


@query()
def mlp_predict(spark, d):
    return _oof(spark, d, learn.perceptron("label", 5))


@query()
def cv_grid(spark, d):
    """Mean log-loss of each cell of two grids: C by class weight of logistic regression; trees, depth and features of forests."""
    f = learn.balanced_weight(features(spark, d).filter("label is not null"), "label")
    linear = [{"c": c, "weight": w} for c in (0.6, 0.8, 1.0, 1.2) for w in (None, "weight")]
    trees = [{"trees": t, "depth": n, "features": m} for t in (8, 20) for n in (6, 8, 10) for m in ("auto", "sqrt", "log2")]
    out = learn.grid_search(f, "label", _names(f), linear, lambda **c: learn.logistic("label", **c), FOLDS)
    out += learn.grid_search(f, "label", _names(f), trees, lambda **c: learn.forest("label", **c), FOLDS)
    return spark.createDataFrame([(p.get("c"), p.get("weight"), p.get("trees"), p.get("depth"), p.get("features"), m) for p, m in out], "c double, weight string, trees int, depth int, features string, log_loss double")


@query()
def stack_level2(spark, d):
    """A second level over the out-of-fold predictions of two first-level learners."""
    f = features(spark, d)
    levels = [learn.out_of_fold(f, "id", "label", _names(f), m, FOLDS) for m in (learn.logistic("label"), learn.forest("label"))]
    return learn.stacked(levels, "id", "label", f, FOLDS)


@query()
def lr_test_mean(spark, d):
    """What the models of all folds say of the records of test, and the mean, which is blended with the submission."""
    f = features(spark, d)
    models = learn.fold_models(f, "label", _names(f), learn.logistic("label"), FOLDS)
    t = one_per_id(table(spark, d, "test", "test_id", "question1", "question2").filter("test_id is not null"), "test_id")
    t = t.select("test_id", F.coalesce("question1", F.lit("")).alias("q1"), F.coalesce("question2", F.lit("")).alias("q2"))
    said = learn.fold_means(pair_features(t, "test_id"), "test_id", models)
    s = table(spark, d, "submission").filter("is_duplicate is not null").groupBy("test_id").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "is_duplicate"))).alias("p"))
    mixed = rows.blend([(said.select("test_id", F.col("prediction").alias("p")), 0.5), (s, 0.5)], "test_id", "p").withColumnRenamed("p", "blend")
    return said.join(mixed, "test_id", "left")


@query()
def lr_logloss(spark, d):
    """Log-loss of the out-of-fold predictions of logistic regression."""
    return rows.log_loss(_oof(spark, d, learn.logistic("label")), "label", "p")


@query()
def saved_model_predict(spark, d):
    """Predictions of a model that was saved and loaded again."""
    f = features(spark, d)
    model = learn.fold_models(f, "label", _names(f), learn.logistic("label"), 1)[0]
    path = Workspace(spark, "model").path("lr")
    learn.save_model(model, path)
    return learn.probability(learn.load_model(path).transform(f)).select("id", "p")


@query()
def document_vectors(spark, d):
    """Similarity of the two texts' learned document vectors."""
    words = pairs(spark, d).select("id", *[clean.document_words(F.col(q)).alias(to) for q, to in (("q1", "a"), ("q2", "b"))])
    words = Workspace(spark, "documents").save(words, "words")
    model = learn.learned_vectors(words.select(F.explode(F.array("a", "b")).alias("t")), "t")
    both = learn.document_vectors(words, model, {"a": "x", "b": "y"})
    return both.select("id", V.similarities("x", "y").alias("s")).select("id", *[r(F.col(f"s.{f}")).alias(f) for f in V.SIMILARITIES])


def _synonyms(spark, t):
    both = t.select(F.explode(F.array("a", "b")).alias("t"))
    return Workspace(spark, "synonyms").save(learn.synonym_table(learn.learned_vectors(both, "t", least=5)), "synonyms")


@query()
def synonym_expansion(spark, d):
    """Both texts with each word replaced by its five nearest words in vectors learned from both."""
    t = token_pairs(spark, d).select("id", "a", "b")
    syn = _synonyms(spark, t)
    said = lambda c, to: embed.expand(t, "id", F.col(c), syn).select("id", F.array_join("tokens", " ").alias(to))
    return said("a", "tokens1").join(said("b", "tokens2"), "id")


@query()
def expanded_weight_share(spark, d):
    """Weight share of the two texts after each word was replaced by its nearest words in learned vectors."""
    t = token_pairs(spark, d)
    syn = _synonyms(spark, t)
    a, b = embed.expand(t, "id", F.col("a"), syn), embed.expand(t, "id", F.col("b"), syn)
    both = a.join(b.withColumnRenamed("tokens", "other"), "id")
    share = corpus.weight_share(corpus.pair_tokens(both, "id", F.col("tokens"), F.col("other")), "id", _weights(pairs(spark, d)))
    return share.select("id", r("share").alias("share"))


@query()
def gram_svd(spark, d):
    """First components of the hashed character trigrams of both texts."""
    p = pairs(spark, d).select("id", F.explode(F.array("q1", "q2")).alias("q"))
    docs = p.distinct().select(F.concat_ws(":", "id", F.md5("q")).alias("key"), learn.hash_cells(tx.char_ngrams(F.lower("q"), 3), 256).alias("cells"))
    out = learn.truncated_svd(docs, "key", "cells", 256, 4)
    return out.select("key", *[r(F.get("components", F.lit(i)), 4).alias(f"svd{i}") for i in range(4)])
