"""The queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.work import Workspace
from ..sources.tables import table
from . import groups, ledger, lookalike, mix, overlap, terms, tokens

PAIR = ("id", "qid1", "qid2", "question1", "question2", "is_duplicate")


def p1_found(spark, d):
    return overlap.found(table(spark, d, "train", "qid1", "question1"), table(spark, d, "test", "test_id", "question1", "question2"), Workspace(spark, "p1"))


def p1_report(spark, d):
    return overlap.report(table(spark, d, "train", "question1"), table(spark, d, "test", "test_id", "question1", "question2", "split", "source"), Workspace(spark, "p1r"))


def p2_found(spark, d):
    return groups.found_groups(table(spark, d, "train", "id", "qid1", "qid2"), Workspace(spark, "p2"))


def p2_splits(spark, d):
    return groups.split_records(table(spark, d, "train", "id", "qid1", "qid2"), table(spark, d, "split_targets"), Workspace(spark, "p2s")).select("id", "split")


def p2_forest(spark, d):
    return groups.boruvka(table(spark, d, "train", "qid1", "qid2"), "qid1", "qid2", Workspace(spark, "p2f"))[1]


def p3_found(spark, d):
    return groups.found_ties(table(spark, d, "train", "qid1", "qid2", "is_duplicate"), Workspace(spark, "p3"))


def _ledger(spark, d):
    return ledger.ledger_of(table(spark, d, "train", "id", "question1", "question2", "loaded_at"), Workspace(spark, "p4"))


def p4_found(spark, d):
    return _ledger(spark, d).copies()


def p4_counts(spark, d):
    return _ledger(spark, d).counts().select("keep_id", "copies")


def p5_found(spark, d):
    return terms.most_distinctive(table(spark, d, "train", "id", "question1", "question2"), "id", ["question1", "question2"], Workspace(spark, "p5"))


def p5_scores(spark, d):
    t = terms.distinctive(table(spark, d, "train", "id", "question1", "question2"), "id", ["question1", "question2"], Workspace(spark, "p5s"))
    return t.withColumns({c: F.round(c, 6) for c in ("g2", "cell")})


def p6_found(spark, d):
    found = terms.value_frequencies(table(spark, d, "train", "id", "qid1", "question1"), 1, Workspace(spark, "p6"))
    return found.filter("n = 1 and mark is not null").select("kind", "term", "mark")


def p6_ngrams(spark, d):
    found = terms.value_frequencies(table(spark, d, "train", "id", "qid1", "question1"), 3, Workspace(spark, "p6n"))
    return found.filter("kind = 'word'").select("n", "term", "occurrences", "records", "mark")


def p6_intervals(spark, d):
    return terms.text_intervals(table(spark, d, "train", "id", "question1"), Workspace(spark, "p6i"))


def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p9_found(spark, d):
    return mix.short_sources(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"), Workspace(spark, "p9"))


def p9_mix(spark, d):
    return mix.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"), Workspace(spark, "p9m"))


def p9_shares(spark, d):
    return mix.shares(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"), Workspace(spark, "p9s"))


def p10_found(spark, d):
    return lookalike.same_in_print(table(spark, d, "documents", "doc_id", "text"), Workspace(spark, "p10"))


def p10_forms(spark, d):
    return lookalike.printed_forms(table(spark, d, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id").select("doc_id", "form")


QUERIES = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

SAID = r"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
W1, W2 = SAID.format(c="question1"), SAID.format(c="question2")
ONE = "(SELECT DISTINCT id, qid1, qid2, question1, question2, is_duplicate FROM train)"


def _components(rounds: int = 12) -> str:
    """Tables R0 to R``rounds`` (v, l): each round a vertex and the vertex that is its label take the least label across an edge, then twice
    the label of the label. E (a, b): both ways."""
    sql = "R0 AS MATERIALIZED (SELECT DISTINCT a AS v, a AS l FROM E)"
    for i in range(rounds):
        sql += f""", H{i} AS MATERIALIZED (SELECT a, x.l AS la, y.l AS lb FROM E JOIN R{i} x ON x.v = a JOIN R{i} y ON y.v = b),
M{i} AS MATERIALIZED (SELECT v, least(l, coalesce(m, l)) AS l FROM R{i} LEFT JOIN (SELECT v, min(lb) AS m FROM (SELECT a AS v, lb FROM H{i} UNION ALL SELECT la, lb FROM H{i}) GROUP BY v) USING (v)),
J{i} AS MATERIALIZED (SELECT x.v, y.l FROM M{i} x JOIN M{i} y ON y.v = x.l), R{i + 1} AS MATERIALIZED (SELECT x.v, y.l FROM J{i} x JOIN J{i} y ON y.v = x.l)"""
    return sql + f", R AS (SELECT v, l FROM R{rounds})"


_TEXTS = f"""A AS (SELECT DISTINCT qid1, list_sort({W1}) AS w FROM train WHERE len({W1}) >= 5 /*where*/), B0 AS (SELECT DISTINCT test_id, question1, question2, split, source FROM test),
B AS (SELECT test_id, split, source, 'question1' AS f, {W1} AS said FROM B0 UNION ALL SELECT test_id, split, source, 'question2', {W2} FROM B0),
U AS (SELECT DISTINCT 0 AS s, w FROM A UNION ALL SELECT DISTINCT 1, list_sort(said) FROM B WHERE len(said) >= 5), K AS MATERIALIZED (SELECT s, w, row_number() OVER () AS k FROM U),
X AS (SELECT k, s, unnest(list_distinct(w)) AS x FROM K), D AS (SELECT x, count(*) AS d FROM X GROUP BY x), O AS (SELECT k, s, x FROM X JOIN D USING (x) QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, x) <= 3),
C AS (SELECT DISTINCT p.k AS i, q.k AS j FROM O p JOIN O q ON p.x = q.x AND p.s = 0 AND q.s = 1),
Z AS (SELECT k, w, list_transform(w, lambda x, i: x || ':' || (i - list_position(w, x))) AS e, list_filter(w, lambda x: regexp_full_match(x, '[\\p{{Nd}}]+')) AS n FROM K),
NEAR AS MATERIALIZED (SELECT p.w AS a, q.w AS b FROM C JOIN Z p ON p.k = i JOIN Z q ON q.k = j WHERE p.n = q.n AND len(p.e) - len(list_intersect(p.e, q.e)) <= 2 AND len(q.e) - len(list_intersect(p.e, q.e)) <= 2)"""

SQL = {
    "p1_found": f"WITH {_TEXTS.replace('/*where*/', 'AND qid1 IS NOT NULL')} SELECT DISTINCT qid1, test_id, f AS test_field FROM NEAR JOIN A ON A.w = a JOIN B ON list_sort(said) = b",
    "p1_report": f"""WITH {_TEXTS}, G AS (SELECT DISTINCT array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT {W1} AS w, unnest(range(1, len({W1}) - 3)) AS i FROM train)),
T AS (SELECT DISTINCT said FROM B WHERE len(said) >= 5), P AS (SELECT said, unnest(range(1, len(said) - 3)) AS i FROM T), H AS (SELECT said, i FROM P JOIN G ON g = array_to_string(said[i : i + 4], ' ')),
V AS (SELECT said, count(DISTINCT p) AS c FROM (SELECT said, unnest(range(i, i + 5)) AS p FROM H) GROUP BY said), S AS (SELECT T.said, coalesce(c, 0) AS c, EXISTS (SELECT 1 FROM NEAR WHERE b = list_sort(T.said)) AS near FROM T LEFT JOIN V USING (said))
SELECT split, replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '-', '_') AS source, count(*) FILTER (f = 'question1') AS records, count(S.said) AS questions, count(*) FILTER (near) AS overlapping,
count(*) FILTER (c >= 0.8 * len(S.said)) AS mostly_covered, count(*) FILTER (c = len(S.said)) AS covered_whole FROM B LEFT JOIN S USING (said) GROUP BY ALL""",
    "p2_found": f"""WITH O AS {ONE}, E AS (SELECT coalesce(qid1, qid2) AS a, coalesce(qid2, qid1) AS b FROM O WHERE qid1 IS NOT NULL OR qid2 IS NOT NULL UNION ALL SELECT coalesce(qid2, qid1), coalesce(qid1, qid2) FROM O WHERE qid1 IS NOT NULL OR qid2 IS NOT NULL),
{_components()}, G AS (SELECT id, l AS group_qid, count(*) OVER (PARTITION BY l) AS n FROM O JOIN R ON v = coalesce(qid1, qid2)) SELECT id, group_qid FROM G WHERE n > 1""",
    "p3_found": f"""WITH O AS {ONE}, T AS (SELECT qid1, qid2 FROM O WHERE is_duplicate = 1 AND qid1 IS NOT NULL AND qid2 IS NOT NULL), E AS (SELECT qid1 AS a, qid2 AS b FROM T UNION ALL SELECT qid2, qid1 FROM T),
{_components()} SELECT l AS group_qid, v AS qid FROM R WHERE v <> l""",
    "p5_scores": f"""WITH T AS (SELECT id, unnest(list_concat({W1}, {W2})) AS term FROM {ONE}), C AS (SELECT id, term, count(*) AS m FROM T GROUP BY ALL), S AS (SELECT id, sum(m) AS size FROM C GROUP BY id),
D AS (SELECT term, sum(m) AS tm, count(*) AS d FROM C GROUP BY term), N AS (SELECT count(*) AS n, (SELECT sum(m) FROM C) AS total FROM {ONE}),
X AS (SELECT id, term, m, d, n, m::DOUBLE AS a, (size - m)::DOUBLE AS b, (tm - m)::DOUBLE AS c, (total - size - tm + m)::DOUBLE AS e, total::DOUBLE AS t FROM C JOIN S USING (id) JOIN D USING (term), N)
SELECT id, term, m, d, round(CASE WHEN a * (c + e) >= c * (a + b) THEN 1 ELSE -1 END * 2 * (CASE WHEN a > 0 THEN a * ln(a * t / ((a + b) * (a + c))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * t / ((a + b) * (b + e))) ELSE 0 END
+ CASE WHEN c > 0 THEN c * ln(c * t / ((c + e) * (a + c))) ELSE 0 END + CASE WHEN e > 0 THEN e * ln(e * t / ((c + e) * (b + e))) ELSE 0 END), 6) AS g2, round(m * ln(n / d), 6) AS cell FROM X""",
    "p10_forms": f"SELECT doc_id, {lookalike.form_sql('text')} AS form FROM documents",
    "p4_found": f"""
WITH k AS (SELECT id, array_to_string({W1}, ' ') AS x, array_to_string({W2}, ' ') AS y FROM {ONE} WHERE len({W1}) >= 5 AND len({W2}) >= 5),
g AS (SELECT id, min(id) OVER (PARTITION BY least(x, y), greatest(x, y)) AS keep_id FROM k)
SELECT keep_id, id FROM g WHERE id <> keep_id""",
    "p4_counts": f"""
WITH k AS (SELECT id, array_to_string({W1}, ' ') AS x, array_to_string({W2}, ' ') AS y FROM {ONE} WHERE len({W1}) >= 5 AND len({W2}) >= 5)
SELECT min(id) AS keep_id, count(*) AS copies FROM k GROUP BY least(x, y), greatest(x, y)""",
    "p5_found": f"""
WITH t AS (SELECT id, unnest(list_concat({W1}, {W2})) AS term FROM {ONE}),
m AS (SELECT id, term, count(*) AS m FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS d FROM m GROUP BY ALL),
s AS (SELECT id, term, round(m * ln((SELECT count(*) FROM {ONE}) / d), 6) AS s FROM m JOIN d USING (term) WHERE d >= 2)
SELECT id, term FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, term) = 1""",
    "p6_found": f"""
WITH o AS (SELECT * FROM {ONE}), t AS (SELECT DISTINCT 'word' AS kind, id, unnest({W1}) AS term FROM o
UNION ALL SELECT 'qid1', id, CAST(qid1 AS VARCHAR) FROM o WHERE qid1 IS NOT NULL),
c AS (SELECT kind, term, count(*) AS d FROM t GROUP BY ALL),
n AS (SELECT 'word' AS kind, count(question1) AS n FROM o UNION ALL SELECT 'qid1', count(qid1) FROM o)
SELECT kind, term, CASE WHEN d = 1 THEN 'rare' ELSE 'common' END AS mark FROM c JOIN n USING (kind) WHERE d = 1 OR d >= 0.05 * n""",
}
for n in (1, 2, 3):
    SQL["p6_ngrams"] = SQL.get("p6_ngrams", f"WITH o AS (SELECT id, question1, {W1} AS w FROM {ONE} WHERE question1 IS NOT NULL), a AS (") + " UNION ALL " * (n > 1) + (
        f"SELECT {n} AS n, id, array_to_string(w[i : i + {n - 1}], ' ') AS term FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM o)"
    )
SQL["p6_ngrams"] += """), c AS (SELECT CAST(n AS INTEGER) AS n, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM a GROUP BY ALL)
SELECT n, term, occurrences, records, CASE WHEN records = 1 THEN 'rare' WHEN records >= 0.05 * (SELECT count(*) FROM o) THEN 'common' END AS mark FROM c"""
