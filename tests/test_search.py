import random

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lexispark import queries as registered
from lexispark.operators import index, search
from lexispark.plans import query as Q

A, B, X = Q.Term("a1"), Q.Term("b1"), Q.Nothing()

# Malformed queries: what each dialect makes of them. A doubled ! in F is double negation here, by choice.
TABLE = [
    ("a1 &&", A, Q.And(A, X)), ("&& a1", A, Q.And(X, A)), ("a1 ||", A, Q.Or(A, X)), ("|| a1", A, Q.Or(X, A)), ("!", X, Q.Not(X)),
    ("!!a1", Q.Not(Q.Not(A)), Q.Not(Q.Not(A))), ("a1 && !!b1", Q.And(A, Q.Not(Q.Not(B))), Q.And(A, Q.Not(Q.Not(B)))), ("a1 ) b1", Q.And(A, B), A),
    ("a1 && && b1", Q.And(A, B), Q.And(Q.And(A, X), B)), ("a1 ()", A, Q.And(A, X)), ("( a1", A, A), ("!=a1", Q.Not(A), A), ("2024", X, Q.Term("2024")), ("", X, X),
    ("a1 !", A, Q.And(A, Q.Not(X))), ("a1 || (&& b1)", Q.Or(A, B), Q.Or(A, Q.And(X, B))), ("a1 || b1 ) c1", Q.And(Q.Or(A, B), Q.Term("c1")), Q.Or(A, B)), ("a1 || && b1", Q.Or(A, B), Q.Or(A, Q.And(X, B))),
    ("a1 || b1 && !a1", Q.Or(A, Q.And(B, Q.Not(A))), Q.Or(A, Q.And(B, Q.Not(A)))), ('"', X, X), ("a1 & b1", Q.And(A, B), Q.And(A, B)),
]


@pytest.mark.parametrize(("text", "f", "b"), TABLE)
def test_malformed_and_plain_queries(text, f, b):
    assert Q.parse(text, "F") == f
    assert Q.parse(text, "B") == b


def test_phrases_and_windows():
    assert Q.parse_f('"gene editing"') == Q.Near(("gene", "edit"), 2)
    assert Q.parse_f("«gene editing» / 5") == Q.Near(("gene", "edit"), 5)
    assert Q.parse_f("gene editing / 5") == Q.And(Q.Term("gene"), Q.Term("edit"))
    assert Q.parse_f("gene-editing / 5") == Q.Near(("gene", "edit"), 5)
    assert Q.parse_f("gene-editing") == Q.Term("gene")
    assert Q.parse_f('"cat" / 9') == Q.Term("cat")
    assert Q.parse_f('"!!!"') == Q.Nothing()
    assert Q.parse_f("16S") == Q.Term("s") and Q.parse_f("cas9") == Q.Term("cas9")
    assert Q.parse_b('"crispr cas9" / 5') == Q.And(Q.And(Q.Term("crispr"), Q.Term("cas9")), Q.Term("5"))


def brute(lists, d):
    def go(k, first, last):
        if k == len(lists):
            return last - first <= d if d != len(lists) else True
        return any(go(k + 1, first, p) for p in lists[k] if (p == last + 1 if d == len(lists) else p > last))

    return any(go(1, p, p) for p in lists[0])


def test_positions_against_backtracking(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(400):
        lists = [sorted(rng.sample(range(25), rng.randint(1, 6))) for _ in range(3)]
        if rng.random() < 0.3:
            lists[2] = lists[1]
        cases.append((*lists, {d: brute(lists, d) for d in range(8)}))
    rows = spark.createDataFrame([c[:3] for c in cases], "p array<int>, q array<int>, r array<int>").coalesce(1)
    cols = [Q.near_column([F.col("p"), F.col("q"), F.col("r")], d).alias(f"d{d}") for d in range(8)]
    got = rows.select("p", "q", "r", *cols).collect()
    want = {(tuple(a), tuple(b), tuple(c)): v for a, b, c, v in cases}
    for g in got:
        assert {d: g[f"d{d}"] for d in range(8)} == want[tuple(g.p), tuple(g.q), tuple(g.r)]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, "the cat and the dog"), (1, "dog cat"), (2, ""), (3, "the the end"), (4, "Katzen")]
    docs = spark.createDataFrame([(i, f"u{i}", f"T{i}" if i else "", t) for i, t in rows], "doc_id long, url string, title string, text string")
    return index.build(docs)


@pytest.mark.parametrize(
    ("q", "ids"),
    [("cat", [0, 1]), ("!cat", [2, 3, 4]), ("cat dog", [0, 1]), ('"cat dog"', []), ('"dog cat"', [1]), ('"cat dog" / 9', [0]), ('"the the"', [3]), ('"the the" / 3', [0, 3]), ("nothing", []), ("!nothing && !cat", [2, 3, 4]), ("(cat || end) && !and", [1, 3]), ("", [])],
)
def test_search(small, q, ids):
    assert sorted(r.doc_id for r in search.search(small, q).collect()) == ids


def test_pages_and_batches(small):
    page = [(r["rank"], r.doc_id, r.line) for r in search.page(small, "!nothing", size=2, offset=1).orderBy("rank").collect()]
    assert page == [(2, 1, "T1 (u1)"), (3, 2, "T2 (u2)")]
    got, errors = search.run_file(small, ["cat", "", "!cat"])
    assert sorted((r.query_id, r.hits, r["rank"], r.doc_id) for r in got.collect()) == [(1, 2, 1, 0), (1, 2, 2, 1), (2, 3, 1, 2), (2, 3, 2, 3), (2, 3, 3, 4)]
    assert not errors


def test_one_exchange_for_any_boolean_query(spark, tmp_path, small):
    index.write(small, str(tmp_path / "i"))
    stored = index.load(spark, str(tmp_path / "i"))
    df = search.search(stored, '(cat && dog || "the end") && cat')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [In(term" in df._jdf.queryExecution().executedPlan().toString() or "In(term" in plan
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(r.doc_id for r in df.collect()) == [0, 1]


def test_repeated_documents_and_long_lists(spark, small):
    docs = spark.createDataFrame([(7, "u", "", "cat dog"), (7, "u", "", "cat x cat dog"), (7, "u", "", "cat dog"), (8, "v", "t", None)], "doc_id long, url string, title string, text string")
    twice = index.build(docs)
    assert [r.doc_id for r in search.search(twice, '"cat dog"').collect()] == [7]
    assert {r.line for r in search.batch(twice, {1: "dog"}).collect()} == {"No Title (u)"}
    # Quadratic in the list, this would take minutes.
    long = spark.createDataFrame([(1, "u", "t", "the of " * 40_000 + "end")], "doc_id long, url string, title string, text string")
    assert [search.search(index.build(long), q).count() for q in ('"the of" / 3', '"of of" / 1', '"of the end" / 2', '"of end"', '"end the"')] == [1, 0, 1 - 1, 1, 0]


NAMES = [n for n in registered.queries() if n in registered.oracle_sql()]


def test_every_query_has_sql():
    assert set(registered.queries()) == set(registered.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, sf, name):
    same_rows(registered.queries()[name](spark, sf).toPandas(), duck.execute(registered.oracle_sql()[name]).df())
