"""Bitmaps of documents, pages that end early and tables of queries, against plain sets and the other ways to search."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lexispark import queries as registered
from lexispark.operators import bitmaps, index, query_table, search
from lexispark.plans import query as Q

WORDS = "alpha beta gamma delta cat dog end".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    ids = rng.sample(range(-300, 3000), 700) + [2**40 + 5, 2**53 + 1]
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) for i in ids}


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([(i, f"u{i}", f"T{i}" if i % 3 else "", t) for i, t in corpus.items()], "doc_id long, url string, title string, text string")
    index.write(index.build(docs), at)
    return index.load(spark, at)


def matches(node, words):
    match node:
        case Q.Term(t):
            return t in words
        case Q.Near(ts, d):
            return near(words, ts, d)
        case Q.Not(x):
            return not matches(x, words)
        case Q.And(a, b):
            return matches(a, words) and matches(b, words)
        case Q.Or(a, b):
            return matches(a, words) or matches(b, words)
    return False


def near(words, terms, d):
    def go(k, first, last):
        if k == len(terms):
            return d == len(terms) or last - first <= d
        return any(words[p] == terms[k] and go(k + 1, first, p) for p in (range(last + 1, len(words)) if d != len(terms) else range(last + 1, min(last + 2, len(words)))))

    return any(w == terms[0] and go(1, p, p) for p, w in enumerate(words))


def random_query(rng, depth=0, windows=True):
    kind = rng.random()
    if depth > 2 or kind < 0.35:
        return rng.choice([*WORDS, "unknown"])
    if kind < 0.5 and windows:
        phrase = '"' + " ".join(rng.choice(WORDS[:4]) for _ in range(rng.randint(2, 4))) + '"'
        return phrase + (f" / {rng.randint(1, 6)}" if rng.random() < 0.6 else "")
    if kind < 0.65:
        return "!" + random_query(rng, depth + 1, windows)
    return f"({random_query(rng, depth + 1, windows)} {rng.choice(['&&', '||', ''])} {random_query(rng, depth + 1, windows)})"


def expected(corpus, query):
    from lexispark.functions.text import stem_text

    node = Q.parse(query)
    return sorted(i for i, t in corpus.items() if matches(node, stem_text(t)))


def test_set_operations(spark):
    rng = random.Random(2)
    sides = [[rng.randint(-200, 200) for _ in range(150)] + [2**62, -(2**62)] * k for k in (0, 1)]
    a, b = (bitmaps.bitmaps(spark.createDataFrame([(i,) for i in s], "doc_id long")) for s in sides)
    left, right = map(set, sides)
    for how, want in (("union", left | right), ("intersect", left & right), ("difference", left - right)):
        got = bitmaps.combine(a, b, how)
        assert sorted(r.doc_id for r in bitmaps.members(got).collect()) == sorted(want)
        assert bitmaps.size(got).first().n == len(want)
    assert bitmaps.size(a.limit(0)).first().n == 0


def test_boolean_queries_against_sets(corpus, stored):
    rng = random.Random(4)
    for _ in range(25):
        q = random_query(rng, windows=False)
        want = expected(corpus, q)
        assert sorted(r.doc_id for r in search.search(stored, q).collect()) == want, q
        assert search.hit_count(stored, q).first().hits == len(want), q
    with pytest.raises(ValueError, match="positions"):
        bitmaps.to_bits(Q.Near(("a", "b"), 2), {})


def test_boolean_plans_read_no_positions(stored):
    for q in ("cat && dog", "!cat", "cat || !dog && end"):
        plan = search.search(stored, q)._jdf.queryExecution().executedPlan().toString()
        assert "positions" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = search.search(stored, '"cat dog" && !end')._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert ["positions" in s for s in scans] == [True, False]
    assert "positions" not in stored.ids(["cat"])._jdf.queryExecution().executedPlan().toString()


def test_pages_in_order_of_ids(corpus, stored):
    for q in ("cat", "!cat", '"cat dog" / 4', "unknown", "cat && !dog", ""):
        want = expected(corpus, q)
        for size, offset in ((5, 0), (5, 7), (1000, 3), (3, 10_000)):
            got = search.page(stored, q, size=size, offset=offset).orderBy("rank").collect()
            assert [(r["rank"], r.doc_id) for r in got] == [(offset + k, i) for k, i in enumerate(want[offset : offset + size], 1)], q


def test_first_page_reads_a_part(spark, tmp_path, monkeypatch):
    """However many documents have a term, its first page asks for one range of ids, and skips row groups of others."""
    spans = []
    for n in (20_000, 80_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("common word").alias("text"))
        spark.conf.set("parquet.block.size", 32 * 1024)
        at = str(tmp_path / str(n))
        index.write(index.build(docs), at)
        ranges = []
        within = index.Index.within
        monkeypatch.setattr(index.Index, "within", lambda self, a, z: ranges.append((a, z)) or within(self, a, z))
        stored = index.load(spark, at)
        assert search.first_ids(stored, "common", "F", 10) == list(range(10))
        monkeypatch.setattr(index.Index, "within", within)
        part = stored.within(*ranges[0]).ids(["common"])
        part.collect()
        spans.append((len(ranges), ranges[0][1] - ranges[0][0]))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(doc_id" in plan and "LessThanOrEqual(doc_id" in plan
    assert spans == [(1, search.LEAST_RANGE)] * 2


def test_query_table_against_sets_and_batch(spark, corpus, stored):
    rng = random.Random(5)
    texts = {k: random_query(rng) for k in range(60)} | {60: "", 61: '"', 62: "unknown", 63: "!unknown", 64: '"cat cat" / 3', 65: '"unknown cat"'}
    table = spark.createDataFrame(list(texts.items()), "query_id long, query string")
    programs = query_table.parsed(table)
    programs.write.mode("overwrite").format("noop").save()
    sets = bitmaps.members(query_table.evaluate(stored, programs), "query_id").collect()
    found = {k: sorted(r.doc_id for r in sets if r.query_id == k) for k in texts}
    assert found == {k: expected(corpus, q) for k, q in texts.items()}
    rows = lambda df: sorted(map(tuple, df.select("query_id", "hits", "rank", "doc_id", "title", "url", "line").collect()))
    assert rows(query_table.batch(stored, table)) == rows(search.batch(stored, texts))
    bad = query_table.parsed(spark.createDataFrame([(1, '"a b" / ' + "9" * 5000), (2, None)], "query_id long, query string")).collect()
    assert {r.query_id: r.error is not None for r in bad} == {1: True, 2: False}


def test_many_queries_have_a_plan_of_one_size(spark, stored, monkeypatch):
    rng = random.Random(6)
    sizes = []
    for n in (10, 10_000):
        table = spark.createDataFrame([(k, random_query(rng)) for k in range(n)], "query_id long, query string")
        programs = query_table.parsed(table)
        sets = query_table.evaluate(stored, query_table.cut(programs, "programs"))
        plan = sets._jdf.queryExecution().analyzed().toString()
        sizes.append(sum("Join" in line or "Aggregate" in line for line in plan.split("\n")))
        counts = bitmaps.size(sets, "query_id")
        assert 0 < counts.count() <= n
    assert sizes[0] == sizes[1]
    # Joined by shuffles, the rows are the same.
    monkeypatch.setattr(query_table, "BROADCAST_LEAVES", 0)
    few = query_table.cut(query_table.parsed(spark.createDataFrame([(1, "cat && !dog"), (2, '"cat dog"')], "query_id long, query string")), "programs")
    assert bitmaps.size(query_table.evaluate(stored, few), "query_id").count() == 2


def test_report_of_a_query_file(spark, corpus, tmp_path):
    from lexispark import __main__ as command

    at = str(tmp_path / "i")
    docs = spark.createDataFrame([(i, f"u{i}", f"T{i}", t) for i, t in corpus.items()], "doc_id long, url string, title string, text string")
    index.write(index.build(docs), at)
    bad = '"a b" / ' + "9" * 5000
    (tmp_path / "q.txt").write_text(f"cat && !dog\n\n  unknown \r\n{bad}\n\"cat dog\"")
    command.main([at, str(tmp_path / "q.txt"), str(tmp_path / "out"), "--size", "2"])
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    cats, pairs = expected(corpus, "cat && !dog"), expected(corpus, '"cat dog"')
    want = ["Query: cat && !dog", f"Found {len(cats)} docs.", *(f"{k}. T{i} (u{i})" for k, i in enumerate(cats[:2], 1)), "", "Query: unknown", "Found 0 docs.", ""]
    assert got[:8] == want and got[8] == f"Query: {bad}" and got[9].startswith("Error: ") and got[10] == ""
    assert got[11:] == ['Query: "cat dog"', f"Found {len(pairs)} docs.", *(f"{k}. T{i} (u{i})" for k, i in enumerate(pairs[:2], 1)), ""]


def test_every_sql_is_quick_inside_another_query():
    """The driver of a comparison may put a text into a subquery, which changes how it is planned."""
    import os

    import duckdb

    sf, con, slow = "/root/testdata/sf0.01", duckdb.connect(), []
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    for name, sql in registered.oracle_sql().items():
        timer = threading.Timer(20, con.interrupt)
        timer.start()
        try:
            con.execute(f"SELECT * FROM ({sql})").fetchone()
        except duckdb.InterruptException:
            slow.append(name)
        timer.cancel()
    assert not slow
