"""Stores of folders by key hash, batches that count once, stateful counts, the visited set and the table function."""

import os

import pytest
from pyspark.sql import functions as F

from lexispark.functions import table as table_functions
from lexispark.operators import analysis, index, ingest
from lexispark.operators.store import Store
from lexispark.streaming import recrawl, term_counts

PAGE = "url string, raw_content string, raw_sha256 string, parsed_text string"


def corpus(spark, n=2000):
    i = F.col("id")
    url = F.concat(F.lit("http://h/"), i.cast("string"))
    return spark.range(n).select(url.alias("url"), F.lit("old").alias("raw_sha256"), i.alias("fetched_at"), i.alias("checked_at"))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(store):
    return {r.url: (r.raw_sha256, r.fetched_at, r.checked_at) for r in store.read().collect()}


def test_ten_keys_rewrite_at_most_ten_folders(spark, tmp_path):
    store = Store.create(corpus(spark), str(tmp_path / "s"), buckets=64)
    assert Store.open(spark, str(tmp_path / "s")) == store and store.read().count() == 2000
    before, was = files(tmp_path / "s" / "rows"), rows(store)
    new = spark.createDataFrame([(f"http://h/{k * 100}", "new", f"note {k}") for k in range(9)] + [("http://new/", "new", "x")], "url string, raw_sha256 string, note string")
    touched = store.upsert(new)
    kept = before & files(tmp_path / "s" / "rows")
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before - kept}
    assert 1 < len(touched) <= 10 and changed <= {str(b) for b in touched} and len(kept) >= 54
    now = rows(store)
    assert {u for u in now if now[u] != was.get(u)} == {f"http://h/{k * 100}" for k in range(9)} | {"http://new/"}
    assert now["http://h/100"] == ("new", 100, 100) and store.read().where("note is not null").count() == 10
    store.touch(new.where("url like 'http://h%'"), 7)
    assert rows(store)["http://h/100"] == ("new", 100, 7) and rows(store)["http://h/1"] == ("old", 1, 1)
    store.insert_if_absent(spark.createDataFrame([("http://h/5", "x"), ("http://h/x", "y"), ("http://h/x", "z")], "url string, raw_sha256 string"), ["raw_sha256"])
    assert rows(store)["http://h/5"][0] == "old" and rows(store)["http://h/x"][0] == "y"
    found = store.lookup(spark.createDataFrame([("http://h/7",), ("nowhere",)], "url string"))
    assert [r.url for r in found.collect()] == ["http://h/7"]
    assert {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles() if "_bucket=" in f} <= {str(b) for b in store._buckets_of(found)} | {str(b) for b in store._buckets_of(spark.createDataFrame([("nowhere",)], "url string"))}
    assert store.upsert(new.limit(0)) == []
    with pytest.raises(ValueError, match="no store"):
        Store.open(spark, str(tmp_path / "none"))


def pages(spark, *urls):
    return spark.createDataFrame([(u, "x", "sha of " + u, "t") for u in urls], PAGE)


def test_batches_count_once(spark, tmp_path):
    store = Store.create(corpus(spark, 300), str(tmp_path / "s"), buckets=8)
    clock = iter(range(1000, 2000, 10))
    merge = recrawl.merge_into(store, "web", lambda: next(clock))
    merge(pages(spark, "http://h/1", "http://a/"), 0)
    after = rows(store)
    assert after["http://a/"] == ("sha of http://a/", 1000, 1000) and after["http://h/1"][1] == 1000
    before = files(tmp_path / "s" / "rows")
    merge(pages(spark, "http://h/1", "http://a/"), 0)
    assert rows(store) == after and files(tmp_path / "s" / "rows") == before
    # The same pages in another batch are unchanged, and fresh ones are left alone.
    merge(pages(spark, "http://a/", "http://a/"), 1)
    assert rows(store)["http://a/"] == ("sha of http://a/", 1000, 1010) and len(rows(store)) == 301
    recrawl.merge_into(store, "other", lambda: 1020, fresh_seconds=500)(pages(spark, "http://a/"), 0)
    assert rows(store)["http://a/"] == ("sha of http://a/", 1000, 1010)


@pytest.mark.parametrize("where", ["stage", "note", "put", "clear"])
def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch, where):
    store = Store.create(corpus(spark, 300), str(tmp_path / "s"), buckets=8)
    was = rows(store)
    recrawl.merge_into(store, "web", lambda: 1000)(pages(spark, "http://h/2"), 0)

    class Crash(Exception):
        pass

    def crash(*_a, **_k):
        raise Crash

    from lexispark.operators import store as module

    with monkeypatch.context() as m:
        if where == "stage":
            m.setattr(Store, "_stage", crash)
        elif where == "note":
            m.setattr(Store, "_put", crash)
        elif where == "put":
            # Folders are gone, and the new ones are not there yet.
            def half(self):
                for b in range(4):
                    for f in files(tmp_path / "s" / "rows" / f"_bucket={b}"):
                        os.remove(f)
                raise Crash

            m.setattr(Store, "recover", lambda self, first=[1]: first.pop() if first else half(self))
        else:
            note = module._note
            m.setattr(module, "_note", lambda s, path, *a: crash() if path.endswith("done") else note(s, path, *a))
        with pytest.raises(Crash):
            recrawl.merge_into(store, "web", lambda: 2000)(pages(spark, "http://new/", *(f"http://h/{k}" for k in range(50))), 1)
    # Another run finds the store and gets the batch again, later.
    again = Store.open(spark, str(tmp_path / "s"))
    recrawl.merge_into(again, "web", lambda: 3000)(pages(spark, "http://new/", *(f"http://h/{k}" for k in range(50))), 1)
    now = rows(again)
    assert len(now) == 301 and now["http://new/"] == ("sha of http://new/", 2000, 2000) and now["http://h/3"] == ("sha of http://h/3", 2000, 2000)
    assert now["http://h/2"] == ("sha of http://h/2", 1000, 2000) and now["http://h/77"] == was["http://h/77"]


def test_term_counts_of_a_stream(spark, tmp_path):
    at = str(tmp_path)
    texts = ["Cats and cats", "the dog", None, "", "cat dogs running"]
    write = lambda k, part: spark.createDataFrame([(t,) for t in part], "text string").write.mode("append").parquet(f"{at}/in")

    def run():
        stream = spark.readStream.schema("text string").parquet(f"{at}/in")
        term_counts.start(stream, f"{at}/out", f"{at}/state").awaitTermination()
        return {r.term: r.freq for r in term_counts.read(spark, f"{at}/out").collect()}

    write(0, texts[:2])
    assert run() == {"cat": 2, "and": 1, "the": 1, "dog": 1}
    write(1, texts[2:])
    # From its checkpoint: only the new files are read, and the counts go on.
    got = run()
    everything = spark.read.parquet(f"{at}/in")
    assert got == {r.term: r.freq for r in analysis.term_counts(everything).collect()} and got["cat"] == 3
    last = max(int(f.split("batch=")[1].split("/")[0]) for f in files(f"{at}/out"))
    changed = spark.read.parquet(f"{at}/out/batch={last}")
    assert {r.term for r in changed.collect()} == {"cat", "dog", "run"}
    # The last batch once more, as after a crash between its writing and its commit.
    changed.union(changed.limit(0)).write.mode("overwrite").parquet(f"{at}/out/batch={last + 1}")
    assert run() == got


def test_visited_urls_are_not_moved(spark, tmp_path):
    n = 4
    name = "asked_in_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for k in range(3):
        ingest.remember(spark.createDataFrame([(f"u{i}",) for i in range(100 * k, 100 * k + 100)], "url string"), name, str(tmp_path / "asked"), n)
    todo = spark.createDataFrame([(f"u{i}",) for i in range(250, 350)], "url string")
    left = ingest.unasked(todo, spark.table(name))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted(r.url for r in left.collect()) == [f"u{i}" for i in range(300, 350)]
    spark.sql(f"DROP TABLE {name}")


def test_table_function(spark):
    docs = spark.createDataFrame([(1, "Cats sat; cats!"), (2, None), (3, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("some_docs")
    table_functions.register(spark)
    got = spark.sql("SELECT doc_id, t.pos, t.term FROM some_docs, LATERAL terms(text) t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.tokens(docs).collect())) == [(1, 0, "cat"), (1, 1, "sat"), (1, 2, "cat")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM tokens('A b-C')").collect()] == [(0, "a"), (1, "b"), (2, "c")]
