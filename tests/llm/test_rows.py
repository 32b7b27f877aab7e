"""Rows that are out of the ordinary, for all operators: large ids beside nulls, samples of like rows, inputs made to be slow."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, fill_middle, filter_audit, html_extract, language_id, line_dedup, ngram_join, nn_graph, packing, quality, simhash, substring_dedup, token_counts

BIG = 2**53 + 1
IDS = [BIG, BIG + 1, BIG + 3, None, None]


@pytest.fixture(scope="module")
def docs(spark):
    words = random.Random(2)
    passage = " ".join(f"word{words.randint(0, 900)}" for _ in range(80))
    rows = [(i, f"{passage} {k}" if k != 3 else None, "en", "s") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.fixture(scope="module")
def item(docs):
    return docs.where("text is not null").select(F.lit(BIG + 7).alias("item_id"), "text").limit(1)


def results(docs, item):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model, classifier = language_id.fit(docs), quality.fit(docs, labels)
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.rand(3)).alias("embedding"))
    return {
        "op1": docs.select("doc_id", token_counts.encoded_length(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)),
        "op2": decontaminate.find(docs, decontaminate.prepare(item)),
        "op3": substring_dedup.dedup(docs),
        "op4": line_dedup.drop_boilerplate(docs),
        "op5": docs.select("doc_id", quality.score(F.col("text"), classifier)),
        "op6": ngram_join.near_duplicates(docs),
        "op7": docs.select("doc_id", html_extract.extract(F.col("text"), html_extract.fit(docs.select(F.col("text").alias("html"), F.lit("u").alias("url"), F.col("doc_id").alias("page_id"))))),
        "op8": docs.select("doc_id", language_id.predict(F.col("text"), model)),
        "op9": packing.pack_documents(docs, P.path("word_bpe_49k.json")),
        "op10": nn_graph.nearest(vectors, F.lit(True)).select(F.col("query_id").alias("doc_id")).distinct(),
        "op11": docs.select("doc_id", fill_middle.arrange(F.col("text"), F.col("doc_id"))),
        "op13": simhash.near_duplicates(docs),
    }


def test_ids_stay_exact_beside_nulls(docs, item):
    whole = sorted(IDS, key=lambda i: (i is None, i))
    named = [i for i in whole if i is not None]
    for name, frame in results(docs, item).items():
        got = sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda i: (i is None, i))
        want = {"op2": [*named, None], "op6": named, "op10": named}.get(name, whole)
        assert got == want, name
    assert {r.item_id for r in decontaminate.find(docs, decontaminate.prepare(item)).collect()} == {BIG + 7}
    least = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert set(least.values()) <= {None, *IDS} and all(c <= i for i, c in least.items())
    audit = filter_audit.audit(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic")))
    assert audit.where("filter_order = 'ABCDE' and step = 1").first().good_lost == 3


def test_neighbours_of_odd_rows(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)] + [(None, [50.0, 1.0]), (90, None), (91, [1.0]), (92, [1.0, 2.0, 3.0]), (93, [])]
    got = nn_graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=3).collect()
    assert {r.query_id for r in got} == set(range(1, 30)) and all(r.score is not None and r.vec_id < 90 for r in got)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 7] == [29, 28, 27]
    assert nn_graph.nearest(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_samples_do_not_hang_on_ids(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(words) for _ in range(30)), lang) for words, lang in ((["der", "hund", "und"], "de"), (["the", "dog", "and"], "en")) for _ in range(900)]
    for ids in (lambda k: 5, lambda k: None, lambda k: k):
        docs = spark.createDataFrame([(ids(k), t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
        model = language_id.fit(docs, sample=50)
        assert model.languages == ["de", "en"]
        assert docs.where(language_id.predict(F.col("text"), model)["lang_pred"] != F.col("lang")).count() == 0
        some = language_id.bounded_sample(docs, "lang", ["doc_id", "text"], 50).groupBy("lang").count().collect()
        assert all(20 < r["count"] <= 50 for r in some) and len(some) == 2
    # Rows that are all alike.
    alike = spark.createDataFrame([(1, "the dog and the cat", "en")] * 2000, "doc_id long, text string, lang string")
    assert 1 <= language_id.bounded_sample(alike, "lang", ["doc_id", "text"], 50).count() <= 50
    assert language_id.fit(alike, sample=50).languages == ["en"]


def test_long_runs_of_white_space_are_quick():
    encoding = token_counts.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    began = time.time()
    assert token_counts.count_ids(encoding, "x".join([" " * 19_999] * 50)) > 0
    assert time.time() - began < 2
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "1", "\n", "!", " ", "\x1c", "é"]) if rng.random() < 0.3 else rng.choice(" \t\n\r\x0b ") * rng.choice([1, 2, 63, 64, 65, 130]) for _ in range(rng.randint(1, 8)))
        assert token_counts.count_ids(encoding, t) == len(encoding.encode_ordinary(t)), repr(t)


def test_parser_of_odd_pages():
    text = lambda page: [b.text for b in html_extract.blocks(page)]
    assert text("<article><p>A</p><svg/><p>B</p></article>") == ["A", "B"]
    assert text('<article><p>A</p><svg viewBox="0 / 1" class=\'>\' /><p>B</p><math/>C<svg><p>no</p></svg><p>D</p></article>') == ["A", "B", "C", "D"]
    for page in ("<div>" * 20_000 + "</span>" * 20_000 + "x", "<section><body>" + "<div>" * 20_000 + "</section>" * 20_000 + "x", "<i>" * 20_000 + "</p>" * 20_000 + "x"):
        began = time.time()
        assert text(page) == ["x"] and time.time() - began < 1
    nested = "<div><p>a<ul><li>b<li>c</ul></div>d<table><tr><td>e<td>f<tr><td>g</table>h"
    assert text(nested) == ["a", "b", "c", "d", "e", "f", "g", "h"]


def test_scores_are_the_models(spark):
    """Language and quality, row by row from the model in plain numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.collect()]
    got = docs.select("text", language_id.predict(F.col("text"), model).alias("p")).collect()
    assert len(got) == len(texts)
    for r in got:
        x = np.log1p(language_id.counts(r.text)) * model.idf
        cosines = model.centroids @ (x / max(np.linalg.norm(x), 1e-9))
        known = any(c.isalpha() for c in r.text or "")
        assert r.p.lang_pred == (model.languages[model.owner[int(cosines.argmax())]] if known else "und")
        assert abs(r.p.score - (min(1, max(0, cosines.max())) if known else 0)) < 1e-5
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    q = quality.fit(docs, labels)
    for r in docs.select("text", quality.score(F.col("text"), q).alias("s")).collect():
        z = [(f - m) / s for f, m, s in zip(quality.features(r.text), q.mean, q.scale, strict=True)]
        raw = q.slope * sum(max(-8, min(8, a)) * w for a, w in zip(z, q.weights, strict=True)) + q.offset
        assert abs(r.s - 1 / (1 + np.exp(-max(-30, min(30, raw))))) < 1e-9


def test_quality_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(["a good text . " * 50, "bad", None, "", "x " * 500_000])], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 7)], "doc_id long, quality int")
    for fitted in (quality.fit(docs, labels), quality.fit(docs.limit(0), labels), quality.fit(docs, labels.limit(0))):
        scores = [r[0] for r in docs.select(quality.score(F.col("text"), fitted)).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
        assert docs.limit(0).select(quality.score(F.col("text"), fitted)).count() == 0
