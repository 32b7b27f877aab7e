import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import codec
from lexispark.functions.porter import mark, stem_once
from lexispark.functions.text import stem_native, stems, tokenize, tokenize_text
from lexispark.operators import index

PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration",
    "generalization": "gener", "triplicate": "triplic", "formative": "form", "electrical": "electr", "hopefulness": "hope", "adoption": "adopt", "probate": "probat",
    "rate": "rate", "controll": "control", "roll": "roll", "as": "as", "is": "is", "a": "a", "by": "by", "16s": "16", "p53": "p53",
}


def test_stems_of_known_words():
    assert {w: stem_once(w) for w in PAIRS} == PAIRS


def test_y_is_marked_by_its_neighbour_on_the_left():
    def consonant(w, i):
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("ayyeb1") for _ in range(rng.randint(1, 9)))
        assert [c == "Y" for c in mark(w)] == [c == "y" and consonant(w, i) for i, c in enumerate(w)]


def test_native_stems_equal_python_stems(spark):
    rng = random.Random(4)
    parts = ["ational", "eed", "ing", "ed", "y", "yy", "ss", "ies", "ll", "izz", "at", "bl", "e", "ness", "ful", "ion", "t", "s", "w", "x", "a", "o", "b", "1", "00", "ous", "ic", "al", "ate"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(4000)} | set(PAIRS))
    got = spark.createDataFrame([(w, [w]) for w in words], "w string, ws array<string>").select("w", stem_native("ws")[0].alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: stem_once(w) for w in words}


def test_tokens_are_ascii_runs_lowered_after_the_cut(spark):
    texts = ["Réel-TIME 16S", "İstanbul Kelvin", "a\tb\rc\0d", "", "!!!", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    native = [r[0] for r in rows.select(tokenize(F.col("text"))).collect()]
    assert native == [["r", "el", "time", "16s"], ["stanbul", "elvin"], ["a", "b", "c", "d"], [], [], None]
    assert [tokenize_text(t) for t in texts] == [n or [] for n in native]
    assert rows.select(stems(F.col("text"))).collect()[0][0] == ["r", "el", "time", "16"]


def test_postings_hold_all_positions(spark):
    docs = spark.createDataFrame([(0, "the cat the"), (1, ""), (2, None), (3, "cats")], "doc_id long, text string")
    got = {(r.term, r.doc_id): (r.positions, r.tf) for r in index.postings(docs).collect()}
    assert got == {("the", 0): ([0, 2], 2), ("cat", 0): ([1], 1), ("cat", 3): ([0], 1)}
    assert index.postings(docs, ["cat"]).count() == 2


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "u0", "t", "the cat sat"), (1, "u1", "t", "the dog")], "doc_id long, url string, title string, text string")
    built = index.build(docs)
    index.write(built, str(tmp_path / "index"))
    stored = index.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, stored.postings.collect())) == sorted(map(tuple, built.postings.collect()))
    assert sorted(map(tuple, stored.dictionary.collect())) == sorted(map(tuple, built.dictionary.collect()))
    assert {r.term for r in stored.lookup(["the"]).collect()} == {"the"}


def test_document_numbers_follow_urls(spark):
    urls = [f"u{i:03d}" for i in range(57)]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").repartition(5)
    got = {r.url: r.doc_id for r in index.number_documents(rows).collect()}
    assert got == {u: i for i, u in enumerate(urls)}


def encoded(v):
    return bytes([v & 127 | 128]) + encoded(v >> 7) if v > 127 else bytes([v])


def decoded(data):
    out, value, shift = [], 0, 0
    for byte in data:
        value, shift = value | (byte & 127) << shift, shift + 7
        if byte < 128:
            out.append(value)
            value, shift = 0, 0
    return out


def test_codecs(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.varbyte_length(F.col("v")).alias("n"), codec.varbyte_hex(F.col("v")).alias("h")).collect()
    for r in rows:
        assert bytes.fromhex(r.h) == encoded(r.v) and r.n == len(r.h) // 2
    lists = spark.createDataFrame([([3, 7, 20],), ([],), ([5],)], "a array<int>")
    deltas = lists.select(codec.delta_encode(F.col("a")).alias("d"), "a")
    assert [r.d for r in deltas.collect()] == [[3, 4, 13], [], [5]]
    named = deltas.withColumn("id", F.size("d"))
    got = [tuple(r) for r in codec.delta_decode(named, ["id"], "d").orderBy("id", "k").collect()]
    assert got == [(1, 0, 5), (3, 0, 3), (3, 1, 7), (3, 2, 20)]
    coded = lists.select(codec.varbyte(F.col("a")).alias("b")).collect()
    assert [decoded(bytes(r.b)) for r in coded] == [[3, 7, 20], [], [5]]
