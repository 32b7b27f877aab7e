"""Token counts, packing, line dedup: exact results on small tables."""

import bisect
import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lexispark.llm import common, line_dedup, packing, queries, token_counts

WORDS = P.path("word_bpe_49k.json")
EDGE = [None, "", "   ", "a", "word " * 9000, "word " * 9000, "x" * 3000, "Été ÇA!! don't «ü» 12", "<|endoftext|> a\x1cb", "한국어 テスト"]


@pytest.fixture(scope="module")
def docs(spark):
    # A column that clashes with names that operators use inside.
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, same string, _group int")


def test_suffix_sums(spark, docs):
    length = token_counts.encoded_length(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = token_counts.suffix_sums(token_counts.length_histogram(docs, length))
    enc = token_counts.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sizes = [len(enc.encode_ordinary(t or "")) for t in EDGE]
    for r in got.collect():
        n = r.n_tokens
        assert r.n_docs == sizes.count(n)
        assert r.docs_at_least == sum(s >= n for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.truncated_total == sum(min(s, n) for s in sizes) and r.docs_total == len(sizes) and r.tokens_total == sum(sizes)
        assert r.share_at_most == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    assert got.count() == len(set(sizes))
    for r in token_counts.totals_at(got, [0, 1, 5, 100, 10**6]).collect():
        assert r.truncated_total == sum(min(s, r.context_limit) for s in sizes) and r.docs_at_limit == sum(s >= r.context_limit for s in sizes)
    for r in token_counts.quantiles(got, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[max(0, int(np.ceil(r.probability * len(sizes))) - 1)]
    empty = token_counts.suffix_sums(token_counts.length_histogram(docs.limit(0), length))
    assert empty.count() == 0


def test_encoder_memory_is_exact(spark, sf):
    enc = packing.WordEncoder(WORDS)
    texts = [t for t in EDGE if t] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert enc.encode(texts) == want


def test_packing(spark, docs):
    got = packing.pack_documents(docs.union(docs), WORDS, group_pieces=7).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(EDGE):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want = sorted((k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))) * 2
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_sums_of_squares_choice_and_tightness():
    def brute(lengths, cap):
        bins, where = [], []
        for s in lengths:
            best = None
            room = [(b, gap) for b, gap in enumerate(bins) if gap >= s]
            for b, gap in room or [(None, cap)]:
                if gap >= s:
                    after = [g for i, g in enumerate(bins) if i != b] + [gap - s]
                    cost = sum(after.count(g) ** 2 for g in set(after) if g)
                    key = (cost, gap)
                    if best is None or key < best[0]:
                        best = (key, b)
            b = best[1]
            if b is None:
                bins.append(cap)
                b = len(bins) - 1
            where.append(cap - bins[b])
            bins[b] -= s
        return len(bins), where

    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 20) for _ in range(40)]
        bins, offsets = packing.pack_lengths(np.array(lengths), 20)
        assert (bins.max() + 1, offsets.tolist()) == brute(lengths, 20)

    def best_fit_decreasing(lengths, cap):
        gaps = []
        for s in lengths:
            at = bisect.bisect_left(gaps, s)
            gap = gaps.pop(at) if at < len(gaps) else cap
            bisect.insort(gaps, gap - s)
        return len(gaps)

    for top in (1200, 2500, 4096):
        lengths = -np.sort(-np.random.default_rng(1).integers(1, top + 1, 8192))
        assert packing.pack_lengths(lengths, 4096)[0].max() + 1 <= 1.01 * best_fit_decreasing(lengths.tolist(), 4096)


def test_packing_deals_evenly(spark):
    # One document of very many pieces, and one id that repeats: groups are as large as any.
    docs = spark.createDataFrame([(1, "word " * 4096 * 40)] + [(2, "a b c")] * 60, "doc_id long, text string").repartition(3)
    parts = common.cut(packing.pieces(docs, WORDS, capacity=256))
    assert parts.count() == 641 + 60
    sizes = [r["count"] for r in parts.groupBy(F.pmod("turn", F.lit(10))).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 80
    got = packing.pack_documents(docs, WORDS, capacity=256, group_pieces=70).collect()
    assert len(got) == 701 and len({(r.sequence_id, r.offset) for r in got}) == 701


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want, total = {}, 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k] = (at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes()))
    got = queries.op9_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1.01 * -(-total // 4096) + 1


def test_token_count_query(spark, sf):
    enc = token_counts.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sizes = collections.Counter(len(enc.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.n_tokens: (r.n_docs, r.docs_at_least, r.truncated_total) for r in queries.op1_token_counts(spark, sf).collect()}
    assert got == {n: (c, sum(m for k, m in sizes.items() if k >= n), sum(min(k, n) * m for k, m in sizes.items())) for n, c in sizes.items()}


def test_very_long_runs_of_white_space(spark):
    enc = token_counts.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(4)
    # At sizes that the encoder itself can read, counts agree.
    for _ in range(60):
        run = "".join(rng.choice(" \n\t\u3000\xa0") for _ in range(5)) * rng.choice([4100, 9000])
        text = rng.choice(["", "a", "it's 12", "!"]) + run + rng.choice(["", "b", "\x1c", "'s", "7 x", "!?"]) + rng.choice(["", run])
        assert token_counts.count_ids(enc, text) == len(enc.encode_ordinary(text))
    docs = spark.createDataFrame([(0, " " * 2_000_000), (1, "a" + "\n" * 2_000_000 + " b"), (2, "x" * 2_000_000)], "doc_id long, text string")
    length = token_counts.encoded_length(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r.n for r in docs.select("doc_id", length.alias("n")).collect()}
    assert got[0] == len(enc._encode_single_piece(" " * 2_000_000)) and got[1] == 2 + len(enc._encode_single_piece("\n" * 2_000_000)) and got[2] > 10_000


def test_lines(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu" if i else None, "h", "x") for i in range(6)] + [(9, "menu\nq", "small", "x"), (10, "", None, "x")] + [(20 + i, "n\nz", None, "x") for i in range(5)]
    names = "doc_id long, text string, source string, _keys string, at string, row string, n_lines string"
    docs = spark.createDataFrame([(*r, "a", "r", "old") for r in rows], names)
    for limit in (10**6, 0):
        found = line_dedup.drop_boilerplate(docs, broadcast_lines=limit, ratio=0.2, min_pages=5)
        assert found.columns == ["doc_id", "text", "source", "_keys", "at", "row", "n_lines", "n_dropped"]
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()}
        assert got[0] == (None, 0, 0) and got[1] == ("own 1\n", 4, 2) and got[9] == ("menu\nq", 2, 0)
        assert got[10] == ("", 1, 0) and got[20] == ("", 2, 2) and len(got) == len(rows)
        assert {(r._keys, r.at, r.row) for r in found.collect()} == {("x", "a", "r")}
    plain = line_dedup.drop_boilerplate(docs, ratio=0.2, counts=None)
    assert plain.columns == docs.columns and {r.n_lines for r in plain.collect()} == {"old"}
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_lines_follow_the_ratio_alone(spark):
    # Six pages, lines of one page: a share of 0.167 passes 0.1 and not 0.2; a share that equals the ratio stays.
    docs = spark.createDataFrame([(i, f"own {i}\nshared" if i < 3 else f"own {i}", "h") for i in range(6)], "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.drop_boilerplate(docs, ratio=0.1).collect()} == {""}
    assert {r.text for r in line_dedup.drop_boilerplate(docs, ratio=0.2).collect()} == {f"own {i}" for i in range(6)}
    assert line_dedup.drop_boilerplate(docs, ratio=0.5).where("n_dropped > 0").count() == 0
    # Repeated rows are pages each.
    twice = docs.union(docs.where("doc_id = 5"))
    assert {r.doc_id for r in line_dedup.drop_boilerplate(twice, ratio=0.25).where("text = ''").collect()} == {5}


def test_lines_of_a_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    huge = spark.createDataFrame([(i, "m\n" + ("own\n" * 300_000 if i == 1 else "x")) for i in range(20)], "doc_id long, text string").withColumn("source", F.lit("h"))
    assert line_dedup.drop_boilerplate(huge, ratio=0.5).where("doc_id = 1 and n_dropped = 1 and n_lines = 300002 and text like 'own%'").count() == 1
    docs = spark.createDataFrame([(i, long + f"\n{i}", "h") for i in range(3)] + [(9, "x", "g")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(docs, ratio=0.5).where("source = 'h'").collect()}
    assert got == {i: (str(i), 3000) for i in range(3)}


@pytest.mark.parametrize("name", ["op4_line_dedup"])
def test_against_sql(spark, duck, sf, name):
    duck.execute("CREATE OR REPLACE VIEW big AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    if name == "op4_line_dedup":
        assert duck.execute(f"SELECT sum(n_dropped) FROM ({queries.OP4_SQL.replace('documents', 'big')})").fetchone()[0] > 0
    same_rows(queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_line_dedup_stays_native(spark, sf):
    df = queries.op4_line_dedup(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
