"""Near duplicates, substrings, benchmark passages, neighbours: against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lexispark.llm import components, decontaminate, ngram_join, nn_graph, queries, substring_dedup


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_brute(rows):
    same = collections.defaultdict(list)
    for i, t in rows:
        if len(g := ngram_join.ngrams(t)):
            same[frozenset(g.tolist())].append(i)
    reps = {min(v): s for s, v in same.items()}
    links, parent = collections.Counter(), {i: i for i in reps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(reps)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if len(reps[a] & reps[b]) >= 0.8 * len(reps[a] | reps[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {i: (i, i, 1, 0) for i, _ in rows}
    for s, v in same.items():
        out |= {i: (find(min(v)), min(v), len(v), links[min(v)]) for i in v}
    return out


@pytest.mark.parametrize("cell", [500_000, 400])
def test_near_duplicates(spark, cell):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(4)]
    texts = [None, "", "!!!", "one two", "one two", "One, two!", "w " * 3000]
    for b in base:
        for _ in range(14):
            t = list(b)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [texts[8], texts[8]] + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component int, rep int")
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in ngram_join.near_duplicates(docs, cell=cell, recall=0.99999).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    # One document, by the longest text, of equally long ones the last; repeated rows give one row.
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (4, c), (None, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in ngram_join.near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_near_duplicate_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in queries.op6_ngram_jaccard_join(spark, sf).collect()}
    assert got == near_brute(rows)


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1)


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == 0


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def cover_brute(rows, length):
    first, out = {}, {}
    for i, raw in sorted(rows):
        cover = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            if first.get(raw[p : p + length], i) < i:
                cover[p : p + length] = True
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
        out[i] = cover[:-1]
    return out


@pytest.mark.parametrize(("length", "k", "size"), [(10, 4, 200), (8, 3, 10**9), (50, 20, 500)])
def test_substrings(spark, length, k, size):
    rng = random.Random(length)
    texts = [None, "", "ab" * 400, "ab" * 400, "é" * 90]
    for _ in range(60):
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.7:
            o = rng.choice([x for x in texts if x])
            a = rng.randint(0, len(o))
            t = t[:20] + o[a : a + rng.randint(5, 120)] + t[20:]
        texts.append(t)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, (texts[i] or "").encode()) for i in order]
    docs = spark.createDataFrame([(i, texts[i], 0) for i in order], "doc_id long, text string, bucket int").repartition(3)
    want = cover_brute(rows, length)
    got = substring_dedup.dedup(docs, length=length, k=k, bucket_bytes=size).collect()
    assert len(got) == len(rows)
    raws = dict(rows)
    for r in got:
        cover = np.zeros(len(raws[r.doc_id]), dtype=bool)
        for s in r.spans:
            assert not cover[s.first : s.end].any()
            cover[s.first : s.end] = True
        assert (cover == want[r.doc_id]).all()
        assert bytes(r.kept) == bytes(np.frombuffer(raws[r.doc_id], dtype=np.uint8)[~cover]) and r.n_bytes == len(raws[r.doc_id])
        assert len(r.spans) == int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substrings_of_a_passage_in_every_document(spark):
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + passage[rng.randint(0, 9) : 390 + rng.randint(0, 9)] + f" {i} end" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    # Of thousands of equal segments each task sends one; the rest it settles itself.
    sent = substring_dedup.send(docs, "doc_id", "text", 4, 50, 20)
    sizes = [r.n for r in sent.groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect()]
    assert sum(sizes) < 0.7 * sum(map(len, texts))
    unpack = zstandard.ZstdDecompressor()
    kept = [n for r in sent.collect() if (n := int.from_bytes(unpack.decompress(bytes(r.blob))[:8], "little", signed=True)) > 0]
    settled = [-n for r in sent.collect() if (n := int.from_bytes(unpack.decompress(bytes(r.blob))[:8], "little", signed=True)) < 0]
    assert len(settled) >= 6 and sum(settled) > 2900
    want = cover_brute([(i, t.encode()) for i, t in enumerate(texts)], 50)
    for r in substring_dedup.dedup(docs).collect():
        cover = np.zeros(len(texts[r.doc_id]), dtype=bool)
        for s in r.spans:
            cover[s.first : s.end] = True
        assert (cover == want[r.doc_id]).all()
    assert sum(kept) < 3000 * 12


def test_a_common_phrase_fills_no_bucket(spark):
    """A phrase shorter than a window, between unlike texts: its bucket does not grow with the documents."""
    rng, phrase = random.Random(5), "in the united states of america"
    assert len(phrase) == 31
    largest = {}
    for n in (1000, 4000, 16_000):
        texts = ["".join(rng.choice("abcdefghijkl ") for _ in range(90)) + phrase + "".join(rng.choice("abcdefghijkl ") for _ in range(90)) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        common = substring_dedup.common_cells(docs, "text", 50, 20)
        for way in (None, common):
            sent = substring_dedup.send(docs, "doc_id", "text", 64, 50, 20, common=way)
            unpack = zstandard.ZstdDecompressor()
            count = collections.Counter()
            for r in sent.collect():
                count[r.bucket] += max(0, int.from_bytes(unpack.decompress(bytes(r.blob))[:8], "little", signed=True))
            largest[n, way is None] = max(count.values()) * 64 / sum(count.values())
        got = {r.doc_id: r.spans for r in substring_dedup.dedup(docs).collect()}
        if n == 1000:
            want = cover_brute([(i, t.encode()) for i, t in enumerate(texts)], 50)
            assert {i for i, s in got.items() if s} == {i for i, c in want.items() if c.any()}
    # Against an even share of all segments.
    assert all(largest[n, True] > 2 for n in (1000, 4000, 16_000)) and all(largest[n, False] < 1.5 for n in (1000, 4000, 16_000)), largest


def test_segments_that_a_task_forgets_are_sent(spark):
    few, all_ = substring_dedup.Seen(3), substring_dedup.Seen()
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, names = rng.integers(0, 9, 40).astype(np.uint64), rng.integers(0, 2, 40).astype(np.uint64), rng.integers(0, 50, 40)
        least = {}
        for x, y, d in zip(a.tolist(), b.tolist(), names.tolist()):
            least[x, y] = min(d, least.get((x, y), d))
        here = np.array([d > least[x, y] for x, y, d in zip(a.tolist(), b.tolist(), names.tolist())])
        for seen in (few, all_):
            gone = substring_dedup.repeats(a, b, names, seen)
            assert (gone | ~here).all() and len(seen.a) <= seen.most + 9  # that of one chunk more


def test_substring_query(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = cover_brute(rows, 50)
    raws = dict(rows)
    for r in queries.op3_suffix_array_dedup(spark, sf).collect():
        cover = want[r.doc_id]
        kept = bytes(np.frombuffer(raws[r.doc_id], dtype=np.uint8)[~cover])
        assert (r.n_removed, r.kept_sha256) == (int(cover.sum()), hashlib.sha256(kept).hexdigest())


def test_alignment():
    def brute(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(-1, 5, rng.integers(1, 20))
        assert decontaminate.align(a, b)[0] == brute(a, b)


def edited(words, rng, rate, vocabulary):
    out = []
    for w in words:
        u = rng.random()
        if u < rate / 3:
            continue
        out.append(rng.choice(vocabulary) if u < 2 * rate / 3 else w)
        if 2 * rate / 3 <= u < rate:
            out.append(rng.choice(vocabulary))
    return out


@pytest.mark.parametrize("item_words", [10**6, 300])
def test_decontamination(spark, item_words):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)] + ["the", "of", "and"] * 150
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(16, 50)))) for i in range(25)] + [(90, None), (91, ""), (92, "v1 v2")]
    docs, planted = [(0, None, 1), (1, "", 1)], set()
    for i in range(2, 120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        if i % 3 == 0:
            k = rng.randrange(25)
            words[10:10] = edited(items[k][1].split(), rng, 0.15, vocabulary)
            planted.add((i, k))
        docs.append((i, " ".join(words).title(), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    slices = decontaminate.prepare(table, item_words=item_words)
    assert len(slices) == (1 if item_words > 10**5 else 3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(df, slices).collect()}
    assert planted <= got
    every = decontaminate.Items.of(items, 3, decontaminate.THRESHOLD)
    want = set()
    for i, t, _ in docs:
        w = every.numbers(t)
        for k, x in enumerate(every.words):
            if len(w) and decontaminate.align(x, w)[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(x) and len(x) > 3:
                want.add((i, every.ids[k]))
    assert {g for g in got if g[1] != 92} == want and planted <= want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(df, slices).collect()}
    assert clean == {d[0] for d in docs} - {i for i, _ in got}
    assert decontaminate.find(df.limit(0), slices).count() == 0


def test_decontamination_finds_all_that_brute_force_finds():
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(300)] + ["the", "of", "and"] * 60
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in [3, 4, 6, 9, 10, 11, 12, *[rng.randint(13, 50) for _ in range(33)]]]
    items = decontaminate.Items.of(list(enumerate(texts)), 3, decontaminate.THRESHOLD)
    found = 0
    for trial in range(400):
        words = texts[trial % len(texts)].split()
        kind = trial // len(texts) % 5
        if kind == 0:  # no run of six words stays
            words = ["new" if j % 5 == trial % 5 else x for j, x in enumerate(words)]
        elif kind == 1:  # no run of three
            words = [y for j, x in enumerate(words) for y in ([x, "new"] if j % 2 else [x])]
        else:
            words = edited(words, rng, 0.1 * kind, vocabulary)
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(own))
        w = items.numbers(" ".join(own[:at] + words + own[at:]))
        want = {}
        for k, x in enumerate(items.words):
            score = decontaminate.align(x, w)[0] if len(w) else 0
            if score >= decontaminate.THRESHOLD * decontaminate.MATCH * len(x):
                want[k] = score / (decontaminate.MATCH * len(x))
        assert {k: s for k, s, _, _ in decontaminate.matches(items, w)} == want
        found += trial % len(texts) in want
    assert found > 250


def test_decontamination_by_slices(spark):
    table = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    docs = table.select((F.col("item_id") + 100).alias("doc_id"), "text").union(spark.createDataFrame([(1, "all of its own"), (2, None)], "doc_id long, text string"))
    slices = decontaminate.prepare(table, item_words=50)
    assert len(slices) == 4
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, slices).collect()} == {(i + 100, i) for i in range(9)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, slices).collect()} == {1, 2}


def test_decontamination_edges(spark):
    # Words joined by commas are cut as they are counted; repeated items and documents each give rows; a very long text is searched whole.
    joined = spark.createDataFrame([(k, ",".join(f"w{k}x{i}" for i in range(100))) for k in range(30)], "item_id long, text string")
    assert len(decontaminate.prepare(joined, item_words=300)) == 10
    item = " ".join(f"q{i}" for i in range(30))
    twice = spark.createDataFrame([(1, item), (1, item), (2, "q1 q2")], "item_id long, text string")
    long = "filler words " * 300_000 + item + " and more" * 1000
    docs = spark.createDataFrame([(5, long, 1), (5, long, 1), (6, "q1, Q2!", 1), (7, "q2 q1", 1)], "doc_id long, text string, item_id int")
    slices = decontaminate.prepare(twice)
    got = collections.Counter((r.doc_id, r.item_id, r.first_word) for r in decontaminate.find(docs, slices).collect())
    assert got == {(5, 1, 600_000): 4, (5, 2, 600_001): 2, (6, 2, 0): 1}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, slices).collect()] == [7]
    assert decontaminate.find(docs, decontaminate.prepare(twice.limit(0))).count() == 0


def test_decontamination_query_against_full_alignment(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = decontaminate.Items.of([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()], 3, decontaminate.THRESHOLD)
    want = set()
    for r in rows:
        w = items.numbers(r.text)
        for k, x in enumerate(items.words):
            # Words of the item in common are the only bound taken here.
            if 2 * np.isin(w, x).sum() >= items.needs[k] and decontaminate.align(x, w)[0] >= items.needs[k]:
                want.add((r.doc_id, items.ids[k]))
    assert {(r.doc_id, r.item_id) for r in queries.op2_benchmark_decontamination(spark, sf).collect()} == want and want


def exact(rows, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in ok if j != i))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [None] + [1.0] * 7), (2100, [float("inf")] * 8)]
    rows += [(3000 + i, (np.array(rows[60][1]) * (1 + i / 10)).tolist()) for i in range(5)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, x int").repartition(3)
    want = exact(rows, 20)
    got = collections.defaultdict(list)
    for r in nn_graph.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({j for j, _ in got[q]} & {j for _, j in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    values = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(values[q], values[j])), rel=1e-12) for j, s in found)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in nn_graph.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert nn_graph.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
    # A repeated id is a repeated candidate, with unlike vectors too.
    again = few.union(spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 1.0])], few.schema))
    found = [(r.vec_id, r.score) for r in nn_graph.nearest(again, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(1, 3.0), (2, 1.0), (2, 1.0), (1, 0.0)]


def test_neighbour_query_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 20)
    got = collections.defaultdict(set)
    for r in queries.op10_nearest_neighbours(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {j for _, j in w}) / 20 for q, w in want.items()]) >= 0.9
