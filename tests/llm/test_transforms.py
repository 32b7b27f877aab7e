"""Fill-in-middle, filter audit and SimHash: SQL, brute force and hand-made cases."""

import collections
import hashlib
import itertools
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import fill_middle, filter_audit, queries, simhash


def same(frame, con, name, sf):
    """Whether a query and its SQL give the same rows, nulls included."""
    got = frame.select(sorted(frame.columns)).collect()
    found = con.execute(f"SELECT {', '.join(sorted(frame.columns))} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(found, key=key)
    assert len(got) > 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_filter_interaction_audit"])
def test_query_against_sql(spark, duck, sf, name):
    same(queries.queries()[name](spark, sf), duck, name, sf)


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The contract with strings and a pattern."""
    t = text or ""
    units = UNITS.findall(t)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_edges(spark):
    rng = random.Random(3)
    odd = ["", None, " ", "a", " a", "a ", "\t\n", "a<P>b", "<S", "x <M> y", "é 日本　語  z", "𝒳 𝒴\x0b𝒵 ", "<P", "P> <", "a\x00b c", "\x1c x \x85 y"]
    texts = odd + ["".join(rng.choice("ab <PSM>é\n𝒳") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = [(k * 7, t, "x", 1) for k, t in enumerate(texts * 3)] + [(None, "a b c d", "x", 2), (2**53 + 1, "one two", "x", 3), (5, "same id", "y", 4), (5, "same id", "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = docs.select("doc_id", "text", fill_middle.arrange(F.col("text"), F.col("doc_id")).alias("f")).collect()
    forms = collections.Counter()
    for r in got:
        n, form, p, m, output = plainly(r.doc_id, r.text)
        assert (r.f.n, r.f.form, r.f.prefix_chars, r.f.middle_chars, r.f.output) == (n, form, p, m, output)
        assert r.f.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.f.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        # The table itself, over the text's bytes and the marks.
        buffers = ((r.text or "").encode(), b"<P><M><S>")
        assert b"".join(buffers[d.buffer][d.first : d.end] for d in r.f.pieces) == output.encode()
        forms[form] += 1
    assert len(got) == len(rows) and min(forms.values()) > 20 and len(forms) == 3
    whole = fill_middle.fill_in_middle(docs)
    assert whole.columns == ["doc_id", "text", "form", "n", "_form"]
    back = whole.select("doc_id", "n", fill_middle.restore(F.col("text"), F.col("_form")).alias("text"))
    assert sorted((r.doc_id or -1, r.n, r.text) for r in back.collect()) == sorted((r[0] or -1, r[3], r[1] or "") for r in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(k, "word \n" * 500_000) for k in range(8)], "doc_id long, text string")
    for r in long.select("doc_id", fill_middle.arrange(F.col("text"), F.col("doc_id"), outputs=False).alias("f")).collect():
        assert r.f.n == 500_001 and r.f.restored_sha256 == hashlib.sha256(b"word \n" * 500_000).hexdigest()


def test_fill_in_middle_tables():
    table = [(fill_middle.TEXT, 0, 5)]
    assert fill_middle.split(table, 0) == [(0, 0, 0), (0, 0, 5)] and fill_middle.split(fill_middle.split(table, 2), 5) == [(0, 0, 2), (0, 2, 5), (0, 5, 5)]
    with pytest.raises(IndexError):
        fill_middle.split(table, 6)
    every = fill_middle.Plan(rate=100, spm=0, marks=("<|p|>", "<|m|>", "<|s|>"))
    for t in (b"a b", b" ", b"x" * 9):
        n, form, pieces, arranged = fill_middle.table_of(4, fill_middle.np.frombuffer(t, fill_middle.np.uint8), t, every)
        marks = every.bytes_of_marks()
        output = b"".join(fill_middle.bytes_of(arranged, (t, b"".join(marks))))
        assert form == "psm" and b"".join(fill_middle.bytes_of(fill_middle.read_back(output, form, marks), (output,))) == t
    with pytest.raises(ValueError, match="marks"):
        fill_middle.Plan(marks=("<P", "<M<", "<S"))


def audited(rows, labels):
    """Order by order and document by document."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first, bad = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        bad.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {b[0] for b in bad}:
            left = [b for b in bad if b[0] == part]
            for step, own in enumerate(order, 1):
                hit = [b for b in left if own in b[1]]
                left = [b for b in left if own not in b[1]]
                failing = [b for b in bad if b[0] == part and own in b[1]]
                out[part, "".join(order), step] = [len(left), len(hit), len(failing) - len(hit), sum(b[1] == {own} for b in failing), sum(b[2] for b in hit), sum(b[3] for b in hit)]
                shapley[part, own] += len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_edges(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " ", "A", "x # y", " ".join(words), " ".join(words) + " |", " ".join(words).upper(), "a b " * 150, "a b", "ÀÉ" * 9, "w\x1cx " * 250, "z " * 100_000]
    rows = [(rng.choice([k, k, k, None, k // 2]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [(1000 + k, "copied text", "en") for k in range(50)] + [(7, "twice", "en"), (7, "twice", "en"), (7, "twice", "de"), (8, "twice", "de"), (None, "twice", "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs.repartition(5), marks)
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[f] for f in fields) for r in got.collect()} == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_potentials_of_any_game(spark):
    """Against Shapley values by orders, of games that no filters make, too."""
    rng = random.Random(1)
    for n in (1, 2, 3, 4):
        v = [0] + [rng.randint(0, 50) for _ in range((1 << n) - 1)]
        games = spark.createDataFrame([("p", 99, v, v, v)], "part string, total long, removed array<long>, good array<long>, toxic array<long>")
        names = "ABCD"[:n]
        want = collections.Counter()
        for order in itertools.permutations(range(n)):
            s = 0
            for k in order:
                want[names[k]] += v[s | 1 << k] - v[s]
                s |= 1 << k
        assert {r.filter_order[r.step - 1]: r.shapley for r in filter_audit.steps(games, names).collect()} == dict(want)


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(rows):
    """Smallest id reachable, by all pairs: rows (id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f, least.get(find(f))) for i, f in rows]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_simhash_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = joined([(i, fingerprint(t)) for i, t in docs])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op13_simhash_near_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in want}) < len(want)
    assert all(len(r.fingerprint) == 16 for r in queries.op13_simhash_near_dedup(spark, sf).limit(5).collect())


def test_covering_masks():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and {m.bit_count() for m in masks} <= {36, 37}
    assert all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in itertools.combinations_with_replacement(range(64), 2))
    wide = simhash.covering_masks(4)
    rng = random.Random(4)
    assert len(wide) == 31 and all(any(not any(m >> b & 1 for b in bits) for m in wide) for bits in (rng.sample(range(64), 4) for _ in range(2000)))


def test_simhash_links_and_edges(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)]
    # A chain of two bits a step, and a ball, whose buckets hold many.
    chain = [sum(1 << k for k in range(2 * s)) ^ 0x5555 for s in range(20)]
    ball = [base[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(24), 2)]
    fps = base + near + chain + ball
    rows = [(None if k % 9 == 4 else k if k % 5 else k // 5, f) for k, f in enumerate(fps)] + [(None, 12345), (None, 12345)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    of = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    found = {r.fp % (1 << 64): r.component_id for r in of}
    assert {(f, found[f]) for _, f in rows} == {(f, c) for _, f, c in joined(rows)} and sum(r.n for r in of) == len(rows)
    texts = [None, "", "  ", "one", "One two", "one\ttwo  THREE", "one two three", "É É É", "é é é", "a b c d e f g " * 30_000]
    docs = [(2**53 + 1, "one two three"), (3, "one two three"), (3, "one two three"), (None, "one"), (None, "alone " * 9)] + [(100 + k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, fp string, component_id int")
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=key) == sorted(joined([(i, fingerprint(t)) for i, t in docs]), key=key)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_simhash_of_many_copies_is_linear(spark):
    """All fingerprints of one ball: rows of the plan stay near a constant number a fingerprint."""
    fps = [(1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in itertools.combinations(range(40), 3)]
    began = time.time()
    got = simhash.classes(spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "doc_id long, fp long"))
    assert {r.component_id for r in got.collect()} == {0} and time.time() - began < 120
