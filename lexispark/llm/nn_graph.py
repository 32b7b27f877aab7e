"""Approximate nearest neighbours by inner product: NN-descent builds a graph in rounds of Spark joins, greedy search walks it.

Equal vectors are one node. Vectors get one more component that makes all as long as the longest, so that near in the graph
means a large inner product. First links come from chunks of nodes that are neighbours along a few random directions. In a
round, each node's neighbours and a bounded number of the nodes that have it as neighbour meet (joins), are compared with each
other, and what beats a node's worst link is merged into its list. A search keeps a pool for each query; in a round the best
nodes that are not yet expanded are joined with the graph, which holds the vectors of a node's neighbours beside it.

Partitions are sized by rows, so tasks hold a bounded part of links; no group is collected, and no list grows with the table.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as query or
candidate, nor do rows without an id, nor vectors of another length than most unlike vectors have (of two such, the longer); equal vectors all are candidates, ties to the smaller id; a query returns all candidates if fewer than k exist; repeated
ids are repeated candidates, and as queries give rows each; further columns are ignored; an empty table gives no rows.

Vectors without structure, such as random ones, are the hardest case: the graph converges slowly and a search must look at several
hundredths of a small table. EXPAND and SEARCH_ROUNDS are set for a recall of 0.9 on these, and searches go on for as long as many of them still find
nearer nodes; one that has found none for QUIET rounds asks for no more.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import bucketed, buckets_for, cut, release

DEGREE = 28
REVERSE = 20
ROUNDS = 5
DIRECTIONS = 8
CHUNK = 256
#: Links into a node that a search may follow back.
INTO = 24
ENTRIES = 32
POOL = 600
EXPAND = 64
SEARCH_ROUNDS = 4
#: A query stops after so many rounds in a row without a nearer neighbour.
QUIET = 3
#: How many of a query's pool, for each neighbour wanted, are compared exactly.
EXACT = 5
#: Searches go on for more rounds while more than this share of the queries found a nearer neighbour in the last one.
MOVING = 0.02
#: Bytes of rows that a task holds at once, and nodes whose first links it finds.
TASK_BYTES = 24_000_000
TASK_NODES = 8192


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    d = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(d, lambda x: x != 0), F.lit(False))


def _whole(df: DataFrame, by: str, partitions: int, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over all rows of each partition at once, after dealing rows by a key."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield run(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0])

    return df.repartition(partitions, by).mapInPandas(each, schema)


def _matrix(column: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f2").reshape(len(column), -1).astype(np.float32)


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _best(u: np.ndarray, w: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct links of each u: u, w, similarity and rank."""
    order = np.lexsort((-s, w, u))
    u, w, s = u[order], w[order], s[order]
    first = np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])))[: len(u)]
    u, w, s = u[first], w[first], s[first]
    order = np.lexsort((w, -s, u))
    u, w, s = u[order], w[order], s[order]
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))[: len(u)])
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
    keep = rank < k
    return u[keep], w[keep], s[keep], rank[keep]


def _meet(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between the members of one group that beat each member's worst: the best ``top`` of each."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    order = np.argpartition(-s, min(top, len(ids) - 1) - 1, axis=1)[:, :top] if len(ids) > top else np.argsort(-s, axis=1)[:, : len(ids) - 1]
    value = np.take_along_axis(s, order, axis=1)
    i, j = np.nonzero(value > worst[:, None])
    return [(ids[i], ids[order[i, j]], value[i, j])] if len(i) else []


def _links(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], degree: int) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"u": np.zeros(0, dtype="int64"), "w": np.zeros(0, dtype="int64"), "s": np.zeros(0, dtype="float32")})
    u, w, s, _ = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), degree)
    return pd.DataFrame({"u": u, "w": w, "s": s.astype("float32")})


def _along(direction: np.ndarray) -> Callable[..., Column]:
    @F.pandas_udf("float")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(_matrix(x) @ direction if len(x) else [], dtype="float32")

    return place


def build_graph(nodes: DataFrame, n: int, width: int, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """(u, w, s, r, worst): the ``degree`` best known links of each node with their ranks, and u's worst similarity. nodes: (id, x), x as 16-bit floats."""
    merged = "u long, w long, s float, r int, worst float"

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        u, w, s, rank = _best(rows["u"].to_numpy(), rows["w"].to_numpy(), rows["s"].to_numpy(), degree)
        last = {a: v for a, v, r in zip(u.tolist(), s.tolist(), rank.tolist(), strict=True) if r == degree - 1}
        return pd.DataFrame({"u": u, "w": w, "s": s, "r": rank.astype("int32"), "worst": np.array([last.get(a, -np.inf) for a in u.tolist()], dtype="float32")})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        b = pd.concat(rows).sort_values(["p", "id"], kind="stable")
        ids, x = b["id"].to_numpy(), _matrix(b["x"])
        found = []
        for at in range(0, len(ids), CHUNK):
            at = max(0, min(at, len(ids) - CHUNK))
            part = slice(at, at + CHUNK)
            if len(ids[part]) > 1:
                found += _meet(ids[part], x[part], np.full(len(ids[part]), -np.inf), degree)
        yield _links(found, degree)

    directions = np.random.default_rng(seed).normal(size=(width, DIRECTIONS)).astype("float32")
    first = None
    for d in range(DIRECTIONS):
        dealt = nodes.select("id", "x", _along(directions[:, d])("x").alias("p")).repartitionByRange(max(buckets_for(n * (2 * width + 16), TASK_BYTES), buckets_for(n, TASK_NODES)), "p", "id")
        part = dealt.mapInPandas(chunks, "u long, w long, s float")
        first = part if first is None else first.union(part)
    parts = buckets_for(n * degree * 40 * DIRECTIONS, TASK_BYTES)
    graph = cut(_whole(first, "u", parts, merge, merged), "graph")

    def join_local(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["v", "m"], kind="stable")
        v, m, worst, x = rows["v"].to_numpy(), rows["m"].to_numpy(), rows["worst"].to_numpy(), _matrix(rows["x"])
        found = []
        for a, b in _segments(v):
            if b - a > 1:
                found += _meet(m[a:b], x[a:b], worst[a:b], 12)
        return _links(found, degree)

    for _ in range(rounds):
        sampled = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("m", "v")))
        into = graph.select(F.col("w").alias("v"), F.col("u").alias("m")).withColumn("_r", sampled).where(F.col("_r") <= reverse).drop("_r")
        pairs = graph.select(F.col("u").alias("v"), F.col("w").alias("m")).union(into).distinct()
        worst = graph.groupBy(F.col("u").alias("id")).agg(F.min("worst").alias("worst"))
        known = nodes.join(worst, "id", "left").select(F.col("id").alias("m"), "x", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        met = _whole(pairs.join(known, "m"), "v", buckets_for(n * (degree + reverse) * (2 * width + 40), TASK_BYTES), join_local, "u long, w long, s float")
        graph = cut(_whole(met.union(graph.select("u", "w", "s")), "u", buckets_for(n * degree * 80, TASK_BYTES), merge, merged), "graph")
        release(nodes.sparkSession)
    return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, n: int, width: int, keep: int, pool: int = POOL, expand: int = EXPAND, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(q, id): the ``keep`` best nodes found for each query. queries: (q, x) with q a node's id."""
    # Links count both ways, as few lists hold an outlying node. Of those into a node, the ones that rank highest at their origin stay.
    place = F.row_number().over(Window.partitionBy("w").orderBy("r", F.col("s").desc(), "u"))
    into = graph.select("u", "w", "r", "s").withColumn("_p", place).where(F.col("_p") <= INTO)
    both = graph.select("u", "w").union(into.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct()
    near = both.join(nodes.select(F.col("id").alias("w"), "x"), "w").select("u", "w", "x")

    def beside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "w"], kind="stable")
        u, w, x = rows["u"].to_numpy(), rows["w"].to_numpy(dtype="<i8"), rows["x"].to_numpy()
        cuts = _segments(u)
        return pd.DataFrame({"u": [u[a] for a, _ in cuts], "ws": [w[a:b].tobytes() for a, b in cuts], "xs": [b"".join(x[a:b]) for a, b in cuts]})

    # Every round's queries come to the neighbours, which are by far the larger table and stay where they are.
    n_buckets = max(buckets_for(n * 2 * DEGREE * (2 * width + 24), TASK_BYTES), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inline = bucketed(_whole(near, "u", n_buckets, beside, "u long, ws binary, xs binary"), "u", n_buckets, "inline")
    # Entry nodes: a fixed number, so that a search can leave a part of the graph that nothing links to the rest. Every query begins
    # with them and their neighbours (a bounded number, too), so that no node is joined with all queries.
    entry = nodes.orderBy(F.xxhash64("id")).limit(ENTRIES).collect()
    known = {r["id"]: bytes(r["x"]) for r in entry}
    for r in inline.where(F.col("u").isin([e["id"] for e in entry])).collect():
        step = 2 * width
        known.update((w, bytes(r["xs"][k * step : (k + 1) * step])) for k, w in enumerate(np.frombuffer(r["ws"], dtype="<i8").tolist()))
    entry_ids = np.array(list(known), dtype="<i8")
    entry_done = np.isin(entry_ids, [e["id"] for e in entry]).astype(np.uint8)
    entry_x = _matrix(list(known.values())) if known else np.zeros((0, width), dtype=np.float32)
    state_type = "q long, x binary, ids binary, sims binary, done binary, next array<long>, quiet int"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                sims = (_matrix(b["x"]) @ entry_x.T).astype("<f4")
                order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
                # A query's own node is expanded first: its links are its neighbours.
                yield pd.DataFrame({
                    "q": b["q"], "x": b["x"], "ids": [entry_ids[o].tobytes() for o in order], "sims": [v[o].tobytes() for v, o in zip(sims, order, strict=True)],
                    "done": [entry_done[o].tobytes() for o in order], "next": [[q] for q in b["q"]], "quiet": 0,
                })

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims: list[bytes] = []
            # The join leaves rows of one node side by side: its neighbours are read once for all queries that ask for it.
            for a, z in _segments(b["u"].to_numpy()) if len(b) else []:
                near = np.frombuffer(b["xs"].iat[a], dtype="<f2").reshape(-1, width).astype(np.float32)
                sims += [v.tobytes() for v in _matrix(b["x"].iloc[a:z]) @ near.T]
            yield pd.DataFrame({"q": b["q"], "x": None, "ids": b["ws"], "sims": sims, "done": None, "next": None, "quiet": None})

    def advance(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("q", kind="stable")
        columns = [rows[c].tolist() for c in ("x", "ids", "sims", "done", "quiet")]
        q = rows["q"].to_numpy()
        for a, b in _segments(q):
            xs, ids, sims, done, quiet = (c[a:b] for c in columns)
            at = next(k for k, v in enumerate(xs) if v is not None)
            x, before = xs[at], np.frombuffer(ids[at], dtype="<i8")[: keep // EXACT]
            i = np.frombuffer(b"".join(ids), dtype="<i8")
            s = np.frombuffer(b"".join(sims), dtype="<f4")
            d = np.frombuffer(b"".join(z if z is not None else bytes(len(w) // 8) for z, w in zip(done, ids, strict=True)), dtype=np.uint8)
            order = np.lexsort((-d.astype(int), i))
            i, s, d = i[order], s[order], d[order]
            once = np.concatenate(([True], i[1:] != i[:-1]))[: len(i)] & (i != q[a])
            i, s, d = i[once], s[once], d[once]
            order = np.lexsort((i, -s))[:pool]
            i, s, d = i[order], s[order], d[order].copy()
            still = 0 if len(np.setdiff1d(i[: keep // EXACT], before)) else int(quiet[at]) + 1
            todo = np.flatnonzero(d == 0)[: expand if still < QUIET else 0]
            d[todo] = 1
            out.append((q[a], x, i.tobytes(), s.tobytes(), d.tobytes(), i[todo].tolist(), still))
        return pd.DataFrame(out, columns=["q", "x", "ids", "sims", "done", "next", "quiet"])

    state = queries.mapInPandas(begin, state_type)
    for k in itertools.count(1):
        frontier = state.select("q", "x", F.explode("next").alias("u"))
        seen = frontier.hint("merge").join(inline, "u").select("q", "u", "x", "ws", "xs").mapInPandas(compare, state_type)
        both = state.select("q", "x", "ids", "sims", "done", F.lit(None).cast("array<long>").alias("next"), "quiet").union(seen)
        state = cut(_whole(both, "q", buckets_for(n // 20 * expand * 2 * DEGREE * 16, TASK_BYTES), advance, state_type), "pool")
        moving, asked = state.agg(F.count_if(F.col("quiet") == 0), F.count(F.lit(1))).first()
        # ``rounds`` at least, and more for as long as many still move.
        if k >= rounds and moving <= MOVING * asked:
            break

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [np.frombuffer(i, dtype="<i8")[:keep] for i in b["ids"]]
            yield pd.DataFrame({"q": np.repeat(b["q"].to_numpy(), [len(g) for g in got]), "id": np.concatenate(got) if got else np.zeros(0, dtype="int64")})

    return state.select("q", "ids").mapInPandas(best, "q long, id long")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found, by exact inner product of the original vectors."""
    named = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), is_query.alias("is_query")).where("vec_id is not null")
    rows = named.where(usable(F.col("v")))
    groups = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.max(F.coalesce("is_query", F.lit(False))).alias("asked"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    classes = cut(groups.withColumn("square", square), "vectors")
    # One row a length.
    lengths = classes.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), F.col("n").desc()).limit(2).collect()
    if len(lengths) > 1:
        classes = classes.where(F.size("v") == lengths[0]["n"])
    shared = classes.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"), F.lit(True).alias("_shared"))
    if not shared.isEmpty():
        # Unlike vectors of one vec_id: nodes of their own.
        apart = F.when(F.col("_shared"), F.xxhash64("id", "v")).otherwise(F.col("id"))
        classes = cut(classes.join(shared, F.col("id") == F.col("_id"), "left").select("v", apart.alias("id"), "asked", "square"), "vectors")
    facts = classes.agg(F.count(F.lit(1)), F.max("square"), F.max(F.size("v"))).first()
    n, longest, width = facts[0], facts[1] or 1.0, (facts[2] or 0) + 1

    def lift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), width), dtype="<f8")
            for i, v in enumerate(b["v"]):
                x[i, : len(v)] = v
            last = np.sqrt(np.maximum(0, longest - b["square"].to_numpy()))
            x[:, -1] = np.where(last < 1e-3 * np.sqrt(longest), 0, last)
            yield pd.DataFrame({"id": b["id"], "asked": b["asked"], "x": [r.astype("<f2").tobytes() for r in x / np.sqrt(longest)]})

    nodes = cut(classes.select("id", "asked", "v", "square").mapInPandas(lift, "id long, asked boolean, x binary"), "nodes")
    graph = build_graph(nodes.select("id", "x"), n, width)

    def as_query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q": b["id"], "x": [x[:-2] + bytes(2) for x in b["x"]]})

    queries = nodes.where("asked").mapInPandas(as_query, "q long, x binary")
    found = search(graph, nodes.select("id", "x"), queries, n, width, keep=EXACT * k)
    # A query's equals are candidates too, through its own node.
    found = found.union(nodes.where("asked").select(F.col("id").alias("q"), "id"))
    # Of equal vectors only the k + 1 of the smallest ids can be among a query's k nearest.
    same = rows.join(classes.select("v", "id"), "v").select("id", "vec_id", "is_query")
    order = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    members = same.withColumn("_r", order).where(F.col("_r") <= k + 1).select("id", "vec_id")
    values = classes.select("id", "v")
    scored = found.join(values, "id").join(values.select(F.col("id").alias("q"), F.col("v").alias("vq")), "q")
    product = F.aggregate(F.zip_with("v", "vq", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = scored.select("q", "id", product.alias("score")).join(members, "id").select("q", "vec_id", "score")
    asked = same.where("is_query").select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"))
    ranked = asked.join(scored, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
