"""Approximate nearest neighbours by learned partitions, for the largest inner product.

Fit (on a bounded sample, on the driver): the sample's neighbour graph is cut into parts of equal capacity by balanced
label propagation over its edges, from a balanced start; a small softmax classifier learns to tell a vector's part from
the vector, with the parts of its neighbours as soft labels. There are about sqrt(n) parts for n distinct vectors (at most
``most_parts``), whatever n is: no table is searched without routing.

Routing: a query looks at its most probable parts until their probabilities add up to a mass that is chosen on held-out
sample queries, as the least whose measured recall reaches the target. So a query that the classifier is sure of looks at
few parts. A query always looks at enough parts to find k rows.

Index: every vector goes to the part that the classifier finds most probable, once. Search: a query is ranked against every
vector of its parts by the inner product in double precision.

Equal vectors are searched once: of a vector's copies only the smallest ids can be among the nearest, and equal queries
share one search. Small parts are searched together in bins, so that a query has one partial result a bin, and large parts are
cut into several bins by a hash. A bin's queries are cut into blocks of a bounded size, so that no task holds more than a
bin and a block; a bin is copied once for each full block of queries that are routed to it, so that what is exchanged follows the
number of routed queries. The sample is a documented bound (``sample`` rows, or 48 a part if that is more, at most 196,608);
there is no cap on candidates. ``exact`` looks at all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, written

SAMPLE, BIN, MOST_PARTS = 12_000, 8_192, 4_096
TARGET = 0.93  # share of true neighbours on held-out sample queries that the probed parts must hold


# --- fitting -----------------------------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of largest inner product of each row, without itself."""
    x = x.astype(np.float32)
    out = np.empty((len(x), k), np.int64)
    step = max(1, min(1000, (1 << 24) // len(x)))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_start(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size by repeated halving along the direction of largest variance."""
    label = np.zeros(len(x), np.int64)
    work = [(np.arange(len(x)), 0, parts)]
    while work:
        rows, first, n = work.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        v = np.ones(x.shape[1])
        for _ in range(20):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) + 1e-300
        order = rows[np.argsort(centred @ v, kind="stable")]
        cut = len(rows) * (n // 2) // n
        work += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    return label


def balanced_partition(graph: np.ndarray, start: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Moves nodes to the part that holds most of their neighbours, best gains first, while that part has room."""
    n, label = len(graph), start.copy()
    room = int(np.ceil(n / parts * (1 + slack)))
    ends = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    others = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        # a node's votes are counted for the parts that its neighbours are in, not for all parts
        pairs, votes = np.unique(ends * parts + label[others], return_counts=True)
        node, part = pairs // parts, pairs % parts
        order = np.lexsort((part, -votes, node))
        best = order[np.r_[True, node[order][1:] != node[order][:-1]]]
        want, gain = label.copy(), np.zeros(n, np.int64)
        want[node[best]], gain[node[best]] = part[best], votes[best]
        own = np.flatnonzero(part == label[node])
        gain[node[own]] -= votes[own]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[want[i]] < room:
                sizes[want[i]] += 1
                sizes[label[i]] -= 1
                label[i] = want[i]
                moved += 1
        if moved < n // 500 + 1:
            break
    return label


@dataclass
class Router:
    """Softmax over a hidden layer; low and high clip the input, mean and scale standardise it."""

    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((np.clip(x, self.low, self.high) - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row, ties to the smaller part."""
        return np.concatenate([self.logits(x[i : i + 2000]).argmax(1) for i in range(0, len(x), 2000)]) if len(x) else np.zeros(0, np.int64)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parts of each row, the most probable first, and the probability of the parts before each."""
        o = self.logits(x)
        p = np.exp(o - o.max(1, keepdims=True))
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p / p.sum(1, keepdims=True), order, 1)
        return order, np.cumsum(p, axis=1) - p

    def routes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each row looks at: those of the mass, and more until they hold ``least`` rows."""
        out: list[np.ndarray] = []
        for i in range(0, len(x), 2000):
            order, before = self.ranked(x[i : i + 2000])
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = (before < self.mass) | (held < least)
            out += [o[t] for o, t in zip(order, take, strict=True)]
        return out


def usual_range(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each component, wide of the middle 98 % of rows: beyond them a few huge values would decide scales and parts."""
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    room = 3 * (high - low) + 1e-6 * (1 + np.abs(low) + np.abs(high))
    return low - room, high + room


def fit_classifier(x: np.ndarray, labels: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """Adam on cross entropy with soft labels, a row's being the shares of its label list, in minibatches; float32."""
    rng = np.random.default_rng(seed)
    low, high = usual_range(x)
    x = np.clip(x, low, high)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / scale).astype(np.float32)
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    p = [(rng.standard_normal(s) * (2 / s[0]) ** 0.5).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in shapes]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(z))
        for i in range(0, len(z), 256):
            rows = order[i : i + 256]
            a, t = z[rows], np.zeros((len(rows), parts), np.float32)
            np.add.at(t, (np.repeat(np.arange(len(rows)), labels.shape[1]), labels[rows].ravel()), 1 / labels.shape[1])
            h = np.maximum(a @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            e = np.exp(o - o.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - t) / len(a)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Router(low, high, mean, scale, *(q.astype(np.float64) for q in p))


def parts_for(n: int, most: int = MOST_PARTS) -> int:
    """About sqrt(n) parts of at least four rows."""
    return max(1, min(most, round(n**0.5), n // 4))


def fit(x: np.ndarray, parts: int, k: int = 20, target: float = TARGET, seed: int = 7) -> Router:
    """A router for the sample; a tenth of it is held out to choose the mass of parts a query looks at."""
    rng = np.random.default_rng(seed)
    held = np.zeros(len(x), bool)
    held[rng.permutation(len(x))[: max(2, len(x) // 10)]] = True
    base = x[~held]
    parts = max(1, min(parts, len(base) // 2))
    near = min(k, len(base) - 1)
    if parts < 2 or near < 1:  # fewer than some eight vectors
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.full(d, -np.inf), np.full(d, np.inf), np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    tame = np.clip(base, *usual_range(base))
    graph = neighbour_graph(tame, min(20, len(base) - 1))
    label = balanced_partition(graph, balanced_start(tame, parts), parts)
    router = fit_classifier(base, np.column_stack([label, label[graph]]), parts, seed=seed)
    home = router.home(base)
    # the mass before a true neighbour's part: beyond which share of them do queries have to look?
    before = []
    queries = x[held]
    for i in range(0, len(queries), 500):
        q = queries[i : i + 500]
        true = np.argpartition(-products(q, base), near - 1, axis=1)[:, :near]
        order, ahead = router.ranked(q)
        by_part = np.empty_like(ahead)
        np.put_along_axis(by_part, order, ahead, 1)
        before.append(np.take_along_axis(by_part, home[true], 1).ravel())
    router.mass = float(np.nextafter(np.quantile(np.concatenate(before), target, method="higher"), 2.0))
    return router


# --- searching ---------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that isn't null, empty or zero, all components finite."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def top(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((vec_ids, -scores, query_ids))
    q = query_ids[order]
    start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = order[rank < k]
    return query_ids[keep], vec_ids[keep], scores[keep]


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query within one bin, among those of the parts that the query is routed to."""
    kept: list[tuple] = []
    q_all, q_ids = matrix(queries["v"]), queries["query"].to_numpy(np.int64)
    asked = queries["parts"].map(len).to_numpy(np.int64)
    flat, asker = (np.concatenate(queries["parts"].tolist()) if len(queries) else np.zeros(0, int)), np.repeat(np.arange(len(queries)), asked)
    order = np.argsort(flat, kind="stable")
    flat, asker = flat[order], asker[order]
    x_all, ids_all, part_of = matrix(candidates["v"]), candidates["vec_id"].to_numpy(np.int64), candidates["part"].to_numpy()
    for part in np.unique(part_of):
        rows = np.flatnonzero(part_of == part)
        asks = asker[slice(*np.searchsorted(flat, [part, part + 1]))]
        x, ids = x_all[rows], ids_all[rows]
        near = min(k, len(ids))
        for i in range(0, len(asks), 256):
            q = q_all[asks[i : i + 256]]
            s = products(q, x)
            # every candidate that ties with the k-th or comes within rounding of it goes on to the exact comparison
            floor = np.partition(s, len(ids) - near, axis=1)[:, len(ids) - near]
            floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), floor)
            a, b = np.nonzero(s >= floor[:, None])
            kept.append(top(q_ids[asks[i + a]], ids[b], exact_scores(q[a], x[b]), k))
    out = [np.concatenate(c) for c in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    out = top(*out, k)
    return pd.DataFrame({"query": out[0], "vec_id": out[1], "score": out[2]})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a block with those of another; what overflows both ways counts least."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = a @ b.T
    return np.where(np.isnan(s), -np.inf, s)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, the same whatever the block they are computed in."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.einsum("ij,ij->i", a, b, optimize=False)
    return np.where(np.isnan(s), -np.inf, s)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, most_parts: int = MOST_PARTS, sample: int = SAMPLE, bin_rows: int = BIN, target: float = TARGET, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows found, for ids divisible by ``every``.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another length than the most frequent (ties: the longest). Repeated rows (id and vector) count once. Ties
    go to the smaller id. Products beyond the range of doubles are infinite, and minus infinity where their terms are so in both
    directions. The router sees components clipped to some width around the middle 98 % of the sample, so that a few huge vectors
    don't hide the others from it.
    """
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else 0))
    # one row a distinct vector, with its smallest k + 1 ids (one of them may be the query's own), which is exact for k nearest
    by_vec = rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).select("v", "vec_id")
    w = Window.partitionBy("v").orderBy("vec_id")
    copies = by_vec.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1).select("v", "vec_id", "copy")
    copies = written(copies, "ann-copies")
    distinct = copies.where("copy = 1").select("v", F.col("vec_id").alias("rep"))
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts_for(n, most_parts)
    picked = distinct.orderBy(F.xxhash64("rep"), "rep").limit(max(sample, 48 * parts)).select("v").toPandas()["v"]
    # of a row's k nearest about k * len(picked) / n are in the sample
    router = fit(matrix(picked), parts, max(5, -(-k * len(picked) // n)), target)
    if exact:
        router.mass = 2.0
    held = spark.sparkContext.broadcast(vars(router))  # plain arrays: some 128 x most_parts numbers

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Router(**held.value)
        for b in batches:
            yield b.assign(part=r.home(matrix(b["v"])).astype(np.int32))

    # a query is a distinct vector that some row with a fitting id holds
    asked = by_vec.where(F.col("vec_id") % every == 0)
    queries = asked.join(distinct, "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"), "v")
    queries = written(queries, "ann-queries")
    placed = written(distinct.mapInPandas(homes, "v array<double>, rep long, part int"), "ann-index")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # at most most_parts rows
    bins = bins_of(sizes, bin_rows)
    room = np.array([sizes.get(p, 0) for p in range(parts)])

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Router(**held.value)
        for b in batches:
            rows: list[tuple] = []
            for i, chosen in enumerate(r.routes(matrix(b["v"]), room, k + 1)):
                by_bin: dict[int, list[int]] = {}
                for p in chosen.tolist():
                    for x in range(*bins.get(p, (0, 0))):
                        by_bin.setdefault(x, []).append(p)
                rows += [(i, x, ps) for x, ps in by_bin.items()]
            yield pd.DataFrame({"query": b["query"].to_numpy()[[x[0] for x in rows]], "bin": np.array([x[1] for x in rows], np.int32), "parts": [x[2] for x in rows]})

    # a bin's queries go in blocks of a bounded size as well, as many as are routed to it; its candidates are repeated for each
    distinct_queries = queries.dropDuplicates(["query"]).select("query", "v")
    routed = written(distinct_queries.mapInPandas(routes, "query long, bin int, parts array<int>"), "ann-routes")
    blocks = [(r["bin"], -(-r["count"] // bin_rows)) for r in routed.groupBy("bin").count().collect()]  # a row a bin
    blocks = small(spark.createDataFrame(blocks, "bin int, blocks int"), len(blocks))
    ranges = small(spark.createDataFrame([(p, lo, hi - lo) for p, (lo, hi) in bins.items()], "part int, lo int, wide int"), len(bins))
    placed = placed.join(ranges, "part").select((F.col("lo") + F.pmod(F.xxhash64("rep"), F.col("wide"))).cast("int").alias("bin"), "part", F.col("rep").alias("vec_id"), "v")
    placed = placed.join(blocks, "bin").select("bin", "part", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sent = routed.join(distinct_queries, "query").join(blocks, "bin")
    sent = sent.select("query", "v", "bin", "parts", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # one more than k: the query's own vector is among them
        return search_block(left, right, k + 1)

    found = sent.groupBy("bin", "block").cogroup(placed.groupBy("bin", "block")).applyInPandas(search, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", F.col("vec_id").alias("rep"), "score")
    # distinct vectors are expanded to their copies' ids, and equal queries to theirs
    reps = distinct.select("v", "rep")
    ids = copies.join(reps, "v").select("rep", "vec_id")
    hits = found.join(ids, "rep").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    hits = hits.join(queries.select("query_id", "query"), "query").where(F.col("query_id") != F.col("vec_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bins_of(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Bins [lo, hi) of each part: small parts share one of about ``most`` rows, a larger part has several of its own."""
    out, at, room = {}, -1, 0
    for part, n in sorted(sizes.items()):
        if n > most:
            need = -(-n // most)
            out[part], at, room = (at + 1, at + 1 + need), at + need, 0
            continue
        if n > room:
            at, room = at + 1, most
        out[part], room = (at, at + 1), room - n
    return out
