"""Approximate nearest neighbours over learned partitions.

Fit, on a bounded sample (rows with the lowest hash of their id): the sample's
neighbour graph is cut into balanced parts (recursive spectral bisection, then moves that win
neighbours and keep the balance), and a small network with one hidden layer learns to tell a
vector's part.  How many parts a query visits is the least number that finds ``target`` of
the true neighbours of held-out sample queries.

There is a part for each ``per_part`` rows, 4 at least.  The sample grows with the parts, from ``sample``
to ``most_sample`` rows, and has 32 rows for each part: beyond ``most_sample`` / 32 parts (1.6 million rows by
default) parts grow instead of getting more.  Under ``FEWEST`` different vectors nothing can be learnt and all is one part.

Search: every row of the table is indexed under its most probable part, every query goes to its
most probable few.  A part is split by hash into blocks of about ``block`` rows, so neither a large
part nor one vector that a third of all rows share lands in one task.  A query's k-th best among
the sample's rows in the parts that it visits is a bound that its result cannot fall below; a
block gives its k best as far as they reach the bound, and the best of those are the result.  A query
whose parts hold fewer than k candidates is asked again in all parts.  Scores are inner products of the
original vectors in double precision, the same for equal vectors wherever they stand.

Defined cases: null, empty or zero vectors, vectors that hold null or non-finite components, and those
of another length than most of the sample take no part; rows that share the query's id are its
own; ties go to the smaller id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


#: Different vectors that a partition can be learnt from.
FEWEST = 48


@dataclass
class Router:
    """The fitted partitioning: scores of each part for a vector, and how many parts a query visits."""

    dim: int
    parts: int
    visits: int
    weights: tuple
    ids: np.ndarray | None = None
    sample: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.weights
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x / norm @ w1 + b1, 0) @ w2 + b2

    def bounds(self, ids: np.ndarray, x: np.ndarray, top: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that its k-th best row in the parts ``top`` reaches."""
        home = self.scores(self.sample).argmax(axis=1)
        out = np.full(len(ids), -np.inf)
        for i in range(0, len(ids), 256):
            s = x[i : i + 256] @ self.sample.T
            seen = np.zeros((len(s), self.parts), bool)
            np.put_along_axis(seen, top[i : i + 256], True, axis=1)
            s[~seen[:, home] | (ids[i : i + 256, None] == self.ids[None, :])] = -np.inf
            if s.shape[1] >= k:
                out[i : i + 256] = np.partition(s, -k, axis=1)[:, -k]
        return out - 1e-9 * np.maximum(1, np.abs(out))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of each row, itself left out."""
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def partition_graph(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Balanced parts (a power of two) of a graph given by each node's neighbours."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    count = 1
    while count < parts:
        # The second eigenvector of each part's graph by power iteration, all parts at once.
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.bincount(u, minlength=n) + 1.0
        x = rng.standard_normal(n)
        for _ in range(60):
            mean = np.bincount(part, degree * x, count) / np.bincount(part, degree, count)
            x = x - mean[part]
            x = (np.bincount(u, x[v], n) + 2 * degree * x) / (3 * degree)
            scale = np.sqrt(np.bincount(part, x * x, count)) + 1e-300
            x = x / scale[part]
        order = np.lexsort((x, part))
        size = np.bincount(part, minlength=count)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        part = part * 2 + (rank >= (size[part] + 1) // 2)
        count *= 2
    limit = int(np.ceil(n / parts * slack))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < limit:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, y: np.ndarray, parts: int, hidden: int = 128, epochs: int = 25, seed: int = 7) -> tuple:
    """A network of one hidden layer by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = x.shape[1]
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2.0), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            rows = order[i : i + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(rows)), y[rows]] -= 1
            z /= len(rows)
            back = z @ p[2].T * (h > 0)
            t += 1
            for j, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ z, z.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= (0.01 if epoch < epochs * 2 // 3 else 0.002) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def valid(vector: Column) -> Column:
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(real, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def fit(rows: DataFrame, sample: int = 8192, most_sample: int = 32768, per_part: int = 1600, target: float = 0.94, k: int = 20) -> Router:
    """``rows`` (vec_id, v) hold usable vectors.  At most ``most_sample`` of them come to the driver."""
    total = rows.count()
    wanted = 1 << max(2, round(np.log2(max(1, total / per_part))))
    size = min(max(sample, 32 * wanted), most_sample)
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("vec_id", "v").collect()
    if not got:
        return Router(0, 1, 1, ())
    lengths = np.array([len(r.v) for r in got])
    dim = int(np.bincount(lengths).argmax())
    ids = np.array([r.vec_id for r in got if len(r.v) == dim])
    x, first = np.unique(np.array([r.v for r in got if len(r.v) == dim], np.float64), axis=0, return_index=True)
    ids = ids[first]
    if len(x) < FEWEST:
        return Router(dim, 1, 1, (), ids, x)
    parts = min(wanted, max(4, 1 << int(np.log2(len(x) / 32))))
    order = np.random.default_rng(3).permutation(len(x))
    ids, x = ids[order], x[order]
    held = x[: max(8, len(x) // 8)]
    part = partition_graph(neighbour_graph(x, 10), parts)
    router = Router(dim, parts, parts, train(x[len(held) :], part[len(held) :], parts), ids, x)
    near = neighbour_graph(x, min(k, len(x) - 1))[: len(held)]
    home = router.scores(x).argmax(axis=1)
    rank = np.argsort(np.argsort(-router.scores(held), axis=1), axis=1)
    visit = np.sort(rank[np.arange(len(held))[:, None], home[near]].ravel())
    router.visits = min(parts, int(visit[int(np.ceil(target * len(visit))) - 1]) + 1)
    return router


def _route(router: Router, n: int, k: int = 0):
    """Rows (vec_id, v) with their ``n`` most probable parts and, for ``k`` above 0, the bound of their k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), router.dim)
            top = np.argsort(-router.scores(x), axis=1, kind="stable")[:, :n]
            bound = router.bounds(ids, x, top, k) if k else np.full(len(ids), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(bound)], names=["vec_id", "v", "parts", "bound"])

    return run


def _rerank(k: int):
    """Best ``k`` of a block for each query; rows (part, block, side, vec_id, v, bound) come sorted, candidates first."""

    def best(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        out: list = [[], [], []]
        s = q @ x.T
        s[qid[:, None] == ids[None, :]] = -np.inf
        for i in range(len(qid)):
            own = int(np.isneginf(s[i]).sum())
            n = min(k, len(ids) - own)
            if n <= 0:
                continue
            edge = np.partition(s[i], len(ids) - n)[len(ids) - n]
            near = np.flatnonzero(s[i] >= max(edge - 1e-9 * max(1.0, abs(edge)), bound[i]))
            exact = (x[near] * q[i]).sum(axis=1)  # the same order of additions for every row
            near = near[order := np.lexsort((ids[near], -exact))][:n]
            out[0].append(np.full(len(near), qid[i]))
            out[1].append(ids[near])
            out[2].append(exact[order][:n])
        flat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, x = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = batch.column("bound").to_numpy()
            part, block, side, vec = (batch.column(c).to_numpy() for c in ("part", "block", "side", "vec_id"))
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for rows in np.split(np.arange(len(vec)), change):
                here = (part[rows[0]], block[rows[0]])
                if here != place:
                    place, ids, x = here, [], []
                if side[rows[0]] == 0:
                    ids.append(vec[rows])
                    x.append(v[rows])
                elif ids:
                    ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    for i in range(0, len(rows), 512):
                        yield best(ids[0], x[0], vec[rows[i : i + 512]], v[rows[i : i + 512]], bound[rows[i : i + 512]])

    return run


def search(rows: DataFrame, queries: Column, k: int = 20, router: Router | None = None, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found of all rows for each row that ``queries`` holds for.
    ``rows`` has vec_id and embedding.  A query row that is repeated is asked once; a repeated candidate is ranked once a
    row.  Different vectors of one queried id are each asked and ranked together."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    router = router or fit(rows, k=k)
    rows = rows.where(F.size("v") == router.dim)
    kind = f"array<{dict(rows.dtypes)['v'][6:-1]}>"
    route = lambda df, n, k: df.mapInArrow(_route(router, n, k), f"vec_id long, v {kind}, parts array<int>, bound double")
    index = stage(route(rows, 1, 0).select("vec_id", "v", "bound", F.get("parts", F.lit(0)).alias("part")), "vector-index")
    sizes = index.groupBy("part").count().collect()  # a row per part
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["part"], -(-r["count"] // block))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.try_element_at(blocks, "part")).cast("int"))
    asked = rows.where(queries).distinct()

    def found(asked: DataFrame, visits: int) -> DataFrame:
        """The best k of every block for (query_id, score, vec_id), over the parts visited."""
        to = route(asked, visits, k).select("vec_id", "v", "bound", F.explode("parts").alias("part")).withColumn("n", F.try_element_at(blocks, "part"))
        to = to.where("n is not null").select("vec_id", "v", "bound", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
        both = index.withColumn("side", F.lit(0)).unionByName(to.withColumn("side", F.lit(1)))
        order = ["part", "block", "side"]
        dealt = both.select(*order, "vec_id", "v", "bound").repartition("part", "block").sortWithinPartitions(*order)
        best = dealt.mapInArrow(_rerank(k), "query_id long, vec_id long, score double")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = found(asked, router.visits)
    if router.visits < router.parts:
        near = stage(near, "neighbours")
        counted = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        few = asked.join(counted, asked.vec_id == counted.query_id, "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v")
        few = stage(few, "queries-with-few")
        if not few.isEmpty():
            near = near.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(found(few, router.parts))
    return near
