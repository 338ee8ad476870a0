"""Exact top-k search: Voronoi kNN join by inner product.

Pivots part the data into groups: each vector belongs to its nearest pivot p. Their number
grows with the root of the rows. A group is summed up by its largest distance r to the
pivot, its norms, its widest angle a to the pivot, and its smallest distances. For a query
q at an angle b to the pivot these bound every score:

    q.p - |q| d(x, p) <= q.x <= min(q.p + |q| r, |q| max |x| cos(max(0, b - a)))

(with the least norm in place of the largest where the cosine is negative). The lower bounds
of k vectors, whatever group they are in, bound the k-th best score from below. Then each
query is solved in the group with the highest bound, and its k-th score there, if higher,
takes the place of that bound. A query is sent to the other groups whose upper bound reaches
it, and to no other.

A group is solved in cells of bounded rows by matrix products, so a group that holds a
third of all rows is as many cells as it needs. A data row goes to its one cell, and only if
a query reached that; the queries of a cell stream past its rows, a batch at a time. The k
best of each cell are merged by a window that keeps k rows of each task. What remains to be
shipped is the queries, once for each cell they reach: with vectors that the bounds can't
part, such as random ones in many dimensions, that is every cell, and the search is a scan.

The driver sees pivots and sums of groups: at most sqrt(rows) of them, and PIVOTS.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize

#: Groups at most, rows of a cell, and queries of one product.
PIVOTS, CELL_ROWS, CELL_QUERIES = 2048, 16_384, 1024

log = logging.getLogger(__name__)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, with finite components only."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(v: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double; whole numbers kept as doubles."""
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.Table]]:
    t = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    dims = pa.compute.list_value_length(t.column("v")).to_numpy()
    for d in np.unique(dims):
        yield int(d), t.filter(pa.array(dims == d)).combine_chunks()


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: floats as long as they can't round."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1)


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of each query, ties to the smaller id, its own id left out."""
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    s = _products(q, x)
    if s.dtype == object:
        rows = [[(int(v), int(i)) for v, i in zip(r, x_ids, strict=True) if i != own] for r, own in zip(s, q_ids, strict=True)]
        top = [(int(own), i, v) for own, r in zip(q_ids, rows, strict=True) for v, i in sorted(r, key=lambda p: (-p[0], p[1]))[:k]]
        a, b, c = zip(*top, strict=True) if top else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.int64)
    s[q_ids[:, None] == x_ids[None, :]] = -np.inf
    rows = np.arange(len(q))
    out = []
    for _ in range(min(k, len(x))):
        at = s.argmax(axis=1)
        score = s[rows, at]
        good = score > -np.inf
        out.append((q_ids[good], x_ids[at[good]], score[good].astype(np.int64)))
        s[rows, at] = -np.inf
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _upper(dot: np.ndarray, norm: np.ndarray, pivot: np.ndarray, sums: dict[str, np.ndarray]) -> np.ndarray:
    """Bound of every score of a query (row) in a group (column)."""
    between = _angle(dot / np.maximum(norm * pivot[None], 1e-300)) - sums["angle"][None] - 1e-7
    cosine = np.where(pivot[None] > 0, np.cos(np.clip(between, 0, math.pi)), 1.0)
    by_angle = norm * cosine * np.where(cosine >= 0, sums["norm"][None], sums["least"][None])
    slack = 1e-9 * (1 + norm * (sums["norm"] + sums["r"])[None])
    return np.minimum(dot + norm * sums["r"][None], by_angle) + slack


def search(data: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """data, queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k best of each query.

    Vectors that are null or hold null or non-finite components, and rows without
    vec_id, take no part. Repeated rows count once. A row with the query's vec_id is
    the query's own and no candidate. Vectors of other lengths than the query's are no
    candidates. A query id with several vectors stands for the smallest. With fewer than
    k candidates all are returned; without queries or data, no rows. Other columns are
    ignored. pivots: groups at most.
    """
    v = quantised(F.col("embedding"), scale)
    rows = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    data, queries = materialize(rows(data).distinct(), "knn-data"), rows(queries).groupBy("id").agg(F.min("v").alias("v"))
    n = data.count()
    chosen: dict[int, list] = {}
    for r in data.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, math.isqrt(n)))).collect():
        chosen.setdefault(len(r["v"]), []).append(r["v"])
    centres = {d: np.unique(np.array(p, float).reshape(-1, d), axis=0) for d, p in chosen.items()}

    def centre(d: int) -> np.ndarray:
        return centres.get(d, np.zeros((1, d)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in _by_dim(batch):
                if not t.num_rows:
                    continue
                x, p = _matrix(t.column("v").combine_chunks(), d), centre(d)
                far = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None], 0)
                g = far.argmin(axis=1)
                near, norm = np.sqrt(((x - p[g]) ** 2).sum(1)), np.sqrt((x * x).sum(1))
                length = np.sqrt((p[g] ** 2).sum(1)) * norm
                angle = np.where(length > 0, _angle((x * p[g]).sum(1) / np.maximum(length, 1e-300)), 0.0)
                cols = [t.column("id"), t.column("v"), pa.array(np.full(len(x), d), pa.int32()), pa.array(g, pa.int32()), pa.array(near), pa.array(norm), pa.array(angle)]
                yield from pa.table(cols, names=["id", "v", "dim", "g", "near", "norm", "angle"]).to_batches()

    data = materialize(data.mapInArrow(assign, "id long, v array<double>, dim int, g int, near double, norm double, angle double"), "knn-groups")
    # A query may meet its own id this often among the bounds.
    own = data.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    need = k + own
    rank = Window.partitionBy("dim", "g").orderBy("near")
    close = data.select("dim", "g", "near", F.row_number().over(rank).alias("i")).filter(F.col("i") <= need)
    close = close.groupBy("dim", "g").agg(F.sort_array(F.collect_list("near")).alias("close"))
    summed = [F.count("*").alias("n"), F.max("near").alias("r"), F.max("norm").alias("norm"), F.min("norm").alias("least"), F.max("angle").alias("angle")]
    found = data.groupBy("dim", "g").agg(*summed).join(close, ["dim", "g"]).collect()
    if not found:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = {(s["dim"], s["g"]): -(-s["n"] // CELL_ROWS) for s in found}
    groups = {}
    for d in {s["dim"] for s in found}:
        own_groups = [s for s in found if s["dim"] == d]
        sums = {c: np.array([s[c] for s in own_groups], float) for c in ("r", "norm", "least", "angle")}
        groups[d] = (np.array([s["g"] for s in own_groups]), sums, [np.array(s["close"]) for s in own_groups])

    def bounds(t: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The lower bound of each query's k-th best score, and upper bounds for each group."""
        g, sums, near = groups[d]
        q, p = _matrix(t.column("v").combine_chunks(), d), centre(d)[g]
        norm, dot = np.sqrt((q * q).sum(1))[:, None], q @ p.T
        slack = 1e-9 * (1 + norm * (sums["norm"] + sums["r"])[None])
        low = np.concatenate([dot[:, i : i + 1] - norm * c[None] - slack[:, i : i + 1] for i, c in enumerate(near)], axis=1)
        least = np.partition(low, -need, axis=1)[:, -need] if low.shape[1] >= need else np.full(len(q), -np.inf)
        return least, _upper(dot, norm, np.sqrt((p * p).sum(1)), sums)

    def sent(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """Each query with the cells that it meets: those of its best group, or of all others that its bound reaches."""
        for batch in batches:
            for d, t in _by_dim(batch):
                if d not in groups or not t.num_rows:
                    continue
                for lo in range(0, t.num_rows, CELL_QUERIES):
                    part = t.slice(lo, CELL_QUERIES)
                    least, most = bounds(part, d)
                    g, best = groups[d][0], most.argmax(axis=1)
                    if home:
                        i, j = np.arange(len(best)), best
                    else:
                        known = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                        reach = most >= np.fmax(least, known)[:, None]
                        reach[np.arange(len(best)), best] = False
                        i, j = np.nonzero(reach)
                    parts = np.array([cells[d, int(x)] for x in g])[j]
                    i, own_cell = np.repeat(i, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    j = np.repeat(j, parts)
                    part = part.take(pa.array(i))
                    yield from pa.table(
                        [part.column("id"), part.column("v"), pa.array(np.full(len(i), d), pa.int32()), pa.array(g[j], pa.int32()), pa.array(own_cell, pa.int32())], names=["id", "v", "dim", "g", "cell"]
                    ).to_batches()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell come before its queries, which pass in batches."""
        now, x, ids = None, [], []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = np.stack([t.column(c).to_numpy() for c in ("dim", "g", "cell", "role")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, [len(key)]])
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, (d, *cell, role) = t.slice(lo, hi - lo), key[lo].tolist()
                if (d, *cell) != now:
                    now, x, ids = (d, *cell), [], []
                mat = _matrix(part.column("v").combine_chunks(), d)
                if role == 0:
                    x.append(mat)
                    ids.append(part.column("id").to_numpy())
                elif x:
                    x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                    q_ids = part.column("id").to_numpy()
                    out += [_best(mat[s : s + CELL_QUERIES], q_ids[s : s + CELL_QUERIES], x[0], ids[0], k) for s in range(0, len(mat), CELL_QUERIES)]
            a, b, c = (np.concatenate(y) for y in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])

    cell = F.expr("pmod(xxhash64(id, 1), cells)").cast("int")
    sizes = data.groupBy("dim", "g").agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells"))
    key = ["dim", "g", "cell"]
    held = materialize(data.select("id", "v", "dim", "g").join(sizes, ["dim", "g"]).select(F.lit(0).alias("role"), "id", "v", "dim", "g", cell.alias("cell")), "knn-cells")

    def solved(asked: DataFrame) -> DataFrame:
        both = held.join(asked.select(*key).distinct(), key, "left_semi").unionByName(asked.withColumn("role", F.lit(1)))
        both = both.repartition(*key).sortWithinPartitions(*key, "role")
        return both.mapInArrow(solve, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    route = "id long, v array<double>, dim int, g int, cell int"
    queries = materialize(queries, "knn-queries")
    homes = materialize(queries.mapInArrow(lambda b: sent(b, True), route), "knn-homes")
    first = materialize(top(solved(homes)), "knn-first")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    others = materialize(queries.join(kth, "id", "left").mapInArrow(lambda b: sent(b, False), route), "knn-others")
    log.info("knn: %d vectors in %d groups, %d queries meet %d cells beyond their own", n, len(found), queries.count(), others.count())
    both = first.drop("rank").unionByName(solved(others))
    return top(both).select("query_id", "rank", "vec_id", "score")
