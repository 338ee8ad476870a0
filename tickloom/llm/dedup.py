"""Embedding near-dedup by NN-descent.

Like vectors become one node with a weight. Every node keeps a list of its nearest
known nodes. The lists start from blocks of random-hyperplane buckets, in as many
tables as START of the pairs at the threshold need to share one; then, round by round, the nodes in a node's neighbourhood (its list and the lists it is in) are
compared with each other, so neighbours of neighbours become neighbours. Only
neighbourhoods with a new edge are joined again. A list whose last entry still reaches
the threshold is saturated and is allowed to grow to twice its length.

Recall is audited, apart from the result: nothing that an audit finds becomes an edge. Two
figures are taken. Probes are sampled nodes turned to the threshold exactly, which makes
lone pairs of the hardest kind; they go through the lists like nodes, and it counts how
many end up connected with their source, however rare links are in the table. And for a
sample of nodes, as large as the root of the table and bounded in bytes, all links are found
by comparing with every node; it counts how many of these links the lists connect. Rounds
go on until the number of near pairs settles; while a figure is too low, new planes start
over on the lists so far. After PLANES of them an exact pass compares all nodes in blocks and
adds what links different components: quadratic, but whole.

Edges at the threshold give components. Members of a component are then compared with
each other in blocks, so n_links is the number of all links within it, whatever the
lists held. Sums are emitted, never the pairs.

Large buckets are split by further planes, which part like vectors least; what still is
large, and hubs, are split at random into blocks, anew in every round and table, so no
neighbour is left out for good and no task takes an unbounded group.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize
from tickloom.llm.graph import components
from tickloom.llm.knn import usable

#: Length of a list at first, nodes of a block, rounds at most for one set of planes, and sets of planes at most.
NEIGHBOURS, BLOCK, ROUNDS, PLANES = 6, 48, 8, 6
#: Share of the pairs at the threshold that meet in a bucket of the first planes.
START = 0.995
#: Tables of one set of planes at most: 0.95 needs them from 20 billion vectors on, low thresholds sooner; the audit then asks for more sets.
TABLES = 128
#: Probes; share of the probes, and of the links of sampled nodes, that must be connected.
PROBES, PROBED, RECALL = 200, 0.99, 0.995
#: Sampled nodes are SAMPLED times the root of the table; they, and a block of the exact pass, have so many bytes at most.
SAMPLED, SAMPLE_BYTES = 4, 32 << 20
#: Bits of a bucket's code; those past a table's own part its large buckets.
BITS = 48
#: Members of a component in one block of the final comparison.
PART = 1024


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Recall:
    """What the audit saw: probes and links of sampled nodes, how many were connected, sets of planes, and whether an exact pass followed."""

    probes: int
    probes_found: int
    links: int
    links_found: int
    planes: int
    exact: bool = False

    @property
    def holds(self) -> bool:
        return self.probes_found >= PROBED * self.probes and self.links_found >= RECALL * self.links


def _tables(bits: int, threshold: float) -> int:
    """Tables of hyperplanes in which START of the pairs at the threshold share a bucket of so many bits."""
    alike = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if alike >= START else min(TABLES, math.ceil(math.log(1 - START) / math.log1p(-max(alike, 1e-9))))


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by their largest component first, so that no square vanishes or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return _normal(np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1))


def _blockwise(rows: DataFrame) -> DataFrame:
    """rows (block, id, v, worst, keep), a block's rows together -> (a, b, sim): what each node of a block
    may take into its list from the block, the best first."""

    def solve(block: pa.Table, out: list) -> None:
        x, ids = _unit(block.column("v")), block.column("id").to_numpy()
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -2
        worst, keep = block.column("worst").to_numpy(), int(block.column("keep").to_numpy().max())
        k = min(keep, len(ids) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(s, top, axis=1)
        i, j = np.nonzero((sim > worst[:, None]) & (sim > -2))
        out.append((ids[i], ids[top[i, j]], sim[i, j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            out: list = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    solve(t.slice(lo, hi - lo), out)
            rest = t.slice(cuts[-1])
            yield _table(out)
        out = []
        if rest is not None and rest.num_rows > 1:
            solve(rest, out)
        yield _table(out)

    def _table(out: list) -> pa.RecordBatch:
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])

    rows = rows.repartition("block").sortWithinPartitions("block")
    return rows.select("block", "id", "v", "worst", "keep").mapInArrow(run, "a long, b long, sim double")


def _blocks(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Add block: rows of a key in parts of about BLOCK, at random but the same in every rerun."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("id", *key, F.lit(seed)), F.col("parts"))
    return rows.join(sizes, key).withColumn("block", F.xxhash64(*key, part)).drop("parts", *key)


def _buckets(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(table, dim, bucket, id): signs against random hyperplanes, for each table; a large bucket is parted by further planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            v, ids = batch.column("v").to_pylist(), batch.column("id").to_numpy()
            size = np.array([len(x) // 8 for x in v])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if d not in planes:
                    if len(planes) >= 64:
                        planes.clear()
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((tables, BITS, d))
                x = _normal(np.frombuffer(b"".join(v[i] for i in at), np.float64).reshape(len(at), d))
                for k in range(tables):
                    b = ((x @ planes[d][k].T > 0).astype(np.int64) << np.arange(BITS)).sum(axis=1)
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), k), pa.int32()), pa.array(np.full(len(at), d), pa.int32()), pa.array(b, pa.int64()), pa.array(ids[at])], names=["table", "dim", "code", "id"]
                    )

    rows = nodes.select("id", "v").mapInArrow(run, "table int, dim int, code long, id long")
    first = lambda n: F.col("code").bitwiseAND(F.expr(f"shiftleft(1L, {n}) - 1"))
    rows = rows.withColumn("own", first(bits))
    key = ["table", "dim", "own"]
    deep = F.least(F.lit(BITS), bits + F.ceil(F.log2(F.count("*") * 2 / BLOCK))).cast("int")
    sizes = rows.groupBy(*key).agg(F.when(F.count("*") > BLOCK, deep).otherwise(bits).alias("depth"))
    rows = rows.join(sizes, key)
    return rows.select("table", "dim", F.xxhash64("depth", first("depth")).alias("bucket"), "id")


def _against(nodes: DataFrame, taken: pa.Table, threshold: float) -> DataFrame:
    """(a, b): component or id of taken rows (id, v, of) and of nodes (id, v, of) that link, unlike ones only, each once a batch."""
    v = taken.column("v").to_pylist()
    own = [(int(i), np.frombuffer(x, np.float64)) for i, x in zip(taken.column("of").to_pylist(), v, strict=True)]
    dims = {d: (np.array([i for i, x in own if len(x) == d]), np.array([x for _, x in own if len(x) == d])) for d in {len(x) for _, x in own}}
    data = nodes.sparkSession.sparkContext.broadcast({d: (i, _normal(x)) for d, (i, x) in dims.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, of = batch.column("v").to_pylist(), batch.column("of").to_numpy()
            size = np.array([len(x) // 8 for x in v])
            for d, (mine, x) in data.value.items():
                at_all = np.flatnonzero(size == d)
                # No more than 32 MB of products at once.
                step = max(1, (4 << 20) // len(mine))
                for lo in range(0, len(at_all), step):
                    at = at_all[lo : lo + step]
                    i, j = np.nonzero(x @ _unit(pa.array([v[k] for k in at])).T >= threshold)
                    pairs = np.stack([mine[i], of[at][j]], axis=1)
                    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                    yield pa.record_batch([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return nodes.select("id", "v", "of").mapInArrow(run, "a long, b long")


def _sampled_links(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """All links (a, b) of a sample of nodes; the audit only counts them."""
    longest = nodes.agg(F.max(F.length("v"))).first()[0] or 8
    size = min(n, max(PROBES, SAMPLED * math.isqrt(n)), max(1, SAMPLE_BYTES // longest))
    rows = nodes.select("id", "v", F.col("id").alias("of"))
    return _against(rows, rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(size).toArrow(), threshold)


def _probes(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(id, v, source): sampled nodes of two components or more, each turned to the threshold in a direction of its own. Their ids are no node's."""
    low, high = nodes.agg(F.min("id"), F.max("id")).first()
    first, step = (low - 1, -1) if low > -(1 << 62) else (high + 1, 1)
    cosine = min(1.0, threshold + 1e-9)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            out = []
            for source, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = _normal(np.frombuffer(v, np.float64)[None, :])[0]
                r = np.random.default_rng([seed, k]).standard_normal(len(x))
                r -= (r @ x) * x
                out.append((first + step * k, (cosine * x + math.sqrt(1 - cosine * cosine) * r / np.sqrt(r @ r)).tobytes(), source))
                k += 1
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["id", "v", "source"])

    taken = nodes.filter(F.length("v") >= 16).select("id", "v").orderBy(F.xxhash64("id", F.lit(9)), "id").limit(PROBES)
    return materialize(taken.coalesce(1).mapInArrow(turn, "id long, v binary, source long"), "near-probes")


def _audited(near: DataFrame, probes: DataFrame, links: DataFrame, planes: int) -> Recall:
    """How many probes have their source, and how many links both their ends, in one component of the near pairs."""
    labels = materialize(components(near.select(F.col("u").alias("a"), F.col("v").alias("b"))), "near-audited")
    x, y = (labels.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}")) for c in "ab")
    together = F.coalesce(F.sum((F.col("ca") == F.col("cb")).cast("long")), F.lit(0))
    seen = [pairs.join(x, "a", "left").join(y, "b", "left").agg(F.count("*"), together).first() for pairs in (probes.select(F.col("id").alias("a"), F.col("source").alias("b")), links)]
    return Recall(*seen[0], *seen[1], planes)


def _exact(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components that link, by comparing all nodes in blocks; each block is broadcast and met by one scan."""
    rows = materialize(nodes.join(labels, "id", "left").select("id", "v", F.coalesce("component_id", "id").alias("of")), "near-exact")
    total = rows.agg(F.sum(F.length("v"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / SAMPLE_BYTES))
    found = None
    for k in range(blocks):
        taken = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == k).toArrow()
        if not taken.num_rows:
            continue
        links = materialize(_against(rows, taken, threshold).distinct(), "near-exact-links")
        found = links if found is None else found.unionByName(links)
    return found if found is not None else labels.select(F.col("id").alias("a"), F.col("id").alias("b")).filter("false")


def _counted(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, links): other vectors that each node of a component links with; like vectors count each."""
    members = nodes.join(labels, "id")
    sizes = members.groupBy("component_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = members.join(sizes, "component_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    left = members.select("component_id", "own", F.explode(each).alias("other"), F.lit(0).alias("role"), "id", "v", "m")
    right = members.select("component_id", F.explode(each).alias("own"), F.col("own").alias("other"), F.lit(1).alias("role"), "id", "v", "m")
    rows = left.unionByName(right).withColumn("cell", F.xxhash64("component_id", "own", "other"))
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        role = t.column("role").to_numpy()
        size = np.array([len(x) for x in t.column("v").to_pylist()])
        ids, m = t.column("id").to_numpy(), t.column("m").to_numpy()
        a_all, n_all = [], []
        for d in np.unique(size):
            a, b = np.flatnonzero((role == 0) & (size == d)), np.flatnonzero((role == 1) & (size == d))
            if len(a):
                x, y = _unit(t.column("v").take(pa.array(a))), _unit(t.column("v").take(pa.array(b)))
                near = (x @ y.T >= threshold) & (ids[a][:, None] != ids[b][None, :])
                a_all.append(ids[a])
                n_all.append(near @ m[b])
        return np.concatenate(a_all), np.concatenate(n_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(t.column("cell").to_numpy())) + 1])
            got = [solve(t.slice(lo, hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = t.slice(cuts[-1])
            if got:
                yield pa.record_batch([pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]).astype(np.int64))], names=["id", "links"])
        if rest is not None and rest.num_rows:
            a, n = solve(rest)
            yield pa.record_batch([pa.array(a), pa.array(n.astype(np.int64))], names=["id", "links"])

    return rows.select("cell", "role", "id", "v", "m").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _improve(graph: DataFrame, found: DataFrame, threshold: float, base: int) -> DataFrame:
    """The best of both as lists (u, v, sim, fresh, keep). A saturated list may grow to twice its length."""
    old = graph.select("u", "v", "sim", F.lit(0).alias("fresh"), "keep")
    new = found.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim", F.lit(1).alias("fresh"), F.lit(base).alias("keep"))
    pairs = old.unionByName(new).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("keep").alias("keep"))
    own = Window.partitionBy("u")
    pairs = pairs.withColumn("keep", F.max("keep").over(own)).withColumn("i", F.row_number().over(own.orderBy(F.col("sim").desc(), "v")))
    full = F.max(F.when(F.col("i") == F.col("keep"), F.col("sim"))).over(own)
    pairs = pairs.withColumn("keep", F.when(full >= threshold, F.col("keep") * 2).otherwise(F.col("keep"))).filter(F.col("i") <= F.col("keep"))
    return pairs.drop("i")


def connect(nodes: DataFrame, n: int, threshold: float, neighbours: int, seed: int) -> tuple[DataFrame, Recall]:
    """The near pairs (a, b) of n nodes (id, v) by NN-descent, and what the audit saw of them."""
    bits = max(1, min(40, math.ceil(math.log2(max(n, 2) / 24))))
    tables = _tables(bits, threshold)
    links = materialize(_sampled_links(nodes, n, threshold), "near-audit")
    probes = _probes(nodes, threshold, seed)
    every = nodes.select("id", "v").unionByName(probes.select("id", "v"))
    lists = lambda rows: rows.join(every, "id")
    graph = nodes.sparkSession.createDataFrame([], "u long, v long, sim double, fresh int, keep int")
    for planes in range(PLANES):
        start = _blocks(_buckets(every, bits, tables, seed + planes), ["table", "dim", "bucket"], seed + planes)
        found = _blockwise(lists(start.withColumn("worst", F.lit(-1.0)).withColumn("keep", F.lit(neighbours))))
        graph = materialize(_improve(graph, found, threshold, neighbours), "near-lists")
        before = -1
        for k in range(ROUNDS):
            near = graph.filter(F.col("sim") >= threshold)
            pairs = near.count()
            if k > 1 and pairs <= before * 1.001:
                break
            before = pairs
            both = graph.select("u", F.col("v").alias("id"), "fresh").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("id"), "fresh"))
            both = both.groupBy("u", "id").agg(F.max("fresh").alias("fresh"))
            touched = both.groupBy("u").agg(F.max("fresh").alias("any")).filter("any = 1").select("u")
            around = _blocks(both.join(touched, "u", "left_semi").select("u", "id"), ["u"], planes * ROUNDS + k)
            state = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.max("keep").alias("keep"))
            state = state.select(F.col("u").alias("id"), F.when(F.col("n") >= F.col("keep"), F.col("low")).otherwise(-1.0).alias("worst"), "keep")
            found = _blockwise(lists(around.join(state, "id")))
            graph = materialize(_improve(graph, found, threshold, neighbours), "near-lists")
        near = graph.filter(F.col("sim") >= threshold)
        seen = _audited(near, probes, links, planes + 1)
        log.info("near-dedup: %d nodes, %d tables: %s", n, tables, seen)
        if seen.holds:
            break
    # No probe is an end of an edge.
    edges = near.join(probes.select(F.col("id").alias("u")), "u", "left_anti").join(probes.select(F.col("id").alias("v")), "v", "left_anti")
    edges = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if not seen.holds:
        log.warning("near-dedup: %s; all nodes are compared in blocks", seen)
        labels = materialize(components(edges), "near-components")
        edges = labels.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(_exact(nodes, labels, threshold))
        seen = replace(seen, exact=True)
    return edges, seen


def dedup(vectors: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS, seed: int = 11) -> DataFrame:
    """``dedup_audited`` without the audit's figures."""
    return dedup_audited(vectors, threshold, neighbours, seed)[0]


def dedup_audited(vectors: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS, seed: int = 11) -> tuple[DataFrame, Recall]:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept, for every row; and the audited recall.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing: their component is their own vec_id and they are kept. Vectors of
    different lengths don't link. A repeated row (same vec_id, same vector) counts
    once as a link of others; rows that share a vec_id are one vertex. A null vec_id
    links with nothing and keeps a null component. No rows give no rows.
    """
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("embedding").cast("array<double>")).alias("e")), "near-rows")
    valid = rows.filter("e is not null").distinct()
    nodes = valid.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, np.float64).tobytes() for x in batch.column("e").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("m"), pa.array(v, pa.binary())], names=["id", "m", "v"])

    nodes = materialize(nodes.mapInArrow(pack, "id long, m long, v binary"), "near-nodes")
    member = rows.join(nodes_of(valid), rows["e"].eqNullSafe(F.col("e_")), "left").select("vec_id", F.col("rep"))
    n = nodes.count()
    if n:
        edges, seen = connect(nodes, n, threshold, neighbours, seed)
    else:
        edges, seen = vectors.sparkSession.createDataFrame([], "a long, b long"), Recall(0, 0, 0, 0, 0)
    tied = member.filter("rep is not null").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).join(several(member), "a", "left_semi")
    labels = materialize(components(edges.unionByName(tied)), "near-components")
    links = _counted(nodes, labels, threshold)
    per = nodes.select("id", "m").join(links, "id", "left").join(labels, "id", "left")
    per = per.select(F.col("id").alias("rep"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = member.join(per, "rep", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    result = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.coalesce("vec_id", F.lit(0)) == F.coalesce("component_id", F.lit(0))).alias("kept"))
    return result, seen


def nodes_of(valid: DataFrame) -> DataFrame:
    return valid.groupBy(F.col("e").alias("e_")).agg(F.min("vec_id").alias("rep"))


def several(member: DataFrame) -> DataFrame:
    """The vec_ids that stand with more than one vector."""
    return member.filter("rep is not null").groupBy(F.col("vec_id").alias("a")).agg(F.countDistinct("rep").alias("n")).filter("n > 1").select("a")

