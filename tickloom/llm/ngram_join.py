"""N-gram Jaccard join: documents whose shingle sets overlap, in size-banded tiles.

A document is the set of its distinct shingles of w words. Two documents link when
``percent`` % of the union lies in the intersection. How links are found:

* Documents with the same set are one class; only classes are compared.
* Tiles. With threshold t, sets that link share one of the first
  n - ceil(t n) + 1 elements of a common order of all shingles. The order is by
  hash, but the shingles of common passages, those in more than ``COMMON`` of all
  documents, come last, so they head no tile unless a set has little else. A tile
  holds the classes that share such an element, in bands of size: linked sets lie
  in the same band or the next.
* Bitmaps. Each set has a parity bitmap of its hashes. Bits that differ between two
  bitmaps bound the symmetric difference from below, so the overlap from above:
  |A & B| <= (|A| + |B| - differing) / 2. Pairs that can't reach t go no further.
* What remains is decided by intersecting the sorted arrays of hashes.

Large groups of near copies don't make all pairs: in some rounds each tile compares
its members with one leader, and linked documents are joined into components; then
only pairs between different components are left, and those are all compared. So
components are exact, whatever the rounds found.

Scale: only the elements shared by two classes or more reach the tiles, texts are
shuffled for the classes of pairs that bitmaps allow, and leaders with many members are split into
salted parts. Nothing but the bounded list of common shingles reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, sliced
from tickloom.llm.graph import components

#: A shingle in more of the documents than this is common. At most mean set size / COMMON shingles are.
COMMON = 0.0025
#: Bits of the bitmaps of small and large sets, and the size from which a set is large.
SMALL_BITS, LARGE_BITS, LARGE_FROM = 512, 4096, 1024
#: Rounds with leaders, and the tiles of each class that they use.
ROUNDS, HEADS = 7, 4
#: Members that one part of a leader takes.
PART = 256
#: Rows of a column of ids up to which a side is broadcast; beyond that it is shuffled.
BROADCAST = 500_000
#: Rows that a group of tiles is meant to have.
TILE_ROWS = 50_000
#: Parts that the rows of one set are dealt to when they learn their class.
SALTS = 16
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts -> sorted arrays of the 64-bit hashes of their distinct shingles."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if len(buf) > len(self.up):
            n = max(len(buf), SLICE + SLICE // 4)
            self.up, self.down = _powers(int(_P), n), _powers(pow(int(_P), -1, 1 << 64), n)
        solid = ~_SPACE[buf]
        edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.empty(len(buf) + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=total[1:])
        h = mix((total[end] - total[start]) * self.down[start] ^ (end - start).astype(np.uint64) * _K)
        first = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        w = self.words
        s = np.zeros(0, np.uint64)
        if len(h) >= w:
            s = h[: len(h) - w + 1].copy()
            for k in range(1, w):
                s = s * _K + h[k : len(h) - w + 1 + k]
            s = mix(s)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= w:
                x = np.sort(s[a : b - w + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                x = np.uint64(b - a)
                for v in h[a:b]:
                    x = x * _K + v
                out.append(mix(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _shingler(words: int) -> Shingler:
    np.seterr(over="ignore")
    return Shingler(words)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays without repeats reach the threshold."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> bytes:
    bits = LARGE_BITS if len(s) >= LARGE_FROM else SMALL_BITS
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(m: bytes) -> bytes:
    """A large bitmap as a small one: parities of hashes that fall together add."""
    return np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, SMALL_BITS // 8), axis=0).tobytes()


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Size bands: linked sets lie in the same or in adjacent ones."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int32)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles in more than COMMON of the documents.

    Every slice of texts reports the shingles in more than half that share of its
    own documents. The sums decide; a common shingle is common in some slice, and
    the order only needs to be the same everywhere, so a sum that lacks the slices
    where the shingle is rare does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _shingler(words)
        for batch in sliced(batches, "text", SLICE):
            sets = f(batch.column("text").to_pylist())
            x, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = n >= max(8, COMMON / 2 * len(sets))
            yield pa.record_batch([pa.array(x[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["s", "n"])

    floor = COMMON * docs.count()
    counts = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") > floor)
    return np.sort(counts.select("s").toArrow().column("s").to_numpy().astype(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, bits, heads): size, 128-bit key, bitmap and tile elements of each row's set."""
    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _shingler(words)
        for batch in sliced(batches, "text", SLICE):
            sets = f(batch.column("text").to_pylist())
            k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            k2 = np.array([mix(s ^ _P).sum(dtype=np.uint64) for s in sets], np.uint64)
            heads = []
            for s in sets:
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(common) and len(s):
                    at = np.searchsorted(common, s)
                    at[at == len(common)] = 0
                    late = common[at] == s
                    s = np.concatenate([s[~late], s[late]])
                heads.append(s[:p])
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ],
                names=["doc_id", "n", "k1", "k2", "bits", "heads"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, k1 long, k2 long, bits binary, heads array<long>")


def _small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few: rows of a few longs, counted before."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole texts of docs (doc_id, text). b is the side with many partners."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = pairs.join(parts, "b").select("b", F.expr("pmod(xxhash64(a), parts)").cast("int").alias("part"), F.lit(1).alias("role"), F.col("a").alias("id"))
    leaders = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("id"))
    rows = docs.withColumnRenamed("doc_id", "id").join(_small(members.unionByName(leaders)), "id")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _shingler(words)
        now, own = None, []
        for batch in sliced(batches, "text", SLICE):
            sets = f(batch.column("text").to_pylist())
            a, b = [], []
            for s, key, part, role, i in zip(sets, *(batch.column(c).to_pylist() for c in ("b", "part", "role", "id")), strict=True):
                if (key, part) != now:
                    now, own = (key, part), []
                if role == 0:
                    own.append(s)
                elif any(linked(s, x, percent) for x in own):
                    a.append(i)
                    b.append(key)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("b", "part", "role", "id", "text").mapInArrow(run, "a long, b long").distinct()


def _pairs_of_tile(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of a tile's classes in different components whose bitmaps allow a link."""
    key, n, ids, comp, own = (rows.column(c).to_numpy() for c in ("key", "n", "id", "comp", "own"))
    bits = rows.column("bits").to_pylist()
    large = np.array([len(b) * 8 == LARGE_BITS for b in bits])
    tight = np.frombuffer(b"".join([_fold(b) if l else b for b, l in zip(bits, large, strict=True)]), np.uint64).reshape(len(bits), -1)
    wide = np.frombuffer(b"".join([b for b, l in zip(bits, large, strict=True) if l]), np.uint64).reshape(-1, LARGE_BITS // 64)
    at_wide = np.cumsum(large) - 1
    del bits
    order = np.argsort(key, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]])
    found: list[np.ndarray] = []
    held = 0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        if len(at) < 2:
            continue
        for k, i in enumerate(at[:-1]):
            j = at[k + 1 :]
            j = j[(comp[j] != comp[i]) & (own[j] | own[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if not len(j):
                continue
            both = large[j] & large[i]
            differ = np.bitwise_count(tight[j] ^ tight[i]).sum(axis=1, dtype=np.int64)
            if both.any():
                differ[both] = np.bitwise_count(wide[at_wide[j[both]]] ^ wide[at_wide[i]]).sum(axis=1, dtype=np.int64)
            size = n[j].astype(np.int64) + int(n[i])
            most = (size - differ) // 2
            j = j[100 * most >= percent * (size - most)]
            if len(j):
                found.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])]))
                held += len(j)
                if held > 1_000_000:
                    found, held = [np.unique(np.concatenate(found, axis=1), axis=1)], 0
    out = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def join(docs: DataFrame, words: int = 5, percent: int = 80, tile_rows: int = TILE_ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; one row for each row.

    Null and empty texts, or texts of white space, have no set and link with
    nothing: their component is their own doc_id. Fewer words than ``words`` are one
    shingle. Rows with the same doc_id are one document, linked if any of its texts
    is. A null doc_id links nothing; its component is that of its set, or null. No
    rows give no rows; other columns are ignored. tile_rows: rows of a group of tiles; in
    larger groups fewer of a pair's tiles repeat it, in smaller ones a task needs less memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(shingle_sets(docs, words, percent), "shingle-sets")
    keys = sets.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    # A set that a third of the rows have is looked up in SALTS places.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    places = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    member = sets.select("doc_id", "n", "k1", "k2", salt.alias("salt")).join(places, ["n", "k1", "k2", "salt"], "left").select("doc_id", "n", "rep")
    member = materialize(member, "shingle-classes")
    several = member.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    # A doc_id with several texts ties their classes; a class whose smallest doc_id has another text is tied to it as well.
    tied = member.filter("doc_id is not null and rep is not null").join(several.filter("lo < hi").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = sets.join(keys.select("n", "k1", "k2", F.col("rep").alias("doc_id")), ["n", "k1", "k2", "doc_id"], "left_semi")
    reps = reps.select(F.explode("heads").alias("key"), F.col("doc_id").alias("id"), "n")
    # Elements of one class only can't make a link.
    tile = Window.partitionBy("key")
    shared = reps.withColumn("lo", F.min("id").over(tile)).withColumn("hi", F.max("id").over(tile)).withColumn("rows", F.count("*").over(tile)).filter("lo < hi")
    tiles = materialize(shared.select("key", "id", "n", "rows"), "shingle-tiles")
    bits = sets.filter("n > 0").select(F.col("doc_id").alias("id"), "n", "bits")
    edges = materialize(tied, "shingle-links")
    first = Window.partitionBy("id").orderBy("key")
    few = tiles.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= HEADS)
    few = _with_bits(_labelled(few.select("key", "id", "n"), components(edges)), bits)
    for k in range(ROUNDS):
        few = materialize(few, "shingle-heads")
        lead = few.groupBy("key").agg(F.min_by(F.struct("id", "n", "comp", "bits"), F.xxhash64("id", F.lit(k))).alias("lead"))
        pairs = few.join(lead, "key").filter((F.col("comp") != F.col("lead.comp")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
        comps = [F.greatest("comp", "lead.comp").alias("hi"), F.least("comp", "lead.comp").alias("lo")]
        pairs = pairs.select(F.col("id").alias("a"), F.col("lead.id").alias("b"), *comps, "n", F.col("lead.n").alias("m"), "bits", F.col("lead.bits").alias("lead_bits"))
        pairs = materialize(_may_link(pairs, percent).distinct(), "shingle-pairs")
        if pairs.isEmpty():
            break
        links = materialize(verify(pairs.select("a", "b"), docs, words, percent).join(pairs, ["a", "b"]), "shingle-links")
        edges = edges.unionByName(links.select("a", "b"))
        # A component takes the smallest label that it is linked to. Chains of labels are left to the next round.
        hook = links.groupBy("hi").agg(F.min("lo").alias("lo"))
        few = few.join(_small(hook), F.col("comp") == F.col("hi"), "left").withColumn("comp", F.coalesce("lo", "comp")).drop("hi", "lo")
    edges = materialize(edges, "shingle-links")
    labels = components(edges)
    pairs = materialize(_tile_pairs(tiles, bits, labels, percent, tile_rows), "shingle-pairs")
    if not pairs.isEmpty():
        edges = materialize(edges.unionByName(verify(pairs, docs, words, percent)), "shingle-links")
        labels = components(edges)
    label = labels.withColumnRenamed("id", "rep")
    out = member.join(label, "rep", "left")
    # An empty text stays alone even if its doc_id has another one.
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")


def _with_bits(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """rows (id, n, ...) and the bitmap of each id's set."""
    wanted = bits.join(_small(rows.select("id").distinct()), "id", "left_semi").dropDuplicates(["id", "n", "bits"])
    return rows.join(wanted, ["id", "n"])


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, hi, lo) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "bits", "lead_bits")), strict=True):
                if len(x) != len(y):
                    x, y = (_fold(v) if len(v) * 8 == LARGE_BITS else v for v in (x, y))
                differ = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                most = (n + m - differ) // 2
                keep.append(100 * most >= percent * (n + m - most))
            yield batch.select(["a", "b", "hi", "lo"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long, hi long, lo long")


def _tile_pairs(tiles: DataFrame, bits: DataFrame, labels: DataFrame, percent: int, tile_rows: int) -> DataFrame:
    """All pairs of different components that share a tile and may link by size and bitmap."""
    rows = _labelled(tiles, labels)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    rows = materialize(rows.join(mixed, "key", "left_semi"), "shingle-mixed")
    parts = rows.count() // tile_rows + 1
    rows = _with_bits(rows, bits)
    b = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    # A large tile is parted into each band with the next one; a pair counts in the tile of its lower member.
    bands = F.when(F.col("rows") > tile_rows // 25, F.array(b, b - 1)).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("band", F.explode(bands)).withColumn("own", F.col("band").isin(-1) | (F.col("band") == b))
    rows = rows.withColumn("tile", F.expr(f"pmod(xxhash64(key), {parts})"))
    return (
        rows.groupBy("band", "tile")
        .applyInArrow(lambda t: _pairs_of_tile(t.combine_chunks(), percent), "a long, b long")
        .distinct()
    )
