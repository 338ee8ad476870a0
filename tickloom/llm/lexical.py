"""Ranked lexical search: variable blocks with maxima, and exact search that skips blocks, shard by shard.

Index. Documents become shards where they lie: a task writes one row for each shard of at
most ``SHARD_POSTINGS`` postings, so there is no shuffle and no term, however frequent, meets
in one task. A shard holds its documents by ascending doc_id, each term's postings (document,
occurrences) and the ends of their blocks. Dynamic programming chooses the ends of each
list: a block costs ``BLOCK_COST`` and the sum of what its maximum overstates each document
by from its first to its last posting, under the shard's own statistics; the least total
wins. So lone postings of rare terms are blocks of their own. Frequencies of terms over all
documents come from the shards by one small aggregation.

Search. A worker takes a block of items through its shards and keeps each item's best k from
shard to shard. The blocks of an item's terms cut a shard's documents into windows; the
sum of the block maxima over a window (exact under the corpus' statistics) bounds each score
in it. Windows are scored in descending order of their bounds, in rounds, until the bound is
below the k-th score: those left can't hold a result, and their postings are never touched. A
sixteenth of the shards is searched first; the k-th scores found there are bounds from below
for all others, so the rest send only what may still count.

Scores are 64-bit integers; equal ones go by ascending doc_id, null last.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, sliced, trim

#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 1 << 17
#: What a block costs besides its error, in units of scores; postings of a block; values that are cut at once.
BLOCK_COST, SPAN, GRID = 4_000_000_000, 64, 500_000
#: Bytes of the items' terms up to which the index holds only those, and of items that a worker searches at once.
TERM_BYTES, ITEM_BYTES = 32 << 20, 4 << 20
#: Windows of a first round; each further one is four times as large.
FIRST = 128
#: One shard of so many is searched first.
AHEAD = 16
#: Separators become spaces, A-Z lower case; all other characters are parts of terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD = "shard long, n_docs long, n_terms long, ids array<bigint>, lengths binary, terms array<string>, counts array<int>, docs binary, tfs binary, block_counts binary, block_ends binary"
HIT = "place int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats: maximal stretches of letters and digits and of all beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


def contributions(tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight; lengths are those of the postings' documents."""
    m = 50 + 50 * lengths.astype(np.int64) * n_docs // max(n_terms, 1)
    tf = tfs.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def block_ends(values: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each list of postings (lists lie one after the other): how many, and their ends within all postings.

    best[j] = min over i of best[i] + BLOCK_COST + max(i..j) * documents from i to j - sum(i..j),
    for blocks of at most SPAN postings. Lists of like length go through it together.
    """
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    ends: list[np.ndarray] = [np.zeros(0, np.int64)] * len(counts)
    size_class = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for c in np.unique(size_class):
        lists = np.nonzero(size_class == c)[0]
        for part in np.array_split(lists, max(1, len(lists) * (1 << c) // GRID)):
            for which, found in zip(part, _cut_lists(values, docs, starts[part], counts[part]), strict=True):
                ends[which] = found + starts[which]
    return np.array([len(e) for e in ends], np.int64), np.concatenate(ends) if ends else np.zeros(0, np.int64)


def _cut_lists(values: np.ndarray, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The ends of the blocks of some lists, within each list."""
    rows, most = len(starts), int(counts.max())
    at = np.minimum(starts[:, None] + np.arange(most), len(values) - 1)
    value, doc = values[at], docs[at].astype(np.int64)
    total = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(value, axis=1)], axis=1)
    best = np.zeros((rows, most + 1), np.int64)
    back = np.zeros((rows, most + 1), np.int32)
    highest = np.zeros((rows, most), np.int64)  # highest[:, i]: the maximum from i to j
    for j in range(most):
        low = max(0, j + 1 - SPAN)
        np.maximum(highest[:, low : j + 1], value[:, j : j + 1], out=highest[:, low : j + 1])
        spanned = doc[:, j : j + 1] - doc[:, low : j + 1] + 1
        cost = best[:, low : j + 1] + total[:, low : j + 1] + highest[:, low : j + 1] * spanned
        back[:, j + 1] = low + cost.argmin(axis=1)
        best[:, j + 1] = cost.min(axis=1) - total[:, j + 1] + BLOCK_COST
    out = []
    for r, n in enumerate(counts.tolist()):
        found, to = [], back[r].tolist()
        while n > 0:
            found.append(n)
            n = to[n]
        out.append(np.array(found[::-1], np.int64))
    return out


class Writer:
    """Gathers documents and gives them as rows of shards."""

    def __init__(self, first: int, wanted: frozenset[bytes] | None, postings: int = SHARD_POSTINGS) -> None:
        self.next, self.wanted, self.most = first, wanted, postings
        self._open()

    def _open(self) -> None:
        self.ids, self.lengths, self.n_docs, self.n_terms, self.held = [], [], 0, 0, 0
        self.number: dict[bytes, int] = {}
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list[int | None], texts: Iterator[str | None]) -> Iterator[pa.RecordBatch]:
        for i, text in zip(ids, texts, strict=True):
            words = terms_of(text)
            if not words:
                continue
            self.n_docs += 1
            self.n_terms += len(words)
            found = Counter(words if self.wanted is None else filter(self.wanted.__contains__, words))
            if not found:
                continue
            terms = np.fromiter((self.number.setdefault(w, len(self.number)) for w in found), np.int32, len(found))
            self.postings.append((terms, np.full(len(found), len(self.ids), np.int32), np.fromiter(found.values(), np.int32, len(found))))
            self.ids.append(i)
            self.lengths.append(len(words))
            self.held += len(found)
            if self.held >= self.most or len(self.ids) >= SHARD_DOCS:
                yield self.close()

    def close(self) -> pa.RecordBatch:
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        nulls = np.array([i is None for i in self.ids], bool)
        by = np.lexsort((ids, nulls))
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True)) if self.postings else (np.zeros(0, np.int32),) * 3
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        lengths = np.array(self.lengths, np.int32)[by]
        counts = np.bincount(term, minlength=len(self.number)).astype(np.int64)
        own = np.array([weight(self.n_docs, n) for n in counts.tolist()], np.int64)
        blocks, ends = block_ends(contributions(tf, lengths[doc], self.n_docs, self.n_terms) * own[term], doc, counts)
        row = {
            "shard": self.next, "n_docs": self.n_docs, "n_terms": self.n_terms,
            "ids": [None if nulls[k] else int(ids[k]) for k in by], "lengths": lengths.tobytes(),
            "terms": [w.decode() for w in self.number], "counts": counts.tolist(), "docs": doc.tobytes(), "tfs": tf.tobytes(),
            "block_counts": blocks.astype(np.int32).tobytes(), "block_ends": ends.astype(np.int32).tobytes(),
        }
        self.next += 1
        self._open()
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)


_ARROW = pa.schema(
    [(n, {"long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (x.split() for x in SHARD.split(", "))]
)


@dataclass
class Index:
    """Shards of documents, and their statistics: documents with a term, and terms with repeats."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    def frequencies(self) -> DataFrame:
        """term, df."""
        pair = F.explode(F.arrays_zip("terms", "counts")).alias("x")
        return self.shards.select(pair).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))


def build(docs: DataFrame, wanted: frozenset[bytes] | None = None, postings: int = SHARD_POSTINGS) -> Index:
    """Index docs (doc_id, text): every term, or the wanted ones, in shards of so many postings. Every document counts in the statistics."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(TaskContext.get().partitionId() << 32, told.value, postings)
        for batch in sliced(batches, "text", 4 << 20):
            yield from writer.add(batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text")))
        if writer.n_docs:
            yield writer.close()
        trim()

    shards = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SHARD), "lexical-index")
    n, m = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(shards, n or 0, m or 0)


class Best:
    """The k best documents of an item so far: scores, ids, which ids are null."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bound(self) -> int:
        """The least score that may still count."""
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        top = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[top], ids[top], nulls[top]


class Shard:
    """One shard under the corpus' statistics."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        read = lambda name: np.frombuffer(row[name], np.int32)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.nulls = np.array([i is None for i in row["ids"]], bool)
        self.docs, counts = read("docs"), np.array(row["counts"], np.int64)
        self.number = {w: k for k, w in enumerate(row["terms"])}
        self.values = contributions(read("tfs"), read("lengths")[self.docs], n_docs, n_terms)
        self.key = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * (len(self.ids) + 1) + self.docs
        ends = read("block_ends").astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        self.most = np.maximum.reduceat(self.values, starts) if len(ends) else np.zeros(0, np.int64)
        self.first, self.last = self.docs[starts].astype(np.int64) if len(ends) else starts[:0], self.docs[ends - 1].astype(np.int64) if len(ends) else starts[:0]
        self.block_at = np.concatenate([[0], np.cumsum(read("block_counts"))]).astype(np.int64)
        self.skipped = self.scored = 0

    def search(self, weights: dict[str, int], best: Best) -> None:
        """Bring the item's documents of this shard that count into best."""
        mine = [(self.number[t], w) for t, w in weights.items() if t in self.number]
        if not mine:
            return
        terms, w = (np.array(x, np.int64) for x in zip(*mine, strict=True))
        low, n = self.block_at[terms], self.block_at[terms + 1] - self.block_at[terms]
        block = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        value = self.most[block] * np.repeat(w, n)
        place = np.concatenate([self.first[block], self.last[block] + 1])
        by = np.argsort(place, kind="stable")
        place, sums = place[by], np.cumsum(np.concatenate([value, -value])[by])
        last = np.append(place[1:] != place[:-1], True)
        edges, bounds = place[last], sums[last][:-1]
        windows = np.nonzero(bounds >= best.bound)[0]
        self.skipped += len(bounds) - len(windows)
        windows = windows[np.argsort(-bounds[windows], kind="stable")]
        size = FIRST
        while len(windows) and bounds[windows[0]] >= best.bound:
            now, windows = windows[:size], windows[size:]
            now = np.sort(now[bounds[now] >= best.bound])
            self.scored += len(now)
            # Windows that touch are one.
            joint = np.append(True, now[1:] != now[:-1] + 1)
            start, end = edges[now[joint]], edges[now[np.append(joint[1:], True)] + 1]
            base = terms[:, None] * (len(self.ids) + 1)
            a, b = np.searchsorted(self.key, (base + start).ravel()), np.searchsorted(self.key, (base + end).ravel())
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            gains = self.values[at] * np.repeat(np.repeat(w, len(start)), n)
            # Sums stay below 2^53, so doubles hold them exactly.
            scores = np.bincount(self.docs[at], gains, minlength=len(self.ids)).astype(np.int64)
            (found,) = np.nonzero(scores >= best.bound)
            best.add(scores[found], self.ids[found], self.nulls[found])
            size *= 4
        self.skipped += len(windows)


def item_terms(items: DataFrame) -> frozenset[bytes] | None:
    """All terms of the items (text), or None if they exceed TERM_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column("text") for w in terms_of(t.as_py())}
            yield pa.record_batch([pa.array([w.decode() for w in found], pa.string())], names=["term"])

    terms = items.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string").distinct()
    if (terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) > TERM_BYTES:
        return None
    return frozenset(r["term"].encode() for r in terms.collect())


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """The items by id in blocks of ITEM_BYTES: (place, item_id, terms). One partition at a time comes to the driver."""
    block, held = [], 0
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).orderBy(F.asc_nulls_last("item_id"), "text")
    for place, r in enumerate(rows.toLocalIterator()):
        terms = sorted(set(terms_of(r["text"])))
        block.append((place, r["item_id"], terms))
        held += sum(map(len, terms))
        if held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def search_shards(shards: DataFrame, index: Index, weights: list[tuple[int, dict[str, int]]], k: int, floors: dict[int, int]) -> DataFrame:
    """(place, doc_id, score): each worker's k best documents of every item among its shards, none below the item's floor."""
    told = shards.sparkSession.sparkContext.broadcast((weights, floors))
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, floors = told.value
        best = [Best(k, floors.get(place, 1)) for place, _ in weights]
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch.slice(n, 1).to_pylist()[0], n_docs, n_terms)
                for (_, w), b in zip(weights, best, strict=True):
                    shard.search(w, b)
        for (place, _), b in zip(weights, best, strict=True):
            if len(b.scores):
                yield pa.record_batch([pa.array([place] * len(b.scores), pa.int32()), pa.array(b.ids, mask=b.nulls), pa.array(b.scores)], names=["place", "doc_id", "score"])
        trim()

    return shards.mapInArrow(run, HIT)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0 (all, if fewer).

    Repeated items are answered each; an item with a null text, or without a term of any
    document, has no rows. Null doc_ids rank behind others of the same score, repeated
    rows each have a rank. Without items or documents there are no rows.
    """
    spark, out = items.sparkSession, []
    kind = items.schema["item_id"].dataType
    for block in item_blocks(items):
        own = spark.createDataFrame([(t.decode(),) for t in {t for _, _, terms in block for t in terms}], "term string")
        df = dict(index.frequencies().join(own, "term", "left_semi").collect())
        weights = [(place, {t: weight(index.n_docs, df[t]) for t in map(bytes.decode, terms) if t in df}) for place, _, terms in block]
        weights = [(place, w) for place, w in weights if w]
        early = F.pmod(F.xxhash64("shard"), F.lit(AHEAD)) == 0
        ahead = materialize(search_shards(index.shards.filter(early), index, weights, k, {}), "lexical-ahead")
        ranked = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score")))
        floors = dict(ahead.select("place", "score", ranked.alias("r")).filter(F.col("r") == k).select("place", "score").collect())
        hits = ahead.unionByName(search_shards(index.shards.filter(~early), index, weights, k, floors))
        names = spark.createDataFrame([(place, i) for place, i, _ in block], f"place int, item_id {kind.simpleString()}")
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out.append(top.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole


def rank(docs: DataFrame, items: DataFrame, k: int = 50, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k best of docs (doc_id, text) for each of items (item_id, text); other columns of both are left aside."""
    return search(build(docs, item_terms(items), postings), items, k)
