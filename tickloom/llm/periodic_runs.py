"""Runs of repeated words: longest Lyndon words under both orders, extended by LCP and range minima.

A run is a stretch of words with a smallest period q that no neighbouring word extends.
By the runs theorem every run has a Lyndon root under one of two opposite orders of the
words, and that root is the longest Lyndon word at its start: it ends where the next
smaller value of the inverse suffix array stands. So the n longest Lyndon words of each
order hold all runs; a candidate (i, q) is extended right by the longest common extension
of i and i + q and left by that of the reversed words, each a minimum over a range of the
LCP array.

What counts is a run of at least ``times`` periods and ``least`` words. Two facts about such
runs spare work without losing any:

* each of its words stands in it at least ``times`` times, so a word that the text holds
  fewer times is in none, and the text falls into segments between those words;
* the first of its roots is followed by ``times`` - 2 full periods or more to the right.

Texts don't depend on each other. Within a worker the segments of many texts lie one after
the other, each with an end of its own below all words, and numpy sorts the suffixes of all
by prefix doubling (only those that still tie), so the cost is a few sorts for each batch
of about ``BATCH`` words. A longer segment is a batch of its own; memory is linear in it,
but for one array of ranks for each doubling.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import sliced

#: Words of a run and periods of a run that counts; words of a batch of segments.
LEAST, TIMES, BATCH = 24, 3, 1 << 17
#: Values of a block of the range minima; neighbours tried before the tree of minima.
BLOCK, NEAR = 16, 6
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """The maximal stretches of characters other than the six ASCII white spaces, in UTF-8."""
    return text.encode().split() if text else []


class RangeMin:
    """Minima over ranges: prefix and suffix minima within blocks, a sparse table over blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        rows = np.concatenate([values, np.full(-len(values) % BLOCK, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, BLOCK)
        self.first = np.minimum.accumulate(rows, axis=1).ravel()
        self.last = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(rows):
            half, below = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low..high]), ends included, low <= high."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.last[low], self.first[high])
        (same,) = np.nonzero(a == b)
        out[same] = self.values[low[same]]
        for k in range(1, BLOCK):
            out[same] = np.minimum(out[same], self.values[np.minimum(low[same] + k, high[same])])
        (far,) = np.nonzero(b - a > 1)
        level = np.frexp((b[far] - a[far] - 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = far[level == k]
            t = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(t[a[at] + 1], t[b[at] - (1 << k)]))
        return out


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4, ... keys.

    No two suffixes are equal, as each segment's end has a key of its own.
    """
    n = len(key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    held = key[order]
    fresh = np.concatenate([[True], held[1:] != held[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, width = [rank], 1
    tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
    (places,) = np.nonzero(tied)
    while len(places):
        at = order[places]
        pair = rank[at].astype(np.int64) * n + rank[at + width]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[places] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank = rank.copy()
        rank[at] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        ranks.append(rank)
        places = places[~(fresh & np.concatenate([fresh[1:], [True]]))]
        width *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix and the next in order, from the ranks of each doubling."""
    lcp = np.zeros(max(len(order) - 1, 1), np.int32)
    a, b = order[:-1], order[1:]
    (at,) = np.nonzero(ranks[0][a] == ranks[0][b])
    a, b = a[at].astype(np.int64), b[at].astype(np.int64)
    found = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        found += (ranks[k][a + found] == ranks[k][b + found]).astype(np.int64) << k
    lcp[at] = found
    return lcp


class Extension:
    """Longest common extensions of suffixes by the range minima of the LCP array."""

    def __init__(self, order: np.ndarray, ranks: list[np.ndarray]) -> None:
        self.place, self.least = ranks[-1], RangeMin(common_prefixes(order, ranks))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return self.least(np.minimum(a, b), np.maximum(a, b) - 1).astype(np.int64)


def next_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, which there must be."""
    out = np.empty(len(at), np.int64)
    left = np.arange(len(at))
    for step in range(1, NEAR + 1):
        near = np.minimum(at[left] + step, len(values) - 1)
        hit = values[near] < values[at[left]]
        out[left[hit]] = near[hit]
        left = left[~hit]
    if not len(left):
        return out
    levels = [np.concatenate([values, np.full((1 << (len(values) - 1).bit_length()) - len(values), np.iinfo(values.dtype).max, values.dtype)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    # Up to the first whole block with a smaller value, then down to its first such value.
    value, place = values[at[left]], at[left] + NEAR + 1
    level = np.full(len(left), -1)
    for k, minima in enumerate(levels):
        (here,) = np.nonzero((level < 0) & ((place >> k) & 1 == 1))
        hit = minima[place[here] >> k] < value[here]
        level[here[hit]] = k
        place[here[~hit]] += 1 << k
    for k in range(len(levels) - 1, 0, -1):
        (here,) = np.nonzero(level == k)
        right = levels[k - 1][place[here] >> (k - 1)] >= value[here]
        place[here[right]] += 1 << (k - 1)
        level[here] = k - 1
    out[left] = place
    return out


def joined(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments one after the other, an end behind each: words (0 for an end), segment of each place, starts."""
    sizes = np.array([len(s) + 1 for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = np.zeros(sizes.sum(), np.int64)
    owner = np.repeat(np.arange(len(segments)), sizes)
    inner = np.ones(len(words), bool)
    inner[starts + sizes - 1] = False
    words[inner] = np.concatenate(segments).astype(np.int64) + 1
    return words, owner, starts


def runs_of_segments(segments: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (segment, start in it, length, period) of all runs that count, each once. A segment holds word numbers."""
    width = max(int(s.max()) for s in segments) + 2
    words, owner, starts = joined(segments)
    (inner,) = np.nonzero(words)
    base = owner * width
    found, right = [], None
    for up in (True, False):
        order, ranks = suffix_order(base + np.where(words > 0, words if up else width - words, 0))
        if up:
            right = Extension(order, ranks)
        end = next_smaller(ranks[-1], inner)
        q = end - inner
        alike = words[inner] == words[end]
        i, q = inner[alike], q[alike]
        ahead = right(i, i + q)
        enough = ahead >= (times - 2) * q
        found.append(np.stack([i[enough], q[enough], ahead[enough]]))
    i, q, ahead = np.concatenate(found, axis=1)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    # The left side: the same over the reversed words of the segments that have a candidate.
    used, at = np.unique(owner[i], return_inverse=True)
    turned, turned_owner, turned_starts = joined([segments[s][::-1] for s in used])
    left = Extension(*suffix_order(turned_owner * width + turned))
    size = np.array([len(segments[s]) for s in used])
    k = i - starts[owner[i]]
    behind = np.zeros(len(i), np.int64)
    (inside,) = np.nonzero(k > 0)
    mirror = turned_starts[at[inside]] + size[at[inside]] - k[inside]
    behind[inside] = left(mirror, mirror - q[inside])
    length = behind + q + ahead
    counts = length >= np.maximum(least, times * q)
    rows = np.stack([owner[i], k - behind, length, q], axis=1)[counts]
    return np.unique(rows, axis=0)


def find_runs(texts: Iterable[np.ndarray], least: int = LEAST, times: int = TIMES, batch: int = BATCH) -> list[np.ndarray]:
    """For each array of word numbers its runs that count: rows (start, length, period) by start, then period."""
    out: list[list[np.ndarray]] = []
    segments, places, held = [], [], 0

    def settle() -> None:
        rows = runs_of_segments(segments, least, times)
        owners, firsts = np.unique(rows[:, 0], return_index=True)
        for s, part in zip(owners, np.split(rows[:, 1:], firsts[1:]) if len(firsts) else [], strict=True):
            text, start = places[s]
            out[text].append(part + [start, 0, 0])
        segments.clear()
        places.clear()

    for k, ids in enumerate(texts):
        out.append([])
        if len(ids) < least:
            continue
        rare = np.bincount(ids)[ids] < times
        cuts = np.concatenate([[-1], np.nonzero(rare)[0], [len(ids)]])
        for c in np.nonzero(np.diff(cuts) > least)[0]:
            start, end = cuts[c] + 1, cuts[c + 1]
            segments.append(ids[start:end])
            places.append((k, start))
            held += end - start
            if held >= batch:
                settle()
                held = 0
    if segments:
        settle()
    runs = [np.concatenate(parts) if parts else np.zeros((0, 3), np.int64) for parts in out]
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in runs]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number by first occurrence."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    return b" ".join([words[i] for i in np.nonzero(kept_words(len(words), runs))[0]])


def find(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with ``runs`` (start and length in words, period; by start, then period) and ``collapsed``.

    A null or empty text, or one of few words, has no runs; a null text collapses to
    an empty one, any other to its words joined by one space, each run cut to its first
    period. Columns named runs or collapsed are replaced, others stay whatever their
    names. A text's runs depend on nothing else, so repeated rows get the same and no rows
    give none; a text of any length is handled whole.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    packed = docs.select(F.struct(*[quoted(c) for c in others]).alias("row"), quoted(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = [words_of(t.as_py()) for t in batch.column("text")]
            found = find_runs(map(numbered, words), least, times)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            shown = [collapsed(w, r).decode() for w, r in zip(words, found, strict=True)]
            yield pa.record_batch([batch.column("row"), pa.array(rows, kind), pa.array(shown, pa.string())], names=["row", "runs", "collapsed"])

    schema = StructType([packed.schema["row"], *StructType.fromDDL(f"runs {RUNS}, collapsed string")])
    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in others], "runs", "collapsed")
