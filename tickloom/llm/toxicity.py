"""Toxicity: a factorization machine over hashed terms.

A document is the set of its distinct words. A word stands for the hashed terms
of itself and of its leading letters (4 and 5), so that inflected insults share a
term. Every term t has a weight w_t and a vector v_t; with all term instances i of
a document's distinct words

    score = sigmoid(b + sum_i w_i + 1/2 (|sum_i v_i|^2 - sum_i |v_i|^2))

The second part holds a learned interaction of every pair of terms, such as an
insult with the mention of a group. It is additive in the words, so a document
costs one table look-up for each distinct word.

Terms are hashed into a table of 2^``HASH_BITS`` places, which bounds the model. Of these
the fit keeps the terms whose label odds differ by more than ODDS standard errors, among
all documents or among those that hold a term kept so: a frequent, neutral mention of a
group matters only beside an insult.

The model is fitted on the driver on at most ``MAX_TRAIN_DOCS`` labelled rows, chosen by a
hash of doc_id. Their terms are counted by Spark, and only the kept ones of each document
(never texts) are collected. The scores cover every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, sliced, trim

#: Bound of the labelled sample that the model is fitted on.
MAX_TRAIN_DOCS = 12_000
#: Bits of a hashed term: the model has at most so many places.
HASH_BITS = 20
#: Standard errors that the log odds of a kept term differ by, and documents that it is in at least.
ODDS, SUPPORT = 2.5, 3
FACTORS = 4
PREFIXES = (4, 5)
#: A text is toxic from this score on.
THRESHOLD = 0.3

WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct words in lower case; none for a null or empty text."""
    return set(WORDS.findall(text.lower())) if text else set()


def term_ids(word: str) -> list[int]:
    """Hashed terms of a word: itself and its leading letters."""
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask]
    for n in PREFIXES:
        if len(word) > n:
            out.append(zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) & mask)
    return out


@dataclass
class Model:
    """terms (sorted hashed ids), their weights and vectors, and the bias."""

    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def table(self) -> dict[int, int]:
        return {int(t): i for i, t in enumerate(self.terms)}


def _sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; 0 for an empty one."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def telling(df: np.ndarray, hits: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Whether terms in df of n documents, hits of them toxic, have label odds beyond chance."""
    df, hits = df.astype(float), hits.astype(float)
    a, c = (hits + 0.5) / (toxic + 1), (df - hits + 0.5) / (n - toxic + 1)
    return (df >= SUPPORT) & (np.abs(np.log(a / c)) / np.sqrt(1 / (hits + 0.5) + 1 / (df - hits + 0.5)) > ODDS)


def _kept(flat: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted terms that tell, among all documents or among those that hold one that does."""

    def among(at: np.ndarray, n: int, toxic: int) -> np.ndarray:
        pairs = np.unique((flat[at].astype(np.int64) << 32) | owner[at])
        terms, where = np.unique(pairs >> 32, return_inverse=True)
        df, hits = np.bincount(where, minlength=len(terms)), np.bincount(where, weights=y[pairs & 0xFFFFFFFF], minlength=len(terms))
        return terms[telling(df, hits, n, toxic)]

    first = among(np.arange(len(flat)), len(y), int(y.sum()))
    holds = np.zeros(len(y), bool)
    holds[owner[np.isin(flat, first)]] = True
    return np.union1d(first, among(np.flatnonzero(holds[owner]), int(holds.sum()), int(y[holds].sum())))


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> Model:
    """Fit by Adam on the log loss. docs: the term instances of each document (repeats allowed)."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(docs) or not len(y):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), -10.0)
    counts = np.array([len(d) for d in docs])
    flat = np.concatenate(docs).astype(np.int32, copy=False) if counts.sum() else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
    terms = _kept(flat, owner, y)
    n1, n0 = y.sum(), len(y) - y.sum()
    # Places of the instances of kept terms, block by block.
    known_at, known_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for lo in range(0, len(flat) if len(terms) else 0, 1 << 20):
        part = flat[lo : lo + (1 << 20)]
        at = np.searchsorted(terms, part)
        at[at >= len(terms)] = 0
        known = terms[at] == part
        known_at.append(at[known])
        known_owner.append(owner[lo : lo + (1 << 20)][known])
    del flat, owner
    at, owner = np.concatenate(known_at), np.concatenate(known_owner)
    counts = np.bincount(owner, minlength=len(docs))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    m = len(terms)
    theta = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.02, (m, FACTORS))], axis=1)
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    m1, m2, bm1, bm2, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            cnt = counts[rows]
            idx = np.concatenate([at[offsets[r] : offsets[r + 1]] for r in rows]) if cnt.sum() else np.zeros(0, int)
            starts = np.concatenate([[0], np.cumsum(cnt)[:-1]])
            inst = theta[idx]
            v = inst[:, 1:]
            s = _sums(inst, starts, cnt)
            sq = _sums((v * v).sum(axis=1), starts, cnt)
            score = bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - sq)
            err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) / len(rows)
            e = np.repeat(err, cnt)
            grad = np.empty((len(idx), 1 + FACTORS))
            grad[:, 0] = e
            grad[:, 1:] = e[:, None] * (np.repeat(s[:, 1:], cnt, axis=0) - v)
            g = np.stack([np.bincount(idx, weights=grad[:, j], minlength=m) for j in range(1 + FACTORS)], axis=1) + l2 * theta
            step += 1
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            gb = err.sum()
            bm1, bm2 = 0.9 * bm1 + 0.1 * gb, 0.999 * bm2 + 0.001 * gb * gb
            bias -= rate * (bm1 / (1 - 0.9**step)) / (np.sqrt(bm2 / (1 - 0.999**step)) + 1e-8)
        rate *= 0.9
    return Model(terms, theta[:, 0].copy(), theta[:, 1:].copy(), float(bias))


def score_words(model: Model, docs: list[set[str]], rows: dict[str, tuple[int, ...]], table: dict[int, int]) -> np.ndarray:
    """Scores of documents given as word sets. rows: cache of each word's places in the model."""
    flat: list[int] = []
    counts = np.zeros(len(docs), dtype=np.int64)
    for k, words in enumerate(docs):
        before = len(flat)
        for w in words:
            found = rows.get(w)
            if found is None:
                found = tuple(i for t in term_ids(w) if (i := table.get(t)) is not None)
                if len(rows) > 150_000:
                    rows.clear()
                rows[w] = found
            if found:
                flat += found
        counts[k] = len(flat) - before
    idx = np.array(flat, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(docs) else np.zeros(0, int)
    v = model.vectors[idx]
    s = _sums(v, starts, counts)
    sq = _sums((v * v).sum(axis=1), starts, counts)
    x = model.bias + _sums(model.weights[idx], starts, counts) + 0.5 * ((s * s).sum(axis=1) - sq)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        terms = [[t for w in words_of(x) for t in term_ids(w)] for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("label"), pa.array(terms, pa.list_(pa.int32()))], names=["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the rows of labels (doc_id, label) whose crc32(doc_id as text) mod 4 is not 2.

    Only doc_id and the label are read from labels; rows with a null in either do
    not count, and a doc_id labelled twice takes its larger label. Without any
    labelled document the model scores all texts alike, near 0.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)
    # The bound of the sample bounds the broadcast.
    pairs = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("label", "text")
    terms = materialize(pairs.mapInArrow(_instances, "label int, terms array<int>"), "toxic-terms")

    def counted(rows: DataFrame) -> np.ndarray:
        """Terms of rows that tell. The driver sees no more counts than the table has places."""
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        own = rows.select("label", F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.sum("label").alias("hits"))
        got = own.filter(F.col("df") >= SUPPORT).toArrow()
        t, df, hits = (got.column(c).to_numpy() for c in ("t", "df", "hits"))
        return np.sort(t[telling(df, hits, n, toxic)])

    def kept_of(kept: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [[t for t, known in zip(x, np.isin(x, kept), strict=True) if known] if x else [] for x in batch.column("terms").to_pylist()]
                yield pa.record_batch([batch.column("label"), pa.array(own, pa.list_(pa.int32()))], names=["label", "terms"])

        return run

    schema = "label int, terms array<int>"
    first = counted(terms)
    kept = np.union1d(first, counted(materialize(terms.mapInArrow(_holding(first), schema), "toxic-beside")))
    got = terms.mapInArrow(kept_of(kept), schema).toArrow()
    model = fit([np.array(x, np.int32) for x in got.column("terms").to_pylist()], got.column("label").to_numpy())
    del got
    trim()
    return model


def _holding(kept: np.ndarray):
    """The rows with one of the kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(x) and bool(np.isin(x, kept).any()) for x in batch.column("terms").to_pylist()], pa.bool_()))

    return run


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit; a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score; every row is kept, null and empty texts get the score of no words.

    The model has at most 2^``HASH_BITS`` terms, so its copy in each task is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = model.table(), {}
        for batch in sliced(batches, "text"):
            x = score_words(model, [words_of(t) for t in batch.column("text").to_pylist()], rows, table)
            yield pa.record_batch([batch.column("doc_id"), pa.array(x)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, columns as they were, whatever their names.

    Null and empty texts score low and stay; texts are scored whole; repeated rows stay
    or go together; no rows give none.
    """
    kept = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = model.table(), {}
        for batch in sliced(batches, "text"):
            x = score_words(model, [words_of(t) for t in batch.column("text").to_pylist()], rows, table)
            yield batch.filter(pa.array(x < threshold))

    return docs.mapInArrow(run, kept)
