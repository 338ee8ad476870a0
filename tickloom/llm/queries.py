"""The registered queries of this subpackage: each applies one operator to its whole table.

QUERIES[name](spark, sf_dir) returns a DataFrame; ORACLE_SQL[name] is DuckDB SQL
for the same rows where SQL can express them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, dedup, html_text, knn, lexical, mixing, ngram_join, periodic_runs, pii, secrets, token_counts, toxicity, warc
from tickloom.llm.common import sliced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; the fit sees no held-out label."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 best inner products of every vector whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


ORACLE_SQL["op3_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at cosine 0.95, and their components."""
    return dedup.dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def digest_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and digests of the ids of each text and of what they decode to."""
    data = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(data.value, pattern)
        digits = pa.array([b"%d" % i for i in range(max(codec.ranks.values()) + 1)], pa.large_binary())
        for batch in sliced(batches, "text", 4 << 20):
            ids, decoded = codec.round_trip(batch.column("text").to_pylist())
            rows = bpe.lists_of(ids)
            shown = pc.binary_join(pa.ListArray.from_arrays(rows.offsets, digits.take(rows.values)), pa.scalar(b" ", digits.type))
            shown = [sha256(x).hexdigest() for x in shown.to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(shown), pa.array([sha256(x).hexdigest() for x in decoded])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by the public vocabulary and decode the ids."""
    import public_tokenizers

    return digest_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; those with a checksum come beside the base kinds."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.KINDS[:3]))
    counts = [count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 1, 2, 3 in turn and give at most 3 times their size."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op8_mix_sources"] = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, chr(0)) || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS bits FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY source, bits, size) AS k FROM raw),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- Share by weight; sources above three times their size stop there; share again among the others.
share AS (
  SELECT 0 AS step, source, source_size, weight, false AS stopped, 1::BIGINT AS fresh FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight, now, sum((now AND NOT stopped)::INT) OVER ()::BIGINT FROM (
    SELECT *, stopped OR 3 * source_size * sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () <= weight * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) AS now
    FROM share WHERE fresh > 0)),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE (weight * (sum(source_size) OVER ()::BIGINT - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()::BIGINT))::DOUBLE
    / (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM share WHERE step = (SELECT max(step) FROM share)),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
-- p = min(1, c * size): the longest documents are certain until c * size is below 1 for the others.
g AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
c AS (
  SELECT g.source, g.size, r.target - r.whole * r.source_size AS rest,
    coalesce(sum(g.size * g.n) OVER (PARTITION BY g.source ORDER BY g.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
    (sum(g.n * g.size * g.size) OVER (PARTITION BY g.source ORDER BY g.size))::DOUBLE AS squares
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
f AS (SELECT source, arg_max((rest - above) / squares, size) AS factor, max(size) AS longest, arg_max(floor(rest - above), size)::BIGINT AS gap FROM c WHERE (rest - above) * size < squares GROUP BY source),
p AS (
  SELECT d.*, r.source_size, r.target, r.whole, CASE WHEN d.size > f.longest THEN 1.0::DOUBLE ELSE coalesce(f.factor * d.size, 0) END AS p,
    ((CASE WHEN k = 1 THEN bits ELSE ('0x' || substr(md5('mix|' || bits || '|' || k), 1, 13))::BIGINT END)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source),
q AS (SELECT source, bits, k, size, row_number() OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), bits, k) AS place FROM p WHERE p > 0 AND p < 1),
-- One document after the other, each that still fits.
walk AS (
  SELECT source, 0::BIGINT AS place, gap, false AS took FROM f
  UNION ALL
  SELECT w.source, q.place, CASE WHEN q.size <= w.gap THEN w.gap - q.size ELSE w.gap END, q.size <= w.gap
  FROM walk w JOIN q ON q.source IS NOT DISTINCT FROM w.source AND q.place = w.place + 1),
won AS (SELECT q.source, q.bits, q.k, q.size FROM walk JOIN q ON q.source IS NOT DISTINCT FROM walk.source AND q.place = walk.place WHERE took)
SELECT p.doc_id, p.size, p.source_size, p.target, least(p.whole + CASE WHEN p.p = 1 OR won.bits IS NOT NULL THEN 1 ELSE 0 END, 3) * p.size AS taken
FROM p LEFT JOIN won ON p.source IS NOT DISTINCT FROM won.source AND p.bits = won.bits AND p.k = won.k AND p.size = won.size
"""


@query
def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that reveal it."""
    found = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each page is a full response, visited again later and found not modified.

    The second visit has the page's own validator, or none when the page's etag ends in
    0 to 3; so it agrees with the latest earlier response of the URL only if no other
    page was fetched there in between.
    """
    etag = F.substring(F.md5("html"), 1, 8)
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"),
        "url",
        (2 * F.col("page_id")).alias("ts"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), day(2 * F.col("page_id"))).alias("headers"),
        F.col("page_id").alias("payload_id"),
    )
    later = 2 * F.col("page_id") + 1 + 2 * F.pmod(F.col("page_id") * 37, F.lit(500))
    asked = F.when(F.substring(F.md5("html"), 8, 1) < "4", F.create_map(F.lit("date"), day(later), F.lit("Server"), F.lit("x")))
    asked = asked.otherwise(F.create_map(F.lit("date"), day(later), F.lit("etag"), F.concat(F.lit("W/"), etag)))
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", later.alias("ts"), F.lit(304).alias("status"), asked.alias("headers"), F.lit(None).cast("long").alias("payload_id")
    )
    return full.unionByName(again)


@query
def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl log with the response that it stands for."""
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "canonical", "refers_to", "verdict", "payload_id", shown.alias("headers"))


ORACLE_SQL["op10_revisits"] = r"""
WITH u AS (SELECT page_id, substr(md5(html), 1, 8) AS etag, substr(md5(html), 8, 1) AS last,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
p AS (SELECT page_id, etag, last,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(?:80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(regexp_extract(u, '^[^/?]*(.*)$', 1), '^[^?]*'), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(regexp_extract(u, '^[^/?]*(.*)$', 1), '\?(.*)$', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(regexp_extract(q, '^[^=]*'), '^(?:utm_[a-z]+|ref|gclid|fbclid)$'))) AS query FROM u),
c AS (SELECT *, place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM p),
r AS (SELECT 2 * page_id + 1 AS record_id, canonical, 2 * page_id + 1 + 2 * (page_id * 37 % 500) AS ts, etag, last < '4' AS bare FROM c),
f AS (SELECT page_id, 2 * page_id AS ts, canonical, etag FROM c),
j AS (SELECT r.*, f.page_id, f.etag AS f_etag, CASE WHEN f.page_id IS NULL THEN 'orphan' WHEN bare THEN 'unverified' WHEN f.etag = r.etag THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.ts > f.ts)
SELECT record_id, canonical, CASE WHEN verdict IN ('resolved', 'unverified') THEN 2 * page_id END AS refers_to, verdict,
  CASE WHEN verdict IN ('resolved', 'unverified') THEN page_id END AS payload_id,
  CASE WHEN verdict = 'resolved' THEN 'content-type=text/html;date=day ' || ts || ';etag=W/' || etag
       WHEN verdict = 'unverified' THEN 'content-type=text/html;date=day ' || ts || ';etag=' || f_etag
       WHEN bare THEN 'date=day ' || ts || ';server=x' ELSE 'date=day ' || ts || ';etag=W/' || etag END AS headers
FROM j
"""


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by crc32 gets a period: its words from a place on repeat the p words there."""
    h = crc32(b"%d" % doc_id) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest_runs(docs: DataFrame) -> DataFrame:
    """doc_id, the strongest run, and digests of all runs and of the collapsed text."""

    def strongest(runs: list[list[int]]) -> list[int | None]:
        best = None
        for start, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = [start, length, q]
        return [*best, 1000 * best[1] // best[2]] if best else [None] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            ids = batch.column("doc_id").to_pylist()
            words = [with_period(periodic_runs.words_of(t.as_py()), i) for t, i in zip(batch.column("text"), ids, strict=True)]
            found = periodic_runs.find_runs(map(periodic_runs.numbered, words))
            lists = [r.tolist() for r in found]
            best = list(zip(*map(strongest, lists), strict=True))
            shown = [sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in lists]
            kept = [sha256(periodic_runs.collapsed(w, r)).hexdigest() for w, r in zip(words, found, strict=True)]
            numbers = [ids, list(map(len, lists)), *best]
            yield pa.record_batch([*[pa.array(x, pa.int64()) for x in numbers], pa.array(shown), pa.array(kept)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three periods and 24 words or more in every document."""
    return digest_runs(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether they exceed a context of 1024 tokens."""
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLE_SQL["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS big_n, sum(len(ws))::BIGINT AS big_l FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
g AS (SELECT k, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)) AS gain FROM p, s),
r AS (SELECT item_id, k, doc_id, sum(w * gain)::BIGINT AS score FROM i JOIN w USING (term) JOIN g USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""
