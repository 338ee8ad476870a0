"""From raw documents to token ids: five stages over the operators of tickloom.llm.

Every stage reads what its predecessor wrote. Toxic documents go, one document of each
group of near copies stays, personal data is generalised, sources are mixed to their
target weights (a document taken n times is n rows), and the texts are encoded; the ids
are decoded again to prove them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, mixing, ngram_join, pii, toxicity
from tickloom.llm.common import materialize

#: Rows of a group of tiles in the n-gram join: 80 % leaves more pairs to compare than 85 %, and small groups repeat them.
TILE_ROWS = 80_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes that an encoding worker remembers, and bytes of text that it encodes at once: it shares its memory with what earlier stages left.
CACHE, SLICE = 12 << 20, 1 << 20
#: Keys of documents without a doc_id of their own begin here.
KEYS = 1 << 62


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of toxicity.

    Null and empty texts score low and stay; a long text is scored whole; repeated rows
    get equal scores and stay or go together; no rows give none. Other columns, a column
    score among them, are as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingles at 80 %: the one with the smallest doc_id.

    A row whose doc_id is null or stands with several rows is a document of its own: its
    key is a hash of all its columns, above every doc_id, so of these the smallest hash
    stays where no document with a doc_id of its own is in the component. Rows alike in
    every column share a key, and one of them stays. Documents without words stay.
    """
    alike = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1 or again is null").select("again")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("own"), F.col("text").alias("whole"))
    rows = rows.join(alike, F.col("own").eqNullSafe(F.col("again")), "left")
    single = F.col("own").isNotNull() & F.col("again").isNull()
    key = F.when(single, F.col("own").cast("long")).otherwise(KEYS + F.pmod(F.xxhash64("row"), F.lit(KEYS)))
    found = ngram_join.join(rows.select(key.alias("doc_id"), F.col("whole").alias("text")), words=5, percent=80, tile_rows=TILE_ROWS)
    leaders = found.filter("doc_id = component_id or n_shingles = 0").select(F.col("doc_id").alias("leader")).distinct()
    kept = rows.withColumn("key", key).join(leaders, F.col("key") == F.col("leader"), "left_semi")
    kept = kept.filter(F.col("key") < KEYS).unionByName(kept.filter(F.col("key") >= KEYS).dropDuplicates(["key"]))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and the terms that reveal it generalised; n_chars follows.

    One row out for each row in: null and empty texts come back as they were, repeated
    rows are changed alike, texts are read whole, and no rows give none. A null or wrong
    n_chars stays where the text did not change.
    """
    out = pii.sanitise(docs.select(packed(docs).alias("row"), "text"))
    changed = F.size("spans") > 0
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        count = F.length("redacted").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, count).otherwise(F.col("row")["n_chars"])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words, null texts among them, are never taken; a null source is a
    source; repeated rows are drawn one by one; no rows give none.
    """
    out = mixing.mix(docs.select(packed(docs).alias("row"), "doc_id", "text", "source")).filter("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of each document, and whether they decode to its text.

    Null and empty texts have no ids and are intact; long texts are encoded whole;
    repeated rows have equal ids; no rows give none.
    """
    docs = docs.select("doc_id", "source", "text")
    found = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, CACHE, SLICE)
    return found.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", "intact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_join", near_copies),
    ("sanitise", personal_data),
    ("mix", mixed),
    ("bpe", tokens),
]
#: A fitted model, components and pre-tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
