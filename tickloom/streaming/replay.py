"""A table replayed as a stream, slice by slice, over one checkpoint: what a live system sees, with a restart between slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Stateful processors need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``; in local mode under a temporary one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep state in RocksDB."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def slices(df: DataFrame, n: int, ts: str = "ts") -> list[DataFrame]:
    """df in n parts of about equal size, one after the other in time."""
    at = F.unix_micros(ts)
    cuts = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    part = sum([F.when(at > cut, 1).otherwise(0) for cut in cuts], F.lit(0))
    return [df.filter(part == k) for k in range(n)]


def replay(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataStreamWriter] | None = None) -> DataFrame | None:
    """Rows of make(stream) where the stream is each part in turn; the query ends and starts again between parts.

    ``write`` replaces the sink: then nothing is returned.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    root = scratch(spark, "replay")
    with state_store(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{root}/in")
            out = make(spark.readStream.schema(schema).parquet(f"{root}/in"))
            writer = write(out) if write else out.writeStream.format("parquet").option("path", f"{root}/out")
            query = writer.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    return None if write else spark.read.schema(out.schema).parquet(f"{root}/out")
