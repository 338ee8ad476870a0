"""Readers and writers of tapes, books, klines, event documents and results.

A table of trades is partitioned by symbol and day, so a date range prunes files before
anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schema import normalise

c = F.col
AGG_TRADE = "a long, p string, q string, f long, l long, T long, m boolean"


def read_trades(spark: SparkSession, root: str, symbol: str | None = None, start: str | None = None, end: str | None = None, inclusive: bool = False) -> DataFrame:
    """Trades of [start, end) by day, or [start, end] with inclusive, as a canonical tape."""
    df = spark.read.parquet(root)
    if symbol is not None:
        df = df.filter(c("symbol") == symbol)
    if start is not None:
        df = df.filter(c("dt") >= F.lit(start).cast("date"))
    if end is not None:
        day = F.lit(end).cast("date")
        df = df.filter(c("dt") <= day if inclusive else c("dt") < day)
    return normalise(df)


def write_days(df: DataFrame, root: str, ts: str = "ts", skip_existing: bool = False) -> None:
    """Write by symbol and day. Days present are replaced one by one, or left as they are."""
    df = df.withColumn("dt", F.to_date(ts))
    if skip_existing:
        try:
            there = df.sparkSession.read.parquet(root).select("symbol", "dt").distinct()
            df = df.join(F.broadcast(there) if there.count() <= 100_000 else there, ["symbol", "dt"], "left_anti")
        except Exception as e:  # noqa: BLE001  nothing is there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "dt").parquet(root)


def decode_agg_trades(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of aggregated trades as a tape; works on streams too. m (buyer is maker) means a sell."""
    x = messages.select(*[k for k in messages.columns if k != column], F.from_json(column, AGG_TRADE).alias("j"))
    others = [k for k in messages.columns if k != column]
    return x.select(
        *others,
        F.timestamp_millis("j.T").alias("ts"),
        c("j.a").alias("seq"),
        c("j.p").cast("double").alias("price"),
        c("j.q").cast("double").alias("qty"),
        (c("j.p").cast("double") * c("j.q").cast("double")).alias("notional"),
        F.when(c("j.m"), "sell").otherwise("buy").alias("side"),
        c("j.f").alias("first_id"),
        c("j.l").alias("last_id"),
        (c("j.l") - c("j.f") + 1).alias("n_fills"),
    )


def read_klines(df: DataFrame) -> DataFrame:
    """Klines with repeated timestamps reduced to the first."""
    w = Window.partitionBy("symbol", "ts").orderBy("open", "close", "volume")
    return df.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def floor_book(book: DataFrame, seconds: int, columns: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The last value that is there of each column in each bin."""
    bin_ = F.timestamp_seconds((F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds).cast("long"))
    rows = book.withColumn("bin", bin_)
    last = lambda x: F.max_by(x, F.when(c(x).isNotNull(), F.struct(ts, seq))).alias(x)
    return rows.groupBy("symbol", "bin").agg(*[last(x) for x in columns])


def recent(df: DataFrame, cutoff, ts: str = "ts") -> DataFrame:
    return df.filter(c(ts) >= F.lit(cutoff)).orderBy(ts)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written there if it is missing."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def market_events(docs: DataFrame, keywords: list[str], column: str = "value") -> DataFrame:
    """Event documents with lists kept as JSON strings inside JSON, by any keyword in the title."""
    schema = "id string, title string, outcomes string, outcomePrices string, clobTokenIds string"
    x = docs.select(F.from_json(column, schema).alias("j")).select("j.*")
    lists = {k: F.from_json(k, "array<string>") for k in ("outcomes", "outcomePrices", "clobTokenIds")}
    found = F.lit(False)
    for k in keywords:
        found = found | F.lower("title").contains(k.lower())
    return x.withColumns(lists).withColumn("outcomePrices", F.transform("outcomePrices", lambda p: p.cast("double"))).filter(found)


def token_for_signal(markets: DataFrame, signal: str = "signal") -> DataFrame:
    """The outcome token that a signal buys, by the words of the title and the outcomes."""
    up = F.lower("title").rlike("up|above|higher|rise")
    want = F.when(c(signal) > 0, F.when(up, "yes").otherwise("no")).when(c(signal) < 0, F.when(up, "no").otherwise("yes"))
    at = F.array_position(F.transform("outcomes", lambda o: F.lower(o)), want).cast("int")
    return markets.withColumn("token", F.when(at > 0, F.try_element_at("clobTokenIds", at)))


def write_results(df: DataFrame, path: str, form: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else getattr(w, form)(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def stream_trades(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of JSON messages as they arrive, decoded."""
    return decode_agg_trades(spark.readStream.schema(schema).json(path))


def stream_to_days(df: DataFrame, path: str, checkpoint: str):
    """Append a stream of trades to Parquet by symbol and day, once each."""
    return df.withColumn("dt", F.to_date("ts")).writeStream.format("parquet").partitionBy("symbol", "dt").option("path", path).option("checkpointLocation", checkpoint)


def table_path(root: str, kind: str, symbol: str | None = None, dt: str | None = None) -> str:
    return "/".join([root.rstrip("/"), kind, *([f"symbol={symbol.replace('/', '')}"] if symbol else []), *([f"dt={dt}"] if dt else [])])
