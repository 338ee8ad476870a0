"""Canonical tables and the adapters that make them.

A trade tape has symbol, ts, seq (total order), price, qty, notional, side, first_id,
last_id, n_fills. Missing values are NULL everywhere: NaN and infinities become NULL
at the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPE = "symbol long, ts timestamp, seq long, price double, qty double, notional double, side string, first_id long, last_id long, n_fills long"
#: Names that inputs use for canonical columns.
ALIASES = {
    "timestamp": "ts",
    "amount": "qty",
    "volume": "qty",
    "cost": "notional",
    "value": "notional",
    "agg_trade_id": "seq",
    "first_trade_id": "first_id",
    "last_trade_id": "last_id",
    "n_trades_in_agg": "n_fills",
}


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normalise(trades: DataFrame, symbol: str | None = None) -> DataFrame:
    """Any trade table with known names as a canonical tape. Missing columns are derived or NULL."""
    names = {ALIASES.get(c, c): c for c in trades.columns}
    col = lambda c, default: F.col(names[c]) if c in names else default
    price, qty = col("price", F.lit(None)).cast("double"), col("qty", F.lit(None)).cast("double")
    rows = trades.select(
        col("symbol", F.lit(symbol)).alias("symbol"),
        col("ts", F.lit(None)).cast("timestamp").alias("ts"),
        col("seq", F.lit(None)).cast("long").alias("seq"),
        finite(price).alias("price"),
        finite(qty).alias("qty"),
        finite(col("notional", price * qty).cast("double")).alias("notional"),
        F.lower(col("side", F.lit(None))).alias("side"),
        col("first_id", F.lit(None)).cast("long").alias("first_id"),
        col("last_id", F.lit(None)).cast("long").alias("last_id"),
        col("n_fills", F.lit(None)).cast("long").alias("n_fills"),
    )
    return rows.withColumn("n_fills", F.coalesce("n_fills", F.col("last_id") - F.col("first_id") + 1))


def tape_of_events(events: DataFrame, symbols: int = 10) -> DataFrame:
    """The events table read as a tape: a series for each user modulo ``symbols``."""
    k = F.get_json_object("props", "$.k").cast("long")
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("seq")).cast("long")
    rows = events.select(
        (F.col("user_id") % symbols).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (100 + F.col("value") / 100).alias("price"),
        (1 + k).cast("double").alias("qty"),
        F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell").alias("side"),
        k.alias("k"),
    )
    rows = rows.withColumn("notional", F.col("price") * F.col("qty")).withColumn("rn", rn)
    first = F.when(F.col("k") % 4 != 0, 4 * F.col("rn")).otherwise(4 * F.col("rn") + 1)
    return rows.select("symbol", "ts", "seq", "price", "qty", "notional", "side", first.alias("first_id"), (4 * F.col("rn") + 3).alias("last_id"), (1 + F.col("k") % 3).alias("n_fills"))


def book_of_embeddings(embeddings: DataFrame, levels: int = 5) -> DataFrame:
    """A deterministic depth book: sizes from the vector, prices a cent apart around 100."""
    side = lambda sign, shift: F.array(
        *[F.struct((F.lit(100.0) + sign * 0.01 * (i + 1)).alias("price"), F.abs(F.element_at("embedding", i + 1 + shift)).cast("double").alias("size")) for i in range(levels)]
    )
    return embeddings.select(F.lit(0).alias("symbol"), F.timestamp_seconds("vec_id").alias("ts"), F.col("vec_id").alias("seq"), side(-1, 0).alias("bids"), side(1, levels).alias("asks"))


def book_of_columns(book: DataFrame, levels: int, first: int = 0) -> DataFrame:
    """Wide columns bid_<i>_price .. ask_<i>_size, numbered from ``first``, as arrays of (price, size)."""
    side = lambda name: F.array(*[F.struct(F.col(f"{name}_{i}_price").alias("price"), F.col(f"{name}_{i}_size").alias("size")) for i in range(first, first + levels)])
    drop = [f"{s}_{i}_{f}" for s in ("bid", "ask") for i in range(first, first + levels) for f in ("price", "size")]
    return book.withColumn("bids", side("bid")).withColumn("asks", side("ask")).drop(*drop)
