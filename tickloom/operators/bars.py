"""Bars, taker orders and within-bar statistics.

Time, count and carried volume bars are one groupBy over a bar id. Row numbers, orders and
volume bars that restart at zero go chunk by chunk with a carry (``chunks``), so a long
symbol is many tasks; the aggregation stays built in. first and last follow (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import chunks
from tickloom.windows import Series, div

EPS = 1e-15


def _is(side: str, x: Column) -> Column:
    return F.when(F.col("side") == side, x)


def _of(side: str, x: Column) -> Column:
    """Sum of x over a side, 0 without any."""
    return F.coalesce(F.sum(_is(side, x)), F.lit(0.0))


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts)) / 1e6


def time_bin(ts: Column, sec: int) -> Column:
    """Start of the bin, in epoch seconds."""
    return (F.floor(F.unix_micros(ts) / (sec * 1_000_000)) * sec).cast("long")


def ohlcv() -> list[Column]:
    at = F.struct("ts", "seq")
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("n_trades"),
        _of("buy", F.col("qty")).alias("buy_volume"),
        (F.sum("qty") - _of("buy", F.col("qty"))).alias("sell_volume"),
    ]


def _event_bars(rows: DataFrame, aggs: list[Column]) -> DataFrame:
    span = F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, F.lit(0.001))
    return rows.groupBy("symbol", "bar_id").agg(F.min("ts").alias("ts"), *aggs, span.alias("bar_duration_sec"))


def time_bars(tape: DataFrame, sec: int) -> DataFrame:
    """Bars by bin; bins without a trade have none."""
    return tape.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(*ohlcv())


def with_count_id(tape: DataFrame, n: int) -> DataFrame:
    """Add bar_id: n trades each."""
    rows = chunks.numbered(tape, "bar_id", chunks.by_time())
    return rows.withColumn("bar_id", F.floor(F.col("bar_id") / n).cast("long"))


def count_bars(tape: DataFrame, n: int) -> DataFrame:
    """Bars of n trades; the last may be partial."""
    return _event_bars(with_count_id(tape, n), ohlcv())


def volume_bar_ids(tape: DataFrame, volume: float, carry: bool = False, size: str = "qty") -> DataFrame:
    """Add bar_id. A bar closes with the trade that reaches volume; what it has too much is dropped, or carried on."""
    if not carry:
        return chunks.volume_ids(tape, volume, size)
    before = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return tape.withColumn("bar_id", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0.0)) / volume).cast("long"))


def volume_bars(tape: DataFrame, volume: float, carry: bool = False) -> DataFrame:
    return _event_bars(volume_bar_ids(tape, volume, carry), ohlcv())


def merge_trades(tape: DataFrame, gap_ms: int = 100) -> DataFrame:
    """One row for each order that swept several prices.

    A row continues the one before if it has the same side, its ids follow without a
    gap, less than gap_ms passed (whole milliseconds), and its price is no better.
    """

    def goes_on(before: chunks.Field, now: chunks.Field) -> Column:
        gap = F.floor((F.unix_micros(now("ts")) - F.unix_micros(before("ts"))) / 1000)
        worse = F.when(now("side") == "buy", now("price") >= before("price")).otherwise(now("price") <= before("price"))
        return (now("side") == before("side")) & (now("first_id") == before("last_id") + 1) & (gap < gap_ms) & worse

    rows = chunks.run_ids(tape, "grp", goes_on, ["ts", "side", "price", "first_id", "last_id"], chunks.by_time())
    at = F.struct("ts", "seq")
    out = rows.groupBy("symbol", "grp").agg(
        F.min("ts").alias("ts"),
        F.min("seq").alias("seq"),
        F.sum("qty").alias("qty"),
        F.first("side").alias("side"),
        F.sum("notional").alias("notional"),
        F.sum("n_fills").alias("n_fills"),
        F.count("*").alias("n_raw_trades"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        (F.max("price") - F.min("price")).alias("price_range"),
    )
    return out.withColumn("price", F.col("notional") / (F.col("qty") + EPS)).drop("grp")


def taker_orders(tape: DataFrame) -> DataFrame:
    """Orders as runs of fills with one side and no gap in ids, with their metrics."""
    goes_on = lambda before, now: (now("side") == before("side")) & (now("first_id") == before("last_id") + 1)
    rows = chunks.run_ids(tape, "taker_id", goes_on, ["side", "first_id", "last_id"], chunks.by_id(), order=("seq",))
    at = "seq"
    out = rows.groupBy("symbol", "taker_id").agg(
        F.count("*").alias("levels_swept"),
        F.sum("qty").alias("total_volume"),
        F.sum("notional").alias("total_cost"),
        F.sum("n_fills").alias("total_fills"),
        F.avg("n_fills").alias("fills_per_level_mean"),
        F.coalesce(F.stddev_samp("n_fills"), F.lit(0.0)).alias("fills_per_level_std"),
        F.min("ts").alias("ts"),
        F.first("side").alias("side"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000.0).alias("duration_ms"),
        F.min_by("qty", at).alias("_v0"),
        F.max_by("qty", at).alias("_v1"),
    )
    impact = F.col("last_price") - F.col("first_price")
    return (
        out.withColumn("vwap", div(F.col("total_cost"), F.col("total_volume")))
        .withColumn("price_impact", impact)
        .withColumn("price_impact_pct", div(impact, F.col("first_price")) * 100)
        .withColumn("impact_per_volume", F.abs(impact) / (F.col("total_volume") + 1e-10))
        .withColumn("impact_per_level", F.abs(impact) / F.col("levels_swept"))
        .withColumn("volume_taper", F.col("_v1") / (F.col("_v0") + 1e-10))
        .drop("_v0", "_v1")
    )


def _log(x: Column) -> Column:
    """Logarithm of x, at least EPS; NULL stays."""
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(EPS))))


def _slope(y: Column, x: Column, side: str) -> Column:
    """Least-squares slope over a side; 0 with fewer than 3 rows or hardly any variance."""
    a, b = _is(side, y), _is(side, x)
    good = (F.count(b) >= 3) & (F.var_pop(b) >= EPS)
    return F.when(good, F.coalesce(div(F.covar_pop(a, b), F.var_pop(b)), F.lit(0.0))).otherwise(0.0)


def _skew(x: Column, side: str) -> Column:
    """Bias-corrected skewness over a side; 0 with fewer than 3 rows."""
    v = _is(side, x)
    n = F.count(v).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).otherwise(0.0)


def merged_aggs() -> list[Column]:
    """Aggregates of a bar of merged orders."""
    price, first, qty = F.col("price"), F.col("first_price"), F.col("qty")
    log_qty, multi = F.log(F.greatest(qty, F.lit(EPS))), F.col("n_raw_trades") > 1
    out = [*ohlcv(), F.sum("notional").alias("value")]
    dist = {"buy": price - first, "sell": first - price}
    for side in ("buy", "sell"):
        m = lambda x: F.when((F.col("side") == side) & multi, x)
        single = F.when((F.col("side") == side) & ~multi, qty)
        out += [
            F.count(_is(side, qty)).alias(f"{side}_count"),
            _of(side, dist[side]).alias(f"{side}_vwap_dist_sum"),
            F.count(m(qty)).alias(f"{side}_mf_count"),
            F.coalesce(F.sum(m(qty)), F.lit(0.0)).alias(f"{side}_mf_volume"),
            F.coalesce(F.sum(m(F.col("notional") - first * qty)), F.lit(0.0)).alias(f"{side}_off_top_cost"),
            F.coalesce(_log(F.median(m(qty))) - _log(F.median(single)), F.lit(0.0)).alias(f"{side}_mf_log_median_ratio"),
            _slope(dist[side], log_qty, side).alias(f"{side}_vwap_dist_beta"),
            _slope(F.col("price_range"), log_qty, side).alias(f"{side}_price_range_beta"),
            _skew(qty, side).alias(f"{side}_volume_skew"),
        ]
    out.append(F.sum((price - first) * qty).alias("weighted_vwap_dist"))
    return out


def merged_time_bars(merged: DataFrame, sec: int) -> DataFrame:
    return merged.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(*merged_aggs())


def merged_count_bars(merged: DataFrame, n: int) -> DataFrame:
    return _event_bars(with_count_id(merged, n), merged_aggs())


def merged_volume_bars(merged: DataFrame, volume: float, carry: bool = False) -> DataFrame:
    return _event_bars(volume_bar_ids(merged, volume, carry), merged_aggs())


def build_bars(tape: DataFrame, source: str = "raw", mode: str = "time", size: float = 60, gap_ms: int = 100) -> DataFrame:
    """Bars by source (raw, merged) and mode (time in seconds, count, volume)."""
    makers = {
        ("raw", "time"): time_bars,
        ("raw", "count"): count_bars,
        ("raw", "volume"): volume_bars,
        ("merged", "time"): merged_time_bars,
        ("merged", "count"): merged_count_bars,
        ("merged", "volume"): merged_volume_bars,
    }
    if (source, mode) not in makers or size <= 0:
        raise ValueError(f"no bars of {source}, {mode}, {size}")
    rows = merge_trades(tape, gap_ms) if source == "merged" else tape
    return makers[source, mode](rows, size if mode == "volume" else int(size))


def average_bar_seconds(bars: DataFrame) -> DataFrame:
    """Median bar duration of each symbol; without durations the median step between bars, 60 if there is none."""
    if "bar_duration_sec" in bars.columns:
        return bars.groupBy("symbol").agg(F.median("bar_duration_sec").alias("seconds"))
    step = F.col("bar") - F.lag("bar").over(Window.partitionBy("symbol").orderBy("bar"))
    return bars.withColumn("_d", step).groupBy("symbol").agg(F.coalesce(F.median("_d"), F.lit(60.0)).alias("seconds"))


def volume_threshold(tape: DataFrame, n: int, scales: list[float]) -> DataFrame:
    """Volume of bars that hold about n trades: the median volume of count bars, times each scale."""
    mid = count_bars(tape, n).groupBy("symbol").agg(F.median("volume").alias("m"))
    return mid.select("symbol", F.explode(F.array(*map(F.lit, scales))).alias("scale"), "m").select("symbol", "scale", (F.col("m") * F.col("scale")).alias("volume_per_bar"))


def compare_bars(kinds: dict[str, DataFrame]) -> DataFrame:
    """For each kind of bars: number, median duration, deviation and mean size of the return."""
    from functools import reduce

    rows = []
    for kind, bars in kinds.items():
        order = "bar" if "bar" in bars.columns else "bar_id"
        r = div(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy(order))) - 1
        span = F.col("bar_duration_sec") if "bar_duration_sec" in bars.columns else F.lit(None).cast("double")
        rows.append(bars.withColumn("_r", r).groupBy("symbol").agg(F.lit(kind).alias("kind"), F.count("*").alias("n_bars"), F.median(span).alias("median_seconds"), F.stddev_samp("_r").alias("std"), F.avg(F.abs("_r")).alias("mean_abs")))
    return reduce(DataFrame.unionByName, rows)


def tick_stats(tape: DataFrame, sec: int) -> DataFrame:
    """Statistics of the trades of each bin: sizes, prices, sides and large trades."""
    tape = tape.withColumn("bar", time_bin(F.col("ts"), sec))
    w = Window.partitionBy("symbol", "bar")
    rows = tape.withColumn("large", F.col("qty") > 2 * F.avg("qty").over(w))
    buy, sell = F.avg(_is("buy", F.col("qty"))), F.avg(_is("sell", F.col("qty")))
    close, vwap = F.max_by("price", F.struct("ts", "seq")), div(F.sum("notional"), F.sum("qty"))
    nil = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.groupBy("symbol", "bar").agg(
        F.countDistinct("price").alias("n_prices"),
        F.max("qty").alias("max_trade"),
        F.avg("qty").alias("mean_trade"),
        nil(div(F.stddev_samp("qty"), F.avg("qty"))).alias("size_cv"),
        (div(close - vwap, vwap) * 1e4).alias("vwap_dev_bps"),
        nil(buy).alias("buy_avg_size"),
        nil(sell).alias("sell_avg_size"),
        nil(div(nil(buy) - nil(sell), nil(buy) + nil(sell))).alias("size_imbalance"),
        F.avg(F.col("large").cast("double")).alias("large_trade_pct"),
        ((F.max("price") - F.min("price")) / F.count("*")).alias("range_per_trade"),
        F.count("*").alias("n_trades"),
    )


def fill_size(tape: DataFrame, sec: int) -> DataFrame:
    """Mean quantity of a fill in each bin."""
    return tape.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(F.avg(F.col("qty") / F.greatest("n_fills", F.lit(1))).alias("avg_fill_size"))


def level_profile(tape: DataFrame, sec: int, levels: int = 5) -> DataFrame:
    """Concentration of volume over equal price levels of each bin."""
    tape = tape.withColumn("bar", time_bin(F.col("ts"), sec))
    w = Window.partitionBy("symbol", "bar")
    lo, hi = F.min("price").over(w), F.max("price").over(w)
    at = F.when(hi - lo < 1e-10, 0).otherwise(F.least(F.lit(levels - 1), F.floor(div(F.col("price") - lo, hi - lo) * levels))).cast("int")
    own = tape.withColumn("level", at).groupBy("symbol", "bar", "level").agg(F.sum("qty").alias("v"), F.avg(F.col("qty") / F.greatest("n_fills", F.lit(1))).alias("fill"))
    own = own.withColumn("share", F.col("v") / F.sum("v").over(w))
    return own.groupBy("symbol", "bar").agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.max("share").alias("top_share"),
        F.max_by("fill", F.struct("v", (-F.col("level")))).alias("top_fill"),
        F.count("*").alias("active_levels"),
    )


def side_runs(tape: DataFrame, sec: int) -> DataFrame:
    """Mean length of runs of one side in each bin."""
    s = Series()
    turn = F.when(F.col("side") == s.lag(F.col("side")), 0).otherwise(1)
    rows = tape.withColumn("turn", turn)
    rows = rows.withColumn("run", F.sum("turn").over(s.u)).withColumn("bar", time_bin(F.col("ts"), sec))
    length = F.count("*").over(Window.partitionBy("symbol", "run"))
    return rows.withColumn("length", length).groupBy("symbol", "bar").agg(F.avg("length").alias("mean_run"))


def intensity(tape: DataFrame, sec: int) -> DataFrame:
    """Trades and fills of each bin and their rates."""
    return tape.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(
        F.count("*").alias("n_trades"),
        F.sum("n_fills").alias("n_fills"),
        F.avg("n_fills").alias("avg_fills"),
        (F.count("*") / sec).alias("trade_rate"),
    )


def vwap_deviation(tape: DataFrame, sec: int) -> DataFrame:
    """VWAP of each bin, the close's distance from it, and its change."""
    bars = tape.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(
        div(F.sum("notional"), F.sum("qty")).alias("vwap"), F.max_by("price", F.struct("ts", "seq")).alias("close")
    )
    w = Window.partitionBy("symbol").orderBy("bar")
    return bars.withColumn("vwap_dev", (F.col("close") - F.col("vwap")) / (F.col("close") + 1e-10) * 100).withColumn("vwap_change", (div(F.col("vwap"), F.lag("vwap").over(w)) - 1) * 100)


def primitives(tape: DataFrame, sec: int) -> DataFrame:
    """The wide table of a bar's primitives, missing values carried forward, then 0."""
    base = tape.groupBy("symbol", time_bin(F.col("ts"), sec).alias("bar")).agg(*ohlcv(), F.sum("n_fills").alias("n_fills"), F.sum("notional").alias("value"), F.max_by("qty", F.struct("price", "seq")).alias("volume_at_high"))
    base = base.join(tick_stats(tape, sec).select("symbol", "bar", "n_prices", "max_trade", "size_cv", "buy_avg_size", "sell_avg_size", "size_imbalance", "large_trade_pct"), ["symbol", "bar"])
    s = Series(order=("bar",))
    c = F.col
    signed = c("buy_volume") - c("sell_volume")
    step = c("close") - s.lag(c("close"))
    spread = c("high") - c("low")
    body = c("close") - c("open")
    base = (
        base.withColumn("return_1", (div(c("close"), s.lag(c("close"))) - 1) * 1e4)
        .withColumn("log_return", F.log(div(c("close"), s.lag(c("close")))))
        .withColumn("price_range", spread)
        .withColumn("signed_volume", signed)
        .withColumn("trade_imbalance", signed / (c("volume") + 1e-10))
        .withColumn("abs_imbalance", F.abs(signed / (c("volume") + 1e-10)))
        .withColumn("buy_volume_pct", c("buy_volume") / (c("volume") + 1e-10))
        .withColumn("avg_trade_size", div(c("volume"), c("n_trades")))
        .withColumn("fills_per_agg", div(c("n_fills"), c("n_trades")))
        .withColumn("price_impact", F.abs(step) / (c("volume") + 1e-10))
        .withColumn("signed_price_impact", step / (signed + F.when(signed >= 0, 1e-10).otherwise(-1e-10)))
        .withColumn("vwap", div(c("value"), c("volume")))
        .withColumn("vwap_deviation", div(c("close") - div(c("value"), c("volume")), div(c("value"), c("volume"))) * 1e4)
        .withColumn("bar_efficiency", F.abs(body) / (spread + 1e-10))
        .withColumn("body_direction", F.signum(body))
        .withColumn("upper_wick_pct", (c("high") - F.greatest("open", "close")) / (spread + 1e-10))
        .withColumn("lower_wick_pct", (F.least("open", "close") - c("low")) / (spread + 1e-10))
        .withColumn("volume_per_range", c("volume") / (spread + 1e-10))
        .withColumn("roll_spread", 2 * F.sqrt(F.greatest(F.lit(0.0), -s.cov(step, s.lag(step), 60, 10))))
        .withColumn("buy_sell_log_ratio", F.log((c("buy_volume") + 1) / (c("sell_volume") + 1)))
        .withColumn("volume_ratio", c("volume") / (s.mean(c("volume"), 20, 1) + 1e-10))
        .withColumn("trade_rate", c("n_trades") / sec)
        .withColumn("parkinson_vol_raw", F.pow(F.log(div(c("high"), c("low"))), 2) / (4 * F.log(F.lit(2.0))))
        .withColumn("efficiency_ratio", F.abs(c("close") - s.lag(c("close"), 20)) / (s.total(F.abs(step), 20, 20) + 1e-10))
        .withColumn("small", (c("volume") <= s.quantile(c("volume"), 0.5, 20, 1)).cast("int"))
    )
    small, large = F.when(c("small") == 1, c("price_impact")), F.when(c("small") == 0, c("price_impact"))
    base = (
        base.withColumn("small_vol_pi_ratio", s.mean(small, 20, 1) / (s.mean(large, 20, 1) + 1e-10))
        .withColumn("small_vol_signed_volume", F.when(c("small") == 1, c("signed_volume")).otherwise(0.0))
        .withColumn("small_vol_return", F.when(c("small") == 1, c("return_1")).otherwise(0.0))
        .withColumn("small_vol_volume", F.when(c("small") == 1, c("volume")).otherwise(0.0))
        .drop("small")
    )
    fixed = ("symbol", "bar")
    return base.select(*fixed, *[F.coalesce(s.ffill(c(x)), F.lit(0.0)).alias(x) for x in base.columns if x not in fixed])
