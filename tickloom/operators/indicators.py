"""Indicators over tapes, taker orders, books and bars, and market regimes.

Each takes a table and returns it with one more column, or a table of bins. Series
order is (ts, seq) for tapes and bar for bars. Two families define some names
differently; those of the second (detectors) end in _d.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import time_bin
from tickloom.operators.rolling import ts_rank
from tickloom.windows import Series, div, grid, trailing

E = 1e-10
T = Series()
BARS = Series(order=("bar",))
c = F.col


def _signed() -> Column:
    return F.when(c("side") == "buy", c("qty")).otherwise(-c("qty"))


def _step(s: Series = T, x: str = "price") -> Column:
    return c(x) - s.lag(c(x))


def _timed(tape: DataFrame) -> DataFrame:
    return tape.withColumn("micros", F.unix_micros("ts"))


# --- price impact ---------------------------------------------------------------------------------


def tick_price_impact(tape: DataFrame, ms: int = 5000) -> DataFrame:
    """Sum of absolute price steps by volume over the last ms."""
    rows = trailing(_timed(tape).withColumn("_d", F.abs(_step())), ms, {"_s": ("sum", c("_d")), "_w": ("sum", c("qty"))})
    return rows.withColumn("tick_price_impact", c("_s") / (c("_w") + E)).drop("_d", "_s", "_w", "micros")


def volume_weighted_impact(tape: DataFrame, ms: int = 10000) -> DataFrame:
    rows = trailing(_timed(tape).withColumn("_d", F.abs(_step()) * c("qty")), ms, {"_s": ("sum", c("_d")), "_w": ("sum", c("qty"))})
    return rows.withColumn("volume_weighted_impact", c("_s") / (c("_w") + E)).drop("_d", "_s", "_w", "micros")


def kyles_lambda(tape: DataFrame, n: int = 100) -> DataFrame:
    rows = tape.withColumn("_d", _step()).withColumn("_q", _signed())
    return rows.withColumn("kyles_lambda", T.cov(c("_d"), c("_q"), n, 20) / (T.mp(20, n, c("_q"), F.var_samp("_q").over(T.r(n))) + E)).drop("_d", "_q")


# --- spreads --------------------------------------------------------------------------------------


def trade_diff_spread(tape: DataFrame, n: int = 100) -> DataFrame:
    rows = tape.withColumn("_d", F.abs(_step()))
    return rows.withColumn("trade_diff_spread", T.quantile(c("_d"), 0.5, n, 10)).drop("_d")


def roll_spread(tape: DataFrame, n: int = 200) -> DataFrame:
    rows = tape.withColumn("_d", _step()).withColumn("_l", F.lag(_step()).over(T.p))
    cov = T.cov(c("_d"), c("_l"), n, 30)
    return rows.withColumn("roll_spread", F.when(cov.isNotNull(), 2 * F.sqrt(F.greatest(F.lit(0.0), -cov)))).drop("_d", "_l")


def effective_spread(tape: DataFrame, ms: int = 5000) -> DataFrame:
    """Distance of the lowest buy from the highest sell of the last ms, each carried forward over the other's trades."""
    buy, sell = F.when(c("side") == "buy", c("price")), F.when(c("side") != "buy", c("price"))
    rows = trailing(_timed(tape), ms, {"_b": ("min", buy), "_s": ("max", sell)})
    rows = rows.withColumn("_b", F.when(c("side") == "buy", c("_b"))).withColumn("_s", F.when(c("side") != "buy", c("_s")))
    return rows.withColumn("effective_spread", F.abs(T.ffill(c("_b")) - T.ffill(c("_s")))).drop("_b", "_s", "micros")


def spread_percentile(rows: DataFrame, column: str, n: int = 500, s: Series = T) -> DataFrame:
    """Average-tie percentile rank of the last value of n."""
    return rows.withColumn("spread_percentile", ts_rank(s, c(column), n, 20) * 100)


# --- order flow -----------------------------------------------------------------------------------


def trade_imbalance(tape: DataFrame, n: int = 100) -> DataFrame:
    """Volume of the last n buys against that of the last n sells."""
    own = Window.partitionBy("symbol", "side").orderBy("ts", "seq").rowsBetween(-(n - 1), 0)
    rows = tape.withColumn("_v", F.when(F.count("qty").over(own) >= 5, F.sum("qty").over(own)))
    b, s = T.ffill(F.when(c("side") == "buy", c("_v"))), T.ffill(F.when(c("side") != "buy", c("_v")))
    return rows.withColumn("trade_imbalance", (b - s) / (b + s + E)).drop("_v")


#: A rational approximation of the normal distribution's tail (Hart, as given by West 2005), highest power first, and where a fraction takes over.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FAR = 7.07106781186547


def normal_cdf(x: Column) -> Column:
    """Distribution of the standard normal, in columns, to 1e-14."""
    t = F.abs(x)
    poly = lambda ks: reduce(lambda acc, k: acc * t + k, ks[1:], F.lit(ks[0]))
    fraction = reduce(lambda acc, k: t + k / acc, (4, 3, 2, 1), t + 0.65)
    near, far = poly(TAIL_TOP) / poly(TAIL_BOTTOM), 1 / fraction / math.sqrt(2 * math.pi)
    tail = F.exp(-t * t / 2) * F.when(t < TAIL_FAR, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def vpin(tape: DataFrame, bucket_volume: float = 1000, buckets: int = 50, sigma: int = 200) -> DataFrame:
    """Bulk-classified imbalance of volume buckets, averaged over the last ones."""
    rows = tape.withColumn("_d", _step()).withColumn("_n", T.index())
    std = F.coalesce(T.std(c("_d"), sigma, sigma), F.stddev_samp("_d").over(T.u))
    rows = rows.withColumn("_z", div(c("_d"), std)).withColumn("_buy", c("qty") * F.coalesce(normal_cdf(c("_z")), F.lit(0.5)))
    rows = rows.withColumn("bucket", F.floor(F.sum("qty").over(T.u) / bucket_volume))
    out = rows.groupBy("symbol", "bucket").agg(F.max("ts").alias("ts"), F.sum("qty").alias("volume"), F.sum("_buy").alias("buy"))
    s = Series(order=("bucket",))
    share = F.abs(2 * c("buy") - c("volume")) / (c("volume") + E)
    return out.withColumn("_i", share).withColumn("vpin", s.mean(c("_i"), buckets, 5)).drop("_i")


def aggressive_flow(tape: DataFrame, ms: int = 5000, imbalance: float = 0.7, ratio: float = 2.0) -> DataFrame:
    """Trades at which the last ms are one-sided and busier than usual."""
    rows = trailing(_timed(tape), ms, {"_q": ("sum", _signed()), "window_volume": ("sum", c("qty"))})
    rows = rows.withColumn("imbalance", c("_q") / (c("window_volume") + E))
    rows = rows.withColumn("volume_ratio", c("window_volume") / (T.mean(c("window_volume"), 100, 20) + E))
    return rows.filter((F.abs("imbalance") >= imbalance) & (c("volume_ratio") >= ratio)).drop("_q", "micros")


def flow_toxicity(tape: DataFrame, n: int = 200) -> DataFrame:
    rows = tape.withColumn("_d", F.abs(_step()))
    return rows.withColumn("flow_toxicity", F.abs(c("price") - T.lag(c("price"), n)) / (T.mean(c("_d"), n) + E)).drop("_d")


# --- taker volume series of bins ------------------------------------------------------------------


def taker_series(tape: DataFrame, sec: int) -> DataFrame:
    """Buy and sell volume of each bin, empty bins 0."""
    rows = tape.withColumn("bar_ts", F.timestamp_seconds(time_bin(c("ts"), sec)))
    agg = rows.groupBy("symbol", "bar_ts").agg(
        F.sum(F.when(c("side") == "buy", c("qty")).otherwise(0.0)).alias("buy"), F.sum(F.when(c("side") != "buy", c("qty")).otherwise(0.0)).alias("sell")
    )
    return grid(agg, sec, ts="bar_ts").fillna(0.0, ["buy", "sell"])


BINS = Series(order=("bar_ts",))


def taker_volume_corr(bins: DataFrame, n: int = 60) -> DataFrame:
    return bins.withColumn("taker_volume_corr", BINS.corr(c("buy"), c("sell"), n, 10))


def taker_volume_autocorr(bins: DataFrame, n: int = 60, lag: int = 1, side: str = "buy") -> DataFrame:
    rows = bins.withColumn("_l", BINS.lag(c(side), lag))
    return rows.withColumn(f"taker_{side}_autocorr", BINS.corr(c(side), c("_l"), n, 10)).drop("_l")


def taker_volume_skewness(bins: DataFrame, n: int = 120) -> DataFrame:
    return bins.withColumn("buy_skew", BINS.skew(c("buy"), n, 20)).withColumn("sell_skew", BINS.skew(c("sell"), n, 20))


def buy_sell_ratio(bins: DataFrame, n: int = 60) -> DataFrame:
    return bins.withColumn("buy_sell_ratio", F.log((BINS.total(c("buy"), n, 5) + E) / (BINS.total(c("sell"), n, 5) + E)))


def large_trade_ratio(tape: DataFrame, sec: int = 5, n: int = 60, q: float = 0.9) -> DataFrame:
    """Share of volume in trades above their rolling quantile, averaged over bins."""
    rows = tape.withColumn("_q", T.quantile(c("qty"), q, 1000, 50))
    rows = rows.withColumn("bar_ts", F.timestamp_seconds(time_bin(c("ts"), sec)))
    agg = rows.groupBy("symbol", "bar_ts").agg((F.sum(F.when(c("qty") >= c("_q"), c("qty")).otherwise(0.0)) / (F.sum("qty") + E)).alias("share"))
    return grid(agg, sec, ts="bar_ts").withColumn("large_trade_ratio", BINS.mean(c("share"), n, 5))


def side_autocorrelation(bins: DataFrame, n: int = 20, lag: int = 1) -> DataFrame:
    rows = bins.withColumn("_b", BINS.lag(c("buy"), lag)).withColumn("_s", BINS.lag(c("sell"), lag))
    return (
        rows.withColumn("buy_autocorr", BINS.corr(c("buy"), c("_b"), n, 5))
        .withColumn("sell_autocorr", BINS.corr(c("sell"), c("_s"), n, 5))
        .withColumn("cross_corr", BINS.corr(c("buy"), c("sell"), n, 5))
        .drop("_b", "_s")
    )


# --- taker orders ---------------------------------------------------------------------------------

#: name -> (aggregate over the orders of a bin, rows of the rolling mean's minimum)
TAKER = {
    "avg_levels_swept": lambda: F.avg("levels_swept"),
    "large_taker_ratio": lambda: F.avg((c("levels_swept") >= 3).cast("double")),
    "taker_imbalance": lambda: (F.sum(F.when(c("side") == "buy", c("total_volume")).otherwise(-c("total_volume")))) / (F.sum("total_volume") + E),
    "impact_efficiency": lambda: F.sum(F.abs("price_impact")) / (F.sum("total_volume") + E),
    "taker_arrival_rate": lambda: F.count("*").cast("double"),
    "iceberg_score": lambda: F.avg((c("fills_per_level_mean") >= 5).cast("double")),
}


def taker_indicator(orders: DataFrame, name: str, sec: int = 5, n: int = 60) -> DataFrame:
    """One of TAKER over bins, averaged over n bins; empty bins count as missing, as 0 for the arrival rate."""
    rows = orders.withColumn("bar_ts", F.timestamp_seconds(time_bin(c("ts"), sec)))
    agg = grid(rows.groupBy("symbol", "bar_ts").agg(TAKER[name]().alias("_v")), sec, ts="bar_ts")
    agg = agg.fillna(0.0, ["_v"]) if name == "taker_arrival_rate" else agg
    return agg.withColumn(name, BINS.mean(c("_v"), n, 5)).drop("_v")


def sweep_depth_autocorr(orders: DataFrame, sec: int = 5, n: int = 60, lag: int = 1) -> DataFrame:
    rows = orders.withColumn("bar_ts", F.timestamp_seconds(time_bin(c("ts"), sec)))
    agg = grid(rows.groupBy("symbol", "bar_ts").agg(F.avg("levels_swept").alias("_v")), sec, ts="bar_ts").fillna(1.0, ["_v"])
    agg = agg.withColumn("_l", BINS.lag(c("_v"), lag))
    return agg.withColumn("sweep_depth_autocorr", BINS.corr(c("_v"), c("_l"), n, 10)).drop("_v", "_l")


def taker_size_skewness(orders: DataFrame, sec: int = 10, n: int = 60) -> DataFrame:
    rows = orders.withColumn("bar_ts", F.timestamp_seconds(time_bin(c("ts"), sec)))
    agg = grid(rows.groupBy("symbol", "bar_ts").agg(F.avg("total_volume").alias("_v")), sec, ts="bar_ts")
    return agg.withColumn("taker_size_skewness", BINS.skew(c("_v"), n, 20)).drop("_v")


# --- depth books ----------------------------------------------------------------------------------


def _total(side: str, n: int, value=lambda x: x["size"]) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda t, x: t + value(x))


def book_primitives(book: DataFrame, levels: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Mid, spread, depth, imbalance, skew and concentration of each snapshot; missing values carried forward, then 0."""
    bid, ask = c("bids")[0], c("asks")[0]
    mid = (bid["price"] + ask["price"]) / 2
    cols = {"mid": mid, "spread": ask["price"] - bid["price"], "spread_bps": div(ask["price"] - bid["price"], mid) * 1e4}
    for n in levels:
        b, a = _total("bids", n), _total("asks", n)
        cols |= {f"bid_depth_{n}": b, f"ask_depth_{n}": a, f"depth_imbalance_{n}": (b - a) / (b + a + E)}
    top = max(levels)
    cols["depth_skew"] = F.log((_total("bids", top) + E) / (_total("asks", top) + E))
    cols["bid_concentration"] = bid["size"] / (_total("bids", top) + E)
    cols["ask_concentration"] = ask["size"] / (_total("asks", top) + E)
    rows = book.select("symbol", "ts", "seq", *[x.alias(k) for k, x in cols.items()])
    return rows.select("symbol", "ts", "seq", *[F.coalesce(T.ffill(c(k)), F.lit(0.0)).alias(k) for k in cols])


def depth_change_rate(book: DataFrame, levels: int = 5, n: int = 10) -> DataFrame:
    rows = book.withColumn("bid_depth", _total("bids", levels)).withColumn("ask_depth", _total("asks", levels))
    for x in ("bid", "ask"):
        rows = rows.withColumn(f"_{x}", div(c(f"{x}_depth"), T.lag(c(f"{x}_depth"))) - 1)
        rows = rows.withColumn(f"{x}_change_mean", T.mean(c(f"_{x}"), n, 1)).withColumn(f"{x}_change_std", T.std(c(f"_{x}"), n, 2)).withColumn(f"{x}_momentum", div(c(f"{x}_depth"), T.lag(c(f"{x}_depth"), n)) - 1)
    return rows.withColumn("change_asymmetry", c("bid_change_mean") - c("ask_change_mean")).drop("_bid", "_ask", "bids", "asks")


def depth_resilience(book: DataFrame, levels: int = 5, shock: int = 3, n: int = 10, drop: float = -0.2) -> DataFrame:
    """How far the depth lost in a shock comes back, averaged over recent shocks."""
    rows = book.withColumn("depth", _total("bids", levels) + _total("asks", levels))
    before = T.lag(c("depth"), shock)
    rows = rows.withColumn("_before", before).withColumn("_change", div(c("depth"), before) - 1)
    rows = rows.withColumn("_low", T.low(c("depth"), shock, 1))
    hit = c("_change") <= drop
    back = (c("depth") - c("_low")) / (c("_before") - c("_low") + E)
    return rows.withColumn("is_shock", hit.cast("int")).withColumn("_r", F.when(hit, back)).withColumn("depth_resilience", T.mean(c("_r"), n, 1)).drop("_before", "_change", "_low", "_r", "bids", "asks")


def level_thickness(book: DataFrame, levels: int = 5) -> DataFrame:
    """Share of the first three levels in the depth of each side."""
    share = lambda s: _total(s, 3) / (_total(s, levels) + E)
    return book.select("symbol", "ts", "seq", share("bids").alias("bid_top3"), share("asks").alias("ask_top3"), (share("bids") - share("asks")).alias("thickness_diff"))


def vwap_pressure(book: DataFrame, levels: int = 5) -> DataFrame:
    mid = (c("bids")[0]["price"] + c("asks")[0]["price"]) / 2
    vw = lambda s: div(_total(s, levels, lambda x: x["price"] * x["size"]), _total(s, levels))
    b, a = (mid - vw("bids")), (vw("asks") - mid)
    return book.select(
        "symbol", "ts", "seq", vw("bids").alias("bid_vwap"), vw("asks").alias("ask_vwap"), b.alias("bid_pressure"), a.alias("ask_pressure"),
        (a - b).alias("pressure_diff"), ((a - b) / (a + b + E)).alias("pressure_ratio"),
    )


def depth_imbalance(book: DataFrame, levels: int = 5) -> DataFrame:
    b, a = _total("bids", levels), _total("asks", levels)
    return book.select("symbol", "ts", "seq", ((b - a) / (b + a + E)).alias("depth_imbalance"))


def depth_slope(book: DataFrame, levels: int = 5) -> DataFrame:
    """Least-squares slope of size by distance from the mid, for each side of each snapshot."""
    mid = (c("bids")[0]["price"] + c("asks")[0]["price"]) / 2

    def slope(side: str) -> Column:
        x = lambda v: F.abs(v["price"] - mid)
        n = F.size(F.slice(side, 1, levels)).cast("double")
        sx, sy = _total(side, levels, x), _total(side, levels)
        sxy, sxx = _total(side, levels, lambda v: x(v) * v["size"]), _total(side, levels, lambda v: x(v) * x(v))
        return div(n * sxy - sx * sy, n * sxx - sx * sx)

    return book.select("symbol", "ts", "seq", slope("bids").alias("bid_slope"), slope("asks").alias("ask_slope"), (slope("bids") - slope("asks")).alias("slope_asymmetry"))


# --- bars -----------------------------------------------------------------------------------------


def returns_momentum(bars: DataFrame, windows: tuple[int, ...] = (3, 5, 10, 20)) -> DataFrame:
    s = BARS
    rows = bars.withColumn("return_1", div(c("close"), s.lag(c("close"))) - 1).withColumn("log_return", F.log(div(c("close"), s.lag(c("close")))))
    for n in windows:
        r = c("return_1")
        mean, std = s.mean(r, n, max(1, n // 2)), s.std(r, n, max(2, n // 2))
        rows = (
            rows.withColumn(f"return_sum_{n}", s.total(r, n, max(1, n // 2)))
            .withColumn(f"return_std_{n}", std)
            .withColumn(f"return_skew_{n}", s.skew(r, n, 3))
            .withColumn(f"return_kurt_{n}", s.kurt(r, n, 4))
            .withColumn(f"return_z_{n}", (r - mean) / (std + E))
        )
    return rows


def bar_structure(bars: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    s, spread, body = BARS, c("high") - c("low"), c("close") - c("open")
    rows = (
        bars.withColumn("bar_range", spread)
        .withColumn("body", body)
        .withColumn("upper_wick", c("high") - F.greatest("open", "close"))
        .withColumn("lower_wick", F.least("open", "close") - c("low"))
        .withColumn("efficiency", F.abs(body) / (spread + E))
        .withColumn("volume_per_range", c("volume") / (spread + E))
        .withColumn("imbalance", (c("buy_volume") - c("sell_volume")) / (c("volume") + E))
    )
    for n in windows:
        rows = rows.withColumn(f"range_mean_{n}", s.mean(c("bar_range"), n, 1)).withColumn(f"efficiency_mean_{n}", s.mean(c("efficiency"), n, 1)).withColumn(f"imbalance_sum_{n}", s.total(c("imbalance"), n, 1))
    return rows


# --- regimes --------------------------------------------------------------------------------------


def _log_return() -> Column:
    return F.log(div(c("close"), BARS.lag(c("close"))))


def realized_volatility(bars: DataFrame, n: int = 60) -> DataFrame:
    return bars.withColumn("_r", _log_return()).withColumn("realized_volatility", BARS.std(c("_r"), n, 10)).drop("_r")


def parkinson_volatility(bars: DataFrame, n: int = 60) -> DataFrame:
    rows = bars.withColumn("_h", F.pow(F.log(div(c("high"), c("low"))), 2))
    return rows.withColumn("parkinson_volatility", F.sqrt(BARS.mean(c("_h"), n, 10) / (4 * math.log(2)))).drop("_h")


def quantile_regime(rows: DataFrame, column: str, n: int = 500, low: float = 0.25, high: float = 0.75, name: str = "regime", labels: tuple[str, str, str] = ("low", "normal", "high")) -> DataFrame:
    """low, normal or high against rolling quantiles; normal until 30 values are there."""
    q = lambda p: BARS.quantile(c(column), p, n, 30)
    return rows.withColumn(name, F.when(c(column) < q(low), labels[0]).when(c(column) > q(high), labels[2]).otherwise(labels[1]))


def efficiency_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    rows = bars.withColumn("_d", F.abs(c("close") - BARS.lag(c("close"))))
    return rows.withColumn("efficiency_ratio", F.abs(c("close") - BARS.lag(c("close"), n)) / (BARS.total(c("_d"), n) + E)).drop("_d")


def trend_regime(rows: DataFrame, adx: str, hurst: str | None = None, trend: float = 25, flat: float = 20) -> DataFrame:
    """trending, ranging or neutral by strength, then by the Hurst exponent where there is one."""
    out = F.when(c(adx) > trend, "trending").when(c(adx) < flat, "ranging").otherwise("neutral")
    if hurst:
        out = F.when((c(hurst) > 0.55) & (c(adx) > flat), "trending").when((c(hurst) < 0.45) & (c(adx) < trend), "ranging").otherwise(out)
    return rows.withColumn("trend_regime", out)


def amihud(bars: DataFrame, n: int = 20) -> DataFrame:
    rows = bars.withColumn("_i", F.abs(div(c("close"), BARS.lag(c("close"))) - 1) / (c("volume") * c("close") + E))
    return rows.withColumn("amihud", BARS.mean(c("_i"), n, 5)).drop("_i")


def turnover_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("turnover_ratio", c("volume") / (BARS.mean(c("volume"), n, 5) + E))


# --- detectors ------------------------------------------------------------------------------------


def bucket_impact_d(tape: DataFrame, ms: int) -> DataFrame:
    """Price change in percent of each bucket of ms with two trades or more."""
    rows = tape.withColumn("bucket", F.floor(F.unix_millis("ts") / ms))
    at = F.struct("ts", "seq")
    out = rows.groupBy("symbol", "bucket").agg(
        F.min_by("price", at).alias("first"), F.max_by("price", at).alias("last"), F.max("price").alias("top"), F.min("price").alias("bottom"),
        F.sum("qty").alias("volume"), F.sum(_signed()).alias("net"), F.count("*").alias("n_trades"),
    )
    out = out.filter("n_trades >= 2").withColumn("impact_pct", div(c("last") - c("first"), c("first")) * 100)
    return out.withColumn("direction", F.when(c("net") > 0, "buy").otherwise("sell"))


def large_impacts_d(tape: DataFrame, ms: int, pct: float, ratio: float, n: int = 20) -> DataFrame:
    s = Series(order=("bucket",))
    rows = bucket_impact_d(tape, ms).withColumn("volume_ratio", c("volume") / (s.mean(c("volume"), n, 1) + E))
    return rows.filter((F.abs("impact_pct") >= pct) & (c("volume_ratio") >= ratio))


def volume_impact_d(tape: DataFrame, n: int) -> DataFrame:
    rows = tape.withColumn("_d", F.abs(_step()))
    return rows.withColumn("volume_impact", div(T.total(c("_d"), n, 1), T.total(c("qty"), n, 1))).drop("_d")


def kyle_lambda_d(tape: DataFrame, n: int) -> DataFrame:
    rows = tape.withColumn("_d", _step()).withColumn("_q", F.when(c("_d").isNotNull(), _signed()))
    var = F.var_samp("_q").over(T.r(n))
    return rows.withColumn("kyle_lambda", F.when(var >= E, T.cov(c("_d"), c("_q"), n, 2) / var)).drop("_d", "_q")


def spread_d(tape: DataFrame, method: str, n: int) -> DataFrame:
    """Estimate of the spread: trade_diff, roll or tick_range."""
    w = T.r(n)
    if method == "trade_diff":
        x = F.abs(F.avg(F.when(c("side") == "buy", c("price"))).over(w) - F.avg(F.when(c("side") != "buy", c("price"))).over(w))
        return tape.withColumn("spread", x)
    if method == "roll":
        rows = tape.withColumn("_d", _step()).withColumn("_l", F.lag(_step()).over(T.p))
        cov = T.cov(c("_d"), c("_l"), n, 2)
        return rows.withColumn("spread", F.when(cov < 0, 2 * F.sqrt(-cov))).drop("_d", "_l")
    if method == "tick_range":
        return tape.withColumn("spread", F.max("price").over(w) - F.min("price").over(w))
    raise ValueError(f"no method {method}")


def spread_percentile_d(rows: DataFrame, column: str = "spread", n: int = 100) -> DataFrame:
    """Share of the window strictly below the current value, in percent; values that agree to 9 digits count as equal."""
    a = F.collect_list(F.round(column, 9)).over(T.r(n))
    return rows.withColumn("spread_pct", F.when(F.size(a) >= 10, 100.0 * F.size(F.filter(a, lambda v: v < F.round(column, 9))) / F.size(a)))


def spread_expansion_d(tape: DataFrame, n: int = 100, threshold: float = 90) -> DataFrame:
    rows = spread_percentile_d(spread_d(tape, "trade_diff", n), "spread", n)
    return rows.withColumn("expanded", F.coalesce(c("spread_pct") >= threshold, F.lit(False)))


def imbalance_d(tape: DataFrame, n: int) -> DataFrame:
    w = T.r(n)
    return tape.withColumn("imbalance", div(F.sum(_signed()).over(w), F.sum("qty").over(w)))


def vpin_d(tape: DataFrame, bucket: float, n: int) -> DataFrame:
    """Imbalance of volume buckets by the share of buys in trades, over n buckets, looked up for each trade."""
    rows = tape.withColumn("bucket", F.floor(F.sum("qty").over(T.u) / bucket))
    b = rows.groupBy("symbol", "bucket").agg(F.sum("qty").alias("v"), F.avg((c("side") == "buy").cast("double")).alias("share"))
    s = Series(order=("bucket",))
    b = b.withColumn("_i", F.abs(2 * c("share") - 1) * c("v")).withColumn("vpin", F.sum("_i").over(s.r(n)) / (F.count("_i").over(s.r(n)) * bucket))
    return rows.join(b.select("symbol", "bucket", "vpin"), ["symbol", "bucket"])


def aggressive_flow_d(tape: DataFrame, ms: int, imbalance: float, ratio: float, n: int = 20) -> DataFrame:
    s = Series(order=("bucket",))
    rows = tape.withColumn("bucket", F.floor(F.unix_millis("ts") / ms)).groupBy("symbol", "bucket").agg(F.sum(_signed()).alias("net"), F.sum("qty").alias("volume"), F.count("*").alias("n_trades"))
    rows = rows.withColumn("imbalance", div(c("net"), c("volume"))).withColumn("volume_ratio", c("volume") / (s.mean(c("volume"), n, 1) + E))
    return rows.filter((F.abs("imbalance") >= imbalance) & (c("volume_ratio") >= ratio))


def flow_toxicity_d(tape: DataFrame, n: int) -> DataFrame:
    w = T.r(n)
    sign = F.when(c("side") == "buy", 1.0).otherwise(-1.0)
    return tape.withColumn("flow_toxicity", F.abs(F.sum(sign).over(w)) / F.count(F.lit(1)).over(w))


def liquidity_shocks(tape: DataFrame, ms: int, pct: float, spread_pct: float, imbalance: float, n: int = 100) -> DataFrame:
    """Buckets with a large move while the spread is wide and the flow one-sided: as of the bucket's end."""
    from tickloom.operators.joins import asof

    state = imbalance_d(spread_percentile_d(spread_d(tape, "trade_diff", n), "spread", n), n)
    state = state.withColumn("at", F.unix_millis("ts").cast("long")).groupBy("symbol", "at").agg(F.max_by("spread_pct", "seq").alias("spread_pct"), F.max_by("imbalance", "seq").alias("imbalance"))
    hits = bucket_impact_d(tape, ms).withColumn("at", ((c("bucket") + 1) * ms - 1).cast("long"))
    found = asof(hits, state, "at", ["symbol"], ["spread_pct", "imbalance"])
    # The price to hold is the bucket's extreme on the side of the move.
    found = found.withColumn("peak", F.when(c("impact_pct") > 0, c("top")).otherwise(c("bottom")))
    return found.filter((F.abs("impact_pct") >= pct) & (c("spread_pct") >= spread_pct) & (F.abs("imbalance") >= imbalance))


def refills(shocks: DataFrame, tape: DataFrame, horizon_ms: int = 30_000, hold: float = 0.5) -> DataFrame:
    """Whether the price holds after each shock: it does not pass the peak in the direction of the move by more than hold percent."""
    from tickloom.operators.joins import interval

    rows = tape.select("symbol", F.unix_millis("ts").alias("ms"), "price", "qty")
    hit = interval(shocks, rows, ["symbol"], "ms", c("at"), c("at") + horizon_ms, float(horizon_ms), closed="right")
    beyond = F.when(c("impact_pct") > 0, div(c("price") - c("peak"), c("peak")) * 100).otherwise(div(c("peak") - c("price"), c("peak")) * 100)
    seen = hit.groupBy("symbol", "bucket").agg(F.max(beyond).alias("beyond_pct"), F.max_by("price", "ms").alias("end_price"), F.sum("qty").alias("volume_after"))
    out = shocks.join(seen, ["symbol", "bucket"], "left")
    back = F.when(c("impact_pct") > 0, c("end_price") < c("peak")).otherwise(c("end_price") > c("peak"))
    return out.withColumn("held", F.coalesce(c("beyond_pct") <= hold, F.lit(False))).withColumn("signal", F.when(c("held") & F.coalesce(back, F.lit(False)), -F.signum("impact_pct")).otherwise(0.0).cast("int"))
