"""Rule factors over bars, signals of a factor, and position sizes: columns throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.rolling import ts_rank
from tickloom.operators.smoothers import delta_threshold, ewm, ewm_scan, recur
from tickloom.windows import Series, div

S = Series(order=("bar",))
c = F.col
E = 1e-10


def imbalance(b: Column, s: Column) -> Column:
    return (b - s) / (F.abs(b) + F.abs(s) + E)


def raw_imbalance(b: Column, s: Column) -> Column:
    """Of one bar, with the signed sum below."""
    return div(b - s, b + s)


def _w(n: int, least: int = 5) -> int:
    return max(least, n // 4)


def _both(prefix: str, n: int) -> Column:
    return imbalance(S.mean(c(f"buy_{prefix}"), n, max(3, n // 4)), S.mean(c(f"sell_{prefix}"), n, max(3, n // 4)))


#: Rule factors of raw bars: name -> builder by window.
RAW: dict[str, Callable[[int], Column]] = {
    "trade_imbalance": lambda n: (c("buy_volume") - c("sell_volume")) / (c("volume") + E),
    "buy_sell_ratio": lambda n: F.log((c("buy_volume") + E) / (c("sell_volume") + E)),
    "volume_zscore": lambda n: (c("volume") - S.mean(c("volume"), n, _w(n))) / (S.std(c("volume"), n, _w(n)) + E),
    "kyles_lambda": lambda n: S.cov(c("close") - S.lag(c("close")), c("buy_volume") - c("sell_volume"), n, _w(n, 10)) / (F.var_samp(c("buy_volume") - c("sell_volume")).over(S.r(n)) + E),
    "taker_vol_corr": lambda n: S.corr(c("buy_volume"), c("sell_volume"), n, _w(n, 10)),
    "volume_acceleration": lambda n: (c("volume") - S.lag(c("volume"), 5)) - (S.lag(c("volume"), 20) - S.lag(c("volume"), 25)),
    "price_impact": lambda n: F.abs(c("close") - c("open")) / (c("volume") + E),
    "taker_vol_skew": lambda n: S.skew(c("buy_volume"), n, _w(n, 10)) - S.skew(c("sell_volume"), n, _w(n, 10)),
}
#: Rule factors of merged bars.
MERGED: dict[str, Callable[[int], Column]] = {
    "vwap_dist_sum_imbalance": lambda n: _both("vwap_dist_sum", n),
    "vwap_dist_sum_delta_imbalance": lambda n: imbalance(c("buy_vwap_dist_sum") - S.lag(c("buy_vwap_dist_sum")), c("sell_vwap_dist_sum") - S.lag(c("sell_vwap_dist_sum"))),
    "multi_fill_count_imbalance": lambda n: _both("mf_count", n),
    "multi_fill_volume_imbalance": lambda n: _both("mf_volume", n),
    "mf_vol_median_ratio_imbalance": lambda n: _both("mf_log_median_ratio", n),
    "off_top_volume_imbalance": lambda n: _both("off_top_cost", n),
    "off_top_volume_delta_imbalance": lambda n: imbalance(c("buy_off_top_cost") - S.lag(c("buy_off_top_cost")), c("sell_off_top_cost") - S.lag(c("sell_off_top_cost"))),
    "volume_asymmetry": lambda n: S.mean(imbalance(c("buy_volume"), c("sell_volume")), n, max(3, n // 4)) - S.mean(imbalance(c("buy_volume"), c("sell_volume")), 4 * n, max(3, n // 4)),
    "volume_autocorr_imbalance": lambda n: imbalance(S.corr(c("buy_volume"), S.lag(c("buy_volume")), n, max(3, n // 4)), S.corr(c("sell_volume"), S.lag(c("sell_volume")), n, max(3, n // 4))),
    "vwap_dist_reg_imbalance": lambda n: _both("vwap_dist_beta", n),
    "price_range_reg_imbalance": lambda n: _both("price_range_beta", n),
    "volume_skew_imbalance": lambda n: _both("volume_skew", n),
    "weighted_vwap_dist_sum": lambda n: S.mean(c("weighted_vwap_dist"), n, max(3, n // 4)),
}


def factor(bars: DataFrame, name: str, n: int = 60) -> DataFrame:
    """bars with a column factor; ValueError for an unknown name."""
    made = RAW.get(name) or MERGED.get(name)
    if made is None:
        raise ValueError(f"no factor {name}")
    return bars.withColumn("factor", made(n))


def _sides(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


#: Signals of a column x: name -> builder by parameters; 1, -1 or 0 for each bar.
SIGNALS: dict[str, Callable[..., Column]] = {
    "raw": lambda x, dead=0.0: _sides(x > dead, x < -dead),
    "raw_reversal": lambda x, dead=0.0: _sides(x < -dead, x > dead),
    "zscore": lambda x, n=60, up=1.0, down=1.0: (lambda z: _sides(z > up, z < -down))((x - S.mean(x, n, _w(n))) / (S.std(x, n, _w(n)) + E)),
    "quantile": lambda x, n=60, low=0.2, high=0.8: _sides(x > S.quantile(x, high, n, _w(n, 10)), x < S.quantile(x, low, n, _w(n, 10))),
    "ma_cross": lambda x, fast=5, slow=20: (lambda a, b: _sides(a > b, a < b))(S.mean(x, fast, 1), S.mean(x, slow, 1)),
    "bollinger": lambda x, n=20, k=2.0: (lambda m, s: _sides(x < m - k * s, x > m + k * s))(S.mean(x, n, _w(n)), S.std(x, n, _w(n))),
    "rank": lambda x, n=60, low=0.2, high=0.8: (lambda r: _sides(r > high, r < low))(ts_rank(S, x, n, _w(n, 10))),
    "delta": lambda x, d=1, least=0.0: _sides(x - S.lag(x, d) > least, x - S.lag(x, d) < -least),
    "threshold": lambda x, up=0.5, down=-0.5: _sides(x > up, x < down),
}


def signal(bars: DataFrame, name: str, column: str = "factor", **params) -> DataFrame:
    """bars with a column signal (int, 0 where the factor is missing)."""
    if name == "dual_ma_band":
        return dual_ma_band(bars, column, **params)
    return bars.withColumn("signal", F.coalesce(SIGNALS[name](c(column), **params), F.lit(0)).cast("int"))


def dual_ma_band(bars: DataFrame, column: str, fast: int = 10, slow: int = 40, k: float = 1.0, n: int = 60) -> DataFrame:
    """Spread of two exponential means against its rolling deviation."""
    for name, span in (("_fast", fast), ("_slow", slow)):
        bars = recur(bars, lambda x, span: {name_: ewm(x, 2 / (span + 1), adjust=True, least=span)["y"] for name_ in ("_fast", "_slow")}, [column], [name], span=span)
    spread = c("_fast") - c("_slow")
    bars = bars.withColumn("_spread", spread)
    band = S.std(c("_spread"), n, _w(n)) * k
    return bars.withColumn("signal", F.coalesce(_sides(c("_spread") > band, c("_spread") < -band), F.lit(0)).cast("int")).drop("_fast", "_slow", "_spread")


def flip_entries(bars: DataFrame, column: str, n: int = 100, k: float = 0.0, method: str = "mad", reverse: bool = False) -> DataFrame:
    """Position of the variant family: the sign of the smoothed factor's delta, zeros carried forward;
    a flip enters if the delta reaches its threshold; held until the next entry."""
    d = c(column) - S.lag(c(column))
    bars = bars.withColumn("_d", d)
    bars = delta_threshold(bars, "_d", n, k, method)
    bars = bars.withColumn("_s", S.ffill(F.when(c("_d") != 0, F.signum("_d"))))
    flip = (c("_s") != S.lag(c("_s"))) & (F.abs("_d") >= F.coalesce("threshold", F.lit(0.0)))
    side = c("_s") if not reverse else -c("_s")
    bars = bars.withColumn("_e", F.when(flip, side))
    return bars.withColumn("position", F.coalesce(S.ffill(c("_e")), F.lit(0.0))).drop("_d", "_s", "_e", "threshold")


def volume_scaled_mad(bars: DataFrame, column: str, out: str, n: int, k: float, volume: str | None, fill_ahead: bool) -> DataFrame:
    """bars with k times the median distance of a column from its rolling median, scaled by the root of how busy the last 10 bars are; carried forward.

    ``fill_ahead`` gives the rows before the first threshold that threshold, which looks ahead.
    """
    bars = bars.withColumn("_m", S.quantile(c(column), 0.5, n)).withColumn("_a", F.abs(c(column) - c("_m")))
    level = S.quantile(c("_a"), 0.5, n) * k
    if volume is not None:
        bars = bars.withColumn("_local", S.mean(c(volume), 10))
        level = level * F.sqrt(c("_local") / (S.mean(c("_local"), n) + E))
    bars = bars.withColumn(out, level).withColumn(out, S.ffill(c(out)))
    if fill_ahead:
        bars = bars.withColumn(out, S.bfill(c(out)))
    return bars.drop("_m", "_a", "_local")


def two_sided_entries(
    bars: DataFrame, buy: str, sell: str, up: tuple[int, int, float] = (8, 10, 1.5), down: tuple[int, int, float] = (10, 10, 1.0), n: int = 100, volume: str | None = "volume", fill_ahead: bool = False
) -> DataFrame:
    """bars with position: long and short entries each by an imbalance, window, span and threshold of their own.

    A side (window, span, k) has the imbalance of the mean buy and sell columns over its
    window, smoothed with its span; it enters when the change of that turns its way and
    passes k of its ``volume_scaled_mad``. The position is the last entry's, 0 before the first.
    """
    names = bars.columns
    for side, (window, span, k) in (("up", up), ("down", down)):
        a, b = S.mean(c(buy), window), S.mean(c(sell), window)
        bars = bars.withColumn("_f", (a - b) / (F.abs(a) + F.abs(b) + E))
        bars = ewm_scan(bars, "_f", "_y", 2 / (span + 1), adjust=True).withColumn(f"_{side}", c("_y") - S.lag(c("_y"))).drop("_f", "_y")
        bars = volume_scaled_mad(bars, f"_{side}", f"_{side}_t", n, k, volume, fill_ahead)
        bars = bars.withColumn(f"_{side}_s", S.ffill(F.when(c(f"_{side}") != 0, F.signum(f"_{side}"))))
        way = 1 if side == "up" else -1
        bars = bars.withColumn(f"_{side}_e", (S.lag(c(f"_{side}_s")) == -way) & (c(f"_{side}_s") == way) & (F.abs(f"_{side}") > c(f"_{side}_t")))
    entry = F.when(c("_down_e"), -1).when(c("_up_e"), 1)  # a bar that enters both ways is short
    return bars.withColumn("_entry", entry).withColumn("position", F.coalesce(S.ffill(c("_entry")), F.lit(0))).select(*[x for x in names if x != "position"], "position")


def size(bars: DataFrame, name: str, column: str = "signal", **p) -> DataFrame:
    """bars with a column position: fixed, vol_target or proportional sizes of a signal, or those of a
    controller of a raw signal: threshold (all beyond it, else nothing) and scaled (by its size, ``least`` at least)."""
    s = c(column).cast("double")
    if name == "fixed":
        out = s * p.get("size", 1.0)
    elif name == "vol_target":
        bps = c("_vol")
        bars = bars.withColumn("_r", (div(c("close"), S.lag(c("close"))) - 1) * 1e4).withColumn("_vol", S.std(c("_r"), p.get("n", 20), 5))
        out = s * F.least(F.lit(p.get("most", 3.0)), p.get("target", 10.0) / F.greatest(F.coalesce(bps, F.lit(1e9)), F.lit(1.0)))
    elif name == "proportional":
        out = F.greatest(F.lit(-p.get("most", 1.0)), F.least(F.lit(p.get("most", 1.0)), s * F.abs(c(p.get("by", "factor"))) * p.get("scale", 1.0)))
    elif name in ("threshold", "scaled"):
        beyond = F.abs(s) > p.get("threshold", 0.0)
        share = F.lit(1.0) if name == "threshold" else F.greatest(F.lit(p.get("least", 0.1)), F.least(F.lit(1.0), F.abs(s) / p.get("scale", 5.0)))
        out = F.when(beyond, F.signum(s) * share * p.get("most", 1.0)).otherwise(0.0)
    else:
        raise ValueError(f"no sizer {name}")
    return bars.withColumn("position", F.coalesce(out, F.lit(0.0))).drop("_r", "_vol")


def round_trip_bps(maker_share: float = 0.5, maker: float = 2.0, taker: float = 5.0, slippage: float = 0.0) -> float:
    """Cost of a blended entry and exit in basis points."""
    return 2 * (maker_share * maker + (1 - maker_share) * taker + slippage)


def round_to(x: Column, step: float = 0.05) -> Column:
    """Half-even rounding to a step."""
    return F.bround(x / step) * step
