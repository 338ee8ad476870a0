"""Position simulators and their grids.

A position machine is a recursion over bars, so each (symbol, configuration) is one
pass in grouped Arrow batches, and configurations run in parallel. Whatever has no state
(held positions, fixed intervals, contrarian returns) is windows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from tickloom.operators.joins import expand
from tickloom.windows import Series, div

S = Series(order=("bar",))
c = F.col

#: stop name -> function(state, parameters) -> bool; the state has side, entry, price, bars, peak, atr.
STOPS: dict[str, Callable] = {
    "none": lambda s, p: False,
    "fixed": lambda s, p: s["pnl"] <= -p.get("pct", 0.01),
    "trailing": lambda s, p: s["peak"] - s["pnl"] >= p.get("pct", 0.01) and s["peak"] > 0,
    "time": lambda s, p: s["bars"] >= p.get("bars", 20),
    "atr": lambda s, p: s["atr"] == s["atr"] and s["side"] * (s["price"] - s["entry"]) <= -p.get("k", 2.0) * s["atr"],
}
#: exit name -> function(state, signal, parameters) -> bool
EXITS: dict[str, Callable] = {
    "none": lambda s, x, p: False,
    "signal_reversal": lambda s, x, p: x * s["side"] < 0,
    "signal_neutral": lambda s, x, p: x == 0,
    "time_decay": lambda s, x, p: s["bars"] >= p.get("bars", 10),
    "mean_reversion": lambda s, x, p: s["pnl"] >= p.get("target", 0.005),
}


def machine(close: np.ndarray, want: np.ndarray, atr: np.ndarray, stop: str, exit: str, params: dict, cost_bps: float, strict: bool = False) -> dict[str, list]:
    """Walk the bars: stop, then exit, then the wanted position. Returns position, ret and reason for each bar.

    A flip from one side straight to the other keeps the entry and the count of bars of
    the first, unless strict. Cost is paid on the change of position, half of the round
    trip for each unit. stop may join several names by +.
    """
    pos, entry, bars, peak, entry_atr, prior = 0.0, np.nan, 0, 0.0, np.nan, np.nan
    out: dict[str, list] = {"position": [], "ret": [], "reason": []}
    for price, target, a in zip(close, want, atr, strict=True):
        ret = pos * (price / prior - 1) if prior == prior and prior else 0.0
        before, reason = pos, ""
        if pos:
            bars += 1
            side = 1 if pos > 0 else -1
            pnl = side * (price / entry - 1)
            peak = max(peak, pnl)
            state = {"side": side, "entry": entry, "price": price, "bars": bars, "peak": peak, "pnl": pnl, "atr": entry_atr}
            if any(STOPS[s](state, params) for s in stop.split("+")):
                pos, reason = 0.0, "stop"
            elif EXITS[exit](state, target, params):
                pos, reason = 0.0, "exit"
        if not reason and target and target != pos:
            if not pos or strict and pos * target < 0:
                entry, bars, peak, entry_atr = price, 0, 0.0, a
                reason = "entry"
            elif pos * target < 0:
                reason = "flip"
            pos = float(target)
        ret -= abs(pos - before) * cost_bps / 2 / 1e4
        out["position"].append(pos)
        out["ret"].append(ret)
        out["reason"].append(reason)
        prior = price
    return out


def backtest(bars: DataFrame, configs: list[dict], column: str = "position") -> DataFrame:
    """bars (symbol, bar, close, column, maybe atr) for every configuration -> a log row for each bar.

    A configuration has stop, exit, cost_bps, strict and the parameters of its rules.
    """
    known = {"stop": "none", "exit": "none", "cost_bps": 0.0, "strict": False}
    grid = [known | g for g in configs]
    rows = bars if "atr" in bars.columns else bars.withColumn("atr", F.lit(None).cast("double"))
    rows = expand(rows.select("symbol", "bar", "close", c(column).cast("double").alias("want"), "atr"), [{"_k": i} for i in range(len(grid))]).drop("_k")
    schema = StructType([rows.schema["symbol"], rows.schema["config_id"], rows.schema["bar"]]).add("close", DoubleType()).add("position", DoubleType()).add("ret", DoubleType()).add("reason", StringType())

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bar")
        g = grid[t.column("config_id")[0].as_py()]
        arrays = [t.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("close", "want", "atr")]
        got = machine(*arrays, stop=g["stop"], exit=g["exit"], params=g, cost_bps=g["cost_bps"], strict=g["strict"])
        own = t.select(["symbol", "config_id", "bar"]).append_column("close", t.column("close").cast(pa.float64()))
        for n in ("position", "ret"):
            own = own.append_column(n, pa.array(got[n], pa.float64()))
        return own.append_column("reason", pa.array(got["reason"], pa.string()))

    return rows.groupBy("symbol", "config_id").applyInArrow(run, schema)


def grid(**options: list) -> list[dict]:
    """All combinations of the options."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def held_returns(bars: DataFrame, column: str = "position", fee_bps: float = 0.0) -> DataFrame:
    """Returns of a held position: yesterday's position earns today's open to close, changes pay the fee."""
    held = F.coalesce(S.lag(c(column)), F.lit(0.0))
    bars = bars.withColumn("_h", held)
    turn = F.abs(c("_h") - F.coalesce(S.lag(c("_h")), F.lit(0.0)))
    ret = c("_h") * (div(c("close"), c("open")) - 1) - turn * fee_bps / 1e4
    bars = bars.withColumn("ret", F.coalesce(ret, F.lit(0.0)))
    return bars.withColumn("equity", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(S.u))).drop("_h")


def fixed_interval(bars: DataFrame, column: str, every: int, threshold: float, cost_bps: float) -> DataFrame:
    """Rebalance every few bars to the sign of a prediction beyond a threshold; keep it in between."""
    bars = bars.withColumn("_i", S.index() - 1)
    want = F.when(c(column) > threshold, 1.0).when(c(column) < -threshold, -1.0).otherwise(0.0)
    bars = bars.withColumn("position", S.ffill(F.when(c("_i") % every == 0, want)))
    move = div(c("close"), S.lag(c("close"))) - 1
    held = F.coalesce(S.lag(c("position")), F.lit(0.0))
    cost = F.abs(c("position") - held) * cost_bps / 1e4
    return bars.withColumn("ret", F.coalesce(held * move, F.lit(0.0)) - cost).drop("_i")


def contrarian(bars: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Against the last return."""
    bars = bars.withColumn("_r", div(c("close"), S.lag(c("close"))) - 1)
    side = F.coalesce(-F.signum(S.lag(c("_r"))), F.lit(0.0))
    return bars.withColumn("ret", F.coalesce(side * c("_r"), F.lit(0.0)) - F.when(side != 0, cost_bps / 1e4).otherwise(0.0)).withColumn("cum", F.sum("ret").over(S.u)).drop("_r")


def with_cooldown(entries: DataFrame, exit_bar: str, cooldown: int, horizon: int, strict: bool = False, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Of candidate entries (i: row of the entry, exit_bar: bars until it ends) those free of the one taken before.

    The next entry comes cooldown rows after the full horizon of the last, or with strict
    after its actual exit.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        free, keep = -1, []
        for i, e in zip(t.column("i").to_pylist(), t.column(exit_bar).to_pylist(), strict=True):
            ok = i >= free
            keep.append(ok)
            if ok:
                free = i + (e if strict else horizon) + cooldown
        return t.filter(pa.array(keep, pa.bool_()))

    return entries.groupBy(*key).applyInArrow(run, entries.schema)


def signal_accuracy(bars: DataFrame, column: str, hold: int) -> DataFrame:
    """Outcome of each signal entered at the next close and held for some bars: ret and correct."""
    ret = c(column) * (div(S.lead(c("close"), 1 + hold), S.lead(c("close"), 1)) - 1)
    return bars.withColumn("ret", ret).filter((c(column) != 0) & c("ret").isNotNull()).withColumn("correct", (c("ret") > 0).cast("int"))


def threshold_paths(bars: DataFrame, column: str, thresholds: list[float], h: int) -> DataFrame:
    """Mean and median of best move, worst move and return of the next h bars by threshold of entry, for reversion."""
    w = S.f(h)
    side = -F.signum(c(column))
    far = div(S.lead(c("close"), h), c("close")) - 1
    up, down = div(F.max("high").over(w), c("close")) - 1, div(F.min("low").over(w), c("close")) - 1
    rows = bars.withColumn("_ret", side * far).withColumn("_mfe", F.when(side > 0, up).otherwise(-down)).withColumn("_mae", F.when(side > 0, down).otherwise(-up)).filter("_ret is not null")
    rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.abs(c(column)) >= c("threshold"))
    stats = [f(n).alias(f"{k}{n}") for n in ("_ret", "_mfe", "_mae") for k, f in (("mean", F.avg), ("median", F.median))]
    return rows.groupBy("symbol", "threshold").agg(F.count("*").alias("n"), *stats)


def reversion_grid(bars: DataFrame, column: str, entries: list[float], exits: list[float], h: int) -> DataFrame:
    """For entries beyond a level: how often and how soon the value comes back within another in h bars."""
    rows = bars.withColumn("_a", F.collect_list(F.abs(c(column))).over(S.f(h)))
    rows = expand(rows, [{"entry": e, "leave": x} for e in entries for x in exits if x < e]).filter((F.abs(c(column)) >= c("entry")) & (F.size("_a") > 0))
    tau = F.array_position(F.transform("_a", lambda v: v <= c("leave")), True).cast("double")
    rows = rows.withColumn("_t", F.when(tau > 0, tau))
    return rows.groupBy("symbol", "entry", "leave").agg(F.count("*").alias("n"), F.avg(c("_t").isNotNull().cast("double")).alias("hit_rate"), F.avg("_t").alias("mean_tau"))
