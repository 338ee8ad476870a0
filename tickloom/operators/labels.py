"""Forward labels and exits along a path, by arrays of the rows ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.windows import Series, div

S = Series(order=("bar",))
c = F.col


def ahead(h: int, *columns: str) -> Column:
    """The next h rows as structs, nearest first."""
    return F.collect_list(F.struct(*columns)).over(S.f(h))


def _first(a: Column, test) -> Column:
    """Place of the first element that passes, from 1; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(a, test), True), F.lit(0)).cast("int")


def triple_barrier(bars: DataFrame, up: float, down: float, h: int, path: bool = True, width: Column | None = None) -> DataFrame:
    """First of upper barrier, lower barrier or h bars: label, hit_bar, ret, mfe, mae.

    up and down are shares of the entry close, times width (say a volatility) if given.
    path: highs and lows touch barriers, else closes. A bar that touches both counts for
    the side of its close, down if that is not below the entry, with the close's return. A series
    that ends before has a time label at its last bar; the last row has none.
    """
    w = F.lit(1.0) if width is None else width
    bars = bars.withColumn("_a", ahead(h, "high", "low", "close")).withColumn("_u", c("close") * (1 + up * w)).withColumn("_l", c("close") * (1 - down * w))
    top = (lambda x: x["high"]) if path else (lambda x: x["close"])
    bottom = (lambda x: x["low"]) if path else (lambda x: x["close"])
    hit = _first(c("_a"), lambda x: (top(x) >= c("_u")) | (bottom(x) <= c("_l")))
    bars = bars.withColumn("_k", hit).withColumn("hit_bar", F.when(c("_k") > 0, c("_k")).otherwise(F.size("_a")))
    x = F.try_element_at("_a", F.when(c("hit_bar") > 0, c("hit_bar")).otherwise(1))
    hi, lo = top(x) >= c("_u"), bottom(x) <= c("_l")
    both = hi & lo
    label = F.when(c("_k") == 0, "time").when(both, F.when(x["close"] >= c("close"), "lower").otherwise("upper")).when(hi, "upper").otherwise("lower")
    ret = F.when((c("_k") == 0) | both, div(x["close"], c("close")) - 1).when(hi, up * w).otherwise(-down * w)
    part = F.slice("_a", 1, F.greatest(c("hit_bar"), F.lit(1)))
    best = div(F.array_max(F.transform(part, top)), c("close")) - 1
    worst = div(F.array_min(F.transform(part, bottom)), c("close")) - 1
    out = bars.filter(F.size("_a") > 0).withColumn("label", label).withColumn("ret", ret).withColumn("mfe", best).withColumn("mae", worst)
    return out.drop("_a", "_u", "_l", "_k")


def multi_horizon(bars: DataFrame, up: float, down: float, horizons: list[int]) -> DataFrame:
    """The label of triple_barrier at each horizon, as label_<h>: one pass over the longest."""
    bars = bars.withColumn("_a", ahead(max(horizons), "high", "low", "close"))
    u, low = c("close") * (1 + up), c("close") * (1 - down)
    hit = _first(c("_a"), lambda x: (x["high"] >= u) | (x["low"] <= low))
    bars = bars.withColumn("_k", hit)
    x = F.try_element_at("_a", F.greatest(c("_k"), F.lit(1)))
    side = F.when((x["high"] >= u) & (x["low"] <= low), F.when(x["close"] >= c("close"), "lower").otherwise("upper")).when(x["high"] >= u, "upper").otherwise("lower")
    for h in horizons:
        bars = bars.withColumn(f"label_{h}", F.when((c("_k") > 0) & (c("_k") <= h), side).otherwise("time"))
    return bars.filter(F.size("_a") > 0).drop("_a", "_k")


def label_summary(labels: DataFrame) -> DataFrame:
    """Number, share and mean outcome of each label of a symbol."""
    from pyspark.sql import Window

    n = F.count("*")
    out = labels.groupBy("symbol", "label").agg(n.alias("n"), F.avg("ret").alias("mean_ret"), F.avg("hit_bar").alias("mean_bars"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))
    return out.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("symbol")))


def forward_return(bars: DataFrame, h: int, kind: str = "ratio") -> DataFrame:
    """Return of the next h bars: ratio, log, bps, or the sum of the column ret."""
    far = S.lead(c("close"), h)
    if kind == "sum":
        x = F.when(F.count("ret").over(S.f(h)) >= h, F.sum("ret").over(S.f(h)))
    else:
        ratio = div(far, c("close"))
        x = {"ratio": ratio - 1, "log": F.log(ratio), "bps": (ratio - 1) * 1e4}[kind]
    return bars.withColumn(f"fwd_{h}", x)


def class_target(column: str, up: float, down: float | None = None) -> Column:
    """1 above up, -1 below -down, else 0; NULL stays."""
    down = up if down is None else down
    return F.when(c(column) > up, 1).when(c(column) < -down, -1).when(c(column).isNotNull(), 0)


def path_exit(bars: DataFrame, h: int, stop: float, target: float, trail: float | None = None, side: int = 1) -> DataFrame:
    """Exit of an entry at each close: trailing stop, then stop, then target, then h bars. Adds exit_bar, exit_reason, exit_ret.

    Shares of the entry price. The trailing stop follows the best close so far of the bars before.
    """
    bars = bars.withColumn("_a", ahead(h, "high", "low", "close"))
    e = c("close")
    gain = lambda p: side * (div(p, e) - 1)
    worst = (lambda x: x["low"]) if side > 0 else (lambda x: x["high"])
    best = (lambda x: x["high"]) if side > 0 else (lambda x: x["low"])
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit("").alias("why"), F.lit(0.0).alias("ret"), F.lit(0.0).alias("peak"))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        done = lambda why, ret: F.struct(i.alias("i"), i.alias("at"), F.lit(why).alias("why"), ret.alias("ret"), s["peak"].alias("peak"))
        go = F.struct(i.alias("i"), s["at"].alias("at"), s["why"].alias("why"), s["ret"].alias("ret"), F.greatest(s["peak"], gain(x["close"])).alias("peak"))
        out = F.when(s["at"] > 0, s)
        if trail is not None:
            out = out.when((s["peak"] > 0) & (gain(worst(x)) <= s["peak"] - trail), done("trail", s["peak"] - trail))
        return out.when(gain(worst(x)) <= -stop, done("stop", F.lit(-stop))).when(gain(best(x)) >= target, done("target", F.lit(target))).otherwise(go)

    bars = bars.withColumn("_x", F.aggregate("_a", zero, step)).filter(F.size("_a") > 0)
    last = F.element_at("_a", -1)
    held = c("_x.at") == 0
    return (
        bars.withColumn("exit_bar", F.when(held, F.size("_a")).otherwise(c("_x.at")))
        .withColumn("exit_reason", F.when(held, "time").otherwise(c("_x.why")))
        .withColumn("exit_ret", F.when(held, gain(last["close"])).otherwise(c("_x.ret")))
        .drop("_a", "_x")
    )


def excursions(bars: DataFrame, h: int) -> DataFrame:
    """Best and worst move of the next h bars from each close."""
    w = S.f(h)
    return bars.withColumn("mfe", div(F.max("high").over(w), c("close")) - 1).withColumn("mae", div(F.min("low").over(w), c("close")) - 1)


def gaps(bars: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """Three-bar gaps: bullish where this low is above the high two bars ago, bearish the other way round."""
    hi, lo, mid = S.lag(c("high"), 2), S.lag(c("low"), 2), S.lag(c("close"), 1)
    made = F.array_compact(
        F.array(
            F.when(c("low") > hi, F.struct(F.lit("bullish").alias("kind"), hi.alias("bottom"), c("low").alias("top"), (div(c("low") - hi, mid) * 100).alias("size_pct"))),
            F.when(c("high") < lo, F.struct(F.lit("bearish").alias("kind"), c("high").alias("bottom"), lo.alias("top"), (div(lo - c("high"), mid) * 100).alias("size_pct"))),
        )
    )
    return bars.withColumn("_g", made).withColumn("_g", F.explode("_g")).select("*", "_g.*").drop("_g").filter(c("size_pct") >= least_pct)


def gap_fills(bars: DataFrame, h: int, least_pct: float = 0.0) -> DataFrame:
    """Gaps with status (filled, partial, expired, open), fill_bars and the furthest move before the fill."""
    bars = bars.withColumn("_a", ahead(h, "high", "low"))
    g = gaps(bars, least_pct)
    bull = c("kind") == "bullish"
    full = _first(c("_a"), lambda x: F.when(bull, x["low"] <= c("bottom")).otherwise(x["high"] >= c("top")))
    touched = F.exists("_a", lambda x: F.when(bull, x["low"] < c("top")).otherwise(x["high"] > c("bottom")))
    g = g.withColumn("fill_bars", F.when(full > 0, full))
    before = F.when(c("fill_bars").isNull(), c("_a")).otherwise(F.slice("_a", 1, F.greatest(c("fill_bars") - 1, F.lit(0))))
    reach = F.when(bull, F.array_max(F.transform(before, lambda x: x["high"])) - c("top")).otherwise(c("bottom") - F.array_min(F.transform(before, lambda x: x["low"])))
    status = F.when(c("fill_bars").isNotNull(), "filled").when(touched, "partial").when(F.size("_a") >= h, "expired").otherwise("open")
    return g.withColumn("status", status).withColumn("max_extension", F.greatest(F.lit(0.0), F.coalesce(reach, F.lit(0.0)))).drop("_a")
