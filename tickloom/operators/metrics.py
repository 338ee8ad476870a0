"""Performance of return series and trade lists: running sums and maxima, islands, one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.windows import div

c = F.col


def _corrected_skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def trade_metrics(trades: DataFrame, key: list[str], order: str, ret: str = "ret") -> DataFrame:
    """13 figures of a list of trades. A trade that earns nothing is a loss; drawdown is of the running sum."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_c", F.sum(ret).over(w)).withColumn("_d", F.greatest(F.max("_c").over(w), F.lit(0.0)) - c("_c"))
    win, loss = F.when(c(ret) > 0, c(ret)), F.when(c(ret) <= 0, c(ret))
    nil = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n_trades"),
        nil(F.avg((c(ret) > 0).cast("double"))).alias("win_rate"),
        nil(F.avg(ret)).alias("mean_ret"),
        nil(F.median(ret)).alias("median_ret"),
        nil(F.stddev_samp(ret)).alias("std_ret"),
        nil(F.sum(ret)).alias("total_ret"),
        nil(F.avg(win)).alias("avg_win"),
        nil(F.avg(loss)).alias("avg_loss"),
        nil(div(F.sum(win), F.abs(F.sum(loss)))).alias("profit_factor"),
        nil(div(F.avg(ret), F.stddev_samp(ret)) * F.sqrt(F.count("*"))).alias("sharpe"),
        nil(F.max("_d")).alias("max_drawdown"),
        nil(_corrected_skew(ret)).alias("skew"),
        nil(F.percentile(ret, F.lit(0.05))).alias("p05"),
    )


def return_metrics(rows: DataFrame, key: list[str], order: str, bar_seconds: float, ret: str = "ret", position: str = "position") -> DataFrame:
    """Compounded and annualised figures of a return for each bar, by side, with turnover and drawdown."""
    w = Window.partitionBy(*key).orderBy(order)
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    year = 365 * 86400 / bar_seconds
    rows = rows.withColumn("_g", F.sum(F.log1p(F.greatest(c(ret), F.lit(-0.999999)))).over(u))
    rows = rows.withColumn("_e", F.exp("_g")).withColumn("_d", 1 - c("_e") / F.greatest(F.max("_e").over(u), F.lit(1.0)))
    rows = rows.withColumn("_t", F.abs(c(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0)))).withColumn("_held", F.coalesce(F.lag(position).over(w), F.lit(0.0)))
    nil = lambda x: F.coalesce(x, F.lit(0.0))
    down = F.sqrt(F.avg(F.pow(F.least(c(ret), F.lit(0.0)), 2)))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n_bars"),
        (F.exp(F.max_by("_g", order)) - 1).alias("total_return"),
        (F.avg(ret) * year).alias("annual_return"),
        nil(F.stddev_samp(ret) * math.sqrt(year)).alias("annual_vol"),
        nil(div(F.avg(ret), F.stddev_samp(ret)) * math.sqrt(year)).alias("sharpe"),
        nil(div(F.avg(ret), down) * math.sqrt(year)).alias("sortino"),
        nil(F.max("_d")).alias("max_drawdown"),
        nil(div(F.exp(F.max_by("_g", order)) - 1, F.max("_d"))).alias("calmar"),
        nil(F.sum(F.when(c("_held") > 0, c(ret)))).alias("long_return"),
        nil(F.sum(F.when(c("_held") < 0, c(ret)))).alias("short_return"),
        F.sum("_t").alias("turnover"),
        F.avg((c(position) != 0).cast("double")).alias("exposure"),
        nil(F.avg(F.when(c("_held") != 0, (c(ret) > 0).cast("double")))).alias("hit_rate"),
    )


def stretches(rows: DataFrame, key: list[str], order: str, position: str = "position", ret: str = "ret") -> DataFrame:
    """Runs of one side, the bar of the exit included: start, end, bars, side, ret."""
    w = Window.partitionBy(*key).orderBy(order)
    prior = F.coalesce(F.lag(position).over(w), F.lit(0.0))
    rows = rows.withColumn("_s", F.signum(position)).withColumn("_p", F.signum(prior))
    rows = rows.withColumn("_new", ((c("_s") != 0) & (c("_s") != c("_p"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = rows.filter((c("_run") > 0) & ((c("_s") != 0) | (c("_p") != 0)))
    return inside.groupBy(*key, "_run").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("bars"), F.min_by("_s", order).alias("side"), F.sum(ret).alias("ret")
    ).withColumnRenamed("_run", "run")


def streaks(rows: DataFrame, key: list[str], order: str, ret: str = "ret") -> DataFrame:
    """Longest runs of wins and of losses."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = rows.withColumn("_w", (c(ret) > 0).cast("int"))
    turn = F.when(c("_w") == F.lag("_w").over(w), 0).otherwise(1)
    rows = rows.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*key, "_run", "_w").agg(F.count("*").alias("n"))
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(c("_w") == 1, c("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(c("_w") == 0, c("n"))), F.lit(0)).alias("max_losses"))


def report_series(rows: DataFrame, key: list[str], order: str, ret: str = "ret", position: str = "position") -> DataFrame:
    """Cumulative return, drawdown, curves by side, mean turnover and entry and exit marks of each bar."""
    w = Window.partitionBy(*key).orderBy(order)
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = F.coalesce(F.lag(position).over(w), F.lit(0.0))
    rows = rows.withColumn("_p", prior).withColumn("cum_return", F.exp(F.sum(F.log1p(ret)).over(u)) - 1)
    rows = rows.withColumn("drawdown", 1 - (1 + c("cum_return")) / F.greatest(F.max(1 + c("cum_return")).over(u), F.lit(1.0)))
    rows = rows.withColumn("long_curve", F.sum(F.when(c("_p") > 0, c(ret)).otherwise(0.0)).over(u)).withColumn("short_curve", F.sum(F.when(c("_p") < 0, c(ret)).otherwise(0.0)).over(u))
    rows = rows.withColumn("_t", F.abs(c(position) - c("_p")))
    return (
        rows.withColumn("turnover_ma", F.avg("_t").over(w.rowsBetween(-29, 0)))
        .withColumn("is_entry", ((c(position) != 0) & (c("_p") == 0)).cast("int"))
        .withColumn("is_exit", ((c(position) == 0) & (c("_p") != 0)).cast("int"))
        .drop("_p", "_t")
    )
