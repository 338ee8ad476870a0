"""Autocorrelation studies and the spectrum of intraday volume."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.evaluate import _corr_pair, autocorrelation
from tickloom.windows import div

c = F.col


def return_acf(rows: DataFrame, key: list[str], day: str, order: str, x: str, lags: list[int]) -> DataFrame:
    """Autocorrelation of a return less its mean of the day, with the 95 % band 2 / sqrt(n)."""
    rows = rows.withColumn("_x", c(x) - F.avg(x).over(Window.partitionBy(*key, day)))
    acf = autocorrelation(rows, key, order, "_x", lags)
    n = rows.filter("_x is not null").groupBy(*key).agg(F.count("*").alias("n"))
    return acf.join(n, key).withColumn("band", 2 / F.sqrt("n")).withColumn("significant", F.abs("acf") > c("band"))


def daily_acf(rows: DataFrame, key: list[str], day: str, order: str, x: str) -> DataFrame:
    """Lag-1 autocorrelation of each day, its mean over days and the t of that mean."""
    w = Window.partitionBy(*key, day).orderBy(order)
    days = rows.filter(c(x).isNotNull()).withColumn("_l", F.lag(x).over(w)).groupBy(*key, day).agg(_corr_pair(x, "_l").alias("acf"))
    return days.groupBy(*key).agg(F.count("acf").alias("days"), F.avg("acf").alias("mean_acf"), div(F.avg("acf"), F.stddev_samp("acf") / F.sqrt(F.count("acf"))).alias("t"))


def detrend(rows: DataFrame, key: list[str], order: str, x: str, q: int) -> DataFrame:
    """x less its centred mean of 2q + 1 rows, without the ends."""
    w = Window.partitionBy(*key).orderBy(order)
    frame = w.rowsBetween(-q, q)
    return rows.withColumn("_n", F.count(F.lit(1)).over(frame)).withColumn("detrended", c(x) - F.avg(x).over(frame)).filter(c("_n") == 2 * q + 1).drop("_n")


def autocovariance(rows: DataFrame, key: list[str], order: str, x: str, most: int) -> DataFrame:
    """Unbiased autocovariance at lags 0 .. most of each series by FFT."""
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key), "lag int", "gamma double", "n long"])

    def run(t: pa.Table) -> pa.Table:
        v = t.sort_by(order).column(x).cast(pa.float64()).to_numpy(zero_copy_only=False)
        v = np.nan_to_num(v - np.nanmean(v)) if len(v) else v
        n = len(v)
        size = 1 << max(1, (2 * n - 1).bit_length())
        f = np.fft.rfft(v, size)
        h = min(most, n - 1)
        got = np.fft.irfft(f * np.conj(f), size)[: h + 1] / (n - np.arange(h + 1))
        own = {k: pa.array([t.column(k)[0].as_py()] * (h + 1), t.schema.field(k).type) for k in key}
        return pa.table({**own, "lag": pa.array(np.arange(h + 1), pa.int32()), "gamma": got, "n": pa.array([n] * (h + 1), pa.int64())})

    return rows.select(*key, order, x).groupBy(*key).applyInArrow(run, schema)


def spectrum(gamma: DataFrame, key: list[str], seconds: float, frequencies: int) -> DataFrame:
    """Cosine transform of an autocovariance: a2 and its share for each frequency j, with the period."""
    h = gamma.groupBy(*key).agg(F.max("lag").alias("_h"), F.sum(F.when(c("lag") == 0, c("gamma"))).alias("_v"))
    rows = gamma.join(h, key).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(frequencies))))
    weight = F.when((c("lag") == 0) | (c("lag") == c("_h")), 1.0).otherwise(2.0)
    out = rows.groupBy(*key, "j").agg((F.sum(weight * c("gamma") * F.cos(c("j") * c("lag") * F.lit(np.pi) / c("_h"))) / F.first("_h")).alias("a2"), F.first("_h").alias("_h"), F.first("_v").alias("_v"))
    return out.select(*key, "j", (2 * c("_h") * seconds / c("j")).alias("period_sec"), F.greatest("a2", F.lit(0.0)).alias("a2"), div(F.greatest("a2", F.lit(0.0)), c("_v")).alias("share"))


def top_periods(spec: DataFrame, key: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(c("a2").desc(), "j")
    return spec.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def nearest_period(spec: DataFrame, key: list[str], seconds: float) -> DataFrame:
    return spec.groupBy(*key).agg(F.min_by(F.struct("j", "period_sec", "a2", "share"), F.struct(F.abs(c("period_sec") - seconds), c("j"))).alias("s")).select(*key, "s.*")


def intraday_panel(tape: DataFrame, sec: int, coverage: float = 0.95) -> DataFrame:
    """Volume of each (day, bin), empty bins 0, days whose trades cover less of the day left out."""
    day, at = F.to_date("ts"), F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / sec)
    rows = tape.groupBy("symbol", day.alias("day"), at.alias("bin")).agg(F.sum("qty").alias("volume"))
    ends = rows.groupBy("symbol", "day").agg(((F.max("bin") - F.min("bin") + 1) * sec / 86400).alias("_c")).filter(c("_c") >= coverage)
    full = ends.select("symbol", "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(86400 // sec - 1).cast("long"))).alias("bin"))
    return full.join(rows, ["symbol", "day", "bin"], "left").fillna(0.0, ["volume"])


def cosines(spark, n: int, seconds: float, periods: list[float], amplitudes: list[float], noise: float = 0.0, seed: int = 0) -> DataFrame:
    """A synthetic series of cosines with known periods, and noise from a seed."""
    t = c("id") * seconds
    x = sum((a * F.cos(2 * np.pi * t / p) for a, p in zip(amplitudes, periods, strict=True)), F.lit(0.0))
    return spark.range(n).select(F.lit(0).alias("symbol"), c("id").alias("bar"), (x + noise * F.randn(seed)).alias("x"))


def trailing_quintile(rows: DataFrame, key: list[str], order: str, x: str, n: int = 60, least: int = 10) -> DataFrame:
    """Quintile of x among the n rows before it: 1 + the fifth its share of smaller or equal values falls in."""
    w = Window.partitionBy(*key).orderBy(order)
    a = F.collect_list(x).over(w.rowsBetween(-n, -1))
    share = F.size(F.filter(a, lambda v: v <= c(x))) / F.size(a)
    return rows.withColumn("quintile", F.when(F.size(a) >= least, F.greatest(F.lit(1), F.ceil(share * 5)).cast("int")))


def long_short(rows: DataFrame, key: list[str], y: str) -> DataFrame:
    """Mean of the fifth quintile less that of the first, with Welch's t."""
    one, five = F.when(c("quintile") == 1, c(y)), F.when(c("quintile") == 5, c(y))
    se = F.sqrt(F.var_samp(five) / F.count(five) + F.var_samp(one) / F.count(one))
    return rows.groupBy(*key).agg(F.count(five).alias("n_long"), F.count(one).alias("n_short"), (F.avg(five) - F.avg(one)).alias("spread"), div(F.avg(five) - F.avg(one), se).alias("t"))
