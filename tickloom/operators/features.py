"""Event-window features, feature matrices and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.joins import interval
from tickloom.windows import Series, div

c = F.col


def around(events: DataFrame, tape: DataFrame, before: float, after: float) -> DataFrame:
    """Trade statistics before and after each event (symbol, event_id, at in epoch seconds), in one pass.

    The window before is [at - before, at), the one after [at, at + after).
    """
    rows = tape.select("symbol", "seq", (F.unix_micros("ts") / 1e6).alias("t"), "price", "qty", "side")
    hit = interval(events.select("symbol", "event_id", "at"), rows, ["symbol"], "t", c("at") - before, c("at") + after, float(before + after))
    pre = c("t") < c("at")
    signed = F.when(c("side") == "buy", c("qty")).otherwise(-c("qty"))

    def stats(name: str, inside: Column) -> list[Column]:
        m = lambda x: F.when(inside, x)
        nil = lambda x: F.coalesce(x, F.lit(0.0))
        return [
            F.count(m(c("qty"))).alias(f"{name}_n"),
            nil(F.sum(m(c("qty")))).alias(f"{name}_volume"),
            nil(div(F.sum(m(signed)), F.sum(m(c("qty"))))).alias(f"{name}_imbalance"),
            nil(F.avg(m(c("qty")))).alias(f"{name}_mean_size"),
            nil(F.max(m(c("qty")))).alias(f"{name}_max_size"),
            nil(F.stddev_samp(m(c("qty")))).alias(f"{name}_std_size"),
            nil(div(F.max_by(c("price"), m(c("seq"))) - F.min_by(c("price"), m(c("seq"))), F.min_by(c("price"), m(c("seq"))))).alias(f"{name}_return"),
            nil(F.max(m(c("price"))) - F.min(m(c("price")))).alias(f"{name}_range"),
        ]

    out = hit.groupBy("symbol", "event_id").agg(*stats("pre", pre), *stats("post", ~pre))
    out = out.withColumn("volume_shift", c("post_volume") / (c("pre_volume") + 1e-10)).withColumn("imbalance_shift", c("post_imbalance") - c("pre_imbalance"))
    return events.join(out, ["symbol", "event_id"], "left")


def indicator_stats(events: DataFrame, series: DataFrame, column: str, before: float, after: float) -> DataFrame:
    """mean, std, last, max, min and trend of an indicator (symbol, t, column) before, mean and first after, and their shift."""
    hit = interval(events.select("symbol", "event_id", "at"), series.select("symbol", "t", column), ["symbol"], "t", c("at") - before, c("at") + after, float(before + after), closed="both")
    pre, post = F.when(c("t") < c("at"), c(column)), F.when(c("t") >= c("at"), c(column))
    tp, tq = F.when(c("t") < c("at"), c("t")), F.when(c("t") >= c("at"), c("t"))
    out = hit.groupBy("symbol", "event_id").agg(
        F.avg(pre).alias("pre_mean"), F.stddev_samp(pre).alias("pre_std"), F.max_by(column, tp).alias("pre_last"), F.max(pre).alias("pre_max"), F.min(pre).alias("pre_min"),
        (F.max_by(column, tp) - F.min_by(column, tp)).alias("pre_trend"), F.avg(post).alias("post_mean"), F.min_by(column, tq).alias("post_first"),
    )
    return out.withColumn("shift", c("post_mean") - c("pre_mean"))


def longest_run(rows: DataFrame, key: list[str], order: str, side: str = "side") -> DataFrame:
    """Length of the longest run of one side."""
    w = Window.partitionBy(*key).orderBy(order)
    turn = F.when(c(side) == F.lag(side).over(w), 0).otherwise(1)
    rows = rows.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_run").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("longest_run"))


def select_features(df: DataFrame, columns: list[str], most_missing: float = 0.5) -> list[str]:
    """Columns that vary and are mostly there: one aggregate job."""
    aggs = [F.struct((F.sum(c(x).isNull().cast("long")) / F.count("*")).alias("gone"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(x) for x in columns]
    row = df.agg(*aggs).first()
    return [x for x in columns if row[x]["gone"] is not None and row[x]["gone"] <= most_missing and row[x]["lo"] != row[x]["hi"]]


def by_prefix(df: DataFrame, prefixes: tuple[str, ...], numeric: bool = True) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if n.startswith(prefixes) and (not numeric or t in kinds)]


def sequences(df: DataFrame, columns: list[str], lookback: int, stride: int = 1, s: Series | None = None) -> DataFrame:
    """The last lookback rows of features as an array of arrays, for every stride-th row with a full frame."""
    s = s or Series(order=("bar",))
    rows = df.withColumn("sequence", F.collect_list(F.array(*[c(x).cast("double") for x in columns])).over(s.r(lookback))).withColumn("_i", s.index() - 1)
    return rows.filter((F.size("sequence") == lookback) & (c("_i") % stride == 0)).drop("_i")


def every_nth(df: DataFrame, n: int, s: Series) -> DataFrame:
    return df.withColumn("_i", s.index() - 1).filter(c("_i") % n == 0).drop("_i")


def balance(df: DataFrame, column: str, key: list[str], seed: int = 0) -> DataFrame:
    """Downsample every class to the size of the smallest, by a hash of the key: reruns agree."""
    w = Window.partitionBy(column).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    least = df.groupBy(column).count().agg(F.min("count").alias("_least"))
    return df.withColumn("_i", F.row_number().over(w)).join(F.broadcast(least), c("_i") <= c("_least")).drop("_i", "_least")


def sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows by a hash of the key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def tokens(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """How often each token of a delimited column occurs."""
    return df.select(F.explode(F.split(column, sep)).alias("t")).select(F.trim("t").alias("token")).filter("token <> ''").groupBy("token").count()


def split_by_date(df: DataFrame, ts: str, cut, warmup: int, s: Series) -> tuple[DataFrame, DataFrame]:
    """Rows before cut; rows from cut on with the last warmup rows before it marked warm."""
    late = c(ts) >= F.lit(cut)
    before = df.filter(~late)
    w = Window.partitionBy("symbol").orderBy(c(ts).desc())
    warm = before.withColumn("_i", F.row_number().over(w)).filter(c("_i") <= warmup).drop("_i")
    return before, df.filter(late).withColumn("warm", F.lit(False)).unionByName(warm.withColumn("warm", F.lit(True)))
