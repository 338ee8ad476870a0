"""Window specifications and the rules of missing values that all operators share.

Every trailing window of a table uses the one specification P, so Spark plans them with
one exchange and one sort. Frames count rows; ``mp`` gives NULL until enough values of
the frame are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Partition and order of a series.
KEY, ORDER = ("symbol",), ("ts", "seq")


class Series:
    """Frames over one series order. ``key`` and ``order`` name columns."""

    def __init__(self, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ORDER) -> None:
        self.key, self.order = key, order

    @property
    def p(self) -> WindowSpec:
        """The whole partition in order. Made on demand: Python workers import this module without a session."""
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def r(self, d: int) -> WindowSpec:
        """The last d rows, this one included."""
        return self.p.rowsBetween(-(d - 1), 0)

    @property
    def u(self) -> WindowSpec:
        """All rows up to this one."""
        return self.p.rowsBetween(Window.unboundedPreceding, 0)

    def f(self, h: int) -> WindowSpec:
        """The next h rows, without this one."""
        return self.p.rowsBetween(1, h)

    def lag(self, x: Column, d: int = 1) -> Column:
        return F.lag(x, d).over(self.p)

    def lead(self, x: Column, d: int = 1) -> Column:
        return F.lead(x, d).over(self.p)

    def mp(self, least: int, d: int, counted: Column, value: Column) -> Column:
        """value if the frame has ``least`` values of counted, else NULL."""
        return F.when(F.count(counted).over(self.r(d)) >= least, value)

    def mean(self, x: Column, d: int, least: int | None = None) -> Column:
        return self.mp(d if least is None else least, d, x, F.avg(x).over(self.r(d)))

    def std(self, x: Column, d: int, least: int | None = None) -> Column:
        return self.mp(max(2, d if least is None else least), d, x, F.stddev_samp(x).over(self.r(d)))

    def total(self, x: Column, d: int, least: int | None = None) -> Column:
        return self.mp(d if least is None else least, d, x, F.sum(x).over(self.r(d)))

    def low(self, x: Column, d: int, least: int | None = None) -> Column:
        return self.mp(d if least is None else least, d, x, F.min(x).over(self.r(d)))

    def high(self, x: Column, d: int, least: int | None = None) -> Column:
        return self.mp(d if least is None else least, d, x, F.max(x).over(self.r(d)))

    def quantile(self, x: Column, q: float, d: int, least: int | None = None) -> Column:
        return self.mp(d if least is None else least, d, x, F.percentile(x, F.lit(q)).over(self.r(d)))

    def corr(self, x: Column, y: Column, d: int, least: int) -> Column:
        """Pearson of complete pairs; NULL with zero variance."""
        a, b = paired(x, y)
        w = self.r(d)
        flat = (F.min(a).over(w) == F.max(a).over(w)) | (F.min(b).over(w) == F.max(b).over(w))
        # Not F.corr, which raises where the product of tiny variances underflows.
        rho = div(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))
        return F.when((F.count(a).over(w) >= max(2, least)) & ~flat, rho)

    def cov(self, x: Column, y: Column, d: int, least: int) -> Column:
        a, b = paired(x, y)
        return F.when(F.count(a).over(self.r(d)) >= max(2, least), F.covar_samp(a, b).over(self.r(d)))

    def skew(self, x: Column, d: int, least: int) -> Column:
        """Bias-corrected skewness."""
        n = F.count(x).over(self.r(d)).cast("double")
        g = F.skewness(x).over(self.r(d))
        return F.when(n >= max(3, least), g * F.sqrt(n * (n - 1)) / (n - 2))

    def kurt(self, x: Column, d: int, least: int) -> Column:
        """Bias-corrected excess kurtosis."""
        n = F.count(x).over(self.r(d)).cast("double")
        g = F.kurtosis(x).over(self.r(d))
        return F.when(n >= max(4, least), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))

    def ffill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.u)

    def bfill(self, x: Column) -> Column:
        """A running frame over the reversed order: one that starts at its row is gone through anew for every row."""
        back = Window.partitionBy(*self.key).orderBy(*[F.desc(o) for o in self.order])
        return F.last(x, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))

    def index(self) -> Column:
        return F.row_number().over(self.p)


def trailing(df: DataFrame, ms: int, values: dict[str, tuple[str, Column]], key: tuple[str, ...] = KEY, micros: str = "micros") -> DataFrame:
    """Add by name the (sum, min or max) of a column over the trailing time frame (t - ms, t] of a column of microseconds.

    Time is cut into bins of ms. A frame is what its bin holds up to t and what the bin before
    holds behind t - ms: a running value in each direction, where every row of the bin
    before is placed ms later. So a row is met twice, however many rows a frame has, a
    bin is a task of its own, and nothing is subtracted.
    """
    us = ms * 1000
    names = {n: f"_v_{n}" for n in values}
    rows = df.withColumns({names[n]: x for n, (_, x) in values.items()} | {"_t": F.col(micros), "_own": F.lit(True)})
    later = rows.filter(F.col("_t").isNotNull()).select(*key, (F.col("_t") + us).alias("_t"), F.lit(False).alias("_own"), *names.values())
    both = rows.unionByName(later, allowMissingColumns=True).withColumn("_bin", F.col("_t") - F.pmod("_t", F.lit(us)))
    part = Window.partitionBy(*key, "_bin")
    here = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    before = part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    kinds = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}
    found = {}
    for n, (kind, _) in values.items():
        agg, both_of = kinds[kind]
        found[n] = both_of(agg(F.when(F.col("_own"), F.col(names[n]))).over(here), agg(F.when(~F.col("_own"), F.col(names[n]))).over(before))
    kept = [x for x in df.columns if x not in values]
    return both.withColumns(found).filter("_own").select(*kept, *values)


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    """Both, each NULL where either is."""
    whole = x.isNotNull() & y.isNotNull()
    return F.when(whole, x), F.when(whole, y)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def dedup_last(df: DataFrame, key: tuple[str, ...] = KEY, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The last row of each timestamp."""
    w = Window.partitionBy(*key, ts).orderBy(F.col(seq).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def grid(df: DataFrame, seconds: int, key: tuple[str, ...] = KEY, ts: str = "ts") -> DataFrame:
    """Add empty bins between the first and the last of each series, bins ``seconds`` apart."""
    ends = df.groupBy(*key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    bins = ends.select(*key, F.explode(F.expr(f"sequence(lo, hi, interval {seconds} seconds)")).alias(ts))
    return bins.join(df, [*key, ts], "left")


def with_halo(df: DataFrame, chunk: Column, lookback: int, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Split each series into chunks with the last ``lookback`` rows of the chunk before.

    Windows over (key, chunk) with frames of at most ``lookback`` + 1 rows then give the
    values of the whole series on rows where ``halo`` is false, so one long series is no
    single task. The halo of a chunk must lie in the chunk before.
    """
    w = Window.partitionBy(*key, "chunk").orderBy(*[F.col(c).desc() for c in order])
    df = df.withColumn("chunk", chunk)
    own = df.withColumn("halo", F.lit(False))
    tail = df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= lookback).drop("_k")
    nxt = Window.partitionBy(*key).orderBy("chunk")
    following = df.select(*key, "chunk").distinct().withColumn("_next", F.lead("chunk").over(nxt)).filter("_next is not null")
    tail = tail.join(following, [*key, "chunk"]).withColumn("chunk", F.col("_next")).drop("_next").withColumn("halo", F.lit(True))
    return own.unionByName(tail)
