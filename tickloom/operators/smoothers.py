"""Recursive smoothers.

Where the pace of a smoother comes from the data alone, its steps are linear and compose:
``ewm_scan``, ``kaufman_scan`` and ``adaptive_scan`` run within chunks of ROWS rows and hand one
value on, so a long series is many tasks. ``recur`` runs a NumPy kernel over a whole series
in grouped Arrow batches, for the others; series run in parallel. The smoothers that are
no true recursions are built-in windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tickloom.operators import chunks
from tickloom.windows import Series, div, with_halo

Kernel = Callable[..., dict[str, np.ndarray]]
#: Rows of a chunk of a series.
ROWS = 8192


def recur(df: DataFrame, kernel: Kernel, inputs: list[str], outputs: list[str], key: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("bar",), **params) -> DataFrame:
    """df with the outputs of kernel(arrays..., **params) for each series; NULL and NaN stand for each other."""
    schema = StructType([f for f in df.schema.fields if f.name not in outputs])
    names = [f.name for f in schema.fields]
    for o in outputs:
        schema = schema.add(o, DoubleType())

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        arrays = [t.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).copy() for i in inputs]
        got = kernel(*arrays, **params)
        t = t.select(names)
        for o in outputs:
            v = np.asarray(got[o], float)
            t = t.append_column(o, pa.array(v, pa.float64(), mask=~np.isfinite(v)))
        return t

    return df.groupBy(*key).applyInArrow(run, schema)


def ewm(x: np.ndarray, alpha: float, adjust: bool = False, least: int = 1) -> dict[str, np.ndarray]:
    """Exponential mean; missing values decay the weights of older ones. NaN until ``least`` values were seen."""
    out, num, den, seen, y = np.full(len(x), np.nan), 0.0, 0.0, 0, np.nan
    old = 1.0
    for i, v in enumerate(x):
        good = v == v
        if adjust:
            num, den = num * (1 - alpha), den * (1 - alpha)
            if good:
                num, den = num + v, den + 1
        elif y != y:
            y = v
        else:
            old *= 1 - alpha
            if good:
                y, old = (old * y + alpha * v) / (old + alpha), 1.0
        seen += good
        if seen >= least:
            out[i] = num / den if adjust else y
    return {"y": out}


def kaufman(x: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> dict[str, np.ndarray]:
    """Adaptive average: the efficiency of the last n steps sets the pace."""
    out = np.full(len(x), np.nan)
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    steps = np.abs(np.diff(x, prepend=x[:1]))
    for i in range(len(x)):
        if i < n:
            out[i] = x[i]
            continue
        move, path = abs(x[i] - x[i - n]), steps[i - n + 1 : i + 1].sum()
        k = ((move / path if path > 0 else 0.0) * (f - s) + s) ** 2
        out[i] = out[i - 1] + k * (x[i] - out[i - 1])
    return {"y": out}


def adaptive_ema(x: np.ndarray, alpha: np.ndarray) -> dict[str, np.ndarray]:
    """Exponential mean with a pace for each row."""
    out, y = np.full(len(x), np.nan), np.nan
    for i, (v, a) in enumerate(zip(x, alpha, strict=True)):
        if v == v:
            y = v if y != y else y + (a if a == a else 0.0) * (v - y)
        out[i] = y
    return {"y": out}


def _placed(df: DataFrame, rows: int, order: tuple[str, ...], key: str, by: Column | None) -> DataFrame:
    """df with _i, the row's number in its series; ``by`` is the chunk in which rows are numbered."""
    return chunks.numbered(df, "_i", F.floor(F.col(order[0]) / (rows * 60)).cast("long") if by is None else by, order, key)


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ewm_scan(df: DataFrame, column: str, out: str, alpha: float, adjust: bool = False, least: int = 1, rows: int = ROWS, order: tuple[str, ...] = ("bar",), key: str = "symbol", by: Column | None = None) -> DataFrame:
    """The values of ``ewm`` as a scan in chunks of so many rows."""
    df = _placed(df, rows, order, key, by)
    x = _finite(F.col(column).cast("double"))
    good, part, decay = x.isNotNull(), F.floor(F.col("_i") / rows), F.lit(1 - alpha)
    seen = (F.lit(1.0), good.cast("double"))
    if adjust:
        got = chunks.linear(df, {"_num": (decay, F.coalesce(x, F.lit(0.0))), "_den": (decay, good.cast("double")), "_seen": seen}, part, order, key)
        y = div(F.col("_num"), F.col("_den"))
    else:
        # Rows since the last value set how much of it is left.
        since = (F.when(good, 0.0).otherwise(1.0), F.lit(1.0))
        got = chunks.linear(df, {"_since": since, "_seen": seen}, part, order, key, before=True)
        old = F.pow(decay, F.col("_since_before"))
        first = F.col("_seen_before") == 0
        a = F.when(~good, 1.0).when(first, 0.0).otherwise(old / (old + alpha))
        b = F.when(~good, 0.0).when(first, x).otherwise(alpha * x / (old + alpha))
        got = chunks.linear(got, {"_y": (a, b)}, part, order, key)
        y = F.col("_y")
    return got.withColumn(out, F.when(F.col("_seen") >= max(least, 1), y)).select(*[c for c in df.columns if c not in (out, "_i")], out)


def kaufman_scan(df: DataFrame, column: str, out: str, n: int = 10, fast: int = 2, slow: int = 30, rows: int = ROWS, order: tuple[str, ...] = ("bar",), key: str = "symbol", by: Column | None = None) -> DataFrame:
    """The values of ``kaufman`` as a scan; the steps of a chunk's first rows come from the chunk before."""
    if rows <= n:
        raise ValueError("a chunk must be longer than the look-back")
    names = df.columns
    df = with_halo(_placed(df, rows, order, key, by), F.floor(F.col("_i") / rows), n + 1, (key,), order)
    s, x = Series((key, "chunk"), order), F.col(column).cast("double")
    df = df.withColumn("_step", F.abs(x - s.lag(x)))
    path, move = F.sum("_step").over(s.r(n)), F.abs(x - s.lag(x, n))
    # A missing value within the path makes it no number, and the value is missing from there on.
    path = F.when(F.count("_step").over(s.r(n)) == n, path)
    f, w = 2 / (fast + 1), 2 / (slow + 1)
    pace = F.pow(F.when(path > 0, move / path).otherwise(0.0) * (f - w) + w, 2)
    df = df.withColumn("_k", F.when(F.col("_i") >= n, pace)).filter(~F.col("halo"))
    nan = F.lit(float("nan"))
    step = (F.when(F.col("_k").isNull(), 0.0).otherwise(1 - F.col("_k")), F.coalesce(F.when(F.col("_k").isNull(), x).otherwise(F.col("_k") * x), nan))
    got = chunks.linear(df, {"_y": step}, F.floor(F.col("_i") / rows), order, key)
    return got.withColumn(out, _finite(F.col("_y"))).select(*[c for c in names if c != out], out)


def adaptive_scan(df: DataFrame, column: str, pace: str, out: str, rows: int = ROWS, order: tuple[str, ...] = ("bar",), key: str = "symbol", by: Column | None = None) -> DataFrame:
    """The values of ``adaptive_ema`` as a scan."""
    df = _placed(df, rows, order, key, by)
    x, a = _finite(F.col(column).cast("double")), F.coalesce(_finite(F.col(pace).cast("double")), F.lit(0.0))
    part, good = F.floor(F.col("_i") / rows), x.isNotNull()
    got = chunks.linear(df, {"_seen": (F.lit(1.0), good.cast("double"))}, part, order, key, before=True)
    first = F.col("_seen_before") == 0
    step = (F.when(~good, 1.0).when(first, 0.0).otherwise(1 - a), F.when(~good, 0.0).when(first, x).otherwise(a * x))
    got = chunks.linear(got, {"_y": step}, part, order, key)
    return got.withColumn(out, F.when(F.col("_seen") > 0, F.col("_y"))).select(*[c for c in df.columns if c not in (out, "_i")], out)


def kalman(x: np.ndarray, q: float | None = None, r: float | None = None, clip: bool = False) -> dict[str, np.ndarray]:
    """Local-level filter. Without q and r they come from the variance of the whole series, which looks ahead."""
    v = x[np.isfinite(x)]
    var = float(np.var(v)) if len(v) else 1.0
    q, r = (0.01 * var if q is None else q), (var if r is None else r)
    out, level, p = np.full(len(x), np.nan), np.nan, 1.0
    seen: list[float] = []
    for i, z in enumerate(x):
        if z == z:
            if clip:
                seen.append(z)
                lo, hi = np.percentile(seen, [1, 99])
                z = min(max(z, lo), hi)
            if level != level:
                level, p = z, r
            else:
                p += q
                k = p / (p + r) if p + r > 0 else 0.0
                level, p = level + k * (z - level), (1 - k) * p
        out[i] = level
    return {"y": out}


def garch(r: np.ndarray, alpha: float = 0.06, beta: float = 0.93, omega: float = 0.01) -> dict[str, np.ndarray]:
    """Variance recursion over returns, started with the variance of the first 20."""
    head = r[np.isfinite(r)][:20]
    v0 = float(np.var(head, ddof=1)) if len(head) > 1 else np.nan
    out, v = np.full(len(r), np.nan), v0
    for i, x in enumerate(r):
        out[i] = np.sqrt(v) if v == v and v >= 0 else np.nan
        if x == x and v == v:
            v = omega * v0 + alpha * x * x + beta * v
    return {"y": out}


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14, wilder: bool = False) -> dict[str, np.ndarray]:
    """Trend strength with both directional indices."""
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    prior = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - prior), np.abs(low - prior)))
    a, least = (1 / n, n) if wilder else (2 / (n + 1), 1)
    smooth = lambda v: ewm(v, a, least=least)["y"]
    atr = smooth(tr) + 1e-10
    pdi, mdi = 100 * smooth(plus) / atr, 100 * smooth(minus) / atr
    return {"adx": smooth(100 * np.abs(pdi - mdi) / (pdi + mdi + 1e-10)), "plus_di": pdi, "minus_di": mdi}


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    prior = np.concatenate([close[:1], close[:-1]])
    return {"atr": ewm(np.maximum(high - low, np.maximum(np.abs(high - prior), np.abs(low - prior))), 2 / (n + 1))["y"]}


def hurst_rs(x: np.ndarray, n: int = 200, least: int = 50, scales: tuple[int, ...] = (8, 16, 32, 64)) -> dict[str, np.ndarray]:
    """Rolling Hurst exponent: slope of the log rescaled range over log scale in the last n returns."""
    r = np.diff(np.log(x), prepend=np.nan)
    out = np.full(len(x), np.nan)
    for i in range(len(x)):
        w = r[max(0, i - n + 1) : i + 1]
        w = w[np.isfinite(w)]
        if len(w) >= least:
            out[i] = _hurst(w, scales)
    return {"hurst": out}


def _hurst(w: np.ndarray, scales: tuple[int, ...]) -> float:
    pts = []
    for m in scales:
        k = len(w) // m
        if k:
            b = w[: k * m].reshape(k, m)
            dev = np.cumsum(b - b.mean(axis=1, keepdims=True), axis=1)
            s = b.std(axis=1)
            rs = (dev.max(axis=1) - dev.min(axis=1))[s > 0] / s[s > 0]
            if len(rs):
                pts.append((np.log(m), np.log(rs.mean())))
    return float(np.polyfit(*zip(*pts, strict=True), 1)[0]) if len(pts) > 1 else np.nan


def bilateral(s: Series, x: Column, width: int, sigma_t: float, sigma_x: float) -> Column:
    """Centred filter weighted by distance in time and value. It looks ahead."""
    w = s.p.rowsBetween(-width, width)
    near = F.collect_list(F.struct(F.col("_i").alias("i"), x.alias("v"))).over(w)
    weight = lambda p: F.exp(-F.pow((p["i"] - F.col("_i")) / sigma_t, 2) / 2 - F.pow((p["v"] - x) / sigma_x, 2) / 2)
    top = F.aggregate(near, F.lit(0.0), lambda t, p: t + weight(p) * p["v"])
    return div(top, F.aggregate(near, F.lit(0.0), lambda t, p: t + weight(p)))


def polyfit_last(s: Series, x: Column, n: int, degree: int = 3) -> Column:
    """Value at the last row of a polynomial fitted to n rows: a fixed dot product, as the fit is linear in x."""
    t = np.arange(n, dtype=float)
    design = np.vander(t, degree + 1)
    weights = design[-1] @ np.linalg.pinv(design)
    a = F.collect_list(x).over(s.r(n))
    dot = F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in weights]), lambda v, u: v * u), F.lit(0.0), lambda q, v: q + v)
    return F.when(F.size(a) == n, dot)


def rolling_slope(s: Series, x: Column, n: int) -> Column:
    """Slope of x on the row number; the row number is a column _i."""
    return F.when(F.count(x).over(s.r(n)) >= n, F.regr_slope(x, F.col("_i")).over(s.r(n)))


def delta_threshold(df: DataFrame, column: str, n: int, k: float, method: str = "mad", s: Series | None = None, fill_ahead: bool = False) -> DataFrame:
    """Threshold of a delta from its own past: mad, std or q75; carried forward (and back, if asked to look ahead)."""
    s = s or Series(order=("bar",))
    x = F.abs(F.col(column))
    if method == "mad":
        df = df.withColumn("_m", s.quantile(F.col(column), 0.5, n, max(2, n // 4))).withColumn("_a", F.abs(F.col(column) - F.col("_m")))
        t = s.quantile(F.col("_a"), 0.5, n, max(2, n // 4)) * k
    elif method == "std":
        t = s.std(F.col(column), n, max(2, n // 4)) * k
    elif method == "q75":
        t = s.quantile(x, 0.75, n, max(2, n // 4)) * k
    else:
        raise ValueError(f"no method {method}")
    df = df.withColumn("threshold", t).withColumn("threshold", s.ffill(F.col("threshold")))
    if fill_ahead:
        df = df.withColumn("threshold", s.bfill(F.col("threshold")))
    return df.drop("_m", "_a")


def robust_z(df: DataFrame, column: str, n: int, s: Series | None = None) -> DataFrame:
    """Rolling z-score by mean and deviation, and by median and 1.4826 MAD."""
    s = s or Series(order=("bar",))
    x = F.col(column)
    df = df.withColumn("demeaned", x - s.mean(x, n, max(2, n // 4))).withColumn("z", F.col("demeaned") / (s.std(x, n, max(2, n // 4)) + 1e-12))
    df = df.withColumn("_m", s.quantile(x, 0.5, n, max(2, n // 4))).withColumn("_a", F.abs(x - F.col("_m")))
    return df.withColumn("mad_z", (x - F.col("_m")) / (1.4826 * s.quantile(F.col("_a"), 0.5, n, max(2, n // 4)) + 1e-12)).drop("_m", "_a")
