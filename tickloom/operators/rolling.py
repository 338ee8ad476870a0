"""Operators of the factor language: columns in, a column out.

x and y are columns of a series s; d counts rows, this one included. Each operator
says how many values a frame must have. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.windows import Series, div, paired

EPS = 1e-12


def delay(s: Series, x: Column, d: int) -> Column:
    return s.lag(x, d)


def delta(s: Series, x: Column, d: int) -> Column:
    return x - s.lag(x, d)


def ts_mean(s: Series, x: Column, d: int) -> Column:
    return s.mean(x, d, max(1, d // 2))


def ts_stddev(s: Series, x: Column, d: int) -> Column:
    return s.std(x, d, max(2, d // 2))


def ts_sum(s: Series, x: Column, d: int) -> Column:
    return s.total(x, d, 1)


def ts_product(s: Series, x: Column, d: int) -> Column:
    """Product of values clipped at 1e-20, by logarithms."""
    return F.exp(s.total(F.log(F.greatest(x, F.lit(1e-20))), d, d))


def ts_corr(s: Series, x: Column, y: Column, d: int) -> Column:
    return s.corr(x, y, d, max(3, d // 2))


def ts_cov(s: Series, x: Column, y: Column, d: int) -> Column:
    return s.cov(x, y, d, max(3, d // 2))


def ts_min(s: Series, x: Column, d: int) -> Column:
    return s.low(x, d, 1)


def ts_max(s: Series, x: Column, d: int) -> Column:
    return s.high(x, d, 1)


def _frame(s: Series, x: Column, d: int) -> Column:
    """Values of the frame, oldest first; NULL if one is missing."""
    w = s.r(d)
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), F.collect_list(x).over(w))


def ts_argmin(s: Series, x: Column, d: int) -> Column:
    """d - 1 - place of the first minimum; a partial frame counts from d as a full one."""
    a = _frame(s, x, d)
    return F.lit(d) - F.array_position(a, F.array_min(a))


def ts_argmax(s: Series, x: Column, d: int) -> Column:
    a = _frame(s, x, d)
    return F.lit(d) - F.array_position(a, F.array_max(a))


def ts_rank(s: Series, x: Column, d: int, least: int | None = None) -> Column:
    """Average rank of the last value in its frame, as a share."""
    a = _frame(s, x, d)
    less = F.size(F.filter(a, lambda v: v < x))
    same = F.size(F.filter(a, lambda v: v == x))
    n = F.size(a)
    return F.when(n >= (max(2, d // 2) if least is None else least), (less + (same + 1) / 2) / n)


def decay_linear(s: Series, x: Column, d: int) -> Column:
    """Mean with weights 1 .. n, the newest n."""
    a = _frame(s, x, d)
    n = F.size(a)
    top = F.aggregate(F.arrays_zip(a.alias("v"), F.sequence(F.lit(1), n).alias("w")), F.lit(0.0), lambda t, p: t + p["v"] * p["w"])
    return F.when(n >= 1, top / (n * (n + 1) / 2))


def decay_exp(s: Series, x: Column, d: int, factor: float = 0.5) -> Column:
    """Mean with weights factor^age."""
    a = _frame(s, x, d)
    top = F.aggregate(a, F.lit(0.0), lambda t, v: t * factor + v)
    low = F.aggregate(a, F.lit(0.0), lambda t, v: t * factor + F.lit(1.0))
    return div(top, low)


def ts_skew(s: Series, x: Column, d: int) -> Column:
    return s.skew(x, d, max(3, d // 2))


def ts_kurt(s: Series, x: Column, d: int) -> Column:
    return s.kurt(x, d, max(4, d // 2))


def ts_median(s: Series, x: Column, d: int) -> Column:
    return s.quantile(x, 0.5, d, 1)


def ts_entropy(s: Series, x: Column, d: int, bins: int = 10) -> Column:
    """Shannon entropy (nats) over equal bins of the frame; 0 for fewer than 3 values or one value only."""
    w = s.r(d)
    a = F.collect_list(x).over(w)
    lo, hi, n = F.array_min(a), F.array_max(a), F.size(a)
    place = lambda v: F.least(F.lit(bins - 1), F.floor(div(v - lo, hi - lo) * bins))
    at = F.transform(a, place)
    part = lambda k: F.size(F.filter(at, lambda b: b == k)) / n
    total = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda t, k: t - F.when(part(k) > 0, part(k) * F.log(part(k))).otherwise(0.0))
    enough = F.count(x).over(w) >= max(1, d // 2)
    return F.when(enough, F.when((n < 3) | (lo == hi), 0.0).otherwise(total))


def signedpower(s: Series, x: Column, a: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(a))


def log1p_safe(s: Series, x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def abs_val(s: Series, x: Column) -> Column:
    return F.abs(x)


def ts_zscore(s: Series, x: Column, d: int) -> Column:
    return (x - ts_mean(s, x, d)) / (ts_stddev(s, x, d) + EPS)


def ts_returns(s: Series, x: Column, d: int = 1) -> Column:
    """Relative change of the forward-filled series."""
    y = s.ffill(x)
    return div(y, s.lag(y, d)) - 1


def ts_acceleration(s: Series, x: Column, d: int) -> Column:
    return x - 2 * s.lag(x, d) + s.lag(x, 2 * d)


def ts_momentum(s: Series, x: Column, d: int) -> Column:
    return div(x, s.lag(x, d)) - 1


def ts_range(s: Series, x: Column, d: int) -> Column:
    return ts_max(s, x, d) - ts_min(s, x, d)


def ts_cv(s: Series, x: Column, d: int) -> Column:
    return ts_stddev(s, x, d) / (F.abs(ts_mean(s, x, d)) + EPS)


def ts_autocorr(s: Series, x: Column, d: int, lag: int = 1) -> Column:
    return s.corr(x, s.lag(x, lag), d, max(3, d // 2))


def _ols(s: Series, y: Column, x: Column, d: int) -> dict[str, Column]:
    """Slope, intercept, residual and r2 of y on x over complete pairs of a full frame."""
    b, a = paired(y, x)
    w = s.r(d)
    n = F.count(a).over(w)
    sxx, sxy, syy = F.regr_sxx(b, a).over(w), F.regr_sxy(b, a).over(w), F.regr_syy(b, a).over(w)
    good = (s.index() >= d) & (n >= max(3, d // 2)) & (sxx >= 1e-20)
    slope = F.when(good, div(sxy, sxx))
    level = F.avg(b).over(w) - slope * F.avg(a).over(w)
    rest = syy - slope * sxy
    return {"beta": slope, "alpha": level, "residual": y - (level + slope * x), "r2": 1 - rest / (syy + 1e-20)}


def ts_reg_beta(s: Series, y: Column, x: Column, d: int) -> Column:
    return _ols(s, y, x, d)["beta"]


def ts_reg_alpha(s: Series, y: Column, x: Column, d: int) -> Column:
    return _ols(s, y, x, d)["alpha"]


def ts_reg_residual(s: Series, y: Column, x: Column, d: int) -> Column:
    return _ols(s, y, x, d)["residual"]


def ts_reg_r2(s: Series, y: Column, x: Column, d: int) -> Column:
    return _ols(s, y, x, d)["r2"]


#: name -> (function, series it takes, rows it looks back for a parameter d)
REGISTRY = {
    **{f.__name__: (f, 1, lambda d: d) for f in (delay, delta)},
    **{
        f.__name__: (f, 1, lambda d: d - 1)
        for f in (ts_mean, ts_stddev, ts_sum, ts_product, ts_min, ts_max, ts_argmin, ts_argmax, ts_rank, decay_linear, decay_exp, ts_skew, ts_kurt, ts_median, ts_entropy, ts_zscore, ts_range, ts_cv)
    },
    **{f.__name__: (f, 1, lambda d: 0) for f in (signedpower, log1p_safe, abs_val)},
    **{f.__name__: (f, 1, lambda d: d) for f in (ts_returns, ts_momentum, ts_autocorr)},
    "ts_acceleration": (ts_acceleration, 1, lambda d: 2 * d),
    **{f.__name__: (f, 2, lambda d: d - 1) for f in (ts_corr, ts_cov, ts_reg_beta, ts_reg_alpha, ts_reg_residual, ts_reg_r2)},
}
