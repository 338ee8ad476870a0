"""Registered queries of the engine over the driver's tables, with DuckDB SQL where it can say the same.

Doubles are rounded to 6 digits on both sides, as the engines add in different orders; a
billionth more keeps exact halves, which the engines round differently, off the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import windows
from tickloom.operators import bars as br
from tickloom.operators import evaluate as ev
from tickloom.operators import features as ft
from tickloom.operators import indicators as ind
from tickloom.operators import joins as jn
from tickloom.operators import labels as lb
from tickloom.operators import metrics as mt
from tickloom.operators import signals as sg
from tickloom.operators import simulate as sim
from tickloom.operators import smoothers as sm
from tickloom.operators import spectrum as sp
from tickloom.plans import scans
from tickloom.plans.expressions import evaluate
from tickloom.schema import book_of_embeddings, tape_of_events
from tickloom.windows import Series, div

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col
S = Series(order=("bar",))
SEC = 21600

TAPE_SQL = """tape AS (SELECT user_id % 10 AS symbol, ts, event_id AS seq, 100 + value / 100 AS price, (1 + k)::DOUBLE AS qty, (100 + value / 100) * (1 + k) AS notional,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side, CASE WHEN k % 4 <> 0 THEN 4 * rn ELSE 4 * rn + 1 END AS first_id, 4 * rn + 3 AS last_id,
  1 + k % 3 AS n_fills, epoch_us(ts) AS us FROM (SELECT *, regexp_extract(props, '-?[0-9]+')::BIGINT AS k, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn FROM events))"""
OHLC_SQL = """arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume, count(*) AS n_trades,
  coalesce(sum(qty) FILTER (side = 'buy'), 0) AS buy_volume, sum(qty) - coalesce(sum(qty) FILTER (side = 'buy'), 0) AS sell_volume"""
BARS_SQL = f"""{TAPE_SQL}, bars AS (SELECT symbol, us // {SEC * 1000000} * {SEC} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL)"""
FIELDS_SQL = f"""{BARS_SQL}, f AS (SELECT symbol, bar, close AS x, (buy_volume - sell_volume) / volume AS y, close / 100 AS z FROM bars)"""


def tape(spark: SparkSession, d: str) -> DataFrame:
    return tape_of_events(spark.read.parquet(f"{d}/events.parquet"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return br.time_bars(tape(spark, d), SEC)


def book(spark: SparkSession, d: str) -> DataFrame:
    return book_of_embeddings(spark.read.parquet(f"{d}/embeddings.parquet"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c(n) + 1e-9, 6) + 0.0).alias(n) if t in ("double", "float") else c(n) for n, t in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE + 1e-9, 6) + 0.0 AS {name}"


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(f(spark, d))
    if sql is not None:
        ORACLE_SQL[name] = sql


def w(d: int, by: str = "bar") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY {by} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def at_least(n: int, x: str, d: int, value: str, by: str = "bar") -> str:
    return f"CASE WHEN count({x}) {w(d, by)} >= {n} THEN {value} {w(d, by)} END"


P = "OVER (PARTITION BY symbol ORDER BY bar)"
LIST = f"list(x) {w(10)}"
CORR = lambda a, b, d, n: f"CASE WHEN count({a}) {w(d)} >= {n} AND min({a}) {w(d)} < max({a}) {w(d)} AND min({b}) {w(d)} < max({b}) {w(d)} THEN corr({a}, {b}) {w(d)} END"
OLS = f"row_number() {P} >= 10 AND regr_sxx(x, y) {w(10)} >= 1e-20"
MEAN, STD = at_least(5, "x", 10, "avg(x)"), at_least(5, "x", 10, "stddev_samp(x)")
#: name -> (expression, SQL over x, y, z and the list l of the last 10 x)
ROLLING = {
    "delay": ("delay(x, 10)", f"lag(x, 10) {P}"),
    "delta": ("delta(x, 10)", f"x - lag(x, 10) {P}"),
    "ts_mean": ("ts_mean(x, 10)", MEAN),
    "ts_stddev": ("ts_stddev(x, 10)", STD),
    "ts_sum": ("ts_sum(x, 10)", f"sum(x) {w(10)}"),
    "ts_product": ("ts_product(z, 10)", at_least(10, "z", 10, "exp(sum(ln(greatest(z, 1e-20)))").replace(f" {w(10)} END", f" {w(10)}) END")),
    "ts_corr": ("ts_corr(x, y, 10)", CORR("x", "y", 10, 5)),
    "ts_cov": ("ts_cov(x, y, 10)", at_least(5, "x", 10, "covar_samp(x, y)")),
    "ts_min": ("ts_min(x, 10)", f"min(x) {w(10)}"),
    "ts_max": ("ts_max(x, 10)", f"max(x) {w(10)}"),
    "ts_argmin": ("ts_argmin(x, 10)", "10 - list_position(l, list_min(l))"),
    "ts_argmax": ("ts_argmax(x, 10)", "10 - list_position(l, list_max(l))"),
    "ts_rank": ("ts_rank(x, 10)", "CASE WHEN len(l) >= 5 THEN (len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2) / len(l) END"),
    "decay_linear": ("decay_linear(x, 10)", "list_sum(list_transform(l, lambda v, i: v * i)) / (len(l) * (len(l) + 1) / 2)"),
    "decay_exp": ("decay_exp(x, 10, 0.5)", "list_sum(list_transform(l, lambda v, i: v * 0.5 ** (len(l) - i))) / list_sum(list_transform(l, lambda v, i: 0.5 ** (len(l) - i)))"),
    "ts_skew": ("ts_skew(x, 10)", at_least(5, "x", 10, "skewness(x)")),
    "ts_kurt": ("ts_kurt(x, 10)", at_least(5, "x", 10, "kurtosis(x)")),
    "ts_median": ("ts_median(x, 10)", f"quantile_cont(x, 0.5) {w(10)}"),
    "ts_entropy": (
        "ts_entropy(x, 10)",
        "CASE WHEN len(l) >= 5 THEN list_sum(list_transform(range(10), lambda k: CASE WHEN len(list_filter(l, lambda v: least(9, floor((v - list_min(l)) / (list_max(l) - list_min(l)) * 10)) = k)) > 0 "
        "THEN -(len(list_filter(l, lambda v: least(9, floor((v - list_min(l)) / (list_max(l) - list_min(l)) * 10)) = k)) / len(l)) * ln(len(list_filter(l, lambda v: least(9, floor((v - list_min(l)) / (list_max(l) - list_min(l)) * 10)) = k)) / len(l)) ELSE 0 END)) END",
    ),
    "signedpower": ("signedpower(y, 2)", "sign(y) * abs(y) ** 2"),
    "log1p_safe": ("log1p_safe(y)", "sign(y) * ln(1 + abs(y))"),
    "abs_val": ("abs_val(y)", "abs(y)"),
    "ts_zscore": ("ts_zscore(x, 10)", f"(x - {MEAN}) / ({STD} + 1e-12)"),
    "ts_returns": ("ts_returns(x, 5)", f"x / lag(x, 5) {P} - 1"),
    "ts_acceleration": ("ts_acceleration(x, 3)", f"x - 2 * lag(x, 3) {P} + lag(x, 6) {P}"),
    "ts_momentum": ("ts_momentum(x, 5)", f"x / lag(x, 5) {P} - 1"),
    "ts_range": ("ts_range(x, 10)", f"max(x) {w(10)} - min(x) {w(10)}"),
    "ts_cv": ("ts_cv(x, 10)", f"{STD} / (abs({MEAN}) + 1e-12)"),
    "ts_autocorr": ("ts_autocorr(x, 10)", f"CASE WHEN count(x1) {w(10)} >= 5 THEN corr(CASE WHEN x1 IS NOT NULL THEN x END, x1) {w(10)} END"),
    "ts_reg_beta": ("ts_reg_beta(x, y, 10)", f"CASE WHEN {OLS} THEN regr_slope(x, y) {w(10)} END"),
    "ts_reg_alpha": ("ts_reg_alpha(x, y, 10)", f"CASE WHEN {OLS} THEN regr_intercept(x, y) {w(10)} END"),
    "ts_reg_residual": ("ts_reg_residual(x, y, 10)", f"CASE WHEN {OLS} THEN x - regr_intercept(x, y) {w(10)} - regr_slope(x, y) {w(10)} * y END"),
    "ts_reg_r2": ("ts_reg_r2(x, y, 10)", f"CASE WHEN {OLS} THEN regr_r2(x, y) {w(10)} END"),
    "nested_rank_of_mean": ("ts_zscore(ts_mean(delta(x, 2), 3), 10)", None),
    "nested_decay_of_corr": ("delta(ts_corr(x, y, 10), 5)", None),
}


def fields(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return b.select("symbol", "bar", c("close").alias("x"), ((c("buy_volume") - c("sell_volume")) / c("volume")).alias("y"), (c("close") / 100).alias("z"))


for _name, (_text, _sql) in ROLLING.items():
    register(
        f"factor_{_name}",
        lambda spark, d, text=_text: evaluate(fields(spark, d), {"value": text}, S, keep=["symbol", "bar"]),
        _sql and f"WITH {FIELDS_SQL}, g AS (SELECT *, {LIST} AS l, lag(x) {P} AS x1 FROM f) SELECT symbol, bar, {r(_sql, 'value')} FROM g",
    )
ORACLE_SQL["factor_nested_rank_of_mean"] = f"""WITH {FIELDS_SQL}, a AS (SELECT symbol, bar, x - lag(x, 2) {P} AS u FROM f),
b AS (SELECT symbol, bar, {at_least(1, "u", 3, "avg(u)")} AS x FROM a) SELECT symbol, bar, {r(f"(x - {MEAN}) / ({STD} + 1e-12)", "value")} FROM b"""
ORACLE_SQL["factor_nested_decay_of_corr"] = f"""WITH {FIELDS_SQL}, a AS (SELECT symbol, bar, {CORR("x", "y", 10, 5)} AS u FROM f) SELECT symbol, bar, {r(f"u - lag(u, 5) {P}", "value")} FROM a"""

# --- bars and orders ------------------------------------------------------------------------------
B_COLS = ", ".join(r(x, x) for x in ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume")) + ", n_trades"
register("bars_time", bars, f"WITH {BARS_SQL} SELECT symbol, bar, {B_COLS} FROM bars")


def event_bars_sql(ids: str) -> str:
    return f"""WITH {TAPE_SQL}, t AS ({ids}), b AS (SELECT symbol, bar_id, min(us) AS first_us, {OHLC_SQL}, greatest((max(us) - min(us)) / 1e6, 0.001) AS bar_duration_sec FROM t GROUP BY ALL)
SELECT symbol, bar_id, first_us, {B_COLS}, {r("bar_duration_sec", "bar_duration_sec")} FROM b"""


def event_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("first_us", F.unix_micros("ts")).drop("ts")


register("bars_count", lambda s, d: event_bars(br.count_bars(tape(s, d), 40)), event_bars_sql("SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 40 AS bar_id FROM tape"))
register(
    "bars_volume",
    lambda s, d: event_bars(br.volume_bars(tape(s, d), 2000)),
    event_bars_sql(
        """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM tape),
  v AS (SELECT symbol, i, qty AS acc, 0::BIGINT AS bar_id FROM n WHERE i = 1 UNION ALL
        SELECT n.symbol, n.i, CASE WHEN v.acc >= 2000 THEN n.qty ELSE v.acc + n.qty END, v.bar_id + CASE WHEN v.acc >= 2000 THEN 1 ELSE 0 END FROM v JOIN n ON n.symbol = v.symbol AND n.i = v.i + 1)
  SELECT n.*, v.bar_id FROM n JOIN v USING (symbol, i)"""
    ),
)
register(
    "bars_volume_carried",
    lambda s, d: event_bars(br.volume_bars(tape(s, d), 2000, carry=True)),
    event_bars_sql("SELECT *, floor(coalesce(sum(qty) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000)::BIGINT AS bar_id FROM tape"),
)
GAP = 3_600_000
MERGE_SQL = f"""{TAPE_SQL}, g0 AS (SELECT *, lag(side) OVER o AS ps, lag(last_id) OVER o AS pl, lag(us) OVER o AS pu, lag(price) OVER o AS pp FROM tape WINDOW o AS (PARTITION BY symbol ORDER BY ts, seq)),
g AS (SELECT *, sum(CASE WHEN side = ps AND first_id = pl + 1 AND (us - pu) // 1000 < {GAP} AND (CASE WHEN side = 'buy' THEN price >= pp ELSE price <= pp END) THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS grp FROM g0),
m AS (SELECT symbol, min(ts) AS ts, min(us) AS us, min(seq) AS seq, sum(qty) AS qty, any_value(side) AS side, sum(notional) AS notional, sum(n_fills)::BIGINT AS n_fills, count(*) AS n_raw_trades,
  arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price, min(first_id) AS first_id, max(last_id) AS last_id, max(price) - min(price) AS price_range, sum(notional) / (sum(qty) + 1e-15) AS price FROM g GROUP BY symbol, grp)"""


def merged(s: SparkSession, d: str) -> DataFrame:
    return br.merge_trades(tape(s, d), GAP)


register("merge_trades", lambda s, d: merged(s, d).drop("ts"), f"WITH {MERGE_SQL} SELECT symbol, seq, side, n_fills, n_raw_trades, first_id, last_id, {', '.join(r(x, x) for x in ('qty', 'notional', 'first_price', 'last_price', 'price_range', 'price'))} FROM m")
TAKER_SQL = f"""{TAPE_SQL}, t0 AS (SELECT *, lag(side) OVER o AS ps, lag(last_id) OVER o AS pl FROM tape WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
t1 AS (SELECT *, sum(CASE WHEN side = ps AND first_id = pl + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY seq)::BIGINT AS taker_id FROM t0),
o AS (SELECT symbol, taker_id, count(*) AS levels_swept, sum(qty) AS total_volume, sum(notional) AS total_cost, sum(n_fills)::BIGINT AS total_fills, avg(n_fills) AS fills_per_level_mean,
  coalesce(stddev_samp(n_fills), 0) AS fills_per_level_std, min(us) AS us, any_value(side) AS side, arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price, (max(us) - min(us)) / 1000.0 AS duration_ms,
  arg_max(qty, seq) / (arg_min(qty, seq) + 1e-10) AS volume_taper FROM t1 GROUP BY ALL),
taker AS (SELECT *, total_cost / total_volume AS vwap, last_price - first_price AS price_impact, (last_price - first_price) / first_price * 100 AS price_impact_pct,
  abs(last_price - first_price) / (total_volume + 1e-10) AS impact_per_volume, abs(last_price - first_price) / levels_swept AS impact_per_level FROM o)"""
T_COLS = ("total_volume", "total_cost", "fills_per_level_mean", "fills_per_level_std", "first_price", "last_price", "duration_ms", "volume_taper", "vwap", "price_impact", "price_impact_pct", "impact_per_volume", "impact_per_level")
register("taker_orders", lambda s, d: br.taker_orders(tape(s, d)).drop("ts"), f"WITH {TAKER_SQL} SELECT symbol, taker_id, side, levels_swept, total_fills, {', '.join(r(x, x) for x in T_COLS)} FROM taker")


def side_sql(side: str, f: Callable[[str, str], str]) -> str:
    dist = "price - first_price" if side == "buy" else "first_price - price"
    on, multi, single = f"FILTER (side = '{side}')", f"FILTER (side = '{side}' AND n_raw_trades > 1)", f"FILTER (side = '{side}' AND n_raw_trades <= 1)"
    slope = lambda y: f"CASE WHEN count(*) {on} >= 3 AND var_pop(ln(qty)) {on} >= 1e-15 THEN covar_pop({y}, ln(qty)) {on} / var_pop(ln(qty)) {on} ELSE 0 END"
    parts = {
        "vwap_dist_sum": f"coalesce(sum({dist}) {on}, 0)",
        "mf_volume": f"coalesce(sum(qty) {multi}, 0)",
        "off_top_cost": f"coalesce(sum(notional - first_price * qty) {multi}, 0)",
        "mf_log_median_ratio": f"coalesce(ln(median(qty) {multi}) - ln(median(qty) {single}), 0)",
        "vwap_dist_beta": slope(dist),
        "price_range_beta": slope("price_range"),
        "volume_skew": f"CASE WHEN count(*) {on} >= 3 AND max(qty) {on} > min(qty) {on} THEN skewness(qty) {on} ELSE 0 END",
    }
    return f"count(*) {on} AS {side}_count, count(*) {multi} AS {side}_mf_count, " + ", ".join(f(v, f"{side}_{k}") for k, v in parts.items())


def merged_agg(f: Callable[[str, str], str]) -> str:
    """SQL of the aggregates of merged orders; f gives each expression its name."""
    plain = {
        "open": "arg_min(price, seq)",
        "high": "max(price)",
        "low": "min(price)",
        "close": "arg_max(price, seq)",
        "volume": "sum(qty)",
        "buy_volume": "coalesce(sum(qty) FILTER (side = 'buy'), 0)",
        "sell_volume": "sum(qty) - coalesce(sum(qty) FILTER (side = 'buy'), 0)",
        "value": "sum(notional)",
        "weighted_vwap_dist": "sum((price - first_price) * qty)",
    }
    return f"{', '.join(f(x, n) for n, x in plain.items())}, count(*) AS n_trades, {side_sql('buy', f)}, {side_sql('sell', f)}"


MERGED_AGG = merged_agg(r)
MERGED_RAW = merged_agg(lambda x, n: f"{x} AS {n}")
DAY = 86400
register("bars_merged_time", lambda s, d: br.merged_time_bars(merged(s, d), DAY), f"WITH {MERGE_SQL} SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {MERGED_AGG} FROM m GROUP BY ALL")
register("bars_merged_count", lambda s, d: br.merged_count_bars(merged(s, d), 30).drop("ts", "bar_duration_sec"), f"WITH {MERGE_SQL}, i AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 30 AS bar_id FROM m) SELECT symbol, bar_id, {MERGED_AGG} FROM i GROUP BY ALL")
register("bars_merged_volume", lambda s, d: br.merged_volume_bars(merged(s, d), 3000).drop("ts"))
register("bars_average_seconds", lambda s, d: br.average_bar_seconds(br.count_bars(tape(s, d), 40)))
register("bars_volume_threshold", lambda s, d: br.volume_threshold(tape(s, d), 40, [0.5, 1.0, 2.0]))
register("bars_comparison", lambda s, d: br.compare_bars({"time": bars(s, d), "count": br.count_bars(tape(s, d), 40)}))
BIN = f"us // {SEC * 1000000} * {SEC} AS bar"
register(
    "tick_stats",
    lambda s, d: br.tick_stats(tape(s, d), SEC),
    f"""WITH {TAPE_SQL}, a AS (SELECT *, {BIN} FROM tape), l AS (SELECT *, qty > 2 * avg(qty) OVER (PARTITION BY symbol, bar) AS large FROM a),
g AS (SELECT symbol, bar, count(DISTINCT price) AS n_prices, max(qty) AS max_trade, avg(qty) AS mean_trade, coalesce(stddev_samp(qty) / avg(qty), 0) AS size_cv, (arg_max(price, seq) / (sum(notional) / sum(qty)) - 1) * 1e4 AS vwap_dev_bps,
  coalesce(avg(qty) FILTER (side = 'buy'), 0) AS b, coalesce(avg(qty) FILTER (side = 'sell'), 0) AS s, avg(large::INT) AS large_trade_pct, (max(price) - min(price)) / count(*) AS range_per_trade, count(*) AS n_trades FROM l GROUP BY ALL)
SELECT symbol, bar, n_prices, n_trades, {", ".join(r(x, x) for x in ("max_trade", "mean_trade", "size_cv", "vwap_dev_bps", "large_trade_pct", "range_per_trade"))}, {r("b", "buy_avg_size")}, {r("s", "sell_avg_size")}, {r("(b - s) / (b + s)", "size_imbalance")} FROM g""",
)
register("fill_size", lambda s, d: br.fill_size(tape(s, d), SEC), f"WITH {TAPE_SQL} SELECT symbol, {BIN}, {r('avg(qty / greatest(n_fills, 1))', 'avg_fill_size')} FROM tape GROUP BY ALL")
register(
    "level_profile",
    lambda s, d: br.level_profile(tape(s, d), DAY),
    f"""WITH {TAPE_SQL}, a AS (SELECT *, us // {DAY * 1000000} * {DAY} AS bar FROM tape), e AS (SELECT *, min(price) OVER (PARTITION BY symbol, bar) AS lo, max(price) OVER (PARTITION BY symbol, bar) AS hi FROM a),
l AS (SELECT symbol, bar, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE least(4, floor((price - lo) / (hi - lo) * 5)) END AS level, sum(qty) AS v, avg(qty / greatest(n_fills, 1)) AS fill FROM e GROUP BY ALL),
h AS (SELECT *, v / sum(v) OVER (PARTITION BY symbol, bar) AS share FROM l)
SELECT symbol, bar, {r("sum(share * share)", "hhi")}, {r("max(share)", "top_share")}, {r("arg_max(fill, v * 10 - level)", "top_fill")}, count(*) AS active_levels FROM h GROUP BY symbol, bar""",
)
register(
    "side_runs",
    lambda s, d: br.side_runs(tape(s, d), SEC),
    f"""WITH {TAPE_SQL}, a AS (SELECT *, {BIN}, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY ts, seq) THEN 0 ELSE 1 END AS turn FROM tape),
b AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY ts, seq) AS run FROM a), l AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS n FROM b) SELECT symbol, bar, {r("avg(n)", "mean_run")} FROM l GROUP BY ALL""",
)
register("intensity", lambda s, d: br.intensity(tape(s, d), SEC), f"WITH {TAPE_SQL} SELECT symbol, {BIN}, count(*) AS n_trades, sum(n_fills)::BIGINT AS n_fills, {r('avg(n_fills)', 'avg_fills')}, {r(f'count(*) / {SEC}', 'trade_rate')} FROM tape GROUP BY ALL")
register(
    "vwap_deviation",
    lambda s, d: br.vwap_deviation(tape(s, d), SEC),
    f"""WITH {TAPE_SQL}, b AS (SELECT symbol, {BIN}, sum(notional) / sum(qty) AS vwap, arg_max(price, seq) AS close FROM tape GROUP BY ALL)
SELECT symbol, bar, {r("vwap", "vwap")}, {r("close", "close")}, {r("(close - vwap) / (close + 1e-10) * 100", "vwap_dev")}, {r(f"(vwap / lag(vwap) {P} - 1) * 100", "vwap_change")} FROM b""",
)
register("primitives", lambda s, d: br.primitives(tape(s, d), SEC))
register(
    "dedup_last",
    lambda s, d: windows.dedup_last(s.read.parquet(f"{d}/lineitem.parquet").select(c("l_suppkey").alias("symbol"), c("l_shipdate").cast("timestamp").alias("ts"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), (c("l_extendedprice") / c("l_quantity")).alias("price"))).drop("ts"),
    f"SELECT l_suppkey AS symbol, l_orderkey * 10 + l_linenumber AS seq, {r('l_extendedprice / l_quantity', 'price')} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1",
)
register(
    "bars_of_lineitem",
    lambda s, d: br.time_bars(s.read.parquet(f"{d}/lineitem.parquet").select((c("l_suppkey") % 20).alias("symbol"), c("l_shipdate").cast("timestamp").alias("ts"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").cast("double").alias("qty"), F.when(c("l_returnflag") == "R", "buy").otherwise("sell").alias("side")), 30 * DAY),
    f"""WITH tape AS (SELECT l_suppkey % 20 AS symbol, epoch_us(l_shipdate) AS us, l_orderkey * 10 + l_linenumber AS k, l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS qty, CASE WHEN l_returnflag = 'R' THEN 'buy' ELSE 'sell' END AS side FROM lineitem),
t AS (SELECT *, us * 1000000::HUGEINT * 1000 + k AS seq FROM tape), bars AS (SELECT symbol, us // {30 * DAY * 1000000} * {30 * DAY} AS bar, {OHLC_SQL} FROM t GROUP BY ALL) SELECT symbol, bar, {B_COLS} FROM bars""",
)

# --- joins ----------------------------------------------------------------------------------------


def events_at(s: SparkSession, d: str) -> DataFrame:
    t = tape(s, d)
    return t.filter("qty > 95").select("symbol", (F.unix_micros("ts") / 1e6).alias("at"), c("seq").alias("event_id"))


EVENTS_SQL = f"{TAPE_SQL}, e AS (SELECT symbol, us / 1e6 AS at, seq AS event_id FROM tape WHERE qty > 95)"
register(
    "join_asof_backward",
    lambda s, d: jn.asof(events_at(s, d), tape(s, d).filter("side = 'sell'").select("symbol", (F.unix_micros("ts") / 1e6).alias("at"), "price", "qty"), "at", ["symbol"], ["price", "qty"]),
    f"WITH {EVENTS_SQL}, q AS (SELECT symbol, us / 1e6 AS at, price, qty FROM tape WHERE side = 'sell') SELECT e.symbol, {r('e.at', 'at')}, event_id, {r('price', 'price')}, {r('qty', 'qty')} FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.at >= q.at",
)
register(
    "join_asof_forward",
    lambda s, d: jn.asof(events_at(s, d), tape(s, d).filter("side = 'sell'").select("symbol", (F.unix_micros("ts") / 1e6).alias("at"), "price"), "at", ["symbol"], ["price"], forward=True, fallback_last=True),
    f"""WITH {EVENTS_SQL}, q AS (SELECT symbol, us / 1e6 AS at, price FROM tape WHERE side = 'sell'), z AS (SELECT symbol, arg_max(price, q.at) AS last_price FROM q GROUP BY symbol)
SELECT e.symbol, {r('e.at', 'at')}, event_id, {r('coalesce(q.price, last_price)', 'price')} FROM e JOIN z USING (symbol) ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.at <= q.at""",
)
register(
    "join_interval",
    lambda s, d: jn.interval(events_at(s, d), tape(s, d).select("symbol", (F.unix_micros("ts") / 1e6).alias("t"), "qty", "price"), ["symbol"], "t", c("at") - 3600, c("at") + 3600, 7200.0).groupBy("symbol", "event_id").agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.max("price").alias("high")),
    f"WITH {EVENTS_SQL} SELECT e.symbol, event_id, count(*) AS n, {r('sum(qty)', 'volume')}, {r('max(price)', 'high')} FROM e JOIN tape t ON t.symbol = e.symbol AND t.us / 1e6 >= e.at - 3600 AND t.us / 1e6 < e.at + 3600 GROUP BY ALL",
)
register("join_semi_days", lambda s, d: jn.keep_days(bars(s, d), bars(s, d).filter("volume > 800").select("symbol", "bar"), ["symbol", "bar"]), f"WITH {BARS_SQL} SELECT symbol, bar, {B_COLS} FROM bars WHERE volume > 800")
register("join_anti_days", lambda s, d: jn.keep_days(bars(s, d), bars(s, d).filter("volume > 800").select("symbol", "bar"), ["symbol", "bar"], drop=True), f"WITH {BARS_SQL} SELECT symbol, bar, {B_COLS} FROM bars WHERE volume <= 800")
register("features_around_events", lambda s, d: ft.around(events_at(s, d), tape(s, d), 7200, 3600).drop("at"))
register(
    "features_indicator_stats",
    lambda s, d: ft.indicator_stats(events_at(s, d), tape(s, d).select("symbol", (F.unix_micros("ts") / 1e6).alias("t"), "price"), "price", 7200, 3600).drop("pre_trend"),
    f"""WITH {EVENTS_SQL}, h AS (SELECT e.symbol, event_id, t.us / 1e6 < e.at AS pre, t.us, t.price FROM e JOIN tape t ON t.symbol = e.symbol AND t.us / 1e6 BETWEEN e.at - 7200 AND e.at + 3600),
g AS (SELECT symbol, event_id, avg(price) FILTER (pre) AS a, stddev_samp(price) FILTER (pre) AS b, arg_max(price, us) FILTER (pre) AS l, max(price) FILTER (pre) AS hi, min(price) FILTER (pre) AS lo, avg(price) FILTER (NOT pre) AS p, arg_min(price, us) FILTER (NOT pre) AS f FROM h GROUP BY ALL)
SELECT symbol, event_id, {r("a", "pre_mean")}, {r("b", "pre_std")}, {r("l", "pre_last")}, {r("hi", "pre_max")}, {r("lo", "pre_min")}, {r("p", "post_mean")}, {r("f", "post_first")}, {r("p - a", "shift")} FROM g""",
)
