"""More registered queries: indicators, signals, labels, simulators, metrics, evaluation, spectrum."""

from __future__ import annotations

from pyspark.sql import functions as F

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
from tickloom.operators.bars import merge_trades, merged_time_bars, taker_orders
from tickloom.plans import scans
from tickloom.queries import BARS_SQL, CORR, GAP, MERGE_SQL, MERGED_RAW, P, S, SEC, TAKER_SQL, TAPE_SQL, at_least, bars, book, c, event_bars, fields, r, register, tape, w
from tickloom.windows import Series, div, grid

DAY = 86400
PS = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
SIGNED = "CASE WHEN side = 'buy' THEN qty ELSE -qty END"


def ws(n: int) -> str:
    return w(n, "ts, seq")


def tl(n: int, x: str, d: int, value: str) -> str:
    return at_least(n, x, d, value, "ts, seq")


STEP_SQL = f"{TAPE_SQL}, t AS (SELECT *, price - lag(price) {PS} AS d, {SIGNED} AS q FROM tape), u AS (SELECT *, lag(d) {PS} AS dl, abs(d) AS a FROM t)"


def on_tape(name: str, f, column: str, sql: str | None, source: str = STEP_SQL, frm: str = "u") -> None:
    register(name, lambda s, d: f(tape(s, d)).select("symbol", "seq", column), sql and f"WITH {source} SELECT symbol, seq, {r(sql, column)} FROM {frm}")


def time_window(ms: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {ms * 1000 - 1} PRECEDING AND CURRENT ROW)"


H = 3_600_000
on_tape("ind_tick_price_impact", lambda t: ind.tick_price_impact(t, H), "tick_price_impact", f"sum(a) {time_window(H)} / (sum(qty) {time_window(H)} + 1e-10)")
on_tape("ind_volume_weighted_impact", lambda t: ind.volume_weighted_impact(t, H), "volume_weighted_impact", f"sum(a * qty) {time_window(H)} / (sum(qty) {time_window(H)} + 1e-10)")
PAIR = "CASE WHEN d IS NOT NULL THEN q END"
on_tape("ind_kyles_lambda", lambda t: ind.kyles_lambda(t, 50), "kyles_lambda", f"{tl(20, 'd', 50, 'covar_samp(d, q)')} / ({tl(20, 'q', 50, 'var_samp(q)')} + 1e-10)")
on_tape("ind_trade_diff_spread", lambda t: ind.trade_diff_spread(t, 50), "trade_diff_spread", tl(10, "a", 50, "quantile_cont(a, 0.5)"))
on_tape("ind_roll_spread", lambda t: ind.roll_spread(t, 100), "roll_spread", f"CASE WHEN count(dl) {ws(100)} >= 30 THEN 2 * sqrt(greatest(0, -(covar_samp(d, dl) {ws(100)}))) END")
EFF = f"""{TAPE_SQL}, e AS (SELECT *, CASE WHEN side = 'buy' THEN min(price) FILTER (side = 'buy') {time_window(H)} END AS b, CASE WHEN side <> 'buy' THEN max(price) FILTER (side <> 'buy') {time_window(H)} END AS s FROM tape)"""
on_tape("ind_effective_spread", lambda t: ind.effective_spread(t, H), "effective_spread", f"abs(last_value(b IGNORE NULLS) {PS.replace(')', ' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} - last_value(s IGNORE NULLS) {PS.replace(')', ' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')})", EFF, "e")
on_tape("ind_spread_percentile", lambda t: ind.spread_percentile(t, "price", 50), "spread_percentile", "CASE WHEN len(l) >= 20 THEN 100 * (len(list_filter(l, lambda v: v < price)) + (len(list_filter(l, lambda v: v = price)) + 1) / 2) / len(l) END", f"{TAPE_SQL}, l AS (SELECT *, list(price) {ws(50)} AS l FROM tape)", "l")
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
IMB = f"""{TAPE_SQL}, v AS (SELECT *, CASE WHEN count(qty) o >= 5 THEN sum(qty) o END AS v FROM tape WINDOW o AS (PARTITION BY symbol, side ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
i AS (SELECT *, last_value(CASE WHEN side = 'buy' THEN v END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq {UP}) AS b, last_value(CASE WHEN side <> 'buy' THEN v END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq {UP}) AS s FROM v)""".replace(
    "count(qty) o", "count(qty) OVER o"
).replace("sum(qty) o", "sum(qty) OVER o")
on_tape("ind_trade_imbalance", lambda t: ind.trade_imbalance(t, 50), "trade_imbalance", "(b - s) / (b + s + 1e-10)", IMB, "i")
on_tape("ind_flow_toxicity", lambda t: ind.flow_toxicity(t, 50), "flow_toxicity", f"CASE WHEN count(a) {ws(50)} >= 50 THEN abs(price - lag(price, 50) {PS}) / (avg(a) {ws(50)} + 1e-10) END")
register("ind_vpin", lambda s, d: ind.vpin(tape(s, d), 500, 10, 50).drop("ts"))
register("ind_aggressive_flow", lambda s, d: ind.aggressive_flow(tape(s, d), H, 0.5, 1.2).select("symbol", "seq", "imbalance", "volume_ratio"))
BSEC = 21600
BINS_SQL = f"""{TAPE_SQL}, b0 AS (SELECT symbol, us // {BSEC * 1000000} * {BSEC} AS bar, coalesce(sum(qty) FILTER (side = 'buy'), 0) AS buy, coalesce(sum(qty) FILTER (side <> 'buy'), 0) AS sell FROM tape GROUP BY ALL),
e AS (SELECT symbol, unnest(range(min(bar), max(bar) + 1, {BSEC})) AS bar FROM b0 GROUP BY symbol), bins AS (SELECT e.symbol, e.bar, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell FROM e LEFT JOIN b0 USING (symbol, bar))"""


def binned(f):
    return lambda s, d: f(ind.taker_series(tape(s, d), BSEC)).withColumn("bar", F.unix_seconds("bar_ts")).drop("bar_ts")


def on_bins(name: str, f, column: str, sql: str, extra: str = "") -> None:
    register(name, binned(lambda b: f(b).select("symbol", "bar_ts", column)), f"WITH {BINS_SQL}{extra} SELECT symbol, bar, {r(sql, column)} FROM {'x' if extra else 'bins'}")


on_bins("ind_taker_volume_corr", lambda b: ind.taker_volume_corr(b, 30), "taker_volume_corr", CORR("buy", "sell", 30, 10))
on_bins("ind_taker_volume_autocorr", lambda b: ind.taker_volume_autocorr(b, 30), "taker_buy_autocorr", f"CASE WHEN count(p) {w(30)} >= 10 THEN corr(CASE WHEN p IS NOT NULL THEN buy END, p) {w(30)} END", f", x AS (SELECT *, lag(buy) {P} AS p FROM bins)")
on_bins("ind_taker_volume_skewness", lambda b: ind.taker_volume_skewness(b, 40), "buy_skew", at_least(20, "buy", 40, "skewness(buy)"))
on_bins("ind_buy_sell_ratio", lambda b: ind.buy_sell_ratio(b, 30), "buy_sell_ratio", f"CASE WHEN count(buy) {w(30)} >= 5 THEN ln((sum(buy) {w(30)} + 1e-10) / (sum(sell) {w(30)} + 1e-10)) END")
on_bins("ind_side_autocorrelation", lambda b: ind.side_autocorrelation(b, 20), "cross_corr", CORR("buy", "sell", 20, 5))
register("ind_large_trade_ratio", lambda s, d: ind.large_trade_ratio(tape(s, d), BSEC, 20).withColumn("bar", F.unix_seconds("bar_ts")).drop("bar_ts"))
TAKER_AGG = {
    "avg_levels_swept": "avg(levels_swept)",
    "large_taker_ratio": "avg((levels_swept >= 3)::INT)",
    "taker_imbalance": "sum(CASE WHEN side = 'buy' THEN total_volume ELSE -total_volume END) / (sum(total_volume) + 1e-10)",
    "impact_efficiency": "sum(abs(price_impact)) / (sum(total_volume) + 1e-10)",
    "taker_arrival_rate": "count(*)::DOUBLE",
    "iceberg_score": "avg((fills_per_level_mean >= 5)::INT)",
}
for _n, _agg in TAKER_AGG.items():
    _v = "coalesce(v, 0)" if _n == "taker_arrival_rate" else "v"
    register(
        f"ind_{_n}",
        lambda s, d, n=_n: ind.taker_indicator(taker_orders(tape(s, d)), n, BSEC, 20).withColumn("bar", F.unix_seconds("bar_ts")).select("symbol", "bar", n),
        f"""WITH {TAKER_SQL}, a AS (SELECT symbol, us // {BSEC * 1000000} * {BSEC} AS bar, {_agg} AS v FROM taker GROUP BY ALL),
e AS (SELECT symbol, unnest(range(min(bar), max(bar) + 1, {BSEC})) AS bar FROM a GROUP BY symbol), g AS (SELECT e.symbol, e.bar, {_v} AS v FROM e LEFT JOIN a USING (symbol, bar))
SELECT symbol, bar, {r(at_least(5, "v", 20, "avg(v)"), _n)} FROM g""",
    )
register("ind_sweep_depth_autocorr", lambda s, d: ind.sweep_depth_autocorr(taker_orders(tape(s, d)), BSEC, 30).withColumn("bar", F.unix_seconds("bar_ts")).drop("bar_ts"))
register("ind_taker_size_skewness", lambda s, d: ind.taker_size_skewness(taker_orders(tape(s, d)), BSEC, 40).withColumn("bar", F.unix_seconds("bar_ts")).drop("bar_ts"))

# --- depth books ----------------------------------------------------------------------------------
BOOK_SQL = "book AS (SELECT 0 AS symbol, vec_id AS seq, list_transform(embedding[1:5], lambda v: abs(v)::DOUBLE) AS b, list_transform(embedding[6:10], lambda v: abs(v)::DOUBLE) AS a FROM embeddings)"


def on_book(name: str, f, sql: dict[str, str]) -> None:
    register(name, lambda s, d: f(book(s, d)).select("symbol", "seq", *sql), f"WITH {BOOK_SQL} SELECT symbol, seq, {', '.join(r(v, k) for k, v in sql.items())} FROM book")


BS, AS_ = "list_sum(b)", "list_sum(a)"
on_book("book_primitives", ind.book_primitives, {"mid": "100.0", "bid_depth_3": "list_sum(b[1:3])", "ask_depth_5": AS_, "depth_imbalance_5": f"({BS} - {AS_}) / ({BS} + {AS_} + 1e-10)", "depth_skew": f"ln(({BS} + 1e-10) / ({AS_} + 1e-10))", "bid_concentration": f"b[1] / ({BS} + 1e-10)"})
on_book("book_depth_imbalance", ind.depth_imbalance, {"depth_imbalance": f"({BS} - {AS_}) / ({BS} + {AS_} + 1e-10)"})
on_book("book_level_thickness", ind.level_thickness, {"bid_top3": f"list_sum(b[1:3]) / ({BS} + 1e-10)", "ask_top3": f"list_sum(a[1:3]) / ({AS_} + 1e-10)", "thickness_diff": f"list_sum(b[1:3]) / ({BS} + 1e-10) - list_sum(a[1:3]) / ({AS_} + 1e-10)"})
on_book("book_vwap_pressure", ind.vwap_pressure, {"bid_vwap": f"list_sum(list_transform(b, lambda v, i: v * (100 - 0.01 * i))) / {BS}", "ask_vwap": f"list_sum(list_transform(a, lambda v, i: v * (100 + 0.01 * i))) / {AS_}"})
register("book_depth_slope", lambda s, d: ind.depth_slope(book(s, d)).drop("ts"))
register("book_depth_change_rate", lambda s, d: ind.depth_change_rate(book(s, d)).drop("ts"))
register("book_depth_resilience", lambda s, d: ind.depth_resilience(book(s, d)).drop("ts"))

# --- bars and regimes -----------------------------------------------------------------------------
RET_SQL = f"{BARS_SQL}, t AS (SELECT *, close / lag(close) {P} - 1 AS ret, ln(close / lag(close) {P}) AS lr, abs(close - lag(close) {P}) AS ad, ln(high / low) ** 2 AS hl FROM bars)"


def on_bars(name: str, f, sql: dict[str, str], source: str = RET_SQL, frm: str = "t") -> None:
    register(name, lambda s, d: f(bars(s, d)).select("symbol", "bar", *sql), f"WITH {source} SELECT symbol, bar, {', '.join(r(v, k) if not v.startswith('!') else v[1:] + ' AS ' + k for k, v in sql.items())} FROM {frm}")


on_bars("bar_returns_momentum", ind.returns_momentum, {"return_1": "ret", "log_return": "lr", "return_sum_10": at_least(5, "ret", 10, "sum(ret)"), "return_std_10": at_least(5, "ret", 10, "stddev_samp(ret)"), "return_skew_10": at_least(3, "ret", 10, "skewness(ret)"), "return_kurt_10": at_least(4, "ret", 10, "kurtosis(ret)")})
on_bars("bar_structure", ind.bar_structure, {"bar_range": "high - low", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "efficiency": "abs(close - open) / (high - low + 1e-10)", "imbalance": "(buy_volume - sell_volume) / (volume + 1e-10)", "range_mean_5": f"avg(high - low) {w(5)}", "imbalance_sum_20": f"sum((buy_volume - sell_volume) / (volume + 1e-10)) {w(20)}"})
on_bars("regime_realized_volatility", lambda b: ind.realized_volatility(b, 30), {"realized_volatility": at_least(10, "lr", 30, "stddev_samp(lr)")})
on_bars("regime_parkinson", lambda b: ind.parkinson_volatility(b, 30), {"parkinson_volatility": f"CASE WHEN count(hl) {w(30)} >= 10 THEN sqrt(avg(hl) {w(30)} / (4 * ln(2))) END"})
on_bars("regime_efficiency_ratio", lambda b: ind.efficiency_ratio(b, 20), {"efficiency_ratio": f"CASE WHEN count(ad) {w(20)} >= 20 THEN abs(close - lag(close, 20) {P}) / (sum(ad) {w(20)} + 1e-10) END"})
on_bars("regime_volume", lambda b: ind.quantile_regime(b, "volume", 100), {"regime": f"!CASE WHEN count(volume) {w(100)} >= 30 AND volume < quantile_cont(volume, 0.25) {w(100)} THEN 'low' WHEN count(volume) {w(100)} >= 30 AND volume > quantile_cont(volume, 0.75) {w(100)} THEN 'high' ELSE 'normal' END"})
on_bars("regime_amihud", lambda b: ind.amihud(b, 20).withColumn("amihud", c("amihud") * 1e6), {"amihud": f"1e6 * CASE WHEN count(ret) {w(20)} >= 5 THEN avg(abs(ret) / (volume * close + 1e-10)) {w(20)} END"})
on_bars("regime_turnover_ratio", lambda b: ind.turnover_ratio(b, 20), {"turnover_ratio": f"CASE WHEN count(volume) {w(20)} >= 5 THEN volume / (avg(volume) {w(20)} + 1e-10) END"})
register("regime_garch", lambda s, d: sm.recur(bars(s, d).withColumn("r", 100 * F.log(div(c("close"), S.lag(c("close"))))), sm.garch, ["r"], ["y"]).select("symbol", "bar", "y"))
register("regime_adx", lambda s, d: ind.trend_regime(sm.recur(bars(s, d), sm.adx, ["high", "low", "close"], ["adx", "plus_di", "minus_di"], n=14), "adx").select("symbol", "bar", "adx", "plus_di", "minus_di", "trend_regime"))
register("regime_adx_wilder", lambda s, d: sm.recur(bars(s, d), sm.adx, ["high", "low", "close"], ["adx", "plus_di", "minus_di"], n=14, wilder=True).select("symbol", "bar", "adx", "plus_di", "minus_di"))
register("regime_hurst", lambda s, d: sm.recur(bars(s, d), sm.hurst_rs, ["close"], ["hurst"], n=100).select("symbol", "bar", "hurst"))

# --- smoothers ------------------------------------------------------------------------------------
EWM_SQL = f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT symbol, bar, close, row_number() {P} AS i FROM bars), e AS (SELECT symbol, bar, i, close AS y FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.bar, n.i, 0.8 * e.y + 0.2 * n.close FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, bar, {r("y", "y")} FROM e"""
register("smooth_ewm", lambda s, d: sm.ewm_scan(bars(s, d), "close", "y", 0.2, rows=16).select("symbol", "bar", "y"), EWM_SQL)
EWMA_SQL = f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT symbol, bar, close, row_number() {P} AS i FROM bars), e AS (SELECT symbol, bar, i, close AS a, 1.0::DOUBLE AS b FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.bar, n.i, 0.8 * e.a + n.close, 0.8 * e.b + 1 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, bar, {r("a / b", "y")} FROM e"""
register("smooth_ewm_adjusted", lambda s, d: sm.ewm_scan(bars(s, d), "close", "y", 0.2, adjust=True, rows=16).select("symbol", "bar", "y"), EWMA_SQL)
register("smooth_kaufman", lambda s, d: sm.kaufman_scan(bars(s, d), "close", "y", rows=16).select("symbol", "bar", "y"))
register("smooth_kalman", lambda s, d: sm.recur(bars(s, d), sm.kalman, ["close"], ["y"]).select("symbol", "bar", "y"))
register("smooth_kalman_clipped", lambda s, d: sm.recur(bars(s, d), sm.kalman, ["close"], ["y"], clip=True).select("symbol", "bar", "y"))
register("smooth_adaptive_ema", lambda s, d: sm.adaptive_scan(bars(s, d).withColumn("alpha", F.least(F.lit(0.5), 0.1 * c("volume") / S.mean(c("volume"), 20, 1))), "close", "alpha", "y", rows=16).select("symbol", "bar", "y"))
register("smooth_bilateral", lambda s, d: bars(s, d).withColumn("_i", S.index()).select("symbol", "bar", sm.bilateral(S, c("close"), 3, 2.0, 1.0).alias("y")))
register("smooth_polyfit", lambda s, d: bars(s, d).select("symbol", "bar", sm.polyfit_last(S, c("close"), 12).alias("y")))
register(
    "smooth_slope",
    lambda s, d: bars(s, d).withColumn("_i", S.index().cast("double")).select("symbol", "bar", sm.rolling_slope(S, c("close"), 10).alias("y")),
    f"WITH {BARS_SQL}, n AS (SELECT *, row_number() {P} AS i FROM bars) SELECT symbol, bar, {r(at_least(10, 'close', 10, 'regr_slope(close, i)'), 'y')} FROM n",
)
MADX = f"{BARS_SQL}, a AS (SELECT symbol, bar, volume AS v, CASE WHEN count(volume) {w(40)} >= 10 THEN quantile_cont(volume, 0.5) {w(40)} END AS m FROM bars), b AS (SELECT *, abs(v - m) AS dev FROM a)"
register("smooth_robust_z", lambda s, d: sm.robust_z(bars(s, d), "volume", 40).select("symbol", "bar", "z", "mad_z"), f"WITH {MADX} SELECT symbol, bar, {r(f'CASE WHEN count(v) {w(40)} >= 10 THEN (v - avg(v) {w(40)}) / (stddev_samp(v) {w(40)} + 1e-12) END', 'z')}, {r(f'CASE WHEN count(dev) {w(40)} >= 10 THEN (v - m) / (1.4826 * quantile_cont(dev, 0.5) {w(40)} + 1e-12) END', 'mad_z')} FROM b")
register("smooth_delta_threshold", lambda s, d: sm.delta_threshold(bars(s, d), "volume", 40, 1.5, "q75").select("symbol", "bar", "threshold"), f"WITH {BARS_SQL} SELECT symbol, bar, {r(f'1.5 * CASE WHEN count(volume) {w(40)} >= 10 THEN quantile_cont(volume, 0.75) {w(40)} END', 'threshold')} FROM bars")

# --- detectors ------------------------------------------------------------------------------------
DB_SQL = f"""{TAPE_SQL}, t AS (SELECT *, us // 1000 // {BSEC * 1000} AS bucket FROM tape),
g AS (SELECT symbol, bucket, arg_min(price, seq) AS first, arg_max(price, seq) AS last, max(price) AS top, min(price) AS bottom, sum(qty) AS volume, sum({SIGNED}) AS net, count(*) AS n_trades FROM t GROUP BY ALL)"""
DCOLS = f"symbol, bucket, n_trades, {', '.join(r(x, x) for x in ('first', 'last', 'top', 'bottom', 'volume', 'net'))}, {r('(last - first) / first * 100', 'impact_pct')}, CASE WHEN net > 0 THEN 'buy' ELSE 'sell' END AS direction"
register("detect_bucket_impact", lambda s, d: ind.bucket_impact_d(tape(s, d), BSEC * 1000), f"WITH {DB_SQL} SELECT {DCOLS} FROM g WHERE n_trades >= 2")
WB = w(20, "bucket")
register(
    "detect_large_impacts",
    lambda s, d: ind.large_impacts_d(tape(s, d), BSEC * 1000, 0.3, 1.1),
    f"WITH {DB_SQL}, h AS (SELECT *, volume / (avg(volume) {WB} + 1e-10) AS vr FROM g WHERE n_trades >= 2) SELECT {DCOLS}, {r('vr', 'volume_ratio')} FROM h WHERE abs((last - first) / first * 100) >= 0.3 AND vr >= 1.1",
)
on_tape("detect_volume_impact", lambda t: ind.volume_impact_d(t, 30), "volume_impact", f"sum(a) {ws(30)} / sum(qty) {ws(30)}")
on_tape("detect_kyle_lambda", lambda t: ind.kyle_lambda_d(t, 30), "kyle_lambda", f"CASE WHEN count(d) {ws(30)} >= 2 AND var_samp({PAIR}) {ws(30)} >= 1e-10 THEN covar_samp(d, q) {ws(30)} / var_samp({PAIR}) {ws(30)} END")
on_tape("detect_spread_trade_diff", lambda t: ind.spread_d(t, "trade_diff", 30), "spread", f"abs(avg(price) FILTER (side = 'buy') {ws(30)} - avg(price) FILTER (side <> 'buy') {ws(30)})")
on_tape("detect_spread_roll", lambda t: ind.spread_d(t, "roll", 30), "spread", f"CASE WHEN count(dl) {ws(30)} >= 2 AND covar_samp(d, dl) {ws(30)} < 0 THEN 2 * sqrt(abs(covar_samp(d, dl) {ws(30)})) END")
on_tape("detect_spread_tick_range", lambda t: ind.spread_d(t, "tick_range", 30), "spread", f"max(price) {ws(30)} - min(price) {ws(30)}")
on_tape("detect_spread_percentile", lambda t: ind.spread_percentile_d(t, "price", 50), "spread_pct", "CASE WHEN len(l) >= 10 THEN 100.0 * len(list_filter(l, lambda v: v < price)) / len(l) END", f"{TAPE_SQL}, l AS (SELECT *, list(price) {ws(50)} AS l FROM tape)", "l")
on_tape("detect_imbalance", lambda t: ind.imbalance_d(t, 30), "imbalance", f"sum(q) {ws(30)} / sum(qty) {ws(30)}")
on_tape("detect_flow_toxicity", lambda t: ind.flow_toxicity_d(t, 30), "flow_toxicity", f"abs(sum(sign(q)) {ws(30)}) / count(*) {ws(30)}")
on_tape("detect_vpin", lambda t: ind.vpin_d(t, 500, 10), "vpin", "i", f"""{TAPE_SQL}, k AS (SELECT *, floor(sum(qty) {PS} / 500)::BIGINT AS bucket FROM tape), b AS (SELECT symbol, bucket, abs(2 * avg((side = 'buy')::INT) - 1) * sum(qty) AS m FROM k GROUP BY ALL),
v AS (SELECT symbol, bucket, sum(m) {w(10, "bucket")} / (count(m) {w(10, "bucket")} * 500) AS i FROM b), j AS (SELECT k.symbol, k.seq, v.i FROM k JOIN v USING (symbol, bucket))""", "j")
register("detect_spread_expansion", lambda s, d: ind.spread_expansion_d(tape(s, d), 50, 80).select("symbol", "seq", "spread_pct", "expanded"))
register(
    "detect_aggressive_flow",
    lambda s, d: ind.aggressive_flow_d(tape(s, d), BSEC * 1000, 0.3, 1.0),
    f"WITH {DB_SQL}, h AS (SELECT *, net / volume AS imb, volume / (avg(volume) {WB} + 1e-10) AS vr FROM g) SELECT symbol, bucket, n_trades, {r('net', 'net')}, {r('volume', 'volume')}, {r('imb', 'imbalance')}, {r('vr', 'volume_ratio')} FROM h WHERE abs(imb) >= 0.3 AND vr >= 1.0",
)


def shocks(s, d):
    return ind.liquidity_shocks(tape(s, d), BSEC * 1000, 0.3, 50, 0.1, 50)


register("detect_liquidity_shocks", shocks)
register("detect_refills", lambda s, d: ind.refills(shocks(s, d), tape(s, d), 4 * BSEC * 1000))

# --- signals --------------------------------------------------------------------------------------
for _n in sg.RAW:
    register(f"rule_{_n}", lambda s, d, n=_n: sg.factor(bars(s, d), n, 40).select("symbol", "bar", "factor"))
for _n in sg.MERGED:
    register(f"rule_{_n}", lambda s, d, n=_n: sg.factor(merged_time_bars(merge_trades(tape(s, d), GAP), DAY), n, 8).select("symbol", "bar", "factor"))
from tickloom.queries import ORACLE_SQL  # noqa: E402

RULE_SQL = {
    "trade_imbalance": "(buy_volume - sell_volume) / (volume + 1e-10)",
    "buy_sell_ratio": "ln((buy_volume + 1e-10) / (sell_volume + 1e-10))",
    "volume_zscore": f"CASE WHEN count(volume) {w(40)} >= 10 THEN (volume - avg(volume) {w(40)}) / (stddev_samp(volume) {w(40)} + 1e-10) END",
    "taker_vol_corr": CORR("buy_volume", "sell_volume", 40, 10),
    "volume_acceleration": f"(volume - lag(volume, 5) {P}) - (lag(volume, 20) {P} - lag(volume, 25) {P})",
    "price_impact": "abs(close - open) / (volume + 1e-10)",
    "taker_vol_skew": f"CASE WHEN count(volume) {w(40)} >= 10 THEN skewness(buy_volume) {w(40)} - skewness(sell_volume) {w(40)} END",
}
for _n, _q in RULE_SQL.items():
    ORACLE_SQL[f"rule_{_n}"] = f"WITH {BARS_SQL} SELECT symbol, bar, {r(_q, 'factor')} FROM bars"
ORACLE_SQL["rule_kyles_lambda"] = f"WITH {BARS_SQL}, t AS (SELECT *, close - lag(close) {P} AS d, buy_volume - sell_volume AS q FROM bars) SELECT symbol, bar, {r(f'CASE WHEN count(d) {w(40)} >= 10 THEN covar_samp(d, q) {w(40)} / (var_samp(q) {w(40)} + 1e-10) END', 'factor')} FROM t"
MB_SQL = f"{MERGE_SQL}, mb AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {MERGED_RAW} FROM m GROUP BY ALL)"


def both_sql(x: str) -> str:
    b, s = at_least(3, f"buy_{x}", 8, f"avg(buy_{x})"), at_least(3, f"sell_{x}", 8, f"avg(sell_{x})")
    return f"(({b}) - ({s})) / (abs({b}) + abs({s}) + 1e-10)"


for _n, _x in {"vwap_dist_sum_imbalance": "vwap_dist_sum", "multi_fill_count_imbalance": "mf_count", "multi_fill_volume_imbalance": "mf_volume", "off_top_volume_imbalance": "off_top_cost", "vwap_dist_reg_imbalance": "vwap_dist_beta", "price_range_reg_imbalance": "price_range_beta", "volume_skew_imbalance": "volume_skew", "mf_vol_median_ratio_imbalance": "mf_log_median_ratio"}.items():
    ORACLE_SQL[f"rule_{_n}"] = f"WITH {MB_SQL} SELECT symbol, bar, {r(both_sql(_x), 'factor')} FROM mb"

FX = "(buy_volume - sell_volume) / volume"
SIG_SQL = f"{BARS_SQL}, f AS (SELECT symbol, bar, {FX} AS x FROM bars)"


def sides(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


Z = f"(x - avg(x) {w(40)}) / (stddev_samp(x) {w(40)} + 1e-10)"
N10 = f"count(x) {w(40)} >= 10 AND"
SIGNAL_SQL = {
    "raw": ({"dead": 0.2}, sides("x > 0.2", "x < -0.2")),
    "raw_reversal": ({"dead": 0.2}, sides("x < -0.2", "x > 0.2")),
    "zscore": ({"n": 40, "up": 1.0, "down": 0.8}, sides(f"{N10} {Z} > 1.0", f"{N10} {Z} < -0.8")),
    "quantile": ({"n": 40, "low": 0.2, "high": 0.8}, sides(f"{N10} x > quantile_cont(x, 0.8) {w(40)}", f"{N10} x < quantile_cont(x, 0.2) {w(40)}")),
    "ma_cross": ({"fast": 5, "slow": 20}, sides(f"avg(x) {w(5)} > avg(x) {w(20)} + 1e-12", f"avg(x) {w(5)} < avg(x) {w(20)} - 1e-12")),
    "bollinger": ({"n": 20, "k": 1.0}, sides(f"count(x) {w(20)} >= 5 AND x < avg(x) {w(20)} - stddev_samp(x) {w(20)}", f"count(x) {w(20)} >= 5 AND x > avg(x) {w(20)} + stddev_samp(x) {w(20)}")),
    "delta": ({"d": 1, "least": 0.1}, sides(f"x - lag(x) {P} > 0.1", f"x - lag(x) {P} < -0.1")),
    "threshold": ({"up": 0.3, "down": -0.3}, sides("x > 0.3", "x < -0.3")),
    "rank": ({"n": 40, "low": 0.2, "high": 0.8}, None),
    "dual_ma_band": ({"fast": 5, "slow": 15, "n": 30}, None),
}


def factored(s, d):
    return bars(s, d).withColumn("factor", (c("buy_volume") - c("sell_volume")) / c("volume"))


for _n, (_p, _q) in SIGNAL_SQL.items():
    register(f"signal_{_n}", lambda s, d, n=_n, p=_p: sg.signal(factored(s, d), n, "factor", **p).select("symbol", "bar", "signal"), _q and f"WITH {SIG_SQL} SELECT symbol, bar, {_q} AS signal FROM f")
register("signal_flip_entries", lambda s, d: sg.flip_entries(sm.recur(factored(s, d), sm.ewm, ["factor"], ["y"], alpha=0.2), "y", 40, 0.5).select("symbol", "bar", "position"))
register("size_fixed", lambda s, d: sg.size(sg.signal(factored(s, d), "raw", dead=0.2), "fixed", size=2.0).select("symbol", "bar", "position"), f"WITH {SIG_SQL} SELECT symbol, bar, {r('2.0 * ' + sides('x > 0.2', 'x < -0.2'), 'position')} FROM f")
register("size_vol_target", lambda s, d: sg.size(sg.signal(factored(s, d), "raw", dead=0.2), "vol_target").select("symbol", "bar", "position"))
register("size_proportional", lambda s, d: sg.size(sg.signal(factored(s, d), "raw", dead=0.2), "proportional", scale=2.0).select("symbol", "bar", "position"), f"WITH {SIG_SQL} SELECT symbol, bar, {r('greatest(-1, least(1, 2 * abs(x) * ' + sides('x > 0.2', 'x < -0.2') + '))', 'position')} FROM f")

# --- labels and paths -----------------------------------------------------------------------------
PATH_SQL = f"""{BARS_SQL}, n AS (SELECT *, row_number() {P} AS i FROM bars), h AS (SELECT a.symbol, a.bar, a.close, b.i - a.i AS k, b.high AS bh, b.low AS bl, b.close AS bc FROM n a JOIN n b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 12),
f AS (SELECT symbol, bar, any_value(close) AS close, max(k) AS len, min(k) FILTER (bh >= close * 1.012 OR bl <= close * 0.99) AS hit FROM h GROUP BY symbol, bar),
x AS (SELECT f.*, h.bh, h.bl, h.bc FROM f JOIN h ON h.symbol = f.symbol AND h.bar = f.bar AND h.k = coalesce(hit, len)),
m AS (SELECT f.symbol, f.bar, max(bh) / any_value(f.close) - 1 AS mfe, min(bl) / any_value(f.close) - 1 AS mae FROM f JOIN h ON h.symbol = f.symbol AND h.bar = f.bar AND h.k <= coalesce(hit, len) GROUP BY f.symbol, f.bar)"""
BOTH = "bh >= close * 1.012 AND bl <= close * 0.99"
LABEL = f"CASE WHEN hit IS NULL THEN 'time' WHEN {BOTH} THEN CASE WHEN bc >= close THEN 'lower' ELSE 'upper' END WHEN bh >= close * 1.012 THEN 'upper' ELSE 'lower' END"
register(
    "label_triple_barrier",
    lambda s, d: lb.triple_barrier(bars(s, d), 0.012, 0.01, 12).select("symbol", "bar", "label", c("hit_bar").cast("long").alias("hit_bar"), "ret", "mfe", "mae"),
    f"WITH {PATH_SQL} SELECT symbol, bar, {LABEL} AS label, coalesce(hit, len) AS hit_bar, {r(f'CASE WHEN hit IS NULL OR ({BOTH}) THEN bc / close - 1 WHEN bh >= close * 1.012 THEN 0.012 ELSE -0.01 END', 'ret')}, {r('mfe', 'mfe')}, {r('mae', 'mae')} FROM x JOIN m USING (symbol, bar)",
)
register("label_multi_horizon", lambda s, d: lb.multi_horizon(bars(s, d), 0.012, 0.01, [4, 12]).select("symbol", "bar", "label_4", "label_12"), f"WITH {PATH_SQL} SELECT symbol, bar, CASE WHEN hit <= 4 THEN {LABEL} ELSE 'time' END AS label_4, {LABEL} AS label_12 FROM x")
register("label_summary", lambda s, d: lb.label_summary(lb.triple_barrier(bars(s, d), 0.012, 0.01, 12)))
register("label_volatility_barriers", lambda s, d: lb.triple_barrier(ind.realized_volatility(bars(s, d), 30).filter("realized_volatility > 0"), 2.0, 2.0, 12, path=False, width=c("realized_volatility")).select("symbol", "bar", "label", "hit_bar", "ret"))
register("label_forward_return", lambda s, d: lb.forward_return(bars(s, d), 5, "bps").select("symbol", "bar", "fwd_5"), f"WITH {BARS_SQL} SELECT symbol, bar, {r(f'(lead(close, 5) {P} / close - 1) * 1e4', 'fwd_5')} FROM bars")
register("label_excursions", lambda s, d: lb.excursions(bars(s, d), 12).select("symbol", "bar", "mfe", "mae"), f"WITH {BARS_SQL} SELECT symbol, bar, {r('max(high) o / close - 1', 'mfe').replace(' o ', ' OVER o ')}, {r('min(low) o / close - 1', 'mae').replace(' o ', ' OVER o ')} FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)")
register("exit_path", lambda s, d: lb.path_exit(bars(s, d), 12, 0.01, 0.012, trail=0.006).select("symbol", "bar", "exit_bar", "exit_reason", "exit_ret"))
GAPS_SQL = f"""{BARS_SQL}, g AS (SELECT *, lag(high, 2) {P} AS h2, lag(low, 2) {P} AS l2, lag(close) {P} AS c1 FROM bars),
k AS (SELECT symbol, bar, 'bullish' AS kind, h2 AS bottom, low AS top, (low - h2) / c1 * 100 AS size_pct FROM g WHERE low > h2 UNION ALL SELECT symbol, bar, 'bearish', high, l2, (l2 - high) / c1 * 100 FROM g WHERE high < l2)"""
register("gap_events", lambda s, d: lb.gaps(bars(s, d)).select("symbol", "bar", "kind", "bottom", "top", "size_pct"), f"WITH {GAPS_SQL} SELECT symbol, bar, kind, {r('bottom', 'bottom')}, {r('top', 'top')}, {r('size_pct', 'size_pct')} FROM k")
register("gap_fills", lambda s, d: lb.gap_fills(bars(s, d), 12).select("symbol", "bar", "kind", "status", "fill_bars", "max_extension"))

# --- simulators and metrics -----------------------------------------------------------------------


def positions(s, d):
    return sg.signal(factored(s, d), "raw", dead=0.2).withColumn("position", c("signal").cast("double"))


register("sim_machine", lambda s, d: sim.backtest(positions(s, d), [{"stop": "fixed", "exit": "time_decay", "pct": 0.005, "bars": 6, "cost_bps": 4.0}]).drop("close"))
GRID = sim.grid(stop=["none", "fixed", "trailing"], exit=["none", "signal_reversal"], pct=[0.004, 0.01], cost_bps=[4.0])
register("sim_grid_search", lambda s, d: scans.grid_search(positions(s, d), GRID, SEC))
HELD_SQL = f"""{SIG_SQL}, q AS (SELECT f.symbol, f.bar, open, close, {sides('x > 0.2', 'x < -0.2')} AS p FROM f JOIN bars USING (symbol, bar)), h AS (SELECT *, coalesce(lag(p) {P}, 0) AS held FROM q), t AS (SELECT *, abs(held - coalesce(lag(held) {P}, 0)) AS turn FROM h),
y AS (SELECT *, held * (close / open - 1) - turn * 4 / 1e4 AS ret FROM t)"""
register("sim_held_returns", lambda s, d: sim.held_returns(positions(s, d), fee_bps=4.0).select("symbol", "bar", "ret", "equity"), f"WITH {HELD_SQL} SELECT symbol, bar, {r('ret', 'ret')}, {r(f'exp(sum(ln(1 + ret)) {P})', 'equity')} FROM y")
register(
    "sim_fixed_interval",
    lambda s, d: sim.fixed_interval(factored(s, d), "factor", 4, 0.1, 4.0).select("symbol", "bar", "position", "ret"),
    f"""WITH {SIG_SQL}, q AS (SELECT f.symbol, f.bar, close, {sides('x > 0.1', 'x < -0.1')} AS want, row_number() {P} - 1 AS i FROM f JOIN bars USING (symbol, bar)), p AS (SELECT *, last_value(CASE WHEN i % 4 = 0 THEN want END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar {UP}) AS pos FROM q),
h AS (SELECT *, coalesce(lag(pos) {P}, 0) AS held, close / lag(close) {P} - 1 AS mv FROM p) SELECT symbol, bar, {r('pos', 'position')}, {r('coalesce(held * mv, 0) - abs(pos - held) * 4 / 1e4', 'ret')} FROM h""",
)
register(
    "sim_contrarian",
    lambda s, d: sim.contrarian(bars(s, d), 2.0).select("symbol", "bar", "ret", "cum"),
    f"""WITH {BARS_SQL}, a AS (SELECT symbol, bar, close / lag(close) {P} - 1 AS m FROM bars), b AS (SELECT *, coalesce(-sign(lag(m) {P}), 0) AS side FROM a), e AS (SELECT *, coalesce(side * m, 0) - CASE WHEN side <> 0 THEN 0.0002 ELSE 0 END AS ret FROM b)
SELECT symbol, bar, {r('ret', 'ret')}, {r(f'sum(ret) {P}', 'cum')} FROM e""",
)
register("sim_cooldown_entries", lambda s, d: sim.with_cooldown(lb.path_exit(bars(s, d), 12, 0.01, 0.012).withColumn("i", S.index()).select("symbol", "bar", "i", "exit_bar", "exit_ret"), "exit_bar", 2, 12))
register(
    "sim_signal_accuracy",
    lambda s, d: sim.signal_accuracy(positions(s, d), "position", 4).select("symbol", "bar", "ret", "correct"),
    f"WITH {SIG_SQL}, q AS (SELECT f.symbol, f.bar, {sides('x > 0.2', 'x < -0.2')} AS p, lead(close, 5) {P} / lead(close, 1) {P} - 1 AS m FROM f JOIN bars USING (symbol, bar)) SELECT symbol, bar, {r('p * m', 'ret')}, (p * m > 0)::INT AS correct FROM q WHERE p <> 0 AND m IS NOT NULL",
)
register("sim_threshold_paths", lambda s, d: sim.threshold_paths(factored(s, d), "factor", [0.1, 0.3, 0.5], 8))
register("sim_reversion_grid", lambda s, d: sim.reversion_grid(factored(s, d), "factor", [0.3, 0.5], [0.1, 0.2], 8))


def held(s, d):
    return sim.held_returns(positions(s, d), fee_bps=4.0)


register("metric_returns", lambda s, d: mt.return_metrics(held(s, d), ["symbol"], "bar", SEC))
TRADES_SQL = f"{HELD_SQL}, z AS (SELECT *, sum(ret) {P} AS cs FROM y), dd AS (SELECT *, greatest(max(cs) {P}, 0) - cs AS dn FROM z)"
register(
    "metric_trades",
    lambda s, d: mt.trade_metrics(held(s, d), ["symbol"], "bar"),
    f"""WITH {TRADES_SQL} SELECT symbol, count(*) AS n_trades, {r('avg((ret > 0)::INT)', 'win_rate')}, {r('avg(ret)', 'mean_ret')}, {r('median(ret)', 'median_ret')}, {r('stddev_samp(ret)', 'std_ret')}, {r('sum(ret)', 'total_ret')}, {r('avg(ret) FILTER (ret > 0)', 'avg_win')},
{r('avg(ret) FILTER (ret <= 0)', 'avg_loss')}, {r('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret <= 0))', 'profit_factor')}, {r('avg(ret) / stddev_samp(ret) * sqrt(count(*))', 'sharpe')}, {r('max(dn)', 'max_drawdown')}, {r('skewness(ret)', 'skew')}, {r('quantile_cont(ret, 0.05)', 'p05')} FROM dd GROUP BY symbol""",
)
register("metric_stretches", lambda s, d: mt.stretches(held(s, d), ["symbol"], "bar"))
register("metric_streaks", lambda s, d: mt.streaks(held(s, d), ["symbol"], "bar"))
register("metric_report_series", lambda s, d: mt.report_series(held(s, d), ["symbol"], "bar").select("symbol", "bar", "cum_return", "drawdown", "long_curve", "turnover_ma", "is_entry", "is_exit"))

# --- evaluation and scans -------------------------------------------------------------------------


def xy(s, d):
    return factored(s, d).select("symbol", "bar", c("factor").alias("x"), (div(S.lead(c("close")), c("close")) - 1).alias("y"))


XY_SQL = f"{BARS_SQL}, xy0 AS (SELECT symbol, bar, {FX} AS x, lead(close) {P} / close - 1 AS y FROM bars), xy AS (SELECT * FROM xy0 WHERE y IS NOT NULL)"
RK = "rank() OVER (PARTITION BY symbol ORDER BY {0}) + (count(*) OVER (PARTITION BY symbol, {0}) - 1) / 2"
register("eval_ic_spearman", lambda s, d: ev.ic(xy(s, d), ["symbol"]), f"WITH {XY_SQL}, k AS (SELECT symbol, {RK.format('x')} AS a, {RK.format('y')} AS b FROM xy) SELECT symbol, count(*) AS n, {r('corr(a, b)', 'ic')} FROM k GROUP BY symbol")
register("eval_ic_pearson", lambda s, d: ev.ic(xy(s, d), ["symbol"], method="pearson"), f"WITH {XY_SQL} SELECT symbol, count(*) AS n, {r('corr(x, y)', 'ic')} FROM xy GROUP BY symbol")
register(
    "eval_rolling_ic",
    lambda s, d: ev.rolling_ic(xy(s, d), S, 30).select("symbol", "bar", "rolling_ic"),
    f"WITH {XY_SQL} SELECT symbol, bar, {r('CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY bar) > 30 AND count(y) OVER o > 10 THEN corr(CASE WHEN y IS NOT NULL THEN x END, y) OVER o END', 'rolling_ic')} FROM xy0 WINDOW o AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
)
register("eval_rolling_ic_spearman", lambda s, d: ev.rolling_ic(xy(s, d), S, 30, "spearman").select("symbol", "bar", "rolling_ic"))
register("eval_autocorrelation", lambda s, d: ev.autocorrelation(xy(s, d), ["symbol"], "bar", "x", [1, 2, 5]), f"WITH {XY_SQL}, l AS (SELECT symbol, k AS lag, x, CASE k WHEN 1 THEN lag(x, 1) {P.replace('symbol', 'symbol, k')} WHEN 2 THEN lag(x, 2) {P.replace('symbol', 'symbol, k')} ELSE lag(x, 5) {P.replace('symbol', 'symbol, k')} END AS p FROM xy0, (VALUES (1), (2), (5)) v(k)) SELECT symbol, lag, {r('corr(x, p) FILTER (p IS NOT NULL)', 'acf')} FROM l GROUP BY ALL")
register("eval_half_life", lambda s, d: ev.half_life(ev.rolling_ic(xy(s, d), S, 30), ["symbol"], "bar", "rolling_ic", 20))
register("eval_stability", lambda s, d: ev.stability(ev.rolling_ic(xy(s, d), S, 30), ["symbol"], "bar"))
register(
    "eval_quantile_returns",
    lambda s, d: ev.quantile_returns(xy(s, d), ["symbol"]),
    f"""WITH {XY_SQL}, e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM xy GROUP BY symbol HAVING count(*) >= 50), b AS (SELECT symbol, greatest(0, len(list_filter(e, lambda v: v < x)) - 1)::INT AS bucket, y FROM xy JOIN e USING (symbol))
SELECT symbol, bucket, count(*) AS n, {r('avg(y)', 'mean')}, {r('stddev_samp(y)', 'std')}, {r('avg(y) / (stddev_samp(y) / sqrt(count(*)))', 't')} FROM b GROUP BY ALL HAVING count(*) >= 2""",
)
register("eval_turnover", lambda s, d: ev.turnover(xy(s, d), ["symbol"], "bar"), f"WITH {XY_SQL}, k AS (SELECT symbol, bar, ({RK.format('x')}) / count(*) OVER (PARTITION BY symbol) AS a FROM xy0), l AS (SELECT symbol, abs(a - lag(a) {P}) AS v FROM k) SELECT symbol, {r('avg(v)', 'turnover')} FROM l GROUP BY symbol")
register("eval_summary", lambda s, d: ev.summary(xy(s, d), ["symbol"], "x").drop("skew", "kurt"), f"WITH {XY_SQL} SELECT symbol, count(x) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')}, {', '.join(r(f'quantile_cont(x, {q / 100})', f'p{q:02d}') for q in (5, 25, 50, 75, 95))} FROM xy0 GROUP BY symbol")
register("eval_signal_metrics", lambda s, d: ev.signal_metrics(xy(s, d).withColumn("signal", F.signum(F.round("x", 1)).cast("int")), ["symbol"], "bar"))
register("eval_factor", lambda s, d: ev.evaluate(xy(s, d), ["symbol"], "bar", n=30))
EXPRESSIONS = scans.first_order(["trade_imbalance", "volume"], (5, 20), ("ts_zscore", "delta", "ts_rank")) + scans.second_order(["trade_imbalance", "return_1"], (3,), (10,), (10,))
register("scan_factors", lambda s, d: scans.factor_scan(tape(s, d), SEC, EXPRESSIONS))
register("scan_signals", lambda s, d: scans.signal_scan(bars(s, d), ["trade_imbalance", "volume_zscore"], [20, 40], [("zscore", {"n": 40}), ("quantile", {"n": 40})]))
register("scan_best", lambda s, d: scans.best(scans.signal_scan(bars(s, d), ["trade_imbalance", "buy_sell_ratio"], [20], [("zscore", {"n": 40}), ("raw", {"dead": 0.1})]).drop("valid"), ["symbol"], "rank_ic"))
register("scan_pivot", lambda s, d: scans.pivot_mean(ev.ic(scans.unpivot(xy(s, d).withColumn("z", -c("x")), ["symbol", "bar", "y"], ["x", "z"]).withColumnRenamed("value", "v"), ["symbol", "expr"], x="v"), "symbol", "expr", "ic", ["x", "z"]))

# --- spectrum and features ------------------------------------------------------------------------


def logret(s, d):
    return bars(s, d).select("symbol", "bar", F.floor(c("bar") / DAY).alias("day"), F.log(div(c("close"), S.lag(c("close")))).alias("r"))


register("spectrum_return_acf", lambda s, d: sp.return_acf(logret(s, d), ["symbol"], "day", "bar", "r", [1, 2, 3]))
register(
    "spectrum_daily_acf",
    lambda s, d: sp.daily_acf(tape(s, d).withColumn("day", F.floor(F.unix_seconds("ts") / DAY)), ["symbol"], "day", "seq", "price"),
    f"WITH {TAPE_SQL}, a AS (SELECT symbol, us // {DAY * 1000000} AS day, price, lag(price) OVER (PARTITION BY symbol, us // {DAY * 1000000} ORDER BY seq) AS p FROM tape), b AS (SELECT symbol, day, CASE WHEN count(p) >= 2 AND min(p) < max(p) AND min(price) FILTER (p IS NOT NULL) < max(price) FILTER (p IS NOT NULL) THEN corr(price, p) FILTER (p IS NOT NULL) END AS acf FROM a GROUP BY ALL) SELECT symbol, count(acf) AS days, {r('avg(acf)', 'mean_acf')}, {r('avg(acf) / (stddev_samp(acf) / sqrt(count(acf)))', 't')} FROM b GROUP BY symbol",
)
register("spectrum_detrend", lambda s, d: sp.detrend(bars(s, d), ["symbol"], "bar", "volume", 4).select("symbol", "bar", "detrended"), f"WITH {BARS_SQL}, a AS (SELECT symbol, bar, volume - avg(volume) OVER o AS v, count(*) OVER o AS n FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT symbol, bar, {r('v', 'detrended')} FROM a WHERE n = 9")
register("spectrum_autocovariance", lambda s, d: sp.autocovariance(bars(s, d), ["symbol"], "bar", "volume", 20))
register("spectrum_periods", lambda s, d: sp.top_periods(sp.spectrum(sp.autocovariance(bars(s, d), ["symbol"], "bar", "volume", 40), ["symbol"], SEC, 40), ["symbol"], 3))
register("spectrum_panel", lambda s, d: sp.intraday_panel(tape(s, d), 21600, 0.5).withColumn("day", F.unix_date("day")), f"WITH {TAPE_SQL}, a AS (SELECT symbol, us // {DAY * 1000000} AS day, us // 21600000000 % 4 AS bin, sum(qty) AS volume FROM tape GROUP BY ALL), g AS (SELECT symbol, day FROM a GROUP BY ALL HAVING (max(bin) - min(bin) + 1) / 4 >= 0.5) SELECT g.symbol, g.day::INT AS day, b.bin, {r('coalesce(volume, 0)', 'volume')} FROM g CROSS JOIN (SELECT unnest(range(4)) AS bin) b LEFT JOIN a ON a.symbol = g.symbol AND a.day = g.day AND a.bin = b.bin")
register("spectrum_quintiles", lambda s, d: sp.trailing_quintile(bars(s, d), ["symbol"], "bar", "volume", 30).select("symbol", "bar", "quintile"), f"WITH {BARS_SQL}, a AS (SELECT symbol, bar, volume, list(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l FROM bars) SELECT symbol, bar, CASE WHEN len(l) >= 10 THEN greatest(1, ceil(len(list_filter(l, lambda v: v <= volume)) / len(l) * 5))::INT END AS quintile FROM a")
register("spectrum_long_short", lambda s, d: sp.long_short(sp.trailing_quintile(bars(s, d).withColumn("y", div(S.lead(c("close")), c("close")) - 1), ["symbol"], "bar", "volume", 30), ["symbol"], "y"))
register("features_longest_run", lambda s, d: ft.longest_run(tape(s, d), ["symbol"], "seq"))
register("features_sequences", lambda s, d: ft.sequences(bars(s, d), ["close", "volume"], 5, 3).select("symbol", "bar", F.size("sequence").alias("rows"), F.aggregate("sequence", F.lit(0.0), lambda t, v: t + v[1]).alias("volume")), f"WITH {BARS_SQL}, a AS (SELECT symbol, bar, count(*) {w(5)} AS k, sum(volume) {w(5)} AS v, row_number() {P} - 1 AS i FROM bars) SELECT symbol, bar, k::INT AS rows, {r('v', 'volume')} FROM a WHERE k = 5 AND i % 3 = 0")
register("features_every_nth", lambda s, d: ft.every_nth(bars(s, d), 3, S).select("symbol", "bar", "n_trades"), f"WITH {BARS_SQL} SELECT symbol, bar, n_trades FROM bars QUALIFY (row_number() {P} - 1) % 3 = 0")
register("features_balanced", lambda s, d: ft.balance(tape(s, d).select("seq", "side"), "side", ["seq"]).groupBy("side").agg(F.count("*").alias("n")), f"WITH {TAPE_SQL}, a AS (SELECT side, count(*) AS n FROM tape GROUP BY side) SELECT side, (SELECT min(n) FROM a) AS n FROM a")
register("grid_fill", lambda s, d: grid(bars(s, d).withColumn("ts", F.timestamp_seconds("bar")).select("symbol", "ts", "volume"), SEC).select("symbol", F.unix_seconds("ts").alias("bar"), F.coalesce("volume", F.lit(0.0)).alias("volume")), f"WITH {BARS_SQL}, e AS (SELECT symbol, unnest(range(min(bar), max(bar) + 1, {SEC})) AS bar FROM bars GROUP BY symbol) SELECT symbol, bar, {r('coalesce(volume, 0)', 'volume')} FROM e LEFT JOIN bars USING (symbol, bar)")
register("value_counts", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")

# --- compositions ---------------------------------------------------------------------------------
from tickloom.operators import compose as cm  # noqa: E402
from tickloom.queries import events_at  # noqa: E402

register("compose_all_indicators", lambda s, d: cm.all_indicators(tape(s, d), SEC))
register("compose_microstructure_frame", lambda s, d: cm.microstructure_frame(tape(s, d), SEC))
register("compose_liquidity_cycle", lambda s, d: cm.liquidity_cycle(shocks(s, d), tape(s, d), 4 * BSEC * 1000))
register("compose_gaps_by_size", lambda s, d: cm.gaps_by_size(tape(s, d), [SEC, 2 * SEC], 12))
register("compose_book_around", lambda s, d: cm.book_around(s.range(5).select(F.lit(0).alias("symbol"), c("id").alias("event_id"), (c("id") * 10 + 20).cast("double").alias("at")), book(s, d), 10, 10))
register("exit_atr", lambda s, d: cm.atr_exits(bars(s, d)).select("symbol", "bar", "stop", "target"))
register(
    "exit_percentile",
    lambda s, d: cm.percentile_exits(bars(s, d), 50).select("symbol", "bar", "stop", "target"),
    f"WITH {RET_SQL}, a AS (SELECT symbol, bar, abs(ret) AS a FROM t) SELECT symbol, bar, {r('2 * ' + '(' + at_least(20, 'a', 51, 'quantile_cont(a, 0.75)') + ')', 'stop')}, {r('2 * ' + '(' + at_least(20, 'a', 51, 'quantile_cont(a, 0.9)') + ')', 'target')} FROM a",
)
register("exit_chandelier", lambda s, d: cm.chandelier(bars(s, d), 10).select("symbol", "bar", "long_stop", "short_stop"))
register("sim_indicator_backtest", lambda s, d: cm.indicator_backtest(factored(s, d), "factor", 0.3, -0.3, 8, 0.01, 0.012, 2))
register("sim_trade_exits", lambda s, d: cm.trade_exits(events_at(s, d).withColumn("side", F.lit(1)), tape(s, d), 7200.0, 2.0))
register("sim_adaptive_threshold", lambda s, d: sm.recur(factored(s, d), cm.adaptive_threshold, ["factor", "close"], ["position", "ret"], n=60, every=10).select("symbol", "bar", "position", "ret"))
for _n, (_how, _p) in {"v0_ewm": ("ewm", {"alpha": 0.2, "adjust": True}), "v03_kalman": ("kalman", {}), "v05_kaufman": ("kaufman", {}), "v06_bilateral": ("bilateral", {"width": 3, "sigma_t": 2.0, "sigma_x": 0.3}), "v50_polyfit": ("polyfit", {"n": 10}), "v60_slope": ("slope", {"n": 10})}.items():
    register(f"variant_{_n}", lambda s, d, how=_how, p=_p: cm.variant(bars(s, d), 8, how, p, k=0.5, window=30).select("symbol", "bar", "position", "ret", "equity"))
register("study_split_half", lambda s, d: cm.split_half(xy(s, d), ["symbol"], "bar"), f"WITH {XY_SQL}, h AS (SELECT *, ntile(2) {P} AS half FROM xy0), e AS (SELECT symbol, corr(x, y) FILTER (half = 1) AS a, corr(x, y) FILTER (half = 2) AS b FROM h WHERE y IS NOT NULL GROUP BY symbol) SELECT symbol, {r('a', 'ic_1')}, {r('b', 'ic_2')}, (a * b > 0)::INT AS agree, {r('(abs(a) + abs(b)) / 2', 'mean_abs')} FROM e")
register("study_threshold_sensitivity", lambda s, d: cm.threshold_sensitivity(factored(s, d), "factor", [0.5, 1.0, 2.0], 40))
register("feature_matrix", lambda s, d: cm.feature_matrix(tape(s, d), SEC))
register("compose_trade_microstructure", lambda s, d: cm.trade_microstructure(tape(s, d), SEC, (5, 20)).select("symbol", "bar", "avg_fill_size", "hhi", "avg_fill_size_mean5", "avg_fill_size_std20", "n_trades_mean20", "trade_rate_std5", "vwap_dev_mean5"))
