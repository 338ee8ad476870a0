"""DuckDB SQL of further registered queries, each written from the operator's definition.

Machines with state of their own, and compositions of queries that have SQL, have none here.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np

from tickloom.operators.indicators import TAIL_BOTTOM, TAIL_FAR, TAIL_TOP
from tickloom.queries import BARS_SQL, MERGE_SQL, MERGED_AGG, OHLC_SQL, ORACLE_SQL, P, SEC, TAKER_SQL, TAPE_SQL, at_least, r, w
from tickloom.queries_more import BOOK_SQL, BSEC, DB_SQL, DCOLS, FX, HELD_SQL, LABEL, MB_SQL, BOTH, PATH_SQL, PS, SIG_SQL, XY_SQL, H, sides, time_window, tl, ws

S = ORACLE_SQL
E = "1e-10"


def named(columns: dict[str, str]) -> str:
    return ", ".join(r(x, n) for n, x in columns.items())


def corr(a: str, b: str, over: str, least: int) -> str:
    """Pearson of complete pairs over a window, null with fewer than least or without variance."""
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) {over} >= {least} AND min({x}) {over} < max({x}) {over} AND min({y}) {over} < max({y}) {over} THEN corr({x}, {y}) {over} END"


# --- bars -----------------------------------------------------------------------------------------
S["bars_merged_volume"] = f"""WITH RECURSIVE {MERGE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM m),
v AS (SELECT symbol, i, qty AS acc, 0::BIGINT AS bar_id FROM n WHERE i = 1 UNION ALL
      SELECT n.symbol, n.i, CASE WHEN v.acc >= 3000 THEN n.qty ELSE v.acc + n.qty END, v.bar_id + CASE WHEN v.acc >= 3000 THEN 1 ELSE 0 END FROM v JOIN n ON n.symbol = v.symbol AND n.i = v.i + 1)
SELECT symbol, bar_id, {MERGED_AGG}, {r("greatest((max(us) - min(us)) / 1e6, 0.001)", "bar_duration_sec")} FROM n JOIN v USING (symbol, i) GROUP BY symbol, bar_id"""
COUNT_SQL = f"""{TAPE_SQL}, k AS (SELECT *, (row_number() {PS} - 1) // 40 AS bar_id FROM tape),
cb AS (SELECT symbol, bar_id, {OHLC_SQL}, greatest((max(us) - min(us)) / 1e6, 0.001) AS seconds FROM k GROUP BY ALL)"""
S["bars_average_seconds"] = f"WITH {COUNT_SQL} SELECT symbol, {r('median(seconds)', 'seconds')} FROM cb GROUP BY symbol"
S["bars_volume_threshold"] = f"WITH {COUNT_SQL} SELECT symbol, scale::DOUBLE AS scale, {r('median(volume) * scale', 'volume_per_bar')} FROM cb, (VALUES (0.5), (1.0), (2.0)) v(scale) GROUP BY symbol, scale"
_COMPARED = f"count(*) AS n_bars, {r('{0}', 'median_seconds')}, {r('stddev_samp(ret)', 'std')}, {r('avg(abs(ret))', 'mean_abs')}"
S["bars_comparison"] = f"""WITH {COUNT_SQL}, tb AS (SELECT symbol, us // {SEC * 1000000} * {SEC} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL),
a AS (SELECT *, close / lag(close) {P} - 1 AS ret FROM tb), b AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS ret FROM cb)
SELECT symbol, 'time' AS kind, {_COMPARED.format('NULL')} FROM a GROUP BY symbol UNION ALL SELECT symbol, 'count' AS kind, {_COMPARED.format('median(seconds)')} FROM b GROUP BY symbol"""
MEAN20 = f"avg({{0}}) {w(20)}"
_RAW = {
    "n_fills": "n_fills",
    "volume_at_high": "volume_at_high",
    "return_1": f"(close / lag(close) {P} - 1) * 1e4",
    "log_return": f"ln(close / lag(close) {P})",
    "price_range": "spread",
    "signed_volume": "signed",
    "trade_imbalance": f"signed / (volume + {E})",
    "abs_imbalance": f"abs(signed / (volume + {E}))",
    "buy_volume_pct": f"buy_volume / (volume + {E})",
    "avg_trade_size": "volume / n_trades",
    "fills_per_agg": "n_fills / n_trades",
    "price_impact": f"abs(step) / (volume + {E})",
    "signed_price_impact": f"step / (signed + CASE WHEN signed >= 0 THEN {E} ELSE -{E} END)",
    "vwap": "value / volume",
    "vwap_deviation": "(close - value / volume) / (value / volume) * 1e4",
    "bar_efficiency": f"abs(close - open) / (spread + {E})",
    "body_direction": "sign(close - open)",
    "upper_wick_pct": f"(high - greatest(open, close)) / (spread + {E})",
    "lower_wick_pct": f"(least(open, close) - low) / (spread + {E})",
    "volume_per_range": f"volume / (spread + {E})",
    "roll_spread": f"CASE WHEN count(CASE WHEN before IS NOT NULL THEN step END) {w(60)} >= 10 THEN 2 * sqrt(greatest(0, -covar_samp(CASE WHEN before IS NOT NULL THEN step END, before) {w(60)})) END",
    "buy_sell_log_ratio": "ln((buy_volume + 1) / (sell_volume + 1))",
    "volume_ratio": f"volume / (avg(volume) {w(20)} + {E})",
    "trade_rate": f"n_trades / {SEC}",
    "parkinson_vol_raw": "ln(high / low) ** 2 / (4 * ln(2))",
    "efficiency_ratio": f"CASE WHEN count(step) {w(20)} >= 20 THEN abs(close - lag(close, 20) {P}) / (sum(abs(step)) {w(20)} + {E}) END",
    "small_vol_pi_ratio": f"avg(CASE WHEN small THEN pi END) {w(20)} / (avg(CASE WHEN NOT small THEN pi END) {w(20)} + {E})",
    "small_vol_signed_volume": "CASE WHEN small THEN signed ELSE 0 END",
    "small_vol_return": f"CASE WHEN small THEN (close / lag(close) {P} - 1) * 1e4 ELSE 0 END",
    "small_vol_volume": "CASE WHEN small THEN volume ELSE 0 END",
}
_TICKS = {"n_prices": "count(DISTINCT price)", "max_trade": "max(qty)", "size_cv": "coalesce(stddev_samp(qty) / avg(qty), 0)", "buy_avg_size": "coalesce(avg(qty) FILTER (side = 'buy'), 0)", "sell_avg_size": "coalesce(avg(qty) FILTER (side = 'sell'), 0)", "large_trade_pct": "avg(large::INT)"}
_PLAIN = ("open", "high", "low", "close", "volume", "n_trades", "buy_volume", "sell_volume", "value", *_TICKS, "size_imbalance")
S["primitives"] = f"""WITH {TAPE_SQL}, a AS (SELECT *, us // {SEC * 1000000} * {SEC} AS bar FROM tape), l AS (SELECT *, qty > 2 * avg(qty) OVER (PARTITION BY symbol, bar) AS large FROM a),
g AS (SELECT symbol, bar, {OHLC_SQL}, sum(n_fills)::BIGINT AS n_fills, sum(notional) AS value, arg_max(qty, price * 1e9 + seq / 1e9) AS volume_at_high, {', '.join(f'{x} AS {n}' for n, x in _TICKS.items())} FROM l GROUP BY symbol, bar),
s AS (SELECT *, high - low AS spread, buy_volume - sell_volume AS signed, close - lag(close) {P} AS step, coalesce((buy_avg_size - sell_avg_size) / nullif(buy_avg_size + sell_avg_size, 0), 0) AS size_imbalance FROM g),
t AS (SELECT *, lag(step) {P} AS before, abs(step) / (volume + {E}) AS pi, volume <= quantile_cont(volume, 0.5) {w(20)} AS small FROM s),
u AS (SELECT symbol, bar, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in ({n: n for n in _PLAIN} | _RAW).items())} FROM t)
SELECT symbol, bar, {', '.join(f"coalesce(last_value({n} IGNORE NULLS) OVER o, 0)::BIGINT AS {n}" if n in ("n_trades", "n_prices", "n_fills") else r(f"coalesce(last_value({n} IGNORE NULLS) OVER o, 0)", n) for n in (*_PLAIN, *_RAW))}
FROM u WINDOW o AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# --- books ----------------------------------------------------------------------------------------
SIDE = "list_sum(list_transform({0}, lambda v, i: {1}))"


def slope(side: str) -> str:
    x, y, xy, xx = (SIDE.format(side, f) for f in ("0.01 * i", "v", "0.01 * i * v", "0.0001 * i * i"))
    return f"(5 * {xy} - {x} * {y}) / (5 * {xx} - {x} * {x})"


S["book_depth_slope"] = f"WITH {BOOK_SQL} SELECT symbol, seq, {named({'bid_slope': slope('b'), 'ask_slope': slope('a'), 'slope_asymmetry': f'{slope("b")} - ({slope("a")})'})} FROM book"
Q = "OVER (PARTITION BY symbol ORDER BY seq)"
DEPTHS = f"{BOOK_SQL}, d AS (SELECT symbol, seq, list_sum(b) AS bid, list_sum(a) AS ask FROM book), c AS (SELECT *, bid / lag(bid) {Q} - 1 AS cb, ask / lag(ask) {Q} - 1 AS ca FROM d)"
S["book_depth_change_rate"] = f"""WITH {DEPTHS} SELECT symbol, seq, {named({
    'bid_depth': 'bid', 'ask_depth': 'ask',
    'bid_change_mean': f'avg(cb) {w(10, "seq")}', 'bid_change_std': f'CASE WHEN count(cb) {w(10, "seq")} >= 2 THEN stddev_samp(cb) {w(10, "seq")} END', 'bid_momentum': f'bid / lag(bid, 10) {Q} - 1',
    'ask_change_mean': f'avg(ca) {w(10, "seq")}', 'ask_change_std': f'CASE WHEN count(ca) {w(10, "seq")} >= 2 THEN stddev_samp(ca) {w(10, "seq")} END', 'ask_momentum': f'ask / lag(ask, 10) {Q} - 1',
    'change_asymmetry': f'avg(cb) {w(10, "seq")} - avg(ca) {w(10, "seq")}'})} FROM c"""
S["book_depth_resilience"] = f"""WITH {DEPTHS}, e AS (SELECT symbol, seq, bid + ask AS depth FROM d), f AS (SELECT *, lag(depth, 3) {Q} AS before, min(depth) {w(3, "seq")} AS low FROM e),
g AS (SELECT *, (depth / before - 1 <= -0.2)::INT AS is_shock FROM f), h AS (SELECT *, CASE WHEN is_shock = 1 THEN (depth - low) / (before - low + {E}) END AS back FROM g)
SELECT symbol, seq, {r('depth', 'depth')}, is_shock, {r(f'avg(back) {w(10, "seq")}', 'depth_resilience')} FROM h"""

# --- indicators -----------------------------------------------------------------------------------
S["ind_aggressive_flow"] = f"""WITH {TAPE_SQL}, t AS (SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) {time_window(H)} AS net, sum(qty) {time_window(H)} AS total FROM tape),
v AS (SELECT symbol, seq, net / (total + {E}) AS imbalance, {tl(20, 'total', 100, 'total').replace('THEN total', 'THEN total / (avg(total)').replace(' END', f' + {E}) END')} AS volume_ratio FROM t)
SELECT symbol, seq, {named({'imbalance': 'imbalance', 'volume_ratio': 'volume_ratio'})} FROM v WHERE abs(imbalance) >= 0.5 AND volume_ratio >= 1.2"""


def gridded(source: str, value: str, missing: str = "v") -> str:
    return f"""{source}, a AS ({value}), e AS (SELECT symbol, unnest(range(min(bar), max(bar) + 1, {BSEC})) AS bar FROM a GROUP BY symbol),
g AS (SELECT e.symbol, e.bar, {missing} AS v FROM e LEFT JOIN a USING (symbol, bar))"""


_BAR = f"us // {BSEC * 1000000} * {BSEC} AS bar"
S["ind_large_trade_ratio"] = f"""WITH {gridded(f"{TAPE_SQL}, q AS (SELECT *, {tl(50, 'qty', 1000, 'quantile_cont(qty, 0.9)')} AS high FROM tape)", f"SELECT symbol, {_BAR}, sum(CASE WHEN qty >= high THEN qty ELSE 0 END) / (sum(qty) + {E}) AS v FROM q GROUP BY ALL")}
SELECT symbol, bar, {named({'share': 'v', 'large_trade_ratio': at_least(5, 'v', 20, 'avg(v)')})} FROM g"""
S["ind_sweep_depth_autocorr"] = f"""WITH {gridded(TAKER_SQL, f"SELECT symbol, {_BAR}, avg(levels_swept) AS v FROM taker GROUP BY ALL", "coalesce(v, 1)")}, k AS (SELECT *, lag(v) {P} AS p FROM g)
SELECT symbol, bar, {r(corr('v', 'p', w(30), 10), 'sweep_depth_autocorr')} FROM k"""
S["ind_taker_size_skewness"] = f"WITH {gridded(TAKER_SQL, f'SELECT symbol, {_BAR}, avg(total_volume) AS v FROM taker GROUP BY ALL')} SELECT symbol, bar, {r(at_least(20, 'v', 40, 'skewness(v)'), 'taker_size_skewness')} FROM g"

# --- rules and signals ----------------------------------------------------------------------------
IMB = f"({{0}} - {{1}}) / (abs({{0}}) + abs({{1}}) + {E})"
S["rule_weighted_vwap_dist_sum"] = f"WITH {MB_SQL} SELECT symbol, bar, {r(at_least(3, 'weighted_vwap_dist', 8, 'avg(weighted_vwap_dist)'), 'factor')} FROM mb"
for _n, _x in {"vwap_dist_sum_delta_imbalance": "vwap_dist_sum", "off_top_volume_delta_imbalance": "off_top_cost"}.items():
    S[f"rule_{_n}"] = f"WITH {MB_SQL}, d AS (SELECT symbol, bar, buy_{_x} - lag(buy_{_x}) {P} AS b, sell_{_x} - lag(sell_{_x}) {P} AS s FROM mb) SELECT symbol, bar, {r(IMB.format('b', 's'), 'factor')} FROM d"
S["rule_volume_asymmetry"] = f"WITH {MB_SQL}, d AS (SELECT symbol, bar, {IMB.format('buy_volume', 'sell_volume')} AS v FROM mb) SELECT symbol, bar, {r(f'({at_least(3, "v", 8, "avg(v)")}) - ({at_least(3, "v", 32, "avg(v)")})', 'factor')} FROM d"
S["rule_volume_autocorr_imbalance"] = f"""WITH {MB_SQL}, l AS (SELECT *, lag(buy_volume) {P} AS bp, lag(sell_volume) {P} AS sp FROM mb),
d AS (SELECT symbol, bar, {corr('buy_volume', 'bp', w(8), 3)} AS b, {corr('sell_volume', 'sp', w(8), 3)} AS s FROM l) SELECT symbol, bar, {r(IMB.format('b', 's'), 'factor')} FROM d"""
S["signal_rank"] = f"""WITH {SIG_SQL}, l AS (SELECT *, list(x) {w(40)} AS l FROM f), k AS (SELECT *, CASE WHEN len(l) >= 10 THEN (len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2) / len(l) END AS rank FROM l)
SELECT symbol, bar, {sides('rank > 0.8', 'rank < 0.2')} AS signal FROM k"""
S["size_vol_target"] = f"""WITH {BARS_SQL}, t AS (SELECT symbol, bar, {sides(f'{FX} > 0.2', f'{FX} < -0.2')} AS s, (close / lag(close) {P} - 1) * 1e4 AS ret FROM bars), v AS (SELECT *, {at_least(5, 'ret', 20, 'stddev_samp(ret)')} AS vol FROM t)
SELECT symbol, bar, {r('s * least(3, 10 / greatest(coalesce(vol, 1e9), 1))', 'position')} FROM v"""

# --- labels and metrics ---------------------------------------------------------------------------
S["label_summary"] = f"""WITH {PATH_SQL}, o AS (SELECT symbol, {LABEL} AS label, coalesce(hit, len) AS hit_bar, CASE WHEN hit IS NULL OR ({BOTH}) THEN bc / close - 1 WHEN bh >= close * 1.012 THEN 0.012 ELSE -0.01 END AS ret, mfe, mae FROM x JOIN m USING (symbol, bar)),
s AS (SELECT symbol, label, count(*) AS n, avg(ret) AS a, avg(hit_bar) AS b, avg(mfe) AS c, avg(mae) AS d FROM o GROUP BY ALL)
SELECT symbol, label, n, {named({'mean_ret': 'a', 'mean_bars': 'b', 'mean_mfe': 'c', 'mean_mae': 'd', 'share': 'n / sum(n) OVER (PARTITION BY symbol)'})} FROM s"""
RUNS = f"{HELD_SQL}, z AS (SELECT symbol, bar, p, held, ret, sum(ln(1 + greatest(ret, -0.999999))) {P} AS lg FROM y), d AS (SELECT *, 1 - exp(lg) / greatest(max(exp(lg)) {P}, 1) AS dd FROM z)"
YEAR = 365 * 86400 / SEC
S["metric_returns"] = f"""WITH {RUNS}, k AS (SELECT *, exp(last_value(lg) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - 1 AS whole, abs(p - held) AS turn FROM d)
SELECT symbol, count(*) AS n_bars, {named({
    'total_return': 'any_value(whole)', 'annual_return': f'avg(ret) * {YEAR}', 'annual_vol': f'coalesce(stddev_samp(ret) * {math.sqrt(YEAR)!r}, 0)',
    'sharpe': f'coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * {math.sqrt(YEAR)!r}, 0)', 'sortino': f'coalesce(avg(ret) / nullif(sqrt(avg(least(ret, 0) ** 2)), 0) * {math.sqrt(YEAR)!r}, 0)',
    'max_drawdown': 'max(dd)', 'calmar': 'coalesce(any_value(whole) / nullif(max(dd), 0), 0)', 'long_return': 'coalesce(sum(ret) FILTER (held > 0), 0)', 'short_return': 'coalesce(sum(ret) FILTER (held < 0), 0)',
    'turnover': 'sum(turn)', 'exposure': 'avg((p <> 0)::INT)', 'hit_rate': 'coalesce(avg((ret > 0)::INT) FILTER (held <> 0), 0)'})} FROM k GROUP BY symbol"""
S["metric_stretches"] = f"""WITH {HELD_SQL}, n AS (SELECT *, sum((p <> 0 AND p <> held)::INT) {P} AS run FROM y)
SELECT symbol, run::BIGINT AS run, min(bar) AS start, max(bar) AS "end", count(*) AS bars, {r('arg_min(p, bar)', 'side')}, {r('sum(ret)', 'ret')} FROM n WHERE run > 0 AND (p <> 0 OR held <> 0) GROUP BY symbol, run"""
S["metric_streaks"] = f"""WITH {HELD_SQL}, a AS (SELECT symbol, bar, ret > 0 AS won, CASE WHEN (ret > 0) = lag(ret > 0) {P} THEN 0 ELSE 1 END AS turn FROM y), b AS (SELECT *, sum(turn) {P} AS run FROM a), n AS (SELECT symbol, run, won, count(*) AS n FROM b GROUP BY ALL)
SELECT symbol, coalesce(max(n) FILTER (won), 0) AS max_wins, coalesce(max(n) FILTER (NOT won), 0) AS max_losses FROM n GROUP BY symbol"""
S["metric_report_series"] = f"""WITH {RUNS} SELECT symbol, bar, {named({'cum_return': 'exp(lg) - 1', 'drawdown': 'dd', 'long_curve': f'sum(CASE WHEN held > 0 THEN ret ELSE 0 END) {P}', 'turnover_ma': f'avg(abs(p - held)) {w(30)}'})},
(p <> 0 AND held = 0)::INT AS is_entry, (p = 0 AND held <> 0)::INT AS is_exit FROM d"""

# --- evaluation and spectrum ----------------------------------------------------------------------
O30 = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
ROLL = f"{XY_SQL}, ri AS (SELECT symbol, bar, CASE WHEN row_number() {P} > 30 AND count(y) {O30} > 10 THEN corr(CASE WHEN y IS NOT NULL THEN x END, y) {O30} END AS v FROM xy0)"
S["eval_stability"] = f"""WITH {ROLL}, k AS (SELECT *, lag(v) {P} AS p FROM ri WHERE v IS NOT NULL)
SELECT symbol, count(v) AS n, {', '.join(r(f'CASE WHEN count(v) >= 5 THEN {x} END', n) for n, x in {'ic_mean': 'avg(v)', 'ic_std': 'stddev_samp(v)', 'ic_ir': 'avg(v) / stddev_samp(v)', 'ic_positive': 'avg((v > 0)::INT)', 'ic_autocorr': 'corr(v, p)'}.items())} FROM k GROUP BY symbol"""
_LR = f"{BARS_SQL}, q AS (SELECT symbol, bar, bar // 86400 AS day, ln(close / lag(close) {P}) AS lr FROM bars), x AS (SELECT symbol, bar, lr - avg(lr) OVER (PARTITION BY symbol, day) AS v FROM q)"
S["spectrum_return_acf"] = f"""WITH {_LR}, l AS (SELECT symbol, k AS lag, v, CASE k WHEN 1 THEN lag(v, 1) OVER o WHEN 2 THEN lag(v, 2) OVER o ELSE lag(v, 3) OVER o END AS p FROM x, (VALUES (1), (2), (3)) t(k) WINDOW o AS (PARTITION BY symbol, k ORDER BY bar)),
n AS (SELECT symbol, count(v) AS n FROM x GROUP BY symbol), a AS (SELECT symbol, lag, corr(v, p) FILTER (v IS NOT NULL AND p IS NOT NULL) AS acf FROM l GROUP BY ALL)
SELECT symbol, lag, {r('acf', 'acf')}, n, {r('2 / sqrt(n)', 'band')}, abs(acf) > 2 / sqrt(n) AS significant FROM a JOIN n USING (symbol)"""
ACV = f"""{BARS_SQL}, z AS (SELECT symbol, volume - avg(volume) OVER (PARTITION BY symbol) AS v, row_number() {P} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
g AS (SELECT a.symbol, k AS lag, sum(a.v * b.v) / any_value(a.n - k) AS gamma, any_value(a.n) AS n FROM z a CROSS JOIN (SELECT unnest(range({{0}} + 1)) AS k) JOIN z b ON b.symbol = a.symbol AND b.i = a.i + k GROUP BY a.symbol, k)"""
S["spectrum_autocovariance"] = f"WITH {ACV.format(20)} SELECT symbol, lag::INT AS lag, {r('gamma', 'gamma')}, n FROM g"
S["spectrum_long_short"] = f"""WITH {BARS_SQL}, a AS (SELECT symbol, volume, lead(close) {P} / close - 1 AS y, list(volume) {O30} AS l FROM bars),
q AS (SELECT symbol, y, CASE WHEN len(l) >= 10 THEN greatest(1, ceil(len(list_filter(l, lambda v: v <= volume)) / len(l) * 5)) END AS q FROM a)
SELECT symbol, count(y) FILTER (q = 5) AS n_long, count(y) FILTER (q = 1) AS n_short, {r('avg(y) FILTER (q = 5) - avg(y) FILTER (q = 1)', 'spread')},
{r('(avg(y) FILTER (q = 5) - avg(y) FILTER (q = 1)) / sqrt(var_samp(y) FILTER (q = 5) / count(y) FILTER (q = 5) + var_samp(y) FILTER (q = 1) / count(y) FILTER (q = 1))', 't')} FROM q GROUP BY symbol"""
S["features_longest_run"] = f"""WITH {TAPE_SQL}, a AS (SELECT symbol, seq, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY seq) THEN 0 ELSE 1 END AS turn FROM tape), b AS (SELECT symbol, sum(turn) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM a),
n AS (SELECT symbol, run, count(*) AS n FROM b GROUP BY ALL) SELECT symbol, max(n) AS longest_run FROM n GROUP BY symbol"""
S["scan_pivot"] = f"""WITH {XY_SQL}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS b FROM xy)
SELECT symbol, {r('corr(a, b)', 'x')}, {r('-corr(a, b)', 'z')} FROM k GROUP BY symbol"""
S["detect_spread_expansion"] = f"""WITH {TAPE_SQL}, s AS (SELECT *, round(abs(avg(price) FILTER (side = 'buy') {ws(50)} - avg(price) FILTER (side <> 'buy') {ws(50)}), 9) AS spread FROM tape), l AS (SELECT *, list(spread) FILTER (spread IS NOT NULL) {ws(50)} AS l FROM s),
k AS (SELECT symbol, seq, CASE WHEN len(l) >= 10 THEN 100.0 * len(list_filter(l, lambda v: v < spread)) / len(l) END AS pct FROM l) SELECT symbol, seq, {r('pct', 'spread_pct')}, coalesce(pct >= 80, false) AS expanded FROM k"""
S["compose_trade_microstructure"] = f"""WITH {TAPE_SQL}, a AS (SELECT *, us // {SEC * 1000000} * {SEC} AS bar FROM tape), e AS (SELECT *, min(price) OVER (PARTITION BY symbol, bar) AS lo, max(price) OVER (PARTITION BY symbol, bar) AS hi FROM a),
l AS (SELECT symbol, bar, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE least(4, floor((price - lo) / (hi - lo) * 5)) END AS level, sum(qty) AS v FROM e GROUP BY ALL),
h AS (SELECT symbol, bar, sum(share * share) AS hhi FROM (SELECT *, v / sum(v) OVER (PARTITION BY symbol, bar) AS share FROM l) GROUP BY symbol, bar),
g AS (SELECT symbol, bar, avg(qty / greatest(n_fills, 1)) AS fill, count(*) AS n, count(*) / {SEC} AS rate, sum(notional) / sum(qty) AS vwap, arg_max(price, seq) AS close FROM a GROUP BY symbol, bar),
b AS (SELECT *, (close - vwap) / (close + 1e-10) * 100 AS dev FROM g JOIN h USING (symbol, bar))
SELECT symbol, bar, {named({'avg_fill_size': 'fill', 'hhi': 'hhi', **{n: f'coalesce({at_least(2, x, k, f"{f}({x})")}, 0)' for n, x, k, f in (('avg_fill_size_mean5', 'fill', 5, 'avg'), ('avg_fill_size_std20', 'fill', 20, 'stddev_samp'), ('n_trades_mean20', 'n', 20, 'avg'), ('trade_rate_std5', 'rate', 5, 'stddev_samp'), ('vwap_dev_mean5', 'dev', 5, 'avg'))}})} FROM b"""

# --- paths by self-joins and recursions -----------------------------------------------------------
S["spectrum_periods"] = f"""WITH {ACV.format(40)}, h AS (SELECT symbol, max(lag) AS h, max(gamma) FILTER (lag = 0) AS v FROM g GROUP BY symbol),
s AS (SELECT symbol, j, any_value(h) AS h, any_value(v) AS v, greatest(sum(CASE WHEN lag = 0 OR lag = h THEN 1 ELSE 2 END * gamma * cos(j * lag * pi() / h)) / any_value(h), 0) AS a2 FROM g JOIN h USING (symbol) CROSS JOIN (SELECT unnest(range(1, 41)) AS j) GROUP BY symbol, j)
SELECT symbol, j::INT AS j, {named({'period_sec': f'2 * h * {SEC} / j', 'a2': 'a2', 'share': 'a2 / v'})}, row_number() OVER (PARTITION BY symbol ORDER BY a2 DESC, j)::INT AS rank FROM s QUALIFY rank <= 3"""
NUM = f"{BARS_SQL}, n AS (SELECT *, row_number() {P} AS i FROM bars)"
S["smooth_kaufman"] = f"""WITH RECURSIVE {NUM}, d AS (SELECT *, abs(close - lag(close) {P}) AS step FROM n), e AS (SELECT *, abs(close - lag(close, 10) {P}) AS move, sum(step) {w(10)} AS path FROM d),
k AS (SELECT symbol, bar, i, close, power(CASE WHEN path > 0 THEN move / path ELSE 0 END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS k FROM e),
y AS (SELECT symbol, bar, i, close AS y FROM k WHERE i = 1 UNION ALL SELECT k.symbol, k.bar, k.i, CASE WHEN k.i <= 10 THEN k.close ELSE y.y + k.k * (k.close - y.y) END FROM y JOIN k ON k.symbol = y.symbol AND k.i = y.i + 1)
SELECT symbol, bar, {r('y', 'y')} FROM y"""
FITTED = [float(np.polyval(np.polyfit(np.arange(12.0), np.eye(12)[k], 3), 11.0)) for k in range(12)]
S["smooth_polyfit"] = f"WITH {BARS_SQL}, l AS (SELECT symbol, bar, list(close) {w(12)} AS l FROM bars) SELECT symbol, bar, {r(f'CASE WHEN len(l) = 12 THEN list_inner_product(l, {FITTED}::DOUBLE[]) END', 'y')} FROM l"
S["smooth_bilateral"] = f"""WITH {NUM}, j AS (SELECT a.symbol, a.bar, b.close AS v, exp(-power((b.i - a.i) / 2.0, 2) / 2 - power(b.close - a.close, 2) / 2) AS weight FROM n a JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 3 AND a.i + 3)
SELECT symbol, bar, {r('sum(weight * v) / sum(weight)', 'y')} FROM j GROUP BY symbol, bar"""
S["label_volatility_barriers"] = f"""WITH {BARS_SQL}, q AS (SELECT *, ln(close / lag(close) {P}) AS lr FROM bars), v0 AS (SELECT symbol, bar, close, {at_least(10, 'lr', 30, 'stddev_samp(lr)')} AS vol FROM q), v AS (SELECT *, row_number() {P} AS i FROM v0 WHERE vol > 0),
h AS (SELECT a.symbol, a.bar, a.close, a.vol, b.i - a.i AS k, b.close AS bc FROM v a JOIN v b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 12),
f AS (SELECT symbol, bar, any_value(close) AS close, any_value(vol) AS vol, max(k) AS len, min(k) FILTER (bc >= close * (1 + 2 * vol) OR bc <= close * (1 - 2 * vol)) AS hit FROM h GROUP BY symbol, bar)
SELECT f.symbol, f.bar, CASE WHEN hit IS NULL THEN 'time' WHEN bc >= f.close * (1 + 2 * f.vol) THEN 'upper' ELSE 'lower' END AS label, coalesce(hit, len) AS hit_bar,
{r('CASE WHEN hit IS NULL THEN bc / f.close - 1 WHEN bc >= f.close * (1 + 2 * f.vol) THEN 2 * f.vol ELSE -2 * f.vol END', 'ret')} FROM f JOIN h ON h.symbol = f.symbol AND h.bar = f.bar AND h.k = coalesce(hit, len)"""
S["gap_fills"] = f"""WITH {NUM}, g AS (SELECT *, lag(high, 2) {P} AS h2, lag(low, 2) {P} AS l2 FROM n),
k AS (SELECT symbol, bar, i, 'bullish' AS kind, h2 AS bottom, low AS top FROM g WHERE low > h2 UNION ALL SELECT symbol, bar, i, 'bearish', high, l2 FROM g WHERE high < l2),
h AS (SELECT k.*, n.i - k.i AS j, n.high, n.low FROM k LEFT JOIN n ON n.symbol = k.symbol AND n.i > k.i AND n.i <= k.i + 12),
f AS (SELECT *, min(CASE WHEN kind = 'bullish' AND low <= bottom OR kind = 'bearish' AND high >= top THEN j END) OVER (PARTITION BY symbol, bar, kind) AS fill FROM h)
SELECT symbol, bar, kind, any_value(fill)::INT AS fill_bars,
  CASE WHEN any_value(fill) IS NOT NULL THEN 'filled' WHEN bool_or(CASE WHEN kind = 'bullish' THEN low < top ELSE high > bottom END) THEN 'partial' WHEN count(j) >= 12 THEN 'expired' ELSE 'open' END AS status,
  {r("greatest(0, coalesce(CASE WHEN kind = 'bullish' THEN max(high) FILTER (fill IS NULL OR j < fill) - any_value(top) ELSE any_value(bottom) - min(low) FILTER (fill IS NULL OR j < fill) END, 0))", 'max_extension')} FROM f GROUP BY symbol, bar, kind"""
S["eval_rolling_ic_spearman"] = f"""WITH {XY_SQL}, n AS (SELECT *, row_number() {P} AS i FROM xy0), j AS (SELECT a.symbol, a.bar, b.x, b.y FROM n a JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 30 AND a.i - 1 WHERE a.i > 30 AND b.x IS NOT NULL AND b.y IS NOT NULL),
k AS (SELECT symbol, bar, rank() OVER (PARTITION BY symbol, bar ORDER BY x) + (count(*) OVER (PARTITION BY symbol, bar, x) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol, bar ORDER BY y) + (count(*) OVER (PARTITION BY symbol, bar, y) - 1) / 2 AS b FROM j),
c AS (SELECT symbol, bar, CASE WHEN count(*) > 10 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS v FROM k GROUP BY symbol, bar) SELECT symbol, bar, {r('v', 'rolling_ic')} FROM n LEFT JOIN c USING (symbol, bar)"""
PRIOR = f"coalesce(lag(close) {P}, close)"
TR = f"greatest(high - low, abs(high - {PRIOR}), abs(low - {PRIOR}))"
S["exit_chandelier"] = f"""WITH RECURSIVE {NUM}, d AS (SELECT *, {TR} AS tr FROM n), y AS (SELECT symbol, i, tr AS atr FROM d WHERE i = 1 UNION ALL SELECT d.symbol, d.i, 9.0 / 11 * y.atr + 2.0 / 11 * d.tr FROM y JOIN d ON d.symbol = y.symbol AND d.i = y.i + 1)
SELECT symbol, bar, {named({'long_stop': f'max(high) {w(10)} - 3 * atr', 'short_stop': f'min(low) {w(10)} + 3 * atr'})} FROM n JOIN y USING (symbol, i)"""
S["exit_atr"] = f"""WITH {NUM}, d AS (SELECT *, {TR} AS tr FROM n), l AS (SELECT symbol, bar, close, list(tr) {w(42)} AS l FROM d), a AS (SELECT *, list_reduce(l, lambda y, x: 13.0::DOUBLE / 15 * y + 2.0::DOUBLE / 15 * x) AS atr FROM l)
SELECT symbol, bar, {named({n: f'round(greatest(0.002, least(0.05, {k} * atr / close)), 4)' for n, k in (('stop', 2), ('target', 3))})} FROM a"""


def adx_sql(a: str, least: int) -> str:
    """Directional strength: three exponential means, and one of their spread, from so many values on."""
    return f"""WITH RECURSIVE {NUM}, u AS (SELECT *, coalesce(high - lag(high) {P}, 0) AS up, coalesce(lag(low) {P} - low, 0) AS down, {TR} AS tr FROM n),
d AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus FROM u),
y AS (SELECT symbol, bar, i, plus::DOUBLE AS p, minus::DOUBLE AS m, tr::DOUBLE AS t FROM d WHERE i = 1 UNION ALL
      SELECT d.symbol, d.bar, d.i, (1 - {a}) * y.p + {a} * d.plus, (1 - {a}) * y.m + {a} * d.minus, (1 - {a}) * y.t + {a} * d.tr FROM y JOIN d ON d.symbol = y.symbol AND d.i = y.i + 1),
x AS (SELECT symbol, bar, i, 100 * p / (t + 1e-10) AS plus_di, 100 * m / (t + 1e-10) AS minus_di FROM y WHERE i >= {least}), v AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM x),
z AS (SELECT symbol, i, dx AS s FROM v WHERE i = {least} UNION ALL SELECT v.symbol, v.i, (1 - {a}) * z.s + {a} * v.dx FROM z JOIN v ON v.symbol = z.symbol AND v.i = z.i + 1),
o AS (SELECT n.symbol, n.bar, CASE WHEN n.i >= {2 * least - 1} THEN z.s END AS adx, plus_di, minus_di FROM n LEFT JOIN x USING (symbol, i) LEFT JOIN z USING (symbol, i))
SELECT symbol, bar, {named({k: k for k in ('adx', 'plus_di', 'minus_di')})}"""


S["regime_adx"] = adx_sql("(2.0::DOUBLE / 15)", 1) + ", CASE WHEN adx > 25 THEN 'trending' WHEN adx < 20 THEN 'ranging' ELSE 'neutral' END AS trend_regime FROM o"
S["regime_adx_wilder"] = adx_sql("(1.0::DOUBLE / 14)", 14) + " FROM o"
S["regime_garch"] = f"""WITH RECURSIVE {NUM}, d AS (SELECT symbol, bar, i, 100 * ln(close / lag(close) {P}) AS x FROM n), f AS (SELECT symbol, CASE WHEN count(x) > 1 THEN var_samp(x) END AS v0 FROM d WHERE i BETWEEN 2 AND 21 GROUP BY symbol),
y AS (SELECT symbol, bar, i, x, v0, v0 AS v FROM d JOIN f USING (symbol) WHERE i = 1 UNION ALL SELECT d.symbol, d.bar, d.i, d.x, y.v0, CASE WHEN y.x IS NULL THEN y.v ELSE 0.01 * y.v0 + 0.06 * y.x * y.x + 0.93 * y.v END FROM y JOIN d ON d.symbol = y.symbol AND d.i = y.i + 1)
SELECT symbol, bar, {r('sqrt(v)', 'y')} FROM y"""
S["eval_half_life"] = f"""WITH {ROLL}, l AS (SELECT symbol, bar, k, v, row_number() OVER (PARTITION BY symbol, k ORDER BY bar) AS i FROM ri, (SELECT unnest(range(1, 21)) AS k)), n AS (SELECT symbol, count(v) AS n FROM ri GROUP BY symbol),
a AS (SELECT x.symbol, x.k, corr(x.v, p.v) AS acf FROM l x JOIN l p ON p.symbol = x.symbol AND p.k = x.k AND p.i = x.i - x.k WHERE x.v IS NOT NULL AND p.v IS NOT NULL GROUP BY x.symbol, x.k),
b AS (SELECT symbol, k, acf FROM a JOIN n USING (symbol) WHERE k <= floor(n / 4)), s AS (SELECT symbol, min(k) FILTER (acf < 0.5) AS first, regr_slope(ln(CASE WHEN acf > 0 THEN acf END), k) AS slope FROM b GROUP BY symbol)
SELECT symbol, {r('coalesce(first, CASE WHEN slope < 0 THEN -ln(2) / slope END)', 'half_life')} FROM s"""
S["eval_signal_metrics"] = f"""WITH {XY_SQL}, s AS (SELECT *, sign(round(x, 1)) AS s FROM xy), l AS (SELECT *, lag(s) {P} AS l, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS a,
  rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS b, quantile_cont(abs(y), 0.33) OVER (PARTITION BY symbol) AS t FROM s)
SELECT symbol, count(*) AS n, {', '.join(r(f'CASE WHEN count(*) >= 30 THEN coalesce({x}, 0) ELSE 0 END', k) for k, x in {
    'ic': 'corr(x, y)', 'rank_ic': 'corr(a, b)', 'triple_acc': 'avg((CASE WHEN abs(y) < t THEN 0 ELSE sign(y) END = s)::INT)',
    'long_hit': 'CASE WHEN count(*) FILTER (s = 1) > 5 THEN avg((y > 0)::INT) FILTER (s = 1) END', 'short_hit': 'CASE WHEN count(*) FILTER (s = -1) > 5 THEN avg((y < 0)::INT) FILTER (s = -1) END',
    'mean_bps': 'avg(y * s) FILTER (s <> 0) * 1e4', 'signal_autocorr': 'corr(s, l)', 'change_rate': 'avg((s <> l)::INT)', 'long_share': 'avg((s = 1)::INT)', 'short_share': 'avg((s = -1)::INT)'}.items())} FROM l GROUP BY symbol"""
FWD = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)"
S["sim_threshold_paths"] = f"""WITH {BARS_SQL}, a AS (SELECT symbol, {FX} AS x, -sign({FX}) AS side, lead(close, 8) {P} / close - 1 AS far, max(high) {FWD} / close - 1 AS up, min(low) {FWD} / close - 1 AS down FROM bars),
b AS (SELECT symbol, x, side * far AS ret, CASE WHEN side > 0 THEN up ELSE -down END AS mfe, CASE WHEN side > 0 THEN down ELSE -up END AS mae FROM a WHERE far IS NOT NULL)
SELECT symbol, threshold::DOUBLE AS threshold, count(*) AS n, {named({f'{k}_{n}': f'{f}({n})' for n in ('ret', 'mfe', 'mae') for k, f in (('mean', 'avg'), ('median', 'median'))})} FROM b JOIN (VALUES (0.1), (0.3), (0.5)) t(threshold) ON abs(x) >= threshold GROUP BY symbol, threshold"""
S["sim_reversion_grid"] = f"""WITH {NUM}, a AS (SELECT symbol, i, abs({FX}) AS x FROM n), g AS (SELECT e::DOUBLE AS entry, l::DOUBLE AS leave FROM (VALUES (0.3), (0.5)) t(e), (VALUES (0.1), (0.2)) u(l)),
t AS (SELECT a.symbol, a.i, entry, leave, min(b.i - a.i) FILTER (b.x <= leave) AS tau FROM a JOIN g ON a.x >= entry JOIN a b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 8 GROUP BY ALL)
SELECT symbol, entry, leave, count(*) AS n, {named({'hit_rate': 'avg((tau IS NOT NULL)::INT)', 'mean_tau': 'avg(tau)'})} FROM t GROUP BY symbol, entry, leave"""
SHOCK = f"""{DB_SQL}, sp AS (SELECT *, round(abs(avg(price) FILTER (side = 'buy') {ws(50)} - avg(price) FILTER (side <> 'buy') {ws(50)}), 9) AS spread, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) {ws(50)} / sum(qty) {ws(50)} AS imbalance FROM tape),
sl AS (SELECT *, list(spread) FILTER (spread IS NOT NULL) {ws(50)} AS l FROM sp), st AS (SELECT symbol, us // 1000 AS at, arg_max(CASE WHEN len(l) >= 10 THEN 100.0 * len(list_filter(l, lambda v: v < spread)) / len(l) END, seq) AS spread_pct, arg_max(imbalance, seq) AS imbalance FROM sl GROUP BY ALL),
hit AS (SELECT *, (bucket + 1) * {BSEC * 1000} - 1 AS at, (last - first) / first * 100 AS move FROM g WHERE n_trades >= 2),
shock AS (SELECT hit.*, spread_pct, imbalance, CASE WHEN move > 0 THEN top ELSE bottom END AS peak FROM hit ASOF JOIN st ON hit.symbol = st.symbol AND hit.at >= st.at WHERE abs(move) >= 0.3 AND spread_pct >= 50 AND abs(imbalance) >= 0.1)"""
_SHOWN = f"{DCOLS}, CAST(\"at\" AS BIGINT) AS \"at\", {named({k: k for k in ('spread_pct', 'imbalance', 'peak')})}"
S["detect_liquidity_shocks"] = f"WITH {SHOCK} SELECT {_SHOWN} FROM shock"
S["detect_refills"] = f"""WITH {SHOCK}, w AS (SELECT k.symbol, k.bucket, max(CASE WHEN move > 0 THEN (t.price - peak) / peak * 100 ELSE (peak - t.price) / peak * 100 END) AS beyond, arg_max(t.price, t.us // 1000) AS end_price, sum(t.qty) AS volume_after
  FROM shock k JOIN tape t ON t.symbol = k.symbol AND t.us // 1000 > k.at AND t.us // 1000 <= k.at + {4 * BSEC * 1000} GROUP BY k.symbol, k.bucket),
j AS (SELECT shock.*, beyond, end_price, volume_after, coalesce(beyond <= 0.5, false) AS held FROM shock LEFT JOIN w USING (symbol, bucket))
SELECT {_SHOWN}, {named({'beyond_pct': 'beyond', 'end_price': 'end_price', 'volume_after': 'volume_after'})}, held, CASE WHEN held AND coalesce(CASE WHEN move > 0 THEN end_price < peak ELSE end_price > peak END, false) THEN -sign(move) ELSE 0 END::INT AS signal FROM j"""
S["exit_path"] = f"""WITH {PATH_SQL}, p AS (SELECT symbol, bar, k, bl / close - 1 AS lo, bh / close - 1 AS hi, bc / close - 1 AS gain, max(k) OVER (PARTITION BY symbol, bar) AS len,
  coalesce(greatest(0, max(bc / close - 1) OVER (PARTITION BY symbol, bar ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS peak FROM h),
o AS (SELECT *, CASE WHEN peak > 0 AND lo <= peak - 0.006 THEN 'trail' WHEN lo <= -0.01 THEN 'stop' WHEN hi >= 0.012 THEN 'target' WHEN k = len THEN 'time' END AS why FROM p)
SELECT symbol, bar, k::INT AS exit_bar, why AS exit_reason, {r("CASE why WHEN 'trail' THEN peak - 0.006 WHEN 'stop' THEN -0.01 WHEN 'target' THEN 0.012 ELSE gain END", 'exit_ret')} FROM o WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, bar ORDER BY k) = 1"""


def weighted(name: str, span: int) -> str:
    """Exponential mean with weights that start at 1, from span values on."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""{name}0 AS (SELECT symbol, i, x AS u, 1.0::DOUBLE AS v FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.i, u * (1 - {a}) + q.x, v * (1 - {a}) + 1 FROM {name}0 z JOIN q ON q.symbol = z.symbol AND q.i = z.i + 1),
{name} AS (SELECT symbol, i, CASE WHEN i >= {span} THEN u / v END AS {name} FROM {name}0)"""


S["signal_dual_ma_band"] = f"""WITH RECURSIVE {SIG_SQL}, q AS (SELECT symbol, bar, x, row_number() {P} AS i FROM f), {weighted("fast", 5)}, {weighted("slow", 15)},
d AS (SELECT q.symbol, q.bar, fast - slow AS d FROM q JOIN fast USING (symbol, i) JOIN slow USING (symbol, i)), b AS (SELECT symbol, bar, d, {at_least(7, "d", 30, "stddev_samp(d)")} AS band FROM d)
SELECT symbol, bar, {sides('d > band', 'd < -band')} AS signal FROM b"""


def scanned(factors: dict[str, str], windows: tuple[int, ...], rules: dict[str, str]) -> str:
    """Figures of every factor, window and rule as m. A factor's SQL may hold {n} and {least}, a rule's SQL is over x."""
    own = lambda sql: sql.replace("PARTITION BY symbol", "PARTITION BY symbol, factor, win")
    key = "symbol, factor, win, rule"
    rows = " UNION ALL ".join(f"SELECT symbol, bar, y, '{f}' AS factor, {n} AS win, {q(n)} AS x FROM base" for f, q in factors.items() for n in windows)
    kinds = " UNION ALL ".join(f"SELECT *, '{name}' AS rule, {own(q)} AS s FROM xs" for name, q in rules.items())
    ranks = ", ".join(f"rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2 AS {n}" for v, n in (("x", "a"), ("y", "b")))
    figures = {
        "ic": "corr(x, y)", "rank_ic": "corr(a, b)", "triple_acc": "avg((CASE WHEN abs(y) < t THEN 0 ELSE sign(y) END = s)::INT)",
        "long_hit": "CASE WHEN count(*) FILTER (s = 1) > 5 THEN avg((y > 0)::INT) FILTER (s = 1) END", "short_hit": "CASE WHEN count(*) FILTER (s = -1) > 5 THEN avg((y < 0)::INT) FILTER (s = -1) END",
        "mean_bps": "avg(y * s) FILTER (s <> 0) * 1e4", "signal_autocorr": "CASE WHEN min(s) < max(s) THEN corr(s, l) END", "change_rate": "avg((s <> l)::INT)", "long_share": "avg((s = 1)::INT)", "short_share": "avg((s = -1)::INT)",
    }
    return f"""{BARS_SQL}, base AS (SELECT *, lead(close) {P} / close - 1 AS y FROM bars), xs AS ({rows}), ss AS ({kinds}), ok AS (SELECT {key}, avg((x IS NOT NULL)::INT) AS valid FROM ss GROUP BY ALL HAVING valid >= 0.3),
ls AS (SELECT *, lag(s) OVER (PARTITION BY {key} ORDER BY bar) AS l, quantile_cont(abs(y), 0.33) OVER (PARTITION BY {key}) AS t, {ranks} FROM ss WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT {key}, count(*) AS n, {', '.join(f'CASE WHEN count(*) >= 30 THEN coalesce({x}, 0) ELSE 0 END AS {k}' for k, x in figures.items())}, any_value(valid) AS valid FROM ls JOIN ok USING ({key}) GROUP BY {key})"""


_FIGURES = ("ic", "rank_ic", "triple_acc", "long_hit", "short_hit", "mean_bps", "signal_autocorr", "change_rate", "long_share", "short_share")
_Z40 = f"(x - avg(x) {w(40)}) / (stddev_samp(x) {w(40)} + {E})"
_IMBALANCE = lambda n: f"(buy_volume - sell_volume) / (volume + {E})"
_RULES = {
    "zscore": sides(f"count(x) {w(40)} >= 10 AND {_Z40} > 1", f"count(x) {w(40)} >= 10 AND {_Z40} < -1"),
    "quantile": sides(f"count(x) {w(40)} >= 10 AND x > quantile_cont(x, 0.8) {w(40)}", f"count(x) {w(40)} >= 10 AND x < quantile_cont(x, 0.2) {w(40)}"),
}
_VOLUME = lambda n: f"CASE WHEN count(volume) {w(n)} >= {max(5, n // 4)} THEN (volume - avg(volume) {w(n)}) / (stddev_samp(volume) {w(n)} + {E}) END"
S["scan_signals"] = f"""WITH {scanned({'trade_imbalance': _IMBALANCE, 'volume_zscore': _VOLUME}, (20, 40), _RULES)}
SELECT symbol, factor, win AS "window", rule, n, {named({k: k for k in (*_FIGURES, 'valid')})} FROM m"""


# --- filters, event windows and exits -------------------------------------------------------------
S["smooth_adaptive_ema"] = f"""WITH RECURSIVE {NUM}, a AS (SELECT *, least(0.5, 0.1 * volume / avg(volume) {w(20)}) AS pace FROM n),
y AS (SELECT symbol, bar, i, close AS y FROM a WHERE i = 1 UNION ALL SELECT a.symbol, a.bar, a.i, y.y + a.pace * (a.close - y.y) FROM y JOIN a ON a.symbol = y.symbol AND a.i = y.i + 1)
SELECT symbol, bar, {r('y', 'y')} FROM y"""
S["smooth_kalman"] = f"""WITH RECURSIVE {NUM}, v AS (SELECT symbol, var_pop(close) AS v FROM n GROUP BY symbol), z AS (SELECT n.symbol, bar, i, close, v FROM n JOIN v ON n.symbol = v.symbol),
y AS (SELECT symbol, bar, i, close AS level, v AS p FROM z WHERE i = 1
  UNION ALL SELECT z.symbol, z.bar, z.i, y.level + CASE WHEN y.p + 1.01 * z.v > 0 THEN (y.p + 0.01 * z.v) / (y.p + 1.01 * z.v) ELSE 0 END * (z.close - y.level),
    CASE WHEN y.p + 1.01 * z.v > 0 THEN (1 - (y.p + 0.01 * z.v) / (y.p + 1.01 * z.v)) * (y.p + 0.01 * z.v) ELSE y.p END FROM y JOIN z ON z.symbol = y.symbol AND z.i = y.i + 1)
SELECT symbol, bar, {r('level', 'y')} FROM y"""


def _window_stats(name: str, inside: str) -> dict[str, str]:
    """The statistics of one side of an event window over rows x."""
    f = f"FILTER ({inside})"
    signed = "CASE WHEN side = 'buy' THEN qty ELSE -qty END"
    first = f"arg_min(price, seq) {f}"
    return {
        f"{name}_volume": f"coalesce(sum(qty) {f}, 0)",
        f"{name}_imbalance": f"coalesce(sum({signed}) {f} / sum(qty) {f}, 0)",
        f"{name}_mean_size": f"coalesce(avg(qty) {f}, 0)",
        f"{name}_max_size": f"coalesce(max(qty) {f}, 0)",
        f"{name}_std_size": f"coalesce(stddev_samp(qty) {f}, 0)",
        f"{name}_return": f"coalesce((arg_max(price, seq) {f} - {first}) / {first}, 0)",
        f"{name}_range": f"coalesce(max(price) {f} - min(price) {f}, 0)",
    }


_AT = f"{TAPE_SQL}, e AS (SELECT symbol, us / 1e6 AS at, seq AS event_id FROM tape WHERE qty > 95)"
_BEFORE, _AFTER = _window_stats("pre", "t < hit"), _window_stats("post", "t >= hit")
_SHIFTS = {"volume_shift": f"{_AFTER['post_volume']} / ({_BEFORE['pre_volume']} + 1e-10)", "imbalance_shift": f"{_AFTER['post_imbalance']} - {_BEFORE['pre_imbalance']}"}
S["features_around_events"] = f"""WITH {_AT}, x AS (SELECT e.symbol, event_id, e.at AS hit, us / 1e6 AS t, price, qty, side, seq FROM e JOIN tape USING (symbol) WHERE us / 1e6 >= e.at - 7200 AND us / 1e6 < e.at + 3600)
SELECT symbol, event_id, count(*) FILTER (t < hit) AS pre_n, count(*) FILTER (t >= hit) AS post_n, {named(_BEFORE | _AFTER | _SHIFTS)} FROM x GROUP BY symbol, event_id"""
S["sim_trade_exits"] = f"""WITH {_AT}, q AS (SELECT symbol, us / 1e6 AS t, price FROM tape), z AS (SELECT symbol, arg_max(price, t) AS last_price FROM q GROUP BY symbol),
i AS (SELECT e.symbol, e.at, event_id, q.price AS entry_price FROM e JOIN q ON q.symbol = e.symbol AND q.t = e.at),
o AS (SELECT i.*, i.at + 7200 AS leave FROM i), x AS (SELECT o.*, coalesce(q.price, last_price) AS price FROM o JOIN z ON z.symbol = o.symbol ASOF LEFT JOIN q ON o.symbol = q.symbol AND o.leave <= q.t)
SELECT symbol, {r('x.at', 'at')}, event_id, 1 AS side, {r('entry_price', 'entry_price')}, {r('price', 'price')}, {r('price / entry_price - 1 - 0.0004', 'ret')} FROM x"""
S["study_threshold_sensitivity"] = f"""WITH {BARS_SQL}, f AS (SELECT symbol, bar, {FX} AS x FROM bars), d AS (SELECT symbol, bar, x - lag(x) {P} AS d FROM f),
m AS (SELECT *, {at_least(10, 'd', 40, 'quantile_cont(d, 0.5)')} AS m FROM d), a AS (SELECT *, abs(d - m) AS a FROM m), t AS (SELECT *, {at_least(10, 'a', 40, 'quantile_cont(a, 0.5)')} AS t FROM a),
h AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS held FROM t)
SELECT symbol, k::DOUBLE AS k, count(*) AS n, {r('avg(coalesce((abs(d) >= k * held)::INTEGER, 0))', 'passed')} FROM h, (VALUES (0.5), (1.0), (2.0)) v(k) GROUP BY symbol, k"""


def _gaps_of(sec: int) -> str:
    """Gaps with their fills within 12 bars of so many seconds."""
    bars = BARS_SQL.replace(f"us // {SEC * 1_000_000} * {SEC}", f"us // {sec * 1_000_000} * {sec}")
    up, made = "kind = 'bullish'", "lag(high, 2) {0} AS h2, lag(low, 2) {0} AS l2, lag(close) {0} AS c1".format(P)
    return f"""SELECT * FROM (WITH {bars}, n AS (SELECT *, row_number() {P} AS i FROM bars), g AS (SELECT *, {made} FROM n),
k AS (SELECT symbol, bar, i, 'bullish' AS kind, h2 AS bottom, low AS top, (low - h2) / c1 * 100 AS size_pct FROM g WHERE low > h2 UNION ALL SELECT symbol, bar, i, 'bearish', high, l2, (l2 - high) / c1 * 100 FROM g WHERE high < l2),
h AS (SELECT k.*, n.i - k.i AS j, n.high, n.low FROM k LEFT JOIN n ON n.symbol = k.symbol AND n.i > k.i AND n.i <= k.i + 12),
f AS (SELECT *, min(CASE WHEN {up} AND low <= bottom OR NOT {up} AND high >= top THEN j END) OVER (PARTITION BY symbol, bar, kind) AS fill FROM h)
SELECT symbol, {sec}::INTEGER AS sec, bar, kind, {named({x: f'any_value({x})' for x in ('bottom', 'top', 'size_pct')})}, any_value(fill)::INTEGER AS fill_bars,
  CASE WHEN any_value(fill) IS NOT NULL THEN 'filled' WHEN bool_or(CASE WHEN {up} THEN low < top ELSE high > bottom END) THEN 'partial' WHEN count(j) >= 12 THEN 'expired' ELSE 'open' END AS status,
  {r(f"greatest(0, coalesce(CASE WHEN {up} THEN max(high) FILTER (fill IS NULL OR j < fill) - any_value(top) ELSE any_value(bottom) - min(low) FILTER (fill IS NULL OR j < fill) END, 0))", 'max_extension')}
FROM f GROUP BY symbol, bar, kind)"""


S["compose_gaps_by_size"] = f"{_gaps_of(SEC)} UNION ALL {_gaps_of(2 * SEC)}"


# --- bulk classification --------------------------------------------------------------------------


def _normal_sql(x: str) -> str:
    """The distribution of the standard normal by the same approximation as in columns."""
    poly = lambda ks: reduce(lambda acc, k: f"({acc}) * abs({x}) + {k!r}", ks[1:], f"{ks[0]!r}")
    near = f"exp(-({x}) * ({x}) / 2) * ({poly(TAIL_TOP)}) / ({poly(TAIL_BOTTOM)})"
    tail = f"CASE WHEN abs({x}) < {TAIL_FAR!r} THEN {near} ELSE 0 END"  # beyond, it is under 1e-12
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


_S50 = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_ALL = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
_B10 = "OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
S["ind_vpin"] = f"""WITH {TAPE_SQL}, d AS (SELECT *, price - lag(price) {PS} AS d FROM tape),
s AS (SELECT *, coalesce(CASE WHEN count(d) {_S50} >= 50 THEN stddev_samp(d) {_S50} END, stddev_samp(d) {_ALL}) AS std, sum(qty) {_ALL} AS run FROM d),
z AS (SELECT *, CASE WHEN std <> 0 THEN d / std END AS z FROM s), b AS (SELECT symbol, floor(run / 500)::BIGINT AS bucket, qty, qty * CASE WHEN z IS NULL THEN 0.5 ELSE {_normal_sql('z')} END AS buy FROM z),
k AS (SELECT symbol, bucket, sum(qty) AS volume, sum(buy) AS buy FROM b GROUP BY ALL), i AS (SELECT *, abs(2 * buy - volume) / (volume + {E}) AS i FROM k)
SELECT symbol, bucket, {named({'volume': 'volume', 'buy': 'buy', 'vpin': f'CASE WHEN count(i) {_B10} >= 5 THEN avg(i) {_B10} END'})} FROM i"""
