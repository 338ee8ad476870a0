"""Registered queries of models, their metrics and the event matrix they are trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as br
from tickloom.operators import compose as cm
from tickloom.operators import ml
from tickloom.operators import signals as sg
from tickloom.queries import BARS_SQL, GAP, MERGE_SQL, P, SEC, S, bars, book, r, register, tape, w
from tickloom.streaming.replay import scratch
from tickloom.windows import div

c = F.col


def scored(s: SparkSession, d: str) -> DataFrame:
    """Bars with a probability made from their imbalance, the next step up or not, and features; the last bar of a series has no label."""
    b = bars(s, d)
    y = F.when(S.lead(c("close")).isNotNull(), (S.lead(c("close")) > c("close")).cast("int"))
    flow = div(c("buy_volume") - c("sell_volume"), c("volume"))
    return b.withColumns({"x": flow, "z": div(c("close"), S.lag(c("close"))) - 1, "p": F.round(1 / (1 + F.exp(-2 * flow)), 4), "y": y}).select("symbol", "bar", "x", "z", "p", "y", "volume")


def trained_on(df: DataFrame, label: str) -> DataFrame:
    """df written once and read from there: a fit goes through its rows many times, and would make them of the whole tape each time."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCORED = f"""{BARS_SQL}, q AS (SELECT symbol, bar, (buy_volume - sell_volume) / volume AS x, CASE WHEN lead(close) {P} IS NOT NULL THEN (lead(close) {P} > close)::INTEGER END AS y, volume FROM bars),
s AS (SELECT *, round(1 / (1 + exp(-2 * x)), 4) AS p FROM q), k AS (SELECT * FROM s WHERE y IS NOT NULL AND p IS NOT NULL)"""
_BINS = "SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM k GROUP BY ALL"
register("ml_reliability", lambda s, d: ml.reliability(scored(s, d), "p", "y"), f"WITH {SCORED}, b AS ({_BINS}) SELECT bin, n, {r('mean_p', 'mean_p')}, {r('rate', 'rate')}, {r('mean_p - rate', 'gap')} FROM b")
_HIT, _SAID = "count(*) FILTER (p >= 0.5 AND y = 1)", "count(*) FILTER (p >= 0.5)"
register(
    "ml_metrics",
    lambda s, d: ml.classification_metrics(scored(s, d), "p", "y"),
    f"""WITH {SCORED}, b AS ({_BINS}), e AS (SELECT sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM b),
a AS (SELECT sum(CASE WHEN u.p > v.p THEN 1.0 WHEN u.p = v.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM k u JOIN k v ON u.y = 1 AND v.y = 0)
SELECT count(*) AS n, {r('avg(y)', 'base_rate')}, {r('avg(((p >= 0.5)::INTEGER = y)::INTEGER)', 'accuracy')}, {r(f'{_HIT} / {_SAID}', 'precision')}, {r(f'{_HIT} / sum(y)', 'recall')},
  {r(f'2 * {_HIT} / ({_SAID} + sum(y))', 'f1')}, {r('avg((p - y) ** 2)', 'brier')}, {r('avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END)', 'log_loss')},
  {r('any_value(ece)', 'calibration_error')}, {r('any_value(auc)', 'auc')} FROM k, e, a""",
)
register(
    "ml_class_report",
    lambda s, d: ml.class_report(scored(s, d).withColumn("said", (c("p") >= 0.5).cast("int")), "said", "y"),
    f"""WITH {SCORED}, m AS (SELECT (p >= 0.5)::INTEGER AS said, y FROM k), l AS (SELECT said AS class FROM m UNION SELECT y FROM m),
t AS (SELECT class, count(*) FILTER (said = class AND y = class) AS hit, count(*) FILTER (said = class) AS said, count(*) FILTER (y = class) AS support FROM l, m GROUP BY class)
SELECT class, {r('CASE WHEN said > 0 THEN hit / said END', 'precision')}, {r('CASE WHEN support > 0 THEN hit / support END', 'recall')}, {r('2 * hit / (said + support)', 'f1')}, support FROM t""",
)
register(
    "ml_class_weights",
    lambda s, d: ml.class_weights(scored(s, d).select("symbol", "bar", "y"), "y"),
    f"WITH {SCORED} SELECT symbol, bar, y, {r('count(*) OVER () / ((SELECT count(DISTINCT y) FROM k) * count(*) OVER (PARTITION BY y))', 'weight')} FROM k",
)
register(
    "ml_folds",
    lambda s, d: ml.folds(bars(s, d).select("symbol", "bar"), "bar", 3),
    f"WITH {BARS_SQL} SELECT symbol, bar, ((bar > (SELECT quantile_disc(bar, 0.25) FROM bars))::INTEGER + (bar > (SELECT quantile_disc(bar, 0.5) FROM bars))::INTEGER + (bar > (SELECT quantile_disc(bar, 0.75) FROM bars))::INTEGER)::INTEGER AS fold FROM bars",
)


def line(s: SparkSession, d: str) -> DataFrame:
    """A least-squares line of the label on one feature, and what it predicts."""
    df = trained_on(scored(s, d).filter("y is not null"), "scored")
    return ml.fit(df, ["x"], "y", "ridge", reg=0.0).transform(df).select("symbol", "bar", "prediction")


register("ml_linear", line, f"WITH {SCORED}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k) SELECT symbol, bar, {r('a * x + b', 'prediction')} FROM k, f")


def calibrated(s: SparkSession, d: str) -> DataFrame:
    """Reliability of held-out probabilities of a logistic model, as they are and after the isotonic map; the model is stored and read again."""
    df = trained_on(scored(s, d).filter("y is not null and z is not null").drop("p"), "scored")
    path = scratch(s, "model")
    ml.calibrate(df, ["x", "z"], "y", "logistic", "bar").save(path)
    seen = ml.Calibrated.load(path).transform(df)
    return ml.reliability(seen, "p_raw", "y").withColumn("kind", F.lit("raw")).unionByName(ml.reliability(seen, "p", "y").withColumn("kind", F.lit("calibrated")))


register("ml_calibrated", calibrated)


def early(s: SparkSession, d: str) -> DataFrame:
    """Metrics of boosted trees that stop early, with the number of trees they stopped at."""
    df = trained_on(scored(s, d).filter("y is not null and z is not null"), "scored")
    model = ml.fit_early(df, ["x", "z"], "y", "gbt_classifier", "bar", trees=40)
    return ml.classification_metrics(ml.probabilities(model, df), "p_raw", "y").withColumn("trees", F.lit(model.stages[-1].getNumTrees))


register("ml_early_stopping", early)

# --- signals with two sides, and controllers ------------------------------------------------------
_N = 20


def two_sided(s: SparkSession, d: str) -> DataFrame:
    b = br.merged_time_bars(br.merge_trades(tape(s, d), GAP), SEC)
    return sg.two_sided_entries(b, "buy_vwap_dist_sum", "sell_vwap_dist_sum", up=(4, 5, 0.5), down=(6, 8, 0.3), n=_N, fill_ahead=True).select("symbol", "bar", "volume", "position")


def _side_sql(name: str, window: int, span: int, k: float, way: int) -> str:
    """Tables of one side: its imbalance, the mean of that, the change, the threshold and the entries."""
    a, b = (f"CASE WHEN count({x}) {w(window)} >= {window} THEN avg({x}) {w(window)} END" for x in ("bd", "sd"))
    keep = 1 - 2 / (span + 1)
    full = lambda x, v: f"CASE WHEN count({x}) {w(_N)} >= {_N} THEN {v} {w(_N)} END"
    all_ = "OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)"
    after = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""{name}0 AS (SELECT symbol, bar, i, local, {a} AS a, {b} AS b FROM n), {name}1 AS (SELECT *, (a - b) / (abs(a) + abs(b) + 1e-10) AS f FROM {name}0),
{name}2 AS (SELECT u.symbol, u.bar, u.i, sum(v.f * power({keep}, u.i - v.i)) / sum(power({keep}, u.i - v.i)) AS y FROM {name}1 u JOIN {name}1 v ON v.symbol = u.symbol AND v.i <= u.i AND v.f IS NOT NULL GROUP BY ALL),
{name}3 AS (SELECT n.symbol, n.bar, n.i, n.local, y - lag(y) OVER (PARTITION BY n.symbol ORDER BY n.bar) AS d FROM n LEFT JOIN {name}2 USING (symbol, i)), {name}4 AS (SELECT *, {full('d', 'quantile_cont(d, 0.5)')} AS m FROM {name}3),
{name}5 AS (SELECT *, abs(d - m) AS dev FROM {name}4), {name}6 AS (SELECT *, {full('dev', 'quantile_cont(dev, 0.5)')} * {k} * sqrt(local / ({full('local', 'avg(local)')} + 1e-10)) AS t FROM {name}5),
{name}7 AS (SELECT *, last_value(t IGNORE NULLS) {all_} AS t1, last_value(CASE WHEN d <> 0 THEN sign(d) END IGNORE NULLS) {all_} AS s FROM {name}6),
{name}8 AS (SELECT symbol, i, abs(d) > coalesce(t1, first_value(t1 IGNORE NULLS) {after}) AND s = {way} AND lag(s) {P} = {-way} AS enters FROM {name}7)"""


register(
    "signal_two_sided",
    two_sided,
    f"""WITH {MERGE_SQL}, mb AS (SELECT symbol, us // {SEC * 1_000_000} * {SEC} AS bar, sum(qty) AS volume, coalesce(sum(price - first_price) FILTER (side = 'buy'), 0) AS bd, coalesce(sum(first_price - price) FILTER (side = 'sell'), 0) AS sd FROM m GROUP BY ALL),
n AS (SELECT *, row_number() {P} AS i, CASE WHEN count(volume) {w(10)} >= 10 THEN avg(volume) {w(10)} END AS local FROM mb), {_side_sql('u', 4, 5, 0.5, 1)}, {_side_sql('v', 6, 8, 0.3, -1)},
e AS (SELECT n.symbol, n.bar, n.volume, CASE WHEN v8.enters THEN -1 WHEN u8.enters THEN 1 END AS entry FROM n JOIN u8 USING (symbol, i) JOIN v8 USING (symbol, i))
SELECT symbol, bar, {r('volume', 'volume')}, coalesce(last_value(entry IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS position FROM e""",
)
register(
    "size_controllers",
    lambda s, d: sg.size(sg.size(scored(s, d), "threshold", "x", threshold=0.1, most=2.0).withColumnRenamed("position", "fixed"), "scaled", "x", threshold=0.1, scale=0.5, least=0.3, most=2.0).select("symbol", "bar", "fixed", c("position").alias("scaled")),
    f"WITH {SCORED} SELECT symbol, bar, {r('CASE WHEN abs(x) > 0.1 THEN 2 * sign(x) ELSE 0 END', 'fixed')}, {r('CASE WHEN abs(x) > 0.1 THEN 2 * sign(x) * greatest(0.3, least(1, abs(x) / 0.5)) ELSE 0 END', 'scaled')} FROM s",
)

# --- events ---------------------------------------------------------------------------------------
register(
    "features_bar_runs",
    lambda s, d: cm.bar_runs(bars(s, d)).select("symbol", "bar", "close", "step", "run"),
    f"""WITH {BARS_SQL}, a AS (SELECT *, coalesce(sign(close - lag(close) {P}), 0)::INTEGER AS step FROM bars), b AS (SELECT *, CASE WHEN step = lag(step) {P} THEN 0 ELSE 1 END AS fresh FROM a),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT symbol, bar, {r('close', 'close')}, step, row_number() OVER (PARTITION BY symbol, island ORDER BY bar)::INTEGER AS run FROM i""",
)
FEATURES = ["size_pct", "volume_ratio", "imbalance_with", "run_with", "size_by_volume", "efficiency_ratio"]


def matrix(s: SparkSession, d: str) -> DataFrame:
    return cm.gap_matrix(tape(s, d), SEC)


_PAST = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_LATER = ", ".join(f"(coalesce(lead(close, {k}) {P}, last_value(close) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / close - 1) * 100 AS f{k}" for k in (5, 10, 20))
register(
    "features_gap_matrix",
    lambda s, d: matrix(s, d).select("symbol", "bar", "side", "size_pct", "gap_size", "candle2_volume", "candle2_range", "volume_ratio", "imbalance", "step", "run", *FEATURES[2:5], *[f"{x}_{k}" for k in (5, 10, 20) for x in ("future_ret", "label_direction")]),
    f"""WITH {BARS_SQL}, a AS (SELECT *, coalesce(sign(close - lag(close) {P}), 0)::INTEGER AS step, lag(high, 2) {P} AS h2, lag(low, 2) {P} AS l2, lag(close) {P} AS c1, lag(volume) {P} AS v1, lag(high - low) {P} AS r1,
  CASE WHEN count(*) {_PAST} = 20 THEN lag(volume) {P} / (avg(volume) {_PAST} + 1e-10) ELSE 1 END AS vr, (buy_volume - sell_volume) / volume AS im, {_LATER} FROM bars),
b AS (SELECT *, CASE WHEN step = lag(step) {P} THEN 0 ELSE 1 END AS fresh FROM a), i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS island FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY bar)::INTEGER AS run FROM i),
g AS (SELECT *, 1 AS side, (low - h2) / c1 * 100 AS sp, low - h2 AS gs FROM m WHERE low > h2 UNION ALL SELECT *, -1, (l2 - high) / c1 * 100, l2 - high FROM m WHERE high < l2)
SELECT symbol, bar, side, {r('sp', 'size_pct')}, {r('gs', 'gap_size')}, {r('v1', 'candle2_volume')}, {r('r1', 'candle2_range')}, {r('vr', 'volume_ratio')}, {r('im', 'imbalance')}, step, run, {r('im * side', 'imbalance_with')},
  run * step * side AS run_with, {r('sp * vr', 'size_by_volume')}, {', '.join(f"{r(f'f{k}', f'future_ret_{k}')}, (f{k} > 0)::INTEGER AS label_direction_{k}" for k in (5, 10, 20))} FROM g""",
)


def two_phases(s: SparkSession, d: str) -> DataFrame:
    """The report of clusters of gaps and what the classifier that sees them says, from a model that was stored and read again."""
    m = trained_on(matrix(s, d), "matrix")
    path = scratch(s, "two-phase")
    ml.TwoPhase.fit(m, FEATURES, "label_filled", k=3, trees=10).save(path)
    seen = ml.TwoPhase.load(path).predict(m)
    return ml.cluster_report(seen, "label_filled", ["size_pct", "volume_ratio", "pred_proba"])


register("ml_two_phase", two_phases)


def shocks(s: SparkSession, d: str) -> DataFrame:
    """Depth round every moment at which the bids are more than twice the asks."""
    b = book(s, d)
    size = lambda side: F.aggregate(side, F.lit(0.0), lambda t, x: t + x["size"])
    events = b.filter(size("bids") > 2 * size("asks")).select("symbol", c("seq").alias("event_id"), (F.unix_micros("ts") / 1e6).alias("at"))
    return cm.book_around(events, b, 10, 10)


def _depth_sql() -> str:
    """Means before and from the moment on of each side's depth, weighted depth and large levels."""
    out = []
    for name, inside in (("pre", "t < hit"), ("post", "t >= hit")):
        out += [r(f"avg({x}) FILTER ({inside})", f"{name}_{x}") for x in ("bid", "ask", "wbid", "wask", "lbid", "lask")]
        out += [r(f"stddev_pop(bid + ask) FILTER ({inside})", f"{name}_depth_std"), r(f"avg((bid - ask) / (bid + ask + 1e-10)) FILTER ({inside})", f"{name}_imbalance")]
    out += [r(f"avg({x}) FILTER (t >= hit) / avg({x}) FILTER (t < hit) - 1", f"{x}_shift") for x in ("bid", "ask")]
    return ", ".join(out)


_SUM = "list_sum(list_transform({0}, lambda v, i: v{1}))"
_LARGE = "len(list_filter({0}, lambda v: v > 3 * list_sum({0}) / 5))"
register(
    "book_around_shocks",
    shocks,
    f"""WITH s AS (SELECT vec_id, vec_id::DOUBLE AS t, list_transform(embedding[1:5], lambda x: abs(x)::DOUBLE) AS b, list_transform(embedding[6:10], lambda x: abs(x)::DOUBLE) AS a FROM embeddings),
l AS (SELECT vec_id, t, list_sum(b) AS bid, list_sum(a) AS ask, {_SUM.format('b', ' / i')} AS wbid, {_SUM.format('a', ' / i')} AS wask, {_LARGE.format('b')} AS lbid, {_LARGE.format('a')} AS lask FROM s),
e AS (SELECT vec_id AS event_id, t AS hit FROM l WHERE bid > 2 * ask), j AS (SELECT e.event_id, e.hit, l.* FROM e JOIN l ON l.t BETWEEN e.hit - 10 AND e.hit + 10)
SELECT 0 AS symbol, event_id, {_depth_sql()} FROM j GROUP BY event_id""",
)
