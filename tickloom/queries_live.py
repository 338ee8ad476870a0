"""Registered queries of the live path, of sources and of sinks: tables replayed as streams, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as br
from tickloom.operators import features as ft
from tickloom.operators import joins as jn
from tickloom.queries import DAY, GAP, MERGE_SQL, OHLC_SQL, TAPE_SQL, r, register, tape
from tickloom.sources import io
from tickloom.streaming import bars as sb
from tickloom.streaming import live
from tickloom.streaming.replay import replay, scratch, slices
from tickloom.windows import Series

c = F.col
O = "OVER (PARTITION BY symbol ORDER BY ts, seq)"  # noqa: E741
BARS = ("open", "high", "low", "close", "volume", "n_trades", "buy_volume", "sell_volume")
ROUNDED = ", ".join(r(x, x) if x != "n_trades" else x for x in BARS)
HISTORY, PER_BAR = 50, 8


def plain(df: DataFrame) -> DataFrame:
    return df.select("symbol", "bar_id", *BARS)


# --- streams that equal batches -------------------------------------------------------------------
register(
    "stream_count_bars",
    lambda s, d: plain(replay(slices(tape(s, d), 2), lambda x: sb.event_bar_stream(x, count=40))),
    f"WITH {TAPE_SQL}, k AS (SELECT *, (row_number() {O} - 1) // 40 AS bar_id FROM tape), b AS (SELECT symbol, bar_id, {OHLC_SQL} FROM k GROUP BY ALL) SELECT symbol, bar_id, {ROUNDED} FROM b WHERE n_trades = 40",
)
register(
    "stream_volume_bars",
    lambda s, d: plain(replay(slices(tape(s, d), 2), lambda x: sb.event_bar_stream(x, volume=3000.0))),
    f"""WITH RECURSIVE {TAPE_SQL}, n AS (SELECT *, row_number() {O} AS i FROM tape),
v AS (SELECT symbol, i, qty AS acc, 0::BIGINT AS bar_id FROM n WHERE i = 1 UNION ALL
      SELECT n.symbol, n.i, CASE WHEN v.acc >= 3000 THEN n.qty ELSE v.acc + n.qty END, v.bar_id + CASE WHEN v.acc >= 3000 THEN 1 ELSE 0 END FROM v JOIN n ON n.symbol = v.symbol AND n.i = v.i + 1),
b AS (SELECT symbol, bar_id, {OHLC_SQL} FROM n JOIN v USING (symbol, i) GROUP BY symbol, bar_id)
SELECT symbol, bar_id, {ROUNDED} FROM b WHERE volume >= 3000""",
)
register(
    "stream_time_bars",
    lambda s, d: replay(slices(tape(s, d), 2), lambda x: sb.time_bar_stream(x, "1 day", "1 hour")).select("symbol", F.unix_seconds("bar_ts").alias("bar"), *BARS),
    f"WITH {TAPE_SQL}, b AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL) SELECT symbol, bar, {ROUNDED} FROM b WHERE (bar + {DAY}) * 1000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM tape)",
)
_ORDERS = ("qty", "notional", "first_price", "last_price", "price")
register(
    "stream_merged_trades",
    lambda s, d: replay(slices(tape(s, d), 2), lambda x: sb.merge_stream(x, gap_ms=GAP, flush_ms=10**13)).select("symbol", "seq", "side", "n_fills", "n_raw_trades", "first_id", "last_id", *_ORDERS),
    f"WITH {MERGE_SQL} SELECT symbol, seq, side, n_fills, n_raw_trades, first_id, last_id, {', '.join(r(x, x) for x in _ORDERS)} FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) > 1",
)


def spliced(s: SparkSession, d: str) -> DataFrame:
    """The first third is history, from which the stream starts; the stream repeats a part of it, and stops once."""
    first, second, third = slices(tape(s, d), 3)
    warm = live.warm_state(first, PER_BAR, gap_ms=GAP)
    again = first.filter(c("seq") % 1000 >= 700)  # rows that both have
    signal = live.zscore_signal(n=20)
    return replay([again.unionByName(second), third], lambda x: live.live_bars(x, PER_BAR, signal, warm, history=HISTORY, warmup=10, gap_ms=GAP))


#: Bars of all orders but the last, which a stream holds back, and the history's bars apart.
LIVE_SQL = f"""{MERGE_SQL},
o AS (SELECT *, (row_number() {O} - 1) // {PER_BAR} AS bar_id, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS back FROM m),
b AS (SELECT symbol, bar_id, {OHLC_SQL}, max(us) AS us FROM o WHERE back > 1 GROUP BY symbol, bar_id HAVING count(*) = {PER_BAR}),
x AS (SELECT *, (buy_volume - sell_volume) / volume AS x FROM b)"""
_W = "OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_Z = f"(x - avg(x) {_W}) / (stddev_samp(x) {_W} + 1e-10)"


def spliced_whole(s: SparkSession, d: str) -> DataFrame:
    """Bars of the history and of the stream behind it: those of all trades in one batch."""
    first = slices(tape(s, d), 3)[0]
    before = live.history_bars(first, PER_BAR, GAP).filter(c("n_trades") == PER_BAR).select("symbol", "bar_id", *BARS)
    return plain(before.unionByName(spliced(s, d).select("symbol", "bar_id", *BARS)))


register("live_spliced_bars", spliced_whole, f"WITH {LIVE_SQL} SELECT symbol, bar_id, {ROUNDED} FROM b")


def live_signals(s: SparkSession, d: str) -> DataFrame:
    """Bars with the signal of their bounded history, once 10 bars were seen."""
    found = replay(slices(tape(s, d), 2), lambda x: live.live_bars(x, PER_BAR, live.zscore_signal(n=20), history=HISTORY, warmup=10, gap_ms=GAP))
    return found.select("symbol", "bar_id", "close", "n_bars", "ready", "signal")


register(
    "live_signals",
    live_signals,
    f"""WITH {LIVE_SQL}, z AS (SELECT *, CASE WHEN count(x) {_W} >= 5 THEN {_Z} END AS z FROM x)
SELECT symbol, bar_id, {r("close", "close")}, bar_id + 1 AS n_bars, bar_id + 1 >= 10 AS ready, (CASE WHEN bar_id + 1 < 10 THEN 0 WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END)::INTEGER AS signal FROM z""",
)
SILENT = 12 * 3_600_000
register(
    "live_silence",
    lambda s, d: replay(slices(tape(s, d), 2), lambda x: live.staleness(x, SILENT, clock=False)).select("symbol", "status", F.unix_micros("ts").alias("us"), "n_trades"),
    f"""WITH {TAPE_SQL}, g AS (SELECT symbol, us, lead(us) {O} AS following, row_number() {O} AS n FROM tape)
SELECT symbol, 'stale' AS status, us, n AS n_trades FROM g WHERE following - us > {SILENT * 1000} OR following IS NULL AND (SELECT max(us) FROM tape) // 1000 > us // 1000 + {SILENT} + 1
UNION ALL SELECT symbol, 'back', following, n FROM g WHERE following - us > {SILENT * 1000}""",
)


def tail_features(s: SparkSession, d: str) -> DataFrame:
    """Daily bars and their mean of three, computed anew over the tail whenever a day is over."""

    def features(tail: DataFrame) -> DataFrame:
        b, days = br.time_bars(tail, DAY), Series(order=("bar",))
        return b.withColumn("mean", days.mean(c("close"), 3, 1)).select("symbol", "bar", "close", "volume", "mean")

    root = scratch(s, "tail")
    replay(slices(tape(s, d), 2), lambda x: x, lambda x: live.bar_features(x, features, DAY, root, bars=3))
    return live.read_features(s, root)


register(
    "live_tail_features",
    tail_features,
    f"""WITH {TAPE_SQL}, b AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL),
m AS (SELECT symbol, bar, close, volume, avg(close) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean, max(bar) OVER (PARTITION BY symbol) AS last FROM b)
SELECT symbol, bar, {r("close", "close")}, {r("volume", "volume")}, {r("mean", "mean")} FROM m WHERE bar < last""",
)


# --- sources and sinks ----------------------------------------------------------------------------
TAPE_COLUMNS = f"symbol, {r('price', 'price')}, {r('qty', 'qty')}, seq, side, first_id, last_id, n_fills"


def days(s: SparkSession, d: str) -> DataFrame:
    """Two writes by symbol and day, the second over days that are there already; then a range of days of one symbol."""
    root, t = scratch(s, "days"), tape(s, d)
    io.write_days(t.filter(F.dayofmonth("ts") <= 15), root)
    io.write_days(t.filter(F.dayofmonth("ts") >= 10).withColumn("price", F.when(F.dayofmonth("ts") <= 15, F.lit(-1.0)).otherwise(c("price"))), root, skip_existing=True)
    return io.read_trades(s, root, symbol=3, start="2024-01-05", end="2024-01-20").select("symbol", "price", "qty", "seq", "side", "first_id", "last_id", "n_fills")


register("source_days", days, f"WITH {TAPE_SQL} SELECT {TAPE_COLUMNS} FROM tape WHERE symbol = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")


def messages(t: DataFrame) -> DataFrame:
    """The tape as JSON messages of aggregated trades."""
    told = {"a": c("seq"), "p": c("price").cast("decimal(18,6)").cast("string"), "q": c("qty").cast("decimal(18,6)").cast("string"), "f": c("first_id"), "l": c("last_id"), "T": F.unix_millis("ts"), "m": c("side") == "sell"}
    return t.select("symbol", F.to_json(F.struct(*[x.alias(n) for n, x in told.items()])).alias("value"))


MESSAGE_SQL = f"symbol, {r('round(price, 6)', 'price')}, qty, {r('round(price, 6) * qty', 'notional')}, seq, side, first_id, last_id, last_id - first_id + 1 AS n_fills, us // 1000 AS ms"
_MESSAGE = ("symbol", "price", "qty", "notional", "seq", "side", "first_id", "last_id", "n_fills")
register("source_messages", lambda s, d: io.decode_agg_trades(messages(tape(s, d))).select(*_MESSAGE, F.unix_millis("ts").alias("ms")), f"WITH {TAPE_SQL} SELECT {MESSAGE_SQL} FROM tape")


def stream_sink(s: SparkSession, d: str) -> DataFrame:
    """Messages that arrive as files in two parts, decoded and appended to days once each."""
    root, ck = scratch(s, "sink"), scratch(s, "sink-checkpoint")
    for part in slices(tape(s, d), 2):
        messages(part).write.mode("append").json(f"{root}/in")
        io.stream_to_days(io.stream_trades(s, f"{root}/in", "symbol long, value string"), f"{root}/out", ck).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/out").select(c("symbol").cast("long").alias("symbol"), *_MESSAGE[1:], F.unix_millis("ts").alias("ms"))


register("sink_stream_days", stream_sink, f"WITH {TAPE_SQL} SELECT {MESSAGE_SQL} FROM tape")


def results(s: SparkSession, d: str) -> DataFrame:
    """Daily bars written as CSV and read again."""
    path = scratch(s, "results")
    b = br.time_bars(tape(s, d), DAY).select("symbol", "bar", "close", "volume")
    io.write_results(b, path)
    return io.read_results(s, path, b.schema)


register("sink_results", results, f"WITH {TAPE_SQL}, b AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL) SELECT symbol, bar, {r('close', 'close')}, {r('volume', 'volume')} FROM b")
register(
    "source_klines",
    lambda s, d: io.read_klines(
        tape(s, d).select("symbol", F.timestamp_seconds(br.time_bin(c("ts"), 21600)).alias("ts"), c("price").alias("open"), (c("price") + 1).alias("close"), c("qty").alias("volume"))
    ).select("symbol", F.unix_seconds("ts").alias("bar"), "open", "close", "volume"),
    f"WITH {TAPE_SQL} SELECT symbol, us // 21600000000 * 21600 AS bar, {r('price', 'open')}, {r('price + 1', 'close')}, {r('qty', 'volume')} FROM tape QUALIFY row_number() OVER (PARTITION BY symbol, us // 21600000000 ORDER BY price, qty) = 1",
)
register(
    "source_recent",
    lambda s, d: io.recent(tape(s, d), "2024-01-25 12:00:00").select("symbol", "seq", "price", "qty"),
    f"WITH {TAPE_SQL} SELECT symbol, seq, {r('price', 'price')}, {r('qty', 'qty')} FROM tape WHERE ts >= TIMESTAMP '2024-01-25 12:00:00'",
)


def kept(s: SparkSession, d: str) -> DataFrame:
    """A table that is made once: the second call reads what the first wrote."""
    path, t = scratch(s, "kept"), tape(s, d)
    io.cached(s, path, lambda: t.groupBy("symbol").agg(F.sum("qty").alias("qty")))
    return io.cached(s, path, lambda: t.groupBy("symbol").agg(F.lit(-1.0).alias("qty")))


register("source_cached", kept, f"WITH {TAPE_SQL} SELECT symbol, {r('sum(qty)', 'qty')} FROM tape GROUP BY symbol")


def markets(s: SparkSession, d: str) -> DataFrame:
    """Event documents made of the users' last event of each type, their titles searched, and the token of a signal."""
    e = s.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.max("event_id").alias("id"))
    asked = F.when(c("user_id") % 2 == 0, "up").otherwise("down")
    listed = lambda *x: F.to_json(F.array(*x))
    told = {
        "id": c("id").cast("string"), "title": F.concat(F.lit("Will "), c("event_type"), F.lit(" go "), asked, F.lit("?")), "outcomes": listed(F.lit("Yes"), F.lit("No")),
        "outcomePrices": listed(F.lit("0.25"), F.lit("0.75")), "clobTokenIds": listed(F.concat(F.lit("y"), c("id")), F.concat(F.lit("n"), c("id"))),
    }
    docs = e.select(F.to_json(F.struct(*[x.alias(n) for n, x in told.items()])).alias("value"))
    found = io.market_events(docs, ["CLICK", "view"]).withColumn("signal", F.pmod(c("id").cast("long"), F.lit(3)) - 1)
    return io.token_for_signal(found).select("id", "title", "signal", "token", F.element_at("outcomePrices", 2).alias("price"))


register(
    "source_markets",
    markets,
    """WITH e AS (SELECT user_id, event_type, max(event_id) AS id FROM events GROUP BY ALL)
SELECT id::VARCHAR AS id, 'Will ' || event_type || ' go ' || CASE WHEN user_id % 2 = 0 THEN 'up' ELSE 'down' END || '?' AS title, id % 3 - 1 AS signal,
  CASE WHEN id % 3 = 1 THEN NULL WHEN (id % 3 = 2) = (user_id % 2 = 0) THEN 'y' || id ELSE 'n' || id END AS token, 0.75::DOUBLE AS price FROM e WHERE event_type IN ('click', 'view')""",
)


# --- filters and joins of tables ------------------------------------------------------------------
_HALVES = f"WITH {TAPE_SQL}, a AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {OHLC_SQL} FROM tape GROUP BY ALL), h AS (SELECT symbol, us // {DAY * 1000000} * {DAY} AS bar, {OHLC_SQL} FROM tape WHERE side = 'buy' GROUP BY ALL)"


def daily(s: SparkSession, d: str) -> DataFrame:
    return br.time_bars(tape(s, d), DAY)


register(
    "join_aligned_bars",
    lambda s, d: jn.align(daily(s, d).select("symbol", "bar", "close", "volume"), br.time_bars(tape(s, d).filter("side = 'buy'"), DAY).select("symbol", "bar", "close", "n_trades"), ["symbol", "bar"]),
    f"{_HALVES} SELECT symbol, bar, {r('a.close', 'close')}, {r('a.volume', 'volume')}, {r('h.close', 'close_right')}, h.n_trades FROM a LEFT JOIN h USING (symbol, bar)",
)
register(
    "join_lookup",
    lambda s, d: jn.lookup(daily(s, d).select("symbol", "bar", "close"), daily(s, d).filter("n_trades > 30").withColumn("busy", c("n_trades")), ["symbol", "bar"], "busy", 0),
    f"{_HALVES} SELECT symbol, bar, {r('close', 'close')}, CASE WHEN n_trades > 30 THEN n_trades ELSE 0 END AS busy FROM a",
)


def chosen(s: SparkSession, d: str) -> DataFrame:
    """Columns by prefix, of these the ones that vary and are mostly there, of bars with a flat and an empty column."""
    b = daily(s, d).withColumns({"buy_flat": F.lit(1.0), "buy_rare": F.when(c("symbol") == 0, c("bar").cast("double")), "buy_name": F.lit("x")})
    return b.select("symbol", "bar", *ft.select_features(b, ft.by_prefix(b, ("buy", "sell"))))


register("features_selected", chosen, f"{_HALVES} SELECT symbol, bar, {r('buy_volume', 'buy_volume')}, {r('sell_volume', 'sell_volume')} FROM a")


def parted(s: SparkSession, d: str) -> DataFrame:
    """Rows before a day, and rows from it on with the last three before it to warm up."""
    b = daily(s, d).withColumn("ts", F.timestamp_seconds("bar"))
    before, after = ft.split_by_date(b, "ts", "2024-01-20", 3, Series(order=("bar",)))
    parts = before.withColumn("part", F.lit("before")).withColumn("warm", F.lit(False)).unionByName(after.withColumn("part", F.lit("after")))
    return parts.select("symbol", "bar", "close", "part", c("warm").cast("int").alias("warm"))


register(
    "features_split_by_date",
    parted,
    f"""{_HALVES}, k AS (SELECT *, bar < epoch(TIMESTAMP '2024-01-20')::BIGINT AS early, row_number() OVER (PARTITION BY symbol, bar < epoch(TIMESTAMP '2024-01-20')::BIGINT ORDER BY bar DESC) AS back FROM a)
SELECT symbol, bar, {r('close', 'close')}, 'before' AS part, 0 AS warm FROM k WHERE early UNION ALL SELECT symbol, bar, {r('close', 'close')}, 'after', early::INTEGER FROM k WHERE NOT early OR back <= 3""",
)
register(
    "features_tokens",
    lambda s, d: ft.tokens(s.read.parquet(f"{d}/documents.parquet"), "text", " "),
    "SELECT trim(t) AS token, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents) WHERE trim(t) <> '' GROUP BY trim(t)",
)
