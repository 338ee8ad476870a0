"""The live path: a batch of history hands over to a stream, bars keep a bounded history, signals follow.

Three pieces, all for each symbol:

* ``live_bars``: fills become taker orders, orders become bars of a count, and a signal is
  computed from the last bars when one closes. State is the order and the bar under way, a
  ring of closed bars and the last row consumed. ``warm_state`` computes that state from a
  history in one batch; rows of the stream that the history holds already are dropped, so
  the two may overlap.
* ``staleness``: one row when a symbol falls silent for too long, one when it is back, by
  event time or by the clock.
* ``bar_features``: the bounded tail of the stream is kept as a table and features are
  computed anew over it whenever bars complete. All writes are named by batch, so a batch
  that runs again replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.bars import EPS, merge_trades, ohlcv, time_bin, with_count_id
from tickloom.streaming.ordered import Columns, cuts, frames, joined, order_starts, ordered, pieces
from tickloom.streaming.ordered import plain as own

c = F.col
VALUES = ("open", "high", "low", "close", "volume", "n_trades", "buy_volume", "sell_volume")
_BAR = "bar_id long, us long, open double, high double, low double, close double, volume double, n_trades long, buy_volume double, sell_volume double"
_ORDER = "us long, last_us long, last_id long, last_price double, qty double, notional double, side string"
_BAR_NAMES, _ORDER_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (_BAR, _ORDER))
History = dict[str, np.ndarray]


# --- signals over a bounded history ---------------------------------------------------------------


def imbalance(history: History) -> np.ndarray:
    """(bought - sold) / volume of each bar."""
    v = history["volume"]
    return np.divide(history["buy_volume"] - history["sell_volume"], v, out=np.full(len(v), np.nan), where=v != 0)


def _side(up: bool, down: bool) -> int:
    return 1 if up else -1 if down else 0


def zscore_signal(column: Callable[[History], np.ndarray] = imbalance, n: int = 60, up: float = 1.0, down: float = 1.0) -> Callable[[History], int]:
    """The batch signal "zscore" of the last bar, from the last n."""
    least = max(5, n // 4)

    def signal(history: History) -> int:
        x = column(history)[-n:]
        if len(x) < least or not np.isfinite(x[-1]):
            return 0
        x = x[np.isfinite(x)]
        if len(x) < max(2, least):
            return 0
        z = (x[-1] - x.mean()) / (x.std(ddof=1) + 1e-10)
        return _side(z > up, z < -down)

    return signal


def ma_cross_signal(column: Callable[[History], np.ndarray], fast: int = 5, slow: int = 20) -> Callable[[History], int]:
    """The batch signal "ma_cross" of the last bar."""

    def signal(history: History) -> int:
        x = column(history)
        a, b = (np.nanmean(x[-k:]) if np.isfinite(x[-k:]).any() else np.nan for k in (fast, slow))
        return _side(a > b, a < b)

    return signal


# --- bars with a history --------------------------------------------------------------------------


class LiveBars(StatefulProcessor):
    """Bars of ``count`` taker orders (or fills, with merge=False), each with the signal of the last ``history`` bars.

    A bar is sent when it closes. ``ready`` is false, and the signal 0, until ``warmup``
    bars were seen, those of the initial state included.
    """

    def __init__(self, count: int, signal: Callable[[History], int], history: int = 500, warmup: int = 0, gap_ms: int = 100, require_ids: bool = True, merge: bool = True) -> None:
        if count < 1 or history < 1:
            raise ValueError("count and history must be positive")
        self.count, self.signal, self.history, self.warmup = count, signal, history, warmup
        self.gap_us, self.require_ids, self.merge = gap_ms * 1000, require_ids, merge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", _ORDER)
        self.open = handle.getValueState("open", _BAR)
        self.seen = handle.getValueState("seen", "us long, seq long, n_bars long")
        self.ring = handle.getMapState("ring", "slot long", _BAR)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.seen.update((int(row.us), int(row.seq), int(row.n_bars)))
            for name, state, fields in (("pending", self.pending, _ORDER_NAMES), ("open", self.open, _BAR_NAMES)):
                if (held := getattr(row, name)) is not None:
                    state.update(tuple(json.loads(held)[f] for f in fields))
            for bar in json.loads(row.bars or "[]"):
                self.ring.updateValue((bar["bar_id"] % self.history,), tuple(bar[f] for f in _BAR_NAMES))

    def _orders(self, p: dict | None, t: Columns) -> tuple[dict | None, Columns]:
        """The order under way after these rows, and us, price, qty and side of those that are over."""
        if not self.merge or not len(t["us"]):
            return p, {n: t[n] for n in ("us", "price", "qty", "side")}
        before = p and {"side": p["side"], "us": p["last_us"], "price": p["last_price"], "last_id": p["last_id"]}
        starts = np.flatnonzero(order_starts(before, t, self.gap_us, self.require_ids))
        n = len(t["us"])
        lead = starts[0] if len(starts) else n
        if p and lead:  # rows that go on with the order under way
            p |= {"last_us": t["us"][lead - 1], "last_id": t["last_id"][lead - 1], "last_price": t["price"][lead - 1]}
            p |= {x: p[x] + t[x][:lead].sum() for x in ("qty", "notional")}
        last = (np.append(starts[1:], n) - 1)[: len(starts)]
        runs = {"us": t["us"][starts], "side": t["side"][starts], "last_us": t["us"][last], "last_id": t["last_id"][last], "last_price": t["price"][last]}
        runs |= {x: np.add.reduceat(t[x], starts) if len(starts) else t[x][:0] for x in ("qty", "notional")}
        runs = joined(p, _ORDER_NAMES, runs)
        p, whole = {x: runs[x][-1] for x in _ORDER_NAMES}, {x: v[:-1] for x, v in runs.items()}
        return p, {"us": whole["us"], "price": whole["notional"] / (whole["qty"] + EPS), "qty": whole["qty"], "side": whole["side"]}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bar = dict(zip(_BAR_NAMES, self.open.get(), strict=True)) if self.open.exists() else None
        us, seq, n_bars = self.seen.get() if self.seen.exists() else (-(2**62), -(2**62), 0)
        t = ordered(rows, ["us", "seq", "price", "qty", "notional", "side", "first_id", "last_id"], ("us", "seq"))
        p = dict(zip(_ORDER_NAMES, self.pending.get(), strict=True)) if self.pending.exists() else None
        over_by_now = []
        for part in cuts(t):
            # The history, or an earlier row, holds what is not behind the last row consumed.
            at, of = (np.concatenate([[x], part[n][:-1]]) for x, n in ((us, "us"), (seq, "seq")))
            if (part["us"][0], part["seq"][0]) < (us, seq):
                at, of = np.where((at > us) | (at == us) & (of > seq), at, us), np.where((at > us) | (at == us) & (of > seq), of, seq)
            fresh = (part["us"] > at) | (part["us"] == at) & (part["seq"] > of)
            p, orders = self._orders(p, {n: x[fresh] for n, x in part.items()})
            over_by_now.append(orders)
            us, seq = max((us, seq), (int(part["us"][-1]), int(part["seq"][-1])))
        del t
        if p is not None:
            self.pending.update(tuple(own(p[x]) for x in _ORDER_NAMES))
        o = {n: np.concatenate([x[n] for x in over_by_now]) for n in ("us", "price", "qty", "side")}
        del over_by_now
        there = bar["n_trades"] if bar else 0
        n = len(o["us"])
        starts = np.concatenate([np.zeros(1 if n else 0, np.int64), np.arange(self.count - there, n, self.count)]).astype(np.int64)
        bought = np.where(o["side"] == "buy", o["qty"], 0.0)
        over = lambda f, x: f.reduceat(x, starts) if n else np.empty(0)
        last = np.append(starts[1:], n)[: len(starts)] - 1
        made = {"us": o["us"][starts], "open": o["price"][starts], "high": over(np.fmax, o["price"]), "low": over(np.fmin, o["price"]), "close": o["price"][last]}
        made |= {"volume": over(np.add, o["qty"]), "n_trades": last + 1 - starts, "buy_volume": over(np.add, bought), "sell_volume": over(np.add, o["qty"] - bought)}
        made["bar_id"] = n_bars + np.arange(len(starts))
        if bar and n:  # the first bar goes on with the one under way
            made["us"][0], made["open"][0] = bar["us"], bar["open"]
            made["high"][0], made["low"][0] = max(bar["high"], made["high"][0]), min(bar["low"], made["low"][0])
            for x in ("volume", "n_trades", "buy_volume", "sell_volume"):
                made[x][0] += bar[x]
        closed = int((made["n_trades"] == self.count).sum())
        if len(starts) > closed:
            self.open.update(tuple(own(made[x][-1]) for x in _BAR_NAMES))
        elif n and self.open.exists():
            self.open.clear()
        made = {x: made[x][:closed] for x in _BAR_NAMES}
        self.seen.update((us, seq, n_bars + closed))
        ring = np.array(sorted(tuple(v) for v in self.ring.values())[-self.history :], float).reshape(-1, len(_BAR_NAMES)) if closed else None
        held = ring is not None and {x: np.concatenate([ring[:, i].astype(made[x].dtype), made[x]]) for i, x in enumerate(_BAR_NAMES)}
        signals = np.zeros(closed, np.int64)
        for i in range(max(0, self.warmup - n_bars - 1), closed):
            end = len(ring) + i + 1
            signals[i] = self.signal({x: v[max(0, end - self.history) : end] for x, v in held.items()})
        for i in range(max(0, closed - self.history), closed):
            self.ring.updateValue((int(made["bar_id"][i]) % self.history,), tuple(own(made[x][i]) for x in _BAR_NAMES))
        count = n_bars + 1 + np.arange(closed)
        yield from frames({"symbol": np.full(closed, key[0])} | made | {"n_bars": count, "ready": count >= self.warmup, "signal": signals})

    def close(self) -> None:
        pass


def history_bars(history: DataFrame, count: int, gap_ms: int = 100, merge: bool = True) -> DataFrame:
    """symbol, bar_id, us and OHLCV of the bars of a history as ``LiveBars`` sees them: the last order is not over, the last bar may have fewer orders."""
    orders = history
    if merge:
        orders = merge_trades(history, gap_ms)
        last = orders.groupBy("symbol").agg(F.max(F.struct("ts", "seq")).alias("_end"))
        orders = orders.join(last, "symbol").filter(~F.struct("ts", "seq").eqNullSafe(c("_end"))).drop("_end")
    return with_count_id(orders, count).groupBy("symbol", "bar_id").agg(F.unix_micros(F.min("ts")).alias("us"), *ohlcv())


def warm_state(history: DataFrame, count: int, keep: int = 500, gap_ms: int = 100, merge: bool = True) -> DataFrame:
    """One row for each symbol: the state of ``LiveBars`` after these trades, computed in one batch.

    The last taker order is still under way, and so is the bar of the orders behind the
    last full count. Nested state travels as JSON.
    """
    ends = history.groupBy("symbol").agg(F.max(F.struct(F.unix_micros("ts").alias("us"), "seq")).alias("at"))
    if merge:
        last = merge_trades(history, gap_ms).groupBy("symbol").agg(F.max_by(F.struct("ts", *_ORDER_NAMES[2:]), F.struct("ts", "seq")).alias("o")).select("symbol", "o.*")
        under_way = last.join(ends, "symbol")
        told = {"us": F.unix_micros("ts"), "last_us": c("at.us"), **{n: c(n) for n in _ORDER_NAMES[2:]}}
        pending = under_way.select("symbol", F.to_json(F.struct(*[x.alias(n) for n, x in told.items()])).alias("pending"))
    else:
        pending = ends.select("symbol", F.lit(None).cast("string").alias("pending"))
    bars = history_bars(history, count, gap_ms, merge)
    full = c("n_trades") == count
    told = F.struct(*_BAR_NAMES)
    recent = Window.partitionBy("symbol").orderBy(F.desc("bar_id"))
    ring = bars.filter(full).withColumn("_k", F.row_number().over(recent)).filter(c("_k") <= keep)
    ring = ring.groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list(told))).alias("bars"), (F.max("bar_id") + 1).alias("n_bars"))
    under_way = bars.filter(~full).select("symbol", F.to_json(told).alias("open"))
    return (
        ends.select("symbol", "at.us", "at.seq")
        .join(pending, "symbol", "left")
        .join(under_way, "symbol", "left")
        .join(ring, "symbol", "left")
        .select("symbol", "us", "seq", F.coalesce("n_bars", F.lit(0)).cast("long").alias("n_bars"), "pending", "open", "bars")
    )


def live_bars(tape: DataFrame, count: int, signal: Callable[[History], int], warm: DataFrame | None = None, **options) -> DataFrame:
    """Bars of a streaming tape with n_bars, ready and signal; ``warm`` is ``warm_state`` of a history with the same options.

    Initial state is read once, with the first batch of a query; a restarted query goes on from its checkpoint.
    """
    rows = tape.select("symbol", F.unix_micros("ts").alias("us"), "seq", "price", "qty", "notional", "side", "first_id", "last_id")
    kind = tape.schema["symbol"].dataType.simpleString()
    processor = LiveBars(count, signal, **options)
    schema = f"symbol {kind}, {_BAR}, n_bars long, ready boolean, signal int"
    out = rows.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "None", initialState=None if warm is None else warm.groupBy("symbol"))
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


# --- silence --------------------------------------------------------------------------------------


class Staleness(StatefulProcessor):
    """A row ``stale`` once a symbol has been silent for stale_ms, a row ``back`` with its next trade.

    By event time the silence is between trades, or between a symbol's last trade and the
    watermark that the others move; by the clock it is since the last batch with a trade.
    """

    def __init__(self, stale_ms: int, clock: bool) -> None:
        self.stale_ms, self.clock = stale_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, us long, n long, stale boolean")

    def _wait(self, start_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(start_ms + self.stale_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ms, us, n, stale = self.last.get() if self.last.exists() else (None, None, 0, False)
        out = []
        for (at,) in pieces(ordered(rows, ["us"], ("us",)), ["us"]):
            if us is not None and at < us:
                n += 1
                continue
            if not self.clock and us is not None and not stale and at - us > self.stale_ms * 1000:
                out.append((*key, "stale", us, n))
                stale = True
            if stale:
                out.append((*key, "back", at, n))
                stale = False
            us, n = at, n + 1
        ms = timerValues.getCurrentProcessingTimeInMs() if self.clock else us // 1000
        self.last.update((int(ms), int(us), n, stale))
        self._wait(int(ms) + (0 if self.clock else 1))
        yield pd.DataFrame(out, columns=["symbol", "status", "us", "n_trades"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            ms, us, n, stale = self.last.get()
            if not stale:
                self.last.update((ms, us, n, True))
                yield pd.DataFrame([(*key, "stale", us, n)], columns=["symbol", "status", "us", "n_trades"])

    def close(self) -> None:
        pass


def staleness(tape: DataFrame, stale_ms: int = 90_000, clock: bool = True, watermark: str = "0 seconds") -> DataFrame:
    """symbol, status (stale or back), ts (last trade before, first trade after), n_trades so far.

    With clock=False silence is measured between event times; a watermark then bounds how
    late rows may be.
    """
    kind = tape.schema["symbol"].dataType.simpleString()
    rows = tape if clock else tape.withWatermark("ts", watermark)
    rows = rows.select("symbol", "ts", F.unix_micros("ts").alias("us"))
    mode = "ProcessingTime" if clock else "EventTime"
    out = rows.groupBy("symbol").transformWithStateInPandas(Staleness(stale_ms, clock), f"symbol {kind}, status string, us long, n_trades long", "Append", mode)
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


# --- a bounded tail, computed anew ----------------------------------------------------------------


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at path, None where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if files.exists(folder) else None


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bar_features(tape: DataFrame, features: Callable[[DataFrame], DataFrame], sec: int, root: str, keep: int = 50_000, bars: int = 1) -> DataStreamWriter:
    """A writer that computes features(trades) for the bars of ``sec`` seconds that each batch completes.

    ``features`` maps trades to rows with symbol and bar (its start in epoch seconds) and may
    look back over ``bars`` bars with trades, the bar itself included. It sees the tail of the batch before and
    all rows of this one, however many they are. The tail, in root/tail/<batch>, is the last ``keep`` trades of
    each symbol, and more where its bar under way and the ``bars`` - 1 before it have more: none of
    these is cut. Results are in root/out/<batch>, read by ``read_features``. A bar is complete
    when a later bar of the symbol has a trade, and is written once, by the batch that completes
    it. Batch n reads the tail of n - 1 and replaces its own folders, so running it again changes
    nothing; the tail of n - 2 is deleted when n is written.
    """
    schema = tape.schema

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = _read(spark, f"{root}/tail/{batch - 1}", schema)
        joint = rows if before is None else before.unionByName(rows)
        at = time_bin(c("ts"), sec)
        sizes = joint.groupBy("symbol", at.alias("bar")).agg(F.count("*").alias("_n"))
        newest = Window.partitionBy("symbol").orderBy(F.desc("bar"))
        # Trades of the later bars; a bar is whole in the tail, or cut at keep, or not there.
        held = sizes.withColumns({"_newer": F.coalesce(F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_i": F.row_number().over(newest)})
        held = held.filter((c("_i") <= bars) | (c("_newer") < keep)).withColumn("_left", F.when((c("_i") <= bars) | (c("_newer") + c("_n") <= keep), c("_n")).otherwise(keep - c("_newer")))
        last = Window.partitionBy("symbol", "bar").orderBy(F.desc("ts"), F.desc("seq"))
        tail = joint.withColumn("bar", at).join(held.select("symbol", "bar", "_left"), ["symbol", "bar"]).withColumn("_k", F.row_number().over(last)).filter(c("_k") <= c("_left"))
        tail.select(*schema.names).write.mode("overwrite").parquet(f"{root}/tail/{batch}")
        under_way = lambda df, name: df.groupBy("symbol").agg(F.max(at).alias(name))
        now = under_way(joint, "_now")
        done = now.withColumn("_was", F.lit(None).cast("long")) if before is None else now.join(under_way(before, "_was"), "symbol", "left")
        out = features(joint).join(done, "symbol").filter((c("bar") < c("_now")) & (c("_was").isNull() | (c("bar") >= c("_was"))))
        out.drop("_now", "_was").write.mode("overwrite").parquet(f"{root}/out/{batch}")
        _drop(spark, f"{root}/tail/{batch - 2}")

    return tape.writeStream.foreachBatch(write)


def read_features(spark: SparkSession, root: str) -> DataFrame:
    """The results of all batches of ``bar_features``."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")
