"""Live merging and bars by stateful streaming.

A StatefulProcessor for each symbol keeps the pending taker order and the open bar, so
one state store holds what a live bot holds. Event time only: late rows beyond the
watermark are dropped by Spark; a row that is late but within it counts in arrival order.
Batch and stream share one merge rule, with or without the test of fill ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.bars import ohlcv
from tickloom.streaming.ordered import Columns, cuts, joined, order_starts, ordered, pieces, plain

ORDER = "symbol long, ts timestamp, seq long, price double, qty double, notional double, side string, first_price double, last_price double, first_id long, last_id long, n_fills long, n_raw_trades long"
_PENDING = "ts timestamp, last_ts timestamp, seq long, qty double, notional double, side string, first_price double, last_price double, first_id long, last_id long, n_fills long, n_raw_trades long"
BAR = "symbol long, bar_id long, ts timestamp, open double, high double, low double, close double, volume double, n_trades long, buy_volume double, sell_volume double"
_OPEN = "bar_id long, ts timestamp, open double, high double, low double, close double, volume double, n_trades long, buy_volume double, sell_volume double"
_NAMES = [x.split()[0] for x in _PENDING.split(", ")]
_BARS = [x.split()[0] for x in _OPEN.split(", ")]
_SENT = [x.split()[0] for x in ORDER.split(", ")]


class Merger(StatefulProcessor):
    """Joins fills into taker orders; an order is sent when the next fill breaks it, or when its timer ends."""

    def __init__(self, gap_ms: int = 100, require_ids: bool = True, flush_ms: int = 60_000) -> None:
        self.gap_ms, self.require_ids, self.flush_ms = gap_ms, require_ids, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = dict(zip(_NAMES, self.pending.get(), strict=True)) if self.pending.exists() else None
        whole = ordered(rows, ["ts", "seq", "price", "qty", "notional", "side", "first_id", "last_id", "n_fills"], ("ts", "seq"))
        for t in cuts(whole):
            p, sent = self._merge(p, t)
            sent |= {"symbol": np.full(len(sent["ts"]), key[0]), "price": sent["notional"] / (sent["qty"] + 1e-15)}
            yield pd.DataFrame({x: sent[x] for x in _SENT})
        self.pending.update(tuple(pd.Timestamp(p[x]).to_pydatetime() if x in ("ts", "last_ts") else plain(p[x]) for x in _NAMES))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(p["last_ts"]).timestamp() * 1000) + self.flush_ms)

    def _merge(self, p: dict | None, t: Columns) -> tuple[dict, Columns]:
        """The order under way after these rows, and the orders that are over."""
        t["us"] = t["ts"].astype("datetime64[us]").astype(np.int64)
        before = p and {"side": p["side"], "us": pd.Timestamp(p["last_ts"]).value // 1000, "price": p["last_price"], "last_id": p["last_id"]}
        starts = np.flatnonzero(order_starts(before, t, self.gap_ms * 1000, self.require_ids))
        n = len(t["us"])
        lead = starts[0] if len(starts) else n
        if p and lead:  # rows that go on with the order under way
            p |= {"last_ts": t["ts"][lead - 1], "last_price": t["price"][lead - 1], "last_id": t["last_id"][lead - 1], "n_raw_trades": p["n_raw_trades"] + int(lead)}
            p |= {x: p[x] + t[x][:lead].sum() for x in ("qty", "notional", "n_fills")}
        last = (np.append(starts[1:], n) - 1)[: len(starts)]
        runs = {x: t[x][starts] for x in ("ts", "seq", "side", "first_id")} | {"last_id": t["last_id"][last]}
        runs |= {"last_ts": t["ts"][last], "first_price": t["price"][starts], "last_price": t["price"][last], "n_raw_trades": np.diff(np.append(starts, n))}
        runs |= {x: np.add.reduceat(t[x], starts) if len(starts) else t[x][:0] for x in ("qty", "notional", "n_fills")}
        runs = joined(p, _NAMES, runs)
        return {x: runs[x][-1] for x in _NAMES}, {x: v[:-1] for x, v in runs.items()}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            p = dict(zip(_NAMES, self.pending.get(), strict=True))
            self.pending.clear()
            yield pd.DataFrame([self._row(key, p)], columns=_SENT)

    def _row(self, key, p: dict) -> tuple:
        return (key[0], p["ts"], p["seq"], p["notional"] / (p["qty"] + 1e-15), p["qty"], p["notional"], p["side"], p["first_price"], p["last_price"], p["first_id"], p["last_id"], p["n_fills"], p["n_raw_trades"])

    def close(self) -> None:
        pass


class EventBars(StatefulProcessor):
    """Bars that close after a count of trades or with the trade that reaches a volume; partial bars are not sent."""

    def __init__(self, count: int | None = None, volume: float | None = None) -> None:
        if (count is None) == (volume is None):
            raise ValueError("give count or volume")
        self.count, self.volume = count, volume

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("bar", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = dict(zip(_BARS, self.open.get(), strict=True)) if self.open.exists() else None
        out, last = [], b["bar_id"] - (b["n_trades"] > 0) if b else -1
        t = ordered(rows, ["ts", "seq", "price", "qty", "side"], ("ts", "seq"))
        for i, (price, qty, side) in enumerate(pieces(t, ["price", "qty", "side"])):
            if b is None or b["n_trades"] == 0:
                b = {"bar_id": last + 1, "ts": pd.Timestamp(t["ts"][i]).to_pydatetime(), "open": price, "high": price, "low": price, "close": price, "volume": 0.0, "n_trades": 0, "buy_volume": 0.0, "sell_volume": 0.0}
            buy = qty if side == "buy" else 0.0
            b |= {"high": max(b["high"], price), "low": min(b["low"], price), "close": price, "volume": b["volume"] + qty, "n_trades": b["n_trades"] + 1, "buy_volume": b["buy_volume"] + buy, "sell_volume": b["sell_volume"] + qty - buy}
            if (b["n_trades"] >= self.count) if self.count else (b["volume"] >= self.volume):
                out.append((key[0], *[b[n] for n in _BARS]))
                last = b["bar_id"]
                b = b | {"n_trades": 0, "bar_id": last}
        if b:
            self.open.update(tuple(b[n] for n in _BARS))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BAR.split(", ")])

    def close(self) -> None:
        pass


def merge_stream(tape: DataFrame, watermark: str = "1 minute", **options) -> DataFrame:
    """Taker orders of a streaming tape."""
    return tape.withWatermark("ts", watermark).groupBy("symbol").transformWithStateInPandas(Merger(**options), ORDER, "Append", "EventTime")


def event_bar_stream(tape: DataFrame, **options) -> DataFrame:
    """Count or volume bars of a streaming tape."""
    return tape.groupBy("symbol").transformWithStateInPandas(EventBars(**options), BAR, "Append", "None")


def time_bar_stream(tape: DataFrame, bar: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """Time bars of a streaming tape, sent once the watermark passes their end."""
    return tape.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", bar).alias("w")).agg(*ohlcv()).select("symbol", F.col("w.start").alias("bar_ts"), *[x for x in ("open", "high", "low", "close", "volume", "n_trades", "buy_volume", "sell_volume")])
