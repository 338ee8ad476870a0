"""A symbol's rows of one batch in order, as narrow columns, and what can be said of them column by column.

A batch may hold millions of rows of a symbol, so they are never a list of Python rows at
once: columns are 8 bytes a value, and loops take them in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rows that are Python objects at a time, and rows of a frame that is handed on.
PIECE = 50_000
Columns = dict[str, np.ndarray]


def ordered(rows: Iterator[pd.DataFrame], columns: list[str], order: tuple[str, ...]) -> Columns:
    """The named columns of all frames, sorted."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in columns}
    for frame in rows:
        for n, held in parts.items():
            held.append(frame[n].to_numpy())
    out = {n: np.concatenate(parts.pop(n)) for n in columns}
    at = np.lexsort([out[n] for n in reversed(order)])
    for n in columns:
        out[n] = out[n][at]
    return out


def cuts(t: Columns) -> Iterator[Columns]:
    """The rows in pieces, one after the other."""
    for start in range(0, len(next(iter(t.values()))), PIECE):
        yield {n: x[start : start + PIECE] for n, x in t.items()}


def pieces(t: Columns, columns: list[str]) -> Iterator[tuple]:
    """Rows of the named columns as tuples of Python values."""
    for start in range(0, len(t[columns[0]]), PIECE):
        yield from zip(*(t[n][start : start + PIECE].tolist() for n in columns), strict=True)


def frames(t: Columns) -> Iterator[pd.DataFrame]:
    """The columns as frames of bounded size; one without rows if there are none."""
    for start in range(0, max(len(next(iter(t.values()))), 1), PIECE):
        yield pd.DataFrame({n: x[start : start + PIECE] for n, x in t.items()})


def plain(x):
    """A value of a column as Python's own, None if it is missing."""
    x = x.item() if hasattr(x, "item") else x
    return None if x is None or x != x else x


def joined(held: dict | None, names: list[str], t: Columns) -> Columns:
    """The columns with one row before them, if there is one."""
    if held is None:
        return {n: t[n] for n in names}
    return {n: np.concatenate([np.array([held[n]], t[n].dtype if held[n] is not None else float), t[n]]) for n in names}


def order_starts(held: dict | None, t: Columns, gap: int, require_ids: bool) -> np.ndarray:
    """For each row whether it starts a taker order, by the row before it; before the first it is that of an order under way.

    ``held`` has side, us, price and last_id of that row; gap is in microseconds, passed in whole milliseconds.
    """
    b = joined(held, ["side", "us", "price", "last_id"], t)
    n = len(t["us"])
    if held is None:
        b = {k: x[:-1] for k, x in b.items()}
        now = {k: x[1:] for k, x in t.items() if k in ("side", "us", "price", "first_id")}
    else:
        b = {k: x[:n] for k, x in b.items()}
        now = t
    worse = np.where(now["side"] == "buy", now["price"] >= b["price"], now["price"] <= b["price"])
    goes_on = (now["side"] == b["side"]) & ((now["us"] - b["us"]) // 1000 * 1000 < gap) & worse
    if require_ids:
        goes_on &= now["first_id"] == b["last_id"] + 1
    starts = ~goes_on.astype(bool)
    return starts if held is not None else np.concatenate([np.ones(min(n, 1), bool), starts])
