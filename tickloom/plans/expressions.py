"""The factor language: op(op(field, d), d), compiled to staged columns.

A batch of expressions is parsed into nodes that are shared wherever they are alike;
each depth of nesting becomes one select, so a sub-expression is computed once for the
whole batch. Unknown names and fields fail when compiled, before any data is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.rolling import REGISTRY
from tickloom.windows import Series

NAME = re.compile(r"\s*([A-Za-z_]\w*)\s*")
NUMBER = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*")


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Const:
    value: float


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple
    params: tuple = ()


Node = Field | Const | Call


def parse(text: str) -> Node:
    """The node of an expression; ValueError says where it is wrong."""

    def node(at: int) -> tuple[Node, int]:
        if m := NAME.match(text, at):
            name, at = m[1], m.end()
            if at < len(text) and text[at] == "(":
                args, at = [], at + 1
                while True:
                    x, at = node(at)
                    args.append(x)
                    if at >= len(text) or text[at] not in ",)":
                        raise ValueError(f"expected , or ) at {at} in {text!r}")
                    at += 1
                    if text[at - 1] == ")":
                        break
                while at < len(text) and text[at].isspace():
                    at += 1
                return call(name, args), at
            return Field(name), at
        if m := NUMBER.match(text, at):
            return Const(float(m[1])), m.end()
        raise ValueError(f"expected a name or a number at {at} in {text!r}")

    def call(name: str, args: list[Node]) -> Call:
        if name not in REGISTRY:
            raise ValueError(f"unknown operator {name} in {text!r}")
        n = REGISTRY[name][1]
        series, rest = args[:n], args[n:]
        if len(series) < n or any(isinstance(x, Const) for x in series) or not all(isinstance(x, Const) for x in rest):
            raise ValueError(f"{name} takes {n} series, then numbers, in {text!r}")
        params = [x.value for x in rest]
        if not params and name not in ("log1p_safe", "abs_val"):
            params = [20.0] if n == 2 else [1.0] if name == "ts_returns" else []
            if not params:
                raise ValueError(f"{name} needs a parameter in {text!r}")
        if name != "signedpower" and params:
            params[0] = int(params[0])
        return Call(name, tuple(series), tuple(params))

    out, at = node(0)
    if at != len(text):
        raise ValueError(f"unexpected text at {at} in {text!r}")
    return out


def show(n: Node) -> str:
    if isinstance(n, Field):
        return n.name
    if isinstance(n, Const):
        return f"{n.value:g}"
    return f"{n.op}({', '.join([*map(show, n.args), *(f'{p:g}' for p in n.params)])})"


def order(n: Node) -> int:
    """Number of operators on the deepest path."""
    return 1 + max((order(a) for a in n.args), default=0) if isinstance(n, Call) else 0


def fields(n: Node) -> set[str]:
    return {n.name} if isinstance(n, Field) else set().union(*map(fields, n.args)) if isinstance(n, Call) else set()


def lookback(n: Node) -> int:
    """Rows before this one that a value depends on."""
    if not isinstance(n, Call):
        return 0
    own = REGISTRY[n.op][2](n.params[0]) if n.params else 0
    return int(own) + max((lookback(a) for a in n.args), default=0)


def evaluate(df: DataFrame, expressions: dict[str, str], series: Series, keep: Iterable[str] | None = None) -> DataFrame:
    """df with a column for each named expression. keep: the columns of df that stay."""
    keep = list(df.columns if keep is None else keep)
    roots = {name: parse(text) for name, text in expressions.items()}
    missing = set().union(*map(fields, roots.values())) - set(df.columns)
    if missing:
        raise ValueError(f"no such fields: {', '.join(sorted(missing))}")
    depth: dict[int, dict[Call, str]] = {}
    names: dict[Node, str] = {}

    def visit(n: Node) -> None:
        if isinstance(n, Call) and n not in names:
            for a in n.args:
                visit(a)
            names[n] = f"_x{len(names)}"
            depth.setdefault(order(n), {})[n] = names[n]

    for root in roots.values():
        visit(root)
    col = lambda n: F.col(n.name).cast("double") if isinstance(n, Field) else F.lit(n.value) if isinstance(n, Const) else F.col(names[n])
    for level in sorted(depth):
        made = [REGISTRY[n.op][0](series, *map(col, n.args), *n.params).alias(alias) for n, alias in depth[level].items()]
        df = df.select("*", *made)
    return df.select(*keep, *[col(root).alias(name) for name, root in roots.items()])


def unpivot(df: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row for each expression and row: ids, expr, value."""
    return df.unpivot(ids, names, "expr", "value")
