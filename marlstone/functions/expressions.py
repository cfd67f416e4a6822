"""Factors as text: a small language of fields, arithmetic and trailing-window functions, compiled to columns.

    $close / Ref($close, 5) - 1
    Corr(Rank($close, 20), Log($volume + 1), 10)
    If($close > Mean($close, 20), 1, -1)

Equal subexpressions are one column, whichever expressions they stand in. A window over another window's result needs
that result as a column first, so that windows are put into stages by their depth; all share one partitioning and
order, and Spark plans one exchange and one sort for any number of expressions.

A window holds the last n rows, fewer at the start of a series. Missing values (null) are left out of windows; what is
undefined, as a division by zero, is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .rolling import KEYS, ewms, last_n, series
from .safe import sdiv


class ExpressionError(ValueError):
    """What is wrong with an expression, and at which character."""

    def __init__(self, what: str, text: str, position: int):
        super().__init__(f"{what} at {position}: {text[:position]}>>{text[position:]}")
        self.position = position


@dataclass(frozen=True)
class Node:
    """A constant, a field, an operator or a function; equal nodes are one."""

    kind: str
    value: object = None
    args: tuple = ()

    def windows(self) -> int:
        """How many windows lie on top of each other."""
        below = max((a.windows() for a in self.args), default=0)
        return below + (self.kind == "call" and self.value in WINDOWS)


_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<field>\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|[-+*/()<>,&|]))")
_BINDS = {"|": 1, "&": 2, "<": 3, "<=": 3, ">": 3, ">=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5}


def parse(text: str) -> Node:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError("unknown sign", text, len(text) - len(text[at:].lstrip()))
        tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    tokens.append(("end", "", len(text)))
    place = 0

    def peek():
        return tokens[place]

    def take(value=None):
        nonlocal place
        kind, found, at = tokens[place]
        if value is not None and found != value:
            raise ExpressionError(f"{value!r} expected" + (f" for {found!r}" if found else ""), text, at)
        place += 1
        return kind, found, at

    def operand() -> Node:
        kind, value, at = take()
        if kind == "number":
            return Node("number", float(value))
        if kind == "field":
            return Node("field", value[1:])
        if value == "(":
            inner = climb(1)
            take(")")
            return inner
        if value in ("-", "+"):
            inner = operand()
            if value == "+":
                return inner
            return Node("number", -inner.value) if inner.kind == "number" else Node("op", "neg", (inner,))
        if kind == "name":
            if value not in FUNCTIONS:
                raise ExpressionError(f"no function {value}", text, at)
            take("(")
            args, places = [], []
            while True:
                places.append(peek()[2])
                args.append(climb(1))
                if peek()[1] != ",":
                    break
                take(",")
            take(")")
            return _call(value, args, places, text, at)
        raise ExpressionError("value expected" + (f" for {value!r}" if value else ""), text, at)

    def climb(least: int) -> Node:
        left = operand()
        while _BINDS.get(peek()[1], 0) >= least:
            _, op, _ = take()
            left = Node("op", op, (left, climb(_BINDS[op] + 1)))
        return left

    out = climb(1)
    if peek()[0] != "end":
        raise ExpressionError(f"end expected for {peek()[1]!r}", text, peek()[2])
    return out


def _call(name: str, args: list[Node], places: list[int], text: str, at: int) -> Node:
    values = FUNCTIONS[name].values
    sized = name in WINDOWS
    if len(args) != values + sized:
        raise ExpressionError(f"{name} takes {values + sized} arguments, not {len(args)}", text, at)
    if sized:
        n, where = args[-1], places[-1]
        if n.kind != "number" or n.value != int(n.value):
            raise ExpressionError(f"{name} takes a whole number of rows", text, where)
        if n.value < (0 if name in ("Ref", "Delta") else 1):
            raise ExpressionError(f"{name} takes no {int(n.value)} rows", text, where)
    return Node("call", name, tuple(args))


@dataclass(frozen=True)
class Function:
    #: How many columns it takes; a window function takes a number of rows after them.
    values: int
    build: Callable[..., Column]


def _over(aggregate):
    return lambda c, n, w: aggregate(c).over(last_n(w, n))


def _corr(a: Column, b: Column, n: int, w: WindowSpec) -> Column:
    both = a.isNotNull() & b.isNotNull()
    x, y, f = F.when(both, a), F.when(both, b), last_n(w, n)
    return sdiv(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f))


def _rank(c: Column, n: int, w: WindowSpec) -> Column:
    """Share of the window's values that are not above the newest, ties by their mean place."""
    window = F.collect_list(c).over(last_n(w, n))
    below, same = F.size(F.filter(window, lambda x: x < c)), F.size(F.filter(window, lambda x: x == c))
    return F.when(c.isNotNull(), (below + (same + 1) / 2) / F.size(window))


def _wma(c: Column, n: int, w: WindowSpec) -> Column:
    """Mean weighted 1, 2, ... from the oldest row of the window on, by sums of the rows' numbers."""
    f, no = last_n(w, n), F.col("_no")
    shift = F.least(F.lit(n), no) - no  # a row's weight is its number and this
    known = F.when(c.isNotNull(), no)
    return sdiv(F.sum(no * c).over(f) + shift * F.sum(c).over(f), F.sum(known).over(f) + shift * F.count(c).over(f))


def _ema(df: DataFrame, means: dict[str, tuple[str, int]], keys, by: str) -> DataFrame:
    """df with exponentially weighted means of a span; a missing row ages the others and has no weight."""
    given = {out: c for out, (c, n) in means.items() if n > 1}
    w = series(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumns({out: F.last(c, ignorenulls=True).over(w) for out, (c, n) in means.items() if n == 1})
    if not given:
        return own
    parts = {f"{out}_v": F.coalesce(c, F.lit(0.0)) for out, c in given.items()} | {f"{out}_k": F.col(c).isNotNull().cast("double") for out, c in given.items()}
    own = ewms(own.withColumns(parts), {f"{p}m": (p, means[p[:-2]][1]) for p in parts}, keys, by)
    return own.withColumns({out: sdiv(f"{out}_vm", f"{out}_km") for out in given}).drop(*parts, *[f"{p}m" for p in parts])


def _log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


WINDOWS: dict[str, Function] = {
    "Ref": Function(1, lambda c, n, w: F.lag(c, n).over(w)),
    "Delta": Function(1, lambda c, n, w: c - F.lag(c, n).over(w)),
    "Mean": Function(1, _over(F.avg)), "Sum": Function(1, _over(F.sum)), "Std": Function(1, _over(F.stddev_samp)),
    "Max": Function(1, _over(F.max)), "Min": Function(1, _over(F.min)), "Corr": Function(2, _corr),
    "Rank": Function(1, _rank), "WMA": Function(1, _wma), "EMA": Function(1, lambda c, n, w: c),  # by _ema, all of a stage
}
FUNCTIONS: dict[str, Function] = WINDOWS | {
    "Abs": Function(1, F.abs), "Sign": Function(1, F.signum), "Log": Function(1, _log),
    "If": Function(3, lambda c, a, b: F.when(c.cast("boolean"), a).otherwise(b)),
}
_OPERATORS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": sdiv, "neg": lambda a: -a,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "&": lambda a, b: a.cast("boolean") & b.cast("boolean"), "|": lambda a, b: a.cast("boolean") | b.cast("boolean"),
}


def compute(df: DataFrame, expressions: dict[str, str], keys=KEYS, by: str = "date") -> DataFrame:
    """df with a column of doubles for each named expression, over series by ``keys`` in the order of ``by``.

    Conditions are 1 and 0. A field that df lacks is an error, at its place.
    """
    nodes = {}
    for name, text in expressions.items():
        nodes[name] = parse(text)
        _known(nodes[name], df, text)
    w = series(*keys, by=by)
    stages: dict[int, dict[Node, None]] = {}

    def visit(node: Node) -> None:
        for a in node.args:
            visit(a)
        if node.kind == "call" and node.value in WINDOWS:
            stages.setdefault(node.windows(), {})[node] = None

    for node in nodes.values():
        visit(node)
    made: dict[Node, str] = {}

    def column(node: Node) -> Column:
        if node in made:
            return F.col(made[node])
        if node.kind == "number":
            return F.lit(node.value)
        if node.kind == "field":
            return F.col(node.value).cast("double")
        if node.kind == "op":
            return _OPERATORS[node.value](*[column(a).cast("double") for a in node.args])
        function = FUNCTIONS[node.value]
        args = [column(a) for a in node.args[: function.values]]
        return function.build(*args, int(node.args[-1].value), w) if node.value in WINDOWS else function.build(*args)

    own = df.withColumn("_no", F.row_number().over(w)) if any(n.value == "WMA" for s in stages.values() for n in s) else df
    for depth in sorted(stages):
        names = {node: f"_x{len(made) + k}" for k, node in enumerate(stages[depth])}
        own = own.withColumns({c: column(node).cast("double") for node, c in names.items()})
        means = {c: node for node, c in names.items() if node.value == "EMA"}
        if means:  # these hold the values yet
            own = own.withColumnsRenamed({c: f"{c}_in" for c in means})
            own = _ema(own, {c: (f"{c}_in", int(node.args[-1].value)) for c, node in means.items()}, keys, by)
        made |= names
    return own.select(*[c for c in df.columns if c not in nodes], *[column(n).cast("double").alias(name) for name, n in nodes.items()])


def _known(node: Node, df: DataFrame, text: str) -> None:
    if node.kind == "field" and node.value not in df.columns:
        raise ExpressionError(f"no field {node.value}", text, re.search(rf"\${node.value}\b", text).start())
    for a in node.args:
        _known(a, df, text)
