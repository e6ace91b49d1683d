"""The expression language: text to tree, rewriting, identity, and Spark columns.

A tree is made of ``Node`` values: leaf (name), number (value), or an operator
with arguments; infix operators are operators named by their sign.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

VERSION = "0.1.0"
# Fixed values of the language.
WINDOWS = (1, 3, 5, 10, 20, 60, 120, 250)
GRID = (0.0, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)
TRIVIAL = (-1.0, 0.0, 1.0)
MOST_CONSTANTS = 3
LEAVES = ("$open", "$high", "$low", "$close", "$volume", "$vwap", "$returns", "$funding_rate", "$open_interest", "$regime_state")
FAMILY_OF_LEAF = {
    "$open": "price", "$high": "price", "$low": "price", "$close": "price", "$returns": "price", "$vwap": "price",
    "$volume": "volume", "$dollar_volume": "volume", "$turnover": "volume",
    "$funding_rate": "funding", "$open_interest": "positioning", "$regime_state": "regime",
}
ALIASES = {"SMA": "TS_MEAN", "CORRELATION": "TS_CORR"}
TS_TWO = ("DELTA", "DELAY", "TS_MEAN", "TS_STD", "TS_MAX", "TS_MIN", "TS_RANK", "TS_ZSCORE", "TS_PCTCHANGE")
CROSS = ("RANK", "ZSCORE", "SCALE")
ARITY = (
    {name: 2 for name in TS_TWO}
    | {"TS_CORR": 3, "WHERE": 3}
    | {name: 1 for name in (*CROSS, "ABS", "SIGN", "LOG", "SQRT", "NEG", "NOT")}
    | {name: 2 for name in ("EQ", "GT", "LT", "AND", "OR")}
)
INFIX = ("+", "-", "*", "/")


class ExpressionError(ValueError):
    pass


class Node(NamedTuple):
    op: str  # "leaf", "number" or an operator
    value: object = None
    args: tuple = ()

    def __str__(self) -> str:
        return render(self)


def leaf(name: str) -> Node:
    return Node("leaf", name)


def number(x: float) -> Node:
    return Node("number", float(x))


def call(op: str, *args: Node) -> Node:
    return Node(op, None, args)


def walk(node: Node, parent: Node | None = None, place: int = 0) -> Iterator[tuple[Node, Node | None, int]]:
    """Every node with its parent and its place among the arguments, top down."""
    yield node, parent, place
    for i, a in enumerate(node.args):
        yield from walk(a, node, i)


def rebuild(node: Node, change: Callable[[Node, Node | None, int], Node], parent: Node | None = None, place: int = 0) -> Node:
    """Bottom up: ``change`` sees each node, its old parent and place."""
    inner = Node(node.op, node.value, tuple(rebuild(a, change, node, i) for i, a in enumerate(node.args)))
    return change(inner, parent, place)


# ---- text to tree ---------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<leaf>\$\w+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|[-+*/<>(),]))")


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position) triples; raises at the first character that starts no token."""
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at:].lstrip()[:1]!r} at position {at}")
        kind = m.lastgroup
        out.append((kind, m[kind], m.start(kind)))
        at = m.end()
    return out


#: How tightly infix words and signs bind, loosest first; comparisons don't chain.
_BINDING = {"or": 1, "and": 2, ">": 3, "<": 3, "==": 3, "+": 4, "-": 4, "*": 5, "/": 5}
_NAMED = {"or": "OR", "and": "AND", ">": "GT", "<": "LT", "==": "EQ"}
_UNARY = 6


class _Parser:
    def __init__(self, text: str, cross: bool):
        self.tokens, self.at, self.cross = tokenize(text), 0, cross

    def peek(self) -> tuple[str, str, int] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def fail(self, what: str):
        t = self.peek()
        raise ExpressionError(f"parse error at {'position ' + str(t[2]) if t else 'end of input'}: {what}")

    def take(self, sign: str) -> None:
        if not (t := self.peek()) or t[0] != "sign" or t[1] != sign:
            self.fail(f"expected {sign!r}")
        self.at += 1

    def infix(self) -> str | None:
        t = self.peek()
        word = t[1].lower() if t and t[0] in ("name", "sign") else ""
        return word if word in _BINDING else None

    def expression(self, least: int = 1) -> Node:
        left = self.prefix()
        while (sign := self.infix()) and _BINDING[sign] >= least:
            self.at += 1
            left = call(_NAMED.get(sign, sign), left, self.expression(_BINDING[sign] + 1))
            if _BINDING[sign] == 3:
                if (again := self.infix()) and _BINDING[again] == 3:
                    self.fail("comparisons don't chain")
        return left

    def prefix(self) -> Node:
        if not (t := self.peek()):
            self.fail("expected an expression")
        kind, text, _ = t
        if kind == "name" and text.lower() == "not":
            self.at += 1
            return call("NOT", self.prefix())
        if kind == "sign" and text in "+-":
            self.at += 1
            inner = self.prefix()
            if text == "+":
                return inner
            return number(-inner.value) if inner.op == "number" else call("NEG", inner)
        self.at += 1
        if kind == "number":
            return number(float(text))
        if kind == "leaf":
            return leaf(text.lower())
        if kind == "sign" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        self.at -= 1
        if kind != "name":
            self.fail(f"unexpected {text!r}")
        self.at += 1
        if not (n := self.peek()) or n[1] != "(":
            self.at -= 1
            self.fail(f"bare name {text!r}: leaves start with $")
        return self.call(text.upper())

    def call(self, name: str) -> Node:
        name = ALIASES.get(name, name)
        self.take("(")
        args = []
        while not ((t := self.peek()) and t[1] == ")"):
            if args:
                self.take(",")
            args.append(self.expression())
        self.take(")")
        if name not in ARITY:
            raise ExpressionError(f"unknown operator {name!r}")
        if len(args) != ARITY[name]:
            raise ExpressionError(f"{name}() takes exactly {ARITY[name]} argument(s)")
        if name in CROSS and not self.cross:
            raise ExpressionError(f"{name}() works across instruments, which is not allowed here")
        return call(name, *args)


def window_place(op: str) -> int | None:
    return 1 if op in TS_TWO else 2 if op == "TS_CORR" else None


def _role(node: Node, parent: Node | None, place: int) -> str:
    """window, category, trivial or free, for a number."""
    if parent is not None and window_place(parent.op) == place:
        return "window"
    if parent is not None and parent.op == "EQ" and node.value.is_integer() and leaf("$regime_state") in parent.args:
        return "category"
    return "trivial" if node.value in TRIVIAL else "free"


def _nearest(x: float) -> float:
    return min(GRID, key=lambda g: abs(g - abs(x)))


def on_grid(x: float) -> bool:
    return x in TRIVIAL or any(abs(abs(x) - g) <= max(abs(g) * 0.05, 1e-12) for g in GRID)


def check(tree: Node) -> Node:
    """Raise unless leaves, operators and constants are allowed."""
    for node, parent, place in walk(tree):
        if node.op == "leaf" and node.value not in LEAVES:
            raise ExpressionError(f"unknown leaf {node.value!r}")
        if node.op not in ("leaf", "number", *INFIX) and ARITY.get(node.op) != len(node.args):
            raise ExpressionError(f"unknown operator or wrong number of arguments: {node.op!r}")
        if parent is not None and window_place(parent.op) == place and node.op != "number":
            raise ExpressionError(f"the window of {parent.op} must be a constant")
        if node.op == "number":
            if not math.isfinite(node.value):
                raise ExpressionError(f"constant must be finite: {node.value!r}")
            role = _role(node, parent, place)
            if role == "window" and node.value not in WINDOWS:
                raise ExpressionError(f"window constant {node.value:g} is not in the allowed window set")
            if role == "free" and abs(abs(node.value) - _nearest(node.value)) > max(abs(_nearest(node.value)) * 0.05, 1e-12):
                raise ExpressionError(f"free constant {node.value:g} is not on the allowed grid")
    return tree


def snap(tree: Node) -> Node:
    """Free constants moved to the nearest grid value, sign kept."""

    def change(node, parent, place):
        if node.op == "number" and _role(node, parent, place) == "free":
            return number(math.copysign(_nearest(node.value), node.value))
        return node

    return rebuild(tree, change)


def free_constants(tree: Node) -> int:
    return sum(n.op == "number" and _role(n, p, i) == "free" for n, p, i in walk(tree))


def parse(text: str, *, cross_sectional: bool = False) -> Node:
    p = _Parser(text, cross_sectional)
    tree = p.expression()
    if p.peek():
        p.fail(f"unexpected {p.peek()[1]!r}")
    tree = rebuild(tree, lambda n, *_: call("GT", n.args[1], n.args[0]) if n.op == "LT" else n)
    tree = snap(check(tree))
    if (n := free_constants(tree)) > MOST_CONSTANTS:
        raise ExpressionError(f"{n} free constants; at most {MOST_CONSTANTS} are allowed")
    return tree


# ---- identity -------------------------------------------------------------


def as_json(node: Node) -> str:
    def plain(n: Node):
        return n.value if n.op in ("leaf", "number") else [n.op, *map(plain, n.args)]

    return json.dumps(plain(node), separators=(",", ":"))


def digest(node: Node) -> str:
    return hashlib.blake2b(as_json(node).encode(), digest_size=16).hexdigest()


# ---- rewriting ------------------------------------------------------------
# Rules take a node whose arguments are already canonical and return a new node
# or None. None of them may change where a result is missing, so x * 0 and
# x / x stay as they are.

_SWAPS = ("+", "*", "AND", "OR", "EQ")
_ODD_1 = CROSS  # f(-x) = -f(x)
_ODD_2 = ("TS_MEAN", "DELAY", "DELTA", "TS_ZSCORE")
_FOLD_2 = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else None}
_FOLD_1 = {
    "NEG": lambda a: -a,
    "ABS": abs,
    "SIGN": lambda a: float((a > 0) - (a < 0)),
    "NOT": lambda a: float(not (a and math.isfinite(a))),
    "LOG": lambda a: math.log(a) if a > 0 else None,
    "SQRT": lambda a: math.sqrt(a) if a >= 0 else None,
}


def _negated(n: Node) -> Node | None:
    return n.args[0] if n.op == "NEG" else None


def _fold(n: Node) -> Node | None:
    values = [a.value for a in n.args if a.op == "number"]
    if len(values) < len(n.args):
        return None
    if n.op in _FOLD_1:
        got = _FOLD_1[n.op](*values)
        return None if got is None else number(got)
    if n.op in _FOLD_2:
        got = _FOLD_2[n.op](*values)
        return number(got) if got is not None and on_grid(got) else None
    return None


def _neutral(n: Node) -> Node | None:
    for op, value, places in (("+", 0.0, (0, 1)), ("*", 1.0, (0, 1)), ("/", 1.0, (1,))):
        for i in places if n.op == op else ():
            if n.args[i] == number(value):
                return n.args[1 - i]
    return None


def _pull_sign(n: Node) -> Node | None:
    inner = [_negated(a) for a in n.args]
    if n.op == "+" and all(inner):
        return call("NEG", call("+", *inner))
    if n.op == "*" and (inner[0] is None) != (inner[1] is None):
        return call("NEG", call("*", *[b or a for a, b in zip(n.args, inner)]))
    if (n.op in _ODD_1 or n.op in _ODD_2) and inner[0]:
        return call("NEG", call(n.op, inner[0], *n.args[1:]))
    return None


def _nested(n: Node) -> Node | None:
    if len(n.args) != 1:
        return None
    (a,) = n.args
    if n.op in ("NEG", "NOT") and a.op == n.op:
        return a.args[0]
    if n.op == a.op and n.op in ("ABS", "SIGN", "RANK", "ZSCORE"):
        return a
    if n.op == "ABS" and a.op == "NEG":
        return call("ABS", a.args[0])
    if n.op == "NOT" and a.op in ("AND", "OR"):
        return call("OR" if a.op == "AND" else "AND", *[call("NOT", x) for x in a.args])
    return None


def _branch(n: Node) -> Node | None:
    if n.op != "WHERE":
        return None
    c, a, b = n.args
    if a == b or c == number(1):
        return a
    if c == number(0):
        return b
    return call("WHERE", c.args[0], b, a) if c.op == "NOT" else None


def _no_minus(n: Node) -> Node | None:
    return call("+", n.args[0], call("NEG", n.args[1])) if n.op == "-" else None


def _greater(n: Node) -> Node | None:
    return call("GT", n.args[1], n.args[0]) if n.op == "LT" else None


def _order(n: Node) -> Node | None:
    if (n.op in _SWAPS or n.op == "TS_CORR") and digest(n.args[1]) < digest(n.args[0]):
        return call(n.op, n.args[1], n.args[0], *n.args[2:])
    return None


RULES = (_no_minus, _greater, _fold, _neutral, _pull_sign, _nested, _branch, _order)


def canonicalize(tree: Node) -> Node:
    """Apply the rules, from the leaves up, until nothing changes (10 passes at most)."""

    def change(node, *_):
        while (new := next((x for rule in RULES if (x := rule(node)) is not None), None)) is not None:
            node = new
        return node

    for _ in range(10):
        new = rebuild(tree, change)
        if new == tree:
            return new
        tree = new
    raise RuntimeError("rewriting did not end within 10 passes")


def fingerprint(tree: Node) -> str:
    return digest(canonicalize(tree))


def render(node: Node, above: int = 0, right: bool = False) -> str:
    """Text that parses to the same tree, with few parentheses."""
    if node.op == "leaf":
        return str(node.value)
    if node.op == "number":
        return str(int(node.value)) if node.value == int(node.value) else f"{node.value:.10g}"
    if node.op in INFIX:
        own = _BINDING[node.op]
        text = f"{render(node.args[0], own)} {node.op} {render(node.args[1], own, True)}"
        return f"({text})" if own < above or right and own == above else text
    return f"{node.op}({', '.join(render(a) for a in node.args)})"


# ---- measures -------------------------------------------------------------


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.args)) if node.args else 0


def operators(tree: Node) -> Counter:
    return Counter(n.op for n, *_ in walk(tree) if n.args)


def leaves(tree: Node) -> set[str]:
    return {n.value for n, *_ in walk(tree) if n.op == "leaf"}


def lookbacks(tree: Node) -> set[int]:
    return {int(n.value) for n, p, i in walk(tree) if n.op == "number" and _role(n, p, i) == "window"}


def complexity(tree: Node) -> int:
    return 2 * sum(operators(tree).values()) + depth(tree) + len(leaves(tree)) + len(lookbacks(tree)) + free_constants(tree)


def categorical_comparisons(tree: Node) -> int:
    return operators(tree)["EQ"]


def consistent(tree: Node, required: list[str] | None) -> tuple[bool, str]:
    """Whether the leaves cover every required data family; the reason if not."""
    missing = sorted({f.lower() for f in required or ()} - {FAMILY_OF_LEAF[x] for x in leaves(tree)})
    return not missing, f"missing families: {', '.join(missing)}" if missing else "ok"


def contains_cross_section(tree: Node) -> bool:
    return any(n.op in CROSS for n, *_ in walk(tree))


# ---- tree to Spark --------------------------------------------------------


def truthy(x: Column) -> Column:
    return F.coalesce(x != 0, F.lit(False))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


_SCALAR: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": fr.divide,
    "ABS": F.abs,
    "SIGN": F.signum,
    "LOG": lambda a: F.when(a > 0, F.ln(a)),
    "SQRT": lambda a: F.when(a >= 0, F.sqrt(a)),
    "NEG": lambda a: -a,
    "EQ": lambda a, b: _flag(a == b),
    "GT": lambda a, b: _flag(a > b),
    "LT": lambda a, b: _flag(a < b),
    "AND": lambda a, b: _flag(truthy(a) & truthy(b)),
    "OR": lambda a, b: _flag(truthy(a) | truthy(b)),
    "NOT": lambda a: _flag(~truthy(a)),
    "WHERE": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
}


def _rank_in(x: Column, n: int, w) -> Column:
    if n == 1:
        return F.when(x.isNotNull(), F.lit(0.0))
    values = F.collect_list(x).over(w)
    upto = F.size(F.filter(values, lambda v: v <= x))
    return F.when((F.count(x).over(w) == n) & x.isNotNull(), (upto - 1) / F.lit(float(n - 1)))


def _windowed(op: str, args: list[Column], n: int, keys) -> Column:
    x, at = args[0], fr.line(keys)
    w = fr.trailing(n, keys)
    if op == "DELAY":
        return F.lag(x, n).over(at)
    if op == "DELTA":
        return x - F.lag(x, n).over(at)
    if op == "TS_PCTCHANGE":
        return fr.divide(x, F.lag(x, n).over(at)) - 1
    if op == "TS_RANK":
        return _rank_in(x, n, w)
    if op == "TS_CORR":
        return fr.correlation(x, args[1], n, w)
    if op == "TS_ZSCORE":
        return fr.zscore(x, n, w)
    pick = {"TS_MEAN": F.avg, "TS_STD": F.stddev_samp, "TS_MAX": F.max, "TS_MIN": F.min}[op]
    return fr.full(pick(x), x, n, w)


def _across(op: str, x: Column) -> Column:
    """RANK: average rank over count, 0..1; ZSCORE: population spread; SCALE: absolute values add up to 1."""
    w = Window.partitionBy(fr.TIME)
    if op == "RANK":
        return fr.divide(fr.average_rank(x, fr.TIME), F.count(x).over(w).cast("double"))
    if op == "ZSCORE":
        s = F.stddev_pop(x).over(w)
        return fr.divide(x - F.avg(x).over(w), F.when(s > 0, s))
    return fr.divide(x, F.sum(F.abs(x)).over(w))


def evaluate(df: DataFrame, trees: dict[str, Node], keys=fr.KEYS) -> DataFrame:
    """Add a column for each named tree.

    Windowed and cross-sectional nodes become columns of their own, each
    distinct one once (by its text), level by level; all of a level share one
    sort of the bars. What is scalar stays an expression on top.
    """
    for name, tree in trees.items():
        for x in leaves(tree):
            if x[1:] not in df.columns and not (x == "$returns" and "close" in df.columns):
                raise ExpressionError(f"{name} needs {x}, which the data lack")
    if any("$returns" in leaves(t) for t in trees.values()) and "returns" not in df.columns:
        c = F.col("close")
        df = df.withColumn("returns", fr.finite(F.ln(fr.divide(c, F.lag(c).over(fr.line(keys))))))
    staged: dict[str, str] = {}
    levels: dict[int, dict[str, Node]] = {}

    def stage(node: Node) -> int:
        """Level of windows needed below and at the node."""
        below = max([stage(a) for a in node.args], default=0)
        if window_place(node.op) is not None or node.op in CROSS:
            levels.setdefault(below, {})[as_json(node)] = node
            return below + 1
        return below

    def column(node: Node) -> Column:
        if (name := staged.get(as_json(node))) is not None:
            return F.col(name)
        if node.op == "leaf":
            return F.col(node.value[1:]).cast("double")
        if node.op == "number":
            return F.lit(node.value)
        return _SCALAR[node.op](*map(column, node.args))

    for tree in trees.values():
        stage(tree)
    made = []
    for level in sorted(levels):
        new = {}
        for key, node in levels[level].items():
            if node.op in CROSS:
                c = _across(node.op, column(node.args[0]))
            else:
                at = window_place(node.op)
                c = _windowed(node.op, [column(a) for i, a in enumerate(node.args) if i != at], int(node.args[at].value), keys)
            name = f"_x{len(made) + len(new)}"
            new[name] = (key, c)
        df = df.withColumns({name: c for name, (_, c) in new.items()})
        staged |= {key: name for name, (key, _) in new.items()}
        made += new
    return df.withColumns({name: column(tree) for name, tree in trees.items()}).drop(*made)


def signal(df: DataFrame, text: str, name: str = "signal", keys=fr.KEYS) -> DataFrame:
    """Parse, rewrite and evaluate one expression."""
    return evaluate(df, {name: canonicalize(parse(text))}, keys)
