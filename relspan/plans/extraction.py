"""From extracted items to constraints: branches of categorical columns, variables with bounds, filters and derived columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from statistics import NormalDist

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.plans import relation as R
from relspan.plans.catalog import Catalog, Column
from relspan.plans.patches import Refused

STEP = 1e-9


class Forks:
    """The categories known of each (table, column), in the order in which facts state them."""

    def __init__(self, stated: list[tuple[tuple[str, str], list[str]]] = ()):
        self.known: dict[tuple[str, str], dict[str, None]] = {}
        for key, categories in stated:
            self.known.setdefault(key, {}).update(dict.fromkeys(categories))

    def branch(self, key: tuple[str, str], op: str, values: list[str]) -> list[str] | None:
        """The categories where the condition holds. None: it can't be told, as `neq` needs all categories, or the operator is no other."""
        known = self.known.get(key)
        if op in ("eq", "in"):
            return list(values) if known is None else [k for k in known if k in values]
        if op == "neq" and known is not None:
            return [k for k in known if k not in values]
        return None


_CONDITION = re.compile(r"\s*(\w+)\.(\w+)\s*(==|=|!=|<>|NOT\s+IN\b|IN\b)\s*(.+?)\s*", re.IGNORECASE | re.DOTALL)
_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|\"([^\"]*)\"|([^\s'\",()]+))\s*")


def parse_condition(text: str) -> tuple[tuple[str, str], str, list[str]] | None:
    """((table, column), op, values) of `TABLE.column = 'a'`, `!=`, `<>`, `IN ('a', 'b')`; op is eq, neq or in. None for anything else."""
    m = _CONDITION.fullmatch(text or "")
    if not m:
        return None
    table, column, sign, rest = m.groups()
    listed = " ".join(sign.upper().split())
    if listed == "NOT IN":
        return None
    if listed == "IN":
        if not (rest.startswith("(") and rest.endswith(")")):
            return None
        rest = rest[1:-1]
    values, at = [], 0
    while True:
        v = _VALUE.match(rest, at)
        if not v:
            return None
        values.append(next(g for g in v.groups() if g is not None).replace("''", "'"))
        at = v.end()
        if at == len(rest):
            break
        if rest[at] != "," or listed != "IN":
            return None
        at += 1
    return (table, column), {"IN": "in", "=": "eq", "==": "eq"}.get(listed, "neq"), values


@dataclass
class Variable:
    """A column's bounds and categories, as all constraints on it leave them; categories None: any."""

    low: float = -math.inf
    high: float = math.inf
    categories: set[str] | None = None

    @property
    def empty(self) -> bool:
        return self.low > self.high or self.categories == set()


def variables(items: list[dict], catalog: Catalog) -> dict[tuple[str, str], Variable]:
    """Of items {"table", "column", "op", "value"}: op lt, lte, gt, gte, eq, range ("min", "max") or in ("values").

    Bounds and categories meet. A strict bound moves by 1 on integers and by STEP
    elsewhere. Items with a condition bind only where it holds, and are left out.
    """
    out: dict[tuple[str, str], Variable] = {}
    for i in items:
        if i.get("if") is not None:
            continue
        t = catalog.tables.get(i["table"])
        c = t and t.column(i["column"])
        if c is None:
            raise Refused(f"no column {i['table']}.{i['column']}")
        v, step, x = out.setdefault((t.name, c.name), Variable()), 1 if c.type == "INTEGER" else STEP, i.get("value")
        match i["op"]:
            case "gt" | "gte":
                v.low = max(v.low, x + step * (i["op"] == "gt"))
            case "lt" | "lte":
                v.high = min(v.high, x - step * (i["op"] == "lt"))
            case "range":
                v.low = max(v.low, i["min"] if i.get("min") is not None else -math.inf)
                v.high = min(v.high, i["max"] if i.get("max") is not None else math.inf)
            case "eq" if not isinstance(x, str):
                v.low, v.high = max(v.low, x), min(v.high, x)
            case "eq" | "in":
                allowed = set(i["values"] if i["op"] == "in" else [x])
                v.categories = allowed if v.categories is None else v.categories & allowed
            case _:
                raise Refused(f"no operator {i['op']}")
    return out


_SIGN = {"eq": "=", "neq": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def predicate(item: dict) -> object:
    """The item's comparison as a predicate of the algebra; {"rhs_column"} compares two columns."""
    left = R.Col(item["column"])
    match item["op"]:
        case "range":
            return R.Between(left, R.Lit(item["min"]), R.Lit(item["max"]))
        case "in":
            return R.Among(left, tuple(item["values"]))
        case op if op in _SIGN:
            return R.Compare(_SIGN[op], left, R.Col(item["rhs_column"]) if "rhs_column" in item else R.Lit(item["value"]))
    raise Refused(f"no operator {item['op']}")


def bridged(item: dict) -> tuple[object, object]:
    """(relation, predicate): the predicate is to hold in every row of the relation. A condition makes it a filter of its table."""
    base = R.Base(item["table"])
    return (base if item.get("if") is None else R.Filter(base, predicate(item["if"]))), predicate(item)


@dataclass(frozen=True)
class Derived:
    """A column that is arithmetic over others. tables: those that the expression reads, the target's where none are given."""

    table: str
    name: str
    expression: object
    facts: tuple[int, ...]
    tables: tuple[str, ...] = field(default=())

    def reads(self) -> set[str]:
        def names(e) -> set[str]:
            return {e.name} if isinstance(e, R.Col) else names(e.left) | names(e.right) if isinstance(e, R.Arith) else set()

        return names(self.expression)

    def errors(self, catalog: Catalog) -> list[str]:
        out, tables = [], self.tables or (self.table,)
        if not self.facts:
            out.append("no fact states the derivation")
        for t in (self.table, *tables):
            if t not in catalog.tables:
                out.append(f"no table {t}")
        if self.table in catalog.tables and catalog.tables[self.table].column(self.name):
            out.append(f"column {self.table}.{self.name} exists")
        there = [c.name for t in dict.fromkeys(tables) if t in catalog.tables for c in catalog.tables[t].columns]
        for c in sorted(self.reads()):
            if there.count(c) != 1:
                out.append(f"column {c} is {'missing' if c not in there else 'ambiguous'}")
        return out

    def patch(self) -> dict:
        """The patch that adds the column to the catalog."""
        return {"action": "add_column", "table": self.table, "column": self.name, "type": "FLOAT"}

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows with the column; rows hold the columns of all tables that it reads."""
        return rows.withColumn(self.name, R.column(self.expression).cast("double"))


def derivation_order(items: list[Derived]) -> list[Derived]:
    """Derived columns of one table so that each comes after those that it reads. Refuses circles."""
    left, out = list(items), []
    while left:
        waiting = {d.name for d in left}
        ready = [d for d in left if not d.reads() & waiting]
        if not ready:
            raise Refused(f"the columns {sorted(waiting)} are derived from one another")
        out += ready
        left = [d for d in left if d not in ready]
    return out


def cut_points(shares: list[float]) -> list[float]:
    """Thresholds on a standard normal variable, one fewer than the shares, below which their running sums fall."""
    total, at, out = sum(shares), 0.0, []
    if not shares or total <= 0 or min(shares) < 0:
        raise ValueError("shares must be at least 0 with a positive sum")
    for s in shares[:-1]:
        at += s / total
        out.append(-math.inf if at <= 0 else math.inf if at >= 1 else NormalDist().inv_cdf(at))
    return out


def by_cut_points(latent: C, points: list[float], names: list[str]) -> C:
    """The name of the interval that a latent value lies in; one name more than points; null for a null."""
    if len(names) != len(points) + 1:
        raise ValueError("one name more than cut points is needed")
    out = F.when(latent.isNull(), F.lit(None).cast("string"))
    for x, n in zip(points, names, strict=False):
        out = out.when(latent < F.lit(x), n)
    return out.otherwise(names[-1])


def added(catalog: Catalog, item: Derived) -> Catalog:
    """The catalog with the derived column. Refused where errors() is not empty."""
    if found := item.errors(catalog):
        raise Refused("; ".join(found))
    t = catalog.tables[item.table]
    return Catalog(catalog.tables | {t.name: replace(t, columns=(*t.columns, Column(item.name, "FLOAT", True)))}, list(catalog.links))
