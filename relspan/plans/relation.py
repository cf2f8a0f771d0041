"""The closed algebra of relations: nodes, checks, and their DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.functions import ranks
from relspan.plans.catalog import FAMILY, ORDERABLE, Catalog


class Refused(ValueError):
    """The algebra has no such relation."""


# expressions and predicates


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Negated:
    part: object


@dataclass(frozen=True)
class Between:
    item: object
    low: object
    high: object


@dataclass(frozen=True)
class Among:
    item: object
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class IfThen:
    condition: object
    result: object


_COMPARE = {"<": C.__lt__, "<=": C.__le__, "=": C.__eq__, "!=": C.__ne__, ">=": C.__ge__, ">": C.__gt__}


#: A column's name with this says whether its value is there, a BOOLEAN that is never null.
PRESENT = ".is_present"


def column(e) -> C:
    """An expression or predicate as a Column. Division gives a double, and null where the divisor is 0."""
    match e:
        case Lit(v):
            return F.lit(v)
        case Col(name) if name.endswith(PRESENT):
            return F.col(f"`{name.removesuffix(PRESENT)}`").isNotNull()
        case Col(name):
            return F.col(f"`{name}`")
        case Arith("/", a, b):
            return F.try_divide(column(a).cast("double"), column(b).cast("double"))
        case Arith(op, a, b):
            return {"+": C.__add__, "-": C.__sub__, "*": C.__mul__}[op](column(a), column(b))
        case Compare(op, a, b):
            return _COMPARE[op](column(a), column(b))
        case Both(parts):
            return reduce(C.__and__, map(column, parts))
        case Either(parts):
            return reduce(C.__or__, map(column, parts))
        case Negated(part):
            return ~column(part)
        case Between(item, low, high):
            return column(item).between(column(low), column(high))
        case Among(item, values, negated):
            found = column(item).isin(*values)
            return ~found if negated else found
        case IfThen(a, b):
            return ~column(a) | column(b)
    raise Refused(f"unsupported shape: {e!r}")


def names(e) -> set[str]:
    """The columns that an expression or predicate reads."""
    match e:
        case Col(name):
            return {name.removesuffix(PRESENT)}
        case Arith(_, a, b) | Compare(_, a, b) | IfThen(a, b):
            return names(a) | names(b)
        case Both(parts) | Either(parts):
            return set().union(*map(names, parts))
        case Negated(a) | Among(a):
            return names(a)
        case Between(a, b, c):
            return names(a) | names(b) | names(c)
    return set()


# relations


@dataclass(frozen=True)
class Base:
    table: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    left_on: tuple[str, str]  # table or alias, column
    right_on: tuple[str, str]


@dataclass(frozen=True)
class Filter:
    source: object
    where: object


@dataclass(frozen=True)
class Project:
    source: object
    outputs: tuple[tuple[object, str], ...]


@dataclass(frozen=True)
class Aggregate:
    source: object
    fn: str
    column: str  # or *
    alias: str
    by: tuple[str, ...] = ()
    param: float | None = None


@dataclass(frozen=True)
class Fanout:
    parent: object
    child: object
    column: str


@dataclass(frozen=True)
class Known:
    """What is known of a relation: types and nullability by column, where each comes from, names that are ambiguous, its key."""

    types: dict[str, str]
    nullable: dict[str, bool]
    origin: dict[str, tuple[str, str]]
    ambiguous: frozenset
    key: tuple[str, ...]
    tables: frozenset


NUMERIC_ONLY, ORDER_ONLY, ANY = {"SUM", "AVG", "STDDEV", "VARIANCE"}, {"MIN", "MAX", "MEDIAN", "PERCENTILE"}, {"COUNT", "COUNT_DISTINCT", "MODE"}


def typed(e, known: Known) -> str:
    match e:
        case Lit(v):
            return "BOOLEAN" if isinstance(v, bool) else "INTEGER" if isinstance(v, int) else "FLOAT" if isinstance(v, float) else "VARCHAR"
        case Col(name):
            of = name.removesuffix(PRESENT)
            if of in known.ambiguous:
                raise Refused(f"column {of} is ambiguous")
            if of not in known.types:
                raise Refused(f"no column {name}")
            if name != of and not known.nullable[of]:
                raise Refused(f"column {of} is always present")
            return known.types[of] if name == of else "BOOLEAN"
        case Arith(_, a, b):
            kinds = {typed(a, known), typed(b, known)}
            if any(FAMILY[k] != "numeric" for k in kinds):
                raise Refused("arithmetic needs numbers")
            return next(k for k in ("DECIMAL", "FLOAT", "INTEGER") if k in kinds)
    raise Refused(f"not an expression: {e!r}")


def check(p, known: Known) -> None:
    """Refuses predicates over unknown, ambiguous or incomparable columns."""
    match p:
        case Compare(_, a, b):
            _comparable(typed(a, known), typed(b, known), a, b)
        case Between(a, b, c):
            _comparable(typed(a, known), typed(b, known), a, b)
            _comparable(typed(a, known), typed(c, known), a, c)
        case Both(parts) | Either(parts):
            if len(parts) < 2:
                raise Refused("AND and OR take two parts or more")
            for x in parts:
                check(x, known)
        case Negated(a):
            check(a, known)
        case Among(a, values):
            typed(a, known)
            if not values or len(set(values)) != len(values):
                raise Refused("IN takes a list of different literals")
        case IfThen(a, b):
            check(a, known)
            check(b, known)
        case _:
            raise Refused(f"unsupported predicate shape: {p!r}")


def _comparable(a: str, b: str, x, y) -> None:
    fa, fb = FAMILY[a], FAMILY[b]
    dated = {fa, fb} == {"temporal", "string"} and isinstance(x if fa == "string" else y, Lit)
    if fa != fb and not dated:
        raise Refused(f"{a} and {b} can't be compared")


def not_null(p) -> set[str]:
    """Columns that are not null wherever the predicate holds: through AND and plain comparisons, not through OR."""
    match p:
        case Both(parts):
            return set().union(*map(not_null, parts))
        case Compare(_, Col(name), Lit(True)) | Compare(_, Lit(True), Col(name)) if name.endswith(PRESENT) and p.op == "=":
            return names(p)
        case Compare() | Between() | Among():
            return set() if _presence(p) else names(p)
        case Negated(Compare() | Between() | Among() as inner):
            return set() if _presence(inner) else names(inner)
    return set()


def _presence(p) -> bool:
    """Whether a comparison is of a presence."""
    return any(isinstance(x, Col) and x.name.endswith(PRESENT) for x in vars(p).values())


def known(r, catalog: Catalog) -> Known:
    """Types, keys and provenance of a relation, or Refused."""
    match r:
        case Base(table, alias):
            t = catalog.tables.get(table)
            if t is None:
                raise Refused(f"no table {table}")
            return Known({c.name: c.type for c in t.columns}, {c.name: c.nullable for c in t.columns}, {c.name: (table, c.name) for c in t.columns}, frozenset(), t.key, frozenset({alias or table}))
        case Join():
            child, parent, on, _, flipped = directed(r, catalog)
            both = frozenset(set(child.types) & set(parent.types)) | child.ambiguous | parent.ambiguous
            if child.tables & parent.tables:
                raise Refused(f"{', '.join(sorted(child.tables & parent.tables))} occurs twice: an alias is needed")
            loose = child.nullable[on]
            name = _alias(r, catalog)
            both = child.ambiguous | parent.ambiguous if name else both
            own = {c: f"{name}.{c}" for c in parent.types if c in child.types} if name else {}
            types, nullable, origin = ({own.get(c, c): v for c, v in of.items()} for of in (parent.types, parent.nullable, parent.origin))
            return Known(types | child.types, {c: n or loose for c, n in nullable.items()} | child.nullable, origin | child.origin, both, child.key, child.tables | parent.tables)
        case Filter(source, where):
            k = known(source, catalog)
            check(where, k)
            sure = not_null(where)
            return Known(k.types, {c: n and c not in sure for c, n in k.nullable.items()}, k.origin, k.ambiguous, k.key, k.tables)
        case Project(source, outputs):
            k = known(source, catalog)
            out = [a for _, a in outputs]
            if len(set(out)) != len(out) or not all(out):
                raise Refused("projected columns need names that differ")
            types = {a: typed(e, k) for e, a in outputs}
            kept = {e.name: a for e, a in outputs if isinstance(e, Col)}
            if not set(k.key) <= set(kept):
                raise Refused("a projection must keep the key")
            return Known(types, {a: not (isinstance(e, Col) and e.name.endswith(PRESENT)) and (any(k.nullable[c] for c in names(e)) or _divides(e)) for e, a in outputs}, {a: k.origin[c] for c, a in kept.items() if c in k.origin}, frozenset(), tuple(kept[c] for c in k.key), k.tables)
        case Aggregate(source, fn, of, alias, by, param):
            k = known(source, catalog)
            if fn not in NUMERIC_ONLY | ORDER_ONLY | ANY:
                raise Refused(f"no aggregate {fn}")
            if not alias or alias in by:
                raise Refused("an aggregate needs a name of its own")
            if of == "*" and fn != "COUNT":
                raise Refused("only COUNT takes *")
            if (fn == "PERCENTILE") != (param is not None) or (param is not None and not 0 <= param <= 100):
                raise Refused("PERCENTILE takes a number from 0 to 100, others take none")
            kind = "INTEGER" if of == "*" else typed(Col(of), k)
            if fn in NUMERIC_ONLY and FAMILY[kind] != "numeric" or fn in ORDER_ONLY and FAMILY[kind] not in ORDERABLE:
                raise Refused(f"{fn} can't take {kind}")
            if len(set(by)) != len(by):
                raise Refused("a grouping column occurs twice")
            types = {b: typed(Col(b), k) for b in by}
            result = "FLOAT" if fn in NUMERIC_ONLY else "INTEGER" if fn.startswith("COUNT") else kind
            return Known(types | {alias: result}, {b: k.nullable[b] for b in by} | {alias: not fn.startswith("COUNT")}, {b: k.origin[b] for b in by if b in k.origin}, frozenset(), tuple(by), k.tables)
        case Fanout(parent, child, on):
            p, c = known(parent, catalog), known(child, catalog)
            _links(c, on, p, p.key[0] if len(p.key) == 1 else "", catalog)
            return Known(p.types | {"child_count": "INTEGER"}, p.nullable | {"child_count": False}, p.origin, p.ambiguous, p.key, p.tables)
    raise Refused(f"not a relation: {r!r}")


def _divides(e) -> bool:
    return isinstance(e, Arith) and (e.op == "/" or _divides(e.left) or _divides(e.right))


def _links(child: Known, on: str, parent: Known, key: str, catalog: Catalog) -> None:
    if parent.key != (key,) or on not in child.origin or key not in parent.origin or on in child.ambiguous:
        raise Refused("a join goes from a foreign key to the one-column key that the parent still has")
    table, name = child.origin[on]
    ptable, pname = parent.origin[key]
    if not catalog.link(table, name, ptable, pname):
        raise Refused(f"{table}.{name} doesn't refer to {ptable}.{pname}")


def directed(j: Join, catalog: Catalog) -> tuple[Known, Known, str, str, bool]:
    """Child and parent, by where the columns come from and not by the side they stand on."""
    left, right = known(j.left, catalog), known(j.right, catalog)
    sides = [j.left_on, j.right_on]
    if sides[0][0] in right.tables and sides[0][0] not in left.tables:
        sides.reverse()
    if sides[0][0] not in left.tables or sides[1][0] not in right.tables:
        raise Refused("each side of ON must name a table of one side")
    a, b = sides[0][1], sides[1][1]
    try:
        _links(left, a, right, b, catalog)
        return left, right, a, b, False
    except Refused:
        _links(right, b, left, a, catalog)
        return right, left, b, a, True


def _alias(j: Join, catalog: Catalog) -> str | None:
    """The parent's alias: columns that the child has too are named alias.column."""
    parent = j.left if directed(j, catalog)[4] else j.right
    return parent.alias if isinstance(parent, Base) else None


def compiled(r, catalog: Catalog, tables: Callable[[str], DataFrame], used: frozenset | None = None) -> DataFrame:
    """The relation's DataFrame.

    A join keeps every child row once (left, whatever keyword was used). If
    nothing above reads a column of the parent, the join is dropped: the
    parent's key is unique, so it adds and loses no row, which Spark can't know.
    """
    known(r, catalog)
    return _frame(r, catalog, tables, used)


def _frame(r, catalog, tables, used):
    match r:
        case Base(table):
            return tables(table).select(*(c.name for c in catalog.tables[table].columns))
        case Join():
            child, parent, on, key, flipped = directed(r, catalog)
            c, p = (r.right, r.left) if flipped else (r.left, r.right)
            name = _alias(r, catalog)
            extra = {x: f"{name}.{x}" if x in child.types else x for x in parent.types if name or x not in child.types}
            if used is not None and not used & set(extra.values()):
                return _frame(c, catalog, tables, used | {on})
            rows = _frame(c, catalog, tables, None if used is None else used | {on})
            others = _frame(p, catalog, tables, None if used is None else used | {key} | {x for x, y in extra.items() if y in used})
            others = others.select(F.col(f"`{key}`").alias("__key"), *(F.col(f"`{x}`").alias(extra[x]) for x in others.columns if x in extra))
            return rows.join(others, rows[on] == others["__key"], "left").drop("__key")
        case Filter(source, where):
            return _frame(source, catalog, tables, None if used is None else used | names(where)).where(column(where))
        case Project(source, outputs):
            return _frame(source, catalog, tables, frozenset().union(*(names(e) for e, _ in outputs))).select(*(column(e).alias(a) for e, a in outputs))
        case Aggregate(source, fn, of, alias, by, param):
            rows = _frame(source, catalog, tables, frozenset(by) | (frozenset() if of == "*" else {of}))
            kind = None if of == "*" else known(source, catalog).types[of]
            return aggregate(rows, fn, of, alias, by, param, kind is None or FAMILY[kind] == "numeric")
        case Fanout(parent, child, on):
            p = known(parent, catalog)
            counts = _frame(child, catalog, tables, frozenset({on})).groupBy(F.col(on).alias("__key")).agg(F.count("*").alias("child_count"))
            rows = _frame(parent, catalog, tables, None)
            return rows.join(counts, rows[p.key[0]] == counts["__key"], "left").drop("__key").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long")))
    raise Refused(f"not a relation: {r!r}")


def aggregate(rows: DataFrame, fn: str, of: str, alias: str, by: tuple[str, ...], param: float | None, numeric: bool) -> DataFrame:
    """One aggregate, by groups or over all rows. Medians and percentiles interpolate numbers; of other values they take the one at that place."""
    c = F.col(of) if of != "*" else F.lit(1)
    place = 0.5 if fn == "MEDIAN" else (param or 0) / 100
    if fn in ("MEDIAN", "PERCENTILE"):
        return (ranks.percentile if numeric else ranks.value_at)(rows, by, of, place, alias)
    if fn == "MODE":
        return ranks.mode(rows, by, of, alias)
    fns = {
        "SUM": lambda: F.sum(c.cast("double")),
        "AVG": lambda: F.avg(c.cast("double")),
        "COUNT": lambda: F.count(c),
        "COUNT_DISTINCT": lambda: F.count_distinct(c),
        "MIN": lambda: F.min(c),
        "MAX": lambda: F.max(c),
        "STDDEV": lambda: F.stddev_samp(c),
        "VARIANCE": lambda: F.var_samp(c),
    }
    return rows.groupBy(*by).agg(fns[fn]().alias(alias))
