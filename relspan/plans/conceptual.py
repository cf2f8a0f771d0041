"""Conceptual models: entities, relationships and dependencies, what is wrong with them, and the catalog they map to."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.plans.catalog import KEYS, Catalog, Column, ForeignKey, Table
from relspan.plans.relation import Refused


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "VARCHAR"
    nullable: bool = False
    multivalued: bool = False
    derived: bool = False


@dataclass(frozen=True)
class Entity:
    """owner: the entity that a weak one is identified through."""

    name: str
    attributes: tuple[Attribute, ...] = ()
    identifier: tuple[str, ...] = ()
    owner: str | None = None


@dataclass(frozen=True)
class Participant:
    """least: 0 if an instance may stay outside the relationship, else 1. most: 1 on the side that occurs once, None on the one that repeats."""

    entity: str
    role: str | None = None
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Relationship:
    name: str
    participants: tuple[Participant, ...]
    kind: str  # 1:1, 1:N, M:N; with more than two participants always M:N
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class Dependency:
    """(entity, attribute) of both sides."""

    given: tuple[tuple[str, str], ...]
    then: tuple[tuple[str, str], ...]


@dataclass
class Model:
    entities: list[Entity]
    relationships: list[Relationship] = field(default_factory=list)
    dependencies: list[Dependency] = field(default_factory=list)


#: What may occur at most once among two participants, by kind.
_ONCE = {"1:1": 2, "1:N": 1, "M:N": 0}


def faults(m: Model) -> list[str]:
    """Repeated names, unknown entities and owners, and cardinalities that don't fit the kind of a relationship."""
    out = [f"entity {n} is declared {k} times" for n, k in Counter(e.name.lower() for e in m.entities).items() if k > 1]
    names = {e.name.lower() for e in m.entities}
    for e in m.entities:
        out += [f"attribute {e.name}.{n} is declared {k} times" for n, k in Counter(a.name.lower() for a in e.attributes).items() if k > 1]
        own = {a.name.lower() for a in e.attributes}
        out += [f"identifier {e.name}.{i} is no attribute" for i in e.identifier if i.lower() not in own]
        if e.owner is not None and e.owner.lower() not in names:
            out.append(f"owner {e.owner} of {e.name} is unknown")
    for r in m.relationships:
        out += [f"{r.name} names the unknown entity {p.entity}" for p in r.participants if p.entity.lower() not in names]
        out += [f"{r.name}: most of {p.entity} is {p.most}, neither 1 nor open" for p in r.participants if p.most not in (1, None)]
        out += [f"{r.name}: least of {p.entity} is {p.least}, neither 0 nor 1" for p in r.participants if p.least not in (0, 1, None)]
        if len(r.participants) < 2:
            out.append(f"{r.name} has fewer than two participants")
        elif r.kind not in _ONCE:
            out.append(f"{r.name} has the unknown kind {r.kind}")
        elif len(r.participants) == 2 and sum(p.most == 1 for p in r.participants) != _ONCE[r.kind]:
            out.append(f"{r.name} is {r.kind}, but {sum(p.most == 1 for p in r.participants)} of its sides occur once")
    return out


def snake(name: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"[^a-z0-9]+", "_", words.lower()).strip("_") or "x"


def _free(name: str, taken) -> str:
    """The name, with the least number from 2 on behind it if it is taken."""
    if name not in taken:
        return name
    return next(f"{name}_{i}" for i in range(2, len(taken) + 3) if f"{name}_{i}" not in taken)


@dataclass
class _Draft:
    model: Model
    tables: dict[str, Table] = field(default_factory=dict)
    links: list[ForeignKey] = field(default_factory=list)

    def refer(self, child: str, parent: str, prefix: str, nullable: bool) -> list[Column]:
        """Columns of a child for the parent's key, with their links; an owner of several key columns lends each."""
        p, out = self.tables[parent], []
        taken = {c.name for c in self.tables[child].columns} if child in self.tables else set()
        for k in p.key:
            name = _free(f"{prefix}{k}", taken | {c.name for c in out})
            out.append(Column(name, p.column(k).type, nullable))
            self.links.append(ForeignKey(child, name, parent, None if len(p.key) == 1 else k))
        return out

    def add(self, child: str, columns: list[Column], key: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> None:
        t = self.tables.get(child) or Table(child, ())
        self.tables[child] = replace(t, columns=(*t.columns, *columns), key=t.key + key, unique=t.unique + unique)


def key_of(e: Entity, m: Model) -> tuple[str, ...]:
    """The key of an entity: its identifier, else what its other attributes depend on, if those can be keys; else none, for a surrogate.

    A name that another entity has as an ordinary attribute is no key: it would
    make every such column look like a reference.
    """
    kinds = {snake(a.name): a for a in e.attributes if not a.multivalued and not a.derived}
    others = {snake(a.name) for o in m.entities if o.name.lower() != e.name.lower() for a in o.attributes}

    def able(names: tuple[str, ...]) -> bool:
        return bool(names) and all(n in kinds and kinds[n].type in KEYS and not kinds[n].nullable and n not in others for n in names)

    declared = tuple(snake(i) for i in e.identifier)
    if able(declared):
        return declared
    for d in m.dependencies:
        if {x.lower() for x, _ in (*d.given, *d.then)} == {e.name.lower()}:
            given, then = (tuple(snake(a) for _, a in side) for side in (d.given, d.then))
            if able(given) and set(given) | set(then) >= set(kinds):
                return given
    return ()


def _noun(name: str) -> bool:
    """Whether a relationship's name can name a table: one word that is neither a plural nor looks like a verb's form."""
    return bool(re.fullmatch(r"[A-Za-z]+", name)) and not name.lower().endswith(("s", "ed", "ing"))


def mapped(m: Model) -> Catalog:
    """The relational catalog of a model, or Refused with its faults.

    Each entity becomes a table; derived attributes go. A weak entity's key ends
    with its owner's key, each attribute of many values becomes a table, and so
    does each relationship of many with many, keyed by all it refers to. One to
    many puts the one side's key into the other, nullable if that may stay
    outside; one to one puts it, unique, into the mandatory side, or the one
    whose name comes last.
    """
    wrong = faults(m)
    if wrong:
        raise Refused("; ".join(wrong))
    d, entities = _Draft(m), {e.name.lower(): e for e in m.entities}
    table = {n: snake(e.name).upper() for n, e in entities.items()}
    if len(set(table.values())) != len(table):
        raise Refused("two entities map to one table")
    todo, done = list(entities), set()
    while todo:
        ready = [n for n in todo if entities[n].owner is None or entities[n].owner.lower() in done]
        if not ready:
            raise Refused(f"weak entities own each other: {', '.join(sorted(todo))}")
        for n in ready:
            e, name = entities[n], table[n]
            plain = [a for a in e.attributes if not a.multivalued and not a.derived]
            columns, key = [Column(snake(a.name), a.type, a.nullable) for a in plain], key_of(e, m)
            if not key:
                key = (_free(f"{snake(e.name)}_id", {c.name for c in columns}),)
                columns.insert(0, Column(key[0], "INTEGER"))
            d.add(name, columns, key)
            if e.owner is not None:
                more = d.refer(name, table[e.owner.lower()], "", False)
                d.add(name, more, tuple(c.name for c in more))
        todo, done = [n for n in todo if n not in ready], done | set(ready)
    for n, e in entities.items():
        for a in e.attributes:
            if a.multivalued and not a.derived:
                name, value = _free(f"{table[n]}_{snake(a.name).upper()}", d.tables), snake(a.name)
                own = [Column(value, a.type, a.nullable)]
                key = (value,)
                if a.type not in KEYS or a.nullable:
                    key = (f"{value}_id",)
                    own.insert(0, Column(key[0], "INTEGER"))
                d.add(name, own, key)
                more = d.refer(name, table[n], "", False)
                d.add(name, more, tuple(c.name for c in more))
    for r in m.relationships:
        _relate(r, d, table)
    out = Catalog(d.tables, list(dict.fromkeys(d.links)))
    left = out.errors()
    if left:
        raise Refused("; ".join(left))
    return out


def _relate(r: Relationship, d: _Draft, table: dict[str, str]) -> None:
    more = [Column(snake(a.name), a.type, a.nullable) for a in r.attributes if not a.derived and not a.multivalued]
    sides = [(p, table[p.entity.lower()]) for p in r.participants]
    if r.kind == "M:N" or len(sides) > 2:
        name = snake(r.name).upper() if _noun(r.name) else "_".join(dict.fromkeys(t for _, t in sides))
        name = _free(name, d.tables)
        d.add(name, [])
        often = Counter(t for _, t in sides)
        for i, (p, t) in enumerate(sides):
            prefix = f"{snake(p.role)}_" if p.role else f"{snake(p.entity)}{i + 1}_" if often[t] > 1 else ""
            columns = d.refer(name, t, prefix, False)
            d.add(name, columns, tuple(c.name for c in columns))
        _own(d, name, more)
        return
    (p, a), (q, b) = sides
    if r.kind == "1:N":
        (child, to), (one, parent) = ((p, a), (q, b)) if p.most != 1 else ((q, b), (p, a))
    elif (p.least == 1) != (q.least == 1):
        (child, to), (one, parent) = ((p, a), (q, b)) if p.least == 1 else ((q, b), (p, a))
    else:
        (child, to), (one, parent) = ((p, a), (q, b)) if p.entity > q.entity else ((q, b), (p, a))
    prefix = f"{snake(one.role)}_" if one.role else f"{snake(r.name)}_" if to == parent else ""
    columns = d.refer(to, parent, prefix, child.least == 0)
    d.add(to, columns, (), (tuple(c.name for c in columns),) if r.kind == "1:1" else ())
    _own(d, to, more)


def _own(d: _Draft, name: str, columns: list[Column]) -> None:
    for c in columns:
        d.add(name, [replace(c, name=_free(c.name, {x.name for x in d.tables[name].columns}))])


def review(m: Model, cited: dict[str, set[str]], facts: set[str], warned: Counter) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a model. cited: facts by entity or relationship.

    Errors are faults() and facts that nothing cites. An attribute that looks
    like a reference to another entity (its name and _id) is a warning, given at
    most twice over all reviews that share `warned`.
    """
    errors, warnings = faults(m), []
    left = facts - set().union(*cited.values())
    if left:
        errors.append(f"nothing cites {', '.join(sorted(left))}")
    names = {snake(e.name) for e in m.entities}
    for e in m.entities:
        for a in e.attributes:
            other = re.sub(r"_(id|code|no|number)$", "", snake(a.name))
            where = f"{e.name}.{a.name}"
            if other != snake(a.name) and other in names - {snake(e.name)} and warned[where] < 2:
                warned[where] += 1
                warnings.append(f"{where} looks like a reference to {other}: state a relationship")
    return errors, warnings


def rendered(c: Catalog) -> str:
    """A catalog as text, a line a table and an indented line a column, in order of names of tables."""
    out, to = [], {(f.table, f.column): f"{f.parent}.{f.to or (c.tables[f.parent].key or ('?',))[0]}" for f in c.links}
    for t in sorted(c.tables.values(), key=lambda t: t.name):
        out.append(f"{t.name} (key: {', '.join(t.key) or 'none'})")
        for x in t.columns:
            more = [x.type, *(["nullable"] if x.nullable else []), *([f"refers to {to[t.name, x.name]}"] if (t.name, x.name) in to else [])]
            out.append(f"  {x.name}: {', '.join(more)}")
        out += [f"  unique: {', '.join(u)}" for u in t.unique]
    return "\n".join(out)


def spread(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """The rows of the table that an attribute of many values becomes: the owner's key and each different value; nulls go."""
    return rows.select(*key, F.explode(F.array_distinct(column)).alias(column)).where(F.col(column).isNotNull())


def listed(c: Catalog) -> list[tuple[str, str, str, bool, bool, str | None]]:
    """(table, column, type, nullable, in the key, table that it refers to) of every column."""
    to = {(f.table, f.column): f.parent for f in c.links}
    return [(t.name, x.name, x.type, x.nullable, x.name in t.key, to.get((t.name, x.name))) for t in c.tables.values() for x in t.columns]
