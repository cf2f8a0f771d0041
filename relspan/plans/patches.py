"""Changes to a catalog and the same changes to DataFrames.

A patch is a dictionary with "action" and what it names. apply() changes a copy
of the catalog and returns it with what was refused; tables() gives the rows.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.plans.catalog import SPARK, Catalog, Column, ForeignKey, Table

ACTIONS = ["add_column", "rename_column", "delete_column", "change_type", "add_table", "merge_tables", "delete_table", "rename_table", "add_link", "delete_link", "set_key", "upsert_unique", "delete_unique"]


class Refused(ValueError):
    """A patch names what is not there, or what is there already."""


def snake(name: str) -> str:
    """Words of a name in lower case, joined by underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name))).strip("_").lower()


def normalised(c: Catalog) -> Catalog:
    """Tables in upper, columns in lower snake case; repeated columns go, the first stays; links follow."""
    out = {}
    for t in c.tables.values():
        columns = {snake(x.name): replace(x, name=snake(x.name)) for x in reversed(t.columns)}
        order = dict.fromkeys(snake(x.name) for x in t.columns)
        out[snake(t.name).upper()] = Table(snake(t.name).upper(), tuple(columns[n] for n in order), tuple(dict.fromkeys(map(snake, t.key))), scrubbed([tuple(map(snake, u)) for u in t.unique], set(order)))
    links = [ForeignKey(snake(f.table).upper(), snake(f.column), snake(f.parent).upper()) for f in c.links]
    for t in out.values():
        far = {f.column for f in links if f.table == t.name}
        if len(far) > 1:  # a junction: rows of one parent repeat
            out[t.name] = replace(t, unique=tuple(u for u in t.unique if len(u) > 1 or u[0] not in far))
    return Catalog(out, links)


def scrubbed(unique: list[tuple[str, ...]], columns: set[str]) -> tuple[tuple[str, ...], ...]:
    """Uniqueness constraints without those that name missing columns, each set of columns once."""
    out: dict[frozenset, tuple[str, ...]] = {}
    for u in unique:
        if u and set(u) <= columns:
            out.setdefault(frozenset(u), tuple(dict.fromkeys(u)))
    return tuple(out.values())


def wired(c: Catalog) -> Catalog:
    """Links added for columns `x_id` without one, to table X, or to the one table whose only key column has the column's name."""
    linked, links = {(f.table, f.column) for f in c.links}, list(c.links)
    keys: dict[str, list[str]] = {}
    for t in c.tables.values():
        if len(t.key) == 1:
            keys.setdefault(t.key[0], []).append(t.name)
    for t in c.tables.values():
        for x in t.columns:
            if (t.name, x.name) in linked or t.key == (x.name,) or not x.name.endswith("_id"):
                continue
            named = x.name[:-3].upper()
            parents = [named] if named in c.tables and len(c.tables[named].key) == 1 else keys.get(x.name, [])
            if len(parents) == 1 and parents[0] != t.name:
                links.append(ForeignKey(t.name, x.name, parents[0]))
    return Catalog(dict(c.tables), links)


def aligned(c: Catalog) -> Catalog:
    """Link columns take the type of the key that they refer to, parents before children; a circle of links ends where it began."""
    c = Catalog(dict(c.tables), list(c.links))
    for _ in c.tables:
        for f in c.links:
            parent, child = c.tables.get(f.parent), c.tables.get(f.table)
            if parent and child and len(parent.key) == 1 and child.column(f.column) and parent.column(parent.key[0]):
                c.tables[f.table] = _edit(child, f.column, type=parent.column(parent.key[0]).type)
    return c


def _edit(t: Table, column: str, **change) -> Table:
    return replace(t, columns=tuple(replace(x, **change) if x.name == column else x for x in t.columns))


def _need(c: Catalog, table: str, column: str | None = None) -> Table:
    if table not in c.tables:
        raise Refused(f"no table {table}")
    if column is not None and c.tables[table].column(column) is None:
        raise Refused(f"no column {table}.{column}")
    return c.tables[table]


def _tidy(c: Catalog) -> Catalog:
    """Without links that have a missing end, each once, in order."""
    ok = {f for f in c.links if f.table in c.tables and f.parent in c.tables and c.tables[f.table].column(f.column)}
    return Catalog(c.tables, sorted(ok, key=lambda f: (f.table, f.column, f.parent)))


def _one(c: Catalog, p: dict) -> Catalog:
    tables, links, do, name = dict(c.tables), list(c.links), p["action"], p.get("table")
    if do == "add_table":
        if name in tables:
            raise Refused(f"table {name} exists")
        tables[name] = Table(name, tuple(Column(*x) for x in p["columns"]), tuple(p.get("key", ())), tuple(map(tuple, p.get("unique", ()))))
    elif do == "delete_table":
        _need(c, name)
        del tables[name]
    elif do in ("rename_table", "merge_tables"):
        old, to = _need(c, name), p["to"]
        if do == "rename_table" and to in tables:
            raise Refused(f"table {to} exists")
        if do == "merge_tables":
            kept = _need(c, to)
            if to == name:
                raise Refused(f"table {to} into itself")
            columns = kept.columns + tuple(x if x.name in kept.key else replace(x, nullable=True) for x in old.columns if kept.column(x.name) is None)
            tables[to] = replace(kept, columns=columns, unique=scrubbed([*kept.unique, *old.unique], {x.name for x in columns}))
        else:
            tables[to] = replace(old, name=to)
        del tables[name]
        links = [ForeignKey(to if f.table == name else f.table, f.column, to if f.parent == name else f.parent) for f in links]
        links = [f for f in links if do == "rename_table" or f.table != f.parent or f in c.links]
    elif do == "add_column":
        t = _need(c, name)
        if t.column(p["column"]):
            raise Refused(f"column {name}.{p['column']} exists")
        tables[name] = replace(t, columns=(*t.columns, Column(p["column"], p["type"], p.get("nullable", True))))
    elif do == "rename_column":
        t, old, to = _need(c, name, p["column"]), p["column"], p["to"]
        if t.column(to):
            raise Refused(f"column {name}.{to} exists")
        tables[name] = replace(_edit(t, old, name=to), key=tuple(to if k == old else k for k in t.key), unique=tuple(tuple(to if k == old else k for k in u) for u in t.unique))
        links = [replace(f, column=to) if (f.table, f.column) == (name, old) else f for f in links]
    elif do == "delete_column":
        t = _need(c, name, p["column"])
        tables[name] = replace(t, columns=tuple(x for x in t.columns if x.name != p["column"]), key=tuple(k for k in t.key if k != p["column"]), unique=tuple(u for u in t.unique if p["column"] not in u))
    elif do == "change_type":
        if p["type"] not in SPARK:
            raise Refused(f"no type {p['type']}")
        tables[name] = _edit(_need(c, name, p["column"]), p["column"], type=p["type"])
    elif do == "add_link":
        t, parent = _need(c, name), _need(c, p["parent"])
        if len(parent.key) != 1:
            raise Refused(f"table {parent.name} has no key of one column")
        if t.column(p["column"]) is None:
            tables[name] = replace(t, columns=(*t.columns, Column(p["column"], parent.column(parent.key[0]).type, True)))
        links.append(ForeignKey(name, p["column"], parent.name))
    elif do == "delete_link":
        left = [f for f in links if (f.table, f.column) != (name, p["column"])]
        if len(left) == len(links):
            raise Refused(f"no link of {name}.{p['column']}")
        links = left
    elif do == "set_key":
        t = _need(c, name)
        for k in p["key"]:
            _need(c, name, k)
        tables[name] = replace(t, key=tuple(p["key"]), columns=tuple(replace(x, nullable=False) if x.name in p["key"] else x for x in t.columns))
    elif do in ("upsert_unique", "delete_unique"):
        t, over = _need(c, name), tuple(p["columns"])
        for k in over:
            _need(c, name, k)
        rest = tuple(u for u in t.unique if set(u) != set(over))
        if do == "delete_unique" and len(rest) == len(t.unique) or not over:
            raise Refused(f"no unique {name}{over}")
        tables[name] = replace(t, unique=rest if do == "delete_unique" else (*rest, over))
    else:
        raise Refused(f"no action {do}")
    return _tidy(Catalog(tables, links))


def apply(c: Catalog, patches: list[dict]) -> tuple[Catalog, list[str]]:
    """The catalog after the patches, in order, and why some were refused; a refused patch changes nothing."""
    refused = []
    for p in patches:
        try:
            c = _one(c, p)
        except Refused as e:
            refused.append(f"{p['action']}: {e}")
    return wired(c), refused


def tables(rows: dict[str, DataFrame], c: Catalog, p: dict) -> dict[str, DataFrame]:
    """The rows after a patch that apply() takes; links and keys leave rows as they are, but for a new column."""
    after, out, do, name = _one(c, p), dict(rows), p["action"], p.get("table")
    if do == "delete_table":
        del out[name]
    elif do == "rename_table":
        out[p["to"]] = out.pop(name)
    elif do == "merge_tables":
        kept, gone = c.tables[p["to"]], c.tables[name]
        more = [x.name for x in gone.columns if kept.column(x.name) is None]
        if not kept.key or len(kept.key) != len(gone.key):
            raise Refused(f"the keys of {name} and {p['to']} do not fit")
        gone_keys = dict(zip(kept.key, gone.key, strict=True))
        side = out.pop(name).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(gone.key)), *(F.col(x.name).alias(f"_s_{x.name}") for x in gone.columns if x.name not in gone.key))
        base = out[p["to"]]
        met = base.join(side, [base[k] == side[f"_k{i}"] for i, k in enumerate(kept.key)], "full")
        shared = {x.name for x in gone.columns if kept.column(x.name) is not None and x.name not in gone.key}
        place = {k: i for i, k in enumerate(gone_keys)}
        # rows that only the merged table has keep their keys and what they say of the kept table's columns
        only = F.coalesce(*(base[k] for k in kept.key)).isNull()
        value = lambda x: F.coalesce(base[x], F.col(f"_k{place[x]}")) if x in place else F.when(only, F.col(f"_s_{x}").cast(base.schema[x].dataType)).otherwise(base[x]) if x in shared else base[x]
        out[p["to"]] = met.select(*(value(x).alias(x) for x in base.columns), *(F.col(f"_k{gone.key.index(m)}" if m in gone.key else f"_s_{m}").alias(m) for m in more))
    elif do == "rename_column":
        out[name] = out[name].withColumnRenamed(p["column"], p["to"])
    elif do == "delete_column":
        out[name] = out[name].drop(p["column"])
    elif do == "change_type":
        out[name] = out[name].withColumn(p["column"], F.col(p["column"]).try_cast(SPARK[p["type"]]))
    elif do in ("add_column", "add_link") and p["column"] not in out[name].columns:
        out[name] = out[name].withColumn(p["column"], F.lit(None).cast(SPARK[after.tables[name].column(p["column"]).type]))
    return out
