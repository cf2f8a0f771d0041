"""Declared tables: types, keys and foreign keys, with checks that list what is wrong."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Declared types by family.
FAMILY = {"INTEGER": "numeric", "FLOAT": "numeric", "DECIMAL": "numeric", "VARCHAR": "string", "TEXT": "string", "UUID": "uuid", "BOOLEAN": "boolean", "DATE": "temporal", "DATETIME": "temporal", "TIMESTAMP": "temporal", "TIME": "temporal"}
SPARK = {"INTEGER": "bigint", "FLOAT": "double", "DECIMAL": "decimal(38,10)", "VARCHAR": "string", "TEXT": "string", "UUID": "string", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "TIME": "string"}
ORDERABLE, KEYS = {"numeric", "string", "temporal"}, {"INTEGER", "VARCHAR", "UUID"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class ForeignKey:
    """A column that refers to a table's key, or to the column `to` of a key of several."""

    table: str
    column: str
    parent: str
    to: str | None = None


@dataclass
class Catalog:
    tables: dict[str, Table]
    links: list[ForeignKey] = field(default_factory=list)

    def errors(self) -> list[str]:
        out = []
        for t in self.tables.values():
            if not re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*", t.name):
                out.append(f"table {t.name} is not in upper snake case")
            if not t.columns:
                out.append(f"table {t.name} has no columns")
            seen = set()
            for c in t.columns:
                if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", c.name):
                    out.append(f"column {t.name}.{c.name} is not in lower snake case")
                if c.type not in FAMILY:
                    out.append(f"column {t.name}.{c.name} has the unknown type {c.type}")
                if c.name in seen:
                    out.append(f"column {t.name}.{c.name} is declared twice")
                seen.add(c.name)
            for k in t.key:
                c = t.column(k)
                if c is None or c.type not in KEYS or c.nullable:
                    out.append(f"key {t.name}.{k} is missing, nullable or of a type that can't be a key")
            for u in t.unique:
                if not u or any(t.column(x) is None for x in u) or len(set(u)) != len(u):
                    out.append(f"unique {t.name}{u} is empty, repeats a column or names a missing one")
        for f in self.links:
            child, parent = self.tables.get(f.table), self.tables.get(f.parent)
            if child is None or parent is None or child.column(f.column) is None:
                out.append(f"foreign key {f.table}.{f.column} to {f.parent} has a missing end")
            elif f.to not in parent.key if f.to is not None else len(parent.key) != 1:
                out.append(f"foreign key {f.table}.{f.column} and the key of {f.parent} don't fit")
            elif parent.column(f.to or parent.key[0]).type != child.column(f.column).type:
                out.append(f"foreign key {f.table}.{f.column} and the key of {f.parent} don't fit")
        return out

    def link(self, child: str, column: str, parent: str, key: str) -> bool:
        p = self.tables.get(parent)
        return p is not None and p.key == (key,) and ForeignKey(child, column, parent) in self.links


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table.lower()}.parquet")


def _table(name: str, key: str, columns: str) -> Table:
    return Table(name, tuple(Column(*c.split(":")) for c in columns.split()), tuple(key.split()))


#: The test tables. lineitem has no key: none of its column sets is promised to be unique.
TESTDATA = Catalog(
    {
        t.name: t
        for t in (
            _table("REGION", "r_regionkey", "r_regionkey:INTEGER r_name:VARCHAR"),
            _table("NATION", "n_nationkey", "n_nationkey:INTEGER n_name:VARCHAR n_regionkey:INTEGER"),
            _table("CUSTOMER", "c_custkey", "c_custkey:INTEGER c_name:VARCHAR c_nationkey:INTEGER c_acctbal:FLOAT c_mktsegment:VARCHAR"),
            _table("SUPPLIER", "s_suppkey", "s_suppkey:INTEGER s_name:VARCHAR s_nationkey:INTEGER s_acctbal:FLOAT"),
            _table("PART", "p_partkey", "p_partkey:INTEGER p_name:VARCHAR p_brand:VARCHAR p_type:VARCHAR p_size:INTEGER p_retailprice:FLOAT"),
            _table("ORDERS", "o_orderkey", "o_orderkey:INTEGER o_custkey:INTEGER o_orderstatus:VARCHAR o_totalprice:FLOAT o_orderdate:TIMESTAMP o_orderpriority:VARCHAR"),
            _table("LINEITEM", "", "l_orderkey:INTEGER l_partkey:INTEGER l_suppkey:INTEGER l_linenumber:INTEGER l_quantity:FLOAT l_extendedprice:FLOAT l_discount:FLOAT l_tax:FLOAT l_returnflag:VARCHAR l_linestatus:VARCHAR l_shipdate:TIMESTAMP"),
            _table("EVENTS", "event_id", "event_id:INTEGER ts:TIMESTAMP user_id:INTEGER event_type:VARCHAR value:FLOAT props:TEXT"),
        )
    },
    [ForeignKey(*x.split()) for x in ("NATION n_regionkey REGION", "CUSTOMER c_nationkey NATION", "SUPPLIER s_nationkey NATION", "ORDERS o_custkey CUSTOMER", "LINEITEM l_orderkey ORDERS", "LINEITEM l_partkey PART", "LINEITEM l_suppkey SUPPLIER")],
)
