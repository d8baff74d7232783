"""Tables, columns, constraints and indexes of a database."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    default: str | None = None  # Spark SQL text
    serial: bool = False


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    include: list[str] = field(default_factory=list)
    where: str | None = None

    def covers(self, columns: set[str]) -> bool:
        return columns <= {*self.columns, *self.include}


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)  # name -> Spark SQL text
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"table {self.name} has no column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


class Catalog:
    """Names are case-insensitive; a schema prefix ``public.`` is dropped."""

    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}

    @staticmethod
    def key(name: str) -> str:
        return name.lower().removeprefix("public.")

    def add(self, table: Table) -> None:
        if self.key(table.name) in self.tables:
            raise ValueError(f"table {table.name} already exists")
        self.tables[self.key(table.name)] = table

    def get(self, name: str) -> Table:
        if self.key(name) not in self.tables:
            raise KeyError(f"table {name} does not exist")
        return self.tables[self.key(name)]

    def drop(self, name: str) -> None:
        self.get(name)
        for other in self.tables.values():
            if self.key(other.name) != self.key(name) and any(self.key(fk.parent) == self.key(name) for fk in other.foreign_keys):
                raise ValueError(f"table {other.name} refers to {name}")
        del self.tables[self.key(name)]
        self.indexes = {k: i for k, i in self.indexes.items() if self.key(i.table) != self.key(name)}

    def indexes_of(self, table: str) -> list[Index]:
        return [i for i in self.indexes.values() if self.key(i.table) == self.key(table)]

    def children(self, table: str) -> list[tuple[Table, ForeignKey]]:
        return [(t, fk) for t in self.tables.values() for fk in t.foreign_keys if self.key(fk.parent) == self.key(table)]
