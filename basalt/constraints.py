"""Constraint checks and referential actions as DataFrame operations.

Each check is one distributed query that yields the offending rows; only
whether there is one comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.catalog import Catalog, ForeignKey, Table


class ConstraintError(ValueError):
    """Rows that a constraint forbids."""


def null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(f"`{c}`").isNull()
    return rows.filter(bad)


def check_violations(rows: DataFrame, condition: str) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes."""
    return rows.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def unique_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a NULL never collide."""
    keyed = rows
    for c in columns:
        keyed = keyed.filter(F.col(f"`{c}`").isNotNull())
    return keyed.groupBy(*[f"`{c}`" for c in columns]).count().filter("count > 1")


def foreign_key_violations(rows: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Rows whose whole key is given but has no parent."""
    full = rows
    for c in columns:
        full = full.filter(F.col(f"`{c}`").isNotNull())
    keys = parent.select(*[F.col(f"`{p}`").alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & (full[c] == keys[f"_p{i}"])
    return full.join(keys, same, "left_anti")


def referring(rows: DataFrame, parents: DataFrame, fk: ForeignKey) -> DataFrame:
    """The rows of a child whose foreign key names one of the parent rows."""
    keys = parents.select(*[F.col(f"`{p}`").alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(fk.columns):
        same = same & (rows[c] == keys[f"_p{i}"])
    return rows.join(keys, same, "left_semi")


def validate(table: Table, rows: DataFrame, whole: DataFrame, parents: Callable[[str], DataFrame], catalog: Catalog) -> None:
    """Raises ``ConstraintError`` if new ``rows`` break a constraint; ``whole``
    is the table with them."""

    def refuse(found: DataFrame, what: str) -> None:
        if not found.isEmpty():
            raise ConstraintError(f"{what} is violated on table {table.name}")

    required = [c.name for c in table.columns if not c.nullable]
    if required:
        refuse(null_violations(rows, required), "NOT NULL")
    for name, condition in table.checks.items():
        refuse(check_violations(rows, condition), f"CHECK constraint {name}")
    keys = [("primary key", table.primary_key)] if table.primary_key else []
    keys += [("UNIQUE", u) for u in table.unique]
    unique = [(what, columns, None) for what, columns in keys]
    unique += [(f"unique index {i.name}", i.columns, i.where) for i in catalog.indexes_of(table.name) if i.unique]
    for what, columns, where in unique:
        # Only keys among the new rows can have become double.
        new = (rows.filter(where) if where else rows).select(*[f"`{c}`" for c in columns]).distinct()
        refuse(unique_violations((whole.filter(where) if where else whole).join(new, columns, "left_semi"), columns), what)
    for fk in table.foreign_keys:
        refuse(foreign_key_violations(rows, parents(fk.parent), fk.columns, fk.parent_columns), f"foreign key {fk.name}")


def cascade(catalog: Catalog, table: str, gone: DataFrame, snapshot: Callable[[str], DataFrame], key: tuple[str, ...] = ("_w", "_i")):
    """Referential actions of deleting rows ``gone`` of a table, to a fixpoint.

    Returns ``[(table, action, rows, foreign key)]`` with the rows of children
    to delete or to change.  A child's rows already marked are left out of a
    later round, so cycles end.  RESTRICT and NO ACTION raise if a row of a
    child would lose its parent.
    """
    out: list[tuple[str, str, DataFrame, ForeignKey]] = []
    marked: dict[str, DataFrame] = {catalog.key(table): gone.select(*key)}
    todo = [(table, gone)]
    while todo:
        parent, rows = todo.pop(0)
        for child, fk in catalog.children(parent):
            hit = referring(snapshot(child.name), rows, fk)
            if (seen := marked.get(catalog.key(child.name))) is not None:
                hit = hit.join(seen, list(key), "left_anti")
            if hit.isEmpty():
                continue
            if fk.on_delete in ("RESTRICT", "NO ACTION"):
                raise ConstraintError(f"foreign key {fk.name} of table {child.name} forbids the delete")
            out.append((child.name, fk.on_delete, hit, fk))
            if fk.on_delete == "CASCADE":
                keyed = hit.select(*key)
                marked[catalog.key(child.name)] = keyed if seen is None else seen.unionByName(keyed)
                todo.append((child.name, hit))
    return out
