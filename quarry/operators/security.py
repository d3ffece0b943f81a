"""Rows by tenant over every table, from one table of policies.

A policy says how a table's rows belong to a tenant: by a column of its own, or by a parent's row that they name. A tenant's view of a
table is a filter or a chain of semi-joins up to the table that has the column; erasing a tenant takes out what such a chain reaches, in
every table. A table without a policy is not shown.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Policy(NamedTuple):
    """Rows of `table` belong to the tenant in `column`, or, with a parent, to that of the parent's row whose `parent_key` is in `column`."""

    table: str
    column: str
    parent: str | None = None
    parent_key: str | None = None


class Secured:
    """Tables with their policies. Public tables are shown whole to everyone."""

    def __init__(self, tables: dict[str, DataFrame], policies: list[Policy], public: tuple[str, ...] = ()):
        self.tables, self.public = tables, public
        self.policies = {p.table: p for p in policies}
        for p in policies:
            seen = {p.table}
            while p.parent:
                if p.parent not in self.policies or p.parent in seen:
                    raise ValueError(f"no owner at the end of {sorted(seen)}")
                seen.add(p.parent)
                p = self.policies[p.parent]

    def view(self, name: str, org: int | str) -> DataFrame:
        """A tenant's rows. Rows without an owner are nobody's."""
        if name in self.public:
            return self.tables[name]
        if name not in self.policies:
            raise PermissionError(f"{name} has no policy")
        p = self.policies[name]
        if p.parent is None:
            return self.tables[name].where(F.col(p.column) == F.lit(org))
        keys = self.view(p.parent, org).select(F.col(p.parent_key).alias(p.column)).distinct()
        return self.tables[name].join(keys, p.column, "left_semi").select(*self.tables[name].columns)

    def register(self, spark: SparkSession, org: int | str, prefix: str = "") -> None:
        """Temporary views of all shown tables, so that SQL sees a tenant's rows alone."""
        for name in [*self.policies, *self.public]:
            self.view(name, org).createOrReplaceTempView(prefix + name)

    def erased(self, org: int | str) -> dict[str, DataFrame]:
        """All tables without a tenant's rows: children go with their parents."""
        out = {}
        for name, table in self.tables.items():
            p = self.policies.get(name)
            if p is None:
                out[name] = table
            elif p.parent is None:
                out[name] = table.where(~F.col(p.column).eqNullSafe(F.lit(org)))
            else:
                keys = self.view(p.parent, org).select(F.col(p.parent_key).alias(p.column)).distinct()
                out[name] = table.join(keys, p.column, "left_anti").select(*table.columns)
        return out
