"""Purging tenants: a walk over the foreign keys from parents to children, with semi-joins and no row on the driver."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Days that softly deleted rows stay.
RETENTION = 90


class Purge:
    """tables: name -> DataFrame with the key `keys` names and deleted_at; links: (child, column, parent), where column holds the parent's key; kept: tables whose rows stay as they are, whatever they belong to."""

    def __init__(self, tables: dict[str, DataFrame], keys: dict[str, str], links: list[tuple[str, str, str]], kept: set[str]):
        unknown = {n for c, _, p in links for n in (c, p)} - set(tables)
        if unknown:
            raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
        self.tables, self.keys, self.links, self.kept = tables, keys, links, kept
        parents: dict[str, set[str]] = {n: set() for n in tables}
        for child, _, parent in links:
            if child != parent:
                parents[child].add(parent)
        try:
            self.order = list(TopologicalSorter(parents).static_order())
        except CycleError as e:
            raise ValueError(f"tables depend on each other: {' -> '.join(e.args[1])}") from e

    def marked(self, roots: dict[str, Column]) -> dict[str, DataFrame]:
        """Keys of the rows that go, by table: those of roots that a condition holds for, and whatever links to such a row, through rows of kept tables too."""
        out: dict[str, DataFrame] = {}
        for name in self.order:
            df, key = self.tables[name], self.keys[name]
            found = df.filter(roots[name]).select(key) if name in roots else df.select(key).limit(0)
            for child, column, parent in self.links:
                if child == name and parent != name:
                    found = found.unionByName(df.join(out[parent].select(F.col(self.keys[parent]).alias("_gone")), F.col(column) == F.col("_gone"), "left_semi").select(key))
            found = cut(found.distinct())
            own = [column for child, column, parent in self.links if child == parent == name]
            fresh = found
            while own and not fresh.isEmpty():  # rows that link to rows of their own table: a round a generation
                gone = fresh.select(F.col(key).alias("_gone"))
                new = df.select(key).limit(0)
                for column in own:
                    new = new.unionByName(df.join(gone, F.col(column) == F.col("_gone"), "left_semi").select(key))
                fresh = cut(new.distinct().join(found, key, "left_anti"))
                found = cut(found.unionByName(fresh))
            out[name] = found
        return out

    def run(self, roots: dict[str, Column], at: Column, days: int = RETENTION) -> dict[str, DataFrame]:
        """Tables after the purge: marked rows have deleted_at (the time they had, or else `at`), and any row deleted over `days` days before `at` is gone. Kept tables are unchanged."""
        marked, out = self.marked(roots), {}
        for name, df in self.tables.items():
            if name in self.kept:
                out[name] = df
                continue
            key = self.keys[name]
            left = df.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= at - F.expr(f"interval {int(days)} days")))
            flagged = left.join(marked[name].select(F.col(key).alias("_gone"), F.lit(True).alias("_hit")), F.col(key) == F.col("_gone"), "left")
            soft = F.when(F.col("_hit"), F.coalesce(F.col("deleted_at"), at)).otherwise(F.col("deleted_at"))
            out[name] = flagged.withColumn("deleted_at", soft).select(*df.columns)
        return out

    def counts(self, after: dict[str, DataFrame]) -> DataFrame:
        """name, rows before, live rows (deleted_at is null) after, and rows after; one small row a table."""
        rows = None
        for name, df in self.tables.items():
            live = F.count_if(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else F.count("*")
            both = df.agg(F.count("*").alias("before")).crossJoin(after[name].agg(live.alias("live"), F.count("*").alias("after")))  # one row each
            both = both.select(F.lit(name).alias("name"), "before", "live", "after")
            rows = both if rows is None else rows.unionByName(both)
        return rows
