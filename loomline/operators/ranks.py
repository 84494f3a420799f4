"""Ranks of all rows of a table, and pages at any depth, without a task that sees them all.

Rows are dealt to ranges of the order and sorted within each. A row's place in its
range is kept with it; the ranges' sizes, a number each, give what stands before
each range. A page reads the files of the ranges that it lies in and no others.

Defined results: nulls stand where the order puts them; rows that are equal in
all columns of the order have ranks in no certain order (so let it end in a unique
column), and lie in one range; a page past the end is empty; columns of the table
may have any names, except that one called like the rank is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: monotonically_increasing_id has the partition above this bit and the row's place in it below.
_BITS = 33


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Ranked:
    """df in an order, written once: `rows` has all of it with its rank from 1, `page` a page, `total` how many rows there are."""

    def __init__(self, df: DataFrame, *order: Column | str, name: str = "rank"):
        if not order:
            raise ValueError("an order is needed")
        df = df.drop(name)
        self.columns, self.name = df.columns, name
        self.part, self.at = _free(df, "part"), _free(df, "at")
        place = F.monotonically_increasing_id()
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(self.at, place)
        dealt = dealt.withColumn(self.part, F.shiftright(self.at, _BITS).cast("int")).withColumn(self.at, F.col(self.at).bitwiseAND(F.lit((1 << _BITS) - 1)))
        self.table = saved(dealt, "ranked", self.part)
        sizes = {r[0]: r[1] for r in self.table.groupBy(self.part).count().collect()}  # a row a range
        self.parts = sorted(sizes)
        self.ends = list(accumulate(sizes[p] for p in self.parts))
        self.total = self.ends[-1] if self.ends else 0

    def _with_rank(self, parts: list[int]) -> DataFrame:
        spark = self.table.sparkSession
        starts = [(p, self.ends[i] - self._size(i)) for i, p in enumerate(self.parts) if p in set(parts)]
        before, p = _free(self.table, "before"), _free(self.table, "of_part")
        known = spark.createDataFrame(starts, f"{p} int, {before} long")
        # A filter on the folders' column, so that files of other ranges aren't listed; the ranges' starts are as many rows as there are ranges.
        rows = self.table if len(parts) == len(self.parts) else self.table.filter(F.col(self.part).isin(parts))
        return rows.join(F.broadcast(known), F.col(self.part) == F.col(p)).withColumn(self.name, F.col(before) + F.col(self.at) + 1).select(*self.columns, self.name)

    def _size(self, i: int) -> int:
        return self.ends[i] - (self.ends[i - 1] if i else 0)

    @property
    def rows(self) -> DataFrame:
        return self._with_rank(self.parts)

    def page(self, page: int, size: int) -> DataFrame:
        """Rows (page - 1) * size + 1 to page * size of the order."""
        if page < 1 or size < 1:
            raise ValueError("page and size from 1")
        first, last = (page - 1) * size, min(page * size, self.total)
        parts = self.parts[bisect_right(self.ends, first) : bisect_right(self.ends, last - 1) + 1] if first < last else []
        rows = self._with_rank(parts) if parts else self.rows.limit(0)
        return rows.filter(F.col(self.name).between(first + 1, last))
