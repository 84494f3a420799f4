"""Tenant-scoped reads and row changes as DataFrame transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TenantScope:
    """A table as one tenant sees it: its own rows (and public ones, if asked for) that aren't deleted."""

    def __init__(self, df: DataFrame, tenant_id: int, include_public: bool = False, key: str = "tenant_id"):
        own = F.col(key) == tenant_id
        df = df.filter(own | F.col(key).isNull() if include_public else own)
        self.df, self.tenant_id, self.key = (df.filter(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df), tenant_id, key

    def where(self, **equal) -> TenantScope:
        """Equality filters; None means no filter, and unknown columns are ignored."""
        out = TenantScope.__new__(TenantScope)
        out.df = reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None and k in self.df.columns), self.df)
        out.tenant_id, out.key = self.tenant_id, self.key
        return out

    def where_set(self, **equal) -> TenantScope:
        """Equality filters of which empty text and 0 also mean no filter."""
        return self.where(**{k: v or None for k, v in equal.items()})

    def page(self, page: int, size: int, *order: Column | str, most: int = 200, keep_total: bool = False) -> DataFrame:
        """A page of rows with `total`, the number of rows on all pages. `order` ends in a unique column. keep_total: a page past the end is one row of nulls with the total, and not empty."""
        if page < 1 or not 1 <= size <= most:
            raise ValueError(f"page from 1 and size from 1 to {most}")
        rows = self.df.orderBy(*order).offset((page - 1) * size).limit(size)
        total = self.df.agg(F.count("*").alias("total"))  # one row
        return total.join(rows, F.lit(True), "left" if keep_total else "inner").select(*self.df.columns, "total")

    def get(self, key: str, value) -> DataFrame:
        return self.df.filter(F.col(key) == value).limit(1)

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))


def patched(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the values of changes that aren't null; a change can't set null, and one without a row does nothing."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key and c in old.columns])
    joined = old.join(new, old[key] == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns and c != key else F.col(c) for c in old.columns])


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of either, those of new where both have a key. Rows without a key are all kept; of new ones with the same key any one is."""
    keyed = new.filter(F.col(key).isNotNull()).dropDuplicates([key])
    kept = old.join(keyed.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(keyed).unionByName(new.filter(F.col(key).isNull()))


def appended_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key old lacks; of new ones with the same key any one is, and those without a key all are."""
    fresh = new.join(old.select(key), key, "left_anti").select(*old.columns)
    return old.unionByName(fresh.filter(F.col(key).isNotNull()).dropDuplicates([key])).unionByName(fresh.filter(F.col(key).isNull()))


def created(df: DataFrame, tenant_id: int) -> DataFrame:
    """New rows with the tenant's id where they have none."""
    return df.withColumn("tenant_id", F.coalesce(F.col("tenant_id"), F.lit(tenant_id)))


def soft_deleted(df: DataFrame, which: Column, at: Column) -> DataFrame:
    """df with deleted_at set in some rows; without such a column these rows go."""
    return df.withColumn("deleted_at", F.when(which, at).otherwise(F.col("deleted_at"))) if "deleted_at" in df.columns else df.filter(~which)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without any row of the keys that new has, and all of new: reprocessing a document twice gives what once does."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
