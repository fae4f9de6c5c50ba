"""Lookups, as-of and nearest joins, overlays and set operations (JON-01..21, SET-01..06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """JON-05/06: to each left row the columns of the last right row at or before its time.

    Both sides are sorted once by (keys, time) and the last right values are carried on: one shuffle, no range join.
    """
    carried = F.struct(*columns)
    kinds = right.select(*keys, time, F.lit(0).alias("_k"), carried.alias("_v"))
    rows = left.withColumns({"_k": F.lit(1), "_v": F.lit(None).cast(kinds.schema["_v"].dataType)})
    w = Window.partitionBy(*keys).orderBy(time, "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(kinds, allowMissingColumns=True)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_k = 1").select(*left.columns, *[F.col(f"_v.{c}") for c in columns])


def nearest_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], ident: str) -> DataFrame:
    """JON-07: the right row nearest in time, the earlier one on ties: the last before and the first after, then the nearer."""
    r = right.select(*keys, F.col(time).alias("_t"), *columns)
    before = as_of(left.withColumn("_id", F.col(ident)), right.select(*keys, time, F.col(time).alias("_bt"), *[F.col(c).alias(f"_b_{c}") for c in columns]), keys, time, ["_bt", *[f"_b_{c}" for c in columns]])
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = r.select(*keys, F.col("_t").alias(time), F.lit(0).alias("_k"), F.struct(F.col("_t").alias("_at"), *[F.col(c).alias(f"_a_{c}") for c in columns]).alias("_v"))
    both = before.withColumns({"_k": F.lit(1), "_v": F.lit(None).cast(after.schema["_v"].dataType)}).unionByName(after, allowMissingColumns=True)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_k = 1").select("*", "_v.*")
    gap = lambda t: F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(t).cast("timestamp")))
    first = F.col("_at").isNull() | (F.col("_bt").isNotNull() & (gap("_bt") <= gap("_at")))
    return both.select(*left.columns, *[F.when(first, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in columns])


def unique_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """JON-12: exact (rank, name) matches, then by the name without its infraspecific mark; only names that are unique on the right."""
    mark = lambda c: F.regexp_replace(c, r" (subsp\.|ssp\.|var\.|f\.) ", " ")
    one = right.groupBy("rank", "name").agg(F.count("*").alias("_n"), F.min("ext_id").alias("_exact")).where("_n = 1").drop("_n")
    two = right.withColumn("_m", mark(F.col("name"))).groupBy("rank", "_m").agg(F.count("*").alias("_n"), F.min("ext_id").alias("_stripped")).where("_n = 1").drop("_n")
    out = left.join(one, ["rank", "name"], "left").withColumn("_m", mark(F.col("name"))).join(two, ["rank", "_m"], "left")
    return out.select(*left.columns, F.coalesce("_exact", "_stripped").alias("ext_id"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """JON-13: whole rows of `over` win; rows of either side stay."""
    columns = [c for c in base.columns if c != key]
    a, b = base.select(key, F.struct(*columns).alias("_a")), over.select(key, F.struct(*columns).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_b", "_a").alias("_x")).select(key, "_x.*")


def filled(catalog: DataFrame, source: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """JON-02/21: blank fields take the source's value; all of them if overwrite."""
    s = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    own = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = catalog.join(s, key, "left")
    return out.select(*[c for c in catalog.columns if c not in columns], *[(F.coalesce(f"_{c}", c) if overwrite else F.coalesce(own(c), F.col(f"_{c}"))).alias(c) for c in columns])


def member_or_below(taxa: DataFrame, tree: DataFrame, members: DataFrame) -> DataFrame:
    """JON-10: taxa that are members or have a member below."""
    held = tree.join(members.select(F.col("taxon_key").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("taxon_key"))
    return taxa.join(held, "taxon_key", "left_semi")


def with_legend(rows: DataFrame, legend: DataFrame, token: Column) -> DataFrame:
    """JON-15, ARR-07: class names by id, slug or code, tried in this order."""
    keys = legend.select("class_id", "name", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("class_id").cast("string").alias("k")), F.struct(F.lit(1).alias("o"), F.lower("slug").alias("k")), F.struct(F.lit(2).alias("o"), F.lower("code").alias("k")))).alias("x"))
    keys = keys.groupBy(F.col("x.k").alias("_k")).agg(F.min_by("name", F.struct("x.o", "class_id")).alias("class_name"))
    return rows.withColumn("_k", F.lower(token)).join(keys, "_k", "left").drop("_k")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET-05: existing rows win; of new rows of one key the first by the order."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), F.struct(*order)).alias("_x")).select(*keys, "_x.*")
    return old.unionByName(one)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """SET-06: of all rows of a key that with the highest version, new ones over old."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", version)).alias("_x")).select(*keys, "_x.*")
