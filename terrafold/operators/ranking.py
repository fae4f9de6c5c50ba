"""Ordinal ranks, percentiles and leaderboards (WIN-01..12, SRT-01..09, AGG-21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def positions(metrics: DataFrame, context: list[str], key: str = "taxon_key", value: str = "value") -> DataFrame:
    """WIN-01/02: 0-based place by value then key as text, size of the context, and place / (size - 1)."""
    order = Window.partitionBy(*context).orderBy(value, F.col(key).cast("string"))
    out = metrics.withColumns({"pos": (F.row_number().over(order) - 1).cast("long"), "cnt": F.count("*").over(Window.partitionBy(*context))})
    return out.withColumn("percentile", percentile(F.col("pos"), F.col("cnt")))


def positions_by_ranges(metrics: DataFrame, context: list[str], key: str = "taxon_key", value: str = "value") -> DataFrame:
    """WIN-01/02 for contexts that are too large for one task: all rows are numbered in the order of context, value and key, and a place is the distance to the first row of the context."""
    order = [*[F.asc(c) for c in context], F.asc(value), F.col(key).cast("string").asc()]
    rows = numbered(metrics, order, "_row")
    first = rows.groupBy(*context).agg(F.min("_row").alias("_first"), F.count("*").alias("cnt"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in context])
    out = rows.join(first.select(*[F.col(c).alias(f"_c_{c}") for c in context], "_first", "cnt"), same)
    out = out.withColumn("pos", F.col("_row") - F.col("_first"))
    return out.select(*metrics.columns, "pos", "cnt", percentile(F.col("pos"), F.col("cnt")).alias("percentile"))


def percentile(pos: Column, cnt: Column) -> Column:
    return F.when(cnt > 1, pos / (cnt - 1)).otherwise(0.0)


def zero_padded(ranked: DataFrame, eligible: DataFrame, context: list[str]) -> DataFrame:
    """WIN-03: eligible taxa without the class count as share zero, below all that have it. eligible: context, eligible."""
    e = ranked.join(eligible, context, "left")
    more = F.greatest(F.coalesce(F.col("eligible"), F.col("cnt")) - F.col("cnt"), F.lit(0))
    e = e.withColumns({"pos": F.col("pos") + more, "cnt": F.col("cnt") + more}).drop("eligible")
    return e.withColumn("percentile", percentile(F.col("pos"), F.col("cnt")))


def within_location(metrics: DataFrame, membership: DataFrame, scope: str, gid: str, context: list[str], key: str = "taxon_key") -> DataFrame:
    """WIN-04, JON-08: the semi-join comes before the ranking."""
    members = membership.where((F.col("scope") == scope) & (F.col("gid") == gid)).select(key)
    return positions(metrics.join(members, key, "left_semi"), context, key)


def leaderboard(ranked: DataFrame, descending: bool, limit: int, offset: int = 0, key: str = "taxon_key") -> DataFrame:
    """WIN-05, SRT-02: places stay those of the ascending order."""
    k = F.col(key).cast("string")
    return ranked.orderBy(*([F.desc("value"), k.desc()] if descending else [F.asc("value"), k])).offset(offset).limit(limit)


def direct(matches: DataFrame, descending: bool, key: str = "taxon_key") -> DataFrame:
    """WIN-06: matches by value, then higher match score; place and percentile in the ascending sense; null values come last."""
    order = [F.desc_nulls_last("value") if descending else F.asc_nulls_last("value"), F.desc("match_score"), F.col(key).cast("string").asc()]
    rows = numbered(matches, order, "row")
    total = matches.agg(F.count("*").alias("cnt"))
    rows = rows.join(F.broadcast(total))  # one row
    pos = (F.col("cnt") - 1 - F.col("row")) if descending else F.col("row")
    return rows.withColumn("pos", pos).withColumn("percentile", percentile(F.col("pos"), F.col("cnt")))


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt over tasks by ranges of the whole order and sorted in each: `_part` rises with the order, `_here` in a part.

    Ranges are over all the columns of the order, so a frequent first value, or null, is split by the others.  The rows are
    written once, because ranges come from a sample and must not change between the steps that use them.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_here", F.monotonically_increasing_id())
    return staged(rows, "ordered").withColumns({"_part": F.shiftright("_here", 33), "_here": F.col("_here").bitwiseAND(F.lit((1 << 33) - 1))})


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A global 0-based row number: the place in a part, moved by the rows of the parts before it. Rows equal in the whole order are numbered in any way."""
    rows = in_order(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # as many rows as tasks
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def summed_below(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Per row the sum of each column over all rows before it in a total order; 0 for the first."""
    rows = in_order(df.withColumns({f"_w_{n}": c for n, c in sums.items()}), order)
    sizes = rows.groupBy("_part").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in sums])
    up = Window.orderBy("_part")  # as many rows as tasks
    before = sizes.select("_part", *[(F.sum(f"_s_{n}").over(up) - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in sums])
    here = Window.partitionBy("_part").orderBy("_here")
    rows = rows.withColumns({f"_h_{n}": F.sum(f"_w_{n}").over(here) - F.col(f"_w_{n}") for n in sums}).join(F.broadcast(before), "_part")
    return rows.select(*df.columns, *[(F.col(f"_h_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def metric_rows(numeric: DataFrame, categorical: DataFrame, counts: DataFrame) -> DataFrame:
    """AGG-21: (taxon_key, variable, metric, value, samples): categorical wins over numeric of one name; a missing or not positive count is the catalogue's; windowed weather metrics stay out."""
    both = numeric.select("taxon_key", "variable", "metric", "value", "samples", F.lit(0).alias("_w")).unionByName(categorical.select("taxon_key", "variable", "metric", "value", F.lit(None).cast("long").alias("samples"), F.lit(1).alias("_w")))
    both = both.where("value is not null and not isnan(value)").where(~F.col("variable").rlike(r"_(avg|sum)_\d+h$"))
    one = both.groupBy("taxon_key", "variable", "metric").agg(F.max_by(F.struct("value", "samples"), "_w").alias("x")).select("taxon_key", "variable", "metric", "x.*")
    return one.join(counts.select("taxon_key", F.col("cnt").alias("_cnt")), "taxon_key", "left").select("taxon_key", "variable", "metric", "value", F.when(F.coalesce("samples", F.lit(0)) > 0, F.col("samples")).otherwise(F.col("_cnt")).alias("samples"))


def options(ranked: DataFrame) -> DataFrame:
    """WIN-11: variable and metric pairs with their sizes, without class shares."""
    return ranked.where("metric not like 'class\\_%'").groupBy("variable", "metric").agg(F.count("*").alias("taxa"))


def outliers(ranked: DataFrame, depth: DataFrame) -> DataFrame:
    """WIN-12: per taxon the strongest of its extreme places in contexts of ten or more. depth: context, depth."""
    strength = F.greatest("percentile", 1 - F.col("percentile"))
    level = F.when(strength >= 0.99, 3).when(strength >= 0.95, 2).when(strength >= 0.9, 1)
    r = ranked.join(depth, "context").where("cnt >= 10").withColumns({"strength": strength, "level": level}).where("level is not null")
    order = Window.partitionBy("taxon_key").orderBy(F.desc("level"), F.desc("depth"), F.desc("strength"), "variable", "context")
    return r.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def capped(df: DataFrame, key: str, ident: str, cap: int, seed: int = 42) -> DataFrame:
    """SRT-08/09: a sampling operator: cap rows per key in the order of a seeded hash."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(drawn, ident))).where(F.col("_r") <= cap).drop("_r")
