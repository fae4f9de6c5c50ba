"""Hourly series, trailing windows, two sources (TMP-01..10, WIN-07..09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Window lengths in hours.
WINDOWS = (1, 6, 24, 72, 168, 720, 2160)


def hourly(points: DataFrame, keys: list[str], time: str, value: str, how=F.avg) -> DataFrame:
    """DAT-04: one value per key and hour: the mean, or another aggregate such as the sum for rain."""
    return points.groupBy(*keys, F.date_trunc("HOUR", F.col(time).cast("timestamp_ntz").cast("timestamp")).alias("hour")).agg(how(value).alias("value"))


def observation_index(rows: DataFrame, time: str, lat: str, lon: str) -> DataFrame:
    """TMP-01: rows that have a time and a place, which is what weather can be joined to."""
    return rows.where(F.col(time).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())


def accumulated(series: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """TMP-03: per key the sum of the values in [start, end), NaN as 0, and the number of hours that have a row."""
    rows = series.where((F.col("hour") >= F.lit(start).cast("timestamp")) & (F.col("hour") < F.lit(end).cast("timestamp")))
    return rows.groupBy(*keys).agg(F.sum(F.nanvl("value", F.lit(0.0))).alias("total"), F.count_distinct("hour").alias("hours"))


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """TMP-04/07: per key and hour the first source's value where it has one: a revision, not a drop of late rows."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1))).where("value is not null")
    return both.groupBy(*keys, "hour").agg(F.min_by("value", "_p").alias("value"))


def trailing(series: DataFrame, keys: list[str], hours: tuple[int, ...] = WINDOWS) -> DataFrame:
    """WIN-07/08: sums and means over the last h hours, each hour of the series included; null without a value.

    Running sums and counts are differenced: the value h hours back is found in the same sort, so a window of 2160 hours
    costs as much as one of 1 hour.
    """
    run = Window.partitionBy(*keys).orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = series.select(*keys, "hour", (F.unix_timestamp("hour") / 3600).cast("long").alias("_h"), "value")
    s = s.withColumns({"_s": F.sum(F.coalesce("value", F.lit(0.0))).over(run), "_c": F.count("value").over(run)})
    out = s
    for h in hours:
        before = Window.partitionBy(*keys).orderBy("_h").rangeBetween(Window.unboundedPreceding, -h)
        out = out.withColumns({f"_s{h}": F.coalesce(F.last("_s").over(before), F.lit(0.0)), f"_c{h}": F.coalesce(F.last("_c").over(before), F.lit(0))})
    sums = {f"sum_{h}h": F.when(F.col("_c") > F.col(f"_c{h}"), F.col("_s") - F.col(f"_s{h}")) for h in hours}
    means = {f"avg_{h}h": F.when(F.col("_c") > F.col(f"_c{h}"), (F.col("_s") - F.col(f"_s{h}")) / (F.col("_c") - F.col(f"_c{h}"))) for h in hours}
    return out.select(*keys, "hour", *[c.alias(n) for n, c in {**sums, **means}.items()])


def shifted(series: DataFrame, keys: list[str], anchor, hours: int, shifts: tuple[int, ...]) -> DataFrame:
    """TMP-06: the window of `hours` that ends before each shifted anchor, half open."""
    end = F.explode(F.array(*map(F.lit, shifts))).alias("shift")
    h = (F.unix_timestamp("hour") / 3600).cast("long")
    a = (F.unix_timestamp(F.lit(anchor).cast("timestamp")) / 3600).cast("long") + F.col("shift")
    return series.select(*keys, "hour", "value", end).where((h < a) & (h >= a - hours)).groupBy(*keys, "shift").agg(F.sum("value").alias("total"), F.count("value").alias("hours"))
