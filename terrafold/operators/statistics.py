"""Summaries, circular statistics, densities, category shares (AGG-01..34)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .filters import clean
from .ranking import numbered

POINTS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
NAMES = ("p01", "p10", "p25", "median", "p75", "p90", "p99")
SPANS = (("iqr", "p75", "p25"), ("range_10_90", "p90", "p10"), ("range_1_99", "p99", "p01"), ("value_range", "max", "min"))
TAU = 6.283185307179586


def tall(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """PRJ-11: one row per (ids, variable) with a value."""
    return df.unpivot(ids, variables, "variable", "value").where("value is not null")


def summary(df: DataFrame, keys: list[str], value: str = "value", exact: bool = True) -> DataFrame:
    """AGG-01 exact, AGG-03 mergeable sketches: one partial and final aggregation either way."""
    v = clean(F.col(value))
    p = F.percentile(v, F.array(*map(F.lit, POINTS))) if exact else F.percentile_approx(v, list(POINTS), 10000)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), p.alias("_p"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    out = out.select(*keys, "n", "min", *[F.get("_p", F.lit(k)).alias(n) for k, n in enumerate(NAMES)], "max", "mean", "std")
    return out.withColumns({n: F.col(a) - F.col(b) for n, a, b in SPANS})


def summary_by_ranges(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """AGG-01 for groups of any size, exact: all values are dealt over tasks by ranges of (keys, value) and numbered; a
    percentile reads the two rows around its place.  No task holds a group, and no sketch rounds."""
    rows = df.select(*keys, clean(F.col(value)).alias("_v")).where("_v is not null")
    rows = numbered(rows, [*[F.asc(k) for k in keys], F.asc("_v")], "_row")
    v = F.col("_v")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_row").alias("_first"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    groups = staged(groups, "groups")
    at = F.posexplode(F.transform(F.array(*map(F.lit, POINTS)), lambda p: p * (F.col("n") - 1))).alias("_k", "_at")
    wanted = groups.select(*keys, "_first", at).select(*keys, "_k", "_at", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("_first") + F.floor("_at")).alias("row")), F.struct(F.lit(1).alias("side"), (F.col("_first") + F.ceil("_at")).alias("row")))).alias("_w"))
    found = wanted.select(*keys, "_k", "_at", "_w.side", F.col("_w.row").alias("_row")).join(rows.select("_row", "_v"), "_row")
    pair = found.groupBy(*keys, "_k").agg(F.max(F.when(F.col("side") == 0, v)).alias("_a"), F.max(F.when(F.col("side") == 1, v)).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_t"))
    points = pair.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t"))).alias(n) for k, n in enumerate(NAMES)])
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    out = groups.alias("g").join(points.alias("p"), same).select(*[F.col(f"g.{k}") for k in keys], "n", "min", *NAMES, "max", "mean", "std")
    return out.withColumns({n: F.col(a) - F.col(b) for n, a, b in SPANS})


def summary_by_rank(df: DataFrame, keys: list[str], is_leaf: Column, value: str = "value") -> DataFrame:
    """AGG-04: groups of leaf taxa, which are small, by exact percentiles in one aggregation; groups above them, which may
    hold all rows, by ranges."""
    return summary(df.where(is_leaf), keys, value).unionByName(summary_by_ranges(df.where(~is_leaf), keys, value))


def circular(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """AGG-02: mean angle, deviations around it, and standard deviation from the resultant length."""
    v = clean(F.col(value))
    rows = df.withColumn("_v", v).where("_v is not null")
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.sin(F.radians("_v"))).alias("_s"), F.avg(F.cos(F.radians("_v"))).alias("_c"))
    means = means.withColumns({"mean": F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)), "_r": F.sqrt(F.col("_s") ** 2 + F.col("_c") ** 2)})
    dev = F.pmod(F.col("_v") - F.col("mean") + 180, F.lit(360.0)) - 180
    spread = rows.join(means.select(*keys, "mean"), keys).groupBy(*keys).agg(F.percentile(dev, F.array(*map(F.lit, POINTS))).alias("_p"), (F.max(dev) - F.min(dev)).alias("value_range"))
    out = means.join(spread, keys)
    return out.select(*keys, "n", "mean", F.when(F.col("_r") > 0, F.degrees(F.sqrt(F.greatest(-2 * F.ln("_r"), F.lit(0.0))))).alias("std"), *[F.pmod(F.col("mean") + F.get("_p", F.lit(k)), F.lit(360.0)).alias(n) for k, n in enumerate(NAMES)], "value_range")


def grid_points(n: Column) -> Column:
    """AGG-12."""
    return F.when(n <= 0, 0).when(n <= 32, F.greatest(F.lit(8), n)).when(n <= 200, 64).otherwise(128).cast("int")


def sampled(df: DataFrame, keys: list[str], ident: str, cap: int = 20_000, value: str = "value") -> DataFrame:
    """AGG-13: at most about cap values per key by a hash of the id: no sort, and the same values at each run."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = F.conv(F.substr(F.md5(F.concat_ws("|", F.col(ident).cast("string"), *[F.col(k).cast("string") for k in keys])), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return df.join(n, keys).where((F.col("_n") <= cap) | (part * F.col("_n") < cap)).drop("_n")


def density(df: DataFrame, keys: list[str], value: str = "value", points: int | None = None, ring: bool = False) -> DataFrame:
    """AGG-10/11: Gaussian densities on a grid; ring: on 0 to 360 degrees with the data repeated on both sides.

    Equal values are counted first.  Then each (value, grid point) pair is one row of a generator inside the aggregation,
    so no pair is shuffled, and partial sums meet per grid point; `sampled` before it bounds the values of large groups.
    """
    v = clean(F.col(value))
    rows = df.select(*keys, v.alias("_v")).where("_v is not null")
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_pop("_v").alias("_s"))
    std = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    band = F.lit(1.06) * std * F.pow("n", F.lit(-0.2))
    if ring:
        low, high = F.lit(0.0), F.lit(360.0)
        band = F.when(F.col("_s") == 0, 18.0).otherwise(band)
    else:
        flat = F.col("_lo") == F.col("_hi")
        pad = F.when(F.col("_lo") == 0, 1.0).otherwise(F.abs("_lo") * 0.1)
        low, high = F.when(flat, F.col("_lo") - pad).otherwise(F.col("_lo")), F.when(flat, F.col("_hi") + pad).otherwise(F.col("_hi"))
    stats = stats.select(*keys, "n", low.alias("low"), high.alias("high"), band.alias("bandwidth"), (F.lit(points) if points else grid_points(F.col("n"))).alias("_k"))
    where = F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.struct(i.alias("i"), (F.col("low") + (F.col("high") - F.col("low")) * i / (F.col("_k") - 1)).alias("x"))))
    pairs = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_times")).join(stats, keys)
    one = lambda shift: F.exp(-0.5 * ((F.col("g.x") - F.col("_v") - shift) / F.col("bandwidth")) ** 2)
    part = reduce(lambda a, b: a + b, [one(s) for s in (-360.0, 0.0, 360.0)]) if ring else one(0.0)
    got = pairs.select(*keys, "n", "bandwidth", "_v", "_times", where.alias("g")).groupBy(*keys, "n", "bandwidth", F.col("g.i").alias("i"), F.col("g.x").alias("x")).agg(F.sum(F.col("_times") * part).alias("_sum"))
    return got.select(*keys, "i", "x", (F.col("_sum") / (F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(TAU)))).alias("density"), "bandwidth", "n")


def category_metrics(df: DataFrame, keys: list[str], category: str, significant: float = 0.05) -> DataFrame:
    """AGG-06: tall rows: total_samples, unique_classes, significant_unique_classes and class_<id> shares."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, F.col(category).alias("_c")).agg(F.count("*").alias("cnt"))
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    share = counts.join(totals, keys).withColumn("share", F.col("cnt") / F.col("total"))
    whole = share.groupBy(*keys).agg(F.max("total").cast("double").alias("total_samples"), F.count("*").cast("double").alias("unique_classes"), F.count_if(F.col("share") >= significant).cast("double").alias("significant_unique_classes"))
    return whole.unpivot(keys, ["total_samples", "unique_classes", "significant_unique_classes"], "metric", "value").unionByName(share.select(*keys, F.concat(F.lit("class_"), F.col("_c").cast("string")).alias("metric"), F.col("share").alias("value")))


def distribution(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-07: class shares back to counts (halves to even) and places by share."""
    total = metrics.where("metric = 'total_samples'").select(*keys, F.col("value").alias("_t"))
    rows = metrics.where("metric like 'class\\_%'").join(total, keys)
    rows = rows.select(*keys, F.expr("substr(metric, 7)").alias("class"), F.col("value").alias("share"), F.bround(F.col("value") * F.col("_t")).cast("long").alias("cnt"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), "class")).cast("long"))


def with_samples(df: DataFrame, keys: list[str], category: str, ident: str, limit: int) -> DataFrame:
    """AGG-08/09: counts per class with the first ids; a bounded top-k, so no group is collected whole."""
    cnt = df.groupBy(*keys, category).agg(F.count("*").alias("cnt"))
    first = df.select(*keys, category, ident, F.row_number().over(Window.partitionBy(*keys, category).orderBy(ident)).alias("_r")).where(F.col("_r") <= limit)
    first = first.groupBy(*keys, category).agg(F.array_sort(F.collect_list(ident)).alias("samples"))
    return cnt.join(first, [*keys, category])


def null_counts(df: DataFrame) -> DataFrame:
    """AGG-14: one scan, one row per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def location_counts(df: DataFrame, scopes: list[str], key: str) -> DataFrame:
    """AGG-16: (scope, gid, key) counts over several location columns in one pass."""
    return df.select(key, *[F.col(s).cast("string").alias(s) for s in scopes]).unpivot([key], scopes, "scope", "gid").where("gid is not null and gid != ''").groupBy("scope", "gid", key).agg(F.count("*").alias("cnt"))


def best_by(df: DataFrame, key: str, order: list[str], ident: str, *columns: str) -> DataFrame:
    """AGG-19: the least row by an order, ties by id."""
    return df.groupBy(key).agg(F.min_by(F.struct(ident, *columns), F.struct(*order, ident)).alias("best")).select(key, "best.*")


def quantiles_and_rates(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """AGG-29: recall and false-positive rate at each threshold."""
    t = df.select(F.col(score).alias("s"), F.col(label).alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return t.groupBy("threshold").agg(F.avg(F.when(F.col("y") == 1, (F.col("s") >= F.col("threshold")).cast("int"))).alias("recall"), F.avg(F.when(F.col("y") == 0, (F.col("s") >= F.col("threshold")).cast("int"))).alias("false_positive_rate"))


def mode_of(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """AGG-30: the most frequent class, the first on ties."""
    n = df.groupBy(*keys, category).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(F.col(category), F.struct(-F.col("_n"), F.col(category))).alias(category))
