"""Row predicates (FLT-01..24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for no location.
NO_LOCATION = ("", "nan", "none", "null", "na", "n/a", "undefined")


def clean(value: Column) -> Column:
    """NaN and infinities as null (FLT-16), so that aggregates skip them."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def visible(df: DataFrame, need_place: bool = True) -> DataFrame:
    """FLT-01/02/03: not obscured, uncertainty of 500 m at most, and coordinates if asked; only tests columns that exist."""
    tests = [("obscured", F.col("obscured") == "No"), ("uncertainty_m", clean(F.col("uncertainty_m")) <= 500)]
    if need_place:
        tests += [("lat", F.col("lat").isNotNull()), ("lon", F.col("lon").isNotNull())]
    for name, test in tests:
        if name in df.columns:
            df = df.where(test)
    return df


def location_column(gid: str, regions: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """FLT-04/05: the column and value that a location id selects; None if it is no id."""
    token = (gid or "").strip()
    if token.lower() in NO_LOCATION:
        return None
    if token.upper() in regions:
        return "gbif_region", token.upper()
    return ("level0_gid", "level1_gid", "level2_gid")[min(token.count("."), 2)], token


def in_range(df: DataFrame, column: str, low: float, high: float, circular: bool = False) -> DataFrame:
    """FLT-06/07/08: closed range; on a circle a low above the high wraps, otherwise the two are exchanged."""
    v = F.col(column)
    if low > high and circular:
        return df.where((v >= low) | (v <= high))
    return df.where(v.between(min(low, high), max(low, high)))


def of_class(df: DataFrame, column: str, token: str, legend: DataFrame) -> DataFrame:
    """FLT-09/10: rows whose class is the one that a token names by id, class_<id>, label or code."""
    t = token.strip().lower()
    match = legend.where((F.col("class_id").cast("string") == t.removeprefix("class_")) | (F.lower("name") == t) | (F.lower("code") == t)).select(F.col("class_id").alias("_class"))
    return df.join(match, df[column] == F.col("_class"), "left_semi")


def min_samples(df: DataFrame, counts: DataFrame, key: str, least: int) -> DataFrame:
    """FLT-12: a key without count fails a positive minimum."""
    return df.join(counts.select(key, F.col("cnt").alias("_cnt")), key, "left").where(F.coalesce("_cnt", F.lit(-1)) >= least).drop("_cnt") if least > 0 else df


def obscured_only(df: DataFrame, key: str, is_visible: Column) -> DataFrame:
    """FLT-23, AGG-18: per key all rows, visible rows, and whether there are rows of which none is visible."""
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(is_visible).alias("visible")).withColumn("all_obscured", (F.col("total") > 0) & (F.col("visible") == 0))


def label_split(df: DataFrame, tokens: Column, positive: list[str]) -> DataFrame:
    """FLT-24: 1 where a token is positive, 0 where there is none at all; other rows go."""
    y = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(p) for p in positive])), 1).when(tokens.isNull() | (F.size(F.filter(tokens, lambda t: t != "")) == 0), 0)
    return df.withColumn("label", y).where("label is not null")


def checked_coordinates(df: DataFrame) -> DataFrame:
    """FLT-14: raises if any coordinate is not a number in its domain."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    bad = df.where(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows have coordinates that are not numbers in range")
    return df


def checked_columns(df: DataFrame, reserved: set[str]) -> DataFrame:
    """FLT-15."""
    if clash := sorted(set(df.columns) & reserved):
        raise ValueError(f"reserved columns in the upload: {', '.join(clash)}")
    return df
