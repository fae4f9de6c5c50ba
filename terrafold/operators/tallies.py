"""Counts, boxes, masks and colours over groups (AGG-15..33, FLT-11..21, HIE-10, MTH-18/19, RAS-04..08, TMP-02..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECIES_LIKE = ("SUBSPECIES", "VARIETY", "FORM")
LEAVES = ("SPECIES", *SPECIES_LIKE)


def sample_count(summaries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """AGG-15: the count of any summary of a taxon, else its rows, else 0; taxa of either table."""
    s = summaries.groupBy(key).agg(F.max("n").alias("_s"))
    r = rows.groupBy(key).agg(F.count("*").alias("_r"))
    return s.join(r, key, "full").select(key, F.coalesce("_s", "_r", F.lit(0)).cast("long").alias("samples"))


def place_counts(rows: DataFrame, key: str) -> DataFrame:
    """AGG-17: sums by scope and place; a missing or unreadable count is 1, and totals that are not positive go."""
    n = F.coalesce(F.col("cnt").try_cast("bigint"), F.lit(1))
    return rows.withColumn("_n", n).where("_n > 0").groupBy(key, "scope", "gid").agg(F.sum("_n").alias("cnt"))


def group_reason(pixels: DataFrame, groups: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """AGG-24: per key the class group with the highest mean among those of at least `least` pixels."""
    m = pixels.join(groups, "class_id").groupBy(*keys, "class_group").agg(F.avg("value").alias("mean"), F.count("*").alias("pixels")).where(F.col("pixels") >= least)
    best = F.max_by(F.struct("class_group", "mean", "pixels"), F.struct(F.round("mean", 9), F.col("class_group")))
    return m.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def colour_range(cells: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """AGG-27: the range of valid pixels between two percentiles."""
    p = cells.where("value is not null and not isnan(value)").groupBy(*keys).agg(F.percentile("value", [low, high]).alias("p"))
    return p.select(*keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def bounding_box(points: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """AGG-31: the box of points, widened about its centre to a least span."""
    b = points.groupBy(*keys).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))

    def side(a, z, sign):
        wide = F.greatest(F.col(z) - F.col(a), F.lit(least))
        return (F.col(a) + F.col(z)) / 2 + sign * wide / 2

    return b.select(*keys, side("s", "n", -1).alias("south"), side("s", "n", 1).alias("north"), side("w", "e", -1).alias("west"), side("w", "e", 1).alias("east"))


def match_quality(matches: DataFrame, key: str = "rank") -> DataFrame:
    """AGG-32: counters per rank; matches has `hits` (ids found) and `conflict`."""
    return matches.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.expr("hits = 1")).alias("matched"), F.count_if(F.expr("hits > 1")).alias("ambiguous"), F.count_if(F.expr("coalesce(hits, 0) = 0")).alias("unmatched"), F.count_if(F.col("conflict")).alias("conflict"))


def aspect_preference(counts: DataFrame, keys: list[str], least: float = 0.5, samples: int = 100) -> DataFrame:
    """AGG-33: aspect (one of eight classes), its count and the total n -> share of each cardinal direction; a diagonal counts
    for both its sides; whether it is preferred.  Counts are added up and divided once, so the share is the same at each run."""
    d = counts.withColumn("direction", F.explode(F.regexp_extract_all("aspect", F.lit("[NESW]"), F.lit(0))))
    d = d.groupBy(*keys, "direction").agg(F.sum("count").alias("c"), F.max("n").alias("n"))
    d = d.withColumn("share", F.col("c") / F.col("n")).drop("c")
    return d.withColumn("preferred", (F.col("share") > least) & (F.col("n") > samples))


def of_rank(taxa: DataFrame, tree: DataFrame, ancestor: str, rank: str, species_like: bool = False) -> DataFrame:
    """FLT-11: taxa of a rank strictly below an ancestor; a species may stand for the ranks below it."""
    ranks = (rank, *SPECIES_LIKE) if rank == "SPECIES" and species_like else (rank,)
    below = tree.where((F.col("ancestor") == ancestor) & (F.col("depth") > 0)).select(F.col("descendant").alias("taxon_key"))
    return taxa.where(F.upper("rank").isin(*ranks)).join(below, "taxon_key", "left_semi")


def ingestible(rows: DataFrame, catalog: DataFrame, required: list[str], ranks: tuple[str, ...] = LEAVES) -> DataFrame:
    """FLT-13: rows of a leaf rank with all required fields, whose key the catalogue knows."""
    good = F.upper("rank").isin(*ranks)
    for c in required:
        good = good & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return rows.where(good).join(catalog.select("taxon_key").distinct(), "taxon_key", "left_semi")


def usable_media(media: DataFrame, licence: str, kinds: tuple[str, ...]) -> DataFrame:
    """FLT-17: media of a usable licence (pattern) and kind with an address."""
    return media.where(F.lower("licence").rlike(licence) & F.lower("kind").isin(*kinds) & (F.trim(F.coalesce("url", F.lit(""))) != ""))


def without_words(names: DataFrame, column: str, words: list[str]) -> DataFrame:
    """FLT-18: rows none of whose words is listed."""
    return names.where(~F.coalesce(F.arrays_overlap(F.split(F.lower(column), r"\W+"), F.array(*map(F.lit, words))), F.lit(False)))


def from_date(value: Column, ts: Column, floor: str) -> Column:
    """FLT-19: no value before a date."""
    return F.when(ts >= F.lit(floor).cast("timestamp_ntz"), value)


def valid(value: Column, nodata: float, zero: bool = False) -> Column:
    """FLT-20: null where the value is the nodata value or NaN; 0 instead for layers in which nodata means none."""
    v = F.when(F.isnan(value) | value.eqNullSafe(F.lit(nodata)), F.lit(None)).otherwise(value)
    return F.coalesce(v, F.lit(0.0)) if zero else v


#: The legend's class of open water.
WATER = 210


def land_candidate(cover: Column, elevation: Column, water: int = WATER) -> Column:
    """FLT-21: a place that may be drawn as an absence: not water at about sea level."""
    return ~F.coalesce((cover == water) & (F.abs(elevation) <= 10), F.lit(False))


def ocean(cover: Column, elevation: Column, water: int = WATER) -> Column:
    """FLT-21: masked in outputs: water, or no class with an elevation under 1 or none."""
    return F.coalesce(cover == water, F.lit(False)) | (cover.isNull() & F.coalesce(elevation < 1, F.lit(True)))


def places_below(locations: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """HIE-10: children by id prefix, else by parent name, else by any ancestor name; `limit` is the report's own.

    locations: gid, name, above (array of ancestor names, the parent last).
    """
    wanted = text.strip().lower()
    way = F.when(F.lower("gid").startswith(wanted + "."), 1)
    way = way.when(F.lower(F.element_at("above", -1)) == wanted, 2).when(F.exists("above", lambda a: F.lower(a) == wanted), 3)
    found = locations.withColumn("_way", F.when(F.size("above") > 0, way)).where("_way is not null")
    best = found.agg(F.min("_way").alias("_way"))
    rows = found.join(F.broadcast(best), "_way", "left_semi").drop("_way").orderBy("gid")
    return rows.limit(limit) if limit is not None else rows


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """MTH-18: red, green and blue, linear between stops on [0, 1]; values outside are clamped."""
    v = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

    def channel(k):
        out = None
        for (a, x), (b, y) in zip(stops[:-1], stops[1:], strict=True):
            here = F.round(F.lit(float(x[k])) + (v - F.lit(a)) / F.lit(b - a) * F.lit(float(y[k] - x[k]))).cast("int")
            out = F.when(v <= b, here) if out is None else out.when(v <= b, here)
        return out

    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b")))


def grown(boxes: DataFrame, factor: float, padding: float = 0.0) -> DataFrame:
    """MTH-19: south, north, west, east grown about their centre, kept off the poles and the date line."""

    def side(a, z, sign, edge):
        half = (F.col(z) - F.col(a)) / 2 * factor + padding
        return F.greatest(F.least((F.col(a) + F.col(z)) / 2 + sign * half, F.lit(edge)), F.lit(-edge))

    return boxes.withColumns({"south": side("south", "north", -1, 89.999), "north": side("south", "north", 1, 89.999), "west": side("west", "east", -1, 179.999), "east": side("west", "east", 1, 179.999)})


def bilinear(points: DataFrame, cells: DataFrame, y: Column, x: Column) -> DataFrame:
    """RAS-04/08: points with real cell coordinates get the weighted mean of the valid ones of their four cells."""
    p = points.withColumns({"_y": y, "_x": x})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("_c")
    p = p.select("*", corner)
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    weight = F.when(F.col("_c.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_c.b") == 1, fx).otherwise(1 - fx)
    p = p.withColumns({"row": F.floor("_y") + F.col("_c.a"), "col": F.floor("_x") + F.col("_c.b"), "_w": weight})
    hit = p.join(cells.where("value is not null and not isnan(value)").select("row", "col", "value"), ["row", "col"], "left")
    w = F.when(F.col("value").isNotNull(), F.col("_w"))
    got = hit.groupBy(*points.columns).agg(F.sum(F.col("_w") * F.col("value")).alias("_v"), F.sum(w).alias("_t"))
    return got.select(*points.columns, F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).alias("value"))


def mosaic(layers: DataFrame, order: str) -> DataFrame:
    """RAS-04/05: overlapping grids as one; the last valid value of a cell holds, the higher on ties."""
    return layers.where("value is not null and not isnan(value)").groupBy("row", "col").agg(F.max_by("value", F.struct(order, "value")).alias("value"))


def covering_chunks(manifest: DataFrame, since: Column) -> DataFrame:
    """SRC-18: chunks of a source, newest first, until the start of the window is covered."""
    newer = Window.partitionBy("source").orderBy(F.desc("start"), "name").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("_from", F.min("start").over(newer)).where(F.col("_from").isNull() | (F.col("_from") > since)).drop("_from")


def expired(manifest: DataFrame, windows: DataFrame) -> DataFrame:
    """TMP-09: chunks that meet no window (since, until)."""
    return manifest.join(windows, (F.col("end") >= F.col("since")) & (F.col("start") <= F.col("until")) & (F.col("source") == F.col("of_source")), "left_anti")


def missing_targets(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """TMP-02: per key the target columns without any value; keys that have all are skipped."""
    have = rows.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    lacking = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return have.select(key, lacking.alias("missing")).where(F.size("missing") > 0)


def snapshot(rows: DataFrame, keys: list[str], time: str, *values: str) -> DataFrame:
    """TMP-10: the newest row of each cell; views with derived variables stand on it."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, *values)).alias("_v"), F.max(time).alias(time)).select(*keys, time, "_v.*")


def steps_in_year(year: Column, seconds: int) -> Column:
    """DAT-05."""
    days = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    return (days * 86400 / seconds).cast("long")


def forecast_frame(frames: DataFrame, keys: list[str], time: str, reference: Column, hours: int) -> DataFrame:
    """SRC-20: of each key's frames the second one by time for no offset (the first is the analysis), the only one if there is
    no second; else the one whose time is nearest to the reference plus the hours, the earlier on ties."""
    if hours == 0:
        order = Window.partitionBy(*keys).orderBy(time)
        ranked = frames.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
        return ranked.groupBy(*keys).agg(F.max(time).alias(time))
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(reference) - F.lit(hours * 3_600_000_000))
    return frames.groupBy(*keys).agg(F.min_by(F.col(time), F.struct(gap, F.col(time))).alias(time))
