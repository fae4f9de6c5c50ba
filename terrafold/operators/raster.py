"""Grids as long tables of cells (RAS-01..09, MTH-07/08, AGG-22..28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import WORLD, tile_id
from .tallies import bilinear


def point_sample(points: DataFrame, cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """RAS-01: the value of the cell that holds each point; null where there is no cell."""
    return points.withColumns({"row": row, "col": col}).join(cells.select("row", "col", "value"), ["row", "col"], "left")


def feature_stack(points: DataFrame, cells: DataFrame, layers: list[str]) -> DataFrame:
    """RAS-02/07, JON-16: one column per layer in model order."""
    wide = cells.groupBy("row", "col").pivot("layer", layers).agg(F.first("value"))
    return points.join(wide, ["row", "col"], "left")


def neighbours(cells: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The eight neighbours of each cell: every cell is sent to the nine cells it touches, in one aggregation."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    sent = cells.select(*keys, "row", "col", "value", steps).select(*keys, (F.col("row") - F.col("s.a")).alias("row"), (F.col("col") - F.col("s.b")).alias("col"), "s.a", "s.b", "value")
    name = {(a, b): f"v{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)}
    return sent.groupBy(*keys, "row", "col").agg(*[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("value"))).alias(n) for (a, b), n in name.items()]).where("v11 is not null")


def slope_aspect(cells: DataFrame, cell_metres: float) -> DataFrame:
    """MTH-07: Horn's 3 x 3 gradient; aspect 0 on the flat; cells without all neighbours are left out."""
    n = neighbours(cells).where(" and ".join(f"v{a}{b} is not null" for a in range(3) for b in range(3)))
    c = {k: F.col(k) for k in n.columns}
    dx = ((c["v02"] + 2 * c["v12"] + c["v22"]) - (c["v00"] + 2 * c["v10"] + c["v20"])) / (8 * cell_metres)
    dy = ((c["v20"] + 2 * c["v21"] + c["v22"]) - (c["v00"] + 2 * c["v01"] + c["v02"])) / (8 * cell_metres)
    aspect = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(dx, -dy)) + 180, F.lit(360.0)))
    return n.select("row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), aspect.alias("aspect"))


#: Fixed value: metres per degree of latitude.
METRES_PER_DEGREE = 111_320.0


def central_gradient(cells: DataFrame, cell_degrees: float, top: float, rows: int) -> DataFrame:
    """MTH-08: slope and aspect by central differences, one-sided at the edges, of a grid in degrees whose first row begins at
    latitude `top`; east-west metres are those of the grid's middle row; no aspect where the slope is 0.001 or less."""
    import math

    middle = top - cell_degrees * rows / 2
    dy_metres, dx_metres = cell_degrees * METRES_PER_DEGREE, cell_degrees * METRES_PER_DEGREE * max(0.01, math.cos(math.radians(middle)))
    r, c = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")

    def diff(w, metres):
        a, b = F.lag("value").over(w), F.lead("value").over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - F.col("value")).when(b.isNull(), F.col("value") - a).otherwise((b - a) / 2) / metres

    got = cells.withColumns({"dy": diff(r, dy_metres), "dx": diff(c, dx_metres)})
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))
    aspect = F.pmod(90 - F.degrees(F.atan2(F.col("dy"), -F.col("dx"))), F.lit(360.0))
    return got.withColumn("slope", slope).select("row", "col", "slope", F.when(F.col("slope") > 0.001, aspect).alias("aspect"))


def overview(cells: DataFrame, factor: int, categorical: bool = False) -> DataFrame:
    """RAS-06: means of factor x factor cells; the most frequent class, lowest on ties, for classes."""
    at = [F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")]
    if not categorical:
        return cells.groupBy(*at).agg(F.avg("value").alias("value"))
    n = cells.select(*at, "value").groupBy("row", "col", "value").agg(F.count("*").alias("_n"))
    return n.groupBy("row", "col").agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("value"))


def mean_raster(cells: DataFrame, group: str | None = None) -> DataFrame:
    """AGG-26: means per pixel, and per pixel and group, without NaN."""
    v = F.when(~F.isnan("value"), F.col("value"))
    keys = ["row", "col", *([group] if group else [])]
    return cells.groupBy(*keys).agg(F.avg(v).alias("value"), F.count(v).alias("n"))


def tile_scores(cells: DataFrame, tile: Column) -> DataFrame:
    """AGG-22: mean of finite pixels per taxon and tile, then over tiles."""
    t = cells.where("not isnan(value)").groupBy("taxon_key", tile.alias("tile")).agg(F.avg("value").alias("m"))
    return t.groupBy("taxon_key").agg(F.avg("m").alias("score"), F.count("*").alias("tiles"))


def tile_reasons(cells: DataFrame, tile: Column, drivers: list[str], least: int = 10) -> DataFrame:
    """AGG-23: per taxon and tile the driver with the strongest correlation, and its sign."""
    tall = cells.select("taxon_key", tile.alias("tile"), F.col("value").alias("p"), *drivers).unpivot(["taxon_key", "tile", "p"], drivers, "driver", "x").where("x is not null and p is not null")
    r = tall.groupBy("taxon_key", "tile", "driver").agg(F.count("*").alias("n"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("p") > 0), F.corr("x", "p")).alias("r"))
    r = r.where(F.col("n") >= least).where("r is not null")
    return r.groupBy("taxon_key", "tile").agg(F.max_by(F.struct("driver", "r"), F.struct(F.round(F.abs("r"), 9), F.col("driver"))).alias("b")).select("taxon_key", "tile", "b.driver", F.signum("b.r").alias("sign"))


def top_reasons(reasons: DataFrame, k: int = 2) -> DataFrame:
    """AGG-25: the k most frequent reasons per taxon (the report's own limit)."""
    n = reasons.groupBy("taxon_key", "driver").agg(F.count("*").alias("tiles"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("taxon_key").orderBy(F.desc("tiles"), "driver")).cast("long")).where(F.col("place") <= k)


def resolved_range(tiles: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """AGG-28: override, then the tiles' own range, then the unit's default."""
    own = tiles.groupBy("layer", "unit").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    o = overrides.select("layer", F.col("low").alias("_ol"), F.col("high").alias("_oh"))
    d = defaults.select("unit", F.col("low").alias("_dl"), F.col("high").alias("_dh"))
    return own.join(o, "layer", "left").join(d, "unit", "left").select("layer", F.coalesce("_ol", "_lo", "_dl").alias("low"), F.coalesce("_oh", "_hi", "_dh").alias("high"))


def region_cover(boxes: DataFrame) -> DataFrame:
    """MTH-17: the 10 degree cells that a box (south, north, west, east) meets."""
    cells = lambda a, b: F.sequence((F.floor(F.col(a) / 10) * 10).cast("int"), (F.floor(F.col(b) / 10) * 10).cast("int"), F.lit(10))
    rows = boxes.withColumn("lat0", F.explode(cells("south", "north")))
    return rows.withColumn("lon0", F.explode(cells("west", "east")))


def tile_pixels(spark, z: int, x: int, y: int, size: int) -> DataFrame:
    """RAS-04, MTH-16: the pixels of a Mercator tile (px from the west, py from the north) with the place of their centres."""
    span = 2 * WORLD / 2**z
    ids = spark.range(size * size).select(F.floor(F.col("id") / size).alias("py"), (F.col("id") % size).alias("px"))
    east = F.lit(-WORLD + x * span) + (F.col("px") + 0.5) * (span / size)
    north = F.lit(WORLD - y * span) - (F.col("py") + 0.5) * (span / size)
    lat = F.degrees(2 * F.atan(F.exp(north / WORLD * F.lit(3.141592653589793))) - F.lit(3.141592653589793) / 2)
    return ids.select("py", "px", lat.alias("lat"), (east / WORLD * 180).alias("lon"))


def overview_factor(step: float, z: int, size: int) -> int:
    """RAS-04: the largest power of two by which cells of `step` degrees may be thinned for pixels of a zoom level."""
    factor, pixel = 1, 360 / 2**z / size
    while factor * 2 * step <= pixel:
        factor *= 2
    return factor


def rendered(pixels: DataFrame, cells: DataFrame, top: float, left: float, step: float, categorical: bool = False, factor: int = 1) -> DataFrame:
    """RAS-04: pixels (lat, lon) with the value of a grid whose first cell begins at (top, left): the cell that holds the pixel's
    centre for classes, else the weighted mean of the four cells around it; from an overview if factor is above 1."""
    if factor > 1:
        cells, step = overview(cells, factor, categorical), step * factor
    y, x = (F.lit(top) - F.col("lat")) / step, (F.col("lon") - F.lit(left)) / step
    if categorical:
        return point_sample(pixels, cells, F.floor(y), F.floor(x)).drop("row", "col")
    return bilinear(pixels, cells, y - 0.5, x - 0.5)


def reprojected(spark, cells: DataFrame, source: tuple[float, float, float], target: tuple[float, float, float], rows: int, cols: int, flip: bool = False) -> DataFrame:
    """RAS-08: a grid on another one, by the four cells around each centre.  Grids are (top, left, step); with flip the source
    counts its rows from the south, and `top` is its southern edge."""
    top, left, step = target
    ids = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    lat, lon = F.lit(top) - (F.col("r") + 0.5) * step, F.lit(left) + (F.col("c") + 0.5) * step
    s_top, s_left, s_step = source
    y = (lat - s_top) / s_step if flip else (F.lit(s_top) - lat) / s_step
    got = bilinear(ids, cells, y - 0.5, (lon - s_left) / s_step - 0.5)
    return got.select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def cut_regions(cells: DataFrame, top: float, left: float, step: float) -> DataFrame:
    """RAS-05: a large grid as regions of ten degrees: the region's id, and row and column within it, from its north-west corner."""
    lat, lon = F.lit(top) - (F.col("row") + 0.5) * step, F.lit(left) + (F.col("col") + 0.5) * step
    south, west = F.floor(lat / 10) * 10, F.floor(lon / 10) * 10
    return cells.select(tile_id(lat, lon).alias("region"), F.floor((south + 10 - lat) / step).alias("row"), F.floor((lon - west) / step).alias("col"), "value")
