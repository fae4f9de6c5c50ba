"""Scalar formulas as column expressions (MTH-01..19, PRJ-09, DAT-04..07). Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation_pressure(t: Column) -> Column:
    """kPa over water at t degrees Celsius."""
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def vapour_pressure_deficit(t: Column, moisture: Column, mode: str = "dew_point") -> Column:
    """MTH-01/02. dew_point: unclamped; clamped: not below 0; humidity: percent clipped to 0..100; live: to 1..100."""
    es = saturation_pressure(t)
    if mode == "dew_point":
        return es - saturation_pressure(moisture)
    if mode == "clamped":
        return F.greatest(es - saturation_pressure(moisture), F.lit(0.0))
    low = 1.0 if mode == "live" else 0.0
    share = F.when(moisture.isNotNull(), F.least(F.greatest(moisture, F.lit(low)), F.lit(100.0))) / 100
    return F.greatest(es - es * share, F.lit(0.0))


def dew_point(t: Column, humidity: Column) -> Column:
    """MTH-03; null for a humidity that is not positive."""
    g = F.ln(F.when(humidity > 0, humidity) / 100) + F.lit(17.625) * t / (F.lit(243.04) + t)
    return F.lit(243.04) * g / (F.lit(17.625) - g)


def stepped(value: Column, steps: list[tuple[float, object]], below: object) -> Column:
    """The label of the highest threshold that value reaches; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for limit, label in sorted(steps, key=lambda s: -s[0]):
        out = out.when(value >= limit, F.lit(label))
    return out.otherwise(F.lit(below))


#: The code of each rate of snow (water per hour), of rain (mm per hour) and of cloud cover (percent).
SNOW_CODES = [(0.01, 71), (0.2, 73), (0.8, 75)]
RAIN_CODES = [(0.01, 51), (0.5, 53), (1.0, 55), (1.3, 61), (2.5, 63), (7.6, 65)]
CLOUD_CODES = [(20.0, 1), (50.0, 2), (80.0, 3)]


def weather_code(snow_water: Column, rain: Column, cloud: Column) -> Column:
    """MTH-04: snow before rain before cloud; null if any input is."""
    snow = snow_water / 10
    missing = snow_water.isNull() | rain.isNull() | cloud.isNull()
    return F.when(missing, F.lit(None).cast("int")).when(snow >= SNOW_CODES[0][0], stepped(snow, SNOW_CODES, 0)).when(rain >= RAIN_CODES[0][0], stepped(rain, RAIN_CODES, 0)).otherwise(stepped(cloud, CLOUD_CODES, 0))


def lapse_corrected(value: Column, model_elevation: Column, target_elevation: Column) -> Column:
    """MTH-05: 6.5 K per km; a model elevation of -900 or less is missing; without elevations no correction."""
    m = F.when(model_elevation > -900, model_elevation)
    return value + F.coalesce(F.lit(0.0065) * (m - target_elevation), F.lit(0.0))


def grid_index(degrees: Column, origin: float, step: float, size: int, descending: bool = False) -> Column:
    """MTH-06: the nearest cell, halves to even, clipped to the grid."""
    at = (F.lit(origin) - degrees if descending else degrees - F.lit(origin)) / F.lit(step)
    return F.least(F.greatest(F.rint(at).cast("int"), F.lit(0)), F.lit(size - 1))


def aspect_bin(degrees: Column) -> Column:
    """MTH-09: 1 to 8, north first."""
    return (F.floor((F.pmod(degrees, F.lit(360.0)) + F.lit(22.5)) / 45) % 8 + 1).cast("int")


#: Slope grade bands in percent.
GRADES = [(5.0, "gentle"), (10.0, "moderate"), (15.0, "strong"), (20.0, "very strong"), (30.0, "extreme")]


def slope_band(degrees: Column) -> tuple[Column, Column]:
    """MTH-11: grade in percent and its band."""
    grade = F.tan(F.radians(degrees)) * 100
    return grade, stepped(grade, GRADES, "flat")


def tile_id(lat: Column, lon: Column) -> Column:
    """PRJ-09: the 10 degree cell that holds a point."""
    return F.concat(F.lit("lat"), (F.floor(lat / 10) * 10).cast("int").cast("string"), F.lit("_lon"), (F.floor(lon / 10) * 10).cast("int").cast("string"))


WORLD = 20037508.342789244


def mercator_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """MTH-16: EPSG:3857 bounds of a tile and the latitudes of its edges."""
    span = F.lit(2 * WORLD) / F.pow(F.lit(2.0), z)
    left, top = F.lit(-WORLD) + x * span, F.lit(WORLD) - y * span

    def latitude(m: Column) -> Column:
        return F.degrees(2 * F.atan(F.exp(m / WORLD * F.lit(3.141592653589793))) - F.lit(3.141592653589793) / 2)

    return {"left": left, "right": left + span, "top": top, "bottom": top - span, "north": latitude(top), "south": latitude(top - span), "west": left / WORLD * 180, "east": (left + span) / WORLD * 180}


#: Metric unit, imperial unit, factor, offset.
UNITS = [("°C", "°F", 1.8, 32.0), ("mm", "in", 1 / 25.4, 0.0), ("m", "ft", 1 / 0.3048, 0.0), ("km", "mi", 1 / 1.609344, 0.0), ("m/s", "mph", 1 / 0.44704, 0.0), ("kPa", "psi", 1 / 6.894757293168, 0.0), ("cm", "in", 1 / 2.54, 0.0), ("kg", "lb", 1 / 0.45359237, 0.0)]
SPREADS = ("std", "iqr", "range", "range_10_90", "range_1_99", "value_range", "bandwidth")


def convert(value: Column, unit: str, to: str = "imperial", spread: bool = False) -> Column:
    """MTH-14: affine for values, factor only for spreads; unknown units pass through."""
    for metric, imperial, factor, offset in UNITS:
        if to == "imperial" and unit == metric:
            return value * factor + (0.0 if spread else offset)
        if to == "metric" and unit == imperial and (metric, imperial) != ("cm", "in"):
            return (value - (0.0 if spread else offset)) / factor
    return value


def hour_offset_label(hours: Column) -> Column:
    """DAT-07."""
    return F.format_string("__f%03dh", hours.cast("int"))


def snap_to_hour(ts: Column) -> Column:
    """DAT-06: nearest hour, halves to even, as epoch seconds."""
    return (F.rint(F.unix_timestamp(ts) / 3600) * 3600).cast("long")
