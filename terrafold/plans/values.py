"""Registered queries: masks, summaries, samples, dates, arrays, grids and models (FLT, AGG, WIN, DAT, ARR, MTH, RAS, TMP, ML)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import science, text
from ..operators import filters, hierarchy, models, ranking, raster, shaping, statistics, tallies, weather
from ..sources import tables
from ..streaming.windows import tumbling
from ..storage import shared_path
from .core import STATS, rounded, stats_sql
from .domain import CLOSURE, OCC, TAXON, VIS, occurrence, query, t, taxon, visible
from .more import CELLS, HOURLY, cells, hourly

_MASKED = "obs AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'Hidden' WHEN user_id % 9 <> 0 THEN 'No' END AS obscured, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS uncertainty_m, CASE WHEN event_id % 7 <> 0 THEN value END AS lat, value AS lon FROM events)"


def _masked(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", F.when(F.col("user_id") % 4 == 0, "Hidden").when(F.col("user_id") % 9 != 0, "No").alias("obscured"), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value") * 2).alias("uncertainty_m"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("lat"), F.col("value").alias("lon"))


@query(f"WITH {_MASKED} SELECT 'base' AS mask, event_id FROM obs WHERE obscured = 'No' AND uncertainty_m <= 500 AND lat IS NOT NULL UNION ALL SELECT 'index', event_id FROM obs WHERE obscured = 'No' UNION ALL SELECT 'stats', event_id FROM obs WHERE obscured = 'No' AND uncertainty_m <= 500")
def quality_masks(spark, sf):
    """FLT-01/02/03: with coordinates; only the tests whose columns are there; without coordinates, NaN excluded."""
    o = _masked(spark, sf)
    masks = {"base": filters.visible(o), "index": filters.visible(o.drop("uncertainty_m"), False), "stats": filters.visible(o, False)}
    parts = [df.select(F.lit(n).alias("mask"), "event_id") for n, df in masks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('N3', 'level0_gid', 'N3'), (' A.1_1 ', 'level1_gid', 'A.1_1'), ('A.1.2_1', 'level2_gid', 'A.1.2_1'), ('asia', 'gbif_region', 'ASIA'), ('NaN', NULL, NULL), ('', NULL, NULL), (' n/a', NULL, NULL)) v(gid, \"column\", value)")
def location_columns(spark, sf):
    """FLT-04/05: the column and value that an id selects; texts for no place select none."""
    asked = ("N3", " A.1_1 ", "A.1.2_1", "asia", "NaN", "", " n/a")
    found = [(g, *(filters.location_column(g, tables.REGIONS) or (None, None))) for g in asked]
    return spark.createDataFrame(found, "gid string, column string, value string")


@query("SELECT event_id, lat, lon FROM (SELECT event_id, fmod(value, 90) AS lat, fmod(value, 180) AS lon FROM events)")
def checked_upload(spark, sf):
    """FLT-14/15: an upload whose coordinates are in range and whose columns are not reserved passes whole; others raise."""
    e = t(spark, sf, "events").selectExpr("event_id", "cast(value % 90 as string) as lat", "cast(value % 180 as string) as lon")
    good = filters.checked_columns(filters.checked_coordinates(e), {"tile_id", "bio_1"})
    bad = (lambda: filters.checked_coordinates(e.withColumn("lat", F.lit("91"))), lambda: filters.checked_columns(e, {"lat"}))
    for check in bad:
        try:
            check()
        except ValueError:
            continue
        raise AssertionError("a wrong upload passed")
    return good.selectExpr("event_id", "cast(lat as double) as lat", "cast(lon as double) as lon")


@query("SELECT event_id, CASE WHEN event_id % 4 > 2 THEN value END AS value FROM events")
def finite_values(spark, sf):
    """FLT-16: NaN and infinities are no values."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return t(spark, sf, "events").select("event_id", filters.clean(raw).alias("value"))


@query(f"WITH {VIS}, {CLOSURE}, l AS (SELECT taxon_key, unnest(['quantity', 'price']) AS variable, unnest([quantity, price]) AS value FROM vis) SELECT ancestor, variable, {stats_sql('value')} FROM l JOIN closure ON descendant = taxon_key GROUP BY ALL")
def summary_by_rank(spark, sf):
    """AGG-01/04: leaves by one aggregation, taxa above them by ranges; both exact."""
    tree = hierarchy.closure(taxon(spark, sf)).select("ancestor", F.col("descendant").alias("taxon_key"))
    rows = statistics.tall(visible(occurrence(spark, sf)).select("taxon_key", "quantity", "price"), ["taxon_key"], ["quantity", "price"])
    got = statistics.summary_by_rank(rows.join(tree, "taxon_key"), ["ancestor", "variable"], F.startswith("ancestor", F.lit("s")))
    return rounded(got, *STATS)


@query(f"WITH {VIS}, l AS (SELECT taxon_key, unnest(['quantity', 'price', 'tax']) AS variable, unnest([quantity, price, tax]) AS value FROM vis) SELECT taxon_key, variable, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN variable = 'tax' THEN 'new' ELSE 'old' END AS version FROM l GROUP BY ALL")
def incremental_summaries(spark, sf):
    """AGG-05: only (taxon, variable) pairs that are not stored yet are summed up, and added."""
    home, rows = shared_path(spark, "summaries"), statistics.tall(visible(occurrence(spark, sf)).select("taxon_key", "quantity", "price", "tax"), ["taxon_key"], ["quantity", "price", "tax"])
    one = lambda df, v: rounded(df.groupBy("taxon_key", "variable").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean").withColumn("version", F.lit(v))
    tables.write(one(rows.where("variable != 'tax'"), "old"), home)
    old = spark.read.parquet(home)
    return old.unionByName(one(tables.missing_only(rows, old, ["taxon_key", "variable"]), "new"))


@query(f"WITH {OCC}, n AS (SELECT flag, count(*) AS n FROM occ GROUP BY 1) SELECT flag, obs_id, quantity AS value FROM occ JOIN n USING (flag) WHERE n <= 500 OR ('0x' || substr(md5(obs_id || '|' || flag), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n < 500")
def sample_cap_hash(spark, sf):
    """AGG-13: a sampling operator; its cap is the feature."""
    return statistics.sampled(occurrence(spark, sf).select("flag", "obs_id", F.col("quantity").alias("value")), ["flag"], "obs_id", 500)


@query(f"WITH {OCC} SELECT taxon_key, obs_id FROM (SELECT taxon_key, obs_id, row_number() OVER (PARTITION BY taxon_key ORDER BY md5('42:' || obs_id), obs_id) AS k FROM occ) WHERE k <= 30")
def per_group_cap(spark, sf):
    """SRT-08/09: a sampling operator; its cap is the feature."""
    return ranking.capped(occurrence(spark, sf).select("taxon_key", "obs_id"), "taxon_key", "obs_id", 30)


@query("WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS q FROM events) SELECT user_id, min(p) AS start, count(*) AS n, event_type FROM s GROUP BY user_id, event_type, p - q")
def run_lengths(spark, sf):
    """WIN-09: runs of equal events of a user."""
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return shaping.run_lengths(e, ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (epoch(date_trunc('day', ts)) + 45296)::BIGINT END AS at, CASE event_id % 3 WHEN 0 THEN 1700000000.0::DOUBLE WHEN 1 THEN 1700000000.5::DOUBLE ELSE 1704110400.0::DOUBLE END AS parsed, (round_even(epoch_us(date_trunc('second', ts)) / 1000000 / 3600.0::DOUBLE, 0) * 3600)::BIGINT AS snapped FROM events")
def event_times(spark, sf):
    """DAT-01/02/03/06: date part and time as seconds, numbers and ISO texts as seconds, the nearest hour."""
    k, day = F.col("event_id") % 3, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    clock = F.when(k == 0, "25:00:00").otherwise("12:34:56Z")
    raw = F.when(k == 0, "1700000000").when(k == 1, "1700000000500").otherwise("2024-01-01T12:00:00Z")
    return t(spark, sf, "events").select("event_id", text.event_time(F.concat(day, F.lit("T00:00")), clock).alias("at"), text.parsed_time(raw).alias("parsed"), science.snap_to_hour(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("snapped"))


@query("SELECT * FROM (VALUES (0, '__f000h'), (8, '__f008h'), (168, '__f168h')) v(hours, label)")
def forecast_labels(spark, sf):
    """DAT-07."""
    return spark.createDataFrame([(0,), (8,), (168,)], "hours int").select("hours", science.hour_offset_label(F.col("hours")).alias("label"))


@query("WITH x AS (SELECT l_suppkey, unnest(['quantity', 'tax']) AS variable, unnest([CASE WHEN l_tax < 0.04 THEN l_quantity END, l_tax]) AS value, l_orderkey * 8 + l_linenumber AS id FROM lineitem) SELECT l_suppkey, variable, (row_number() OVER (PARTITION BY l_suppkey, variable ORDER BY value, id) - 1)::INTEGER AS pos, id, value FROM x WHERE value IS NOT NULL")
def packed_structs(spark, sf):
    """ARR-01: (id, value) structs in value order in one array per group, and back."""
    li = t(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_tax") < 0.04, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    rows = li.unpivot(["l_suppkey", "id"], ["quantity", "tax"], "variable", "value").where("value is not null")
    return shaping.unpacked(shaping.packed(rows, ["l_suppkey"], "variable", ["id", "value"], ["value", "id"]))


@query("WITH x AS (SELECT l_suppkey, unnest(['quantity', 'tax']) AS variable, unnest([CASE WHEN l_tax < 0.04 THEN l_quantity END, l_tax]) AS value FROM lineitem), n AS (SELECT l_suppkey, variable, count(value) AS n FROM x GROUP BY ALL HAVING count(value) > 0) SELECT l_suppkey, variable, n::INTEGER AS length, max(n) OVER (PARTITION BY l_suppkey)::INTEGER AS padded FROM n")
def padded_arrays(spark, sf):
    """ARR-03: arrays of a group as long as the longest, with their true length."""
    li = t(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_tax") < 0.04, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    rows = li.unpivot(["l_suppkey", "id"], ["quantity", "tax"], "variable", "value").where("value is not null")
    got = shaping.padded(shaping.packed(rows, ["l_suppkey"], "variable", ["id", "value"], ["value", "id"]), ["l_suppkey"])
    return got.select("l_suppkey", "variable", "length", F.size("entries").alias("padded"))


@query("SELECT o_custkey, array_to_string([x FOR x, i IN list(o_orderpriority ORDER BY o_orderkey) IF list_position(list(o_orderpriority ORDER BY o_orderkey), x) = i], '|') AS joined FROM orders GROUP BY o_custkey")
def distinct_lists(spark, sf):
    """ARR-08: the first of equal entries, in order."""
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return o.select("o_custkey", shaping.joined_list(F.transform("x", lambda e: e["o_orderpriority"])).alias("joined"))


@query(f"""WITH {CELLS}, m AS (SELECT max("row") + 1 AS n FROM cell), d AS (SELECT "row", col, value, lag(value) OVER r AS up, lead(value) OVER r AS down, lag(value) OVER c AS l, lead(value) OVER c AS g FROM cell WINDOW r AS (PARTITION BY col ORDER BY "row"), c AS (PARTITION BY "row" ORDER BY col)),
e AS (SELECT "row", col, CASE WHEN up IS NULL AND down IS NULL THEN 0 WHEN up IS NULL THEN down - value WHEN down IS NULL THEN value - up ELSE (down - up) / 2 END / (0.01::DOUBLE * 111320.0::DOUBLE) AS dy, CASE WHEN l IS NULL AND g IS NULL THEN 0 WHEN l IS NULL THEN g - value WHEN g IS NULL THEN value - l ELSE (g - l) / 2 END / (0.01::DOUBLE * 111320.0::DOUBLE * cos(radians(50.0::DOUBLE - 0.01::DOUBLE * 20 / 2))) AS dx FROM d),
s AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM e) SELECT "row", col, round(slope, 9) AS slope, CASE WHEN slope > 0.001 THEN round(fmod(fmod(90 - degrees(atan2(dy, -dx)), 360) + 360, 360), 6) END AS aspect FROM s""")
def central_gradient(spark, sf):
    """MTH-08."""
    got = raster.central_gradient(cells(spark, sf), 0.01, 50.0, 20)
    return got.select("row", "col", F.round("slope", 9).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query("SELECT n_nationkey, lat0::INTEGER AS lat0, lon0::INTEGER AS lon0 FROM (SELECT n_nationkey, n_nationkey * 3.5 - 40 AS s, n_nationkey * 3.5 - 25 AS n, n_nationkey * 7.0 - 90 AS w, n_nationkey * 7.0 - 70 AS e FROM nation), range(-90, 90, 10) a(lat0), range(-180, 180, 10) b(lon0) WHERE lat0 <= n AND lat0 + 10 > s AND lon0 <= e AND lon0 + 10 > w")
def region_cover(spark, sf):
    """MTH-17."""
    k = F.col("n_nationkey")
    boxes = t(spark, sf, "nation").select("n_nationkey", (k * 3.5 - 40).alias("south"), (k * 3.5 - 25).alias("north"), (k * 7.0 - 90).alias("west"), (k * 7.0 - 70).alias("east"))
    return raster.region_cover(boxes).select("n_nationkey", "lat0", "lon0")


_PIXELS = "px AS (SELECT py, px, degrees(2 * atan(exp((20037508.342789244::DOUBLE - 2 * 5009377.085697311::DOUBLE - (py + 0.5::DOUBLE) * (5009377.085697311::DOUBLE / 16)) / 20037508.342789244::DOUBLE * pi())) - pi() / 2) AS lat, (-20037508.342789244::DOUBLE + 4 * 5009377.085697311::DOUBLE + (px + 0.5::DOUBLE) * (5009377.085697311::DOUBLE / 16)) / 20037508.342789244::DOUBLE * 180 AS lon FROM range(16) a(py), range(16) b(px))"


@query(f"WITH {CELLS}, {_PIXELS}, p AS (SELECT py, px, (66.0::DOUBLE - lat) / 4.5::DOUBLE AS y, lon / 4.5::DOUBLE AS x FROM px) SELECT py, px, round(value, 6) AS value FROM p LEFT JOIN cell ON \"row\" = floor(y) AND col = floor(x)")
def tile_classes(spark, sf):
    """RAS-04: a tile of classes: the cell that holds each pixel's centre."""
    got = raster.rendered(raster.tile_pixels(spark, 3, 4, 2, 16), cells(spark, sf), 66.0, 0.0, 4.5, categorical=True)
    return rounded(got.select("py", "px", "value"), "value")


@query(f"""WITH {CELLS}, {_PIXELS}, o AS (SELECT "row" // 2 AS "row", col // 2 AS col, avg(value) AS value FROM cell GROUP BY ALL), p AS (SELECT py, px, (66.0::DOUBLE - lat) / 2.0::DOUBLE - 0.5 AS y, lon / 2.0::DOUBLE - 0.5 AS x FROM px), k AS (SELECT * FROM p, range(2) a(a), range(2) b(b)),
h AS (SELECT py, px, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, value FROM k LEFT JOIN o ON "row" = floor(y) + a AND col = floor(x) + b) SELECT py, px, round(sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 6) AS value FROM h GROUP BY py, px""")
def tile_numbers(spark, sf):
    """RAS-04: a tile of numbers from an overview: the weighted mean of the four cells around each pixel's centre."""
    factor = raster.overview_factor(1.0, 3, 16)
    got = raster.rendered(raster.tile_pixels(spark, 3, 4, 2, 16), cells(spark, sf), 66.0, 0.0, 1.0, factor=factor)
    return rounded(got.select("py", "px", "value"), "value")


@query(f"""WITH {CELLS}, q AS (SELECT r, c, (60.0::DOUBLE - (r + 0.5::DOUBLE) * 1.5::DOUBLE - 40.0::DOUBLE) / 1.0::DOUBLE - 0.5 AS y, ((c + 0.5::DOUBLE) * 1.5::DOUBLE) / 1.0::DOUBLE - 0.5 AS x FROM range(10) a(r), range(6) b(c)), k AS (SELECT * FROM q, range(2) a(a), range(2) b(b)),
h AS (SELECT r, c, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, value FROM k LEFT JOIN cell ON "row" = floor(y) + a AND col = floor(x) + b) SELECT r AS "row", c AS col, round(sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 6) AS value FROM h GROUP BY r, c""")
def weather_regrid(spark, sf):
    """RAS-08: a grid that counts its rows from the south on a coarser one."""
    return rounded(raster.reprojected(spark, cells(spark, sf), (40.0, 0.0, 1.0), (60.0, 0.0, 1.5), 10, 6, flip=True), "value")


@query(f"WITH {CELLS}, c AS (SELECT 60.0::DOUBLE - (\"row\" + 0.5::DOUBLE) * 0.5::DOUBLE AS lat, -3.0::DOUBLE + (col + 0.5::DOUBLE) * 0.5::DOUBLE AS lon, value FROM cell) SELECT 'lat' || (floor(lat / 10) * 10)::INTEGER || '_lon' || (floor(lon / 10) * 10)::INTEGER AS region, floor((floor(lat / 10) * 10 + 10 - lat) / 0.5)::BIGINT AS \"row\", floor((lon - floor(lon / 10) * 10) / 0.5)::BIGINT AS col, round(value, 6) AS value FROM c")
def region_cut(spark, sf):
    """RAS-05: a grid cut into regions of ten degrees."""
    return rounded(raster.cut_regions(cells(spark, sf), 60.0, -3.0, 0.5), "value")


@query("WITH f AS (SELECT DISTINCT event_type, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM f) SELECT event_type, 0 AS hours, epoch_us(max(ts)) AS at FROM r WHERE k <= 2 GROUP BY 1 UNION ALL SELECT event_type, 72, epoch_us(arg_min(ts, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02') - 72 * 3600000000), ts))) FROM f GROUP BY 1")
def forecast_frames(spark, sf):
    """SRC-20: the frame for now, and the one nearest to three days on."""
    f = t(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).distinct()
    ref = F.lit("2024-01-02").cast("timestamp")
    one = lambda h: tallies.forecast_frame(f, ["event_type"], "ts", ref, h).select("event_type", F.lit(h).alias("hours"), F.unix_micros("ts").alias("at"))
    return one(0).unionByName(one(72))


@query("SELECT * FROM (VALUES ('bio_1', 'Mean', '°C', 'numeric', 'a|b'), ('wind_speed', 'Wind Speed', NULL, 'categorical', 'b'), ('sand', 'Sand', '%', 'numeric', NULL)) v(id, name, units, value_type, sources)")
def variable_listing(spark, sf):
    """PRJ-19: variables for display, and the sources that they come from."""
    v = spark.sql("select * from values ('bio_1', 'Mean', '°C', '', array('b', 'a'), 0), ('wind_speed', ' ', null, 'Categorical', array('b'), 1), ('sand', null, '%', null, null, 2) as t(id, name, units, value_type, source_ids, ord)")
    used = shaping.sources_used(v).select("source", F.explode("variables").alias("id")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("source")), "|").alias("sources"))
    return shaping.variables_shown(v).join(used, "id", "left").select("id", "name", "units", "value_type", "sources")


@query(f"WITH {CELLS} SELECT p_partkey, round(a.value, 6) AS quantity, round(a.value * 2, 6) AS twice FROM part LEFT JOIN cell a ON a.\"row\" = p_partkey // 10 AND a.col = p_size % 12")
def feature_matrix(spark, sf):
    """RAS-02/07, JON-16: the layers at points, one column each, in the model's order."""
    one = cells(spark, sf).withColumn("layer", F.lit("quantity"))
    stack = one.unionByName(one.withColumns({"layer": F.lit("twice"), "value": F.col("value") * 2}))
    p = t(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("row"), (F.col("p_size") % 12).cast("long").alias("col"))
    return rounded(raster.feature_stack(p, stack, ["quantity", "twice"]).select("p_partkey", "quantity", "twice"), "quantity", "twice")


@query("SELECT event_id, epoch_us(ts) AS at, value AS lat, value / 2 AS lon FROM events WHERE event_type <> 'error' AND user_id % 5 <> 0")
def observation_index(spark, sf):
    """TMP-01: rows that have a time and a place."""
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("lat"), (F.col("value") / 2).alias("lon"))
    return weather.observation_index(e, "at", "lat", "lon")


@query(f"WITH {HOURLY} SELECT cell, sum(CASE WHEN isnan(value) THEN 0 ELSE value END) AS total, count(DISTINCT hour) AS hours FROM hourly WHERE hour >= TIMESTAMP '2024-01-03' AND hour < TIMESTAMP '2024-01-10' GROUP BY cell")
def windowed_sums(spark, sf):
    """TMP-03: sums over [start, end), NaN as 0, and the hours that there are."""
    return weather.accumulated(hourly(spark, sf), ["cell"], "2024-01-03", "2024-01-10")


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(value) AS n FROM events GROUP BY ALL")
def tumbling_stream(spark, sf):
    """TMP-03: hourly counts of a stream with a watermark; all hours are read to the end."""
    home = shared_path(spark, "tumbling")
    e = t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    # The closing row moves the watermark past all others, so that append mode gives every hour.
    last = e.agg((F.max("ts") + F.expr("interval 10 days")).alias("ts")).withColumns({"event_type": F.lit("end"), "value": F.lit(0.0)})
    e.write.parquet(f"{home}/in")
    run = lambda: tumbling(spark.readStream.schema(e.schema).parquet(f"{home}/in"), "ts", "event_type", "value").writeStream.outputMode("append").option("checkpointLocation", f"{home}/offsets").option("path", f"{home}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    run()
    last.write.mode("append").parquet(f"{home}/in")
    run()
    got = spark.read.parquet(f"{home}/out").where("event_type != 'end'")
    return got.select(F.unix_timestamp("hour").alias("hour"), "event_type", "n")


@query("SELECT * FROM (VALUES ('sdm', 'numeric', 'bio_1,sand'), ('sdm', 'categorical', 'zone'), ('full', 'numeric', 'bio_1,sand,wind_avg_24h,wind_avg_168h'), ('full', 'categorical', 'zone'), ('phenology', 'numeric', 'wind_avg_24h,wind_avg_168h'), ('phenology', 'categorical', '')) v(mode, kind, features)")
def feature_specs(spark, sf):
    """ML-01/10: features of the catalogue by kind, and of each training mode."""
    layers = spark.sql("select * from values ('bio_1', 'climate', 'numeric', null, 0), ('zone', 'climate', 'Categorical', null, 1), ('wind', 'Temporal', 'numeric', 'avg', 2), ('code', 'temporal', 'categorical', 'snapshot', 3), ('sand', 'soil', null, null, 4) as t(id, category, value_type, agg, ord)")
    spec = models.feature_spec(layers, (24, 168))
    rows = [(m, k, ",".join(models.mode_features(spec, m)[k])) for m in models.MODES for k in ("numeric", "categorical")]
    return spark.createDataFrame(rows, "mode string, kind string, features string")


@query("WITH p AS (SELECT range AS id, (('0x' || substr(md5(range || ':lat42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 12 + 44 AS lat, (('0x' || substr(md5(range || ':lon42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 24 - 2 AS lon FROM range(1000)) SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM p WHERE NOT (lat BETWEEN 49 AND 51 AND lon BETWEEN 8 AND 12)")
def ring_negatives(spark, sf):
    """ML-02: points of the outer box that are not in the inner one."""
    return rounded9(models.ring_points(spark, 1000, (44.0, 56.0, -2.0, 22.0), (49.0, 51.0, 8.0, 12.0)))


def rounded9(df):
    return df.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("SELECT 400::BIGINT AS n, 400::BIGINT AS distinct_points, 0::BIGINT AS inside, true AS several_rings")
def negative_rounds(spark, sf):
    """ML-02: rings are tried, nearest first, until there are enough points that the mask keeps."""
    box = (49.0, 51.0, 8.0, 12.0)
    got = models.negatives(spark, 400, box, lambda p: p.where("id % 7 = 0"))
    inside = F.col("lat").between(49, 51) & F.col("lon").between(8, 12)
    return got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_points"), F.count_if(inside).alias("inside"), (F.max("ring") > 0).alias("several_rings"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY event_type) + 0.5) AS is_train FROM events")
def stratified_split(spark, sf):
    """ML-04: eight in ten rows of each class."""
    return models.split(t(spark, sf, "events").select("event_id", "event_type"), "event_id", label="event_type").select("event_id", "event_type", "is_train")


@query(f"WITH {TAXON}, {OCC}, c AS (SELECT taxon_key, count(*) AS samples FROM occ GROUP BY 1 HAVING count(*) >= 250), b AS (SELECT taxon_key, samples, substr(taxon_key, 2)::INT % 2 = 0 AS plant FROM c JOIN taxon USING (taxon_key) WHERE starts_with(path, 'r1/')), m AS (SELECT taxon_key, samples, plant, unnest([0, 1, 2]) AS o FROM b) SELECT taxon_key, samples, ['sdm', 'phenology', 'full'][o + 1] AS mode, row_number() OVER (ORDER BY samples DESC, taxon_key, o) - 1 AS place FROM m WHERE o = 0 OR (o = 1 AND plant) OR (o = 2 AND NOT plant)")
def batch_plan(spark, sf):
    """ML-09: which leaf taxa of a subtree are trained in which passes, most samples first."""
    x = taxon(spark, sf)
    counts = occurrence(spark, sf).groupBy("taxon_key").agg(F.count("*").alias("cnt"))
    return models.batch_plan(x, hierarchy.closure(x), counts, "r1", 250, ("SUPPLIER",), F.expr("cast(substr(taxon_key, 2) as int) % 2 = 0"))


@query(f"WITH {OCC} SELECT taxon_key, count(*) AS n, true AS learned, 3 AS weights FROM occ GROUP BY 1")
def batch_models(spark, sf):
    """ML-09: a model per taxon, trained side by side, that tells high from low quantities."""
    rows = occurrence(spark, sf).select("taxon_key", (F.col("quantity") > 25).cast("double").alias("label"), "quantity", "tax")
    got = models.batch_scores(rows, ["quantity", "tax"])
    return got.select("taxon_key", "n", (F.col("accuracy") > 0.9).alias("learned"), F.size("weights").alias("weights"))


@query("SELECT * FROM (VALUES ('', '7', 'taxon_7_gbt_sdm_2'), ('auto_gbt_full', '7', 'taxon_7_gbt_full'), ('auto_gbt_sdm', '8', 'taxon_8_gbt'), ('auto_gbt_full', '8', NULL), ('taxon_7_gbt_sdm_1', NULL, 'taxon_7_gbt_sdm_1'), ('taxon_7_gbt_sdm', NULL, 'taxon_7_gbt_sdm_2'), ('other', NULL, 'other'), ('nothing', NULL, NULL), ('', NULL, NULL)) v(model, taxon_key, name)")
def artifact_names(spark, sf):
    """ML-06: exact names, else the latest by prefix, else the older style."""
    registry = spark.createDataFrame([(n,) for n in ("taxon_7_gbt_sdm_1", "taxon_7_gbt_sdm_2", "taxon_7_gbt_full", "taxon_77_gbt_sdm_9", "taxon_8_gbt", "other")], "name string")
    asked = [("", "7"), ("auto_gbt_full", "7"), ("auto_gbt_sdm", "8"), ("auto_gbt_full", "8"), ("taxon_7_gbt_sdm_1", None), ("taxon_7_gbt_sdm", None), ("other", None), ("nothing", None), ("", None)]
    return spark.createDataFrame([(m, k, models.resolved_artifact(registry, m, k)) for m, k in asked], "model string, taxon_key string, name string")


@query("WITH a AS (SELECT p_partkey AS k, (p_size % 10) / 10.0::DOUBLE AS s FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, (p_size % 7) / 7.0::DOUBLE AS s FROM part WHERE p_partkey % 2 = 0) SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN a.s * b.s ELSE coalesce(a.s, b.s) END AS score FROM a FULL JOIN b ON a.k = b.k")
def composed_scores(spark, sf):
    """ML-08: the product of habitat and phenology where both are known."""
    p = t(spark, sf, "part")
    a = p.where("p_partkey % 3 != 0").select("p_partkey", ((F.col("p_size") % 10) / F.lit(10.0)).alias("score"))
    b = p.where("p_partkey % 2 = 0").select("p_partkey", ((F.col("p_size") % 7) / F.lit(7.0)).alias("score"))
    return models.composed(a, b, "p_partkey")


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v, CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind FROM events), m AS (SELECT quantile_cont(v, 0.5) AS med FROM x), k AS (SELECT arg_min(kind, (-n, kind)) AS top FROM (SELECT kind, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY 1)) SELECT event_id, coalesce(v, med) AS v, coalesce(kind, top) AS kind FROM x, m, k")
def imputed_features(spark, sf):
    """ML-03, PRJ-16: missing numbers by the median, missing classes by the most frequent one; a feature without any value goes."""
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("kind"), F.lit(None).cast("double").alias("empty"))
    kept = models.pruned(e, ["v", "empty"])
    return models.imputed(e, kept, ["kind"]).select("event_id", *kept, "kind")
