"""Registered queries: weather, formulas, names, grids, models, entry points, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import science, text
from ..operators import hierarchy, joins, models, raster, weather
from ..storage import shared_path
from . import api
from .core import METRIC, metric_table, rounded
from .domain import CLOSURE, TAXON, VIS, occurrence, query, t, taxon, visible

#: Hourly sums in whole cents: exact in any order of addition, so neither side rounds.
HOURLY = "hourly AS (SELECT event_type AS cell, date_trunc('hour', ts) AS hour, sum(round(value * 100))::DOUBLE AS value FROM events GROUP BY ALL)"


def hourly(spark, sf):
    cents = t(spark, sf, "events").select(F.col("event_type").alias("cell"), "ts", F.round(F.col("value") * 100).alias("value"))
    return weather.hourly(cents, ["cell"], "ts", "value", F.sum)


def epoch_hour(column: str = "hour"):
    return (F.unix_timestamp(column) / 3600).cast("long").alias("hour")


@query("WITH a AS (SELECT e.event_id, max(s.ts) AS st FROM events e JOIN events s ON s.event_type = 'view' AND s.user_id = e.user_id AND s.ts <= e.ts WHERE e.event_type <> 'view' GROUP BY e.event_id) SELECT e.event_id, epoch_us(a.st) AS seen FROM events e LEFT JOIN a USING (event_id) WHERE e.event_type <> 'view'")
def asof_series(spark, sf):
    """JON-05/06."""
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    right = e.where("event_type = 'view'").select("user_id", "ts", F.unix_micros("ts").alias("seen"))
    return joins.as_of(e.where("event_type != 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["seen"]).select("event_id", "seen")


@query("WITH p AS (SELECT e.event_id, min(abs(epoch_us(s.ts) - epoch_us(e.ts))) AS gap FROM events e LEFT JOIN events s ON s.event_type = 'view' AND s.user_id = e.user_id WHERE e.event_type <> 'view' GROUP BY e.event_id) SELECT event_id, gap FROM p")
def nearest_time(spark, sf):
    """JON-07, SRC-20."""
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    right = e.where("event_type = 'view'").select("user_id", "ts", F.unix_micros("ts").alias("valid"))
    got = joins.nearest_time(e.where("event_type != 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["valid"], "event_id")
    return got.select("event_id", F.abs(F.col("valid") - F.unix_micros("ts")).alias("gap"))


def trailing_sql(hours):
    w = ", ".join(f"sum(value) OVER w{h} AS sum_{h}h, sum(value) OVER w{h} / count(value) OVER w{h} AS avg_{h}h" for h in hours)
    d = ", ".join(f"w{h} AS (PARTITION BY cell ORDER BY hour RANGE BETWEEN INTERVAL {h - 1} HOUR PRECEDING AND CURRENT ROW)" for h in hours)
    return f"SELECT cell, epoch(hour)::BIGINT // 3600 AS hour, {w} FROM hourly WINDOW {d}"


@query(f"WITH {HOURLY} {trailing_sql(weather.WINDOWS)}")
def trailing_windows_7(spark, sf):
    """WIN-07/08, DAT-04."""
    got = weather.trailing(hourly(spark, sf), ["cell"])
    return got.select("cell", epoch_hour(), *[c for c in got.columns if c.startswith(("sum", "avg"))])


TWO = f"{HOURLY}, best AS (SELECT coalesce(a.hour, b.hour) AS hour, 'all' AS cell, coalesce(a.value, b.value) AS value FROM (SELECT * FROM hourly WHERE cell = 'purchase') a FULL JOIN (SELECT * FROM hourly WHERE cell = 'view') b ON a.hour = b.hour)"


@query(f"WITH {TWO}, hourly2 AS (SELECT * FROM best) {trailing_sql((24, 168)).replace('FROM hourly', 'FROM hourly2')}")
def two_source_window(spark, sf):
    """TMP-04/07: one source where it has the hour, else the other."""
    h = hourly(spark, sf)
    one = lambda c: h.where(F.col("cell") == c).select(F.lit("all").alias("cell"), "hour", "value")
    got = weather.trailing(weather.preferred(one("purchase"), one("view"), ["cell"]), ["cell"], (24, 168))
    return got.select("cell", epoch_hour(), *[c for c in got.columns if c.startswith(("sum", "avg"))])


@query(f"WITH {HOURLY}, s(shift) AS (VALUES (0), (1), (8), (24), (72), (168)), a AS (SELECT max(hour) AS anchor FROM hourly) SELECT cell, shift, sum(value) AS total, count(value) AS hours FROM hourly, s, a WHERE epoch(hour)::BIGINT // 3600 < epoch(anchor)::BIGINT // 3600 + shift AND epoch(hour)::BIGINT // 3600 >= epoch(anchor)::BIGINT // 3600 + shift - 240 GROUP BY cell, shift")
def shifted_windows(spark, sf):
    """TMP-06, DAT-07."""
    h = hourly(spark, sf)
    anchor = h.agg(F.max("hour")).first()[0]
    return weather.shifted(h, ["cell"], anchor, 240, (0, 1, 8, 24, 72, 168)).select("cell", "shift", "total", "hours")


@query("SELECT event_id, round(0.6108 * exp(17.27 * v / (v + 237.3)) - 0.6108 * exp(17.27 * d / (d + 237.3)), 6) AS vpd, round(greatest(0.6108 * exp(17.27 * v / (v + 237.3)) * (1 - least(greatest(h, 0), 100) / 100), 0), 6) AS vpd_rh FROM (SELECT event_id, fmod(value, 40) AS v, fmod(value, 40) - 3 AS d, fmod(value * 7, 120) AS h FROM events)")
def vpd(spark, sf):
    """MTH-01/02."""
    e = t(spark, sf, "events").select("event_id", (F.col("value") % 40).alias("v"), (F.col("value") * 7 % 120).alias("h"))
    return e.select("event_id", F.round(science.vapour_pressure_deficit(F.col("v"), F.col("v") - 3), 6).alias("vpd"), F.round(science.vapour_pressure_deficit(F.col("v"), F.col("h"), "humidity"), 6).alias("vpd_rh"))


@query("WITH x AS (SELECT event_id, fmod(value, 40) AS v, 1 + fmod(value * 7, 99) AS h FROM events), g AS (SELECT *, ln(h / 100) + 17.625 * v / (243.04 + v) AS g FROM x) SELECT event_id, round(243.04 * g / (17.625 - g), 6) AS dew FROM g")
def dew_point(spark, sf):
    """MTH-03."""
    e = t(spark, sf, "events")
    return e.select("event_id", F.round(science.dew_point(F.col("value") % 40, 1 + F.col("value") * 7 % 99), 6).alias("dew"))


@query("WITH x AS (SELECT event_id, fmod(value, 10) / 10 AS s, fmod(value * 3, 9) AS r, fmod(value * 5, 100) AS c, event_type FROM events), y AS (SELECT *, CASE WHEN event_type = 'view' THEN s ELSE 0.0 END AS sn FROM x) SELECT event_id, (CASE WHEN sn >= 0.8 THEN 75 WHEN sn >= 0.2 THEN 73 WHEN sn >= 0.01 THEN 71 WHEN r >= 7.6 THEN 65 WHEN r >= 2.5 THEN 63 WHEN r >= 1.3 THEN 61 WHEN r >= 1 THEN 55 WHEN r >= 0.5 THEN 53 WHEN r >= 0.01 THEN 51 WHEN c >= 80 THEN 3 WHEN c >= 50 THEN 2 WHEN c >= 20 THEN 1 ELSE 0 END)::INTEGER AS code FROM y")
def weather_code(spark, sf):
    """MTH-04."""
    e = t(spark, sf, "events")
    snow = F.when(F.col("event_type") == "view", F.col("value") % 10).otherwise(0.0)
    return e.select("event_id", science.weather_code(snow, F.col("value") * 3 % 9, F.col("value") * 5 % 100).alias("code"))


@query("SELECT event_id, round(value + coalesce(0.0065 * (CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id * 1.0 END - 100), 0), 6) AS corrected FROM events")
def lapse_correction(spark, sf):
    """MTH-05."""
    e = t(spark, sf, "events")
    model = F.when(F.col("user_id") % 5 == 0, -999.0).otherwise(F.col("user_id").cast("double"))
    return e.select("event_id", F.round(science.lapse_corrected(F.col("value"), model, F.lit(100.0)), 6).alias("corrected"))


@query("SELECT event_id, least(greatest(round_even((lat + 90) / 0.25, 0), 0), 720)::INTEGER AS r, least(greatest(round_even((90 - lat) / 0.25, 0), 0), 720)::INTEGER AS rd, 'lat' || (floor(lat / 10) * 10)::INTEGER || '_lon' || (floor(lon / 10) * 10)::INTEGER AS tile FROM (SELECT event_id, fmod(value * 13, 180) - 90 AS lat, fmod(value * 29, 360) - 180 AS lon FROM events)")
def grid_index(spark, sf):
    """MTH-06, PRJ-09."""
    e = t(spark, sf, "events").select("event_id", (F.col("value") * 13 % 180 - 90).alias("lat"), (F.col("value") * 29 % 360 - 180).alias("lon"))
    return e.select("event_id", science.grid_index(F.col("lat"), -90, 0.25, 721).alias("r"), science.grid_index(F.col("lat"), 90, 0.25, 721, descending=True).alias("rd"), science.tile_id(F.col("lat"), F.col("lon")).alias("tile"))


@query("SELECT p_partkey, x, y, round(-20037508.342789244::DOUBLE + x * 2 * 20037508.342789244::DOUBLE / 64, 3) AS \"left\", round(degrees(2 * atan(exp((20037508.342789244::DOUBLE - y * 2 * 20037508.342789244::DOUBLE / 64) / 20037508.342789244 * pi())) - pi() / 2), 6) AS north FROM (SELECT p_partkey, (p_partkey % 64) AS x, p_size % 64 AS y FROM part)")
def mercator_bounds(spark, sf):
    """MTH-16."""
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("x"), (F.col("p_size") % 64).alias("y"))
    b = science.mercator_bounds(F.lit(6.0), F.col("x"), F.col("y"))
    return p.select("p_partkey", "x", "y", F.round(b["left"], 3).alias("left"), F.round(b["north"], 6).alias("north"))


@query("SELECT p_partkey, (floor((d + 22.5) / 45)::INTEGER % 8 + 1)::INTEGER AS aspect, round(tan(radians(s)) * 100, 6) AS grade, CASE WHEN tan(radians(s)) * 100 >= 30 THEN 'extreme' WHEN tan(radians(s)) * 100 >= 20 THEN 'very strong' WHEN tan(radians(s)) * 100 >= 15 THEN 'strong' WHEN tan(radians(s)) * 100 >= 10 THEN 'moderate' WHEN tan(radians(s)) * 100 >= 5 THEN 'gentle' ELSE 'flat' END AS band FROM (SELECT p_partkey, fmod(p_retailprice, 360) AS d, p_size / 2 + 0.1 AS s FROM part)")
def aspect_and_slope_bands(spark, sf):
    """MTH-09/10/11/12."""
    p = t(spark, sf, "part")
    grade, band = science.slope_band(F.col("p_size") / 2 + 0.1)
    return p.select("p_partkey", science.aspect_bin(F.col("p_retailprice")).alias("aspect"), F.round(grade, 6).alias("grade"), band.alias("band"))


@query("SELECT p_partkey, round(p_size * 1.8 + 32, 6) AS fahrenheit, round(p_size * 1.8, 6) AS spread, round(p_retailprice / 25.4, 6) AS inches, p_retailprice AS other FROM part")
def unit_convert(spark, sf):
    """MTH-13/14/15."""
    c = science.convert
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return t(spark, sf, "part").select("p_partkey", F.round(c(size, "°C"), 6).alias("fahrenheit"), F.round(c(size, "°C", spread=True), 6).alias("spread"), F.round(c(price, "mm"), 6).alias("inches"), c(price, "furlong").alias("other"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(replace(p_name, '_', ' ')), '\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(p_brand, '([0-9]+)')::BIGINT AS number FROM part")
def name_normalize_slug(spark, sf):
    """STR-01/02/15."""
    return t(spark, sf, "part").select("p_partkey", text.normalized(F.col("p_name")).alias("name"), text.slug(F.col("p_type")).alias("slug"), text.observation_number(F.col("p_brand")).alias("number"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'SUBSPECIES' WHEN 1 THEN 'GENUS' WHEN 2 THEN 'SPECIES' ELSE 'TRIBE' END AS rank, CASE WHEN c_custkey % 3 = 0 THEN 'rain' END AS base, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END AS hours, CASE c_custkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Hidden' ELSE 'Obscured' END AS obscured FROM customer")
def rank_and_id_parse(spark, sf):
    """STR-03/12/13."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, " ssp.").when(k % 4 == 1, "gen").when(k % 4 == 2, "species").otherwise("tribe")
    base, _, hours = text.temporal_parts(F.when(k % 3 == 0, F.format_string("rain_sum_%dh", k)).otherwise("bio_1"))
    obscured = text.obscured_state(F.when(k % 3 == 1, "sensitive taxon").when(k % 3 == 2, "by the observer"))
    return t(spark, sf, "customer").select("c_custkey", text.canonical_rank(raw).alias("rank"), base.alias("base"), hours.alias("hours"), obscured.alias("obscured"))


@query()
def token_set_ratio(spark, sf):
    """STR-05: the library's own definition; tests hold it against a plain one."""
    p = t(spark, sf, "part")
    return p.select("p_partkey", text.token_set_ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


@query("WITH x AS (SELECT p_partkey, lower(p_name) AS name, string_split(lower(p_name), ' ')[1] AS q FROM part) SELECT p_partkey, (90 + CASE WHEN name = q THEN 20 ELSE 0 END - 2 * greatest(0, len(string_split(name, ' ')) - 1))::INTEGER AS score FROM x WHERE 90 + CASE WHEN name = q THEN 20 ELSE 0 END - 2 * greatest(0, len(string_split(name, ' ')) - 1) >= 70")
def score_adjust(spark, sf):
    """STR-06."""
    name = F.lower("p_name")
    score = text.adjusted_score(F.lit(90), name, F.get(F.split(name, " "), F.lit(0)))
    return t(spark, sf, "part").select("p_partkey", score.alias("score")).where("score is not null")


@query("WITH x AS (SELECT c_nationkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 25 ELSE 0 END AS score FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, lower(name)) AS place FROM x) SELECT c_nationkey, name, score::INTEGER AS score FROM r WHERE place = 1")
def name_rank(spark, sf):
    """STR-07."""
    c = t(spark, sf, "customer")
    score = text.common_name_score(F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("de"), F.lit(None).cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", "own").otherwise("other"))
    return c.select("c_nationkey", F.col("c_name").alias("name"), score.alias("score")).groupBy("c_nationkey").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.lower("name"))).alias("x")).select("c_nationkey", "x.*")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an')")
def location_substring(spark, sf):
    """STR-09/10, API-07."""
    return t(spark, sf, "nation").where(F.contains(text.without_accents(F.col("n_name")), F.lit("an"))).select("n_nationkey", "n_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS is_json FROM events")
def json_bag(spark, sf):
    """ARR-04/05."""
    e = t(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) is not null").alias("is_json"))


CELLS = "cell AS (SELECT l_partkey // 10 AS \"row\", l_suppkey % 10 AS col, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def cells(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.floor(F.col("l_partkey") / 10).alias("row"), (F.col("l_suppkey") % 10).alias("col")).agg(F.avg("l_quantity").alias("value"))


_NEAR = ", ".join(f"max(value) FILTER (a = {a} AND b = {b}) AS n{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1))


@query(f"""WITH {CELLS}, sent AS (SELECT "row" - a AS "row", col - b AS col, a, b, value FROM cell, range(-1, 2) x(a), range(-1, 2) y(b)), near AS (SELECT "row", col, {_NEAR} FROM sent GROUP BY "row", col HAVING count(*) = 9), g AS (SELECT "row", col, ((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20)) / 800 AS dx, ((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02)) / 800 AS dy FROM near) SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE fmod(degrees(atan2(dx, -dy)) + 180, 360) END, 4) AS aspect FROM g""")
def slope_aspect(spark, sf):
    """MTH-07."""
    got = raster.slope_aspect(cells(spark, sf), 100.0)
    return got.select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 4).alias("aspect"))


@query(f'WITH {CELLS} SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(value), 6) AS value FROM cell GROUP BY ALL')
def overview_pyramid(spark, sf):
    """RAS-06."""
    return rounded(raster.overview(cells(spark, sf), 4), "value")


@query(f'WITH {CELLS} SELECT p_partkey, round(value, 6) AS value FROM part LEFT JOIN cell ON "row" = p_partkey // 10 AND col = p_size % 12')
def point_sample(spark, sf):
    """RAS-01..03, JON-04/20."""
    got = raster.point_sample(t(spark, sf, "part").select("p_partkey", "p_size"), cells(spark, sf), F.floor(F.col("p_partkey") / 10), (F.col("p_size") % 12).cast("long"))
    return rounded(got.select("p_partkey", "value"), "value")


PIXEL = "px AS (SELECT l_returnflag AS taxon_key, l_partkey // 10 AS \"row\", l_suppkey % 10 AS col, l_quantity AS value, l_discount AS d1, l_tax AS d2 FROM lineitem)"


def pixels(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("taxon_key"), F.floor(F.col("l_partkey") / 10).alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("d1"), F.col("l_tax").alias("d2"))


@query(f'WITH {PIXEL} SELECT taxon_key, "row", col, round(avg(value), 6) AS value, count(value) AS n FROM px GROUP BY ALL')
def pixel_mean_by_group(spark, sf):
    """AGG-26."""
    return rounded(raster.mean_raster(pixels(spark, sf), "taxon_key"), "value")


@query(f'WITH {PIXEL}, x AS (SELECT taxon_key, "row" // 10 AS tile, avg(value) AS m FROM px GROUP BY ALL) SELECT taxon_key, round(avg(m), 6) AS score, count(*) AS tiles FROM x GROUP BY taxon_key')
def tile_scores(spark, sf):
    """AGG-22."""
    return rounded(raster.tile_scores(pixels(spark, sf), F.floor(F.col("row") / 10)), "score")


@query(f"""WITH {PIXEL}, u AS (SELECT taxon_key, "row" // 10 AS tile, value AS p, 'd1' AS driver, d1 AS x FROM px UNION ALL SELECT taxon_key, "row" // 10, value, 'd2', d2 FROM px),
r AS (SELECT taxon_key, tile, driver, corr(x, p) AS r FROM u GROUP BY ALL HAVING count(*) >= 10 AND stddev_pop(x) > 0 AND stddev_pop(p) > 0), b AS (SELECT taxon_key, tile, arg_max(driver, (round(abs(r), 9), driver)) AS driver FROM r GROUP BY ALL),
n AS (SELECT taxon_key, driver, count(*) AS tiles FROM b GROUP BY ALL) SELECT taxon_key, driver, tiles, row_number() OVER (PARTITION BY taxon_key ORDER BY tiles DESC, driver) AS place FROM n""")
def tile_reasons(spark, sf):
    """AGG-23..25: the top-2 report."""
    return raster.top_reasons(raster.tile_reasons(pixels(spark, sf), F.floor(F.col("row") / 10), ["d1", "d2"]))


@query("WITH o AS (SELECT p_brand AS layer, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) SELECT layer, CASE WHEN layer = 'Brand#11' THEN 0.0 ELSE lo END AS low, CASE WHEN layer = 'Brand#11' THEN 1.0 ELSE hi END AS high FROM o")
def range_resolution(spark, sf):
    """AGG-28."""
    tiles = t(spark, sf, "part").select(F.col("p_brand").alias("layer"), F.lit("mm").alias("unit"), F.col("p_retailprice").alias("low"), F.col("p_retailprice").alias("high"))
    return raster.resolved_range(tiles, spark.sql("select 'Brand#11' as layer, 0.0D as low, 1.0D as high"), spark.sql("select 'mm' as unit, -1.0D as low, 1.0D as high"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], [0.5::DOUBLE FOR i IN range(len(embedding))]), 4) AS score FROM embeddings")
def linear_score(spark, sf):
    """ML-07/08 on a feature vector."""
    e = t(spark, sf, "embeddings")
    n = e.select(F.size("embedding")).first()[0]
    return models.linear_score(e, "embedding", [0.5] * n).select("vec_id", F.round("score", 4).alias("score"))


@query("WITH s AS (SELECT least(value / 100, 1.0) AS score, (event_id % 3 = 0)::INT AS y FROM events), r AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS rk FROM s) SELECT count(*) AS n, round(avg(((score >= 0.5)::INT = y)::INT), 6) AS accuracy, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def model_metrics(spark, sf):
    """ML-05."""
    s = t(spark, sf, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_id") % 3 == 0).cast("long").alias("label"))
    return rounded(models.metrics(s), "accuracy", "auc").select("n", "accuracy", "auc")


@query()
def gbt_train_score(spark, sf):
    """ML-03/04/07: rows only, as boosted trees have no SQL."""
    e = t(spark, sf, "events").select("event_id", F.col("value").alias("v"), F.col("event_type").alias("kind"), (F.col("value") > 50).cast("double").alias("label"))
    rows = models.split(e, "event_id")
    model = models.pipeline(["v"], ["kind"]).fit(rows.where("is_train"))
    return models.scored(model, rows.where("not is_train")).select("event_id", "label", "score")


def catalog(spark, sf) -> api.Catalog:
    x = taxon(spark, sf)
    o = visible(occurrence(spark, sf))
    members = t(spark, sf, "supplier").selectExpr("'nation' as scope", "'N' || s_nationkey as gid", "'s' || s_suppkey as taxon_key", "1L as cnt")
    return api.Catalog(x, hierarchy.closure(x), metric_table(spark, sf).drop("context"), members, o)


@query(f"WITH {METRIC}, {CLOSURE[len(TAXON) + 2:]}, s AS (SELECT m.taxon_key, scientific_name, value, samples, row_number() OVER (ORDER BY value, m.taxon_key) - 1 AS pos FROM metric m JOIN taxon x ON x.taxon_key = m.taxon_key WHERE m.taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'r2' AND depth > 0)) SELECT taxon_key, scientific_name, value, samples, pos, count(*) OVER () AS total FROM s ORDER BY value DESC, taxon_key DESC LIMIT 5")
def query_taxa(spark, sf):
    """API-01: a page of suppliers of one region, highest first."""
    got = api.query_taxa(catalog(spark, sf), within="r2", rank="SUPPLIER", sort=("quantity", "mean"), descending=True, limit=5)
    return got.select("taxon_key", "scientific_name", "value", "samples", "pos", "total")


@query(f"WITH {VIS}, {CLOSURE} SELECT 'n5' AS taxon_key, count(price) AS n, round(avg(price) / 25.4, 4) AS mean, round(stddev_pop(price) / 25.4, 4) AS std FROM vis WHERE taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'n5') HAVING count(*) > 0")
def environment_stats(spark, sf):
    """API-02, MTH-15."""
    got = api.environment(catalog(spark, sf), "n5", "price", unit="mm", system="imperial")
    return got.select("taxon_key", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(f"WITH {TAXON} SELECT taxon_key, scientific_name, trim(regexp_replace(lower(scientific_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(rank) AS rank, CASE WHEN starts_with(path || '/', 'r0/') THEN 'africa' WHEN starts_with(path || '/', 'r2/') THEN 'asia' ELSE 'other' END AS taxon_group FROM taxon")
def taxon_serialize(spark, sf):
    """PRJ-17, HIE-18."""
    return api.serialized(taxon(spark, sf), [("r0", "africa"), ("r2", "asia")])


@query(f"WITH {HOURLY} {trailing_sql((24,))}")
def streamed_windows(spark, sf):
    """TMP-05, TMP-07..09: events as a stream; the final state gives the batch result."""
    from ..streaming.windows import Revisions, run_available

    home = shared_path(spark, "stream")
    hours = hourly(spark, sf)
    # Two arrivals of each hour: a wrong one of the fallback source, then the right one of the preferred source.
    both = hours.select("cell", "hour", F.lit(-1.0).alias("value"), F.lit(2).alias("priority"), F.lit(1).cast("long").alias("seq")).unionByName(hours.select("cell", "hour", "value", F.lit(1).alias("priority"), F.lit(2).cast("long").alias("seq")))
    both.write.parquet(f"{home}/in")
    sink = Revisions(spark, f"{home}/state")
    run_available(spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 4).parquet(f"{home}/in"), sink, f"{home}/offsets")
    got = sink.windows((24,))
    return got.select("cell", epoch_hour(), "sum_24h", "avg_24h")
