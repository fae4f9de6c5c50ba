"""Registered queries: shaping, counters, masks, grids and narrative rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, narrative, shaping, statistics, tallies
from .core import LEGEND, rounded
from .domain import CLOSURE, OCC, PLACES, TAXON, VIS, occurrence, places, query, t, taxon, visible
from .more import CELLS, cells


def _taxon_counts(spark, sf):
    return occurrence(spark, sf).groupBy("taxon_key").agg(F.count("*").alias("sample_count"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def footer_counts(spark, sf):
    """SRC-02: counts without columns, which the reader answers from footers."""
    one = [t(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("orders", "part")]
    return one[0].unionByName(one[1])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def ordered_columns(spark, sf):
    """PRJ-01/07."""
    return shaping.ordered(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "absent", "l_tax"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Observation #' || row_number() OVER (ORDER BY event_id) ELSE event_type END AS name FROM events")
def synthetic_names(spark, sf):
    """PRJ-08."""
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(" ").alias("name"))
    return shaping.with_names(e, "name", "event_id")


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS at, event_type = 'error' AS obscured, CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k')::BIGINT END AS k, event_type || '|' || user_id AS joined FROM events")
def derived_occurrence(spark, sf):
    """PRJ-10, ARR-06."""
    e = t(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("obscured"), F.when(F.col("event_type") == "view", k).alias("k"), shaping.joined_list(F.array("event_type", F.col("user_id").cast("string"), "event_type")).alias("joined"))


@query("SELECT s_suppkey::DOUBLE AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_acctbal, NULL, c_mktsegment FROM customer")
def harmonized_union(spark, sf):
    """PRJ-13/14, SET-01."""
    return shaping.harmonized(t(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_name as name"), t(spark, sf, "customer").selectExpr("c_acctbal as k", "c_mktsegment as segment"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_quantity AS l_shipdate_avg_24h FROM lineitem")
def stale_columns(spark, sf):
    """PRJ-02/15."""
    df = t(spark, sf, "lineitem").withColumn("l_shipdate_avg_24h", F.col("l_quantity"))
    return shaping.without_stale(df, "l_tax", {"l_returnflag", "l_shipdate"}).drop("l_shipdate")


@query(f"WITH {VIS} SELECT flag, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"min": "min(quantity)", "max": "max(quantity)", "mean": "avg(quantity)", "std": "stddev_pop(quantity)", **{k: f"quantile_cont(quantity, {p})" for k, p in (("p01", 0.01), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99))}}.items()) + ", count(quantity) AS n FROM vis GROUP BY flag")
def stored_summary(spark, sf):
    """PRJ-18, SNK-09."""
    got = shaping.stored_summary(statistics.summary(visible(occurrence(spark, sf)).select("flag", F.col("quantity").alias("value")), ["flag"]), ["flag"])
    return rounded(got, *[c for c in shaping.STORED if c != "n"])


@query("SELECT p_brand AS id, upper(p_brand) AS name, to_json(list_sort(list(DISTINCT p_type)))::VARCHAR AS source_ids FROM part WHERE p_brand != 'Brand#5' GROUP BY p_brand")
def variable_manifest(spark, sf):
    """SNK-14, PRJ-19, ARR-02."""
    v = t(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set("p_type")).alias("source_ids"))
    return shaping.manifest(v.withColumns({"category": F.col("id"), "name": F.upper("id")}), "Brand#5").select("id", "name", "source_ids")


@query(f"WITH {LEGEND} SELECT 'flag' AS variable, class_id AS code, 'name' AS metric, name AS label FROM legend UNION ALL SELECT 'flag', class_id, 'slug', slug FROM legend")
def class_lookup(spark, sf):
    """SNK-15."""
    from .core import legend

    return shaping.class_lookup(legend(spark).withColumn("variable", F.lit("flag")), ["name", "slug"])


@query(f"WITH {OCC}, {CLOSURE}, c AS (SELECT taxon_key, count(*) AS sample_count FROM occ GROUP BY 1) SELECT ancestor, rank, taxon.taxon_key, sample_count FROM closure JOIN taxon ON descendant = taxon_key JOIN c ON c.taxon_key = descendant WHERE depth > 0")
def descendant_catalog(spark, sf):
    """SNK-05."""
    x = taxon(spark, sf)
    return shaping.descendant_catalog(hierarchy.closure(x), x.select("taxon_key", "rank"), _taxon_counts(spark, sf))


@query(f"WITH {VIS} SELECT flag, 16::BIGINT AS point_count, min(quantity) AS min, max(quantity) AS max FROM vis GROUP BY flag")
def density_rows(spark, sf):
    """SNK-10, AGG-12."""
    grid = statistics.density(visible(occurrence(spark, sf)), ["flag"], "quantity", points=16)
    got = shaping.density_rows(grid, ["flag"])
    return got.where("size(points) = 16 and size(density) = 16").select("flag", "point_count", "min", "max")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS v FROM supplier")
def row_update(spark, sf):
    """JON-03, PRJ-14."""
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return shaping.updated(s, s.where("s_suppkey % 4 = 0").withColumn("v", F.col("v") * 2), ["s_suppkey"], ["v"])


@query("SELECT o_orderkey AS ext_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 't' || o_custkey ELSE 's' || o_custkey % 10 END AS owner FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def media_owner(spark, sf):
    """SRC-10, JON-11."""
    m = t(spark, sf, "orders").selectExpr("o_orderkey as ext_id", "o_orderpriority as rank", "'t' || o_custkey as taxon_key", "'s' || o_custkey % 10 as species_key")
    ids = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("ext_id")).distinct()
    return shaping.media_owner(m, ids, ("1-URGENT", "2-HIGH")).select("ext_id", "owner")


@query(f"""WITH {TAXON}, n AS (SELECT 's' || s_suppkey AS k, 0 AS later, 'ext ' || s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, 1, 'own ' || s_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT taxon_key, coalesce(string_agg(name, '|' ORDER BY later, name), '') AS names FROM taxon LEFT JOIN n ON k = taxon_key GROUP BY taxon_key""")
def vernacular_attach(spark, sf):
    """JON-14, SRC-08."""
    s = t(spark, sf, "supplier")
    names = s.where("s_suppkey % 2 = 0").selectExpr("'s' || s_suppkey as taxon_key", "'ext' as source", "'ext ' || s_name as name").unionByName(s.where("s_suppkey % 3 = 0").selectExpr("'s' || s_suppkey as taxon_key", "'own' as source", "'own ' || s_name as name"))
    return shaping.attached_names(taxon(spark, sf).select("taxon_key"), names, "ext").select("taxon_key", F.array_join("names", "|").alias("names"))


@query(f"WITH {OCC} SELECT taxon_key, count(*) AS n, any_value(CASE WHEN substr(taxon_key, 2)::INT % 3 = 0 THEN 70 + substr(taxon_key, 2)::INT % 7 END)::INTEGER AS match_score FROM occ GROUP BY taxon_key")
def matched_scores(spark, sf):
    """JON-17."""
    ranked = occurrence(spark, sf).groupBy("taxon_key").agg(F.count("*").alias("n"))
    k = F.expr("cast(substr(taxon_key, 2) as int)")
    return shaping.with_scores(ranked, ranked.where(k % 3 == 0).select("taxon_key", (70 + k % 7).alias("match_score")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, '_', ' ') WHEN p_partkey % 3 = 1 THEN p_type ELSE 'p' || p_partkey END AS label, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS image FROM part")
def shown_labels(spark, sf):
    """STR-16/17."""
    k = F.col("p_partkey")
    sci = F.when(k % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
    common = F.when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_type"), F.lit("  ")))
    image = shaping.first_text(shaping.first_of(F.array(F.lit(" "), F.when(k % 2 == 0, F.col("p_type")).otherwise(""))), F.col("p_brand"))
    return t(spark, sf, "part").select("p_partkey", shaping.shown_label(sci, common, F.concat(F.lit("p"), k.cast("string"))).alias("label"), image.alias("image"))


@query("SELECT l_suppkey, l_quantity, count(*) AS n, min(lo)::BIGINT AS \"left\", max(hi)::BIGINT AS \"right\", min(pos) = min(lo) AND max(pos) = max(hi) - 1 AS inside FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS lo, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS hi, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey * 8 + l_linenumber) - 1 AS pos FROM lineitem) GROUP BY l_suppkey, l_quantity")
def tie_blocks(spark, sf):
    """WIN-10."""
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    got = shaping.tie_block(rows, ["l_suppkey"], "l_quantity", "id").groupBy("l_suppkey", "l_quantity")
    return got.agg(F.count("*").alias("n"), F.min("left").alias("left"), F.max("right").alias("right"), ((F.min("pos") == F.min("left")) & (F.max("pos") == F.max("right") - 1)).alias("inside"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def first_in_order(spark, sf):
    """SRT-07: a report of the first five."""
    return shaping.first_rows(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 5)


@query("SELECT event_type, md5(epoch_us(max(ts)) || '|' || count(*)) AS token FROM events GROUP BY event_type")
def version_tokens(spark, sf):
    """DAT-08."""
    return shaping.version_token(t(spark, sf, "events"), ["event_type"], "ts")


@query("""WITH a AS (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem WHERE l_quantity > 49.5), b AS (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem WHERE l_tax >= 0.08 AND l_quantity > 45)
SELECT 's' || k AS taxon_key, source::INTEGER AS source, v AS value FROM (SELECT k, v, 0 AS source FROM a UNION ALL SELECT k, v, 1 FROM b WHERE k NOT IN (SELECT k FROM a))""")
def numeric_records(spark, sf):
    """API-10."""
    o = occurrence(spark, sf).select("taxon_key", F.col("quantity").alias("value"), "tax")
    return shaping.first_source(o.where("value > 49.5").drop("tax"), o.where("tax >= 0.08 and value > 45").drop("tax"))


@query(f"WITH {OCC}, {TAXON} SELECT taxon_key, coalesce(any_value(CASE WHEN substr(taxon_key, 2)::INT % 2 = 0 THEN 7 END), count(obs_id))::BIGINT AS samples FROM occ GROUP BY taxon_key")
def sample_counts(spark, sf):
    """AGG-15."""
    o = occurrence(spark, sf)
    s = o.select("taxon_key").distinct().where("cast(substr(taxon_key, 2) as int) % 2 = 0").withColumn("n", F.lit(7))
    return tallies.sample_count(s, o, "taxon_key")


@query("WITH c AS (SELECT c_nationkey AS taxon_key, 'seg' AS scope, c_mktsegment AS gid, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN c_custkey ELSE -1 END AS n FROM customer) SELECT taxon_key, scope, gid, sum(n)::BIGINT AS cnt FROM c WHERE n > 0 GROUP BY ALL")
def taxon_place_counts(spark, sf):
    """AGG-17."""
    rows = t(spark, sf, "customer").selectExpr("c_nationkey as taxon_key", "'seg' as scope", "c_mktsegment as gid", "case c_custkey % 4 when 0 then null when 1 then 'x' when 2 then cast(c_custkey as string) else '-1' end as cnt")
    return tallies.place_counts(rows, "taxon_key")


@query(f"WITH {OCC}, g AS (SELECT taxon_key, CASE flag WHEN 'R' THEN 'open' WHEN 'A' THEN 'wood' ELSE 'open' END AS class_group, avg(tax) AS mean, count(*) AS pixels FROM occ GROUP BY ALL HAVING count(*) >= 3) SELECT taxon_key, class_group, round(mean, 6) AS mean, pixels FROM (SELECT *, row_number() OVER (PARTITION BY taxon_key ORDER BY round(mean, 9) DESC, class_group DESC) AS k FROM g) WHERE k = 1")
def group_reason(spark, sf):
    """AGG-24."""
    groups = spark.sql("select * from values ('R', 'open'), ('A', 'wood'), ('N', 'open') as t(class_id, class_group)")
    return rounded(tallies.group_reason(occurrence(spark, sf).select("taxon_key", F.col("flag").alias("class_id"), F.col("tax").alias("value")), groups, ["taxon_key"]), "mean")


@query(f"WITH {CELLS} SELECT col % 3 AS band, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM cell GROUP BY 1")
def colour_ranges(spark, sf):
    """AGG-27."""
    return rounded(tallies.colour_range(cells(spark, sf).withColumn("band", F.col("col") % 3), ["band"]), "low", "high")


_BOX = "SELECT l_suppkey AS k, fmod(l_extendedprice, 150) - 75 AS lat, l_quantity / 250 AS lon FROM lineitem"


def _points(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_extendedprice") % 150 - 75).alias("lat"), (F.col("l_quantity") / 250).alias("lon"))


@query(f"WITH p AS ({_BOX}), b AS (SELECT k, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM p GROUP BY k) SELECT k, round((s + n) / 2 - greatest(n - s, 0.25) / 2, 6) AS south, round((s + n) / 2 + greatest(n - s, 0.25) / 2, 6) AS north, round((w + e) / 2 - greatest(e - w, 0.25) / 2, 6) AS west, round((w + e) / 2 + greatest(e - w, 0.25) / 2, 6) AS east FROM b")
def bounding_boxes(spark, sf):
    """AGG-31."""
    return rounded(tallies.bounding_box(_points(spark, sf), ["k"]), "south", "north", "west", "east")


@query(f"WITH p AS ({_BOX}), b AS (SELECT k, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM p GROUP BY k), c AS (SELECT k, (s + n) / 2 AS y, greatest(n - s, 0.25) / 2 * 3 + 0.5 AS h, (w + e) / 2 AS x, greatest(e - w, 0.25) / 2 * 3 + 0.5 AS g FROM b) SELECT k, round(greatest(least(y - h, 89.999), -89.999), 6) AS south, round(greatest(least(y + h, 89.999), -89.999), 6) AS north, round(greatest(least(x - g, 179.999), -179.999), 6) AS west, round(greatest(least(x + g, 179.999), -179.999), 6) AS east FROM c")
def grown_boxes(spark, sf):
    """MTH-19."""
    return rounded(tallies.grown(tallies.bounding_box(_points(spark, sf), ["k"]), 3.0, 0.5), "south", "north", "west", "east")


@query("WITH h AS (SELECT c_mktsegment AS rank, c_custkey % 3 AS hits, c_custkey % 5 = 0 AS conflict FROM customer) SELECT rank, count(*) AS total, count(*) FILTER (hits = 1) AS matched, count(*) FILTER (hits > 1) AS ambiguous, count(*) FILTER (hits = 0) AS unmatched, count(*) FILTER (conflict) AS conflict FROM h GROUP BY rank")
def match_quality(spark, sf):
    """AGG-32."""
    return tallies.match_quality(t(spark, sf, "customer").selectExpr("c_mktsegment as rank", "nullif(c_custkey % 3, 0) as hits", "c_custkey % 5 = 0 as conflict"))


@query("WITH d(i, c, a) AS (VALUES (0, 'N', 'N'), (1, 'NE', 'N'), (1, 'NE', 'E'), (2, 'E', 'E'), (3, 'SE', 'S'), (3, 'SE', 'E'), (4, 'S', 'S'), (5, 'SW', 'S'), (5, 'SW', 'W'), (6, 'W', 'W'), (7, 'NW', 'N'), (7, 'NW', 'W')), t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, l_partkey % 8 AS i, count(*) AS c FROM lineitem GROUP BY ALL) SELECT s.l_suppkey, a AS direction, sum(s.c) / any_value(n) AS share, any_value(n) AS n, sum(s.c) / any_value(n) > 0.4 AND any_value(n) > 100 AS preferred FROM s JOIN t USING (l_suppkey) JOIN d ON d.i = s.i GROUP BY s.l_suppkey, a")
def aspect_preferences(spark, sf):
    """AGG-33."""
    li = t(spark, sf, "lineitem").select("l_suppkey", F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.col("l_partkey") % 8 + 1).cast("int")).alias("aspect"))
    s = li.groupBy("l_suppkey", "aspect").agg(F.count("*").alias("count")).join(li.groupBy("l_suppkey").agg(F.count("*").alias("n")), "l_suppkey")
    return tallies.aspect_preference(s, ["l_suppkey"], 0.4).select("l_suppkey", "direction", "share", "n", "preferred")


@query(f"WITH {CLOSURE} SELECT taxon_key, rank FROM taxon JOIN closure ON descendant = taxon_key WHERE ancestor = 'r1' AND depth > 0 AND rank = 'SUPPLIER'")
def rank_scope(spark, sf):
    """FLT-11."""
    x = taxon(spark, sf)
    return tallies.of_rank(x, hierarchy.closure(x), "r1", "SUPPLIER").select("taxon_key", "rank")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 7 != 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def leaf_ingest(spark, sf):
    """FLT-13, SRC-07/09."""
    o = t(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority as rank", "o_custkey as taxon_key", "if(o_custkey % 7 = 0, ' ', o_orderstatus) as status")
    return tallies.ingestible(o, t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("taxon_key")), ["status"], ("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_brand), 'brand#(1|2)') AND lower(p_type) IN ('economy', 'standard') AND p_partkey % 5 != 0")
def usable_media(spark, sf):
    """FLT-17."""
    m = t(spark, sf, "part").selectExpr("p_partkey", "p_brand as licence", "p_type as kind", "if(p_partkey % 5 = 0, '', p_name) as url")
    return tallies.usable_media(m, "brand#(1|2)", ("economy", "standard")).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT list_has_any(string_split(lower(p_name), ' '), ['cold', 'small'])")
def clean_names(spark, sf):
    """FLT-18."""
    return tallies.without_words(t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["cold", "small"])


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END AS dated, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS valid, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE value END AS snow FROM events")
def nodata_and_date_floor(spark, sf):
    """FLT-19/20, DAT-02."""
    raw = F.when(F.col("user_id") % 10 == 0, float("nan")).when(F.col("user_id") % 5 == 0, -9999.0).otherwise(F.col("value"))
    return t(spark, sf, "events").select("event_id", tallies.from_date(F.col("value"), F.col("ts"), "2024-01-15").alias("dated"), tallies.valid(raw, -9999.0).alias("valid"), tallies.valid(raw, -9999.0, True).alias("snow"))


@query("WITH x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 210 WHEN 1 THEN 10 END AS c, p_size - 20 AS e FROM part) SELECT p_partkey, NOT coalesce(c = 210 AND abs(e) <= 10, false) AS land, coalesce(c = 210, false) OR (c IS NULL AND e < 1) AS ocean FROM x")
def ocean_masks(spark, sf):
    """FLT-21."""
    cover, e = F.when(F.col("p_size") % 3 == 0, 210).when(F.col("p_size") % 3 == 1, 10), F.col("p_size") - 20
    return t(spark, sf, "part").select("p_partkey", tallies.land_candidate(cover, e).alias("land"), tallies.ocean(cover, e).alias("ocean"))


@query("SELECT 's' || s_suppkey AS gid FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def places_below_name(spark, sf):
    """HIE-10: no id and no parent is named so among the suppliers; an ancestor is."""
    x = taxon(spark, sf).select(F.col("taxon_key").alias("gid"), F.col("scientific_name").alias("name"), F.col("parent_key").alias("parent_gid"))
    return tallies.places_below(hierarchy.ancestry(x).where("gid like 's%'"), "Asia").select("gid")


@query("SELECT event_id, CASE WHEN v <= 0.5 THEN floor(v / 0.5 * 200 + 0.5)::INTEGER ELSE 200::INTEGER END AS r, CASE WHEN v <= 0.5 THEN 10 ELSE floor(10 + (v - 0.5) / 0.5 * 200 + 0.5)::INTEGER END AS g FROM (SELECT event_id, least(greatest(value / 400, 0.0), 1.0) AS v FROM events)")
def colour_ramp(spark, sf):
    """MTH-18."""
    c = tallies.ramp(F.col("value") / 400, [(0.0, (0, 10, 0)), (0.5, (200, 10, 0)), (1.0, (200, 210, 255))])
    return t(spark, sf, "events").select("event_id", c["r"].alias("r"), c["g"].alias("g"))


@query(f"""WITH {CELLS}, p AS (SELECT p_partkey, p_partkey / 11.0::DOUBLE AS y, p_size / 7.0::DOUBLE AS x FROM part), k AS (SELECT * FROM p, range(2) a(a), range(2) b(b)),
h AS (SELECT p_partkey, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, value FROM k LEFT JOIN cell ON "row" = floor(y) + a AND col = floor(x) + b)
SELECT p_partkey, round(sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 6) AS value FROM h GROUP BY p_partkey""")
def bilinear_resample(spark, sf):
    """RAS-04/08."""
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") / F.lit(11.0)).alias("y"), (F.col("p_size") / F.lit(7.0)).alias("x"))
    return rounded(tallies.bilinear(p, cells(spark, sf), F.col("y"), F.col("x")), "value").select("p_partkey", "value")


@query('SELECT l_partkey // 10 AS "row", l_suppkey % 10 AS col, arg_max(l_quantity, (l_orderkey * 8 + l_linenumber, l_quantity)) AS value FROM lineitem GROUP BY ALL')
def mosaic_last(spark, sf):
    """RAS-04/05."""
    x = t(spark, sf, "lineitem").select(F.floor(F.col("l_partkey") / 10).alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return tallies.mosaic(x, "at")


_CHUNKS = "chunk AS (SELECT event_type AS source, user_id AS name, min(ts) AS \"start\", max(ts) AS \"end\" FROM events GROUP BY ALL)"


def _chunks(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("name")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


@query(f"WITH {_CHUNKS}, r AS (SELECT *, min(\"start\") OVER (PARTITION BY source ORDER BY \"start\" DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM chunk) SELECT source, name FROM r WHERE newer IS NULL OR newer > TIMESTAMP '2024-01-10'")
def chunk_cover(spark, sf):
    """SRC-18, TMP-01."""
    return tallies.covering_chunks(_chunks(spark, sf), F.lit("2024-01-10").cast("timestamp_ntz")).select("source", "name")


@query(f"WITH {_CHUNKS} SELECT source, name FROM chunk WHERE NOT (source IN ('view', 'click') AND \"end\" >= TIMESTAMP '2024-01-05' AND \"start\" <= TIMESTAMP '2024-01-06')")
def expired_chunks(spark, sf):
    """TMP-09."""
    w = spark.sql("select of_source, timestamp_ntz '2024-01-05' as since, timestamp_ntz '2024-01-06' as until from values ('view'), ('click') as t(of_source)")
    return tallies.expired(_chunks(spark, sf), w).select("source", "name")


@query("WITH x AS (SELECT user_id, count(value) FILTER (user_id % 3 != 0) AS a, count(value) FILTER (user_id % 2 != 0) AS b FROM events GROUP BY 1) SELECT user_id, concat_ws('|', CASE WHEN a = 0 THEN 'a' END, CASE WHEN b = 0 THEN 'b' END) AS missing FROM x WHERE a = 0 OR b = 0")
def enrichment_plan(spark, sf):
    """TMP-02."""
    e = t(spark, sf, "events").select("user_id", F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 2 != 0, F.col("value")).alias("b"))
    return tallies.missing_targets(e, "user_id", ["a", "b"]).withColumn("missing", F.array_join("missing", "|"))


@query("SELECT user_id, round(arg_max(value, (ts, value)) * 1.8 + 32, 6) AS fahrenheit FROM events GROUP BY user_id")
def live_snapshot(spark, sf):
    """TMP-10."""
    return tallies.snapshot(t(spark, sf, "events"), ["user_id"], "ts", "value").select("user_id", F.round(F.col("value") * 1.8 + 32, 6).alias("fahrenheit"))


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS y, (datediff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)) * 8)::BIGINT AS steps FROM orders")
def year_steps(spark, sf):
    """DAT-05."""
    y = t(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return y.select(F.col("y").cast("long").alias("y"), tallies.steps_in_year(F.col("y"), 10_800).alias("steps"))


def _bands(expr: str, bands: list[tuple[float, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {expr} >= {a} THEN '{w}'" for a, w in reversed(bands)) + " ELSE '' END"


def _said(delta: str, degree: str, more: str, less: str) -> str:
    return f"CASE WHEN {degree} = '' THEN 'about the same' ELSE {degree} || CASE WHEN {delta} > 0 THEN ' {more}' ELSE ' {less}' END END || ' in ' || level0"


@query(f"""WITH {PLACES}, g AS (SELECT flag, avg(quantity) AS q, avg(tax) AS x FROM places GROUP BY 1), h AS (SELECT flag, level0, avg(quantity) AS q, avg(tax) AS x FROM places GROUP BY ALL), d AS (SELECT flag, level0, round(h.q - g.q, 9) AS d, (h.x - g.x) AS e, g.x AS b FROM h JOIN g USING (flag))
SELECT flag, level0, {_said('d', _bands('abs(d)', [(0.5, 'slightly'), (1.5, 'a bit'), (3.0, 'noticeably'), (5.0, 'much')]), 'warmer', 'cooler')} AS warm, {_said('e', _bands('round(abs(e) / b, 9)', [(0.10, 'slightly'), (0.25, 'a bit'), (0.50, 'noticeably'), (0.80, 'much')]), 'wetter', 'drier')} AS wet, {_said('d', _bands('abs(d * 20)', [(5.0, 'slightly'), (20.0, 'a bit'), (60.0, 'noticeably'), (150.0, 'much')]), 'snowier', 'less snowy')} AS snow,
CASE WHEN abs(d * 5) >= 2 THEN {_said('d', _bands('abs(d * 5)', [(2.0, 'slightly'), (5.0, 'a bit'), (10.0, 'noticeably'), (20.0, 'much')]), 'sandier', 'less sandy')} END AS soil FROM d""")
def local_comparison(spark, sf):
    """DSC-07."""
    p = places(spark, sf)
    g = p.groupBy("flag").agg(F.avg("quantity").alias("q"), F.avg("tax").alias("x"))
    d = p.groupBy("flag", "level0").agg(F.avg("quantity").alias("lq"), F.avg("tax").alias("lx")).join(g, "flag").withColumn("d", F.round(F.col("lq") - F.col("q"), 9))
    zero, place = F.lit(0.0), F.col("level0")
    return d.select("flag", "level0", narrative.temperature_here(F.col("d"), zero, place).alias("warm"), narrative.rain_here(F.col("lx"), F.col("x"), place).alias("wet"), narrative.snow_here(F.col("d") * 20, zero, place).alias("snow"), narrative.soil_here(F.lit("sand"), F.col("d") * 5, zero, place).alias("soil"))


def _shares(rows, key):
    n = rows.groupBy(key, F.col("flag").alias("class_name")).agg(F.count("*").alias("c"))
    return n.join(rows.groupBy(key).agg(F.count("*").alias("t")), key).select(key, "class_name", (F.col("c") / F.col("t")).alias("share"))


@query(f"""WITH {PLACES}, s AS (SELECT taxon_key, flag AS c, count(*) / sum(count(*)) OVER (PARTITION BY taxon_key) AS share FROM places GROUP BY taxon_key, flag), h AS (SELECT taxon_key, flag AS c, count(*) / sum(count(*)) OVER (PARTITION BY taxon_key) AS share FROM places WHERE level0 = 'N3' GROUP BY taxon_key, flag),
k AS (SELECT *, row_number() OVER (PARTITION BY taxon_key ORDER BY share DESC, c) AS r FROM s WHERE taxon_key IN (SELECT taxon_key FROM h)), d AS (SELECT k.taxon_key, k.c, r, round(coalesce(h.share, 0) - k.share, 9) AS d FROM k LEFT JOIN h USING (taxon_key, c) WHERE r <= 2),
v AS (SELECT *, CASE WHEN abs(d) >= 0.3 THEN 3 WHEN abs(d) >= 0.2 THEN 2 WHEN abs(d) >= 0.1 THEN 1 ELSE 0 END AS lv FROM d), b AS (SELECT taxon_key, lv, d > 0 AS up FROM v WHERE lv > 0 QUALIFY row_number() OVER (PARTITION BY taxon_key ORDER BY lv DESC, abs(d) DESC, r) = 1)
SELECT v.taxon_key, CASE any_value(v.lv) WHEN 3 THEN 'Much ' || CASE WHEN any_value(up) THEN 'more' ELSE 'less' END WHEN 2 THEN CASE WHEN any_value(up) THEN 'More' ELSE 'Less' END ELSE 'A bit ' || CASE WHEN any_value(up) THEN 'more' ELSE 'less' END END || ' common in ' || string_agg(c, ' and ' ORDER BY r) || ' when in N3' AS text
FROM v JOIN b ON v.taxon_key = b.taxon_key AND v.lv = b.lv AND (v.d > 0) = b.up GROUP BY v.taxon_key""")
def share_shifts(spark, sf):
    """DSC-06."""
    p = places(spark, sf)
    return narrative.share_shift(_shares(p, "taxon_key"), _shares(p.where("level0 = 'N3'"), "taxon_key"), "taxon_key", F.lit("N3"))


@query("SELECT l_suppkey, 'Elevation: ' || CASE WHEN round(a) = round(b) THEN round(a)::BIGINT::VARCHAR ELSE round(a)::BIGINT || ' to ' || round(b)::BIGINT END || ' m' AS elevation FROM (SELECT l_suppkey, quantile_cont(l_quantity, 0.1) AS a, quantile_cont(l_quantity, 0.9) AS b FROM lineitem GROUP BY 1)")
def range_texts(spark, sf):
    """DSC-05."""
    s = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", [0.1, 0.9]).alias("p"))
    return s.select("l_suppkey", narrative.range_row("Elevation", F.col("p")[0], F.col("p")[1], "m").alias("elevation"))


@query("WITH x AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part), y AS (SELECT DISTINCT l.a || ' ' || l.b AS one, r.a || ' ' || r.b AS two, l.a AS a, l.b AS b, r.a AS c, r.b AS d FROM x l JOIN x r ON l.b = r.b) SELECT one, two, a || ' and ' || c || ' ' || b AS merged FROM y")
def merged_labels(spark, sf):
    """DSC-03."""
    p = t(spark, sf, "part").select(F.split("p_name", " ").alias("w")).select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).distinct()
    two = p.select("a", "b").join(p.select(F.col("a").alias("c"), "b"), "b")
    text = two.select(F.concat_ws(" ", "a", "b").alias("one"), F.concat_ws(" ", "c", "b").alias("two"))
    return text.select("one", "two", narrative.parallel_label(F.col("one"), F.col("two")).alias("merged"))


@query("SELECT n_nationkey, 'Summary: The ' || lower(replace(n_name, '_', ' ')) || ' (' || replace(n_name, '_', ' ') || ') is a species of ' || r_name || '.' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Habitat: often in grasslands' ELSE '' END || chr(10) || 'Locations: Lies in ' || r_name || chr(10) || 'Soil Texture: ' || CASE WHEN n_nationkey % 3 = 0 THEN 'sandy.' ELSE 'Not notable.' END AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def profiles(spark, sf):
    """DSC-08, API-08."""
    n = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))
    none = F.lit(None).cast("string")
    who = n.select("n_nationkey", narrative.summary_sentence(F.col("n_name"), F.lower("n_name"), none, F.col("r_name")).alias("x"))
    habitat = n.where("n_nationkey % 2 = 0").select("n_nationkey", narrative.habitat_text(F.lit("Often in grassland ")).alias("x"))
    where = n.select("n_nationkey", F.concat(F.lit("Lies in "), F.col("r_name")).alias("x"))
    soil = n.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("sandy").alias("x"))
    return narrative.profile("n_nationkey", who, habitat, None, where, soil_texture=soil).select("n_nationkey", "text")
