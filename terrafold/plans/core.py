"""Registered queries: summaries, filters, hierarchy, ranks, joins, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, hierarchy, joins, ranking, statistics
from .domain import CLOSURE, OCC, PLACES, TAXON, VIS, occurrence, places, query, t, taxon, visible

R = 6


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


STATS = ("min", *statistics.NAMES, "max", "mean", "std", "iqr", "range_10_90", "range_1_99", "value_range")


def stats_sql(v: str) -> str:
    q = {n: f"quantile_cont({v}, {p})" for n, p in zip(statistics.NAMES, statistics.POINTS, strict=True)}
    e = {"min": f"min({v})", **q, "max": f"max({v})", "mean": f"avg({v})", "std": f"stddev_pop({v})", "iqr": f"{q['p75']} - {q['p25']}", "range_10_90": f"{q['p90']} - {q['p10']}", "range_1_99": f"{q['p99']} - {q['p01']}", "value_range": f"max({v}) - min({v})"}
    return f"count({v}) AS n, " + ", ".join(f"round({x}, {R}) AS {n}" for n, x in e.items())


@query(f"WITH {VIS}, {CLOSURE} SELECT 'r1' AS ancestor, 'quantity' AS variable, {stats_sql('quantity')} FROM vis WHERE taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'r1')")
def summary_by_subtree(spark, sf):
    """AGG-01, HIE-03, FLT-01: scan, quality filter, subtree semi-join, exact summary."""
    rows = hierarchy.in_subtree(visible(occurrence(spark, sf)), hierarchy.closure(taxon(spark, sf)), "r1")
    one = rows.select(F.lit("r1").alias("ancestor"), F.lit("quantity").alias("variable"), F.col("quantity").alias("value"))
    return rounded(statistics.summary(one, ["ancestor", "variable"]), *STATS)


@query(f"WITH {VIS}, {CLOSURE}, l AS (SELECT taxon_key, unnest(['quantity', 'price', 'discount', 'tax']) AS variable, unnest([quantity, price, discount, tax]) AS value FROM vis) SELECT ancestor, variable, {stats_sql('value')} FROM l JOIN closure ON descendant = taxon_key WHERE ancestor NOT LIKE 's%' GROUP BY ALL")
def summary_exact_all_vars(spark, sf):
    """AGG-01/04, PRJ-11: every inner taxon, every variable."""
    tree = hierarchy.closure(taxon(spark, sf)).where("ancestor not like 's%'")
    rows = statistics.tall(visible(occurrence(spark, sf)).select("taxon_key", "quantity", "price", "discount", "tax"), ["taxon_key"], ["quantity", "price", "discount", "tax"])
    rows = rows.join(tree.select("ancestor", F.col("descendant").alias("taxon_key")), "taxon_key")
    return rounded(statistics.summary(rows, ["ancestor", "variable"]), *STATS)


@query(f"""WITH {VIS}, a AS (SELECT flag, fmod(price, 360) AS v FROM vis), m AS (SELECT flag, count(*) AS n, avg(sin(radians(v))) AS s, avg(cos(radians(v))) AS c FROM a GROUP BY flag),
k AS (SELECT *, fmod(degrees(atan2(s, c)) + 360, 360) AS mean FROM m), d AS (SELECT a.flag, fmod(v - mean + 540, 360) - 180 AS d FROM a JOIN k USING (flag))
SELECT flag, any_value(k.n) AS n, round(any_value(mean), 4) AS mean, round(any_value(degrees(sqrt(-2 * ln(sqrt(s * s + c * c))))), 4) AS std, round(fmod(any_value(mean) + quantile_cont(d, 0.1) + 360, 360), 4) AS p10, round(fmod(any_value(mean) + quantile_cont(d, 0.9) + 360, 360), 4) AS p90 FROM d JOIN k USING (flag) GROUP BY flag""")
def summary_circular(spark, sf):
    """AGG-02."""
    rows = visible(occurrence(spark, sf)).select("flag", F.pmod("price", F.lit(360.0)).alias("value"))
    return statistics.circular(rows, ["flag"]).select("flag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p90")])


@query(f"WITH {OCC} SELECT taxon_key, count(price) AS n, round(min(price), {R}) AS min, round(max(price), {R}) AS max, round(avg(price), {R}) AS mean, round(stddev_pop(price), {R}) AS std FROM occ GROUP BY taxon_key")
def summary_streaming_merge(spark, sf):
    """AGG-03: mergeable partial states."""
    got = statistics.summary(occurrence(spark, sf), ["taxon_key"], "price", exact=False)
    return rounded(got, "min", "max", "mean", "std").select("taxon_key", "n", "min", "max", "mean", "std")


@query(f"""WITH {VIS}, c AS (SELECT taxon_key, flag, count(*) AS cnt FROM vis GROUP BY ALL), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY taxon_key) AS share, sum(cnt) OVER (PARTITION BY taxon_key)::BIGINT AS total FROM c)
SELECT taxon_key, flag AS class, round(share, {R}) AS share, round_even(share * total, 0)::BIGINT AS cnt, row_number() OVER (PARTITION BY taxon_key ORDER BY share DESC, flag) AS place FROM s""")
def category_distribution(spark, sf):
    """AGG-06/07."""
    return rounded(statistics.distribution(statistics.category_metrics(visible(occurrence(spark, sf)), ["taxon_key"], "flag"), ["taxon_key"]), "share")


@query(f"""WITH {VIS}, c AS (SELECT taxon_key, flag, count(*) AS cnt FROM vis GROUP BY ALL), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY taxon_key) AS share FROM c)
SELECT taxon_key, 'class_' || flag AS metric, round(share, {R}) AS value FROM s UNION ALL SELECT taxon_key, 'total_samples', sum(cnt)::DOUBLE FROM s GROUP BY taxon_key UNION ALL SELECT taxon_key, 'unique_classes', count(*)::DOUBLE FROM s GROUP BY taxon_key
UNION ALL SELECT taxon_key, 'significant_unique_classes', count(*) FILTER (share >= 0.05)::DOUBLE FROM s GROUP BY taxon_key""")
def category_metrics(spark, sf):
    """AGG-06, SNK-09."""
    return rounded(statistics.category_metrics(visible(occurrence(spark, sf)), ["taxon_key"], "flag"), "value")


@query(f"WITH {PLACES} SELECT flag, count(*) AS cnt, array_to_string(list(obs_id ORDER BY obs_id)[1:3], ',') AS samples FROM places WHERE level0 = 'N3' GROUP BY flag")
def category_by_location(spark, sf):
    """AGG-08/09, FLT-04/10."""
    column, value = filters.location_column("N3")
    here = places(spark, sf).where(F.col({"level0_gid": "level0"}[column]) == value)
    return statistics.with_samples(here, [], "flag", "obs_id", 3).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("SELECT 'event_id' AS \"column\", count(*) FILTER (event_id IS NULL) AS nulls FROM events UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM events UNION ALL SELECT 'props', count(*) FILTER (props IS NULL) FROM events")
def null_counts(spark, sf):
    """AGG-14."""
    return statistics.null_counts(t(spark, sf, "events").select("event_id", "value", "props"))


@query(f"WITH {PLACES} SELECT scope, gid, taxon_key, count(*) AS cnt FROM (SELECT 'region' AS scope, region AS gid, taxon_key FROM places UNION ALL SELECT 'level0', level0, taxon_key FROM places) GROUP BY ALL")
def location_counts_unpivot(spark, sf):
    """AGG-16, SNK-11."""
    return statistics.location_counts(places(spark, sf), ["region", "level0"], "taxon_key")


@query(f"WITH {PLACES}, {CLOSURE} SELECT scope, gid, ancestor AS taxon_key, count(*) AS cnt FROM (SELECT 'region' AS scope, region AS gid, taxon_key FROM places UNION ALL SELECT 'level0', level0, taxon_key FROM places) p JOIN closure ON descendant = p.taxon_key GROUP BY ALL")
def rollup_to_ancestors(spark, sf):
    """HIE-11."""
    got = hierarchy.rolled_up(statistics.location_counts(places(spark, sf), ["region", "level0"], "taxon_key"), hierarchy.closure(taxon(spark, sf)))
    return got


@query(f"WITH {CLOSURE} SELECT ancestor, descendant, depth::INTEGER AS depth FROM closure")
def closure_recursive(spark, sf):
    """HIE-03/05 from parent pointers."""
    return hierarchy.recursive_closure(spark, taxon(spark, sf).select("taxon_key", "parent_key"))


@query(f"WITH {CLOSURE} SELECT ancestor, descendant, depth::INTEGER AS depth FROM closure")
def closure_from_path(spark, sf):
    """HIE-03/05/06 from paths."""
    return hierarchy.closure(taxon(spark, sf))


@query(f"WITH {TAXON} SELECT parent_key, string_agg(taxon_key, ',' ORDER BY taxon_key) AS children FROM taxon WHERE parent_key IS NOT NULL GROUP BY parent_key")
def children_by_parent(spark, sf):
    """HIE-01/02."""
    return hierarchy.children(taxon(spark, sf)).withColumn("children", F.array_join("children", ","))


@query(f"WITH {CLOSURE} SELECT ancestor, descendant, depth::INTEGER AS depth FROM closure JOIN taxon ON taxon_key = descendant WHERE rank = 'NATION' AND depth > 0")
def subtree_by_rank_pruned(spark, sf):
    """HIE-04/07."""
    x = taxon(spark, sf)
    return hierarchy.by_rank_pruned(hierarchy.closure(x), x.select("taxon_key", "rank"), "NATION")


@query(f"WITH {TAXON} SELECT t.taxon_key, array_to_string([x FOR x IN [g.scientific_name, p.scientific_name] IF x IS NOT NULL], ' > ') AS above FROM taxon t LEFT JOIN taxon p ON t.parent_key = p.taxon_key LEFT JOIN taxon g ON p.parent_key = g.taxon_key")
def location_ancestry(spark, sf):
    """HIE-09."""
    x = taxon(spark, sf).select(F.col("taxon_key").alias("gid"), F.col("scientific_name").alias("name"), F.col("parent_key").alias("parent_gid"))
    return hierarchy.ancestry(x).select(F.col("gid").alias("taxon_key"), F.array_join("above", " > ").alias("above"))


@query(f"WITH {TAXON} SELECT t.taxon_key FROM taxon t LEFT JOIN taxon p ON t.parent_key = p.taxon_key LEFT JOIN taxon g ON p.parent_key = g.taxon_key WHERE list_contains([lower(t.taxon_key), lower(t.scientific_name), lower(p.scientific_name), lower(g.scientific_name)], 'asia')")
def parent_token_division(spark, sf):
    """JON-19."""
    x = taxon(spark, sf).select(F.col("taxon_key").alias("gid"), F.col("scientific_name").alias("name"), F.col("parent_key").alias("parent_gid"))
    return hierarchy.matches_parents(hierarchy.ancestry(x), ["asia"]).select(F.col("gid").alias("taxon_key"))


def kde_sql(source: str, ring: bool) -> str:
    lo, hi = ("0.0", "360.0") if ring else ("min(v)", "max(v)")
    kernel = " + ".join(f"exp(-0.5 * power((x - v - {s}) / bandwidth, 2))" for s in ((-360.0, 0.0, 360.0) if ring else (0.0,)))
    return f"""WITH {VIS}, a AS ({source}), s AS (SELECT flag, count(*) AS n, {lo} AS low, {hi} AS high, 1.06 * stddev_pop(v) * power(count(*), -0.2) AS bandwidth FROM a GROUP BY flag),
    g AS (SELECT flag, n, bandwidth, i, low + (high - low) * i / 31 AS x FROM s, range(32) r(i)) SELECT g.flag, i::INTEGER AS i, round(x, 4) AS x, round(sum({kernel}) / (n * bandwidth * sqrt(2 * pi())), 9) AS density FROM a JOIN g USING (flag) GROUP BY g.flag, i, x, n, bandwidth"""


@query(kde_sql("SELECT flag, quantity AS v FROM vis", False))
def kde_linear(spark, sf):
    """AGG-10/12."""
    got = statistics.density(visible(occurrence(spark, sf)), ["flag"], "quantity", points=32)
    return got.select("flag", "i", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query(kde_sql("SELECT flag, fmod(price, 360) AS v FROM vis", True))
def kde_circular(spark, sf):
    """AGG-11."""
    got = statistics.density(visible(occurrence(spark, sf)).withColumn("v", F.pmod("price", F.lit(360.0))), ["flag"], "v", points=32, ring=True)
    return got.select("flag", "i", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query(f"WITH {VIS} SELECT obs_id, quantity FROM vis WHERE quantity BETWEEN 10 AND 12")
def range_slice(spark, sf):
    """FLT-06/07, API-04."""
    return filters.in_range(visible(occurrence(spark, sf)), "quantity", 10, 12).select("obs_id", "quantity")


@query(f"WITH {VIS} SELECT obs_id, round(fmod(price, 360), 6) AS v FROM vis WHERE fmod(price, 360) >= 350 OR fmod(price, 360) <= 10")
def range_wrap(spark, sf):
    """FLT-08, SET-02."""
    rows = visible(occurrence(spark, sf)).withColumn("v", F.pmod("price", F.lit(360.0)))
    return filters.in_range(rows, "v", 350, 10, circular=True).select("obs_id", F.round("v", 6).alias("v"))


LEGEND = "legend(class_id, name, slug, code) AS (VALUES (1, 'Returned', 'returned', 'R'), (2, 'Accepted', 'accepted', 'A'), (3, 'None', 'none', 'N'))"


def legend(spark):
    return spark.sql("select * from values (1, 'Returned', 'returned', 'R'), (2, 'Accepted', 'accepted', 'A'), (3, 'None', 'none', 'N') as t(class_id, name, slug, code)")


@query(f"WITH {OCC} SELECT obs_id FROM occ WHERE flag = 'A'")
def class_slice(spark, sf):
    """FLT-09/10, API-03: a class named by its label."""
    rows = occurrence(spark, sf).withColumn("class_id", F.when(F.col("flag") == "R", 1).when(F.col("flag") == "A", 2).otherwise(3))
    return filters.of_class(rows, "class_id", "accepted", legend(spark)).select("obs_id")


@query(f"WITH {OCC} SELECT flag, 'Returned' AS class_name, count(*) AS cnt FROM occ WHERE flag = 'R' GROUP BY flag UNION ALL SELECT flag, 'Accepted', count(*) FROM occ WHERE flag = 'A' GROUP BY flag UNION ALL SELECT flag, 'None', count(*) FROM occ WHERE flag = 'N' GROUP BY flag")
def legend_join(spark, sf):
    """JON-15, ARR-07, PRJ-12."""
    counts = occurrence(spark, sf).groupBy("flag").agg(F.count("*").alias("cnt"))
    return joins.with_legend(counts, legend(spark), F.col("flag")).select("flag", "class_name", "cnt")


@query(f"WITH {OCC}, {TAXON}, c AS (SELECT taxon_key, count(*) AS cnt FROM occ GROUP BY 1) SELECT taxon_key FROM taxon LEFT JOIN c USING (taxon_key) WHERE coalesce(cnt, -1) >= 590")
def min_samples_filter(spark, sf):
    """FLT-12."""
    counts = occurrence(spark, sf).groupBy("taxon_key").agg(F.count("*").alias("cnt"))
    return filters.min_samples(taxon(spark, sf), counts, "taxon_key", 590).select("taxon_key")


@query(f"WITH {OCC} SELECT l_partkey, count(*) AS total, count(*) FILTER (status = 'O') AS visible, count(*) FILTER (status = 'O') = 0 AS all_obscured FROM occ GROUP BY l_partkey")
def obscured_only(spark, sf):
    """FLT-23, AGG-18."""
    return filters.obscured_only(occurrence(spark, sf), "l_partkey", F.col("status") == "O")


def metric_table(spark, sf):
    """(context, taxon_key, variable, metric, value): means per supplier in its nation's context."""
    x = taxon(spark, sf).where("rank = 'SUPPLIER'").select("taxon_key", F.col("parent_key").alias("context"))
    m = visible(occurrence(spark, sf)).groupBy("taxon_key").agg(F.round(F.avg("quantity"), 6).alias("value"), F.count("*").alias("samples"))
    return m.join(x, "taxon_key").select("context", "taxon_key", F.lit("quantity").alias("variable"), F.lit("mean").alias("metric"), "value", "samples")


METRIC = f"{VIS}, {TAXON}, metric AS (SELECT parent_key AS context, v.taxon_key, 'quantity' AS variable, 'mean' AS metric, round(avg(quantity), 6) AS value, count(*) AS samples FROM vis v JOIN taxon x ON x.taxon_key = v.taxon_key GROUP BY 1, 2)"
RANKED = METRIC + ", ranked AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY context, variable, metric) AS cnt FROM metric WINDOW w AS (PARTITION BY context, variable, metric ORDER BY value, taxon_key))"
PCT = "CASE WHEN cnt > 1 THEN pos / (cnt - 1) ELSE 0.0 END"
CONTEXT = ["context", "variable", "metric"]


@query(f"WITH {RANKED} SELECT context, taxon_key, variable, metric, value, samples, pos, cnt, round({PCT}, 6) AS percentile FROM ranked")
def rank_positions(spark, sf):
    """WIN-01/02, SNK-06/07."""
    return rounded(ranking.positions(metric_table(spark, sf), CONTEXT), "percentile")


@query(f"WITH {METRIC}, m AS (SELECT DISTINCT 's' || l_suppkey AS taxon_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND l_quantity > 49), k AS (SELECT * FROM metric SEMI JOIN m USING (taxon_key)), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY value, taxon_key) - 1 AS pos, count(*) OVER (PARTITION BY context) AS cnt FROM k) SELECT context, taxon_key, value, pos, cnt, round({PCT}, 6) AS percentile FROM r")
def rank_in_location(spark, sf):
    """WIN-04, JON-08."""
    members = statistics.location_counts(places(spark, sf).where("quantity > 49"), ["level0"], "taxon_key")
    got = ranking.within_location(metric_table(spark, sf), members, "level0", "N3", CONTEXT)
    return rounded(got, "percentile").select("context", "taxon_key", "value", "pos", "cnt", "percentile")


@query(f"WITH {RANKED}, e AS (SELECT parent_key AS context, count(*) + 5 AS eligible FROM taxon WHERE rank = 'SUPPLIER' GROUP BY 1), z AS (SELECT r.* REPLACE (pos + eligible - cnt AS pos, eligible AS cnt) FROM ranked r JOIN e USING (context)) SELECT context, taxon_key, pos, cnt, round({PCT}, 6) AS percentile FROM z")
def rank_zero_padded(spark, sf):
    """WIN-03: five more eligible taxa per context than there are."""
    e = taxon(spark, sf).where("rank = 'SUPPLIER'").groupBy(F.col("parent_key").alias("context")).agg((F.count("*") + 5).alias("eligible"))
    got = ranking.zero_padded(ranking.positions(metric_table(spark, sf), CONTEXT), e, ["context"])
    return rounded(got, "percentile").select("context", "taxon_key", "pos", "cnt", "percentile")


@query(f"WITH {RANKED} SELECT taxon_key, value, pos FROM ranked WHERE context = 'n3' ORDER BY value DESC, taxon_key DESC LIMIT 3 OFFSET 1")
def leaderboard_desc(spark, sf):
    """WIN-05, SRT-02: a page of a top-k report."""
    got = ranking.positions(metric_table(spark, sf).where("context = 'n3'"), CONTEXT)
    return ranking.leaderboard(got, True, 3, 1).select("taxon_key", "value", "pos")


@query("WITH m AS (SELECT 'p' || p_partkey AS taxon_key, floor(p_retailprice / 10) AS value, p_size AS match_score FROM part), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, match_score DESC, taxon_key) - 1 AS \"row\", count(*) OVER () AS cnt FROM m) SELECT taxon_key, \"row\", cnt - 1 - \"row\" AS pos, round((cnt - 1 - \"row\") / (cnt - 1), 6) AS percentile FROM r")
def direct_rank_ties(spark, sf):
    """WIN-06."""
    m = t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("taxon_key"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("value"), F.col("p_size").alias("match_score"))
    return rounded(ranking.direct(m, True), "percentile").select("taxon_key", "row", "pos", "percentile")


@query(f"WITH {METRIC} SELECT variable, metric, count(*) AS taxa FROM metric GROUP BY ALL")
def rank_options(spark, sf):
    """WIN-11."""
    return ranking.options(metric_table(spark, sf))


@query(f"""WITH {RANKED}, s AS (SELECT *, {PCT} AS p FROM ranked WHERE cnt >= 2), g AS (SELECT context, taxon_key, variable, metric, value, samples, row_number() OVER (ORDER BY value, taxon_key) - 1 AS pos, count(*) OVER () AS cnt FROM metric), h AS (SELECT *, greatest({PCT}, 1 - {PCT}) AS strength FROM g WHERE cnt >= 10)
SELECT taxon_key, CASE WHEN strength >= 0.99 THEN 3 WHEN strength >= 0.95 THEN 2 ELSE 1 END AS level, round(strength, 6) AS strength FROM h WHERE strength >= 0.9""")
def outlier_candidate(spark, sf):
    """WIN-12."""
    got = ranking.positions(metric_table(spark, sf).withColumn("context", F.lit("all")), CONTEXT)
    depth = spark.sql("select 'all' as context, 0 as depth")
    return rounded(ranking.outliers(got, depth), "strength").select("taxon_key", "level", "strength")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier")
def keep_last_merge(spark, sf):
    """SET-06, SNK-08."""
    s = t(spark, sf, "supplier")
    old = s.select("s_suppkey", F.lit("old").alias("version"), F.col("s_acctbal").alias("v"))
    new = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("version"), (F.col("s_acctbal") + 1).alias("v"))
    return joins.keep_last(old, new, ["s_suppkey"], "version")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS version FROM supplier")
def insert_if_absent(spark, sf):
    """SET-05, SNK-07."""
    s = t(spark, sf, "supplier")
    return joins.insert_if_absent(s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("old").alias("version")), s.select("s_suppkey", F.lit("new").alias("version")), ["s_suppkey"], ["version"])


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersect(spark, sf):
    """SET-03."""
    return t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(t(spark, sf, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf):
    """SET-04, FLT-22."""
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query(f"WITH {OCC}, i AS (SELECT flag, obs_id, quantity, row_number() OVER (PARTITION BY flag ORDER BY quantity, obs_id) - 1 AS pos FROM occ) SELECT flag, quantity, min(pos) AS start, count(*) AS cnt FROM i GROUP BY flag, quantity")
def lookup_join_index(spark, sf):
    """SNK-04, JON-01, WIN-09: value-ordered index and the runs of equal values in it."""
    from ..sources.tables import occurrence_index

    idx = occurrence_index(occurrence(spark, sf).select(F.col("flag").alias("taxon_key"), F.lit("quantity").alias("variable"), F.col("obs_id").alias("catalog_number"), F.lit(0).alias("origin"), F.col("quantity").alias("value")))
    return idx.groupBy(F.col("taxon_key").alias("flag"), F.col("value").alias("quantity")).agg(F.min("pos").alias("start"), F.count("*").alias("cnt"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_location(spark, sf):
    """JON-08/09/18."""
    return t(spark, sf, "customer").join(t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query(f"WITH {CLOSURE} SELECT taxon_key FROM taxon WHERE EXISTS (SELECT 1 FROM closure JOIN supplier ON descendant = 's' || s_suppkey WHERE ancestor = taxon_key AND s_acctbal > 9000)")
def exists_descendant(spark, sf):
    """JON-10."""
    x = taxon(spark, sf)
    return joins.member_or_below(x, hierarchy.closure(x), t(spark, sf, "supplier").where("s_acctbal > 9000").selectExpr("'s' || s_suppkey as taxon_key")).select("taxon_key")


@query("WITH r AS (SELECT p_brand AS rank, p_type AS name, count(*) AS n, min(p_partkey) AS ext_id FROM part GROUP BY ALL) SELECT p_partkey, ext_id FROM part LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON p_brand = rank AND p_type = name")
def unique_name_match(spark, sf):
    """JON-12."""
    p = t(spark, sf, "part")
    left = p.select("p_partkey", F.col("p_brand").alias("rank"), F.col("p_type").alias("name"))
    return joins.unique_names(left, p.select(F.col("p_brand").alias("rank"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ext_id"))).select("p_partkey", "ext_id")


@query("SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.s ELSE a.s END AS s FROM (SELECT c_custkey, 'a' || c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey, 'b' || c_mktsegment AS s FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey")
def overlay_full_outer(spark, sf):
    """JON-13."""
    c = t(spark, sf, "customer")
    return joins.overlay(c.where("c_custkey % 2 = 0").selectExpr("c_custkey", "'a' || c_mktsegment as s"), c.where("c_custkey % 3 = 0").selectExpr("c_custkey", "'b' || c_mktsegment as s"), "c_custkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'filled' END AS s_name FROM supplier")
def fill_if_empty(spark, sf):
    """JON-02/21."""
    s = t(spark, sf, "supplier")
    blank = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("s_name"))
    return joins.filled(blank, s.select("s_suppkey", F.lit("filled").alias("s_name")), "s_suppkey", ["s_name"])


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def best_media(spark, sf):
    """AGG-19, HIE-12."""
    return statistics.best_by(t(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice"], "p_partkey").select("p_brand", "p_partkey")


@query("WITH s AS (SELECT event_id, least(value / 100, 1.0) AS score, (event_id % 3 = 0)::INT AS y FROM events) SELECT th AS threshold, round(avg((score >= th)::INT) FILTER (y = 1), 6) AS recall, round(avg((score >= th)::INT) FILTER (y = 0), 6) AS false_positive_rate FROM s, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(th) GROUP BY th")
def threshold_metrics(spark, sf):
    """AGG-29."""
    s = t(spark, sf, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return rounded(statistics.quantiles_and_rates(s, "score", "y", [0.1, 0.3, 0.5]), "recall", "false_positive_rate")


@query("SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def mode_over_time(spark, sf):
    """AGG-30."""
    return statistics.mode_of(t(spark, sf, "events"), ["user_id"], "event_type")


@query("SELECT p_partkey, CASE WHEN list_has_any(string_split(p_name, ' '), ['alpha', 'part', '1']) THEN 1 ELSE 0 END AS label FROM part WHERE list_has_any(string_split(p_name, ' '), ['alpha', 'part', '1']) OR trim(p_name) = ''")
def label_split(spark, sf):
    """FLT-24."""
    return filters.label_split(t(spark, sf, "part"), F.split("p_name", " "), ["alpha", "part", "1"]).select("p_partkey", "label")


@query("SELECT c_custkey, 'C' || c_custkey AS key FROM customer")
def catalog_order(spark, sf):
    """SRT-06: integer keys in numeric order, then the others."""
    c = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("key"))
    n = F.col("key").try_cast("bigint")
    return c.orderBy(n.isNull(), n, "key")
