"""Registered queries: trees and names, entry points, places, narrative (HIE, STR, API, DSC, CTL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import control
from ..functions import text
from ..operators import hierarchy, narrative, ranking, shaping, statistics
from ..sources import tables
from ..storage import shared_path
from . import api
from .core import CONTEXT, METRIC, RANKED, legend, metric_table, rounded
from .domain import CLOSURE, PLACES, TAXON, VIS, occurrence, places, query, t, taxon, visible
from .more import catalog

#: Four ranks: suppliers are species, nations genera, regions families, and every third customer a subspecies of a supplier.
DEEP = """deep AS (SELECT 'r' || r_regionkey AS taxon_key, NULL AS parent_key, 'FAMILY' AS rank, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'GENUS', 'r' || n_regionkey || '/n' || n_nationkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SPECIES', 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, 's' || s_suppkey, 'SUBSPECIES', 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey || '/c' || c_custkey FROM customer JOIN supplier ON c_custkey % 10 = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c_custkey % 3 = 0),
tree AS (SELECT a.taxon_key AS ancestor, d.taxon_key AS descendant, len(string_split(d.path, '/')) - len(string_split(a.path, '/')) AS depth FROM deep d JOIN deep a ON d.path = a.path OR starts_with(d.path, a.path || '/'))"""
#: Every fifth key by its digits has a value of its own.
OWN = "own AS (SELECT *, CASE WHEN regexp_extract(taxon_key, '[0-9]+')::INT % 5 = 1 THEN 'v' || taxon_key END AS v FROM deep)"
FIRST = "first_below AS (SELECT ancestor AS taxon_key, arg_min(v, (depth, descendant)) AS any_v, arg_min(v, (depth, descendant)) FILTER (rank = 'SPECIES') AS species_v FROM tree JOIN own ON own.taxon_key = descendant WHERE depth > 0 AND v IS NOT NULL GROUP BY ancestor)"


def deep(spark, sf):
    x = taxon(spark, sf).select("taxon_key", "parent_key", F.replace(F.replace(F.replace("rank", F.lit("SUPPLIER"), F.lit("SPECIES")), F.lit("NATION"), F.lit("GENUS")), F.lit("REGION"), F.lit("FAMILY")).alias("rank"), "path")
    c = t(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("'c' || c_custkey as taxon_key", "'s' || c_custkey % 10 as parent_key", "'SUBSPECIES' as rank")
    c = c.join(x.select(F.col("taxon_key").alias("parent_key"), F.col("path").alias("up")), "parent_key")
    x = x.unionByName(c.select("taxon_key", "parent_key", "rank", F.concat_ws("/", "up", "taxon_key").alias("path")))
    return x.withColumn("v", F.when(F.regexp_extract("taxon_key", "([0-9]+)", 1).cast("int") % 5 == 1, F.concat(F.lit("v"), F.col("taxon_key"))))


@query(f"""WITH {DEEP}, {OWN}, {FIRST}, x AS (SELECT own.*, any_v, CASE WHEN species_v IS NOT NULL THEN species_v WHEN rank IN ('SPECIES', 'SUBSPECIES') AND v IS NOT NULL THEN v ELSE coalesce(any_v, v) END AS mine, coalesce(v, any_v) AS lent FROM own LEFT JOIN first_below USING (taxon_key)),
s AS (SELECT a.taxon_key, arg_min(b.lent, b.taxon_key) AS other FROM x a JOIN x b ON a.parent_key = b.parent_key AND a.taxon_key <> b.taxon_key AND b.lent IS NOT NULL GROUP BY 1) SELECT taxon_key, coalesce(mine, other) AS v FROM x LEFT JOIN s USING (taxon_key)""")
def media_inheritance(spark, sf):
    """HIE-12."""
    x = deep(spark, sf)
    return hierarchy.inherited_media(x, hierarchy.closure(x), "v")


@query(f"WITH {DEEP}, {OWN}, {FIRST} SELECT taxon_key, coalesce(v, any_v) AS v FROM own LEFT JOIN first_below USING (taxon_key)")
def image_inheritance(spark, sf):
    """HIE-13."""
    x = deep(spark, sf)
    return hierarchy.inherited_image(x, hierarchy.closure(x), "v")


@query(f"WITH {DEEP}, {OWN} SELECT a.taxon_key, coalesce(a.v, CASE WHEN a.rank = 'SUBSPECIES' THEN b.v END) AS v FROM own a LEFT JOIN own b ON a.parent_key = b.taxon_key")
def name_inheritance(spark, sf):
    """HIE-14."""
    return hierarchy.inherited_names(deep(spark, sf), "v")


@query(r"SELECT gid, lv AS level, CASE lv WHEN 1 THEN regexp_replace(gid, '\.[^.]*$', '') ELSE regexp_replace(gid, '\.[0-9]+(_[0-9]+)$', '\1') END AS parent FROM (SELECT 'A' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '.' || n_regionkey END || '.' || n_nationkey || '_1' AS gid, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS lv FROM nation)")
def parent_places(spark, sf):
    """HIE-08."""
    n = t(spark, sf, "nation").selectExpr("'A' || n_regionkey || if(n_nationkey % 2 = 0, '', '.' || n_regionkey) || '.' || n_nationkey || '_1' as gid", "if(n_nationkey % 2 = 0, 1, 2) as level")
    return n.withColumn("parent", F.when(F.col("level") == 1, hierarchy.parent_gid(F.col("gid"), 1)).otherwise(hierarchy.parent_gid(F.col("gid"), 2)))


@query("WITH n AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS name FROM part), x AS (SELECT DISTINCT 'p' || p_partkey AS taxon_key, trim(lower(name)) AS name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM n) SELECT name, slug, string_agg(taxon_key, ',' ORDER BY taxon_key) AS taxa, count(*) AS n FROM x GROUP BY ALL")
def name_index(spark, sf):
    """HIE-16: names and slugs with the taxa that have them."""
    p = t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("taxon_key"), F.split("p_name", " ")[0].alias("name"))
    return hierarchy.name_index(p).withColumn("taxa", F.array_join("taxa", ","))


@query(f"WITH {TAXON} SELECT 'r1' AS asked, taxon_key FROM taxon WHERE taxon_key = 'r1' UNION ALL SELECT 'europe', taxon_key FROM taxon WHERE lower(scientific_name) = 'europe' UNION ALL SELECT 'nation-3', taxon_key FROM taxon WHERE scientific_name = 'NATION_3'")
def taxon_references(spark, sf):
    """HIE-17: by key, by slug; a text with a space and an unknown one give nothing."""
    c = catalog(spark, sf)
    got = [api.resolve_taxon(c, asked).select(F.lit(asked).alias("asked"), "taxon_key") for asked in ("r1", "europe", "nation-3", "middle east", "nowhere")]
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out


@query("WITH x AS (SELECT c_nationkey, c_custkey, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN ' EN ' ELSE 'de' END AS lang, CASE c_custkey % 6 WHEN 0 THEN 'American English' WHEN 1 THEN 'Australian English' WHEN 2 THEN 'USA list' WHEN 3 THEN 'names of the U.S.' WHEN 4 THEN 'Austria' END AS lex, c_mktsegment = 'BUILDING' AS own FROM customer), s AS (SELECT *, (CASE WHEN lower(trim(lang)) = 'en' THEN 100 ELSE 0 END + CASE WHEN lex ILIKE '%english%' THEN 50 ELSE 0 END + CASE WHEN lex ILIKE '%american%' OR lex ILIKE '%usa%' OR lex LIKE '%U.S.%' THEN 10 ELSE 0 END + CASE WHEN own THEN 25 ELSE 0 END)::INTEGER AS score FROM x WHERE lower(trim(lang)) = 'en' OR coalesce(lex ILIKE '%english%', false)) SELECT c_nationkey, arg_min(name, (-score, lower(name))) AS name, max(score) AS score FROM s GROUP BY 1")
def english_names(spark, sf):
    """STR-07: the best English name per group: language, lexicon, marks of the United States, own source."""
    k = F.col("c_custkey")
    lang = F.when(k % 3 == 0, "en").when(k % 3 == 1, " EN ").otherwise("de")
    lex = F.when(k % 6 == 0, "American English").when(k % 6 == 1, "Australian English").when(k % 6 == 2, "USA list").when(k % 6 == 3, "names of the U.S.").when(k % 6 == 4, "Austria")
    c = t(spark, sf, "customer").withColumns({"lang": lang, "lex": lex}).where(text.of_language(F.col("lang"), F.col("lex"), "en"))
    c = c.withColumn("score", text.common_name_score(F.col("lang"), F.col("lex"), F.when(F.col("c_mktsegment") == "BUILDING", "own")))
    best = c.groupBy("c_nationkey").agg(F.min_by(F.struct(F.col("c_name").alias("name"), "score"), F.struct(-F.col("score"), F.lower("c_name"))).alias("x"))
    return best.select("c_nationkey", "x.*")


@query("SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN w[1:2] WHEN 1 THEN w[1:3] WHEN 2 THEN w[1:4] ELSE w END, '_') AS name FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN [lower(p_type), 'x'] WHEN 2 THEN [lower(p_type), 'alba', 'var.'] ELSE [lower(p_type)] END || string_split(p_name, ' ') AS w FROM part)")
def clean_scientific_names(spark, sf):
    """STR-04: two words for a species, three with a hybrid mark, four below species with a mark, all for other ranks."""
    k = F.col("p_partkey") % 4
    lead = F.when(k == 1, F.concat_ws(" ", F.lower("p_type"), F.lit("x"))).when(k == 2, F.concat_ws(" ", F.lower("p_type"), F.lit("alba var."))).otherwise(F.lower("p_type"))
    rank = F.when(k <= 1, "SPECIES").when(k == 2, "VARIETY").otherwise("GENUS")
    return t(spark, sf, "part").select("p_partkey", text.scientific_name(F.concat_ws(" ", lead, "p_name"), rank).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Old Man''s Beard' WHEN 1 THEN 'USA Oak ' || upper(p_name[1]) || lower(p_name[2:4]) ELSE upper(p_type[1]) || lower(p_type[2:]) || ' Tree' END AS name FROM part")
def cased_names(spark, sf):
    """STR-08: capitals for each word, short words in capitals kept, the letter after an apostrophe low."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "old MAN'S beard").when(k == 1, F.concat(F.lit("USA oak "), F.lower(F.substring("p_name", 1, 4)))).otherwise(F.concat(F.lower("p_type"), F.lit(" tree")))
    return t(spark, sf, "part").select("p_partkey", text.cased(raw).alias("name"))


@query("SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' Of Brand' AS label FROM part")
def category_labels(spark, sf):
    """STR-11."""
    return t(spark, sf, "part").select("p_partkey", text.label(F.concat(F.lower("p_type"), F.lit("::of_brand"))).alias("label"))


@query("SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 99 ELSE 99 END)::INTEGER AS score FROM part")
def licence_scores(spark, sf):
    """STR-14."""
    links = F.array(*map(F.lit, ("http://x/CC0/1.0", "http://x/by/4.0/", "http://x/by-nc/4.0", "http://x/by-sa/3.0", "all rights reserved")))
    link = F.when(F.col("p_partkey") % 6 < 5, F.get(links, (F.col("p_partkey") % 6).cast("int")))
    return t(spark, sf, "part").select("p_partkey", text.licence_score(link).cast("int").alias("score"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey END::INTEGER AS class, CASE c_custkey % 3 WHEN 2 THEN 'Cfb' END AS code FROM customer")
def class_codes(spark, sf):
    """STR-18."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("class_"), k.cast("string"))).otherwise("Temperate (Cfb)")
    return t(spark, sf, "customer").select("c_custkey", text.class_number(raw).alias("class"), text.climate_code(raw).alias("code"))


@query("WITH x AS (SELECT 'p' || p_partkey AS taxon_key, lower(p_name) AS name, string_split(lower(p_name), ' ')[1] AS q FROM part) SELECT taxon_key, max(100 + CASE WHEN name = q THEN 20 ELSE 0 END - 2 * greatest(0, len(string_split(name, ' ')) - 1))::DOUBLE AS match_score FROM x WHERE list_contains(string_split(name, ' '), (SELECT min(string_split(lower(p_name), ' ')[1]) FROM part)) GROUP BY 1")
def name_search(spark, sf):
    """STR-05/06, AGG-20, SRT-03/04: taxa that one word finds, each with its best score."""
    p = t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("taxon_key"), F.col("p_name").alias("scientific_name"))
    word = p.agg(F.min(F.split(F.lower("scientific_name"), " ")[0])).first()[0]
    c = catalog(spark, sf)
    found = api.search_names(api.Catalog(p, c.closure, c.metric, c.membership, c.occurrence), word)
    return found.where("match_score is not null")


@query(f"WITH {VIS}, {CLOSURE}, x AS (SELECT obs_id, min((quantity, price)) AS p FROM vis WHERE taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'r1') GROUP BY obs_id) SELECT obs_id, p[1] AS lat, p[2] AS lon FROM x")
def subtree_points(spark, sf):
    """API-05, AGG-34: distinct visible points."""
    c = catalog(spark, sf)
    rows = c.occurrence.withColumns({"lat": F.col("quantity"), "lon": F.col("price")})
    return api.occurrence_points(api.Catalog(c.taxon, c.closure, c.metric, c.membership, rows), "r1")


#: Regions (-1), nations (0) and every tenth customer (1) as places in the catalogue's order.
SPOTS = "spot AS (SELECT 'R' || r_regionkey AS gid, r_name AS name, -1 AS level, NULL AS parent_gid, r_regionkey::BIGINT AS ordinal FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 0, 'R' || n_regionkey, 100 + n_nationkey FROM nation UNION ALL SELECT 'N' || c_nationkey || '.' || c_custkey, c_name, 1, 'N' || c_nationkey, 1000 + c_custkey FROM customer WHERE c_custkey % 10 = 0)"
ABOVE = SPOTS + ", above AS (SELECT s.*, [x FOR x IN [q.name, p.name] IF x IS NOT NULL] AS names, [lower(x) FOR x IN [s.gid, s.name, p.gid, p.name, q.gid, q.name] IF x IS NOT NULL] AS every FROM spot s LEFT JOIN spot p ON s.parent_gid = p.gid LEFT JOIN spot q ON p.parent_gid = q.gid)"
SHOWN = "gid, name, level, array_to_string(names, '|') AS hierarchy"


def spots(spark, sf):
    r = t(spark, sf, "region").selectExpr("'R' || r_regionkey as gid", "r_name as name", "-1 as level", "cast(null as string) as parent_gid", "cast(r_regionkey as bigint) as ordinal")
    n = t(spark, sf, "nation").selectExpr("'N' || n_nationkey as gid", "n_name as name", "0 as level", "'R' || n_regionkey as parent_gid", "100L + n_nationkey as ordinal")
    c = t(spark, sf, "customer").where("c_custkey % 10 = 0").selectExpr("'N' || c_nationkey || '.' || c_custkey as gid", "c_name as name", "1 as level", "'N' || c_nationkey as parent_gid", "1000L + c_custkey as ordinal")
    return r.unionByName(n).unionByName(c)


def _page(df):
    return df.select("gid", "name", "level", F.array_join("hierarchy", "|").alias("hierarchy"))


@query(f"WITH {ABOVE} SELECT {SHOWN} FROM above WHERE contains(strip_accents(lower(name)), 'er') ORDER BY ordinal LIMIT 10")
def location_search(spark, sf):
    """API-07, SRT-07: a report of the first ten; accents and case do not matter."""
    return _page(api.search_locations(spots(spark, sf), " ÉR", 10))


@query(f"WITH {ABOVE} SELECT {SHOWN} FROM above WHERE level = 1 AND list_contains(every, 'asia') ORDER BY ordinal LIMIT 50")
def locations_of_level(spark, sf):
    """API-07: places of a level below a parent given by name."""
    return _page(api.search_hierarchy(spots(spark, sf), level="state", parents=("Asia",)))


@query(f"WITH {ABOVE} SELECT {SHOWN} FROM above WHERE level = 1 AND contains(lower(name), '00') AND list_contains(every, 'n2') ORDER BY ordinal LIMIT 5")
def locations_by_text(spark, sf):
    """API-07, JON-19: text, level and a parent given by id."""
    return _page(api.search_hierarchy(spots(spark, sf), "00", 1, ("N2",), 5))


@query(f"WITH {ABOVE} SELECT {SHOWN} FROM above WHERE starts_with(gid, 'N2.') ORDER BY ordinal LIMIT 50")
def locations_below(spark, sf):
    """API-07, HIE-10: children by the id of the parent, without a level or text."""
    return _page(api.search_hierarchy(spots(spark, sf), parents=("N2",)))


@query(f"WITH {ABOVE} SELECT {SHOWN} FROM above WHERE gid = 'R3' ORDER BY ordinal LIMIT 50")
def locations_by_letter(spark, sf):
    """SRT-10: nothing lies below a place without children that names itself, so names are looked through by letter."""
    s = spots(spark, sf).where("level = -1")
    return _page(api.search_hierarchy(s, parents=("r3",)))


@query(f"WITH {ABOVE} SELECT gid, name, level, parent_gid, array_to_string(names, '|') AS hierarchy, len(names)::INTEGER AS ancestors FROM above WHERE gid = 'N3'")
def location_details(spark, sf):
    """API-07, HIE-09: one place with its ancestors, its id in small letters."""
    got = api.location_detail(spots(spark, sf), "N3")
    return got.withColumns({"hierarchy": F.array_join("hierarchy", "|"), "ancestors": F.size("ancestors")})


@query(f"WITH {PLACES}, {ABOVE}, m AS (SELECT 'N' || right(level0, length(level0) - 1) AS gid, count(*) AS cnt FROM places WHERE taxon_key = 's3' GROUP BY 1) SELECT m.gid, name, 0 AS level, array_to_string(names, '|') AS hierarchy, cnt FROM m JOIN above USING (gid) WHERE list_contains(every, 'europe') ORDER BY cnt DESC, lower(name), gid LIMIT 3")
def species_places(spark, sf):
    """API-06, SRT-05: the first three nations of a region that a taxon lives in."""
    c = catalog(spark, sf)
    members = statistics.location_counts(places(spark, sf), ["region", "level0"], "taxon_key")
    got = api.taxon_locations(api.Catalog(c.taxon, c.closure, c.metric, members, c.occurrence), spots(spark, sf), "s3", "country", ("Europe",), 3)
    return got.withColumn("hierarchy", F.array_join("hierarchy", "|"))


_NAMED = "place AS (SELECT 'N' || n_nationkey AS gid, CASE WHEN n_nationkey = 3 THEN 'Netherlands' ELSE n_name END AS name, 0 AS level, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C' || c_custkey, 'place ' || c_custkey % 40, 1, 'N' || c_nationkey FROM customer)"


@query(f"""WITH {_NAMED}, c AS (SELECT 'x' || c_nationkey AS taxon_key, 'N' || c_nationkey AS gid, count(*) AS cnt FROM customer WHERE c_nationkey % 2 = 1 GROUP BY ALL UNION ALL SELECT 'x' || c_nationkey, 'C' || c_custkey, c_custkey % 7 FROM customer WHERE c_nationkey % 2 = 1 AND c_nationkey <> 5 UNION ALL SELECT 'y' || n_regionkey, 'N' || n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey < 20),
e AS (SELECT taxon_key, gid, name, level, parent, cnt FROM c JOIN place USING (gid) WHERE cnt > 0), u AS (SELECT taxon_key, level, name, max(cnt) AS cnt, count(*) AS times FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY taxon_key, level ORDER BY cnt DESC, name) AS k, sum(times) OVER (PARTITION BY taxon_key, level) AS n FROM u),
l AS (SELECT taxon_key, level, list(CASE WHEN level = 0 AND name = 'Netherlands' THEN 'the Netherlands' ELSE name END ORDER BY k) AS names, max(n) > count(*) AS more FROM r WHERE k <= 3 GROUP BY ALL), j AS (SELECT *, CASE WHEN more THEN array_to_string(names, ', ') || ' and other ' || CASE level WHEN 0 THEN 'countries' ELSE 'regions' END WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[1:len(names) - 1], ', ') || ', and ' || names[-1] END AS txt FROM l)
SELECT a.taxon_key, CASE WHEN len(a.names) = 1 AND b.txt IS NOT NULL THEN b.txt || ' in ' || a.names[1] ELSE a.txt END AS sentence FROM j a LEFT JOIN j b ON a.taxon_key = b.taxon_key AND b.level = 1 WHERE a.level = 0""")
def location_sentence(spark, sf):
    """DSC-04: three countries, or three regions of the only country."""
    n, c = t(spark, sf, "nation"), t(spark, sf, "customer")
    named = n.selectExpr("'N' || n_nationkey as gid", "if(n_nationkey = 3, 'Netherlands', n_name) as name", "0 as level", "'R' || n_regionkey as parent_gid").unionByName(c.selectExpr("'C' || c_custkey as gid", "'place ' || c_custkey % 40 as name", "1 as level", "'N' || c_nationkey as parent_gid"))
    odd = c.where("c_nationkey % 2 = 1")
    counts = odd.groupBy(F.expr("'x' || c_nationkey as taxon_key"), F.expr("'N' || c_nationkey as gid")).agg(F.count("*").alias("cnt"))
    counts = counts.unionByName(odd.where("c_nationkey != 5").selectExpr("'x' || c_nationkey as taxon_key", "'C' || c_custkey as gid", "cast(c_custkey % 7 as bigint) as cnt"))
    counts = counts.unionByName(n.where("n_nationkey < 20").selectExpr("'y' || n_regionkey as taxon_key", "'N' || n_nationkey as gid", "cast(n_nationkey + 1 as bigint) as cnt"))
    return api.location_sentence(counts, named)


def _seen(spark, sf):
    """The catalogue with all observations, the hidden ones marked."""
    c = catalog(spark, sf)
    rows = places(spark, sf).withColumns({"obscured": F.when(F.expr("status = 'O' and discount <= 0.05 and quantity is not null"), "No").otherwise("Hidden"), "level0_gid": F.col("level0")})
    return api.Catalog(c.taxon, c.closure, c.metric, c.membership, rows)


@query(f"WITH {PLACES}, {CLOSURE}, x AS (SELECT * FROM places WHERE status = 'O' AND discount <= 0.05 AND quantity IS NOT NULL AND taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'r1')), r AS (SELECT count(quantity) AS n, round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS std, round(quantile_cont(quantity, 0.9) - quantile_cont(quantity, 0.1), 6) AS range_10_90 FROM x) SELECT 'r1' AS taxon_key, false AS all_obscured, n, mean, std, range_10_90, (CASE WHEN n <= 32 THEN greatest(8, n) WHEN n <= 200 THEN 64 ELSE 128 END)::INTEGER AS points, (SELECT max(quantity) FROM x) AS last_point FROM r")
def environment_numeric(spark, sf):
    """API-02: summary and density of a subtree."""
    r = api.environment_response(_seen(spark, sf), "r1", "quantity")
    got = r.select("taxon_key", "all_obscured", "n", "summary.mean", "summary.std", "summary.range_10_90", F.size("curve.points").alias("points"), F.element_at("curve.points", -1).alias("last_point"))
    return rounded(got, "mean", "std", "range_10_90")


@query(f"WITH {PLACES}, {CLOSURE}, x AS (SELECT * FROM places WHERE status = 'O' AND discount <= 0.05 AND quantity IS NOT NULL AND taxon_key IN (SELECT descendant FROM closure WHERE ancestor = 'r1')), h AS (SELECT flag, count(*) AS cnt FROM x WHERE level0 = 'N3' GROUP BY 1), a AS (SELECT flag, count(*) AS cnt FROM x GROUP BY 1) SELECT 'here' AS part, flag AS class, cnt, round(cnt / (SELECT sum(cnt) FROM h), 6) AS share FROM h UNION ALL SELECT 'everywhere', flag, cnt, round(cnt / (SELECT sum(cnt) FROM a), 6) FROM a")
def environment_categories(spark, sf):
    """API-02: class shares in a place, and those of all places as the baseline."""
    r = api.environment_response(_seen(spark, sf), "r1", "flag", "categorical", "N3", legend=legend(spark))
    one = lambda name, part: r.select(F.lit(part).alias("part"), F.explode(name).alias("x")).select("part", F.col("x.class").alias("class"), F.col("x.cnt").alias("cnt"), F.round("x.share", 6).alias("share"))
    return one("distribution", "here").unionByName(one("baseline", "everywhere"))


@query(f"WITH {RANKED} SELECT context, metric, pos, cnt FROM ranked WHERE taxon_key = 's3' AND variable = 'quantity'")
def environment_ranks(spark, sf):
    """API-02: the places of a taxon in its contexts."""
    ranks = ranking.positions(metric_table(spark, sf), CONTEXT)
    r = api.environment_response(_seen(spark, sf), "s3", "quantity", ranks=ranks)
    return r.select(F.explode("ranks").alias("x")).select("x.context", "x.metric", "x.pos", "x.cnt")


@query(f"WITH {PLACES}, x AS (SELECT price * 1.8 + 32 AS v FROM places WHERE status = 'O' AND discount <= 0.05 AND quantity IS NOT NULL AND taxon_key = 's3' AND level0 = 'N3') SELECT false AS all_obscured, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS low FROM x UNION ALL SELECT true, 0, NULL, NULL")
def environment_units(spark, sf):
    """API-02, MTH-15: a place, in imperial units; then a taxon whose observations are all obscured."""
    c = _seen(spark, sf)
    one = api.environment_response(c, "s3", "price", gid="N3", unit="°C", system="imperial").select("all_obscured", "n", F.round("summary.mean", 4).alias("mean"), F.round("summary.min", 4).alias("low"))
    dark = api.Catalog(c.taxon, c.closure, c.metric, c.membership, c.occurrence.withColumn("obscured", F.lit("Hidden")))
    two = api.environment_response(dark, "s3", "price").select("all_obscured", "n", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("low"))
    return one.unionByName(two)


@query(f"WITH {VIS} SELECT taxon_key, 'quantity' AS variable, count(*) AS n, round(max(quantity) - min(quantity), 6) AS value_range FROM vis WHERE taxon_key = 's3' GROUP BY 1")
def stored_statistics(spark, sf):
    """API-11: stored summaries read through the loader, ranges derived again."""
    home = shared_path(spark, "stats")
    rows = statistics.tall(visible(occurrence(spark, sf)).select("taxon_key", "quantity", "price"), ["taxon_key"], ["quantity", "price"])
    tables.write(shaping.stored_summary(statistics.summary(rows, ["taxon_key", "variable"]), ["taxon_key", "variable"]), f"{home}/summary", sort=["taxon_key"])
    return rounded(api.Stats(spark, home).numeric("s3", "quantity").select("taxon_key", "variable", "n", "value_range"), "value_range")


@query(f"WITH {METRIC}, d AS (SELECT 's' || s_suppkey AS taxon_key, s_suppkey::BIGINT AS n FROM supplier) SELECT taxon_key, 'quantity' AS variable, 'mean' AS metric, value, CASE WHEN samples % 2 = 0 THEN samples ELSE d.n END AS samples FROM metric JOIN d USING (taxon_key) WHERE d.n % 3 <> 0 UNION ALL SELECT taxon_key, 'quantity', 'mean', 1.0, d.n FROM metric JOIN d USING (taxon_key) WHERE d.n % 3 = 0")
def metric_assembly(spark, sf):
    """AGG-21, FLT-16: numeric and categorical metrics as one table: categorical ones win, counts that are not positive are the catalogue's, windowed weather and values that are not finite stay out."""
    m = metric_table(spark, sf).withColumn("k", F.expr("cast(substr(taxon_key, 2) as bigint)"))
    numeric = m.select("taxon_key", "variable", "metric", "value", F.when(F.col("samples") % 2 == 0, F.col("samples")).otherwise(0).alias("samples"))
    windowed = numeric.withColumn("variable", F.lit("wind_avg_6h")).unionByName(numeric.withColumns({"variable": F.lit("broken"), "value": F.lit(float("nan"))}))
    own = m.where("k % 3 = 0").select("taxon_key", "variable", "metric", F.lit(1.0).alias("value"))
    return ranking.metric_rows(numeric.unionByName(windowed), own, m.select("taxon_key", F.col("k").alias("cnt")))


@query(f"WITH {RANKED} SELECT context, taxon_key, value, pos, cnt, {'CASE WHEN cnt > 1 THEN pos / (cnt - 1) ELSE 0.0 END'} AS percentile FROM ranked")
def rank_positions_by_ranges(spark, sf):
    """WIN-01/02 for contexts of any size."""
    return ranking.positions_by_ranges(metric_table(spark, sf), CONTEXT).select("context", "taxon_key", "value", "pos", "cnt", "percentile")


@query("WITH m AS (SELECT 'p' || p_partkey AS taxon_key, CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice / 10) END AS value, p_size AS match_score FROM part), r AS (SELECT *, row_number() OVER (ORDER BY value NULLS LAST, match_score DESC, taxon_key) - 1 AS \"row\" FROM m) SELECT taxon_key, value, \"row\", \"row\" AS pos FROM r")
def direct_rank_nulls(spark, sf):
    """WIN-06: matches without a value come last."""
    m = t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("taxon_key"), F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("p_retailprice") / 10).cast("double")).alias("value"), F.col("p_size").alias("match_score"))
    return ranking.direct(m, False).select("taxon_key", "value", "row", "pos")


@query(f"WITH {TAXON}, m AS (SELECT DISTINCT parent_key AS k FROM taxon WHERE parent_key IS NOT NULL) SELECT taxon_key, upper(rank) AS rank, CASE WHEN starts_with(path || '/', 'r0/') THEN 'africa' ELSE 'other' END AS taxon_group, CASE WHEN rank = 'SUPPLIER' THEN 'Summary: ' || scientific_name || ' is a species.' || chr(10) || 'Terrain: Not notable.' END AS text, CASE WHEN rank = 'REGION' THEN 'taxon_' || taxon_key || '_gbt' ELSE '' END AS models FROM taxon")
def species_details(spark, sf):
    """API-08, DSC-08."""
    x = taxon(spark, sf)
    s = x.where("rank = 'SUPPLIER'")
    none = F.lit(None).cast("string")
    sections = {"summary": s.select("taxon_key", narrative.summary_sentence(F.col("scientific_name"), none, none, none).alias("text")), "terrain": s.where("false").select("taxon_key", F.lit("x").alias("text"))}
    models = x.where("rank = 'REGION'").select("taxon_key", F.concat(F.lit("taxon_"), F.col("taxon_key"), F.lit("_gbt")).alias("name"))
    got = api.species_detail(x, [("r0", "africa")], sections, models)
    return got.select("taxon_key", "rank", "taxon_group", "text", F.array_join("models", "|").alias("models"))


def _words(value: str, words: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {value} {test} THEN '{word}'" for test, word in words) + " END"


_WINTER = [("< -40", "extremely cold"), ("< -30", "incredibly cold"), ("< -20", "very cold"), ("< -10", "quite cold"), ("< 0", "cold"), ("< 10", "cool"), ("< 20", "temperate"), ("< 30", "warm"), (">= 30", "hot")]
_SUMMER = [("> 40", "scorching"), ("> 35", "very hot"), ("> 30", "hot"), ("> 20", "warm"), ("> 10", "temperate"), ("<= 10", "cool")]
_RAIN = [("< 50", "extremely xeric"), ("< 150", "xeric"), ("< 250", "arid"), ("< 400", "semi-arid"), ("< 500", "dry"), ("< 800", "subhumid"), ("< 1000", "moderately wet"), ("< 1200", "wet"), ("< 1500", "very wet"), ("< 2000", "incredibly wet"), ("< 3000", "extremely wet"), (">= 3000", "torrential")]
_SNOW = [("< 5", "snow-free"), ("< 50", "slightly snowy"), ("< 100", "moderately snowy"), ("< 200", "snowy"), ("< 300", "very snowy"), (">= 300", "incredibly snowy")]
_PH = [("< 3.5", "ultra-acidic"), ("<= 4.4", "extremely acidic"), ("<= 5.0", "very strongly acidic"), ("<= 5.5", "strongly acidic"), ("<= 6.0", "moderately acidic"), ("<= 6.5", "slightly acidic"), ("<= 7.3", "neutral"), ("<= 7.8", "slightly alkaline"), ("<= 8.4", "moderately alkaline"), ("<= 9.0", "strongly alkaline"), ("> 9.0", "very strongly alkaline")]
_NITROGEN = [("< 0.05", "extremely nutrient poor"), ("< 0.10", "very nutrient poor"), ("< 0.20", "nutrient poor"), ("< 0.50", ""), ("< 1.00", "nutrient rich"), ("<= 2.00", "very nutrient rich"), ("> 2.00", "extremely nutrient rich")]


@query(f"WITH v AS (SELECT p_partkey, p_partkey % 90 - 50 AS c, (p_partkey * 17 % 3200)::DOUBLE AS mm, 3 + (p_partkey % 71) / 10.0::DOUBLE AS ph, (p_partkey % 51) / 20.0::DOUBLE AS n FROM part) SELECT p_partkey, {_words('c', _WINTER)} AS winter, {_words('c', _SUMMER)} AS summer, {_words('mm', _RAIN)} AS rain, {_words('mm / 8', _SNOW)} AS snow, {_words('ph', _PH)} AS acidity, nullif({_words('n', _NITROGEN)}, '') AS nitrogen FROM v")
def word_scales(spark, sf):
    """MTH-12: the scales of cold, heat, rain, snow, acidity and nutrients."""
    k = F.col("p_partkey")
    v = t(spark, sf, "part").select("p_partkey", (k % 90 - 50).cast("double").alias("c"), (k * 17 % 3200).cast("double").alias("mm"), (3 + (k % 71) / F.lit(10.0)).alias("ph"), ((k % 51) / F.lit(20.0)).alias("n"))
    c, mm = F.col("c"), F.col("mm")
    return v.select("p_partkey", narrative.winter_word(c).alias("winter"), narrative.summer_word(c).alias("summer"), narrative.rain_word(mm).alias("rain"), narrative.snow_word(mm / 8).alias("snow"), narrative.acidity_word(F.col("ph")).alias("acidity"), narrative.nitrogen_word(F.col("n")).alias("nitrogen"))


@query(f"""WITH v AS (SELECT p_partkey, (p_partkey % 60 - 5)::DOUBLE AS hot, (p_partkey % 70 - 45)::DOUBLE AS cold, (p_partkey % 500)::DOUBLE AS sr, (p_partkey % 400)::DOUBLE AS wr, (p_partkey % 7 * 50)::DOUBLE AS swe, (p_partkey % 900)::DOUBLE AS lo FROM part), w AS (SELECT p_partkey, {_words('hot', _SUMMER)} AS heat, {_words('(sr * 4)', _RAIN)} AS srain, {_words('cold', _WINTER)} AS chill, {_words('(wr * 4)', _RAIN)} AS wrain, {_words('swe', _SNOW)} AS tier, {_words('lo', _RAIN)} AS low, {_words('(lo + 300)', _RAIN)} AS mid, {_words('(lo + 700)', _RAIN)} AS high FROM v)
SELECT p_partkey, 'Typically ' || heat || ', ' || srain || ' summers' || chr(10) || 'Typically ' || chill || ', ' || CASE WHEN tier = 'snow-free' THEN wrain ELSE tier END || ' winters' || chr(10) || 'Prefers ' || mid || ' areas' || CASE WHEN low = mid AND high = mid THEN '' WHEN low = mid THEN ', but can tolerate ' || high WHEN high = mid OR low = high THEN ', but can tolerate ' || low ELSE ', but can tolerate ' || low || ' to ' || high END AS weather FROM w""")
def weather_rows(spark, sf):
    """DSC-05."""
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    low = d(k % 900)
    return t(spark, sf, "part").select("p_partkey", narrative.weather_row(d(k % 60 - 5), d(k % 70 - 45), d(k % 500), d(k % 400), d(k % 7 * 50), low, low + 700, low + 300).alias("weather"))


@query(f"""WITH v AS (SELECT p_partkey, (p_partkey % 71)::DOUBLE AS sand, (p_partkey * 7 % 41)::DOUBLE AS silt, (p_partkey * 3 % 31)::DOUBLE AS clay, (p_partkey % 32)::DOUBLE AS cf, 3 + (p_partkey % 71) / 10.0::DOUBLE AS ph, (p_partkey % 51) / 20.0::DOUBLE AS n FROM part),
w AS (SELECT *, greatest(sand, silt, clay) AS top, sand + silt + clay - greatest(sand, silt, clay) - least(sand, silt, clay) AS next, CASE WHEN sand >= silt AND sand >= clay THEN 'sandy' WHEN silt >= clay THEN 'silty' ELSE 'clay-rich' END AS adj, {_words('ph', _PH)} AS acid, nullif({_words('n', _NITROGEN)}, '') AS food FROM v)
SELECT p_partkey, 'Typically ' || CASE WHEN top > 40 AND top - next >= 5 THEN CASE WHEN top > 60 THEN 'extremely ' WHEN top > 50 THEN 'very ' ELSE 'somewhat ' END || adj ELSE 'balanced' END || CASE WHEN cf > 28 THEN ', extremely coarse' WHEN cf > 25 THEN ', very coarse' WHEN cf > 20 THEN ', quite coarse' WHEN cf > 17 THEN ', somewhat coarse' ELSE '' END || ' soil' || chr(10) || 'Typically ' || CASE WHEN food IS NULL THEN acid ELSE food || ' and ' || acid END || ' soil' AS soil FROM w""")
def soil_rows(spark, sf):
    """DSC-05."""
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    return t(spark, sf, "part").select("p_partkey", narrative.soil_row(d(k % 71), d(k * 7 % 41), d(k * 3 % 31), d(k % 32), (k % 51) / F.lit(20.0), 3 + (k % 71) / F.lit(10.0)).alias("soil"))


_BAND = [("< 5", "flat"), ("< 10", "mild"), ("< 15", "gentle"), ("< 20", "moderate"), ("< 30", "steep"), (">= 30", "very steep")]


@query(f"""WITH v AS (SELECT p_partkey, (p_partkey % 40)::DOUBLE AS a, (p_partkey * 7 % 30)::DOUBLE AS b, p_partkey * 13 % 3000 AS e FROM part), g AS (SELECT *, tan(radians(least(a, b))) * 100 AS low, tan(radians(greatest(a, b))) * 100 AS high FROM v), w AS (SELECT *, {_words('low', _BAND)} AS x, {_words('high', _BAND)} AS y FROM g)
SELECT p_partkey, 'Found from ' || (round_even(e / 100.0::DOUBLE, 0) * 100)::BIGINT || '-' || (round_even((e + 500) / 100.0::DOUBLE, 0) * 100)::BIGINT || ' m' || chr(10) || 'Mostly plains' || chr(10) || 'Often ' || CASE WHEN x = y AND y = 'flat' THEN 'flat areas' WHEN x = y THEN y || ' slopes' WHEN x = 'flat' THEN 'flat areas to ' || y || ' slopes' ELSE x || ' to ' || y || ' slopes' END || ' (' || round_even(low, 0)::BIGINT || ' to ' || round_even(high, 0)::BIGINT || ' percent grade)' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN chr(10) || 'Prefers north-facing slopes' ELSE chr(10) || 'Prefers north-facing and east-facing slopes' END AS terrain FROM w""")
def terrain_texts(spark, sf):
    """DSC-05, MTH-11."""
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    facing = narrative.facing_text(F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("north"))).otherwise(F.array(F.lit("north"), F.lit("east"))))
    return t(spark, sf, "part").select("p_partkey", narrative.terrain_row(d(k * 13 % 3000), d(k * 13 % 3000 + 500), "m", d(k % 40), d(k * 7 % 30), F.lit("MOSTLY plains"), facing).alias("terrain"))


_COVERS = "(VALUES (0, 10, 'Rainfed crops', 'cropland', ''), (1, 51, 'Open evergreen broadleaved forest', 'forest', 'sparse evergreen forests'), (2, 62, 'Closed deciduous broadleaved forest', 'forest', 'dense deciduous forests'), (3, NULL, 'Open forest', 'forest', 'sparse forests'), (4, NULL, 'Permanent snow', 'ice_snow', ''), (5, NULL, 'Mangrove', NULL, '')) v(k, class_id, name, grp, label)"


@query(f"SELECT p_partkey, grp AS \"group\", CASE WHEN label <> '' THEN label ELSE name END AS label FROM part JOIN {_COVERS} ON p_partkey % 6 = k")
def land_groups(spark, sf):
    """DSC-02: groups by class number or name, and labels by traits."""
    cover = spark.sql("select * from values (0, 10, 'Rainfed crops'), (1, 51, 'Open evergreen broadleaved forest'), (2, 62, 'Closed deciduous broadleaved forest'), (3, null, 'Open forest'), (4, null, 'Permanent snow'), (5, null, 'Mangrove') as t(k, class_id, name)")
    group = narrative.landcover_group(F.col("class_id"), F.col("name"))
    label, _, _ = narrative.semantic_label(group, F.col("name"), narrative.forest_traits(F.col("name")))
    return t(spark, sf, "part").join(F.broadcast(cover), F.expr("p_partkey % 6 = k")).select("p_partkey", group.alias("group"), label.alias("label"))


@query("SELECT * FROM (VALUES ('BWh', 'hot'), ('BSk', 'cold'), ('Cfa', 'hot'), ('Dfb', 'warm'), ('Dfc', 'cool'), ('Dfd', 'severe-winter'), ('ET', 'cold'), ('EF', 'severe-winter'), ('Af', ''), ('', '')) v(code, heat)")
def climate_traits(spark, sf):
    """DSC-02."""
    codes = spark.createDataFrame([(c,) for c in ("BWh", "BSk", "Cfa", "Dfb", "Dfc", "Dfd", "ET", "EF", "Af", "")], "code string")
    return codes.select("code", narrative.climate_heat(F.col("code")).alias("heat"))


_OFTEN = "CASE WHEN {0} >= 1 THEN 'always' WHEN {0} > 0.8 THEN 'almost always' WHEN {0} > 0.5 THEN 'primarily' WHEN {0} > 0.3 THEN 'often' WHEN {0} > 0.2 THEN 'sometimes' WHEN {0} > 0.1 THEN 'rarely' END"
_SECOND = "CASE WHEN {0} < 0.1 THEN 'rarely' WHEN {0} < 0.25 THEN 'sometimes' WHEN {0} IS NOT NULL THEN 'often' END"


@query(f"""WITH {VIS}, c AS (SELECT taxon_key, flag, count(*) AS n FROM vis GROUP BY ALL), s AS (SELECT taxon_key, flag, n / sum(n) OVER (PARTITION BY taxon_key) AS share FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY taxon_key ORDER BY round(share, 9) DESC, flag) AS k FROM s),
p AS (SELECT taxon_key, max(flag) FILTER (k = 1) AS a, max(share) FILTER (k = 1) AS x, max(flag) FILTER (k = 2) AS b, max(share) FILTER (k = 2) AS y, max(flag) FILTER (k = 3) AS c, max(share) FILTER (k = 3) AS z FROM r GROUP BY 1),
q AS (SELECT *, coalesce({_OFTEN.format('x')}, 'sometimes') AS v, coalesce({_OFTEN.format('y')} = coalesce({_OFTEN.format('x')}, 'sometimes'), false) AS pair FROM p),
l AS (SELECT *, CASE WHEN pair THEN a || ' and ' || b ELSE a END AS lead, CASE WHEN pair THEN x + y ELSE x END AS total, CASE WHEN pair THEN c ELSE b END AS second, CASE WHEN pair THEN z ELSE y END AS sshare, CASE WHEN NOT pair THEN c END AS third, CASE WHEN NOT pair THEN z END AS tshare FROM q),
m AS (SELECT *, coalesce({_OFTEN.format('total')}, v) AS verb, {_SECOND.format('sshare')} AS how, coalesce(tshare >= 0.02 AND {_SECOND.format('tshare')} = {_SECOND.format('sshare')}, false) AS too FROM l)
SELECT taxon_key, CASE WHEN sshare IS NULL OR sshare < 0.02 THEN verb || ' in ' || lead WHEN how <> verb THEN verb || ' in ' || lead || ', and ' || how || ' in ' || second || CASE WHEN too THEN ' and ' || third ELSE '' END
 ELSE CASE WHEN x - sshare > 0.1 THEN coalesce({_OFTEN.format('(total + sshare + CASE WHEN too THEN tshare ELSE 0 END)')}, verb) ELSE verb END || ' in ' || lead || ', as well as ' || second || CASE WHEN too THEN ' and ' || third ELSE '' END END AS phrase FROM m""")
def category_phrase(spark, sf):
    """DSC-01."""
    rows = visible(occurrence(spark, sf)).groupBy("taxon_key", F.col("flag").alias("label")).agg(F.count("*").alias("c"))
    total = rows.groupBy("taxon_key").agg(F.sum("c").alias("t"))
    shares = rows.join(total, "taxon_key").select("taxon_key", "label", (F.col("c") / F.col("t")).alias("share"), F.lit(None).cast("string").alias("base"), F.array().cast("array<string>").alias("traits"))
    return narrative.category_phrase(shares)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'almost always in sparse and dense evergreen forests' WHEN 1 THEN 'almost always in sparse forests, and rarely in croplands' WHEN 2 THEN 'primarily in warm and cool continental climates, and sometimes in bog and fen' ELSE 'often in a x and y c, and sometimes in water' END AS phrase FROM part")
def semantic_phrase(spark, sf):
    """DSC-01/03: siblings by trait, covered classes, labels put together."""
    v = spark.sql("""select * from values
      (0, 'sparse evergreen forests', 0.5D, 'forests', array('sparse', 'evergreen')), (0, 'dense evergreen forests', 0.4D, 'forests', array('dense', 'evergreen')), (0, 'evergreen forests', 0.1D, 'forests', array('', 'evergreen')),
      (1, 'sparse evergreen forests', 0.48D, 'forests', array('sparse', 'evergreen')), (1, 'sparse deciduous forests', 0.47D, 'forests', array('sparse', 'deciduous')), (1, 'croplands', 0.05D, null, array()),
      (2, 'warm continental climates', 0.28D, 'continental climates', array('warm')), (2, 'cool continental climates', 0.26D, 'continental climates', array('cool')), (2, 'bog', 0.24D, null, array()), (2, 'fen', 0.22D, null, array()),
      (3, 'a x c', 0.2D, null, array()), (3, 'a y c', 0.2D, null, array()), (3, 'water', 0.15D, null, array()) as t(k, label, share, base, traits)""")
    v = v.withColumn("traits", F.col("traits").cast("array<string>"))
    got = narrative.category_phrase(v, "k")
    return t(spark, sf, "part").join(F.broadcast(got), F.expr("p_partkey % 4 = k")).select("p_partkey", "phrase")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation")
def bounded_jobs(spark, sf):
    """CTL-01/02: jobs started by a bounded pool, under a tag that could stop them."""
    def job(name):
        def run():
            with control.cancellable(spark, "counts"):
                return name, t(spark, sf, name).count()

        return run

    return spark.createDataFrame(list(control.run_bounded([job(n) for n in ("orders", "part", "nation")], 2, 1)), "name string, n long")


@query("SELECT 'kept' AS name, count(*) AS n FROM orders UNION ALL SELECT 'again', count(*) FROM orders")
def memoized(spark, sf):
    """CTL-03: a frame that is asked for twice is built once."""
    memo, built = control.Memo(), []

    def build():
        built.append(1)
        return t(spark, sf, "orders").select("o_orderkey")

    counts = [(name, memo.get("orders", build).count()) for name in ("kept", "again")]
    memo.release()
    if len(built) != 1:
        raise AssertionError("built twice")
    return spark.createDataFrame(counts, "name string, n long")


@query("SELECT 'sample_cap' AS name, '7' AS value UNION ALL SELECT 'broadcast_rows', '100000' UNION ALL SELECT 'window_hours', '1,2' UNION ALL SELECT 'root', '.'")
def configuration(spark, sf):
    """CTL-04: defaults, overridden by the environment."""
    c = control.Config.load({"TERRAFOLD_SAMPLE_CAP": "7", "TERRAFOLD_WINDOW_HOURS": "1,2"})
    shown = {"sample_cap": c.sample_cap, "broadcast_rows": c.broadcast_rows, "window_hours": ",".join(map(str, c.window_hours)), "root": c.root}
    return spark.createDataFrame([(k, str(v)) for k, v in shown.items()], "name string, value string")


