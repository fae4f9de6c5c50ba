"""Registered queries: readers and writers, each as a round trip through files (SRC, SNK)."""

from __future__ import annotations

import io
import os
import sqlite3
import tempfile
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import hierarchy, joins, models, ranking, shaping, statistics, tallies
from ..sources import catalog, sqlite, tables
from ..storage import shared_path
from .core import CONTEXT, PCT, RANKED, metric_table, rounded
from .domain import OCC, PLACES, TAXON, occurrence, places, query, t, taxon
from .more import CELLS, cells, pixels


def _tsv(df, path, sep="\t", header=True):
    """All columns as text in a delimited file."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.option("sep", sep).option("header", header).csv(path)
    return path


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def scan_partitioned(spark, sf):
    """SRC-01/25, SNK-01: one partition and two columns of a partitioned table, filtered at the scan."""
    home = shared_path(spark, "lines")
    tables.write(t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), home, partition=["l_returnflag"])
    return tables.parquet(spark, home, ["l_orderkey", "l_quantity"], "l_returnflag = 'R' and l_quantity > 45")


@query("SELECT 'missing' AS name, 0::BIGINT AS n UNION ALL SELECT 'nation', count(*) FROM nation")
def scan_missing(spark, sf):
    """SRC-03/04: a table that is not there is an empty one."""
    schema = t(spark, sf, "nation").schema
    one = lambda name, path: tables.parquet_or_empty(spark, path, schema).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("missing", shared_path(spark, "missing")).unionByName(one("nation", f"{sf}/nation.parquet"))


@query("SELECT 's' || s_suppkey AS taxon_key, s_nationkey AS part, s_acctbal AS value, NULL::VARCHAR AS note FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, s_nationkey, s_acctbal, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def append_partitions(spark, sf):
    """SNK-02: rows added to their partitions in two jobs, the second with a column that the first did not have."""
    home = shared_path(spark, "appended")
    s = t(spark, sf, "supplier").selectExpr("s_suppkey", "'s' || s_suppkey as taxon_key", "s_nationkey as part", "s_acctbal as value", "s_name as note")
    catalog.append_occurrences(s.where("s_suppkey % 2 = 0").drop("s_suppkey", "note"), home, "part")
    catalog.append_occurrences(s.where("s_suppkey % 2 = 1").drop("s_suppkey"), home, "part")
    return catalog.read_occurrences(spark, home).select("taxon_key", F.col("part").cast("long").alias("part"), "value", "note")


@query(f"WITH {TAXON} SELECT 'taxon' AS part, taxon_key, scientific_name AS name FROM taxon UNION ALL SELECT 'taxon_name', taxon_key, lower(scientific_name) FROM taxon")
def catalog_tables(spark, sf):
    """SNK-03, SRC-13: taxa and names written and read as tables; media were not written and are empty."""
    home, x = shared_path(spark, "catalog"), taxon(spark, sf).select("taxon_key", F.col("scientific_name").alias("name"))
    catalog.write_catalog(home, taxon=x, taxon_name=x.withColumn("name", F.lower("name")))
    got = catalog.read_catalog(spark, home, dict.fromkeys(catalog.PARTS, x.schema))
    parts = [df.select(F.lit(n).alias("part"), "taxon_key", "name") for n, df in got.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def tsv_chunks(spark, sf):
    """SRC-06: a tab-separated table as text, without inference; lines with too many fields are dropped."""
    home = shared_path(spark, "orders-tsv")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    _tsv(o, f"{home}/good")
    spark.sql("select 'o_orderkey\\to_custkey\\to_orderstatus' as value union all select '1\\t2\\tF\\tone too many'").coalesce(1).write.text(f"{home}/bad")
    got = tables.delimited(spark, [f"{home}/good", f"{home}/bad"], o.columns)
    return got.selectExpr("cast(o_orderkey as bigint) as o_orderkey", "cast(o_custkey as bigint) as o_custkey", "o_orderstatus")


@query(f"WITH {TAXON} SELECT taxon_key, parent_key, rank, scientific_name, path FROM taxon WHERE EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE taxon_key IN ('s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey))")
def tsv_taxonomy(spark, sf):
    """SRC-07, HIE-15: one line per leaf with the names and keys of its ranks becomes a tree."""
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = t(spark, sf, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).selectExpr("r_name as region", "'r' || r_regionkey as region_key", "n_name as nation", "'n' || n_nationkey as nation_key", "s_name as supplier", "'s' || s_suppkey as supplier_key")
    got = tables.delimited(spark, _tsv(rows, shared_path(spark, "taxonomy-tsv")), rows.columns)
    return hierarchy.built(got, ("region", "nation", "supplier")).select("taxon_key", "parent_key", "rank", "scientific_name", "path")


@query("SELECT DISTINCT s_suppkey::VARCHAR AS ext_id, s_name AS name, 'en' AS language, 'English' AS lexicon, 'own' AS source FROM supplier UNION SELECT DISTINCT c_custkey::VARCHAR, c_name, 'de', NULL, 'other' FROM customer")
def vernacular_scan(spark, sf):
    """SRC-08: comma files and one tab file as one table with its source."""
    home = shared_path(spark, "names")
    s, c = t(spark, sf, "supplier"), t(spark, sf, "customer")
    _tsv(s.selectExpr("s_suppkey as id", "s_name as vernacularName", "'en' as language", "'English' as lexicon"), f"{home}/a", ",")
    _tsv(c.selectExpr("c_custkey as taxonID", "c_name as vernacularName", "'de' as language", "'other' as source"), f"{home}/b")
    return tables.vernacular_names(spark, [f"{home}/a"], f"{home}/b")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def positional_scan(spark, sf):
    """SRC-09: columns by place and one by its header; a short line is left out."""
    home = shared_path(spark, "wide")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    _tsv(o.coalesce(1), home)
    spark.sql("select '7\\t8' as value").coalesce(1).write.mode("append").text(home)
    got = tables.positional(spark, home, {"id": 0, "status": 2}, ["o_orderpriority"])
    return got.select(F.col("id").cast("long").alias("id"), "status", F.col("o_orderpriority").alias("priority"))


@query("SELECT p_partkey AS ext_id, p_brand AS licence, CASE WHEN p_size % 2 = 0 THEN 't' || p_partkey ELSE 's' || p_partkey % 10 END AS owner FROM part WHERE regexp_matches(lower(p_brand), 'brand#(1|2)') AND p_partkey % 3 = 0")
def multimedia_scan(spark, sf):
    """SRC-10, FLT-17, JON-11: a media file read once, usable rows of known ids with their owner."""
    p = t(spark, sf, "part").selectExpr("p_partkey as ext_id", "p_brand as licence", "'StillImage' as kind", "'http://x/' || p_partkey as url", "if(p_size % 2 = 0, 'VARIETY', 'SPECIES') as rank", "'t' || p_partkey as taxon_key", "'s' || p_partkey % 10 as species_key")
    got = tables.delimited(spark, _tsv(p, shared_path(spark, "media-tsv")), p.columns).withColumn("ext_id", F.col("ext_id").cast("long"))
    ids = t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ext_id"))
    return shaping.media_owner(tallies.usable_media(got, "brand#(1|2)", ("stillimage",)), ids, ("VARIETY",)).select("ext_id", "licence", "owner")


@query("SELECT 'N' || n_nationkey AS gid, min(n_name) AS name, 0 AS level FROM nation GROUP BY 1")
def geopackage_features(spark, sf):
    """SRC-11: the table of a SQLite file that has the level's columns, read by ranges of rows; distinct features."""
    home = shared_path(spark, "boundaries").removeprefix("file:")
    os.makedirs(home, exist_ok=True)
    rows = [tuple(r) for r in t(spark, sf, "nation").selectExpr("'N' || n_nationkey", "n_name").collect()]  # 25 rows
    with sqlite3.connect(f"{home}/places.gpkg") as con:
        con.execute("create table notes (id integer, text text)")
        con.execute('create table adm (fid integer primary key, "GID_0" text, "NAME_0" text, geom blob)')
        con.executemany('insert into adm ("GID_0", "NAME_0", geom) values (?, ?, ?)', [(*r, b"\x00") for r in rows + rows])
    return catalog.features(sqlite.boundaries(spark, f"{home}/places.gpkg", 0, 4), 0)


@query("SELECT -1 AS level, r AS gid, r AS name, NULL AS parent_gid FROM (VALUES ('AFRICA'), ('ANTARCTICA'), ('ASIA'), ('EUROPE'), ('LATIN_AMERICA'), ('NORTH_AMERICA'), ('OCEANIA')) v(r) UNION ALL SELECT 0, 'N' || n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 'ASIA' END FROM nation")
def location_csv(spark, sf):
    """SRC-12, SNK-12: places written as CSV and read with the regions; lines without a level, id or name are dropped."""
    home = shared_path(spark, "places-csv")
    rows = t(spark, sf, "nation").selectExpr("'0' as level", "'N' || n_nationkey as gid", "n_name as name", "if(n_regionkey = 2, 'ASIA', null) as parent_gid")
    tables.write_csv(rows.unionByName(rows.limit(1).withColumns({"level": F.lit("x")})), home)
    return tables.locations(spark, home)


_LAYERS = '{"categories": [{"id": "climate", "source_ids": ["a", "b"], "layers": [{"id": "bio_1", "name": "Mean", "units": "°C"}, {"id": "zone", "name": "Zone", "value_type": "categorical", "source_ids": ["z"]}]}, {"id": "soil", "layers": [{"id": "sand", "name": "Sand", "units": "%"}]}]}'


@query("SELECT * FROM (VALUES ('bio_1', 'Mean', '°C', 'numeric', 'climate', 'a|b', 0::BIGINT), ('zone', 'Zone', NULL, 'categorical', 'climate', 'z', 1), ('sand', 'Sand', '%', 'numeric', 'soil', NULL, 1000)) v(id, name, units, value_type, category, source_ids, ord)")
def layer_catalog(spark, sf):
    """SRC-14, PRJ-03: categories and layers of a JSON catalogue, sources inherited from the category."""
    home = shared_path(spark, "layers")
    spark.createDataFrame([(_LAYERS,)], "value string").coalesce(1).write.text(home)
    got = tables.variable_catalog(spark, home)
    return got.withColumns({"source_ids": F.array_join("source_ids", "|"), "ord": F.col("ord").cast("long")})


@query("SELECT * FROM (VALUES ('wind_avg_24h'), ('wind_avg_168h'), ('rain_sum_24h'), ('rain_sum_168h'), ('code'), ('bio_1')) v(id)")
def layer_expansion(spark, sf):
    """PRJ-04: windowed layers become one variable per window; snapshots stay."""
    base = spark.sql("select * from values ('wind', 'avg'), ('rain', 'sum'), ('code', 'snapshot'), ('bio_1', null) as t(id, agg)")
    return tables.expanded(base, [24, 168])


@query("SELECT event_id AS catalog_number, fmod(value, 90) AS lat, fmod(value, 180) AS lon, event_type FROM events")
def upload_columns(spark, sf):
    """SRC-22, PRJ-05: an uploaded CSV, its id and coordinates found under other names."""
    home = f"{shared_path(spark, 'upload')}.csv"
    e = t(spark, sf, "events").selectExpr("event_id as `Observation ID`", "value % 90 as `Decimal Latitude (WGS84)`", "value % 180 as LNG", "event_type")
    tables.write_csv(e, home)
    return tables.renamed(tables.upload(spark, home))


@query("SELECT * FROM (VALUES ('a', 'Mean'), ('b', 'Mean (2)'), ('Mean', 'Mean (3)'), ('c', 'c')) v(name, shown)")
def display_names(spark, sf):
    """PRJ-06: display names for columns; a second use of a name is numbered."""
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, Mean int, c int")
    got = tables.readable(df, {"a": "Mean", "b": "Mean", "Mean": "Mean"})
    return spark.createDataFrame(list(zip(df.columns, got.columns, strict=True)), "name string, shown string")


@query("SELECT * FROM (VALUES ('s_suppkey', true), ('s_nationkey', false)) v(name, is_id)")
def id_peek(spark, sf):
    """SRC-23: whether the first rows of a column look like ids: the peek is the feature."""
    s = t(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey % 2 as s_nationkey")
    return spark.createDataFrame([(c, catalog.looks_like_ids(s, c)) for c in s.columns], "name string, is_id boolean")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS ordinal FROM lineitem")
def file_order(spark, sf):
    """SRC-24: the ordinal of each row in its group, for readers that page."""
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return catalog.in_file_order(rows, ["l_suppkey"], "at").drop("at")


@query(f"WITH {CELLS} SELECT 'q' || col % 2 AS layer, \"row\" // 10 AS tile_id, count(*) AS cells FROM cell GROUP BY ALL")
def tile_inventory(spark, sf):
    """SRC-26."""
    rows = cells(spark, sf).select(F.concat(F.lit("q"), (F.col("col") % 2).cast("string")).alias("layer"), F.floor(F.col("row") / 10).alias("tile_id"))
    return catalog.tile_inventory(rows)


@query(f"WITH {OCC} SELECT flag AS taxon_key, 'quantity' AS variable, obs_id AS catalog_number, 0 AS origin, quantity AS value, row_number() OVER (PARTITION BY flag ORDER BY quantity, obs_id) - 1 AS pos FROM occ")
def index_table(spark, sf):
    """SNK-04/16, SRT-01: the value-ordered index written sorted, so that a lookup reads few row groups, and read back."""
    home = shared_path(spark, "index")
    rows = occurrence(spark, sf).select(F.col("flag").alias("taxon_key"), F.lit("quantity").alias("variable"), F.col("obs_id").alias("catalog_number"), F.lit(0).alias("origin"), F.col("quantity").alias("value"))
    tables.write(tables.occurrence_index(rows), home, sort=["taxon_key", "variable", "pos"])
    return spark.read.parquet(home)


@query(f"WITH {RANKED}, m AS (SELECT context, taxon_key, variable, metric, value * 2 AS value, samples FROM ranked WHERE context = 'n3' UNION ALL SELECT context, taxon_key, variable, metric, value, samples FROM ranked WHERE context <> 'n3' UNION ALL SELECT context, taxon_key, variable, 'half', value / 2, samples FROM ranked), r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY context, variable, metric) AS cnt FROM m WINDOW w AS (PARTITION BY context, variable, metric ORDER BY value, taxon_key)) SELECT context, taxon_key, variable, metric, value, samples, pos, cnt, {PCT} AS percentile FROM r")
def rank_index_merge(spark, sf):
    """SNK-06: an index on disk gets a new metric, and one of its own anew in one context."""
    home, m = shared_path(spark, "rank-index"), metric_table(spark, sf)
    tables.write(ranking.positions(m, CONTEXT), home, partition=["context"])
    new = m.where("context = 'n3'").withColumn("value", F.col("value") * 2).unionByName(m.withColumns({"metric": F.lit("half"), "value": F.col("value") / 2}))
    return catalog.merged_rank_index(spark.read.parquet(home), new, ["context"])


@query(f"WITH {RANKED} SELECT taxon_key, variable, metric, context, CASE WHEN context = 'n3' THEN -1 ELSE pos END AS pos FROM ranked")
def rank_positions_table(spark, sf):
    """SNK-07, SET-05: places per taxon on disk; new rows only where a (variable, metric, context) is not there yet."""
    home = shared_path(spark, "positions")
    own = ranking.positions(metric_table(spark, sf), CONTEXT).select("taxon_key", "variable", "metric", "context", "pos")
    tables.write(own.where("context = 'n3'").withColumn("pos", F.lit(-1).cast("long")), home, sort=["taxon_key"])
    return joins.insert_if_absent(spark.read.parquet(home), own, ["taxon_key", "variable", "metric", "context"], ["pos"])


@query(f"WITH {PLACES} SELECT scope, gid, taxon_key, count(*) AS cnt FROM (SELECT 'region' AS scope, region AS gid, taxon_key FROM places UNION ALL SELECT 'level0', level0, taxon_key FROM places) GROUP BY ALL")
def membership_table(spark, sf):
    """SNK-11: membership written sorted by place, and read back."""
    home = shared_path(spark, "membership")
    tables.write(statistics.location_counts(places(spark, sf), ["region", "level0"], "taxon_key"), home, sort=["scope", "gid", "taxon_key"])
    return spark.read.parquet(home)


@query("SELECT 'region.parquet' AS name, count(*) AS n FROM region UNION ALL SELECT 'region.csv', count(*) FROM region UNION ALL SELECT 'lists.parquet', count(*) FROM region UNION ALL SELECT 'lists.csv', count(*) FROM region UNION ALL SELECT 'data_sources.json', 1")
def upload_archive(spark, sf):
    """SNK-13: each table as Parquet and CSV, nested columns as JSON, and the sources, in one ZIP file."""
    import pyarrow.parquet as pq

    r = t(spark, sf, "region").select("r_regionkey", "r_name")
    path = catalog.write_archive(spark, f"{shared_path(spark, 'archive')}.zip", {"region": r, "lists": r.select("r_name", F.array("r_name", "r_name").alias("both"))}, {"a": 1})
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])  # one upload
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        count = {"parquet": lambda b: pq.read_table(io.BytesIO(b)).num_rows, "csv": lambda b: len(b.decode().splitlines()) - 1, "json": lambda b: 1}
        rows = [(n, count[n.rsplit(".", 1)[1]](z.read(n))) for n in z.namelist()]
    return spark.createDataFrame(rows, "name string, n long")


@query('WITH px AS (SELECT l_partkey // 10 AS "row", l_suppkey % 10 AS col, l_quantity AS value FROM lineitem) SELECT "row", col, count(*) AS n, sum(value) AS total FROM px GROUP BY ALL')
def raster_state(spark, sf):
    """SNK-17: component sums on disk, to which a later batch adds."""
    home, px = shared_path(spark, "grid-state"), pixels(spark, sf).select("row", "col", "value", "d1")
    none = px.where("false").select("row", "col", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
    tables.write(catalog.added_state(none, px.where("d1 <= 0.05"), ["row", "col"]), home)
    return catalog.added_state(spark.read.parquet(home), px.where("not d1 <= 0.05"), ["row", "col"])


@query("SELECT count(*) AS n, count(*) AS same FROM events")
def model_artifact(spark, sf):
    """SNK-19: a fitted pipeline saved and loaded scores every row alike."""
    home = shared_path(spark, "model")
    e = t(spark, sf, "events").select("event_id", F.col("value").alias("v"), F.col("event_type").alias("kind"), (F.col("value") > 50).cast("double").alias("label"))
    model = models.pipeline(["v"], ["kind"], "logistic").fit(e)
    own = models.scored(model, e).select("event_id", "label", "score")
    models.save(model, home, models.metrics(own), {"kind": "logistic"})
    again = models.scored(models.load(home), e).select("event_id", F.col("score").alias("again"))
    return own.join(again, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") == F.col("again")).alias("same"))


@query("SELECT r_name AS line FROM region")
def cached_blob(spark, sf):
    """SRC-05: a file copied to the driver once; the second request finds the copy."""
    home = shared_path(spark, "blob")
    t(spark, sf, "region").select("r_name").coalesce(1).write.text(home)
    file = next(r[0] for r in spark.read.format("binaryFile").load(home).select("path").collect())
    with tempfile.TemporaryDirectory() as local:  # the driver's own cache
        first, second = (catalog.cached_file(spark, file, local) for _ in range(2))
        if first != second or len(os.listdir(local)) != 1:
            raise AssertionError("the second request made another copy")
        with open(first) as f:
            lines = [(x.rstrip("\n"),) for x in f]
    return spark.createDataFrame(lines, "line string")


@query(f"WITH {CELLS}, e AS (SELECT event_id, user_id, fmod(value, 10) AS lat, fmod(value * 3, 10) AS lon FROM events) SELECT event_id, floor((lat + 90) * 1)::BIGINT AS r, round(c.value, 6) AS layer FROM e LEFT JOIN cell c ON c.\"row\" = floor(lat + 90) - 90 AND c.col = floor(lon + 180) - 180")
def upload_rows(spark, sf):
    """API-09, RAS-03, FLT-14/15: an uploaded file checked and enriched with a layer's value at its points."""
    home = f"{shared_path(spark, 'upload')}.csv"
    tables.write_csv(t(spark, sf, "events").selectExpr("event_id", "value % 10 as latitude", "value * 3 % 10 as longitude"), home)
    layer = cells(spark, sf).select((F.col("row") + 90).alias("row"), (F.col("col") + 180).alias("col"), "value")
    rows, _ = catalog.processed_upload(spark, home, {"layer": layer}, 1, {"tile_id"})
    return rounded(rows.select(F.col("event_id").cast("long").alias("event_id"), F.floor(F.col("lat") + 90).alias("r"), "layer"), "layer")


@query(f"WITH {CELLS}, e AS (SELECT event_id, fmod(value, 10) AS lat, fmod(value * 3, 10) AS lon FROM events), v AS (SELECT event_id, c.value AS layer, floor(c.value) AS class FROM e LEFT JOIN cell c ON c.\"row\" = floor(lat + 90) - 90 AND c.col = floor(lon + 180) - 180) SELECT 'occurrence' AS name, count(*) AS n FROM v UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'density', 1 UNION ALL SELECT 'categories', 3 + count(DISTINCT class) FROM v UNION ALL SELECT 'index', count(layer) + count(class) FROM v")
def upload_artifacts(spark, sf):
    """API-09: the rows of each artifact of an upload."""
    home = f"{shared_path(spark, 'upload')}.csv"
    tables.write_csv(t(spark, sf, "events").selectExpr("event_id", "value % 10 as latitude", "value * 3 % 10 as longitude"), home)
    layer = cells(spark, sf).select((F.col("row") + 90).alias("row"), (F.col("col") + 180).alias("col"), "value")
    got = catalog.upload_tables(spark, home, {"layer": layer, "class": layer.withColumn("value", F.floor("value").cast("double"))}, 1, {"class"})
    return spark.createDataFrame([(n, df.count()) for n, df in got.items()], T.StructType().add("name", "string").add("n", "long"))
