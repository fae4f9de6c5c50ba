"""Readers and writers (SRC-01..26, SNK-01..17). Paths may be on any file system that Spark knows (SRC-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """SRC-01/25: pruned and filtered at the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-03: a missing table is an empty one; the driver asks the file system, not the local disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def delimited(spark: SparkSession, paths, columns: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """SRC-06..10: all columns as text, malformed lines dropped, no inference pass."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "DROPMALFORMED").csv(paths)


def positional(spark: SparkSession, path: str, ordinals: dict[str, int], named: list[str] = [], sep: str = "\t") -> DataFrame:  # noqa: B006
    """SRC-09: columns taken by their place (0-based) or by their name in the header; rows too short for any of them go.

    The header is the first line of the first file; a line equal to it is a header wherever it stands."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*ordinals, *named]))
    places = ordinals | {n: head[0].split(sep).index(n) for n in named}
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    rows = lines.where(F.col("value") != head[0]).select(parts.alias("p")).where(F.size("p") > max(places.values()))
    return rows.select(*[F.col("p")[k].alias(n) for n, k in places.items()])


def vernacular_names(spark: SparkSession, comma_paths, tab_path: str) -> DataFrame:
    """SRC-08: two layouts as one table with its source."""
    own = delimited(spark, comma_paths, ["id", "vernacularName", "language", "lexicon"], ",").select(F.col("id").alias("ext_id"), F.col("vernacularName").alias("name"), "language", "lexicon", F.lit("own").alias("source"))
    other = delimited(spark, tab_path, ["taxonID", "vernacularName", "language", "source"]).select(F.col("taxonID").alias("ext_id"), F.col("vernacularName").alias("name"), "language", F.lit(None).cast("string").alias("lexicon"), "source")
    return own.unionByName(other).where("name is not null").dropDuplicates(["ext_id", "name", "language", "lexicon"])


def variable_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14, PRJ-03: categories and layers of a JSON catalogue as one row per variable, in order, with inherited sources."""
    layer = "struct<id:string,name:string,units:string,value_type:string,source_ids:array<string>>"
    raw = spark.read.schema(f"categories array<struct<id:string,source_ids:array<string>,layers:array<{layer}>>>").option("multiLine", True).json(path)
    cats = raw.select(F.posexplode("categories").alias("i", "c"))
    rows = cats.select("i", F.col("c.id").alias("category"), F.col("c.source_ids").alias("inherited"), F.posexplode("c.layers").alias("j", "l"))
    return rows.select("l.id", "l.name", "l.units", F.coalesce("l.value_type", F.lit("numeric")).alias("value_type"), F.col("category"), F.coalesce("l.source_ids", "inherited").alias("source_ids"), (F.col("i") * 1000 + F.col("j")).alias("ord"))


def expanded(variables: DataFrame, hours: list[int]) -> DataFrame:
    """PRJ-04: windowed variables `{id}_{agg}_{h}h`; others as they are. variables: id, agg (null: not windowed)."""
    h = F.explode_outer(F.when(F.col("agg").isNotNull() & (F.col("agg") != "snapshot"), F.array(*map(F.lit, hours)))).alias("h")
    return variables.select("id", "agg", h).select(F.when(F.col("h").isNull(), F.col("id")).otherwise(F.format_string("%s_%s_%dh", "id", "agg", "h")).alias("id"))


#: The regions above countries.
REGIONS = ("AFRICA", "ANTARCTICA", "ASIA", "EUROPE", "LATIN_AMERICA", "NORTH_AMERICA", "OCEANIA")


def locations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12."""
    rows = delimited(spark, path, ["level", "gid", "name", "parent_gid"], ",").withColumn("level", F.col("level").try_cast("int")).where("level is not null and gid is not null and name is not null")
    regions = spark.sql("select * from values " + ", ".join(f"(-1, '{r}', '{r}', cast(null as string))" for r in REGIONS) + " as t(level, gid, name, parent_gid)")
    return rows.unionByName(regions)


def upload(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: csv, tsv or parquet by suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    raise ValueError(f"an upload ends in .csv, .tsv or .parquet, not .{kind}")


def write(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-01..11: one commit per job; partitions replaced alone; rows clustered and sorted so that row groups prune."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-12/13."""
    df.write.mode("overwrite").option("header", True).csv(path)


def occurrence_index(values: DataFrame) -> DataFrame:
    """SNK-04/16: taxon_key, variable, catalog_number, origin, value with its place in value order."""
    order = Window.partitionBy("taxon_key", "variable").orderBy("value", "origin", "catalog_number")
    return values.where("value is not null and not isnan(value)").withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def missing_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-05, FLT-22, SET-04: what an incremental build has to compute."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


#: Names under which uploads give an id, a latitude and a longitude.
ALIASES = {"catalog_number": ("catalognumber", "id", "observationid", "occurrenceid", "gbifid"), "lat": ("lat", "latitude", "decimallatitude", "y"), "lon": ("lon", "lng", "long", "longitude", "decimallongitude", "x")}


def renamed(df: DataFrame) -> DataFrame:
    """PRJ-05: columns found by alias, upper and lower case and punctuation aside."""
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in reversed(df.columns)}
    found = {}
    for target, names in ALIASES.items():
        hit = next((plain[n] for n in names if n in plain), None) or next((c for n, c in plain.items() if target in ("lat", "lon") and {"lat": "latitude", "lon": "longitude"}[target] in n), None)
        if hit and hit not in found:
            found[hit] = target
    return df.withColumnsRenamed({a: b for a, b in found.items() if a != b and b not in df.columns})


def readable(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """PRJ-06: display names; a second use of a name gets (2)."""
    seen = {c: 1 for c in df.columns if c not in labels}
    out = []
    for c in df.columns:
        shown = labels.get(c, c)
        if c in labels:
            seen[shown] = seen.get(shown, 0) + 1
        out.append(shown if seen[shown] == 1 else f"{shown} ({seen[shown]})")
    return df.toDF(*out)
