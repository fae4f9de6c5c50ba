"""Catalogue tables, tile inventories and the upload job (SRC-11, SRC-13, SRC-18, SRC-23, SRC-26, SNK-02, SNK-03, SNK-17, API-09)."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters, raster, ranking, shaping, statistics
from .tables import occurrence_index, parquet_or_empty, renamed, upload, write

PARTS = ("taxon", "taxon_name", "taxon_media")


def write_catalog(path: str, **parts: DataFrame) -> None:
    """SNK-03: taxa, names and media as three tables; keys are text; sorted by key, so that a lookup prunes."""
    for name in PARTS:
        if name in parts:
            write(parts[name].withColumn("taxon_key", F.col("taxon_key").cast("string")), f"{path}/{name}", sort=["taxon_key"])


def read_catalog(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """SRC-13: a part that was not written is an empty table of its schema."""
    return {name: parquet_or_empty(spark, f"{path}/{name}", schemas[name]) for name in PARTS if name in schemas}


def append_occurrences(df: DataFrame, path: str, partition: str) -> None:
    """SNK-02: rows added to their partition; a column new to the table is null in the older files."""
    df.repartition(partition).write.mode("append").partitionBy(partition).parquet(path)


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def features(rows: DataFrame, level: int) -> DataFrame:
    """SRC-11: distinct (gid, name) of a level from a boundary table with GID_n and NAME_n, landed by any reader; the first name holds."""
    got = rows.select(F.col(f"GID_{level}").alias("gid"), F.trim(F.col(f"NAME_{level}")).alias("name")).where("gid is not null and gid != ''")
    return got.groupBy("gid").agg(F.min("name").alias("name")).withColumn("level", F.lit(level))


def tile_inventory(cells: DataFrame) -> DataFrame:
    """SRC-26: the tiles of each layer, with their cells."""
    return cells.groupBy("layer", "tile_id").agg(F.count("*").alias("cells"))


def looks_like_ids(df: DataFrame, column: str, rows: int = 50) -> bool:
    """SRC-23: a peek at the first rows, which is all the feature looks at: no blank among them, and none twice."""
    seen = [r[0] for r in df.select(column).limit(rows).collect()]
    return bool(seen) and all(v is not None and str(v).strip() for v in seen) and len(set(seen)) == len(seen)


def added_state(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-17: component sums (n, total) of a state and of new rows (value) as the next state; the grid is total / n."""
    fresh = new.where("value is not null and not isnan(value)").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return state.select(*keys, "n", "total").unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def processed_upload(spark: SparkSession, path: str, layers: dict[str, DataFrame], cells_per_degree: int, reserved: set[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """API-09: an uploaded file normalised, checked and enriched with the value of each layer at its points, and its summary.

    layers: name -> (row, col, value), row and col counted from the south-west corner of the globe.  Rows keep their own
    columns first; a row whose cell has no value gets null.
    """
    df = filters.checked_coordinates(filters.checked_columns(renamed(upload(spark, path)), set(reserved) | set(layers)))
    own = df.columns
    row = F.floor((F.col("lat").cast("double") + 90) * cells_per_degree)
    col = F.floor((F.col("lon").cast("double") + 180) * cells_per_degree)
    for name, cells in layers.items():
        df = raster.point_sample(df, cells, row, col).withColumnRenamed("value", name).drop("row", "col")
    rows = df.select(*own, *layers)
    tall = statistics.tall(rows.select(*[F.col(c).cast("double").alias(c) for c in layers]).withColumn("taxon_key", F.lit("upload")), ["taxon_key"], list(layers))
    return rows, statistics.summary(tall, ["taxon_key", "variable"])


def in_file_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SRC-24: the ordinal of a row within its keys, for readers that page through a group."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def merged_rank_index(old: DataFrame, new: DataFrame, context: list[str]) -> DataFrame:
    """SNK-06: a rank index (context, variable, metric, taxon_key, value, samples, ...) with the metrics of `new` in place of
    its own of the same name, the others kept, and places of all of them."""
    column = [*context, "variable", "metric"]
    rows = [*column, "taxon_key", "value", "samples"]
    kept = old.select(*rows).join(new.select(*column).distinct(), column, "left_anti")
    return ranking.positions(kept.unionByName(new.select(*rows)), column)


def cached_file(spark: SparkSession, path: str, home: str) -> str:
    """SRC-05: a local copy of a remote file, made once: the same size and time as the remote one is the same file.  The copy
    gets its name when it is whole."""
    jvm = spark.sparkContext._jvm
    remote = jvm.org.apache.hadoop.fs.Path(path)
    files = remote.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.getFileStatus(remote)
    local = os.path.join(home, f"{status.getLen()}-{status.getModificationTime()}-{remote.getName()}")
    if not os.path.exists(local):
        os.makedirs(home, exist_ok=True)
        part = tempfile.mkdtemp(dir=home)
        whole = os.path.join(part, remote.getName())
        files.copyToLocalFile(False, remote, jvm.org.apache.hadoop.fs.Path(f"file:{whole}"), True)
        os.replace(whole, local)
        os.rmdir(part)
    return local


def write_archive(spark: SparkSession, path: str, tables: dict[str, DataFrame], sources: dict, home: str | None = None) -> str:
    """SNK-13: a ZIP file with each table as Parquet and as CSV and the data sources as JSON, at `path`.

    An archive is for one upload, so each table is one file; the ZIP file is put together on the driver and then copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    work = tempfile.mkdtemp(dir=home)  # the driver's own: executors never see it
    name = os.path.join(work, "archive.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for table, df in tables.items():
            for kind in ("parquet", "csv"):
                folder = f"{path}.parts/{table}.{kind}"
                w = df.coalesce(1).write.mode("overwrite")
                w.parquet(folder) if kind == "parquet" else flat(df).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
                home_of = jvm.org.apache.hadoop.fs.Path(folder)
                files = home_of.getFileSystem(conf)
                for f in files.listStatus(home_of):
                    if f.getPath().getName().startswith("part-"):
                        local = os.path.join(work, f"{table}.{kind}")
                        files.copyToLocalFile(False, f.getPath(), jvm.org.apache.hadoop.fs.Path(f"file:{local}"), True)
                        out.write(local, f"{table}.{kind}")
                        os.remove(local)
        out.writestr("data_sources.json", json.dumps(sources))
    to = jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(conf)
    files.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file:{name}"), to)
    files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), True)
    os.rmdir(work)
    return path


def flat(df: DataFrame) -> DataFrame:
    """SNK-13: nested columns as JSON text, as CSV has none."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema])


def upload_tables(spark: SparkSession, path: str, layers: dict[str, DataFrame], cells_per_degree: int, categorical: set[str] = frozenset(), reserved: set[str] = frozenset()) -> dict[str, DataFrame]:
    """API-09: the artifacts of an uploaded file: the enriched rows, summaries and densities of numeric layers, shares of
    categorical ones, and the value-ordered index.  Rows that are obscured or too uncertain are not summed up."""
    rows, _ = processed_upload(spark, path, layers, cells_per_degree, reserved)
    if "catalog_number" not in rows.columns:
        rows = rows.withColumn("catalog_number", F.lit(None).cast("string"))
    rows = shaping.with_names(rows.withColumn("_order", F.monotonically_increasing_id()), "catalog_number", "_order").drop("_order")
    good = filters.visible(rows, need_place=False)
    numeric = [c for c in layers if c not in categorical]
    values = statistics.tall(good.select("catalog_number", *[F.col(c).cast("double").alias(c) for c in layers]), ["catalog_number"], list(layers))
    known = values.where(F.col("variable").isin(*numeric))
    found = {"occurrence": rows, "summary": shaping.stored_summary(statistics.summary(known, ["variable"]), ["variable"]), "density": shaping.density_rows(statistics.density(known, ["variable"]), ["variable"])}
    shares = [statistics.category_metrics(good.select(F.lit(c).alias("variable"), F.col(c).cast("long").alias("class")), ["variable"], "class") for c in sorted(categorical & set(layers))]
    for table in shares:
        found["categories"] = found["categories"].unionByName(table) if "categories" in found else table
    index = values.select(F.lit("upload").alias("taxon_key"), "variable", "catalog_number", F.lit(0).alias("origin"), "value")
    return found | {"index": occurrence_index(index)}
