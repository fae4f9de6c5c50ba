"""The domain on the driver's star schema: which table stands for what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def occurrence(spark, sf) -> DataFrame:
    """lineitem: one observation per line, its supplier as the taxon."""
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("taxon_key"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_partkey", "l_suppkey", "l_orderkey")


def visible(df: DataFrame) -> DataFrame:
    return df.where("status = 'O' and discount <= 0.05 and quantity is not null")


def taxon(spark, sf) -> DataFrame:
    r = t(spark, sf, "region").selectExpr("'r' || r_regionkey as taxon_key", "cast(null as string) as parent_key", "'REGION' as rank", "r_name as scientific_name", "'r' || r_regionkey as path")
    n = t(spark, sf, "nation").selectExpr("'n' || n_nationkey as taxon_key", "'r' || n_regionkey as parent_key", "'NATION' as rank", "n_name as scientific_name", "'r' || n_regionkey || '/n' || n_nationkey as path")
    s = t(spark, sf, "supplier").join(F.broadcast(t(spark, sf, "nation")), F.expr("s_nationkey = n_nationkey")).selectExpr("'s' || s_suppkey as taxon_key", "'n' || s_nationkey as parent_key", "'SUPPLIER' as rank", "s_name as scientific_name", "'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey as path")
    return r.unionByName(n).unionByName(s)


def places(spark, sf) -> DataFrame:
    """Observations with the nation and region of their customer as location."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return occurrence(spark, sf).join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey")).join(F.broadcast(n), F.expr("c_nationkey = n_nationkey")).withColumns({"level0": F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "region": F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))})


OCC = "occ AS (SELECT l_orderkey * 8 + l_linenumber AS obs_id, 's' || l_suppkey AS taxon_key, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, l_partkey, l_suppkey, l_orderkey FROM lineitem)"
VIS = OCC + ", vis AS (SELECT * FROM occ WHERE status = 'O' AND discount <= 0.05 AND quantity IS NOT NULL)"
TAXON = "taxon AS (SELECT 'r' || r_regionkey AS taxon_key, NULL AS parent_key, 'REGION' AS rank, r_name AS scientific_name, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'NATION', n_name, 'r' || n_regionkey || '/n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SUPPLIER', s_name, 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
CLOSURE = TAXON + ", closure AS (SELECT a.taxon_key AS ancestor, d.taxon_key AS descendant, len(string_split(d.path, '/')) - len(string_split(a.path, '/')) AS depth FROM taxon d JOIN taxon a ON d.path = a.path OR starts_with(d.path, a.path || '/'))"
PLACES = OCC + ", places AS (SELECT occ.*, 'N' || n_nationkey AS level0, 'R' || n_regionkey AS region FROM occ JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
