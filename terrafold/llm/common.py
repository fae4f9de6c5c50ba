"""What several operators share: reading, staging on shared storage, small digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, shared_path, staged

__all__ = ["SPACE", "bounded_broadcast", "held_out", "hot_keys", "dealt", "repeated", "rows_of", "shared_dir", "shared_path", "small_batches", "spread", "staged", "table", "with_rows"]

SPACE = "\\x20\\x09-\\x0D"
BATCH_ROWS = 512
SPREAD_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few hundred rows: a batch of very long texts still fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only for a frame whose counted rows are within the limit; else a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and `_row`, a struct of all the other columns and doc_id as it is: what a pass over whole rows gets."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("_row"))


def rows_of(docs: DataFrame) -> list:
    """The columns of docs, from a frame with the text and `_row` of `with_rows`."""
    return [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]


def hot_keys(counts: DataFrame, keys: list[str], least: int = 1, small: int | None = None) -> DataFrame | None:
    """Of counts (keys, n: the rows of each key), the hot keys with the salts to deal them over; None if there are none.

    A key is hot if it has more rows than an average task, so there are fewer hot keys than tasks, whatever the data: that
    bounds the list, which is broadcast.  No salt gets fewer than about `least` rows; up to `small` rows in all are not dealt.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if total <= (SPREAD_ROWS if small is None else small):  # all of it fits one task
        return None
    usual = max(1, least, total // tasks)
    hot = staged(counts.where(F.col("n") > usual).select(*keys, F.ceil(F.col("n") / usual).cast("int").alias("_salts")), "hot-keys")
    return None if hot.isEmpty() else F.broadcast(hot)


def dealt(df: DataFrame, hot: DataFrame | None, keys: list[str], by: list[str]) -> DataFrame:
    """df with `_salt`: for a hot key one of its salts, by a hash of the columns `by`; else 0."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return df.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")


def repeated(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """df with `_salt`: a row of a hot key once for each of its salts."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return df.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def spread(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """A join on keys in which the rows of big with a hot key are dealt over several tasks.

    counts: keys and n, the rows of big by key, where they are known.  how: inner, left, left_semi or left_anti.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    hot = hot_keys(counts, keys)
    if hot is None:
        return big.join(small, keys, how)
    return dealt(big, hot, keys, by).join(repeated(small, hot, keys), [*keys, "_salt"], how).drop("_salt")


def held_out(doc_id, parts: int, part: int):
    """True where crc32 of doc_id as text leaves that remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(False))
