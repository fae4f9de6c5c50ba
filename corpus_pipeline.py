"""A corpus pipeline of five stages; each keeps or drops rows of documents for the next.

1. quality: documents that the classifier rejects (score under 0.5) go.
2. exact: of equal texts, white space aside, the longest original with the smallest id stays; of rows equal in both, one.
3. near: of documents joined by 5-word shingles with a similarity of 0.8 or more, the smallest id of each group stays.
4. benchmark: documents with a 10-word window of a benchmark item go.
5. mix: documents of which the mix takes words stay, with size, source_size, target and taken.

A decision is about one row, whatever ids other rows have: the first, fourth and fifth stage judge whole rows where they
lie, and the other two name the rows to drop by file and place.  Rows without doc_id sort last.  Empty tables pass
through as empty tables; other columns are kept as they are, and where documents has a column that the mix adds, the
mix's own is called `mix_` and its name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from terrafold.llm.common import bounded_broadcast, shared_path, staged, table
from terrafold.operators.ranking import numbered

FILE, PLACE, NODE, DECISION = "__file", "__place", "__node", "__decision"
BROADCAST_ROWS = 1_000_000


def _placed(docs: DataFrame) -> DataFrame:
    """docs with the file and the place in it of each row; a frame that is not read from files is written first."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return staged(docs, "documents").select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def _without(docs: DataFrame, drop: DataFrame, key: list[str]) -> DataFrame:
    """docs without the rows that drop names."""
    drop = staged(drop, "dropped-rows")
    return docs.join(bounded_broadcast(drop, drop.count(), BROADCAST_ROWS), key, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; labels are read, but never decide on their own document."""
    found = quality.scored_rows(docs, table(spark, sf_dir, "labels"), result=DECISION)
    return found.where(f"{DECISION}.predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; rows that repeat id and text count as copies like others."""
    placed = _placed(docs)
    found = exact_dedup.exact_duplicates(placed, carry=(FILE, PLACE))
    return _without(placed, found.where("not kept").select(FILE, PLACE), [FILE, PLACE]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows that share a doc_id, or have none, are documents of their own."""
    placed, key = docs, "doc_id"
    unclear = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not unclear.isEmpty():
        placed, key = _placed(docs), NODE
        order = [F.asc_nulls_last("doc_id"), F.asc(FILE), F.asc(PLACE)]
        placed = placed.join(numbered(placed.select("doc_id", FILE, PLACE), order, NODE).drop("doc_id"), [FILE, PLACE])
    found = ngram_join.near_duplicates(placed.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80)
    return _without(placed, found.where("component_id != doc_id").select(F.col("doc_id").alias(key)), [key]).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item."""
    found = decontaminate.contaminated_rows(docs, table(spark, sf_dir, "benchmark"), result=DECISION)
    return found.where(f"not {DECISION}.contaminated").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with the words it takes of each."""
    found = mixing.mixed_rows(docs, result=DECISION).where(f"{DECISION}.taken > 0")
    own = [F.col(f"{DECISION}.{c}").alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")]
    return found.select(*docs.columns, *own)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]
#: A classifier decides what the other stages get, which SQL cannot express; a test holds the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep; each stage is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
