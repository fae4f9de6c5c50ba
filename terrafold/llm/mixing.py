"""Mixing sources to target weights (op8): DataFrame functions only.

Documents get a fixed hash.  One scan counts words and stages id, source, size and hash; all that follows reads these
narrow rows.  Words are summed by source and hash bucket; running sums find, for each source, the bucket in which its
budget ends; only documents of that bucket are summed again, by finer hash bits; then a document is taken by comparing
its hash with its source's threshold: no document is sorted.  Thresholds nest: a lower target takes a subset.
A source that is to give more than its size is taken whole once, and once more below the threshold of the rest.

Targets: `share` times all words, split by weight; a target stops at `most` times its source's size, and what is over
goes to the others by weight until none is above (water filling, from the sources sorted by size per weight).  Sources
are numbered and summed by ranges, so they may be many.

Defined results: null text has size 0; null is a source of its own, last; rows that repeat a doc_id share a hash and
are taken alike; rows without doc_id are hashed by their text instead; a source of size 0 has target 0; an empty table
gives an empty result; other columns are kept out, or kept as they are with `mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered, summed_below
from .common import SPACE, spread, staged

BITS = (12, 12, 12)
BROADCAST_SOURCES = 100_000
WEIGHTS = (5, 2, 1)


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def hash_of(doc_id, text):
    """36 bits, the same in any SQL engine: the first nine hexadecimal digits of the MD5 of the id as text, or of the text where there is no id."""
    return F.conv(F.substr(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), F.lit(1), F.lit(9)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds target."""
    w = numbered(sizes.select("source", "source_size"), [F.asc_nulls_last("source")], "i")
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    w = summed_below(w.withColumn("per_weight", F.col("source_size") / F.col("weight")), [F.asc("per_weight"), F.asc("i")], {"full_size": F.col("source_size"), "full_weight": F.col("weight")})
    all_size, all_weight = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # The level if all sources before this one are at their limit; a source is at its limit if that level reaches it.
    level = (F.lit(share) * F.lit(all_size) - F.lit(most) * F.col("full_size")) / (F.lit(all_weight) - F.col("full_weight"))
    w = w.withColumn("level", level).withColumn("limit", F.lit(most) * F.col("source_size"))
    w = staged(w.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("limit")), "levels")
    final = w.where("not is_full").agg(F.min(F.struct("per_weight", "i", "level"))["level"]).first()[0]
    return w.select("source", "source_size", F.when(F.col("is_full"), F.col("limit")).otherwise(F.lit(final) * F.col("weight")).alias("target"))


def _rows(docs: DataFrame, *more) -> DataFrame:
    """The narrow rows of documents: doc_id, source, size, hash."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), hash_of(F.col("doc_id"), text).alias("hash"), *more)


def _at_source(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their source's row in plan (which has _of for source); null is a source like others."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows, plan = rows.withColumn("_key", key("source")), plan.withColumn("_key", key("_of")).drop("_of")
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "_key").drop("_key")
    return spread(rows, plan, ["_key"], ["hash"]).drop("_key")


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows: source, size, hash. Per source: source, source_size, target, copies (whole ones), threshold (of the last one)."""
    left = sum(BITS)
    bucket = F.shiftright("hash", left - BITS[0])
    histogram = staged(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    # Whole copies first, then the part of the next copy that the threshold is to give.
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("copies", copies.cast("long"))
    plan = staged(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long")), "targets")
    n = plan.count()
    for k, bits in enumerate(BITS):
        left -= bits
        if k:
            inside = F.shiftright("hash", left + bits) == F.shiftright("threshold", left + bits)
            part = _at_source(rows, plan.where("rest > 0").select(F.col("source").alias("_of"), "threshold"), n).where(inside)
            histogram = part.groupBy("source", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = histogram.withColumn("upto", F.sum("words").over(run))
        named = plan.select(F.col("source").alias("s"), "rest")
        sums = sums.join(named, F.col("source").eqNullSafe(F.col("s")))
        # The first bucket that passes the rest is the boundary; those below it are taken.
        fit = F.col("upto") <= F.col("rest")
        edge = sums.groupBy("source").agg(F.min(F.when(~fit, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(fit, F.col("upto"))), F.lit(0)).alias("below"), F.max("bucket").alias("last"), F.min_by("words", F.when(~fit, F.col("bucket"))).alias("edge_words"))
        edge = edge.select(F.col("source").alias("s"), "edge", "below", "last", "edge_words")
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        start = F.shiftleft(F.coalesce("edge", F.col("last") + 1), left) if left else F.coalesce("edge", F.col("last") + 1)
        if not left:  # the smallest bucket is taken if that comes nearer
            nearer = F.coalesce(F.col("edge_words") - (F.col("rest") - F.col("below")) < F.col("rest") - F.col("below"), F.lit(False))
            start = start + F.when(nearer, 1).otherwise(0)
        moved = F.when(F.col("last").isNull(), F.col("threshold")).otherwise(start)
        plan = plan.select("source", "source_size", "target", "copies", (F.col("rest") - F.coalesce("below", F.lit(0))).alias("rest"), moved.cast("long").alias("threshold"))
        plan = staged(plan, f"threshold-{k}")
    return plan.select("source", "source_size", "target", "copies", "threshold")


def taken_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, hash and others) with source_size, target and taken."""
    taken = F.col("size") * (F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0))
    return _at_source(rows, plan.withColumnRenamed("source", "_of"), plan.count()).withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: the words of each document that the mix takes."""
    rows = staged(_rows(docs), "sizes")
    return taken_of(rows, thresholds(rows, weights, share, most)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, result: str = "mix") -> DataFrame:
    """Whole rows of docs, each with its own result: a struct of size, source_size, target and taken. Nothing is joined by id."""
    plan = thresholds(staged(_rows(docs), "sizes"), weights, share, most)
    whole = _rows(docs, F.struct(*docs.columns).alias("_row"))
    return taken_of(whole, plan).select("_row.*", F.struct("size", "source_size", "target", "taken").alias(result))
