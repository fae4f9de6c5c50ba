"""Boilerplate lines by site-relative frequency (op9): DataFrame functions only.

A page's lines are its text blocks.  For each host, the pages that contain a line are counted and divided by the
host's pages; lines over `ratio` on a host with at least `min_pages` pages are dropped from its pages.  Counting
needs two 64-bit hashes of each line, not its text, is pre-aggregated before the shuffle, and never gathers a host.

A host keeps at most (lines of a page on average) / ratio such lines, which bounds the list that is joined back.  In
both joins a host with more rows than an average task is dealt over tasks.

Defined results: null html has no lines; a page without host belongs to the site with empty host; a line repeated in a
page counts once for it, and all its repeats are dropped; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, staged
from .url_rules import host_of

HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|table|tr|td|nav|article|section|footer|header|head|body|title|html)\b[^>]*>"
TAG = r"<[^>]*>"


def lines_of(html):
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def key_of(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def site_lines(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), host_of(F.col("url").cast("string"))[0].alias("host"), lines_of(F.col("html").cast("string")).alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """page_id, host, lines (kept), n_lines, n_dropped."""
    sites = site_lines(pages)
    total = staged(sites.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    seen = sites.select("host", F.explode(F.array_distinct(F.transform("lines", key_of))).alias("key"))
    seen = staged(seen.groupBy("host", "key").agg(F.count("*").alias("pages")).where("pages > 1"), "repeated-lines")
    large = total.where(F.col("n") >= min_pages).withColumnRenamed("n", "host_pages")
    common = spread(seen, large, ["host"], ["key"]).where(F.col("pages") / F.col("host_pages") > ratio)
    common = staged(common.groupBy("host").agg(F.collect_list("key").alias("keys")), "boilerplate")
    known = spread(sites, common, ["host"], ["page_id"], total, "left")
    none = F.array().cast(common.schema["keys"].dataType)
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("keys", none), key_of(x)))
    return known.withColumn("kept", kept).select("page_id", "host", F.col("kept").alias("lines"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
