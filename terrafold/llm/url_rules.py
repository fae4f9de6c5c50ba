"""URL rules by sort-merge range joins (op7): DataFrame functions only.

Both parts of a rule are intervals of keys.  Hosts are written as reversed labels, each ended by a dot
(`com.example.www.`), so that a rule's host and all its subdomains go from `com.example.` up to, not including,
`com.example/`.  Paths are their UTF-8 bytes: those that begin with a rule's path go from it up to it with a byte 255
appended, which no text has.  Intervals nest or are apart.

In a sweep, interval starts, interval ends and points are sorted together.  A running sum of starts and ends is the depth
of the stack of active nested rules; the top of the stack at a point is the last start of the point's own depth.  The
first sweep finds, for each url, the deepest rule host that holds it; with it come the rule hosts above, at most one per
label.  The second sweep, of urls and rule paths within each of those hosts, finds the longest path.  Of the rules that
are found, the longest decides.

Hosts with more urls than an average task are dealt over salts, and rule boundaries are repeated for those alone; no row
carries the rules of a host.  Defined results: null url or one without `://`: host and path are empty and no rule fits;
rules with null or empty host are ignored; a null path is empty; of rules that are equally long (host and path together)
a blocking one holds before an allowing one, then that of the longer host; no fitting rule: `default_verdict`; rows that
repeat a page_id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, hot_keys, repeated, staged

FEW = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    rest = F.substr(url, F.instr(url, "://") + 3)
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def reversed_key(host):
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))).otherwise("")


def swept(points: DataFrame, rules: DataFrame, group: str, by: str) -> DataFrame:
    """points (group, key, ...) with `top`: the `held` of the innermost of rules (group, start, stop, held) around key."""
    # A salt has a quarter as many points as there are rules, at least: rules are repeated four times as often as points at most.
    hot = hot_keys(points.groupBy(group).agg(F.count("*").alias("n")), [group], least=rules.count() // 4, small=FEW)
    bounds = F.array(F.struct(F.col("start").alias("key"), F.lit(0).alias("kind"), "held"), F.struct(F.col("stop").alias("key"), F.lit(-1).alias("kind"), "held"))
    edges = repeated(rules.select(group, F.explode(bounds).alias("_e")).select(group, "_e.*"), hot, [group])
    rows = dealt(points, hot, [group], [by]).withColumn("kind", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    upto = Window.partitionBy(group, "_salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == -1, -1).otherwise(0)
    rows = rows.withColumn("_depth", F.sum(step).over(upto)).where("kind >= 0")
    level = Window.partitionBy(group, "_salt", "_depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("kind") == 0, F.col("held")), ignorenulls=True).over(level)
    return rows.withColumn("top", F.when(F.col("_depth") > 0, top)).where("kind = 1").select(*points.columns, "top")


def host_intervals(rules: DataFrame) -> DataFrame:
    """label, start, stop, held: per rule host its interval and the rule hosts around it, itself included."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    pairs = hosts.select("host", F.explode(above).alias("around")).join(hosts.select(F.col("host").alias("around")), "around")
    chains = pairs.groupBy("host").agg(F.sort_array(F.collect_list("around")).alias("held"))  # at most one per label
    key = reversed_key(F.col("host"))
    chains = chains.select(key.alias("start"), "held")
    return chains.select(F.regexp_extract("start", "^[^./]*", 0).alias("label"), "start", F.concat(F.expr("substr(start, 1, length(start) - 1)"), F.lit("/")).alias("stop"), "held")


def judge_urls(pages: DataFrame, rules: DataFrame, default_verdict: str = "allow") -> DataFrame:
    """pages: page_id, url. rules: host, path, verdict. Result: page_id, host, path, rule, verdict."""
    rules = rules.where("host is not null and host != ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = staged(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")  # 'block' sorts after 'allow'
    host, path = host_of(F.col("url").cast("string"))
    urls = staged(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    key = reversed_key(F.col("host"))
    points = urls.select("*", key.alias("key")).withColumn("label", F.regexp_extract("key", "^[^./]*", 0))
    held = swept(points, host_intervals(rules), "label", "row")
    pairs = staged(held.select("page_id", "host", "path", "row", F.explode_outer("top").alias("rule_host")), "url-hosts")
    start = F.col("path").cast("binary")
    paths = rules.select(F.col("host").alias("rule_host"), start.alias("start"), F.concat(start, F.unhex(F.lit("FF"))).alias("stop"), F.struct("path", "verdict").alias("held"))
    found = swept(pairs.where("rule_host is not null").withColumn("key", F.col("path").cast("binary")), paths, "rule_host", "row")
    length = F.length("rule_host") + F.length("top.path")
    rule = F.when(F.col("top").isNotNull(), F.struct(length.alias("n"), F.col("top.verdict").alias("verdict"), F.length("rule_host").alias("of_host"), F.concat("rule_host", "top.path").alias("rule")))
    best = found.groupBy("row", "page_id", "host", "path").agg(F.max(rule).alias("best"))
    none = pairs.where("rule_host is null").select("row", "page_id", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"))
    return best.unionByName(none).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"))
