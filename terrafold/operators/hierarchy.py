"""Trees as closure tables (HIE-01..18): built once from paths, joined ever after; no recursion on the query path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closure(taxa: DataFrame) -> DataFrame:
    """HIE-03/05: taxon_key, path (keys joined by /) -> ancestor, descendant, depth (0: itself)."""
    p = F.split("path", "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(F.get(p, i - 1).alias("ancestor"), (F.size(p) - i).alias("depth")))
    return taxa.select(F.col("taxon_key").alias("descendant"), F.explode(pairs).alias("x")).select("x.ancestor", "descendant", "x.depth")


def recursive_closure(spark, parents: DataFrame) -> DataFrame:
    """The same from taxon_key, parent_key by WITH RECURSIVE."""
    parents.createOrReplaceTempView("_parents")
    return spark.sql("WITH RECURSIVE c(ancestor, descendant, depth) AS (SELECT taxon_key, taxon_key, 0 FROM _parents UNION ALL SELECT p.parent_key, c.descendant, c.depth + 1 FROM c JOIN _parents p ON p.taxon_key = c.ancestor WHERE p.parent_key IS NOT NULL) SELECT * FROM c")


def children(taxa: DataFrame) -> DataFrame:
    """HIE-02: parent_key and its sorted children."""
    return taxa.where("parent_key is not null").groupBy("parent_key").agg(F.array_sort(F.collect_list("taxon_key")).alias("children"))


def in_subtree(facts: DataFrame, tree: DataFrame, ancestor: str, key: str = "taxon_key", own: bool = True) -> DataFrame:
    """HIE-03 as a semi-join: rows of the ancestor's descendants (and of itself, if own)."""
    below = tree.where((F.col("ancestor") == ancestor) & (F.col("depth") >= (0 if own else 1))).select(F.col("descendant").alias(key))
    return facts.join(below, key, "left_semi")


def by_rank_pruned(tree: DataFrame, ranks: DataFrame, rank: str) -> DataFrame:
    """HIE-04: ancestor and its descendants of a rank that have none of that rank between."""
    hit = tree.join(ranks.where(F.col("rank") == rank).select(F.col("taxon_key").alias("descendant")), "descendant", "left_semi").where("depth > 0")
    above = hit.select(F.col("ancestor").alias("_match"), F.col("descendant"), F.col("depth").alias("_d")).join(ranks.where(F.col("rank") == rank).select(F.col("taxon_key").alias("_match")), "_match", "left_semi")
    nearest = above.groupBy("descendant").agg(F.min("_d").alias("_nearest"))
    return hit.join(nearest, "descendant", "left").where(F.col("_nearest").isNull() | (F.col("depth") <= F.col("_nearest"))).select("ancestor", "descendant", "depth")


def rolled_up(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """HIE-11: counts per (scope, gid, taxon_key) added to every ancestor; leaves are summed before the fan-out."""
    leaf = counts.groupBy("scope", "gid", "taxon_key").agg(F.sum("cnt").alias("cnt"))
    return leaf.join(tree, F.col("taxon_key") == F.col("descendant")).groupBy("scope", "gid", F.col("ancestor").alias("taxon_key")).agg(F.sum("cnt").alias("cnt"))


def parent_gid(gid: Column, level: int) -> Column:
    """HIE-08: of GID.1.2_1 style ids."""
    return F.regexp_replace(gid, r"\.[^.]*$", "") if level == 1 else F.regexp_replace(gid, r"\.[^._]*(_[^.]*)?$", "$1")


def ancestry(locations: DataFrame) -> DataFrame:
    """HIE-09: per location the names from the root to its parent (three levels at most)."""
    up = locations.select(F.col("gid").alias("g1"), F.col("name").alias("n1"), F.col("parent_gid").alias("p1"))
    top = locations.select(F.col("gid").alias("g2"), F.col("name").alias("n2"))
    return locations.join(up, F.col("parent_gid") == F.col("g1"), "left").join(top, F.col("p1") == F.col("g2"), "left").select("gid", "name", F.array_compact(F.array("n2", "n1")).alias("above"))


def matches_parents(locations: DataFrame, tokens: list[str]) -> DataFrame:
    """JON-19: every token equals the name or id of the record or of a location above it."""
    names = F.transform(F.concat(F.array("gid", "name"), "above"), lambda x: F.lower(x))
    return locations.where(F.forall(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.array_contains(names, t)))


#: Ranks below a species.
BELOW_SPECIES = ("SUBSPECIES", "VARIETY", "FORM")


def _below(taxa: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """Per ancestor the value of its first descendant that has one, of any rank and of a species; first by depth, then by key."""
    have = taxa.where(F.col(column).isNotNull()).select(F.col("taxon_key").alias("descendant"), F.col(column).alias("_v"), F.col("rank").alias("_rank"))
    found = tree.where("depth > 0").join(have, "descendant")
    first = F.struct("depth", "descendant")
    species = F.when(F.col("_rank") == "SPECIES", first)
    return found.groupBy(F.col("ancestor").alias("taxon_key")).agg(F.min_by("_v", first).alias("_any"), F.min_by("_v", species).alias("_species"))


def inherited_media(taxa: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """HIE-12: taxa: taxon_key, parent_key, rank and a value.  The first of: a species below the taxon; the taxon itself if it
    is a species or lower; any taxon below; the taxon itself; a sibling (by key), or the first taxon below that sibling."""
    rows = taxa.join(_below(taxa, tree, column), "taxon_key", "left")
    low = F.col("rank").isin("SPECIES", *BELOW_SPECIES)
    rows = rows.withColumn("_own", F.coalesce("_species", F.when(low, F.col(column)), "_any", column)).withColumn("_lent", F.coalesce(column, "_any"))
    # Of the siblings that have a value, the first two by key: one of them is not the taxon itself.
    order = Window.partitionBy("parent_key").orderBy("taxon_key")
    lent = rows.where("_lent is not null and parent_key is not null").select("parent_key", "taxon_key", "_lent", F.row_number().over(order).alias("_r")).where("_r <= 2")
    lent = lent.groupBy("parent_key").agg(F.max(F.when(F.col("_r") == 1, F.struct("taxon_key", "_lent"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.struct("taxon_key", "_lent"))).alias("_b"))
    other = F.when(F.col("_a.taxon_key") != F.col("taxon_key"), F.col("_a._lent")).otherwise(F.col("_b._lent"))
    return rows.join(lent, "parent_key", "left").select("taxon_key", F.coalesce("_own", other).alias(column))


def inherited_image(taxa: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """HIE-13: the taxon's own value, else that of the first taxon below it."""
    return taxa.join(_below(taxa, tree, column), "taxon_key", "left").select("taxon_key", F.coalesce(column, "_any").alias(column))


def inherited_names(taxa: DataFrame, column: str) -> DataFrame:
    """HIE-14: a taxon below the rank of species without a name has its parent's."""
    up = taxa.select(F.col("taxon_key").alias("_p"), F.col(column).alias("_up"))
    got = taxa.join(up, F.col("parent_key") == F.col("_p"), "left")
    return got.select("taxon_key", F.coalesce(column, F.when(F.col("rank").isin(*BELOW_SPECIES), F.col("_up"))).alias(column))


def name_index(names: DataFrame) -> DataFrame:
    """HIE-16: names (taxon_key, name) -> normalized name and slug with the taxa that have them, sorted."""
    from ..functions.text import normalized, slug

    rows = names.select("taxon_key", normalized(F.col("name")).alias("name"), slug(F.col("name")).alias("slug")).distinct()
    return rows.groupBy("name", "slug").agg(F.array_sort(F.collect_list("taxon_key")).alias("taxa"), F.count("*").alias("n"))


#: Ranks from the root.
RANK_ORDER = ("KINGDOM", "PHYLUM", "CLASS", "ORDER", "FAMILY", "GENUS", "SPECIES", "SUBSPECIES")


def ranks_below(rank: str) -> tuple[str, ...]:
    """HIE-07."""
    return RANK_ORDER[RANK_ORDER.index(rank) + 1 :]


def built(rows: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """HIE-15: nodes (taxon_key, parent_key, rank, name, path) from one row per leaf with <rank> and <rank>_key columns."""
    pairs = F.filter(F.array(*[F.struct(F.lit(r.upper()).alias("rank"), F.col(r).alias("name"), F.col(f"{r}_key").cast("string").alias("key")) for r in ranks]), lambda p: p["key"].isNotNull())
    at = rows.select(pairs.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).where("i >= 1")
    keys = F.transform(F.slice("p", F.lit(1), F.col("i")), lambda x: x["key"])
    here = F.element_at("p", F.col("i"))
    return at.select(here["key"].alias("taxon_key"), F.get(keys, F.size(keys) - 2).alias("parent_key"), here["rank"].alias("rank"), here["name"].alias("scientific_name"), F.array_join(keys, "/").alias("path")).dropDuplicates(["taxon_key"])
