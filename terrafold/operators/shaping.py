"""Shaping rows and columns: targets, ids, types, catalogues, attached values (PRJ-02..19, SNK-05..15, JON-03..17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import numbered

STORED = ("min", "max", "mean", "std", "p01", "p10", "p25", "median", "p75", "p90", "p99", "n")


def windows_of(columns: list[str], layer: str) -> list[str]:
    """The columns `<layer>_<statistic>_<hours>h` of a layer."""
    return sorted(c for c in columns if c.startswith(f"{layer}_") and c.endswith("h") and c[:-1].rpartition("_")[2].isdigit())


def targets(columns: list[str], layers: list[str]) -> list[str]:
    """PRJ-02: of each layer its own column, or all its window columns; catalogue order, no repeats."""
    found: dict[str, None] = {}
    for layer in layers:
        found.update(dict.fromkeys([layer] if layer in columns else windows_of(columns, layer)))
    return list(found)


def ordered(df: DataFrame, own: list[str], variables: list[str]) -> DataFrame:
    """PRJ-07: the user's columns first, then the variables that exist."""
    return df.select(*own, *[v for v in variables if v in df.columns and v not in own])


def with_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """PRJ-08: blank names become `Observation #n`, n the 1-based ordinal of the row."""
    rows = numbered(df, [F.asc_nulls_last(order)], "_ordinal")
    blank = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
    return rows.withColumn(name, F.when(blank, F.concat(F.lit("Observation #"), F.col("_ordinal") + 1)).otherwise(F.col(name))).drop("_ordinal")


def harmonized(first: DataFrame, *others: DataFrame) -> DataFrame:
    """PRJ-13/14, SET-01: a union in which a column is double if any part has a float, long if all are integers, else text."""
    parts = (first, *others)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds: dict[str, list[T.DataType]] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    to = {}
    for name, types in kinds.items():
        if len(set(types)) > 1:
            to[name] = "long" if all(isinstance(x, whole) for x in types) else "double" if all(isinstance(x, T.NumericType) for x in types) else "string"
    cast = [p.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def without_stale(df: DataFrame, last: str, known: set[str]) -> DataFrame:
    """PRJ-15: columns to the right of `last` that no catalogue knows are dropped; window columns of a known layer stay."""
    right = df.columns[df.columns.index(last) + 1 :] if last in df.columns else []
    keep = known.union(*[windows_of(right, layer) for layer in known])
    return df.drop(*[c for c in right if c not in keep])


def stored_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ-18: the statistics that are stored; ranges are derived again when read."""
    return summary.select(*keys, *STORED)


def manifest(variables: DataFrame, without: str) -> DataFrame:
    """SNK-14: one row per variable by id, source ids as JSON text, one category left out."""
    return variables.where(~F.col("category").eqNullSafe(F.lit(without))).withColumn("source_ids", F.to_json("source_ids")).orderBy("id")


def class_lookup(legend: DataFrame, labels: list[str]) -> DataFrame:
    """SNK-15: (variable, code, metric, label) from the legend's label columns."""
    tall = legend.select("variable", F.col("class_id").alias("code"), *[F.col(c).cast("string").alias(c) for c in labels])
    return tall.unpivot(["variable", "code"], labels, "metric", "label").where("label is not null").orderBy("variable", "code", "metric")


def descendant_catalog(tree: DataFrame, ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """SNK-05: (ancestor, rank, taxon_key, sample_count), one row per key; integer keys first in numeric order."""
    below = tree.where("depth > 0").select("ancestor", F.col("descendant").alias("taxon_key")).distinct()
    c = counts.groupBy("taxon_key").agg(F.max("sample_count").alias("sample_count"))
    n = F.col("taxon_key").try_cast("bigint")
    return below.join(ranks, "taxon_key").join(c, "taxon_key").select("ancestor", "rank", "taxon_key", "sample_count").orderBy("ancestor", "rank", n.isNull(), n, "taxon_key")


def density_rows(grid: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-10, ARR-02: a density grid (i, x, density) as one row of arrays; a grid has a fixed number of points."""
    sorted_points = F.array_sort(F.collect_list(F.struct("i", "x", "density")))
    got = grid.groupBy(*keys).agg(sorted_points.alias("g"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("*").alias("point_count"))
    return got.select(*keys, "point_count", "min", "max", F.transform("g", lambda p: p["x"]).alias("points"), F.transform("g", lambda p: p["density"]).alias("density"))


def updated(rows: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """JON-03: values put into rows by a stable id; rows without a new value keep theirs."""
    named = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns]).dropDuplicates(keys)
    got = rows.join(named, keys, "left")
    return got.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def media_owner(media: DataFrame, ids: DataFrame, infraspecific: tuple[str, ...]) -> DataFrame:
    """JON-11: media rows of known ids, owned by the species unless the row's rank lies below it."""
    key = F.when(F.col("rank").isin(*infraspecific), F.col("taxon_key")).otherwise(F.col("species_key"))
    return media.join(ids, "ext_id").select(*media.columns, key.alias("owner"))


def attached_names(taxa: DataFrame, names: DataFrame, first: str) -> DataFrame:
    """JON-14: a taxon's names from the source `first`, then its own ones; an empty list without either."""
    listed = names.groupBy("taxon_key").agg(F.array_sort(F.collect_set(F.struct((F.col("source") != first).alias("later"), F.col("name")))).alias("_n"))
    got = taxa.join(listed, "taxon_key", "left")
    return got.withColumn("names", F.coalesce(F.array_distinct(F.transform("_n", lambda x: x["name"])), F.array().cast("array<string>"))).drop("_n")


def with_scores(ranked: DataFrame, matched: DataFrame) -> DataFrame:
    """JON-17: ranked rows with the score of their name match, null without one."""
    return ranked.join(matched.groupBy("taxon_key").agg(F.max("match_score").alias("match_score")), "taxon_key", "left")


def first_text(*shapes: Column) -> Column:
    """STR-16: the first that is not blank; arrays give their first entry that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in shapes])


def first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: F.trim(v) != ""), F.lit(0))


def shown_label(scientific: Column, common: Column, key: Column) -> Column:
    """STR-17: scientific name, then common name, then key, without underscores and repeated spaces."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"[_\s]+", " ")), F.lit(""))
    return F.coalesce(tidy(scientific), tidy(common), key)


def joined_list(values: Column, sep: str = "|") -> Column:
    """ARR-06/08: distinct entries in their order, joined; null entries go."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), sep)


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """SRT-07: the first n rows in file order; the limit is the report's own."""
    return df.orderBy(ordinal).limit(n)


def tie_block(rows: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """WIN-10: the left and right bound of a value in its sorted group, and the row's place between them."""
    w = Window.partitionBy(*keys).orderBy(value)
    own = Window.partitionBy(*keys).orderBy(value, ident)
    left = F.rank().over(w) - 1
    right = F.count("*").over(w)
    return rows.select("*", left.cast("long").alias("left"), right.cast("long").alias("right"), (F.row_number().over(own) - 1).cast("long").alias("pos"))


def version_token(rows: DataFrame, keys: list[str], built: str) -> DataFrame:
    """DAT-08: a token that changes when the newest build or the number of rows of a group changes."""
    return rows.groupBy(*keys).agg(F.md5(F.concat_ws("|", F.unix_micros(F.max(built).cast("timestamp")).cast("string"), F.count("*").cast("string"))).alias("token"))


def first_source(*parts: DataFrame) -> DataFrame:
    """API-10: numeric records of the first source that has any for a taxon; parts share taxon_key and value."""
    tagged = reduce(DataFrame.unionByName, [p.select("taxon_key", "value", F.lit(k).alias("_s")) for k, p in enumerate(parts)])
    best = tagged.groupBy("taxon_key").agg(F.min("_s").alias("_s"))
    return tagged.join(best, ["taxon_key", "_s"], "left_semi").withColumnRenamed("_s", "source")


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """WIN-09: runs of equal neighbours in an order: start (0-based place in the group), n and the value of each run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.select(*keys, *order, F.col(value).alias("_v"), changed.alias("_c"), (F.row_number().over(w) - 1).cast("long").alias("_p"))
    marked = marked.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "_run").agg(F.min("_p").alias("start"), F.count("*").alias("n"), F.first("_v").alias(value)).drop("_run")


def packed(rows: DataFrame, keys: list[str], column: str, fields: list[str], order: list[str]) -> DataFrame:
    """ARR-01: per key and column one array of structs in order: for groups of a bounded size, such as an upload's."""
    got = rows.groupBy(*keys, column).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("entries"))
    return got.select(*keys, column, F.transform("entries", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("entries"))


def unpacked(rows: DataFrame, entries: str = "entries") -> DataFrame:
    """ARR-01: the fields of each entry with its place."""
    rest = [c for c in rows.columns if c != entries]
    return rows.select(*rest, F.posexplode(entries).alias("pos", "_e")).select(*rest, "pos", "_e.*")


def padded(rows: DataFrame, keys: list[str], entries: str = "entries") -> DataFrame:
    """ARR-03: the arrays of a key as long as its longest, filled with nulls, and their true length."""
    longest = rows.groupBy(*keys).agg(F.max(F.size(entries)).alias("_m"))
    missing = F.array_repeat(F.lit(None).cast(rows.schema[entries].dataType.elementType), F.col("_m") - F.size(entries))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    got = rows.alias("r").join(longest.alias("l"), same).select("r.*", "_m")
    return got.select(*[c for c in rows.columns if c != entries], F.size(entries).alias("length"), F.concat(entries, missing).alias(entries))


def variables_shown(catalog: DataFrame) -> DataFrame:
    """PRJ-19: the variables for display, in order: id, its name (the id as words where there is none), units, value type."""
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.initcap(F.replace("id", F.lit("_"), F.lit(" "))))
    return catalog.select("id", named.alias("name"), "units", F.lower(F.coalesce(F.nullif(F.trim("value_type"), F.lit("")), F.lit("numeric"))).alias("value_type"), "ord")


def sources_used(catalog: DataFrame) -> DataFrame:
    """PRJ-19: each source with the variables that come from it."""
    rows = catalog.select("id", F.explode("source_ids").alias("source"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("variables"))
