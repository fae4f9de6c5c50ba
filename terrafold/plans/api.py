"""Entry points (API-01..11): parameters in, one DataFrame out; validation on the driver, everything else in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..control import Memo
from ..functions.science import SPREADS, convert
from ..functions.text import adjusted_score, normalized, slug, token_set_ratio, without_accents
from ..operators import filters, hierarchy, joins, narrative, ranking, statistics


@dataclass(frozen=True)
class Catalog:
    """The tables that the entry points read; any of them may be Parquet tables of any size."""

    taxon: DataFrame  # taxon_key, parent_key, rank, scientific_name, path
    closure: DataFrame  # ancestor, descendant, depth
    metric: DataFrame  # taxon_key, variable, metric, value, samples
    membership: DataFrame  # scope, gid, taxon_key, cnt
    occurrence: DataFrame  # taxon_key, obs_id, variables, quality columns


def resolve_taxon(catalog: Catalog, reference: str) -> DataFrame:
    """HIE-17: an exact key first; a text with spaces is never a slug; a slug of several taxa raises an error."""
    by_key = catalog.taxon.where(F.col("taxon_key") == reference).withColumn("_o", F.lit(0))
    if " " in reference:
        return by_key.drop("_o")
    by_slug = catalog.taxon.where(slug(F.col("scientific_name")) == reference).withColumn("_o", F.lit(1))
    both = by_key.unionByName(by_slug)
    if by_key.isEmpty() and len(taxa := by_slug.select("taxon_key").distinct().limit(6).collect()) > 1:
        raise ValueError(f"{reference!r} is the slug of several taxa: {', '.join(sorted(r[0] for r in taxa)[:5])}")
    return both.join(F.broadcast(both.agg(F.min("_o").alias("_m"))), F.col("_o") == F.col("_m"), "left_semi").drop("_o")


def search_names(catalog: Catalog, text: str, pool: int | None = None) -> DataFrame:
    """STR-05/06, AGG-20: taxa whose name words begin with the query's words, with adjusted scores; with `pool` only the best
    so many by score and key (SRT-03/04): a report that shows few does not carry all."""
    q = " ".join(text.lower().replace("_", " ").split())
    name = normalized(F.col("scientific_name"))
    begins = F.forall(F.split(F.lit(q), " "), lambda w: F.exists(F.split(name, " "), lambda x: F.startswith(x, w)))
    near = catalog.taxon.where(begins).withColumn("_name", name)  # selective, and before the UDF
    score = adjusted_score(token_set_ratio(F.col("_name"), F.lit(q)), F.col("_name"), F.lit(q))
    found = near.withColumn("match_score", score).where("match_score is not null").groupBy("taxon_key").agg(F.max("match_score").alias("match_score"))
    return found if pool is None else found.orderBy(F.desc("match_score"), "taxon_key").limit(pool)


def query_taxa(catalog: Catalog, text: str | None = None, within: str | None = None, rank: str | None = None, sort: tuple[str, str] | None = None, descending: bool = False, scope: tuple[str, str] | None = None, min_samples: int = 0, limit: int = 20, offset: int = 0) -> DataFrame:
    """API-01: scope, location, text and ranking combined. Columns: taxon_key, rank, scientific_name, match_score, value, pos, cnt, percentile, samples, total.

    Places count in ascending order whatever the order of the page; total is that of all pages.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit is 1 or more, offset 0 or more")
    taxa = catalog.taxon.select("taxon_key", "rank", "scientific_name")
    if within:
        taxa = hierarchy.in_subtree(taxa, catalog.closure, within, own=False)
    if rank:
        ranks = (rank, "SUBSPECIES", "VARIETY", "FORM") if rank == "SPECIES" else (rank,)
        taxa = taxa.where(F.col("rank").isin(*ranks))
    counts = None
    if scope:
        counts = catalog.membership.where((F.col("scope") == scope[0]) & (F.col("gid") == scope[1])).groupBy("taxon_key").agg(F.sum("cnt").alias("_here"))
        taxa = taxa.join(counts.select("taxon_key"), "taxon_key", "left_semi")
    if sort:
        m = catalog.metric.where((F.col("variable") == sort[0]) & (F.col("metric") == sort[1])).select("taxon_key", "value", "samples")
        rows = ranking.numbered(taxa.join(m, "taxon_key"), [F.asc_nulls_last("value"), F.asc("taxon_key")], "pos")
        rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("cnt"))))  # one row
        rows = rows.withColumn("percentile", ranking.percentile(F.col("pos"), F.col("cnt")))
    else:
        rows = taxa.withColumns({"value": F.lit(None).cast("double"), "samples": F.lit(None).cast("long"), "pos": F.lit(None).cast("long"), "cnt": F.lit(None).cast("long"), "percentile": F.lit(None).cast("double")})
    if counts is not None:
        rows = rows.join(counts, "taxon_key", "left").withColumn("samples", F.coalesce("_here", "samples")).drop("_here")
    if min_samples > 0:
        rows = rows.where(F.coalesce("samples", F.lit(-1)) >= min_samples)
    if text:
        rows = rows.join(search_names(catalog, text), "taxon_key")
    else:
        rows = rows.withColumn("match_score", F.lit(None).cast("double"))
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    if sort:
        order = [F.desc("value"), F.desc("taxon_key")] if descending else [F.asc("value"), F.asc("taxon_key")]
    else:
        order = [F.desc_nulls_last("match_score"), F.asc("taxon_key")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def empty_reason(total: int, text: str | None, sort, text_matches: int, ranked: int) -> str | None:
    """Why a page is empty."""
    if total:
        return None
    if not text and not sort:
        return "no_query"
    if text and not text_matches:
        return "no_text_matches"
    return "ranking_ineligible" if sort and not ranked else "filtered_out"


def environment(catalog: Catalog, taxon_key: str, variable: str, kind: str = "numeric", gid_column: str | None = None, gid: str | None = None, unit: str | None = None, system: str = "metric") -> DataFrame:
    """API-02: summary of a variable over a subtree, optionally in a location: numeric, circular or categorical."""
    rows = hierarchy.in_subtree(filters.visible(catalog.occurrence), catalog.closure, taxon_key)
    if gid is not None:
        rows = rows.where(F.col(gid_column) == gid)
    if kind == "categorical":
        return statistics.distribution(statistics.category_metrics(rows.withColumn("_all", F.lit(taxon_key)), ["_all"], variable), ["_all"]).drop("_all")
    rows = rows.select(F.lit(taxon_key).alias("taxon_key"), F.col(variable).alias("value"))
    got = statistics.circular(rows, ["taxon_key"]) if kind == "circular" else statistics.summary(rows, ["taxon_key"])
    return in_units(got, unit, system) if unit else got


def in_units(summary: DataFrame, unit: str, system: str) -> DataFrame:
    """MTH-15: spreads by the factor alone."""
    return summary.withColumns({c: convert(F.col(c), unit, system, c in SPREADS) for c in summary.columns if c not in ("taxon_key", "n")})


def environment_response(catalog: Catalog, taxon_key: str, variable: str, kind: str = "numeric", gid: str | None = None, regions: tuple[str, ...] = (), unit: str | None = None, system: str = "metric", ranks: DataFrame | None = None, legend: DataFrame | None = None) -> DataFrame:
    """API-02: one row: taxon_key, variable, kind, all_obscured, n, summary, curve, distribution, baseline, ranks.

    `summary` is a struct of statistics in the asked units, null for categories; `curve` the density (points, values,
    bandwidth); `distribution` the class shares, largest first, and with a location `baseline` those of all places; `ranks`
    the places of the taxon in its contexts (from a rank index), only without a location.  If there are rows but all are
    obscured, only all_obscured is told; without any value LookupError is raised.
    """
    rows = hierarchy.in_subtree(catalog.occurrence, catalog.closure, taxon_key)
    where = filters.location_column(gid, regions) if gid is not None else None
    if gid is not None and where is None:
        raise ValueError(f"{gid!r} is no location id")
    here = rows if where is None else rows.where(F.col(where[0]) == where[1])
    hidden = F.col("obscured") != "No" if "obscured" in rows.columns else F.lit(False)
    good = filters.visible(here)
    total, shown = here.agg(F.count("*"), F.count_if(~F.coalesce(hidden, F.lit(True)))).first()
    n = good.agg(F.count(filters.clean(F.col(variable)) if kind != "categorical" else F.col(variable))).first()[0]
    head = rows.sparkSession.range(1).select(F.lit(taxon_key).alias("taxon_key"), F.lit(variable).alias("variable"), F.lit(kind).alias("kind"), F.lit(total > 0 and shown == 0 and n == 0).alias("all_obscured"), F.lit(n).alias("n"))
    if not n and not (total > 0 and shown == 0):
        raise LookupError(f"no samples of {variable!r} for taxon {taxon_key}")
    shares, numbers = None, None
    if n and kind == "categorical":
        shares = _shares(good, taxon_key, variable, legend).withColumnRenamed("shares", "distribution")
        if where is not None:
            shares = shares.join(_shares(filters.visible(rows), taxon_key, variable, legend).withColumnRenamed("shares", "baseline"), "taxon_key")
    elif n:
        values = good.select(F.lit(taxon_key).alias("taxon_key"), F.col(variable).cast("double").alias("value"))
        summary = statistics.circular(values, ["taxon_key"]) if kind == "circular" else statistics.summary(values, ["taxon_key"])
        curve = statistics.density(values, ["taxon_key"], ring=kind == "circular")
        if unit:
            summary, curve = in_units(summary, unit, system), curve_in_units(curve, unit, system)
        points = F.array_sort(F.collect_list(F.struct("i", "x", "density")))
        curve = curve.groupBy("taxon_key").agg(points.alias("p"), F.max("bandwidth").alias("b"))
        curve = curve.select("taxon_key", F.struct(F.transform("p", lambda p: p["x"]).alias("points"), F.transform("p", lambda p: p["density"]).alias("density"), F.col("b").alias("bandwidth")).alias("curve"))
        numbers = summary.select("taxon_key", F.struct(*[c for c in summary.columns if c != "taxon_key"]).alias("summary")).join(curve, "taxon_key")
    out = head
    for part in (numbers, shares):
        out = out.join(part, "taxon_key", "left") if part is not None else out
    if ranks is not None and where is None:
        own = ranks.where((F.col("taxon_key") == taxon_key) & (F.col("variable") == variable))
        own = own.groupBy("taxon_key").agg(F.array_sort(F.collect_list(F.struct("context", "metric", "pos", "cnt", "percentile"))).alias("ranks"))
        out = out.join(own, "taxon_key", "left")
    for name in ("summary", "curve", "distribution", "baseline", "ranks"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def _shares(rows: DataFrame, taxon_key: str, variable: str, legend: DataFrame | None) -> DataFrame:
    """taxon_key and one array of the variable's classes: class, name, share, cnt, place."""
    got = statistics.distribution(statistics.category_metrics(rows.withColumn("_all", F.lit(taxon_key)), ["_all"], variable), ["_all"])
    if legend is None:
        got = got.withColumn("class_name", F.col("class"))
    else:
        got = joins.with_legend(got, legend, F.col("class"))
    entry = F.struct("place", "class", "class_name", "share", "cnt")
    return got.groupBy(F.col("_all").alias("taxon_key")).agg(F.array_sort(F.collect_list(entry)).alias("shares"))


def curve_in_units(curve: DataFrame, unit: str, system: str) -> DataFrame:
    """MTH-15: points by factor and offset, densities over the factor, bandwidths by the factor."""
    factor = convert(F.lit(1.0), unit, system, True)
    return curve.withColumns({"x": convert(F.col("x"), unit, system), "density": F.col("density") / F.abs(factor), "bandwidth": F.col("bandwidth") * F.abs(factor)})


def occurrence_points(catalog: Catalog, taxon_key: str) -> DataFrame:
    """API-05, AGG-34: distinct visible points of a subtree, the first by id."""
    rows = hierarchy.in_subtree(filters.visible(catalog.occurrence), catalog.closure, taxon_key)
    return rows.groupBy("obs_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("obs_id", "p.*")


#: Names of the levels of places.
LEVELS = {"continent": -1, "country": 0, "state": 1, "county": 2}


def level_number(level: str | int | None) -> int | None:
    """API-06/07: a level by its number or name; None for other texts."""
    if level is None or isinstance(level, int):
        return level
    text = level.strip()
    return int(text) if text.lstrip("-").isdigit() else LEVELS.get(text.lower())


def located(locations: DataFrame) -> DataFrame:
    """HIE-09: locations (gid, name, level, parent_gid, ...) with `ancestors`, structs (gid, name, level) from the root to the
    parent, and `hierarchy`, their names.  Places lie four levels deep at most."""
    out, up = locations.withColumn("_up", F.col("parent_gid")), []
    for k in range(1, 4):
        above = locations.select(F.col("gid").alias(f"_g{k}"), F.struct("gid", "name", "level").alias(f"_a{k}"), F.col("parent_gid").alias(f"_p{k}"))
        out = out.join(above, F.col("_up") == F.col(f"_g{k}"), "left").withColumn("_up", F.col(f"_p{k}"))
        up.append(F.col(f"_a{k}"))
    out = out.withColumn("ancestors", F.array_compact(F.array(*reversed(up))))
    return out.select(*locations.columns, "ancestors", F.transform("ancestors", lambda a: a["name"]).alias("hierarchy"))


def _below_all(places: DataFrame, locations: DataFrame, parents: list[str]) -> DataFrame:
    """JON-19: places for which every parent token, a name or id, names the place itself or one above it."""
    for token in parents:
        t = token.lower()
        # A token that is an id stands for its name too.
        named = [r[0].lower() for r in locations.where(F.col("gid").isin(token, token.upper())).select("name").distinct().collect()]
        own = F.array(F.lower("gid"), F.lower("name"))
        every = F.concat(own, F.transform("ancestors", lambda a: F.lower(a["gid"])), F.transform("ancestors", lambda a: F.lower(a["name"])))
        places = places.where(F.arrays_overlap(every, F.array(*map(F.lit, [t, *named]))))
    return places


def search_locations(locations: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """API-07, STR-10, SRT-07: places whose name holds the text, accents and case aside, the first in the catalogue's order (ordinal)."""
    wanted = without_accents(F.lit(text))
    found = locations.where((F.lit(text.strip()) != "") & F.contains(without_accents(F.col("name")), wanted))
    return located_page(found, locations, limit)


def located_page(found: DataFrame, locations: DataFrame, limit: int) -> DataFrame:
    every = located(locations.select("gid", "name", "level", "parent_gid")).select("gid", "ancestors", "hierarchy").dropDuplicates(["gid"])
    return found.join(every, "gid").orderBy("ordinal").limit(limit).select("gid", "name", "level", "hierarchy", "ordinal")


def search_hierarchy(locations: DataFrame, text: str = "", level: str | int | None = None, parents: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """API-07, SRT-10: places by text, level and parents, the first `limit` that fit all of them.

    Without a text: the places of the level; if none of them fits, the places below a parent, by id, then parent's name,
    then any name above; if there are none either, all places, by the first letter of the alphabet that their name holds.
    Nothing asked gives nothing.
    """
    want, tokens = level_number(level), [p.strip() for p in parents if p.strip()]
    places = located(locations)
    if not text.strip() and not tokens and want is None:
        return places.where("false").select("gid", "name", "level", "hierarchy", "ordinal")
    fit = _below_all(places, locations, tokens)
    at_level = fit if want is None else fit.where(F.col("level") == want)
    columns = ["gid", "name", "level", "hierarchy", "ordinal"]
    if text.strip():
        found = at_level.where(F.contains(without_accents(F.col("name")), without_accents(F.lit(text))))
        return found.orderBy("ordinal").limit(limit).select(*columns)
    way = F.when(F.lit(want is not None), 1)
    for token in tokens:
        t = token.lower()
        below = F.when(F.startswith(F.lower("gid"), F.lit(t + ".")), 2).when(F.lower(F.try_element_at("hierarchy", F.lit(-1))) == t, 3).when(F.exists("hierarchy", lambda h: F.lower(h) == t), 4)
        way = F.coalesce(way, below)
    letters = F.array_min(F.filter(F.split(without_accents(F.col("name")), ""), lambda c: c.rlike("^[a-z]$")))
    rows = at_level.withColumns({"_way": F.coalesce(way, F.when(letters.isNotNull(), 5)), "_letter": letters}).where("_way is not null")
    best = rows.agg(F.min("_way")).first()[0]
    order = ["_letter", "ordinal"] if best == 5 else ["ordinal"]
    return rows.where(F.col("_way") == F.lit(best)).orderBy(*order).limit(limit).select(*columns)


def location_detail(locations: DataFrame, gid: str) -> DataFrame:
    """API-07: one place with its ancestors; the id also in capitals; an unknown one raises LookupError."""
    asked = gid.strip()
    found = [r[0] for r in locations.where(F.col("gid").isin(asked, asked.upper())).select("gid").distinct().collect()]
    if not found:
        raise LookupError(f"no place {gid!r}")
    return located(locations).where(F.col("gid") == (asked if asked in found else found[0])).select("gid", "name", "level", "parent_gid", "hierarchy", "ancestors")


def taxon_locations(catalog: Catalog, locations: DataFrame, taxon_key: str, level: str | int | None = None, parents: tuple[str, ...] = (), limit: int = 500, scopes: dict[str, int] | None = None) -> DataFrame:
    """API-06, SRT-05: places of a taxon by count, name and id, of which a report shows the first; scopes: scope -> level.
    Ids that no catalogue knows are their own names; invalid ones go."""
    scopes = scopes or {"gbif_region": -1, "level0": 0, "level1": 1, "level2": 2}
    want = level_number(level)
    number = F.create_map(*[F.lit(x) for pair in scopes.items() for x in pair])
    counts = catalog.membership.where(F.col("taxon_key") == taxon_key).withColumn("level", number[F.col("scope")]).where("level is not null")
    counts = counts.where(~F.lower(F.trim("gid")).isin(*filters.NO_LOCATION))
    counts = counts.groupBy("level", "gid").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    counts = counts if want is None else counts.where(F.col("level") == want)
    known = located(locations).select("gid", "name", "ancestors", "hierarchy")
    none = F.array().cast(known.schema["ancestors"].dataType)
    rows = counts.join(known, "gid", "left").withColumns({"name": F.coalesce("name", "gid"), "ancestors": F.coalesce("ancestors", none), "hierarchy": F.coalesce("hierarchy", F.array().cast("array<string>"))})
    rows = _below_all(rows, locations, [p.strip() for p in parents if p.strip()])
    return rows.orderBy(F.desc("cnt"), F.lower("name"), "gid").limit(limit).select("gid", "name", "level", "hierarchy", "cnt")


def once_more(build, refresh=lambda: None):
    """API-11: what build gives; if it fails, once more after a refresh."""
    try:
        return build()
    except Exception:
        refresh()
        return build()


@dataclass
class Stats:
    """API-11: the stored statistics of taxa, each table read once and kept; a failed read is tried once more."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.memo = Memo()

    def table(self, name: str) -> DataFrame:
        at = f"{self.path}/{name}"

        def build():
            return self.memo.get(name, lambda: self.spark.read.parquet(at))

        return once_more(build, lambda: self.spark.catalog.refreshByPath(at))

    def numeric(self, taxon_key: str, variable: str) -> DataFrame:
        """The stored summary with the ranges that follow from it."""
        row = self.table("summary").where((F.col("taxon_key") == taxon_key) & (F.col("variable") == variable))
        return row.withColumns({n: F.col(a) - F.col(b) for n, a, b in statistics.SPANS})

    def curve(self, taxon_key: str, variable: str) -> DataFrame:
        return self.table("density").where((F.col("taxon_key") == taxon_key) & (F.col("variable") == variable))

    def categories(self, taxon_key: str, variable: str) -> DataFrame:
        rows = self.table("categories").where((F.col("taxon_key") == taxon_key) & (F.col("variable") == variable))
        return statistics.distribution(rows.drop("variable"), ["taxon_key"])


def serialized(taxon: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """PRJ-17, HIE-18: rows for display; the group is the first path prefix that fits."""
    group = F.lit("other")
    for prefix, name in reversed(groups):
        group = F.when(F.concat("path", F.lit("/")).startswith(prefix + "/"), name).otherwise(group)
    return taxon.select("taxon_key", "scientific_name", slug(F.col("scientific_name")).alias("slug"), F.upper("rank").alias("rank"), group.alias("taxon_group"))


#: Names that take the article.
WITH_ARTICLE = ("united states", "united kingdom", "netherlands", "philippines", "gambia")


def with_article(name: Column) -> Column:
    """DSC-04."""
    return F.when(F.lower(F.trim(name)).isin(*WITH_ARTICLE), F.concat(F.lit("the "), F.trim(name))).otherwise(F.trim(name))


def _listed(entries: DataFrame, limit: int) -> DataFrame:
    """entries: taxon_key, gid, name, parent_gid, cnt.  Per taxon: the largest names (each once), how many entries there are,
    and the id of the largest."""
    best = entries.groupBy("taxon_key", "name").agg(F.max_by(F.struct("cnt", "gid"), F.struct(F.col("cnt"), F.col("gid"))).alias("x"), F.count("*").alias("times"))
    order = Window.partitionBy("taxon_key").orderBy(F.desc("x.cnt"), "name")
    rows = best.withColumns({"r": F.row_number().over(order), "entries": F.sum("times").over(Window.partitionBy("taxon_key"))}).where(F.col("r") <= limit)
    got = rows.groupBy("taxon_key").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("n"), F.max("entries").alias("entries"), F.min_by("x.gid", "r").alias("first_gid"))
    return got.select("taxon_key", F.transform("n", lambda v: v["name"]).alias("names"), (F.col("entries") > F.size("n")).alias("more"), "first_gid")


def _joined(names: Column, more: Column, others: str) -> Column:
    n = F.size(names)
    whole = F.when(n == 1, names[0]).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    return F.when(more, F.concat(F.array_join(names, ", "), F.lit(f" and other {others}"))).otherwise(whole)


def location_sentence(counts: DataFrame, locations: DataFrame, limit: int = 3) -> DataFrame:
    """DSC-04: counts (taxon_key, gid, cnt) and locations (gid, name, level, parent_gid) -> the largest countries of a taxon;
    if there is one country alone, the largest of its regions that the taxon lives in."""
    rows = counts.where("cnt > 0").join(locations.select("gid", "name", "level", "parent_gid"), "gid").where("name is not null and trim(name) != ''")
    lands = _listed(rows.where("level = 0"), limit)
    one = lands.where(F.size("names") == 1).select("taxon_key", F.col("first_gid").alias("land"), with_article(F.col("names")[0]).alias("land_name"))
    inside = rows.where("level = 1").join(one, "taxon_key").where("parent_gid = land")
    regions = _listed(inside, limit).select("taxon_key", _joined(F.col("names"), F.col("more"), "regions").alias("regions"))
    named = one.join(regions, "taxon_key").select("taxon_key", F.concat("regions", F.lit(" in "), "land_name").alias("drilled"))
    lands = lands.withColumn("names", F.transform("names", with_article))
    return lands.join(named, "taxon_key", "left").select("taxon_key", F.coalesce("drilled", _joined(F.col("names"), F.col("more"), "countries")).alias("sentence"))


def species_detail(taxon: DataFrame, groups: list[tuple[str, str]], sections: dict[str, DataFrame], models: DataFrame) -> DataFrame:
    """API-08: the taxon for display, its profile (sections by name, of taxon_key and text) and the names of its models."""
    known = models.groupBy("taxon_key").agg(F.array_sort(F.collect_set("name")).alias("models"))
    shown = serialized(taxon, groups).join(narrative.profile("taxon_key", **sections), "taxon_key", "left").join(known, "taxon_key", "left")
    return shown.withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
