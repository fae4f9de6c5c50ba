"""Expected values on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import science, text
from terrafold.operators import filters, hierarchy, ranking, statistics
from terrafold.plans import api
from terrafold.sources import tables


def rows(spark, values, ddl="value double"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ddl).withColumn("k", F.lit(1))


def test_summary_skips_nan(spark):
    r = statistics.summary(rows(spark, [1.0, 2.0, 3.0, math.nan]), ["k"]).first()
    assert (r["n"], r["mean"], r["median"]) == (3, 2.0, 2.0)
    assert statistics.summary(rows(spark, []), ["k"]).count() == 0


def test_circular_across_north(spark):
    r = statistics.circular(rows(spark, [359.0, 1.0]), ["k"]).first()
    assert min(r["mean"], 360 - r["mean"]) < 1e-9 and abs(r["value_range"] - 2) < 1e-9
    assert r["p10"] > 350 and r["p90"] < 10


@pytest.mark.parametrize(("n", "points"), [(0, 0), (10, 10), (3, 8), (100, 64), (1000, 128)])
def test_grid_points(spark, n, points):
    assert spark.range(1).select(statistics.grid_points(F.lit(n))).first()[0] == points


def test_density_of_equal_values_is_finite(spark):
    got = statistics.density(rows(spark, [5.0, 5.0, 5.0]), ["k"]).collect()
    assert len(got) == 8 and all(math.isfinite(r["density"]) for r in got)


def test_descending_leaderboard_keeps_ascending_places(spark):
    m = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], "taxon_key string, value double").withColumn("c", F.lit(0))
    got = ranking.leaderboard(ranking.positions(m, ["c"]), True, 10).collect()
    assert [(r["taxon_key"], r["pos"], r["percentile"]) for r in got] == [("3", 2, 1.0), ("2", 1, 0.5), ("1", 0, 0.0)]


def test_ties_go_by_match_score(spark):
    m = spark.createDataFrame([("a", 5.0, 80), ("b", 5.0, 95)], "taxon_key string, value double, match_score int")
    assert [r["taxon_key"] for r in ranking.direct(m, False).orderBy("row").collect()] == ["b", "a"]


def test_prefix_rule(spark):
    d = spark.createDataFrame([("zebra fish", "alp"), ("alpine rose", "alp")], "n string, q string")
    assert [r[0] for r in d.select(text.adjusted_score(F.lit(90), F.col("n"), F.col("q"))).collect()] == [None, 88]


def test_token_set_ratio():
    assert text.token_set_ratio_of("quercus robur", "quercus robur alba") == 100.0
    assert text.token_set_ratio_of("", "x") == 0.0
    assert 0 < text.token_set_ratio_of("quercus rubra", "quercus robur") < 100


def test_units(spark):
    r = spark.range(1).select(science.convert(F.lit(10.0), "°C"), science.convert(F.lit(5.0), "°C", spread=True)).first()
    assert tuple(r) == (50.0, 9.0)


def test_wrapped_range(spark):
    d = rows(spark, [355.0, 5.0, 100.0])
    assert filters.in_range(d, "value", 350, 10, circular=True).count() == 2
    assert filters.in_range(d, "value", 200, 10).count() == 1


def test_location_ids():
    assert filters.location_column(" nan ") is None
    assert filters.location_column("USA.1_1") == ("level1_gid", "USA.1_1")
    assert filters.location_column("asia", ("ASIA",)) == ("gbif_region", "ASIA")


def test_pruned_descendants(spark):
    x = spark.createDataFrame([("a", "SPECIES", "a"), ("b", "SPECIES", "a/b"), ("c", "SPECIES", "a/b/c")], "taxon_key string, rank string, path string")
    got = hierarchy.by_rank_pruned(hierarchy.closure(x), x.select("taxon_key", "rank"), "SPECIES").collect()
    assert {(r["ancestor"], r["descendant"]) for r in got} == {("a", "b"), ("b", "c")}


def test_empty_reason():
    assert api.empty_reason(1, None, None, 0, 0) is None
    assert api.empty_reason(0, None, None, 0, 0) == "no_query"
    assert api.empty_reason(0, "x", None, 0, 0) == "no_text_matches"
    assert api.empty_reason(0, "x", ("v", "m"), 3, 0) == "ranking_ineligible"
    assert api.empty_reason(0, "x", None, 3, 3) == "filtered_out"


def test_upload_columns(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0)], "ID int, `Decimal Latitude` double, lng double")
    assert tables.renamed(d).columns == ["catalog_number", "lat", "lon"]
    assert tables.readable(d.toDF("a", "b", "c"), {"a": "X", "b": "X"}).columns == ["X", "X (2)", "c"]
    with pytest.raises(ValueError, match="reserved"):
        filters.checked_columns(d.toDF("tileId", "b", "c"), {"tileId"})


def test_weather_code(spark):
    c = lambda *v: spark.range(1).select(science.weather_code(*[F.lit(x).cast("double") for x in v])).first()[0]
    assert [c(9, 0, 0), c(0, 1.3, 0), c(0, 0, 55), c(0, 0, None)] == [75, 61, 2, None]
