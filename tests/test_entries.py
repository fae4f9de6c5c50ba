"""Entry points and helpers whose errors and order no query shows."""

import time

import pytest
from pyspark.sql import functions as F

from terrafold import control
from terrafold.operators import hierarchy, models, narrative, statistics
from terrafold.plans import api, entries
from terrafold.sources import catalog, sqlite, tables

SF = "/root/testdata/sf0.001"


def places(spark):
    rows = [("ASIA", "ASIA", -1, None), ("A", "Åland", 0, "ASIA"), ("A.1_1", "Pe", 1, "A"), ("A.1.2_1", "Que", 2, "A.1_1"), ("B", "Bland", 0, None), ("B.1_1", "Zz", 1, "B")]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "gid string, name string, level int, parent_gid string, ordinal long")


def gids(df):
    return [r["gid"] for r in df.collect()]


def test_search_by_text_level_and_parents(spark):
    p = places(spark)
    assert gids(api.search_locations(p, " áland ", 10)) == ["A"] and gids(api.search_locations(p, "  ", 10)) == []
    assert gids(api.search_locations(p, "land", 1)) == ["A"]
    assert gids(api.search_hierarchy(p)) == [] and gids(api.search_hierarchy(p, level="planet")) == []
    assert gids(api.search_hierarchy(p, level="state")) == ["A.1_1", "B.1_1"]
    assert gids(api.search_hierarchy(p, level=2, parents=("Åland", "pe"))) == ["A.1.2_1"]
    assert gids(api.search_hierarchy(p, parents=("a",))) == ["A.1_1", "A.1.2_1"]  # by id
    assert gids(api.search_hierarchy(p, parents=("Bland",))) == ["B.1_1"]  # by the parent's name
    assert gids(api.search_hierarchy(p, parents=("que",))) == ["A.1.2_1"]  # nothing below: by letter, itself
    assert gids(api.search_hierarchy(p, "e", parents=("asia",), limit=1)) == ["A.1_1"]


def test_one_place_and_unknown_ones(spark):
    r = api.location_detail(places(spark), "A.1.2_1").first()
    assert r["hierarchy"] == ["ASIA", "Åland", "Pe"] and [a["level"] for a in r["ancestors"]] == [-1, 0, 1]
    assert api.location_detail(places(spark), " asia").first()["gid"] == "ASIA"
    with pytest.raises(LookupError):
        api.location_detail(places(spark), "X")


def test_an_ambiguous_slug_raises(spark):
    taxon = spark.createDataFrame([("1", "Poa alba"), ("2", "poa  Alba"), ("3", "Poa rubra")], "taxon_key string, scientific_name string")
    c = api.Catalog(taxon, None, None, None, None)
    assert gids(api.resolve_taxon(c, "poa-rubra").select(F.col("taxon_key").alias("gid"))) == ["3"]
    assert api.resolve_taxon(c, "1").count() == 1 and api.resolve_taxon(c, "poa rubra").count() == 0
    with pytest.raises(ValueError, match="several"):
        api.resolve_taxon(c, "poa-alba")


def test_environment_without_samples_or_place(spark):
    c = entries._seen(spark, SF)
    with pytest.raises(LookupError):
        api.environment_response(c, "nothing", "quantity")
    with pytest.raises(ValueError, match="no location"):
        api.environment_response(c, "r1", "quantity", gid="nan")


def test_curve_in_units(spark):
    r = api.curve_in_units(spark.createDataFrame([(10.0, 0.5, 2.0)], "x double, density double, bandwidth double"), "°C", "imperial").first()
    assert (round(r["x"], 9), round(r["density"], 9), round(r["bandwidth"], 9)) == (50.0, round(0.5 / 1.8, 9), 3.6)


def test_a_failed_read_is_tried_once_more():
    seen = []

    def build():
        seen.append(1)
        if len(seen) < 2:
            raise OSError("gone")
        return "there"

    assert api.once_more(build) == "there" and len(seen) == 2
    with pytest.raises(OSError):
        api.once_more(lambda: (_ for _ in ()).throw(OSError("gone")))


def test_the_pool_waits_for_memory_and_bounds_what_runs():
    running, most = [0], [0]

    def job(k):
        def run():
            running[0] += 1
            most[0] = max(most[0], running[0])
            time.sleep(0.01)
            running[0] -= 1
            return k

        return run

    assert sorted(control.run_bounded([job(k) for k in range(12)], 3, 2)) == list(range(12)) and most[0] <= 3
    most[0] = 0
    assert sorted(control.run_bounded([job(k) for k in range(5)], 4, 4, used=lambda: 0.95)) == list(range(5)) and most[0] == 1
    with pytest.raises(ZeroDivisionError):
        list(control.run_bounded([lambda: 1 / 0]))


def test_media_of_siblings_and_species_first(spark):
    rows = [("g", None, "GENUS", "g", None), ("a", "g", "SPECIES", "g/a", None), ("b", "g", "SPECIES", "g/b", "mb"), ("a1", "a", "SUBSPECIES", "g/a/a1", "ma1"), ("c", "g", "SPECIES", "g/c", None)]
    x = spark.createDataFrame(rows, "taxon_key string, parent_key string, rank string, path string, v string")
    got = {r["taxon_key"]: r["v"] for r in hierarchy.inherited_media(x, hierarchy.closure(x), "v").collect()}
    assert got == {"g": "mb", "a": "ma1", "b": "mb", "a1": "ma1", "c": "ma1"}


def test_summaries_by_ranges_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", float("nan"))], "k string, value double")
    got = {r["k"]: (r["n"], r["p10"], r["median"], r["iqr"]) for r in statistics.summary_by_ranges(df, ["k"]).collect()}
    assert got == {"a": (1, 1.0, 1.0, 0.0), "b": (2, 2.2, 3.0, 1.0)}


def test_sqlite_parts_read_every_row_once(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "f.gpkg")
    with sqlite3.connect(path) as con:
        con.execute('create table "adm 1" (fid integer primary key, "GID_1" text, "NAME_1" text, area real)')
        con.executemany('insert into "adm 1" values (?, ?, ?, ?)', [(k * 3, f"g{k}", f"n{k}", k / 2) for k in range(50)])
    got = sqlite.boundaries(spark, path, 1, 4)
    assert got.rdd.getNumPartitions() == 4 if hasattr(got, "rdd") else True
    assert sorted(r[0] for r in got.collect()) == sorted(f"g{k}" for k in range(50))
    with pytest.raises(LookupError):
        sqlite.feature_table(path, 2)


def test_short_lines_and_an_empty_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\tz\n1\t2\t3\n4\t5\n6\t\t\n")
    got = sorted(tuple(r) for r in tables.positional(spark, str(tmp_path / "a.tsv"), {"first": 0}, ["z"]).collect())
    assert got == [("1", "3"), ("6", "")]
    (tmp_path / "b.tsv").write_text("")
    assert tables.positional(spark, str(tmp_path / "b.tsv"), {"first": 0}).count() == 0


def test_looks_like_ids(spark):
    df = spark.createDataFrame([("1", "a", " "), ("2", "a", "x")], "a string, b string, c string")
    assert [catalog.looks_like_ids(df, c) for c in "abc"] == [True, False, False]


def test_unknown_mode_and_a_catalogue_of_windows_alone(spark):
    with pytest.raises(ValueError, match="mode"):
        models.mode_features({}, "other")
    only = spark.sql("select 'wind' as id, 'temporal' as category, 'numeric' as value_type, 'avg' as agg, 0 as ord")
    with pytest.raises(ValueError, match="temporal"):
        models.feature_spec(only)


def test_soil_and_weather_without_values(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(narrative.soil_row(F.lit(50.0), none, F.lit(1.0)), narrative.weather_row(none, none, none, none, none, none, none, none), narrative.weather_row(none, none, none, none, F.lit(60.0), F.lit(10.0), F.lit(60.0), none), narrative.terrain_row(none, none, "m", none, none), narrative.soil_row(F.lit(40.0), F.lit(30.0), F.lit(30.0))).first()
    assert tuple(r) == (None, None, "Typically moderately snowy winters\nCan tolerate extremely xeric to xeric", None, "Typically balanced soil")
