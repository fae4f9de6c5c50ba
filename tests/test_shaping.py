"""Shaping, tallies, narrative rows, the catalogue, the upload job and control, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold import control
from terrafold.operators import models, narrative, ranking, shaping, tallies
from terrafold.sources import catalog


def test_targets_take_windows_only_without_the_layer():
    columns = ["a", "a_mean_24h", "b_max_168h", "b_mean_24h", "b_note"]
    assert shaping.targets(columns, ["b", "a", "b", "c"]) == ["b_max_168h", "b_mean_24h", "a"]


def test_harmonized_types(spark):
    a = spark.createDataFrame([(1, 2, 3)], "i int, d int, s int")
    b = spark.createDataFrame([(4, 2.5, "x", True)], "i long, d double, s string, extra boolean")
    got = shaping.harmonized(a, b)
    assert dict(got.dtypes) == {"i": "bigint", "d": "double", "s": "string", "extra": "boolean"}
    assert {tuple(r) for r in got.collect()} == {(1, 2.0, "3", None), (4, 2.5, "x", True)}


def test_summed_below_is_exact_over_parts(spark):
    df = spark.range(1000).selectExpr("cast(id * 7 % 1000 as double) as key", "id % 5 as w")
    got = {r["key"]: r["below"] for r in ranking.summed_below(df, [F.asc("key")], {"below": F.col("w")}).collect()}
    rows = sorted((r["key"], r["w"]) for r in df.collect())
    total = 0
    for key, w in rows:
        assert got[key] == total
        total += w


@pytest.mark.parametrize(("a", "b", "text"), [("open forest", "closed forest", "open and closed forest"), ("old open forest", "old closed forest", "old open and closed forest"), ("dry grass", "dry scrub", "dry grass and dry scrub"), ("forest", "open forest", "forest and open forest"), ("sand", "bare rock", "sand and bare rock"), ("none", "bog", "bog"), ("none bog", "fen", "bog and fen"), ("x", "", "x")])
def test_parallel_label(spark, a, b, text):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(narrative.parallel_label(F.col("a"), F.col("b"))).first()[0] == text


@pytest.mark.parametrize(("here", "everywhere", "warm", "wet"), [(10.2, 10.0, "about the same in X", "about the same in X"), (12.0, 10.0, "a bit warmer in X", "slightly wetter in X"), (1.0, 10.0, "much cooler in X", "much drier in X"), (150.0, 0.0, "much warmer in X", "noticeably wetter in X"), (math.nan, 1.0, None, None), (None, 1.0, None, None)])
def test_local_comparison(spark, here, everywhere, warm, wet):
    r = spark.createDataFrame([(here, everywhere)], "h double, e double").select(narrative.temperature_here(F.col("h"), F.col("e"), F.lit("X")), narrative.rain_here(F.col("h"), F.col("e"), F.lit("X"))).first()
    assert tuple(r) == (warm, wet)


def test_soil_says_nothing_of_small_differences(spark):
    r = spark.createDataFrame([("sand", 31.0, 30.0), ("clay", 20.0, 32.0), ("peat", 50.0, 20.0)], "p string, h double, e double")
    got = [x[0] for x in r.select(narrative.soil_here(F.col("p"), F.col("h"), F.col("e"), F.lit("X"))).collect()]
    assert got == [None, "noticeably less clay-rich in X", "much more peat in X"]


def test_places_below_takes_the_first_way_that_fits(spark):
    df = spark.createDataFrame([("A.1_1", "p", ["Aland"]), ("A.2_1", "q", ["Aland"]), ("A.1.1_1", "r", ["Aland", "p"]), ("A", "Aland", [])], "gid string, name string, above array<string>")
    assert [r["gid"] for r in tallies.places_below(df, "a").collect()] == ["A.1.1_1", "A.1_1", "A.2_1"]
    assert [r["gid"] for r in tallies.places_below(df, "aland").collect()] == ["A.1_1", "A.2_1"]
    assert [r["gid"] for r in tallies.places_below(df.where("gid != 'A.1_1' and gid != 'A.2_1'"), "Aland").collect()] == ["A.1.1_1"]
    assert tallies.places_below(df, "nowhere").count() == 0


def test_box_has_a_least_span(spark):
    r = tallies.bounding_box(spark.createDataFrame([("k", 10.0, 20.0)], "k string, lat double, lon double"), ["k"]).first()
    assert (r["south"], r["north"], r["west"], r["east"]) == (9.875, 10.125, 19.875, 20.125)


def test_bilinear_ignores_invalid_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, math.nan)], "row long, col long, value double")
    got = {r["id"]: r["value"] for r in tallies.bilinear(spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.0), (3, 9.0, 9.0)], "id int, y double, x double"), cells, F.col("y"), F.col("x")).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None}


def test_chunks_until_covered_and_expired(spark):
    m = spark.createDataFrame([("s", "c1", 0, 9), ("s", "c2", 10, 19), ("s", "c3", 20, 29)], "source string, name string, start int, end int")
    assert {r["name"] for r in tallies.covering_chunks(m, F.lit(15)).collect()} == {"c2", "c3"}
    assert {r["name"] for r in tallies.covering_chunks(m, F.lit(20)).collect()} == {"c3"}
    w = spark.createDataFrame([("s", 5, 12)], "of_source string, since int, until int")
    assert {r["name"] for r in tallies.expired(m, w).collect()} == {"c3"}


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "row long, col long, value double, k string")
    assert tallies.colour_range(cells, ["k"]).count() == 0 and tallies.mosaic(cells, "k").count() == 0
    assert shaping.with_names(spark.createDataFrame([], "id long, name string"), "name", "id").count() == 0


def test_catalog_round_trip(spark, tmp_path):
    taxa = spark.createDataFrame([(10, "Quercus"), (2, "Acer")], "taxon_key long, scientific_name string")
    catalog.write_catalog(str(tmp_path), taxon=taxa)
    names = spark.createDataFrame([], "taxon_key string, name string").schema
    keyed = spark.createDataFrame([], "taxon_key string, scientific_name string").schema
    got = catalog.read_catalog(spark, str(tmp_path), {"taxon": keyed, "taxon_name": names})
    assert {r["taxon_key"] for r in got["taxon"].collect()} == {"10", "2"} and got["taxon_name"].count() == 0


def test_appended_occurrences_may_have_new_columns(spark, tmp_path):
    path = str(tmp_path / "occ")
    catalog.append_occurrences(spark.createDataFrame([("K", 1)], "kingdom string, id int"), path, "kingdom")
    catalog.append_occurrences(spark.createDataFrame([("K", 2, 0.5)], "kingdom string, id int, bio double"), path, "kingdom")
    assert {(r["id"], r["bio"]) for r in catalog.read_occurrences(spark, path).collect()} == {(1, None), (2, 0.5)}


def test_state_of_sums_equals_one_pass(spark):
    first = spark.createDataFrame([(0, 1.0), (0, 3.0)], "k int, value double")
    second = spark.createDataFrame([(0, 5.0), (1, math.nan), (1, 2.0)], "k int, value double")
    empty = spark.createDataFrame([], "k int, n long, total double")
    state = catalog.added_state(catalog.added_state(empty, first, ["k"]), second, ["k"])
    assert {(r["k"], r["n"], r["total"]) for r in state.collect()} == {(0, 3, 9.0), (1, 1, 2.0)}


def test_upload_job(spark, tmp_path):
    path = tmp_path / "mine.csv"
    path.write_text("ID,Latitude,Longitude,note\nx,0.5,0.5,a\ny,10.5,0.5,b\n")
    cells = spark.createDataFrame([(90, 180, 7.0)], "row long, col long, value double")
    rows, summary = catalog.processed_upload(spark, str(path), {"bio_1": cells}, 1)
    assert rows.columns[-1] == "bio_1" and {(r["catalog_number"], r["bio_1"]) for r in rows.collect()} == {("x", 7.0), ("y", None)}
    assert summary.first()["n"] == 1 and summary.first()["mean"] == 7.0


def test_model_artifact(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 10)) for i in range(20)], "x double, label int")
    fitted = models.pipeline(["x"], [], "linear").fit(df)
    models.save(fitted, str(tmp_path / "m"), models.metrics(models.scored(fitted, df)), {"taxon": "10"})
    again = models.scored(models.load(str(tmp_path / "m")), df)
    assert models.metrics(again).first()["auc"] == 1.0


def test_config_and_memo(spark):
    c = control.Config.load({"TERRAFOLD_SAMPLE_CAP": "5", "TERRAFOLD_WINDOW_HOURS": "1,2", "TERRAFOLD_ROOT": "/x"})
    assert (c.sample_cap, c.window_hours, c.root) == (5, (1, 2), "/x") and control.Config.load({}).sample_cap == 20_000
    memo = control.Memo()
    one = memo.get("a", lambda: spark.range(3))
    assert memo.get("a", lambda: spark.range(9)) is one
    memo.release()
    with control.cancellable(spark, "t"):
        assert "t" in spark.sparkContext.getJobTags()
    assert "t" not in spark.sparkContext.getJobTags()
