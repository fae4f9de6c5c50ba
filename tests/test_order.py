"""Null and frequent keys in numbered rows, and state that outlives its sink."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrafold.functions import text
from terrafold.operators import ranking, shaping
from terrafold.plans import api
from terrafold.streaming.windows import HOUR, Revisions


def test_rows_with_null_keys_are_numbered_last(spark):
    m = spark.createDataFrame([("a", 5.0, 80), ("b", None, 95), ("c", 7.0, 90), ("d", None, 99)], "taxon_key string, value double, match_score int")
    up = [(r["taxon_key"], r["row"], r["cnt"]) for r in ranking.direct(m, False).orderBy("row").collect()]
    down = [r["taxon_key"] for r in ranking.direct(m, True).orderBy("row").collect()]
    assert up == [("a", 0, 4), ("c", 1, 4), ("d", 2, 4), ("b", 3, 4)] and down == ["c", "a", "d", "b"]
    named = {r["k"]: r["name"] for r in shaping.with_names(spark.createDataFrame([(2, ""), (None, " "), (1, "x")], "k int, name string"), "name", "k").collect()}
    assert named == {1: "x", 2: "Observation #2", None: "Observation #3"}


def test_a_frequent_key_is_split_and_numbered_without_gaps(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one part
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.col("id").cast("double")).alias("v"), "id")
    rows = ranking.in_order(df, [F.asc("v"), F.asc("id")])
    assert rows.where("v = 1.0").select("_part").distinct().count() > 1
    got = [r["id"] for r in ranking.numbered(df, [F.asc("v"), F.asc("id")], "n").orderBy("n").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [r["id"] for r in df.orderBy("v", "id").collect()]


def test_query_taxa_keeps_taxa_without_a_value(spark):
    taxon = spark.createDataFrame([(str(k), None, "SPECIES", f"name {k}", str(k)) for k in range(4)], "taxon_key string, parent_key string, rank string, scientific_name string, path string")
    metric = spark.createDataFrame([("0", "v", "mean", 3.0, 5), ("1", "v", "mean", None, 5), ("2", "v", "mean", 1.0, 5)], "taxon_key string, variable string, metric string, value double, samples long")
    c = api.Catalog(taxon, spark.createDataFrame([], "ancestor string, descendant string, depth int"), metric, spark.createDataFrame([], "scope string, gid string, taxon_key string, cnt long"), taxon)
    got = [(r["taxon_key"], r["pos"], r["cnt"], r["total"]) for r in api.query_taxa(c, sort=("v", "mean")).collect()]
    assert sorted(got) == [("0", 1, 3, 3), ("1", 2, 3, 3), ("2", 0, 3, 3)]


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def test_state_outlives_its_sink_and_is_pruned(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame([("c", at(h), float(v), p, s) for h, v, p, s in rows], HOUR)
    one = Revisions(spark, str(tmp_path / "state"), keep_hours=48, block_hours=6)
    one(batch((0, 1, 2, 1), (7, 2, 2, 1)), 0)
    two = Revisions(spark, str(tmp_path / "state"), keep_hours=48, block_hours=6)
    assert two.version == 0
    two(batch((7, 9, 1, 2), (8, 4, 2, 1)), 1)
    two(batch((7, 5, 2, 3)), 2)  # a worse source, later
    three = Revisions(spark, str(tmp_path / "state"), keep_hours=48, block_hours=6)
    three(batch((7, 5, 2, 3)), 2)  # the same batch again
    got = sorted((r["hour"], r["value"]) for r in three.current().collect())
    assert got == [(at(0), 1.0), (at(7), 9.0), (at(8), 4.0)]
    assert three.manifest(2)[min(three.manifest(2))] == one.manifest(2)[min(one.manifest(2))] == "blocks/0/block=" + str(min(three.manifest(2)))
    changed = sorted(r["hour"] for r in three.windows((24,), changed_only=True).collect())
    assert changed == [at(7), at(8)]
    three(batch((100, 3, 1, 1)), 3)
    assert [r["hour"] for r in three.windows((24,)).collect()] == [at(100)]
    three(batch((101, 3, 1, 1)), 4)
    assert three.versions() == [3, 4] and not (tmp_path / "state" / "blocks" / "0").exists()


def plain_ratio(a, b):
    """The token-set ratio by its definition, with a table of edits."""

    def indel(x, y):
        if not x and not y:
            return 100.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last if c == d else 1 + min(row[j], row[j - 1])
        return 100.0 * (1 - row[-1] / (len(x) + len(y)))

    p, q = set(a.split()), set(b.split())
    if not p or not q:
        return 0.0
    both, x, y = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
    if both and (not x or not y):
        return 100.0
    one, two = " ".join(z for z in (both, x) if z), " ".join(z for z in (both, y) if z)
    return max([indel(one, two)] + ([indel(both, one), indel(both, two)] if both else []))


def test_token_set_ratio_equals_a_plain_one():
    import random

    rng = random.Random(1)
    words = ["quercus", "robur", "alba", "rubra", "roburs", "x", "querc"]
    for _ in range(500):
        a, b = (" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(2))
        assert text.token_set_ratio_of(a, b) == pytest.approx(plain_ratio(a, b))


def test_accents(spark):
    names = ["  Ärzte", "Côte d’Ivoire", "São Tomé", "İzmir", "Ångström", "e\u0301te\u0301", "Łódź", "ß", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.without_accents(F.col("n"))).collect()]
    assert got == ["arzte", "cote d’ivoire", "sao tome", "izmir", "angstrom", "ete", "łodz", "ß", None]
