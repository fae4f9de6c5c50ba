"""The pipeline, stage by stage, against brute force, and its rule for rows that share an id."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import quality
from terrafold.llm.queries import ORACLE
from tests.llm.test_ops import edge_bench, edge_docs, edge_labels

SF = "/root/testdata/sf0.001"
TOP = (1 << 63) - 1


def key(r):
    return (r["doc_id"] is None, r["doc_id"])


def by_quality(rows, spark, docs, labels, benchmark):
    model = quality.fit(docs, labels)
    return [r for r in rows if quality.scores_of(model, [quality.statistics(r["text"])])[0] >= 0.5]


def by_text(rows, *_):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[ \\t-\\r]", "", r["text"] or "")].append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), key(r))) for g in groups.values()]


def by_shingles(rows, *_):
    rows = sorted(rows, key=key)
    sets = []
    for r in rows:
        w = re.findall("[^ \\t-\\r]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [r for k, r in enumerate(rows) if find(k) == k]


def by_windows(rows, spark, docs, labels, benchmark):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for r in benchmark.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    return [r for r in rows if not any(tuple(w[k : k + n]) in some for w in [words(r["text"])] for n, some in windows.items() for k in range(len(w) - n + 1))]


def by_mix(rows, spark, docs, labels, benchmark):
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    taken = {r[0]: r for r in con.execute(f"select doc_id, size, source_size, target, taken from ({ORACLE['op8_mixing']})").fetchall()}
    return [(r, taken[r["doc_id"]][1:]) for r in rows if taken[r["doc_id"]][4] > 0]


BRUTE = {"quality": by_quality, "exact": by_text, "near": by_shingles, "benchmark": by_windows, "mix": by_mix}


@pytest.mark.parametrize("first", [0, TOP - 10_000])
def test_every_stage_equals_brute_force(spark, tmp_path, first):
    """All rows of the smallest table, and the same with the largest ids."""
    sf = str(tmp_path)
    moved = F.col("doc_id") + F.lit(first)
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", moved).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", moved).write.parquet(f"{sf}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    labels, benchmark = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        got = spark.read.parquet(f"{sf}/{k}")
        want = BRUTE[name](rows, spark, docs, labels, benchmark)
        if name == "mix":
            assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((*tuple(r), *more)) for r, more in want)
        else:
            assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want)), name
            assert 0 < len(want) <= len(rows)
        docs = got
    if not first:
        assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b + " end"), (None, a + " end"), (None, c), (None, c), (2, c + " end"), (3, a)]
    docs = spark.createDataFrame([(i, t, "s", 5, "mine") for i, t in rows], "doc_id long, text string, source string, taken int, size string")
    docs.write.parquet(f"{tmp_path}/d")
    for frame in (docs, spark.read.parquet(f"{tmp_path}/d")):
        exact = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.exact_stage(spark, frame, "").collect())
        assert exact == sorted(map(str, [(1, a), (1, b), (1, b + " end"), (None, a + " end"), (None, c), (2, c + " end")]))
        near = sorted(str((r["doc_id"], r["text"][:2])) for r in corpus_pipeline.near_stage(spark, frame, "").collect())
        assert len(near) == 3 and [x for x in near if "(2," in x] == ["(2, 'c0')"] and [x for x in near if "(1," in x] == ["(1, 'a0')", "(1, 'b0')"]
    mixed = corpus_pipeline.mix_stage(spark, docs, "").collect()
    assert all(r["taken"] == 5 and r["size"] == "mine" and 0 < r["mix_taken"] <= 2 * r["mix_size"] == 2 * len(r["text"].split()) for r in mixed)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    edge_labels(spark).write.parquet(f"{sf}/labels.parquet")
    edge_bench(spark).write.parquet(f"{sf}/benchmark.parquet")
    edge_docs(spark).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.where("false"), sf).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.exact_stage(spark, docs, sf).collect()]
    assert sum(i == 1 for i, _ in kept) == 1 and (8, "one  two") in kept and not any(i in (2, 7, None) for i, _ in kept)
    assert 1 not in {r["doc_id"] for r in corpus_pipeline.benchmark_stage(spark, docs, sf).collect()}
