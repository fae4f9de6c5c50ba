"""Habitat models on DataFrames (ML-01..10)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .ranking import numbered, summed_below

SEED = 42


def split(df: DataFrame, ident: str, share: float = 0.8, label: str = "label") -> DataFrame:
    """ML-04: a stratified split that is the same at each run: of each class the given share, in the order of a seeded hash of the id."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col(ident).cast("string")))
    rows = numbered(df, [F.asc(label), drawn.asc(), F.asc(ident)], "_row")
    classes = rows.groupBy(F.col(label).alias("_class")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))  # one row per class
    rows = rows.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("_class")))
    return rows.withColumn("is_train", F.col("_row") - F.col("_first") < F.round(F.col("_n") * share)).drop("_row", "_class", "_first", "_n")


Box = tuple[float, float, float, float]  # south, north, west, east
#: How the box around the positives grows while negatives are wanting; the globe is the last.
WINDOW_FACTORS = (6.0, 30.0, 150.0)
GLOBE: Box = (-89.999, 89.999, -179.999, 179.999)


def _unit(ident: str, salt: str) -> Column:
    """A number from 0 up to 1 by a hash: the same at each run and in any SQL engine."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(salt))), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def ring_points(spark, n: int, outer: Box, inner: Box, seed: int = SEED, first: int = 0) -> DataFrame:
    """ML-02: of n points of the outer box those that are not in the inner one."""
    s, t, w, e = outer
    pts = spark.range(first, first + n).select("id", (_unit("id", f"lat{seed}") * (t - s) + s).alias("lat"), (_unit("id", f"lon{seed}") * (e - w) + w).alias("lon"))
    return pts.where(~(F.col("lat").between(inner[0], inner[1]) & F.col("lon").between(inner[2], inner[3])))


def negative_plan(box: Box, padding: float = 0.5) -> list[tuple[Box, Box]]:
    """ML-02: rings (outer, inner) to draw negatives from, nearest first: the box grown by each factor, then the globe."""
    rings, inner = [], box
    for factor in WINDOW_FACTORS:
        half = [((box[k + 1] - box[k]) / 2 * factor + padding, (box[k] + box[k + 1]) / 2) for k in (0, 2)]
        outer = tuple(max(min(m + sign * h, edge), -edge) for (h, m), edge in zip(half, (89.999, 179.999), strict=True) for sign in (-1, 1))
        rings.append((outer, inner))
        inner = outer
    return [*rings, (GLOBE, inner)]


def negatives(spark, wanted: int, box: Box, accept, oversample: int = 4) -> DataFrame:
    """ML-02: `wanted` negative points: each ring in turn gives points that accept (a filter of points) keeps, until there
    are enough; the first by id of the first rings are taken."""
    found, have = None, 0
    for k, (outer, inner) in enumerate(negative_plan(box)):
        ring = accept(ring_points(spark, wanted * oversample, outer, inner, first=k * wanted * oversample)).withColumn("ring", F.lit(k))
        found = ring if found is None else found.unionByName(ring)
        have += ring.count()
        if have >= wanted:
            break
    return found.orderBy("id").limit(wanted)


def pruned(df: DataFrame, features: list[str]) -> list[str]:
    """PRJ-16: features that have a value, by one aggregation."""
    row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def imputed(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """ML-03: missing numbers by the column's median, missing classes by its most frequent class, the first of equals."""
    row = df.agg(*[F.median(c).alias(c) for c in numeric]).first() if numeric else {}
    out = df.withColumns({c: F.coalesce(c, F.lit(row[c])) for c in numeric})
    for c in categorical:
        n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        out = out.withColumn(c, F.coalesce(c, F.lit(n.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).first()[0])))
    return out


def pipeline(numeric: list[str], categorical: list[str], kind: str = "boosted", trees: int = 300) -> Pipeline:
    """ML-03/04: median and index imputation, one-hot classes, then boosted trees or a penalised logistic model."""
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_i" for c in numeric])] if numeric else []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_x", outputCol=f"{c}_h", handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[f"{c}_i" for c in numeric] + [f"{c}_h" for c in categorical], outputCol="raw", handleInvalid="keep"))
    if kind == "boosted":
        return Pipeline(stages=[*stages, GBTClassifier(featuresCol="raw", labelCol="label", maxIter=trees, stepSize=0.05, maxDepth=3, subsamplingRate=0.8, seed=SEED)])
    return Pipeline(stages=[*stages, StandardScaler(inputCol="raw", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.01)])


def scored(model, df: DataFrame) -> DataFrame:
    """ML-07."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "raw", "scaled")


def metrics(df: DataFrame) -> DataFrame:
    """ML-05: accuracy at 0.5, log loss and rank AUC of columns score, label, in one aggregation per distinct score."""
    by = staged(df.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), "scores")  # the model runs once
    run = summed_below(by, [F.asc("score")], {"_below": F.col("n")})
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    agg = run.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), (F.sum(F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))) / F.sum("n")).alias("accuracy"), (-F.sum(F.col("pos") * F.ln(p) + (F.col("n") - F.col("pos")) * F.ln(1 - p)) / F.sum("n")).alias("log_loss"), F.sum(F.col("pos") * (F.col("_below") + (F.col("n") + 1) / 2)).alias("_r"))
    auc = (F.col("_r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return agg.select("n", "accuracy", "log_loss", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), auc).alias("auc"))


def linear_score(df: DataFrame, vector: str, weights: list[float]) -> DataFrame:
    """A dot product without leaving the JVM."""
    dot = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("score", dot)


def composed(habitat: DataFrame, phenology: DataFrame, key: str) -> DataFrame:
    """ML-08: the product where both exist, else the one that does."""
    b = phenology.select(key, F.col("score").alias("_s"))
    return habitat.join(b, key, "full_outer").select(key, F.when(F.col("score").isNotNull() & F.col("_s").isNotNull(), F.col("score") * F.col("_s")).otherwise(F.coalesce("score", "_s")).alias("score"))


def save(model, path: str, measured: DataFrame, summary: dict[str, str]) -> None:
    """SNK-19: the fitted pipeline, its metrics (one row) and a summary, in a replaced folder."""
    model.write().overwrite().save(f"{path}/model")
    measured.write.mode("overwrite").json(f"{path}/metrics")
    measured.sparkSession.createDataFrame(sorted(summary.items()), "name string, value string").write.mode("overwrite").json(f"{path}/summary")


def load(path: str) -> PipelineModel:
    """SNK-19: the fitted pipeline of `save`."""
    return PipelineModel.load(f"{path}/model")


def feature_spec(layers: DataFrame, hours: tuple[int, ...] = (), temporal: str = "temporal") -> dict[str, list[str]]:
    """ML-01: the catalogue's layers (id, category, value_type, agg, ord) as numeric and categorical features in order;
    windowed layers are appended as numeric ones, `<id>_<agg>_<h>h`."""
    rows = layers.orderBy("ord").collect()  # a catalogue: some hundred layers
    static = [r for r in rows if (r["category"] or "").strip().lower() != temporal and (r["id"] or "").strip()]
    if not static:
        raise ValueError("the catalogue has no layers but temporal ones")
    kinds = {r["id"]: (r["value_type"] or "").strip().lower() == "categorical" for r in static}
    moving = [f"{r['id']}_{r['agg']}_{h}h" for r in rows if (r["category"] or "").strip().lower() == temporal and r["agg"] in ("avg", "sum") for h in hours]
    return {"all": [*kinds, *moving], "numeric": [*[i for i, c in kinds.items() if not c], *moving], "categorical": [i for i, c in kinds.items() if c], "temporal": moving}


#: What each training mode learns from.
MODES = {"sdm": {"temporal": False, "static": True, "label": "presence"}, "full": {"temporal": True, "static": True, "label": "presence"}, "phenology": {"temporal": True, "static": False, "label": "phenology"}}


def mode_features(spec: dict[str, list[str]], mode: str) -> dict[str, list[str]]:
    """ML-10: the features of a training mode: `sdm` static layers, `full` those and windows, `phenology` windows alone."""
    if mode not in MODES:
        raise ValueError(f"unknown training mode {mode!r}: one of {', '.join(MODES)}")
    wants, moving = MODES[mode], set(spec["temporal"])
    numeric = [c for c in spec["numeric"] if wants["temporal" if c in moving else "static"]]
    return {"numeric": numeric, "categorical": spec["categorical"] if wants["static"] else [], "label": wants["label"]}


def batch_plan(taxa: DataFrame, tree: DataFrame, counts: DataFrame, root: str | None, least: int, leaves: tuple[str, ...], is_plant: Column, phenology: bool = True, full: bool = False) -> DataFrame:
    """ML-09: (taxon_key, samples, mode, place): the passes of a batch.  Leaf taxa with at least `least` rows, those under a
    root if one is given, most rows first; all are trained for habitat, plants for phenology if asked, others (and plants
    if asked) with all features."""
    rows = taxa.where(F.upper("rank").isin(*leaves)).join(counts.select("taxon_key", F.col("cnt").alias("samples")), "taxon_key").where(F.col("samples") >= least)
    if root is not None:
        rows = rows.join(tree.where(F.col("ancestor") == root).select(F.col("descendant").alias("taxon_key")), "taxon_key", "left_semi")
    modes = F.array_compact(F.array(F.struct(F.lit(0).alias("o"), F.lit("sdm").alias("mode")), F.when(is_plant & F.lit(phenology), F.struct(F.lit(1).alias("o"), F.lit("phenology").alias("mode"))), F.when(~is_plant | F.lit(full), F.struct(F.lit(2).alias("o"), F.lit("full").alias("mode")))))
    rows = rows.select("taxon_key", "samples", F.explode(modes).alias("m"))
    return numbered(rows, [F.desc("samples"), F.asc("taxon_key"), F.col("m.o").asc()], "place").select("taxon_key", "samples", F.col("m.mode").alias("mode"), "place")


def batch_scores(rows: DataFrame, features: list[str], rounds: int = 200, rate: float = 0.5) -> DataFrame:
    """ML-09: one logistic model per taxon, all trained side by side: rows (taxon_key, label, features) of a taxon meet in one
    task, which holds its capped training set; result: taxon_key, n, accuracy, weights (the last is the bias)."""
    import numpy as np
    import pandas as pd

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].to_numpy(float)
        y = pdf["label"].to_numpy(float)
        mean, std = np.nanmean(x, 0), np.nanstd(x, 0)
        x = np.hstack([np.nan_to_num((x - mean) / np.where(std > 0, std, 1)), np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            w += rate * (x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) / len(y) - 0.001 * w)
        right = ((x @ w >= 0) == (y > 0.5)).mean()
        return pd.DataFrame({"taxon_key": [key[0]], "n": [len(y)], "accuracy": [float(right)], "weights": [w.tolist()]})

    return rows.select("taxon_key", "label", *features).groupBy("taxon_key").applyInPandas(one, "taxon_key string, n long, accuracy double, weights array<double>")


def resolved_artifact(registry: DataFrame, model: str | None, taxon_key: str | None, kind: str = "gbt") -> str | None:
    """ML-06: the name of the artifact that a request means, from a registry of names; None if there is none.

    Without a model the latest of the taxon and kind; `auto_<kind>_<mode>` the latest of the taxon, kind and mode (for sdm
    also of the kind alone, as older ones are named); another name exactly, and for a taxon's name also its latest.
    """
    asked, key = (model or "").strip(), (taxon_key or "").strip()

    def latest(prefix: str) -> str | None:
        name = F.col("name")
        row = registry.where((name == prefix) | F.startswith(name, F.lit(prefix + "_"))).agg(F.max_by("name", F.struct(name == prefix, name))).first()
        return row[0]

    if not asked or asked.startswith("auto_"):
        wanted = asked.removeprefix("auto_").lower() or kind
        if not key or asked == "auto_":
            return None
        found = latest(f"taxon_{key}_{wanted}")
        old, _, mode = wanted.rpartition("_")
        return latest(f"taxon_{key}_{old}") if found is None and asked and mode == "sdm" else found
    exact = registry.where(F.col("name") == asked).select("name").first()
    if exact:
        return exact[0]
    return latest(asked.rstrip("_")) if asked.startswith("taxon_") else None
