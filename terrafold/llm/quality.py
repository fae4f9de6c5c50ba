"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration (op1).

Statistics of the whole text (byte classes, words, repeats, lines, compressibility) are standardised and mapped to
`features` random Fourier features, which approximate a Gaussian kernel.  Partitions sum the normal equations of their
labelled rows; the sums are added up row by row of the matrix, so nothing larger than a matrix row per partition meets
in one place.  Ridge scores are calibrated by isotonic regression on a part of the labelled rows that the ridge does not
see.  `max_labelled` bounds the labelled rows (a hash sample of all of them); scoring covers every row.

Defined results: null text counts as empty, and empty texts get the score of their statistics; labels of null or other
than 0 and 1 are left out; with labels of one class only, that class's share is the score of every text; rows that
repeat a doc_id get the same score for the same text, and one of their texts is used per label row; an empty document
table gives an empty result.  Scores depend on the text alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, rows_of, small_batches, staged, with_rows

STATS = 30
SEED = 7
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c == 32 else 4 if _c == 10 else 5 if _c in b".,;:?'" else 6 if _c == 33 else 7 if _c in b"|<>{}[]()=/\\_" else 8 if _c in b"#$%&*@^~+" else 9 if _c >= 128 else 10


def statistics(text: str | None) -> list[float]:
    """STATS numbers that describe a text; all are bounded or grow with the logarithm of its length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, hist, 11) / n
    words = data.lower().split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    bare = [w.strip(b".,!?;:|#$%&*") for w in words]
    counts: dict[bytes, int] = {}
    for w in bare:
        counts[w] = counts.get(w, 0) + 1
    same_next = sum(map(bytes.__eq__, bare, bare[1:]))
    pairs = len(set(zip(bare, bare[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    sentences = max(1, data.count(b". ") + data.count(b".\n") + data.endswith(b"."))
    top = sorted(counts.values(), reverse=True)[:3]
    entropy = -sum(p * np.log2(p) for p in (hist[hist > 0] / n)) if data else 0.0
    return [
        np.log1p(len(data)), np.log1p(len(words)), *share, lengths.mean(), lengths.std(), len(counts) / m, pairs / m, same_next / m, sum(top) / m,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(m / sentences), len(zlib.compress(data, 1)) / n, entropy,
        sum(w[-1:] in b"!|#$%&*" for w in words) / m, sum(len(w) > 12 for w in words) / m, sum(len(w) <= 2 for w in words) / m, sum(not w for w in bare) / m, float(not words), max(counts.values(), default=0) / m * np.log1p(m),
    ]


def _stats(batches):
    for b in batches:
        values = [statistics(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "label", "stats"])


class Fourier:
    """Standardisation and random Fourier features."""

    def __init__(self, mean, std, features: int, width: float = 0.35):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = np.asarray(mean), np.asarray(std)
        self.w = rng.standard_normal((len(self.mean), features)) * width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x rising, y not falling)."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, bound: int) -> DataFrame:
    """doc_id, text, label: at most about `bound` labelled rows that are not held out, taken by a hash of doc_id; one text for each."""
    y = F.col(label).cast("int")
    known = labels.select(F.col("doc_id").cast("long"), y.alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), parts, part)).distinct()
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    # At most about `bound` ids and labels: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, part: int = 1, features: int = 192, ridge: float = 0.02, max_labelled: int = 20_000) -> dict:
    """A model as plain arrays, small enough to send with a task."""
    rows = labelled_rows(docs, labels, label, parts, part, max_labelled)
    rows = rows.select("doc_id", "text", "label").mapInArrow(_stats, "doc_id long, label int, stats array<double>")
    rows = staged(rows.select("doc_id", "label", "stats", (F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(4)) == 0).alias("calibrates")), "labelled-stats")
    row = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(STATS)], *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(STATS)]).first()
    if not row["n"] or row["share"] in (0.0, 1.0):
        return {"constant": float(row["share"] if row["n"] else 0.5)}
    mean = [row[f"m{k}"] for k in range(STATS)]
    std = [max(row[f"s{k}"], 1e-6) for k in range(STATS)]
    fourier = Fourier(mean, std, features)

    def equations(batches):
        total = None
        for b in batches:
            x = fourier(np.array(b.column(0).to_pylist(), float).reshape(-1, STATS))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            part = np.hstack([x.T @ x, (x.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = r.values.to_numpy(zero_copy_only=False)
                sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])

    parts_of = rows.where("not calibrates").select("stats", "label").mapInArrow(equations, "i int, row array<double>")
    matrix = np.array([r["row"] for r in sorted(parts_of.repartition("i").mapInArrow(added, "i int, row array<double>").collect(), key=lambda r: r["i"])])
    n = matrix[-1, -2] if len(matrix) else 0
    if not n:
        return {"constant": float(row["share"])}
    solved = np.linalg.solve(matrix[:, :-1] / n + ridge / 100 * np.eye(len(matrix)), matrix[:, -1] / n)

    def raw(batches):
        for b in batches:
            s = fourier(np.array(b.column(0).to_pylist(), float).reshape(-1, STATS)) @ solved
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s, 3)), b.column(1)], ["x", "y"])

    seen = rows.where("calibrates").select("stats", "label").mapInArrow(raw, "x double, y int").groupBy("x").agg(F.avg("y").alias("y"), F.count("*").alias("w")).collect()
    seen = sorted((r["x"], r["y"], r["w"]) for r in seen)
    x, y, w = (np.array(v, float) for v in zip(*seen, strict=True)) if seen else (np.array([0.0]), np.array([row["share"]]), np.ones(1))
    kx, ky = isotonic(x, y, w)
    return {"mean": mean, "std": std, "features": features, "solved": solved, "kx": kx, "ky": ky}


def scores_of(model: dict, stats: np.ndarray) -> np.ndarray:
    """0 to 1.  A thousandth of the score keeps the order of ridge scores within a flat part of the calibration."""
    if "constant" in model:
        return np.full(len(stats), model["constant"])
    raw = Fourier(model["mean"], model["std"], model["features"])(stats) @ model["solved"]
    return np.clip(0.999 * np.interp(raw, model["kx"], model["ky"]) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _scored(model):
    def run(batches):
        for b in batches:
            s = np.zeros(0)
            if b.num_rows:
                s = scores_of(model.value, np.array([statistics(t) for t in b.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *b.columns[1:]], ["doc_id", "score", *b.schema.names[1:]])

    return run


def _results(threshold: float, parts: int, part: int) -> dict:
    return {"held_out": held_out(F.col("doc_id"), parts, part), "predicted": (F.col("score") >= threshold).cast("int")}


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, parts: int = 3, part: int = 1, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, parts, part, **options))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = texts.mapInArrow(lambda batches: (b.drop_columns(["text"]) for b in _scored(model)(batches)), "doc_id long, score double")
    return out.withColumns(_results(threshold, parts, part)).select("doc_id", "held_out", "score", "predicted")


def scored_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, parts: int = 3, part: int = 1, result: str = "quality", **options) -> DataFrame:
    """Whole rows of docs, each with its own result: a struct of held_out, score and predicted. Nothing is joined by id."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, parts, part, **options))
    rows = with_rows(docs)
    out = rows.mapInArrow(_scored(model), f"doc_id long, score double, text string, _row {rows.schema['_row'].dataType.simpleString()}")
    return out.withColumns(_results(threshold, parts, part)).select(*rows_of(docs), F.struct("held_out", "score", "predicted").alias(result))
