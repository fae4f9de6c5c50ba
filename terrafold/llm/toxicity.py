"""Toxicity by a subsequence string kernel and Nyström landmarks (op6).

The gap-weighted subsequence kernel K compares two words by their common subsequences of three characters, each weighted
by how far it is stretched, so gapped words and inserted characters stay similar.  A document is the set of its words,
and the kernel of two documents is the sum of K^2 + K^4 (each scaled) over all pairs of their words: powers and sums of
kernels are kernels, and high powers keep many faint similarities of a long text from adding up.

Landmarks are learned from labelled documents: character strings that cover the toxic ones and are rare in the others.
The Nyström map of a document is, for each power, its kernel values with all landmarks times the inverse square root of
the landmarks' own kernel matrix.  A linear support vector machine (squared hinge) on it is calibrated by isotonic
regression on labelled documents of its own.

Only words that share a character trigram with a landmark, with at most one inserted character at each step, are
compared, and all their kernel values count; a word without one has kernel values near 0.  Words over WIDTH characters are cut into pieces that
overlap by a landmark of LONGEST characters with one inserted in every gap; runs of single characters are joined, and
characters that no landmark has do not count as gaps.  Landmarks may be of any scripts.

Bounds of the fit, all parameters: `max_labelled` labelled rows (a hash sample), `pool` strings that most toxic documents
have as candidates, `landmarks` of them that cover most.  Toxic words that share no trigram with any landmark add
nothing.  Every text is scored whole.  Defined results: null or empty text has no words and gets the score of a text
without landmarks; labels other than 0 and 1 are left out; without toxic labels every score is the share of toxic
labels; repeated rows get equal scores; scores depend on the text alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, staged
from .quality import labelled_rows

WIDTH = 24
LONGEST = 10
SHORTEST = 4
START, STOP = "\x02", "\x03"  # bounds of a word, so that a landmark can be a beginning or an end
STRIDE = WIDTH - (2 * LONGEST - 1) + 1  # of pieces: each gapped landmark is whole in one
LANDMARKS = 60
POOL = 20_000
POWERS = (2, 4)
SLOT_BITS = 18
DECAY = 0.5
STEPS = ((1, 2), (1, 3), (2, 3), (2, 4))
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|#$%&*+-_/\\=~`^@"
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){3,}")
HELD_WORDS = 400_000
DOCS = 4096


def words_of(text: str | None, known: frozenset | None = None) -> set[str]:
    """Words with their bounds; of words to be cut, characters that are not known go first."""
    words = {w.strip(EDGE) for w in (text or "").lower().split()}
    words.discard("")
    if sum(len(w) == 1 for w in words) >= 3:
        words.update(re.sub(r"\s", "", m) for m in _SPACED.findall(text.lower()))
    words = {f"{START}{w}{STOP}" for w in words}
    long = [w for w in words if len(w) > WIDTH]
    for w in long:
        words.discard(w)
        if known is not None:
            w = START + "".join(c for c in w[1:-1] if c in known) + STOP
        words.update(w[k : k + WIDTH] for k in range(0, max(1, len(w) - WIDTH + STRIDE), STRIDE))
    return words


def kernel(x: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Subsequence kernel of order 3 between each row of x (0: no character) and one landmark."""
    n, m = len(x), len(landmark)
    same = x[:, :, None] == landmark[None, None, :]
    upto = [np.ones((n, m + 1), np.float32)] + [np.zeros((n, m + 1), np.float32) for _ in range(2)]
    total = np.zeros(n, np.float32)
    for i in range(x.shape[1]):
        hit = same[:, i, :]
        if not hit.any():
            upto[1] *= DECAY
            upto[2] *= DECAY
            continue
        total += DECAY**2 * (hit * upto[2][:, :-1]).sum(1)
        for q in (2, 1):
            run = np.zeros(n, np.float32)
            upto[q] *= DECAY
            gain = DECAY**2 * hit * upto[q - 1][:, :-1]
            for j in range(m):
                run = DECAY * run + gain[:, j]
                upto[q][:, j + 1] += run
    return total


class Landmarks:
    def __init__(self, strings: list[str], ridge: float = 0.05):
        self.strings = strings
        self.known = frozenset(c for s in strings for c in s)
        self.base = len(self.known) + 1
        self.ids = np.zeros(0x110000, np.min_scalar_type(self.base))
        self.ids[sorted(map(ord, self.known))] = np.arange(1, self.base)
        self.codes = [self._codes([s])[0][: len(s)] for s in strings]
        self.own = np.array([float(kernel(c[None, :], c)[0]) for c in self.codes])
        # Trigrams as sorted numbers, the landmarks of each as words of bits, and a hashed set to look only few of them up.
        owners: dict[int, set[int]] = defaultdict(set)
        for k, c in enumerate(self.codes):
            for a in range(len(c) - 2):
                owners[self._trigram(*map(np.uint64, c[a : a + 3]))].add(k)
        self.trigrams = np.array(sorted(owners), np.uint64)
        self.owners = np.zeros((len(owners), -(-len(strings) // 64)), np.uint64)
        for r, t in enumerate(self.trigrams):
            for k in owners[t]:
                self.owners[r, k // 64] |= np.uint64(1 << k % 64)
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[self._slot(self.trigrams)] = True
        wide = np.zeros((len(strings), WIDTH), self.ids.dtype)
        for k, c in enumerate(self.codes):
            wide[k, : len(c)] = c
        self.scale = float(np.sqrt(np.median(self.own)))
        self.gram = np.array([kernel(wide, c) for c in self.codes]) / np.sqrt(np.outer(self.own, self.own))
        n = len(strings)
        self.white = np.zeros((n * len(POWERS), n * len(POWERS)))
        for i, p in enumerate(POWERS):
            self.white[i * n : (i + 1) * n, i * n : (i + 1) * n] = self._root(self.gram**p, ridge)

    @staticmethod
    def _root(k: np.ndarray, ridge: float) -> np.ndarray:
        """The inverse square root of a kernel matrix."""
        values, vectors = np.linalg.eigh((k + k.T) / 2 + ridge * np.eye(len(k)))
        return vectors @ np.diag(np.maximum(values, ridge) ** -0.5) @ vectors.T

    def _trigram(self, a, b, c):
        base = np.uint64(self.base)
        return (a * base + b) * base + c

    def _slot(self, trigrams: np.ndarray) -> np.ndarray:
        return (trigrams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _marks(self, codes: np.ndarray) -> np.ndarray:
        """Words of bits per row: the landmarks that share a trigram with it."""
        c = np.pad(codes, ((0, 0), (0, 4))).astype(np.uint64)
        marks = np.zeros((len(codes), self.owners.shape[1]), np.uint64)
        for a, b in STEPS:
            trigrams = self._trigram(c[:, :WIDTH], c[:, a : WIDTH + a], c[:, b : WIDTH + b]).ravel()
            at = np.flatnonzero(self.slots[self._slot(trigrams)])
            found = np.minimum(np.searchsorted(self.trigrams, trigrams[at]), len(self.trigrams) - 1)
            same = self.trigrams[found] == trigrams[at]
            rows, found = at[same] // WIDTH, found[same]
            if len(rows):
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                marks[rows[first]] |= np.bitwise_or.reduceat(self.owners[found], first, axis=0)
        return marks

    def _codes(self, words: list[str]) -> np.ndarray:
        points = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
        codes = self.ids[points]
        inner = (codes == 0) & (np.maximum.accumulate((codes != 0)[:, ::-1], axis=1)[:, ::-1])
        rows = np.flatnonzero(inner.any(1))
        if len(rows):
            order = np.argsort(codes[rows] == 0, axis=1, kind="stable")
            codes[rows] = np.take_along_axis(codes[rows], order, 1)
        return codes

    def _near(self, words: list[str]):
        """Arrays (word, landmark, kernel value over that of the landmark with itself) of words that come near a landmark."""
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for at in range(0, len(words), 65536):
            codes = self._codes(words[at : at + 65536])
            marks = self._marks(codes)
            some = np.flatnonzero(marks.any(1))
            for k, landmark in enumerate(self.codes):
                rows = some[(marks[some, k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1]
                if len(rows):
                    for column, part in zip(found, (rows + at, np.full(len(rows), k), kernel(codes[rows], landmark) / self.own[k]), strict=True):
                        column.append(part)
        return [np.concatenate(column) for column in found]

    def similar(self, words: list[str]) -> dict[str, list[tuple[int, float]]]:
        """Of words that come near a landmark: which, and the kernel value over that of the landmark with itself (1: holds it once)."""
        out: dict[str, list[tuple[int, float]]] = {}
        for w, k, value in zip(*(column.tolist() for column in self._near(words)), strict=True):
            out.setdefault(words[w], []).append((k, value))
        return out

    def columns(self, words: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of words that come near a landmark: the columns of the document kernel that they add to, and how much."""
        rows, landmarks, ratio = self._near(words)
        x, m = ratio * np.sqrt(self.own[landmarks]) / self.scale, len(self.strings)
        at = np.concatenate([landmarks + i * m for i in range(len(POWERS))]).astype(np.int32)
        values = np.concatenate([x**p for p in POWERS])
        rows = np.tile(rows, len(POWERS))
        order = np.argsort(rows, kind="stable")
        rows, at, values = rows[order], at[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(rows))
        return {words[rows[a]]: (at[a:b], values[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


def matrix_of(docs: list[set[str]], near: dict[str, tuple[np.ndarray, np.ndarray]], landmarks: Landmarks) -> np.ndarray:
    """The kernel values of documents with all landmarks, for each power: what the Nyström map multiplies."""
    width = len(landmarks.strings) * len(POWERS)
    at, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for r, words in enumerate(docs):
        for w in words & near.keys():
            columns, added = near[w]
            at.append(columns + r * width)
            values.append(added)
    return np.bincount(np.concatenate(at), np.concatenate(values), len(docs) * width).reshape(len(docs), width)


def bags(batches, landmarks: Landmarks):
    """(batch, matrix of kernel values per document). Words met before are not compared again."""
    far: set[str] = set()
    near: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(held):
        nonlocal far, near
        every = [[words_of(t, landmarks.known) for t in b.column(1).to_pylist()] for b in held]
        new = set().union(*(w for e in every for w in e)) - far - near.keys()
        fresh = list(new)
        near.update(landmarks.columns(fresh) if fresh else {})
        far |= new - near.keys()
        for b, docs in zip(held, every, strict=True):
            yield b, matrix_of(docs, near, landmarks)
        if len(far) + len(near) > HELD_WORDS:
            far, near = set(), {}

    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= DOCS or size > 1 << 24:
            yield from flush(held)
            held, n, size = [], 0, 0
    if held:
        yield from flush(held)


def grams(words) -> set[str]:
    return {w[k : k + n] for w in words for n in range(SHORTEST, LONGEST + 1) for k in range(len(w) - n + 1)}


def choose_landmarks(rows: DataFrame, least: int = 3, most: int = LANDMARKS, pool: int = POOL) -> list[str]:
    """Strings of SHORTEST to LONGEST characters that cover the toxic documents of rows (doc_id, text, label)."""

    def vocabulary(batches):
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w in words_of(t):
                    counts[w][y] += 1
            if len(counts) > HELD_WORDS:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    def _counts(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["word", "clean", "toxic"])

    def words(batches):
        for b in batches:
            found = [list(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["doc_id", "words"])

    def strings(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(grams(w)) for w in b.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "grams"])

    seen = rows.select("doc_id", "text", "label").mapInArrow(vocabulary, "word string, clean long, toxic long")
    seen = staged(seen.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "vocabulary")
    rare = seen.where("toxic > 0 and clean <= 0.25 * toxic").select("word")
    toxic = rows.where("label = 1").select("doc_id", "text").mapInArrow(words, "doc_id long, words array<string>")
    toxic = toxic.select("doc_id", F.explode("words").alias("word")).join(rare, "word", "left_semi").groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    have = staged(toxic.mapInArrow(strings, "doc_id long, grams array<string>"), "strings").select("doc_id", F.explode("grams").alias("gram"))
    # The pool bounds what the driver and the closures hold.
    df = {r[0]: r[1] for r in have.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(pool).collect()}

    def clean_counts(batches):
        counts: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in grams([w]) & df.keys():
                    counts[g] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    clean = {r[0]: r[1] for r in seen.where("clean > 0").select("word", "clean").mapInArrow(clean_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    good = rows.sparkSession.createDataFrame([(g,) for g in sorted(df) if clean.get(g, 0) <= df[g]], "gram string")  # at least half of its documents are toxic
    where = {r[0]: np.array(r[1]) for r in have.join(F.broadcast(good), "gram").groupBy("gram").agg(F.array_sort(F.collect_list("doc_id"))).collect()}
    return covering(where, clean, least, most)


def covering(where: dict[str, np.ndarray], clean: dict[str, int], least: int, most: int) -> list[str]:
    """Greedy cover: each round takes the string with most documents that are not covered twice, less half its clean ones, as long as nine in ten of its documents go along."""
    if not where:
        return []
    names, found = sorted(where), []
    flat = np.concatenate([where[g] for g in names])
    starts = np.concatenate([[0], np.cumsum([len(where[g]) for g in names])])
    places, flat = np.unique(flat, return_inverse=True)
    sizes, half = np.diff(starts), np.array([clean.get(g, 0) // 2 for g in names])
    covered, live = np.zeros(len(places), np.int32), np.ones(len(names), bool)
    while live.any() and len(found) < most:
        gain = np.where(live, np.add.reduceat(covered[flat] < 2, starts[:-1], dtype=np.int64) - half, np.iinfo(np.int64).min)
        if gain.max() < least:
            break
        best = max(np.flatnonzero(gain == gain.max()), key=lambda k: (len(names[k]), names[k]))
        g = names[best]
        wider = [k for k in np.flatnonzero(live & (sizes >= 0.9 * sizes[best])) if g in names[k]]
        whole = names[max(wider, key=lambda k: (len(names[k]), sizes[k], names[k]))]
        found.append(whole)
        covered[flat[starts[best] : starts[best + 1]]] += 1
        live &= gain >= least
        live[best] = False
        for k in np.flatnonzero(live):
            if names[k] in whole:
                live[k] = False
    return found


def train(v: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([v, np.ones((len(v), 1))])
    s = np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = s * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(reg + 2 * cost * a.T @ a, 2 * cost * a.T @ s[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, with a knot at both ends of a pool: most margins of clean texts are in one pool of zeros."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, last, total, weight = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + total, pools[-1][3] + weight]
    return np.array([e for p in pools for e in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in range(2)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, max_labelled: int = 16_000, landmarks: int = LANDMARKS, pool: int = POOL) -> dict:
    own = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    rows = staged(labelled_rows(docs, labels, label, parts, part, max_labelled).select("doc_id", "text", "label", own.alias("own")), "labelled-texts")
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    strings = choose_landmarks(rows.where("not own"), most=landmarks, pool=pool) if 0 < share < 1 else []
    if not strings:
        return {"constant": float(share)}

    def values(batches):
        for b, v in bags(batches, Landmarks(strings)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(v), pa.list_(pa.float64()))], ["doc_id", "label", "own", "v"])

    seen = rows.mapInArrow(values, "doc_id long, label int, own boolean, v array<double>")
    seen = sorted(seen.collect(), key=lambda r: (r["doc_id"], r["label"], r["v"]))  # one row per label, of about max_labelled
    v, y, held = np.array([r["v"] for r in seen]), np.array([r["label"] for r in seen]), np.array([r["own"] for r in seen])
    white = Landmarks(strings).white
    w = train(v[~held] @ white, y[~held])
    margin = np.round(np.hstack([v[held] @ white, np.ones((held.sum(), 1))]) @ w, 2)
    x, at = np.unique(margin, return_inverse=True)
    n = np.bincount(at, minlength=len(x))
    kx, ky = isotonic(x, np.bincount(at, y[held], len(x)) / n, n) if len(x) else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    return {"strings": strings, "w": w, "kx": kx, "ky": ky}


def scores_of(model: dict, v: np.ndarray, white: np.ndarray) -> np.ndarray:
    margin = np.hstack([v @ white, np.ones((len(v), 1))]) @ model["w"]
    return np.clip(0.999 * np.interp(margin, model["kx"], model["ky"]) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, parts: int = 4, part: int = 2, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, parts, part, **options))

    def scored(batches):
        m = model.value
        if "constant" in m:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, m["constant"]))], ["doc_id", "score"])
            return
        landmarks = Landmarks(m["strings"])
        for b, v in bags(batches, landmarks):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores_of(m, v, landmarks.white))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
