"""Jaccard join of word n-gram sets by rare-first prefix filtering (op3).

1. One pass hashes each text's n-grams.  Equal sets form a class, of which one document goes on.  The same pass adds up
   how many documents have an n-gram, in a count-min sketch over all documents, whose size is fixed.
2. N-grams of a set are ordered rarest first by that sketch, ties by hash; any fixed order is right, and this one keeps
   common passages out of prefixes.  Sets of n n-grams that reach the threshold share one of the first
   n - ceil(threshold * n) + 1.
3. Documents that share a prefix n-gram are compared: lengths, then the positional bound, then the suffix filter (a lower
   bound of the difference of two sets from their counts in 64 hash ranges), then the texts, once per pair.

`near_duplicates` needs components, not all pairs of a group.  So first each document of a prefix n-gram is compared with
the smallest id that has it; these links join most of a group.  Then, for n-grams whose documents are still in more than
one component, documents outside the n-gram's largest component are compared with all others of another component.  Pairs
that are left out are in one component already, so no component differs from that of all pairs.

An n-gram or document with more rows than an average task is dealt over tasks in every join.  Texts are compared by the
64-bit hashes of their n-grams: two different n-grams count as one with a probability of about 1 in 10^19 per pair.

Defined results: a text with fewer words than an n-gram has its whole word sequence as its one element; without words, or
null, the set is empty and linked with nothing; rows that repeat a doc_id are one node and get one component; a null
doc_id is linked with nothing and gets a null component.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, small_batches, spread, staged
from .components import components

SKETCH_BITS = 18
PART_BITS = 14
BINS = 64
BROADCAST_IDS = 1_000_000
BROADCAST_CLASSES = 500_000
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_PASS = "doc_id long, n int, sig binary, bins array<tinyint>, part int, counts binary"
_PASS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("bins", pa.list_(pa.int8())), ("part", pa.int32()), ("counts", pa.binary())])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = self[word] = int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)
        return h


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams; words are split at ASCII white space, A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"short " + b" ".join(found))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)).view(np.uint64)
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = (total + h[k : k + n]) * _MULTIPLY[k % 4] ^ (total >> np.uint64(29))
    total ^= total >> np.uint64(32)
    total *= _MULTIPLY[0]
    total ^= total >> np.uint64(29)
    return np.unique(total)


def _first_pass(words: int):
    def run(batches):
        hashes, counts, held, n = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for b in batches:
            rows = [[], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, words, hashes)
                rows[0].append(i)
                rows[1].append(len(s))
                rows[2].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows[3].append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS).clip(max=127).astype(np.int8))
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                n += len(s)
            if n > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n = [], 0
            empty = pa.nulls(len(rows[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _PASS_ARROW, strict=False)] + [empty.cast(pa.int32()), empty.cast(pa.binary())], schema=_PASS_ARROW)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        if counts.any():
            parts = counts.astype(np.uint32).reshape(-1, 1 << PART_BITS)
            empty = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([*[empty.cast(f.type) for f in list(_PASS_ARROW)[:4]], pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], schema=_PASS_ARROW)

    return run


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
            sums[k] = sums[k] + v if k in sums else v
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], ["part", "counts"])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Join:
    """The staged tables of one join: rows (doc_id, n, sig), info (doc, n, bins of representatives), postings."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        spark = docs.sparkSession
        small_batches(spark)
        self.words, self.percent = words, percent
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
        first = staged(self.texts.mapInArrow(_first_pass(words), _PASS), "shingles")
        self.rows = first.where("part is null").select("doc_id", "n", "sig")
        sums = first.where("part is not null").select("part", "counts").repartition(1 << (SKETCH_BITS - PART_BITS), "part").mapInArrow(_added, "part int, counts binary")
        sketch = np.zeros((1 << (SKETCH_BITS - PART_BITS), 1 << PART_BITS), np.int64)
        for r in sums.collect():  # 2 MB, whatever the input
            sketch[r["part"]] = np.frombuffer(r["counts"], np.int64)
        sent = spark.sparkContext.broadcast(sketch.ravel())
        known = self.rows.where("n > 0 and doc_id is not null")
        self.classes = staged(known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        self.several = staged(self.classes.where("copies > 1"), "classes-of-several")
        self.n_several = self.several.count()
        several = bounded_broadcast(self.several, self.n_several, BROADCAST_CLASSES)
        copies = staged(known.join(several, "sig").where("doc_id != rep").select(F.col("doc_id").alias("c_doc"), F.col("sig").alias("c_sig")).distinct(), "copies")
        self.copies = copies = bounded_broadcast(copies, copies.count(), BROADCAST_IDS)
        other = (F.col("doc") == F.col("c_doc")) & (F.col("sig") == F.col("c_sig"))
        info = first.where("part is null and n > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "n", "sig", "bins")
        self.info = info.join(copies, other, "left_anti").select("doc", "n", "bins").distinct()

        def prefixes(batches):
            hashes, counts = WordHashes(), sent.value
            for b in batches:
                out = [[], [], [], []]
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = shingles(t, words, hashes)
                    if not len(s) or i is None:
                        continue
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    out[0].append(i)
                    out[1].append(len(s))
                    out[2].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    out[3].append(s[order[: prefix_length(len(s), percent)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], ["doc", "n", "sig", "prefix"])

        firsts = self.texts.mapInArrow(prefixes, "doc long, n int, sig binary, prefix array<long>").join(copies, other, "left_anti")
        postings = staged(firsts.select("doc", "n", F.posexplode("prefix").alias("pos", "gram")), "postings")
        shared = staged(postings.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc").alias("leader")).where("n > 1"), "shared-grams")
        self.postings = staged(spread(postings, shared.select("gram", "leader"), ["gram"], ["doc"], shared), "shared-postings")

    def near_lengths(self, m, n):
        return F.least(m, n) * 100 >= F.greatest(m, n) * self.percent

    def needed(self, m, n):
        """The least intersection of two linked sets of these sizes."""
        return F.ceil((m + n) * F.lit(self.percent) / F.lit(100 + self.percent) - F.lit(1e-9))

    def near_counts(self):
        """The suffix filter: counts x and y of two sets in the same hash ranges, cut at 127, bound their difference from below."""
        apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, d: s + d)
        return apart <= F.col("m") + F.col("n") - 2 * self.needed(F.col("m"), F.col("n"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct staged pairs a, b, those that are linked."""
        a = self.info.select(F.col("doc").alias("a"), F.col("n").alias("m"), F.col("bins").alias("x"))
        b = self.info.select(F.col("doc").alias("b"), F.col("n").alias("n"), F.col("bins").alias("y"))
        near = spread(spread(pairs, a, ["a"], ["b"]), b, ["b"], ["a"], pairs.groupBy("b").agg(F.count("*").alias("n"))).where(self.near_lengths(F.col("m"), F.col("n")) & self.near_counts())
        near = staged(near.select("a", "b"), "candidates")
        ids = staged(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "candidate-ids")
        texts = staged(self.texts.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "doc", "left_semi"), "candidate-texts")
        words, percent = self.words, self.percent

        def check(batches):
            hashes, last, held = WordHashes(), None, None
            for b in batches:
                good = []
                for k, (i, t, u) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    if last is None or last[0] != i or last[1] != u:
                        last, held = (i, u), shingles(u, words, hashes)
                    s = shingles(t, words, hashes)
                    both = len(np.intersect1d(s, held, assume_unique=True))
                    if both and 100 * both >= percent * (len(s) + len(held) - both):
                        good.append(k)
                part = b.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

        wide = spread(near, texts.select(F.col("doc").alias("a"), F.col("text").alias("s")), ["a"], ["b"])
        wide = spread(wide, texts.select(F.col("doc").alias("b"), F.col("text").alias("t")), ["b"], ["a"], near.groupBy("b").agg(F.count("*").alias("n")))
        return staged(wide.select("a", "b", "s", "t").mapInArrow(check, "a long, b long").distinct(), "links")

    def links(self) -> DataFrame:
        """Every link between representatives of classes of equal sets: a < b."""
        p = self.postings
        one = p.select("gram", F.col("doc").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"))
        two = p.select("gram", F.col("doc").alias("b"), F.col("n").alias("n"), F.col("pos").alias("j"))
        pairs = spread(two, one, ["gram"], ["b"]).where("a < b").where(self.possible()).select("a", "b").distinct()
        return self.verified(staged(pairs, "link-pairs"))

    def possible(self):
        m, n, i, j = (F.col(c) for c in "mnij")
        return self.near_lengths(m, n) & (F.least(m - i, n - j) >= self.needed(m, n))

    def component_links(self) -> DataFrame:
        """Links that have the components of all links."""
        first = staged(self.postings.where("doc != leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), "leader-pairs")
        links = self.verified(first)
        found = staged(components(links), "components")
        where = self.postings.join(found, F.col("doc") == F.col("node"), "left").select("gram", "doc", "n", "pos", F.coalesce("component", "doc").alias("component"))
        where = staged(where, "placed-postings")
        mixed = where.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("gram")
        open_ = staged(where.join(mixed, "gram", "left_semi"), "open-postings")
        sizes = open_.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("n"))
        sizes = staged(sizes.select("gram", F.col("x.component").alias("largest"), "n"), "open-grams")
        named = staged(spread(open_, sizes.select("gram", "largest"), ["gram"], ["doc"], sizes).join(self.info, ["doc", "n"]), "named-postings")
        one = named.where("component != largest").select("gram", F.col("doc").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"), F.col("component").alias("ca"), F.col("bins").alias("x"))
        two = named.select("gram", F.col("doc").alias("b"), F.col("n").alias("n"), F.col("pos").alias("j"), F.col("component").alias("cb"), "largest", F.col("bins").alias("y"))
        rest = spread(two, one, ["gram"], ["b"], sizes).where(F.expr("ca != cb and (cb = largest or b < a)") & self.possible() & self.near_counts())
        done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        return links.unionByName(self.verified(staged(rest, "open-pairs")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    join = Join(docs, words, percent)
    # A document with a copied text and another one links the class of the copy with what the other text reaches.
    again = join.rows.join(join.copies, (F.col("doc_id") == F.col("c_doc")) & (F.col("sig") != F.col("c_sig"))).select("c_doc", "c_sig").distinct()
    again = again.join(join.several, F.col("c_sig") == F.col("sig")).select(F.col("c_doc").alias("a"), F.col("rep").alias("b"))
    found = staged(components(join.component_links().unionByName(again)), "components")
    several = join.several.join(found, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("of_class"))
    known = join.rows.where("n > 0 and doc_id is not null").join(bounded_broadcast(several, join.n_several, BROADCAST_CLASSES), "sig", "left")
    # Only representatives and documents without a copy have components of their own.
    single = known.where("of_class is null").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    copies = known.where("of_class is not null").select("doc_id", "n", F.col("of_class").alias("component_id"))
    rows = single.unionByName(copies).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = join.rows.where("n = 0 or doc_id is null").join(found, F.col("doc_id") == F.col("node"), "left")
    alone = alone.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return rows.unionByName(alone)
