"""Exact duplicates by counting quotient filters (op10).

Each partition fingerprints its normalised texts and packs them as a counting quotient filter: quotient ranges
(`block`, as many as the rows need for `BLOCK_ROWS` each), and in each the sorted remainders with their counts.  Filters
of a block merge losslessly, counts included, because runs of sorted remainders do.  Fingerprints counted more than
once route their rows to verification: a SHA-256 makes candidate groups, and only their texts are read again and
compared byte for byte with the one that stays.  Hot groups are dealt over tasks in every join.

Defined results: null text counts as empty; all texts without other characters than white space are one group; rows
that repeat a doc_id are separate rows, and of rows that repeat the kept row's id and length too, one is kept; a null
doc_id sorts last; an empty table gives an empty result; other columns are ignored but for those named in `carry`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, small_batches, spread, staged

BLOCK_ROWS = 1 << 20
BROADCAST_IDS = 1_000_000
WHITE = b" \t\n\x0b\x0c\r"
_DIGEST = pa.schema([("fp", pa.int64()), ("n_points", pa.int64()), ("sha", pa.binary())])
_FILTER = pa.schema([("block", pa.int64()), ("run", pa.binary())])
_FOUND = pa.schema([("fp", pa.int64()), ("n", pa.int64())])


def _digests(batches):
    for b in batches:
        fps, points, shas = [], [], []
        for t in b.column(1).to_pylist():
            t = t or ""
            n = t.encode("utf-8", "surrogatepass").translate(None, WHITE)
            fps.append(int.from_bytes(xxhash.xxh3_64_digest(n), "big", signed=True))
            points.append(len(t))
            shas.append(hashlib.sha256(n).digest())
        found = [pa.array(x, f.type) for x, f in zip((fps, points, shas), _DIGEST, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *found, *b.columns[2:]], ["doc_id", *_DIGEST.names, *b.schema.names[2:]])


def block_bits(rows: int) -> int:
    """Bits of the quotient that number the blocks, so that a block has about BLOCK_ROWS rows."""
    return max(6, (max(rows, 1) // BLOCK_ROWS).bit_length())


def run_of(rest: np.ndarray, counts: np.ndarray) -> bytes:
    """How many remainders, the sorted remainders, then place and count of those that are there more than once."""
    many = np.flatnonzero(counts > 1)
    return b"".join((np.uint64(len(rest)).tobytes(), rest.tobytes(), many.astype(np.uint32).tobytes(), counts[many].astype(np.uint64).tobytes()))


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(run, np.uint64, 1)[0])
    many = (len(run) - 8 - 8 * n) // 12
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(run, np.uint32, many, 8 + 8 * n)] = np.frombuffer(run, np.uint64, many, 8 + 8 * n + 4 * many)
    return np.frombuffer(run, np.uint64, n, 8), counts


def pack(fps: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """The filter of one partition: (block, run of the other 64 - bits bits and their counts)."""
    values, counts = np.unique(fps.view(np.uint64), return_counts=True)
    blocks = (values >> np.uint64(64 - bits)).astype(np.int64)
    ends = np.flatnonzero(np.diff(blocks)) + 1
    rest = values & np.uint64((1 << (64 - bits)) - 1)
    return [(int(blocks[a]), run_of(rest[a:b], counts[a:b])) for a, b in zip([0, *ends], [*ends, len(values)], strict=True) if b > a]


def merge(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one; counts of equal remainders are added."""
    values = np.concatenate([a[0], b[0]])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def _filters(bits: int):
    def runs(held):
        found = pack(np.concatenate(held), bits)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], schema=_FILTER)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= 1 << 21:
                yield runs(held)
                held, n = [], 0
        if n:
            yield runs(held)

    return run


def _repeated(bits: int):
    """Rows come sorted by block: one block's filter is held at a time."""

    def run(batches):
        now, levels = None, []

        def flush():
            values, counts = levels[0]
            for other in levels[1:]:
                values, counts = merge((values, counts), other)
            fps = values[counts > 1] | (np.uint64(now) << np.uint64(64 - bits))
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(counts[counts > 1])], schema=_FOUND)

        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield flush()
                    now, levels = block, []
                levels.append(unpack(packed))
                while len(levels) > 1 and len(levels[-2][0]) <= 2 * len(levels[-1][0]):
                    levels[-2:] = [merge(levels[-2], levels[-1])]
        if now is not None:
            yield flush()

    return run


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """Of a column fp, the values that occur more than once (fp) and how often (n)."""
    bits = block_bits(rows)
    runs = fps.select("fp").mapInArrow(_filters(bits), "block long, run binary")
    return runs.repartition("block").sortWithinPartitions("block").mapInArrow(_repeated(bits), "fp long, n long")


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the columns of docs named in carry."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    held = f"_carry {named.schema['_carry'].dataType.simpleString()}"
    marks = named.mapInArrow(_digests, f"doc_id long, fp long, n_points long, sha binary, {held}")
    marks = staged(marks.withColumn("row", F.monotonically_increasing_id()), "digests")
    twice = staged(repeated_fingerprints(marks, marks.count()), "repeated")
    several = staged(spread(marks, twice.select("fp"), ["fp"], ["row"], twice, "left_semi"), "repeated-rows")
    alone = spread(marks, twice.select("fp"), ["fp"], ["row"], twice, "left_anti").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    # Equal fingerprint and SHA-256 make a candidate group, of which the longest original, then the smallest id, stays;
    # of rows equal in both, the first as staged.
    first = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    best = several.groupBy("fp", "sha").agg(F.count("*").alias("group_size"), first.alias("first"))
    best = staged(best.select("fp", "sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), (-F.col("first.points")).alias("most")), "groups")
    sizes = best.withColumn("n", F.col("group_size"))
    out = spread(several, best.drop("most"), ["fp", "sha"], ["row"], sizes).withColumn("kept", F.col("row") == F.col("keep_row"))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *[F.col(f"_carry.{c}").alias(c) for c in carry]]
    wrong = unequal_bytes(rows, several, sizes.where("group_size > 1"))
    if wrong.isEmpty():
        return alone.select(*columns).unionByName(out.select(*columns))
    return by_whole_text(docs.select("doc_id", "text", *carry), carry)  # two texts with one SHA-256: group by the bytes themselves


def unequal_bytes(rows: DataFrame, several: DataFrame, best: DataFrame) -> DataFrame:
    """Members of candidate groups whose normalised text is not byte for byte that of the row their group keeps.

    Only rows whose id is that of a row with a repeated fingerprint are hashed again.
    """
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = staged(several.select(known.alias("_id")).distinct(), "repeated-ids")
    some = rows.withColumn("_id", known).join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "_id", "left_semi")
    norm = _normal(F.coalesce(F.col("text"), F.lit("")))
    shown = some.select("doc_id", norm.alias("norm"), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_points"))
    shown = shown.withColumn("sha", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)))
    shown = spread(shown, best.select("sha", "keep_id", "most"), ["sha"], ["doc_id", "n_points"], best)
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))
    shown = staged(shown.select("sha", "norm", keeper.alias("is_keeper"), F.monotonically_increasing_id().alias("at")), "repeated-texts")
    kept = staged(shown.where("is_keeper").select("sha", F.col("norm").alias("kept_norm")).dropDuplicates(["sha"]), "kept-texts")
    return spread(shown.select("sha", "norm", "at"), kept, ["sha"], ["at"], best).where("norm != kept_norm").select("sha")


def _normal(col):
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def by_whole_text(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The same result with the normalised text itself as the key."""
    t = rows.select(F.col("doc_id").cast("long").alias("doc_id"), _normal(F.coalesce("text", F.lit(""))).alias("_norm"), F.length(F.coalesce("text", F.lit(""))).alias("_points"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    order = Window.partitionBy("_norm").orderBy(F.desc("_points"), F.asc_nulls_last("doc_id"))
    t = t.withColumns({"_k": F.row_number().over(order), "keep_id": F.first("doc_id").over(order), "group_size": F.count("*").over(Window.partitionBy("_norm"))})
    return t.select("doc_id", "keep_id", "group_size", (F.col("_k") == 1).alias("kept"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), *[F.col(f"_carry.{c}").alias(c) for c in carry])
