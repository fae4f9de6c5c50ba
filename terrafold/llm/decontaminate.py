"""Benchmark decontamination by one Aho-Corasick automaton (op5).

Benchmark texts (questions and answers) are normalised to words; each window of `window` consecutive words is a pattern.
Words of the benchmark are numbered and a text becomes a string of those numbers, so that one automaton over numbers
finds every occurrence of every window in one scan; word positions map back to offsets of the original text.  A number
is one character, or two where the words are more than characters.

The patterns are broadcast in blocks of items of at most `block_chars` characters of text, counted before anything is
collected; a larger benchmark is scanned block by block, and hits and items of the blocks are united per document.

Defined results: null or empty text has no words and no hits; an item without words has no window; an item of fewer
words than a window is one window; rows that repeat an item_id are windows of one item; windows of items with a null
item_id count as hits and add nothing to items; rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches, with_rows

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "n_words long, hits binary, items array<string>"
RESULT = "n_words long, n_hit long, items array<string>, spans string, contaminated boolean"
_FOUND = [pa.int64(), pa.binary(), pa.list_(pa.string())]
_RESULT = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
ONE_CHARACTER = 0x100000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Windows:
    """Patterns of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = [(item, words_of(text)) for item, text in items]
        places: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                places.setdefault(w, len(places))
        self.width = 1 if len(places) <= ONE_CHARACTER else 2
        self.numbers = {w: self._number(k) for w, k in places.items()}
        owners: dict[str, set[str]] = {}
        for item, words in texts:
            code = "".join([self.numbers[w] for w in words])
            for k in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(code[self.width * k : self.width * (k + window)], set()).update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton()
        for pattern, of in owners.items():
            self.automaton.add_word(pattern, (len(pattern) // self.width, tuple(of)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()
        self.shortest = min(map(len, owners), default=0) // self.width

    def _number(self, k: int) -> str:
        """Numbers of two characters take them from two ranges, so that a pattern can only be found where a word begins."""
        return chr(0x10000 + k) if self.width == 1 else chr(0x10000 + (k >> 16)) + chr(0x20000 + (k & 0xFFFF))

    def find(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Marks of hit words (None: no hit), and the items with an occurring window."""
        if not self.any or len(words) < self.shortest:
            return None, set()
        get, unknown, width = self.numbers.get, " " * self.width, self.width
        code = "".join([get(w, unknown) for w in words])
        marks, items = None, set()
        for end, (n, of) in self.automaton.iter(code):
            if marks is None:
                marks = np.zeros(len(words), np.uint8)
            marks[end // width - n + 1 : end // width + 1] = 1
            items.update(of)
        return marks, items


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def spans_of(text: str, hits: bytes) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text, end exclusive."""
    where = [m.span() for m in _WORD.finditer(text)]
    marks = np.concatenate([[0], np.frombuffer(hits, np.uint8), [0]]).astype(np.int8)
    edges = np.diff(marks)
    return [(where[a][0], where[b - 1][1]) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


def _scan(rows: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """rows (doc_id, text and more) with the columns of RESULT: one pass per block of the benchmark, nothing is shuffled."""
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    blocks = _blocks(benchmark, block_chars)
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])  # at most about block_chars characters

        def step(batches, sent=sent, first=k == 0, last=k == len(blocks) - 1):
            windows = Windows(sent.value, window)
            for b in batches:
                had = zip(*(b.column(c).to_pylist() for c in ("hits", "items")), strict=True) if not first else ((b"", []) for _ in range(b.num_rows))
                out = []
                for text, (old, old_items) in zip(b.column("text").to_pylist(), had, strict=True):
                    words = words_of(text)
                    marks, found = windows.find(words)
                    if marks is not None and old:
                        marks |= np.frombuffer(old, np.uint8)
                    hits = old if marks is None else marks.tobytes()
                    items = sorted({*old_items, *found}) if found else old_items
                    if last:
                        out.append((len(words), sum(hits), items, ",".join(f"{a}:{z}" for a, z in spans_of(text, hits)) if hits else "", bool(hits)))
                    else:
                        out.append((len(words), hits, items))
                types, names = (_RESULT, RESULT) if last else (_FOUND, FOUND)
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *columns], [*own, *[x.split()[0] for x in names.split(", ")]])

        rows = rows.mapInArrow(step, f"{fields}, {RESULT if k == len(blocks) - 1 else FOUND}")
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted as strings), spans, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _scan(rows, benchmark, window, block_chars).drop("text")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8_000_000, result: str = "benchmark") -> DataFrame:
    """Whole rows of docs, each with its own result in a struct. Nothing is joined by id."""
    found = _scan(with_rows(docs), benchmark, window, block_chars)
    return found.select(*rows_of(docs), F.struct("n_words", "n_hit", "items", "spans", "contaminated").alias(result))


def items_digest(items):
    return F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256)
