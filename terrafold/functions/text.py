"""Names and labels (STR-01..18). Built-in functions but for the token-set ratio, which is an Arrow-batched UDF."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    """STR-01."""
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), r"\s+", " "))


def slug(name: Column, sep: str = "-") -> Column:
    """STR-02."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", sep), F.lit(sep))


#: Rank synonyms.
RANKS = {"SP": "SPECIES", "SSP": "SUBSPECIES", "SUBSP": "SUBSPECIES", "VAR": "VARIETY", "F": "FORM", "FORMA": "FORM", "GEN": "GENUS", "FAM": "FAMILY", "ORD": "ORDER", "CL": "CLASS", "PHYL": "PHYLUM", "DIVISION": "PHYLUM", "REG": "KINGDOM"}


def canonical_rank(rank: Column) -> Column:
    """STR-03."""
    up = F.upper(F.trim(rank))
    out = F.when(up.isNull(), F.lit(None))
    for short, full in RANKS.items():
        out = out.when(up.isin(short, short + "."), full)
    return out.otherwise(up)


def scientific_name(name: Column, rank: Column) -> Column:
    """STR-04: two words for a species (three with a hybrid mark), four with an infraspecific mark, else three."""
    words = F.split(F.trim(name), r"\s+")
    hybrid = F.exists(words, lambda w: w.isin("x", "×"))
    marked = F.exists(words, lambda w: w.isin("subsp.", "ssp.", "var.", "f."))
    n = F.when(rank == "SPECIES", F.when(hybrid, 3).otherwise(2)).when(rank.isin("SUBSPECIES", "VARIETY", "FORM"), F.when(marked, 4).otherwise(3)).otherwise(F.size(words))
    return F.array_join(F.slice(words, F.lit(1), n), "_")


def adjusted_score(ratio: Column, name: Column, query: Column) -> Column:
    """STR-06: null unless each query word begins a name word and the score reaches 70 (one word) or 60."""
    q, n = F.split(query, " "), F.split(name, " ")
    begins = F.forall(q, lambda t: F.exists(n, lambda x: F.startswith(x, t)))
    score = ratio + F.when(name == query, 20).otherwise(0) - 2 * F.greatest(F.lit(0), F.size(n) - F.size(q))
    return F.when(begins & (score >= F.when(F.size(q) > 1, 60).otherwise(70)), score)


def label(code: Column) -> Column:
    """STR-11."""
    return F.initcap(F.trim(F.regexp_replace(code, "(::|_)+", " ")))


def temporal_parts(variable: Column) -> tuple[Column, Column, Column]:
    """STR-12: base, aggregate and hours of an id such as rain_sum_24h; null where it is not one."""
    pattern = r"^(.+?)_(avg|sum)_(\d+)h$"
    fits = variable.rlike(pattern)
    return tuple(F.when(fits, F.regexp_extract(variable, pattern, k)) for k in (1, 2, 3))


def obscured_state(text: Column) -> Column:
    """STR-13."""
    return F.when(text.isNull(), "No").when(F.element_at(F.split(F.trim(text), r"\s+"), -1) == "taxon", "Hidden").otherwise("Obscured")


#: Licences from the freest on; the position is the score.
LICENCES = ("cc0", "publicdomain", "by/4.0", "by-sa", "by-nc/4.0", "by-nc-sa", "by-nd", "by-nc-nd")


def licence_score(text: Column) -> Column:
    """STR-14."""
    low, out = F.lower(text), F.when(text.isNull(), F.lit(99))
    for k, part in enumerate(LICENCES):
        out = out.when(F.contains(low, F.lit(part)), F.lit(k))
    return out.otherwise(F.lit(99))


def observation_number(text: Column) -> Column:
    """STR-15: digits, digits with .0, or the only run of digits."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(text.rlike(r"^\d+(\.0+)?$"), F.regexp_extract(text, r"^(\d+)", 1)).when(F.size(runs) == 1, F.element_at(runs, 1)).cast("long")


def class_number(text: Column) -> Column:
    """STR-18."""
    return F.regexp_extract(text, "^(?:class_)?([0-9]+)$", 1).try_cast("int")


def climate_code(text: Column) -> Column:
    """STR-18."""
    return F.when(text.rlike(r"\(([A-Z][A-Za-z]{1,2})\)"), F.regexp_extract(text, r"\(([A-Z][A-Za-z]{1,2})\)", 1))


#: What marks a lexicon as that of the United States.
US_MARKS = ("american", "united states", "u.s.", "usa")


def common_name_score(language: Column, lexicon: Column, source: Column, first_party: str = "own") -> Column:
    """STR-07: 100 for English, 50 for an English lexicon, 10 for one of the United States, 25 for the first party's names."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    low, own = tidy(lexicon), lambda test, points: F.when(test, points).otherwise(0)
    us = F.lit(False)
    for mark in US_MARKS:
        us = us | F.contains(low, F.lit(mark))
    return own(tidy(language) == "en", 100) + own(F.contains(low, F.lit("english")), 50) + own(us, 10) + own(tidy(source) == first_party, 25)


def of_language(language: Column, lexicon: Column, target: str) -> Column:
    """STR-07: names of a language; an English lexicon counts as English; without a target all names."""
    if not target.strip():
        return F.lit(True)
    low = target.strip().lower()
    same = F.lower(F.trim(F.coalesce(language, F.lit("")))) == low
    return same | F.contains(F.lower(F.coalesce(lexicon, F.lit(""))), F.lit("english")) if low == "en" else same


def cased(name: Column) -> Column:
    """STR-08: each word capitalised, short all-capital words kept, the letter after an apostrophe low."""
    words = F.split(name, " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) <= 4) & (w == F.upper(w)) & w.rlike("[A-Z]"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


@cache
def _bases() -> tuple[str, str]:
    """All letters whose canonical decomposition is one letter and marks, and those letters (Hangul has none)."""
    pairs = []
    for k in range(0xC0, sys.maxunicode):
        c = chr(k)
        plain = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(plain) == 1 and plain[0] != c:
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """STR-09: canonical decomposition without combining marks, low letters, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.translate(text, *_bases()), r"\p{Mn}+", "")))


def _indel(a: str, b: str) -> float:
    """Normalised similarity 0..100 by insertions and deletions (longest common subsequence, one machine word per step)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    common = len(a) - s.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio_of(a: str, b: str) -> float:
    """STR-05 by its published definition."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max([_indel(one, two), *([_indel(both, one), _indel(both, two)] if both else [])])


def token_set_ratio(name: Column, query: Column) -> Column:
    """STR-05, CTL-05. Filter by word beginnings first: that test is selective and stays in the JVM."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio_of(p, q) if p is not None and q is not None else None for p, q in zip(a, b, strict=True)], dtype="float64")

    return ratio(name, query)


def event_time(date: Column, time: Column) -> Column:
    """DAT-01: epoch seconds of a date part and a time; null if missing or wrong."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring_index(date, "T", 1), F.lit("T"), time)))


def parsed_time(text: Column) -> Column:
    """DAT-02/03: epoch seconds from seconds, milliseconds or nanoseconds as a number, or from ISO text."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e17, number / 1e9).when(number > 1e11, number / 1e3).otherwise(number)
    return F.coalesce(seconds, F.unix_timestamp(F.try_to_timestamp(text)).cast("double"))
