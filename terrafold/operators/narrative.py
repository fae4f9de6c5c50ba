"""Rule-based sentences over aggregates (DSC-01..08): bands are steps over columns, texts are column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import stepped

SAME = ""
#: From which difference a word holds. Temperature in degrees, rain as a share of the whole (or mm if that
#: is 0), snow water in mm, soil parts in percent.
TEMPERATURE = [(0.5, "slightly"), (1.5, "a bit"), (3.0, "noticeably"), (5.0, "much")]
RAIN = [(0.10, "slightly"), (0.25, "a bit"), (0.50, "noticeably"), (0.80, "much")]
RAIN_FROM_NONE = [(25.0, "a bit"), (100.0, "noticeably"), (200.0, "much")]
SNOW = [(5.0, "slightly"), (20.0, "a bit"), (60.0, "noticeably"), (150.0, "much")]
SOIL = [(2.0, "slightly"), (5.0, "a bit"), (10.0, "noticeably"), (20.0, "much")]
#: How far a class's share must move, and the words for it.
SHIFT = [(0.1, 1), (0.2, 2), (0.3, 3)]
SHIFT_WORDS = {1: "a bit ", 2: "", 3: "much "}
SOIL_WORDS = {"sand": ("sandier", "less sandy"), "silt": ("siltier", "less silty"), "clay": ("more clay-rich", "less clay-rich")}


def _compared(delta: Column, degree: Column, more: Column, less: Column, place: Column) -> Column:
    there = F.concat(F.lit(" in "), place)
    return F.when(degree == SAME, F.concat(F.lit("about the same"), there)).otherwise(F.concat(degree, F.lit(" "), F.when(delta > 0, more).otherwise(less), there))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def temperature_here(here: Column, everywhere: Column, place: Column) -> Column:
    """DSC-07: null unless both means are finite."""
    d = _finite(here) - _finite(everywhere)
    return _compared(d, stepped(F.abs(d), TEMPERATURE, SAME), F.lit("warmer"), F.lit("cooler"), place)


def rain_here(here: Column, everywhere: Column, place: Column) -> Column:
    """DSC-07: relative to the mean everywhere; absolute where that is not above 0."""
    a, b = _finite(here), _finite(everywhere)
    d = a - b
    degree = F.when(b <= 0, stepped(F.abs(d), RAIN_FROM_NONE, SAME)).otherwise(stepped(F.abs(d) / b, RAIN, SAME))
    return _compared(d, degree, F.lit("wetter"), F.lit("drier"), place)


def snow_here(here: Column, everywhere: Column, place: Column) -> Column:
    """DSC-07."""
    d = _finite(here) - _finite(everywhere)
    return _compared(d, stepped(F.abs(d), SNOW, SAME), F.lit("snowier"), F.lit("less snowy"), place)


def soil_here(part: Column, here: Column, everywhere: Column, place: Column) -> Column:
    """DSC-07: null for a difference under 2 percent."""
    d = _finite(here) - _finite(everywhere)
    more, less = F.concat(F.lit("more "), part), F.concat(F.lit("less "), part)
    for name, (m, k) in SOIL_WORDS.items():
        more, less = F.when(part == name, m).otherwise(more), F.when(part == name, k).otherwise(less)
    return F.when(F.abs(d) >= SOIL[0][0], _compared(d, stepped(F.abs(d), SOIL, SAME), more, less, place))


def share_shift(everywhere: DataFrame, here: DataFrame, key: str, place: Column, top: int = 2) -> DataFrame:
    """DSC-06: of a taxon's leading classes (two, the report's own limit), those whose share in a place differs most.

    Both tables: key, class_name, share.  Classes of the strongest level and of its direction are named together.  Taxa without rows
    in the place get no sentence.
    """
    known = everywhere.join(here.select(key).distinct(), key, "left_semi")
    lead = known.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), "class_name"))).where(F.col("_r") <= top)
    d = lead.join(here.select(key, "class_name", F.col("share").alias("_h")), [key, "class_name"], "left")
    d = d.withColumn("_d", F.round(F.coalesce("_h", F.lit(0.0)) - F.col("share"), 9)).withColumn("_l", stepped(F.abs("_d"), SHIFT, 0)).where("_l > 0")
    best = d.groupBy(key).agg(F.max(F.struct(F.col("_l"), F.abs("_d").alias("m"), (-F.col("_r")).alias("r"), F.signum("_d").alias("s"))).alias("_b"))
    kept = d.join(best, key).where("_l = _b._l and signum(_d) = _b.s")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "class_name"))), lambda x: x["class_name"]), " and ")
    got = kept.groupBy(key).agg(names.alias("names"), F.first("_b").alias("_b"))
    words = F.create_map(*[x for k, v in SHIFT_WORDS.items() for x in (F.lit(k), F.lit(v))])
    text = F.concat(words[F.col("_b._l")], F.when(F.col("_b.s") > 0, "more").otherwise("less"), F.lit(" common in "), F.col("names"), F.lit(" when in "), place)
    return got.select(key, F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2))).alias("text"))


def parallel_label(a: Column, b: Column) -> Column:
    """DSC-03: two labels of as many words as one: with a common first and last word (three words or more) the middles are
    joined, with a common last word what comes before it; else the labels themselves.  A blank or `none` label gives the other."""
    clean = lambda c: F.when(F.lower(F.trim(c)).isin("none", "null", "nan"), "").otherwise(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "(?i)^none ", ""))
    one, two = clean(a), clean(b)
    x, y = F.split(one, r"\s+"), F.split(two, r"\s+")
    n = F.size(x)
    alike, last = n == F.size(y), F.element_at(x, -1) == F.element_at(y, -1)
    words = lambda w, start, count: F.array_join(F.slice(w, start, count), " ")
    middles = F.concat(x[0], F.lit(" "), words(x, F.lit(2), n - 2), F.lit(" and "), words(y, F.lit(2), n - 2), F.lit(" "), F.element_at(x, -1))
    fronts = F.concat(words(x, F.lit(1), n - 1), F.lit(" and "), words(y, F.lit(1), n - 1), F.lit(" "), F.element_at(x, -1))
    return F.when(one == "", two).when(two == "", one).when((n >= 3) & alike & last & (x[0] == y[0]), middles).when((n >= 2) & alike & last, fronts).otherwise(F.concat(one, F.lit(" and "), two))


def range_row(name: str, low: Column, high: Column, unit: str) -> Column:
    """DSC-05: `name: low to high unit`, one number where both round to the same."""
    a, b = F.round(low).cast("long"), F.round(high).cast("long")
    span = F.when(a == b, a.cast("string")).otherwise(F.concat(a, F.lit(" to "), b))
    return F.concat(F.lit(f"{name}: "), span, F.lit(f" {unit}"))


#: The scales of words. `STEPS` hold from their number on, `OVER` only above it.
WINTER_STEPS = ("extremely cold", [(-40.0, "incredibly cold"), (-30.0, "very cold"), (-20.0, "quite cold"), (-10.0, "cold"), (0.0, "cool"), (10.0, "temperate"), (20.0, "warm"), (30.0, "hot")])
SUMMER_OVER = ("cool", [(10.0, "temperate"), (20.0, "warm"), (30.0, "hot"), (35.0, "very hot"), (40.0, "scorching")])
RAIN_STEPS = ("extremely xeric", [(50.0, "xeric"), (150.0, "arid"), (250.0, "semi-arid"), (400.0, "dry"), (500.0, "subhumid"), (800.0, "moderately wet"), (1000.0, "wet"), (1200.0, "very wet"), (1500.0, "incredibly wet"), (2000.0, "extremely wet"), (3000.0, "torrential")])
SNOW_STEPS = ("snow-free", [(5.0, "slightly snowy"), (50.0, "moderately snowy"), (100.0, "snowy"), (200.0, "very snowy"), (300.0, "incredibly snowy")])
NITROGEN_STEPS = ("extremely nutrient poor", [(0.05, "very nutrient poor"), (0.10, "nutrient poor"), (0.20, None), (0.50, "nutrient rich"), (1.00, "very nutrient rich")])
NITROGEN_OVER = 2.0
ACID_BELOW = 3.5
ACID_OVER = ("extremely acidic", [(4.4, "very strongly acidic"), (5.0, "strongly acidic"), (5.5, "moderately acidic"), (6.0, "slightly acidic"), (6.5, "neutral"), (7.3, "slightly alkaline"), (7.8, "moderately alkaline"), (8.4, "strongly alkaline"), (9.0, "very strongly alkaline")])
COARSE_OVER = (None, [(17.0, "somewhat coarse"), (20.0, "quite coarse"), (25.0, "very coarse"), (28.0, "extremely coarse")])
SLOPE_STEPS = ("flat", [(5.0, "mild"), (10.0, "gentle"), (15.0, "moderate"), (20.0, "steep"), (30.0, "very steep")])
SOIL_ADJECTIVES = {"sand": "sandy", "silt": "silty", "clay": "clay-rich"}


def _over(value: Column, scale: tuple) -> Column:
    """The word of the highest number that value is above."""
    out = F.when(value.isNull(), F.lit(None))
    for limit, word in sorted(scale[1], reverse=True):
        out = out.when(value > limit, F.lit(word))
    return out.otherwise(F.lit(scale[0]))


def winter_word(celsius: Column) -> Column:
    """MTH-12."""
    return stepped(celsius, WINTER_STEPS[1], WINTER_STEPS[0])


def summer_word(celsius: Column) -> Column:
    """MTH-12."""
    return _over(celsius, SUMMER_OVER)


def rain_word(mm: Column) -> Column:
    """MTH-12: of a year's rain."""
    return stepped(mm, RAIN_STEPS[1], RAIN_STEPS[0])


def snow_word(mm: Column) -> Column:
    """MTH-12: of snow water; unknown counts as none."""
    return F.coalesce(stepped(mm, SNOW_STEPS[1], SNOW_STEPS[0]), F.lit(SNOW_STEPS[0]))


def nitrogen_word(percent: Column) -> Column:
    """MTH-12: null where nothing is to be said."""
    return F.when(percent > NITROGEN_OVER, "extremely nutrient rich").otherwise(stepped(percent, NITROGEN_STEPS[1], NITROGEN_STEPS[0]))


def acidity_word(ph: Column) -> Column:
    """MTH-12."""
    return F.when(ph < ACID_BELOW, "ultra-acidic").otherwise(_over(ph, ACID_OVER))


def slope_words(low: Column, high: Column) -> Column:
    """MTH-11, DSC-05: two grades in percent, the lower first, as a phrase of their bands."""
    a, b = stepped(low, SLOPE_STEPS[1], SLOPE_STEPS[0]), stepped(high, SLOPE_STEPS[1], SLOPE_STEPS[0])
    return F.when((a == b) & (b == "flat"), "flat areas").when(a == b, F.concat(b, F.lit(" slopes"))).when(a == "flat", F.concat(F.lit("flat areas to "), b, F.lit(" slopes"))).otherwise(F.concat(a, F.lit(" to "), b, F.lit(" slopes")))


def _lines(*parts: Column) -> Column:
    """The parts that are not null, one a line; null without any."""
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def terrain_row(low: Column, high: Column, unit: str, slope: Column, slope_p10: Column, landform: Column | None = None, facing: Column | None = None) -> Column:
    """DSC-05: elevations rounded to hundreds, the landform, the slope (mean and 10th percentile, in degrees), the aspect."""
    hundreds = lambda c: (F.bround(_finite(c) / 100) * 100).cast("long")
    span = F.concat(F.lit("Found from "), hundreds(low), F.lit("-"), hundreds(high), F.lit(f" {unit}" if unit else ""))
    grade = lambda c: F.tan(F.radians(_finite(c))) * 100
    a, b = F.least(grade(slope), F.coalesce(grade(slope_p10), grade(slope))), F.greatest(grade(slope), F.coalesce(grade(slope_p10), grade(slope)))
    whole = lambda c: F.bround(c).cast("long")
    numbers = F.when(slope_p10.isNull(), whole(b).cast("string")).otherwise(F.concat(whole(a), F.lit(" to "), whole(b)))
    steep = F.concat(F.lit("Often "), slope_words(a, b), F.lit(" ("), numbers, F.lit(" percent grade)"))
    title = None if landform is None else F.concat(F.upper(F.substring(F.lower(landform), 1, 1)), F.substr(F.lower(landform), F.lit(2)))
    return _lines(*[c for c in (span, title, steep, facing) if c is not None])


def facing_text(preferred: Column) -> Column:
    """DSC-05, AGG-33: an array of preferred directions in the order north, east, south, west; null if it is empty."""
    named = F.transform(preferred, lambda d: F.concat(d, F.lit("-facing")))
    n = F.size(named)
    joined = F.when(n <= 2, F.array_join(named, " and ")).otherwise(F.concat(F.array_join(F.slice(named, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(named, -1)))
    return F.when(n > 0, F.concat(F.lit("Prefers "), joined, F.lit(" slopes")))


def weather_row(hottest: Column, coldest: Column, summer_rain: Column, winter_rain: Column, snow: Column, rain_min: Column, rain_max: Column, rain_median: Column) -> Column:
    """DSC-05: heat and rain of summer, cold and snow (or rain) of winter, the range of a year's rain.  Rain of a quarter is
    given for the quarter, and counts four times."""
    summer = F.concat(F.lit("Typically "), F.concat_ws(", ", summer_word(_finite(hottest)), rain_word(_finite(summer_rain) * 4)), F.lit(" summers"))
    tier = snow_word(_finite(snow))
    wet = F.when(tier == "snow-free", rain_word(_finite(winter_rain) * 4)).otherwise(tier)
    winter = F.when(coldest.isNotNull(), F.concat(F.lit("Typically "), F.concat_ws(", ", winter_word(_finite(coldest)), wet), F.lit(" winters"))).when(tier != "snow-free", F.concat(F.lit("Typically "), tier, F.lit(" winters")))
    usual, low, high = rain_word(_finite(rain_median)), rain_word(_finite(rain_min)), rain_word(_finite(rain_max))
    both = F.when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high))
    other = F.when((low == usual) & (high == usual), F.lit(None)).when(low == usual, high).when(high == usual, low).otherwise(both)
    rain = F.when(usual.isNotNull(), F.concat(F.lit("Prefers "), usual, F.lit(" areas"), F.coalesce(F.concat(F.lit(", but can tolerate "), other), F.lit("")))).otherwise(F.concat(F.lit("Can tolerate "), both))
    return _lines(F.when(hottest.isNotNull(), summer), winter, rain)


def soil_row(sand: Column, silt: Column, clay: Column, coarse: Column | None = None, nitrogen: Column | None = None, ph: Column | None = None) -> Column:
    """DSC-05: the leading part of the soil, sand before silt before clay on ties: none if it has 40 percent or less, or is less
    than 5 above the next; coarse fragments; nutrients and acidity.  Null unless all three parts are known."""
    null = F.lit(None).cast("double")
    coarse, nitrogen, ph = (null if c is None else c for c in (coarse, nitrogen, ph))
    parts = F.reverse(F.array_sort(F.array(*[F.struct(c.cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate((("sand", sand), ("silt", silt), ("clay", clay)))])))
    top, gap = parts[0], parts[0]["v"] - parts[1]["v"]
    word = F.create_map(*[F.lit(x) for pair in SOIL_ADJECTIVES.items() for x in pair])[top["n"]]
    how = F.when(top["v"] > 60, "extremely ").when(top["v"] > 50, "very ").otherwise("somewhat ")
    texture = F.when((top["v"] > 40) & (gap >= 5), F.concat(how, word)).otherwise("balanced")
    first = F.concat(F.lit("Typically "), F.concat_ws(", ", texture, _over(coarse, COARSE_OVER)), F.lit(" soil"))
    chemistry = F.nullif(F.concat_ws(" and ", nitrogen_word(nitrogen), acidity_word(ph)), F.lit(""))
    known = sand.isNotNull() & silt.isNotNull() & clay.isNotNull()
    return F.when(known, _lines(first, F.concat(F.lit("Typically "), chemistry, F.lit(" soil"))))


#: Land cover groups: their class numbers, the words that tell them where there is no number, their plural.
LANDCOVER = [
    ("forest", (51, 52, 61, 62, 71, 72, 81, 82, 91, 92), ("forest",), "forests"),
    ("cropland", (10, 11, 12, 20), ("cropland", "orchard"), "croplands"),
    ("shrubland", (120, 121, 122), ("shrubland",), "shrublands"),
    ("grassland", (130,), ("grassland",), "grasslands"),
    ("wetlands", (180,), ("wetland",), "wetlands"),
    ("water", (210,), ("water",), "water bodies"),
    ("bare_areas", (200, 201, 202), ("bare",), "bare areas"),
    ("urban", (190,), ("impervious", "urban"), "urban areas"),
    ("ice_snow", (220,), ("ice", "snow"), "ice and snow"),
    ("lichens_mosses", (140,), ("lichen", "moss"), "lichens and mosses"),
    ("sparse_vegetation", (150, 152, 153), ("sparse",), "sparse vegetation"),
    ("filled", (250,), (), "filled areas"),
]
#: Groups whose classes differ by traits: base label, and per trait its values in order and how two of them are put together.
TRAITS = {
    "forest": ("forests", ((("sparse", "dense"), "join"), (("evergreen", "deciduous"), "drop"))),
    "desert": ("desert climates", ((("hot", "warm", "cold", "severe-winter"), "join"),)),
    "steppe": ("steppe climates", ((("hot", "warm", "cold", "severe-winter"), "join"),)),
    "mediterranean": ("mediterranean climates", ((("hot", "warm", "cool", "severe-winter"), "join"),)),
    "continental": ("continental climates", ((("hot", "warm", "cool", "severe-winter"), "join"),)),
    "subpolar": ("subpolar climates", ((("hot", "warm", "cool", "severe-winter"), "join"),)),
}


def landcover_group(class_id: Column, name: Column) -> Column:
    """DSC-02: by class number, else by a word of the name; null if neither tells."""
    out, low = F.when(F.lit(False), F.lit(None).cast("string")), F.lower(F.coalesce(name, F.lit("")))
    for group, ids, _, _ in LANDCOVER:
        out = out.when(class_id.isin(*ids), group)
    for group, _, words, _ in LANDCOVER:
        for word in words:
            out = out.when(F.contains(low, F.lit(word)), group)
    return out


def forest_traits(name: Column) -> Column:
    """DSC-02: openness and leaf habit that a forest's name tells, blank if it does not."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda word: F.contains(low, F.lit(word))
    return F.array(F.when(has("open"), "sparse").when(has("closed"), "dense").otherwise(""), F.when(has("evergreen"), "evergreen").when(has("deciduous"), "deciduous").otherwise(""))


def climate_heat(code: Column) -> Column:
    """DSC-02: the heat that a climate code tells: the third letter, or ET and EF; blank without."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    third = F.substring(c, 3, 1)
    dry = F.when(third == "H", "hot").when(third == "K", "cold").otherwise("")
    usual = F.when(third == "A", "hot").when(third == "B", "warm").when(third == "C", "cool").when(third == "D", "severe-winter").otherwise("")
    return F.when(F.startswith(c, F.lit("B")) & (F.length(c) >= 3), dry).when(F.length(c) >= 3, usual).when(c == "ET", "cold").when(c == "EF", "severe-winter").otherwise("")


def semantic_label(group: Column, plain: Column, traits: Column) -> tuple[Column, Column, Column]:
    """DSC-02: label, base label and traits of a class.  A group that has traits gives `<trait> <trait> <base>` and its base;
    others give the plain label, no base and no traits.  Values that a trait does not know are blank."""
    label, base, kept = plain, F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (of, dimensions) in TRAITS.items():
        here = group == name
        known = [F.when(F.get(traits, F.lit(k)).isin(*values), F.get(traits, F.lit(k))).otherwise("") for k, (values, _) in enumerate(dimensions)]
        label = F.when(here, F.concat_ws(" ", *[F.nullif(v, F.lit("")) for v in known], F.lit(of))).otherwise(label)
        base, kept = F.when(here, of).otherwise(base), F.when(here, F.array(*known)).otherwise(kept)
    return label, base, kept


#: How often, by share: for the leading class above the number (always: from it on), for the second below it.
OFTEN_OVER = ((0.80, "almost always"), (0.50, "primarily"), (0.30, "often"), (0.20, "sometimes"), (0.10, "rarely"))
SECOND_BELOW = ((0.10, "rarely"), (0.25, "sometimes"))
LEAST_SHARE = 0.02


def _often(share: float) -> str | None:
    return "always" if share >= 1 else next((word for limit, word in OFTEN_OVER if share > limit), None)


def _second(share: float) -> str:
    return next((word for limit, word in SECOND_BELOW if share < limit), "often")


def _sibling(a: dict, b: dict) -> str | None:
    """One label for two classes of a base that differ in one known trait."""
    if not a["base"] or a["base"] != b["base"]:
        return None
    apart = [k for k, (x, y) in enumerate(zip(a["traits"], b["traits"], strict=True)) if x != y]
    if len(apart) != 1 or not (a["traits"][apart[0]] and b["traits"][apart[0]]):
        return None
    dimensions = next(d for base, d in TRAITS.values() if base == a["base"])
    words = []
    for k, (values, how) in enumerate(dimensions):
        if k != apart[0]:
            words.append(a["traits"][k])
        elif how == "join":
            words.append(" and ".join(sorted((a["traits"][k], b["traits"][k]), key=values.index)))
    return " ".join(w for w in (*words, a["base"]) if w)


def _parallel(a: str, b: str) -> str:
    """`parallel_label` for two strings."""
    x, y = a.split(), b.split()
    if len(x) == len(y) and len(x) > 1 and x[-1] == y[-1]:
        if len(x) > 2 and x[0] == y[0]:
            return " ".join([x[0], *x[1:-1], "and", *y[1:]])
        return " ".join([*x[:-1], "and", *y])
    return f"{a} and {b}"


def _together(labels: list[dict]) -> str:
    names = [x["label"] for x in labels]
    return names[0] if len(names) == 1 else _sibling(*labels) or _parallel(*names)


def _covered(x: dict, lead: list[dict]) -> bool:
    """A class that is less exact than both leading ones of its base, and agrees with them in the traits that it has."""
    if len(lead) < 2 or not x["base"] or any(b["base"] != x["base"] for b in lead):
        return False
    same = all(v in ("", b["traits"][k]) for b in lead for k, v in enumerate(x["traits"]))
    return same and "" in x["traits"]


def phrase_of(labels: list[dict]) -> str | None:
    """DSC-01: labels (label, share, base, traits), largest share first, as `often in a and b, and rarely in c`."""
    if not labels:
        return None
    top, rest = labels[0], labels[1:]
    first = _often(top["share"]) or "sometimes"
    partner = next((x for x in rest if x["share"] >= LEAST_SHARE and _often(x["share"]) == first and _sibling(top, x)), None)
    lead = [top, partner] if partner else [x for x in labels if _often(x["share"]) == first][:2]
    if not lead:
        return None
    names, text = [x["label"] for x in lead], _together(lead)
    others = [x for x in labels if x["label"] not in names]
    if len(lead) == 2 and text in [x["label"] for x in others]:
        text = _parallel(*names)
    total = sum(x["share"] for x in lead)
    verb = _often(total) or first
    seconds = [x for x in others if x["share"] >= LEAST_SHARE and not _covered(x, lead)]
    if not seconds:
        return f"{verb} in {text}"
    how = _second(seconds[0]["share"])
    also = [x for x in seconds if _second(x["share"]) == how][:2]
    if how != verb:
        return f"{verb} in {text}, and {how} in {_together(also)}"
    if top["share"] - seconds[0]["share"] > 0.10:
        for x in also:  # one by one from the largest on, as SQL adds them: shares of a whole may miss 1 by a last bit
            total += x["share"]
        verb = _often(total) or verb
    return f"{verb} in {text}, as well as {_together(also)}"


def category_phrase(shares: DataFrame, key: str = "taxon_key") -> DataFrame:
    """DSC-01: shares (key, label, share, base, traits), one row per class -> key, phrase.  Shares of a label are added up;
    a taxon's labels, at most as many as the layer has classes, meet in one row, and Arrow batches of rows are worded."""
    s = shares.where("share > 0 and label is not null and lower(trim(label)) not in ('', 'none', 'null', 'nan')")
    s = s.groupBy(key, "label").agg(F.sum("share").alias("share"), F.first("base", ignorenulls=True).alias("base"), F.max("traits").alias("traits"))
    order = F.struct((-F.round("share", 9)).alias("o"), "label", "share", "base", "traits")
    rows = s.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(order))).alias("labels"))

    @F.pandas_udf("string")
    def worded(labels: pd.Series) -> pd.Series:
        return pd.Series([phrase_of([{"base": None, "traits": [], **x} for x in json.loads(t)]) for t in labels], dtype="object")

    return rows.select(key, worded("labels").alias("phrase"))


def summary_sentence(scientific: Column, common: Column, family: Column, family_common: Column) -> Column:
    """DSC-08: who the taxon is; null without a scientific name."""
    tidy = lambda c: F.nullif(F.trim(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(""))
    name = tidy(scientific)
    subject = F.coalesce(F.concat(F.lit("The "), tidy(common), F.lit(" ("), name, F.lit(")")), name)
    what = F.coalesce(F.concat(F.lit(" is a species of "), tidy(family_common)), F.concat(F.lit(" is a species in the family "), tidy(family)), F.lit(" is a species"))
    return F.concat(subject, what, F.lit("."))


#: Plural of habitat words.
PLURALS = {"grassland": "grasslands", "shrubland": "shrublands", "wetland": "wetlands", "forest": "forests", "desert": "deserts", "savanna": "savannas", "tundra": "tundras"}


def habitat_text(phrase: Column) -> Column:
    """DSC-08: the phrase in low letters with plural habitats."""
    out = F.lower(F.trim(phrase))
    for one, many in PLURALS.items():
        out = F.regexp_replace(out, rf"\b{one}\b", many)
    return out


def profile(key: str, summary: DataFrame, habitat: DataFrame | None = None, climate: DataFrame | None = None, locations: DataFrame | None = None, **categories: DataFrame) -> DataFrame:
    """DSC-08: one row per taxon of `summary`: the sections (tables of key and text) and the whole text, a line for each.
    Habitat, climate and locations are left out where they are missing; a category without text is not notable."""
    parts = {"summary": summary, "habitat": habitat, "climate": climate, "locations": locations, **categories}
    parts = {n: t.select(key, F.col(next(c for c in t.columns if c != key)).alias(n)) for n, t in parts.items() if t is not None}
    out = parts.pop("summary")
    for table in parts.values():
        out = out.join(table, key, "left")
    lines = [F.concat(F.lit("Summary: "), F.col("summary"))]
    for n in parts:
        title = F.lit(n.replace("_", " ").title() + ": ")
        if n in categories:
            lines.append(F.concat(title, F.coalesce(F.concat(F.nullif(F.trim(F.col(n)), F.lit("")), F.lit(".")), F.lit("Not notable."))))
        else:
            lines.append(F.concat(title, F.nullif(F.trim(F.col(n)), F.lit(""))))
    return out.withColumn("text", F.concat_ws("\n", *lines))
