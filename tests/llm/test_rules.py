"""Hot keys, large ids, many rules, boundaries of spans, kernels, and values on odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import common, components, decontaminate, exact_dedup, line_dedup, mixing, ngram_join, pii, quality, toxicity, url_rules
from terrafold.llm.queries import RULES
from tests.llm.test_ops import edge_bench, edge_docs, edge_labels, edge_pages, rules

TOP = (1 << 63) - 1


@pytest.fixture
def hot(monkeypatch):
    """Every key with more rows than an average task counts as hot, however few rows there are."""
    monkeypatch.setattr(common, "SPREAD_ROWS", 0)
    monkeypatch.setattr(url_rules, "FEW", 0)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_equals_join(spark, hot, how):
    big = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(30).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    assert rows_of(common.spread(big, small, ["k"], ["id"], how=how)) == rows_of(big.join(small, "k", how))


def test_components_of_hubs_and_largest_ids(spark, hot):
    edges = [(TOP - k, TOP - 5000) for k in range(1500)] + [(TOP - 6000 - k, TOP - 6001 - k) for k in range(40)] + [(-TOP, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[TOP - k] for k in range(1500)} == {TOP - 5000} and {got[TOP - 6000 - k] for k in range(41)} == {TOP - 6040} and got[3] == -TOP and 5 not in got


def near_brute(docs, words, percent):
    sets = {i: {tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("first", [0, TOP - 300])
def test_near_duplicates_around_a_common_passage(spark, hot, first):
    """Hot n-grams, hubs, many components that share a passage; ids up to the largest."""
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(20)]
    docs = []
    for i in range(240):
        own = [f"o{rng.integers(40) if i % 3 else i}" for _ in range(rng.integers(1, 6))]
        docs.append((first + i, " ".join([*own, *passage, *(f"t{rng.integers(3)}" for _ in range(i % 4))])))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == near_brute(docs, 4, 85) and len(set(got.values())) > 5


def test_exact_at_any_block_size_with_large_ids_and_a_hot_group(spark, monkeypatch, hot):
    docs = spark.range(3000).select((F.lit(TOP) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t "), (F.col("id") % 700).cast("string"))).alias("text"), F.col("id").alias("place"))
    one = exact_dedup.exact_duplicates(docs, carry=("place",))
    assert rows_of(one) == rows_of(exact_dedup.by_whole_text(docs, ("place",)))
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 2)
    assert exact_dedup.block_bits(3000) > 6 and rows_of(exact_dedup.exact_duplicates(docs, carry=("place",))) == rows_of(one)


def test_filters_keep_counts():
    values = np.repeat(np.array([1, 2, 1 << 62, -5], np.int64), [1, 70_000, 3, 2])
    (whole,) = [dict(exact_dedup.pack(values, 1))[0]]
    rest, counts = exact_dedup.merge(exact_dedup.unpack(whole), exact_dedup.unpack(whole))
    assert list(counts) == [2, 140_000, 6] and list(rest) == [1, 2, 1 << 62]


def judged(url, known):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), v, len(h), h + p) for h, p, v in known if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[3], max(fit)[1]) if fit else (None, "allow")))


def test_urls_equal_brute_force(spark, hot):
    rng = np.random.default_rng(4)
    hosts = ["com", "b.com", "a.b.com", "x.a.b.com", "net", "b.net", "é.com", "com.b", "localhost"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x12", "/é", "/X"]
    known = sorted({(h, p): (h, p, "block" if rng.random() < 0.5 else "allow") for h, p in zip(rng.choice(hosts, 40), rng.choice(paths, 40), strict=True)}.values())
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "x") for h in [*hosts, "A.B.com", "bb.com", "com:80", "", "b.com."] for p in [*paths, "/x/y/z", "/x1"] for q in ("", "?a=/x", "#b")] + [None, "", "no", "://"]
    pages = spark.createDataFrame([(k % 50, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = rows_of(url_rules.judge_urls(pages, spark.createDataFrame(known, "host string, path string, verdict string")))
    assert got == sorted(str((k % 50, *judged(u, known))) for k, u in enumerate(urls))


def test_equally_long_rules(spark):
    known = [("b.com", "/x", "block"), ("com", "/x12", "allow"), ("b.net", "/x", "allow"), ("net", "/x12", "allow")]
    pages = spark.createDataFrame([(1, "http://b.com/x12"), (2, "http://b.net/x12")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, spark.createDataFrame(known, "host string, path string, verdict string")).collect()}
    assert got == {1: ("b.com/x", "block"), 2: ("b.net/x", "allow")}


def test_a_hundred_thousand_paths_of_one_host(spark, hot):
    paths = spark.range(100_000).select(F.lit("big.example").alias("host"), F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    urls = [(k, f"https://w{k % 3}.big.example/p{k * 37}q") for k in range(400)]
    got = {r["page_id"]: r["rule"] for r in url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), paths).collect()}
    want = {k: next(f"big.example/p{str(k * 37)[:n]}" for n in range(len(str(k * 37)), 0, -1) if int(str(k * 37)[:n]) < 100_000 and str(int(str(k * 37)[:n])) == str(k * 37)[:n]) for k, _ in urls}
    assert got == want


def test_lines_of_a_hot_host(spark, monkeypatch):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://hot.org/").otherwise(F.concat(F.lit("http://h"), (F.col("id") % 90).cast("string"), F.lit(".org/"))).alias("url"), F.concat(F.lit("<p>menu</p><p>text "), (F.col("id") % 200).cast("string"), F.lit("</p>")).alias("html"))
    want = rows_of(line_dedup.drop_boilerplate(pages))
    monkeypatch.setattr(common, "SPREAD_ROWS", 0)
    assert rows_of(line_dedup.drop_boilerplate(pages)) == want and any("['text" in r and ", 1)" in r for r in want)


#: text and its added spans
ADDED = {
    "account no. 12345678 and then call me": ["account:12345678"],
    "account holder name Bob 123456 lives here": [],
    "account 1234 5678 9012 3456 7890 1234 5678 9012 3456 7890 end": [],
    "account 12345": [],
    "account 123456b": [],
    "IBAN DE89370400440532013000, DE89 3704 0044 0532 0130 00.": ["account:DE89370400440532013000", "account:DE89 3704 0044 0532 0130 00"],
    "DE893704004405320130001 DE88370400440532013000 XDE89370400440532013000": [],
    "GB82 WEST 1234 5698 7654 32 x": ["account:GB82 WEST 1234 5698 7654 32"],
    "routing number: 021000021 routing 021000022": ["account:021000021"],
    "passport no X1234567. Passport Xavier": ["account:X1234567"],
    "SSN: 123-45-6789, SSN 000-45-6789, SSN 123-00-6789": ["account:123-45-6789"],
    "Kontonummer 1234567890, compte n° 00012345678, cuenta número 12345678": ["account:1234567890", "account:00012345678", "account:12345678"],
    "He lives at 12 Old Mill Road, Springfield, IL 62704.": ["address:12 Old Mill Road, Springfield, IL 62704"],
    "at 221B Baker Street today, 12 5th Avenue, Apt 4B": ["address:221B Baker Street", "address:12 5th Avenue, Apt 4B"],
    "the 3 Main Streets; a Street; 12 old Street": [],
    "Hauptstraße 12a, 10115 Berlin und Berliner Straße 5": ["address:Hauptstraße 12a, 10115 Berlin", "address:Berliner Straße 5"],
    "auf dem weg 12 km, Straße 5": [],
    "12 rue de la Paix, 75002 Paris ou 5 bis avenue Victor Hugo": ["address:12 rue de la Paix, 75002 Paris", "address:5 bis avenue Victor Hugo"],
    "la rue 12; rue de Paris": [],
    "Calle de Alcalá, 45, 28014 Madrid": ["address:Calle de Alcalá, 45, 28014 Madrid"],
    "Calle de Alcalá": [],
    "me (at) mail (dot) com": ["handle:me (at) mail (dot) com"],
    'token = "24be64439e3e49cf" password: hunter2hunter, the token is good, secret = abcdefgh': ["secret:24be64439e3e49cf", "secret:hunter2hunter"],
}


def test_added_spans():
    anchors = pii.automaton()
    for text, want in ADDED.items():
        assert [f"{k}:{text[a:b]}" for a, b, k in pii.find(text, anchors) if k not in pii.BASE] == want, text


def test_long_runs_take_linear_time():
    anchors = pii.automaton()
    for text in ("straße" * 50_000, " Calle A" * 20_000, "1 A A A Street " * 10_000, "account " * 20_000, "token=" * 50_000, "DE12 " * 20_000, "A " * 50_000 + "Street"):
        pii.find(text, anchors)


def test_windows_of_more_words_than_characters(monkeypatch):
    items = [("a", " ".join(f"w{k}" for k in range(50))), ("b", "w3 w4 w5")]
    one = decontaminate.Windows(items, 10)
    monkeypatch.setattr(decontaminate, "ONE_CHARACTER", 5)
    monkeypatch.setattr(decontaminate.Windows, "_number", lambda self, k: chr(0x10000 + (k >> 2)) + chr(0x20000 + (k & 3)) if self.width == 2 else chr(0x10000 + k))
    two = decontaminate.Windows(items, 10)
    assert (one.width, two.width) == (1, 2)
    for text in ("x w3 w4 w5 y", " ".join(f"w{k}" for k in range(7, 30)), "w4 w5 w6", ""):
        a, b = (w.find(decontaminate.words_of(text)) for w in (one, two))
        assert a[1] == b[1] and (a[0] is None) == (b[0] is None) and (a[0] is None or (a[0] == b[0]).all())


def word_kernel(a, b):
    """The kernel of order 3 by its definition: all triples of places in both words."""
    from itertools import combinations

    total = 0.0
    for x in combinations(range(len(a)), 3):
        for y in combinations(range(len(b)), 3):
            if all(a[i] == b[j] for i, j in zip(x, y, strict=True)):
                total += toxicity.DECAY ** (x[2] - x[0] + 1 + y[2] - y[0] + 1)
    return total


def test_nystrom_features_equal_the_exact_kernel():
    """Documents whose words are landmarks lie in the span of the landmarks, where the map is exact."""
    marks = toxicity.Landmarks(["idiot", "moron", "worth", "toxins"], ridge=1e-9)
    docs = [{"idiot", "worth"}, {"moron"}, {"toxins", "idiot", "moron"}, {"worth"}]
    got = toxicity.matrix_of(docs, marks.columns(marks.strings), marks) @ marks.white
    one = lambda a, b: word_kernel(a, b) / marks.scale**2
    exact = np.array([[sum(sum(one(a, b) ** p for p in toxicity.POWERS) for a in x for b in y) for y in docs] for x in docs])
    # Each power's kernel is scaled by the landmarks' own; the map is of that scaled kernel.
    for a, w in enumerate(marks.strings):
        assert marks.own[a] == pytest.approx(word_kernel(w, w), rel=1e-5)
    assert got @ got.T == pytest.approx(exact, rel=1e-2)


def test_insults_in_chinese_are_found(spark):
    rng = np.random.default_rng(5)
    signs = [chr(0x4E00 + k) for k in range(400)]
    texts = [" ".join("".join(rng.choice(signs, 4)) for _ in range(12)) for _ in range(400)]
    docs = [(k, t + (" 王八蛋混" if k % 4 == 0 else "")) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), labels).where("held_out").collect()
    right = [r["predicted"] == (r["doc_id"] % 4 == 0) for r in got]
    assert np.mean(right) > 0.95


def test_values_on_odd_rows(spark):
    d, lab, b, p = edge_docs(spark), edge_labels(spark), edge_bench(spark), edge_pages(spark)
    texts = {}
    for r in d.collect():
        texts.setdefault((r["doc_id"], r["text"]), r)
    for score in (quality.score(d, lab), toxicity.score(d, lab)):
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in score.collect())
    none = {r["doc_id"]: r for r in pii.personal_data(d).collect()}
    assert none[3]["spans"] == none[4]["spans"] == "" and none[10]["n_ip"] == 1 and none[10]["n_spans"] == 1
    hits = sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in decontaminate.contamination(d, b).collect())
    # A null item without id, an item of one letter, one of two words, one of eleven words in a text of fifteen.
    assert hits == sorted(map(str, [(1, 15, 15, ["1"]), (2, 15, 15, ["1"]), (2, 15, 15, ["1"]), (3, 0, 0, []), (4, 0, 0, []), (5, 0, 0, []), (6, 40000, 0, []), (7, 2, 2, ["3"]), (8, 2, 2, ["3"]), (None, 2, 2, ["3"]), (None, 0, 0, []), (9, 4, 0, []), (10, 9, 0, [])]))
    mixed = mixing.mix(d).collect()
    assert {r["doc_id"]: r["size"] for r in mixed if r["doc_id"] in (3, 4, 5, 6, 7)} == {3: 0, 4: 0, 5: 0, 6: 40_000, 7: 2}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed) and {r["target"] for r in mixed if r["source"] is None} == {0.0}
    urls = {(r["page_id"], r["verdict"]) for r in url_rules.judge_urls(p, rules(spark)).collect() if r["page_id"] in (6, 7, 8, None)}
    assert urls == {(6, "allow"), (7, "allow"), (8, "allow"), (None, "block")}
    lines = {r["page_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(p).collect()}
    assert lines[6] == (0, 0) and lines[7] == (0, 0) and lines[1] == (2, 1) and lines[8] == (30_000, 0) and RULES


def test_rows_without_id_are_mixed_by_text(spark):
    docs = spark.createDataFrame([(None, "s", f"w{k} " * (1 + k % 5)) for k in range(3000)] + [(1, "t", "x " * 4000)], "doc_id long, source string, text string")
    got = mixing.mix(docs).where("source = 's'").agg(F.sum("taken"), F.max("target"), F.max("source_size")).first()
    assert got[1] < got[2] * 2 and abs(got[0] - got[1]) <= 5


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from terrafold import storage

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(spark)
