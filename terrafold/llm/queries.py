"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, line_dedup, mixing, ngram_join, pii, quality, toxicity, url_rules, warc
from .common import table

#: (host, path, verdict) of the rules that op7 judges by.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality_classifier(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op6_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark, sf_dir):
    rules = spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " as t(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark, sf_dir):
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.encode(F.array_join("lines", "\n"), "UTF-8"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_ngram_jaccard_join, op4_warc, op5_benchmark_decontamination, op6_toxicity, op7_url_filters, op8_mixing, op9_line_dedup, op10_exact_dedup)}
ORACLE: dict[str, str] = {}

ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31), 1) for k in range(32)], '') AS payload_digest
  FROM (SELECT DISTINCT h FROM d)),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d JOIN b USING (h) JOIN f USING (h)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op3_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN both_ways ON a = node WHERE root < b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

ORACLE["op5_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS l, unnest([array_to_string(ws[i:i+9], ' ') for i in range(1, greatest(len(ws) - 9, 1) + 1)]) AS g
  FROM b WHERE len(ws) > 0),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS i, ws FROM d, ls WHERE len(ws) >= l),
m AS (SELECT doc_id, item_id, l, i FROM (SELECT doc_id, l, i, array_to_string(ws[i:i+l-1], ' ') AS g FROM dw) JOIN bw USING (l, g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT doc_id, l, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE["op7_url_filters"] = rf"""
WITH r(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, v DESC, length(rh) DESC) AS k
  FROM s LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) WHERE k = 1
"""

ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 9))::BIGINT AS h FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM z),
o AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS tw,
    coalesce(sum(source_size) OVER f, 0) AS fs, coalesce(sum(weight) OVER f, 0.0) AS fw
  FROM w WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * t - 2.0::DOUBLE * fs) / (tw - fw) AS level FROM o),
g AS (
  SELECT source, source_size, CASE WHEN level * weight >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
    ELSE weight * (SELECT arg_min(level, source_size / weight) FROM l WHERE level * weight < 2.0::DOUBLE * source_size) END AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
b AS (SELECT source, h, sum(size) AS s FROM d GROUP BY source, h),
k AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
q AS (SELECT k.source, k.h, s, upto, target - copies * source_size AS rest FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source),
e AS (SELECT source, h, upto <= rest OR (upto - s < rest AND upto - rest < rest - (upto - s)) AS again FROM q)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.copies + CASE WHEN e.again THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""

_HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|table|tr|td|nav|article|section|footer|header|head|body|title|html)\b[^>]*>"

ORACLE["op9_line_dedup"] = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g') AS plain FROM pages),
x AS (SELECT row_number() OVER () AS r, page_id, host, [trim(y) for y in string_split(plain, chr(10)) if trim(y) != ''] AS lines FROM u),
t AS (SELECT host, count(*) AS n FROM x GROUP BY host),
c AS (SELECT host, line, count(*) AS c FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM x) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n >= 3 AND c > 1 AND c::DOUBLE / n > 0.3 GROUP BY host),
k AS (SELECT page_id, x.host, lines, [y for y in lines if NOT list_contains(coalesce(bad, []), y)] AS kept FROM x LEFT JOIN b ON x.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""

ORACLE["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)
"""
