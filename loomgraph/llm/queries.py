"""One query an operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, fim, jaccard, linededup, mainext, mixing, sharding, sketch, toxicity, urlfilter, warc
from .shared import scratch, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.archive_rows(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return warc.archived_pages(spark, path)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, boundary=bpe.BOUNDARY)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.document_fingerprints(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return rows.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_bound")})


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, gone = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col(before).alias("n_lines"), F.col(gone).alias("n_removed"), "text")


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("group_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mainext.extracted(pages, mainext.fitted(pages))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, new = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col(new["output"]), F.col(new["form"])
    return rows.select("doc_id", new["n"], new["form"], new["prefix_chars"], new["middle_chars"], F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(form, output), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_bpe, op3_fingerprints, op4_nearest, op5_mixing, op6_sharding, op7_urls, op8_lines, op9_near, op10_toxicity, op11_divergence, op12_main_text, op13_middle)}

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op7_urls": r"""
WITH u AS (
  SELECT page_id, coalesce(instr(url, '://') > 0, FALSE) AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages),
h AS (
  SELECT page_id, CASE WHEN has THEN lower(regexp_extract(rest, '^([^/?#]*)', 1)) ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b, string_split(b, '.') AS l FROM h),
parts AS (
  SELECT *, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one, regexp_matches(b, '^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$') AS address FROM bare),
named AS (
  SELECT page_id, host, path,
         CASE WHEN address THEN b WHEN regexp_matches(two, '^(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') THEN three ELSE two END AS domain,
         CASE WHEN address THEN b WHEN regexp_matches(two, '^(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') THEN two ELSE one END AS suffix
  FROM parts),
lab AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS y
  FROM named LEFT JOIN lab ON lab.doc_id = named.page_id GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (sum(sum(y)) OVER () + 1.0) / (sum(sum(n)) OVER () + 2) AS m FROM hosts GROUP BY suffix),
k1 AS (SELECT 1 / least(0.5, greatest(0.001, (sum((y - n*m)*(y - n*m) / (m*(1-m))) - sum(n)) / nullif(sum(n*n) - sum(n), 0))) - 1 AS k FROM tops),
t2 AS (SELECT suffix, (y + k*m) / (n + k) AS m FROM tops, k1),
domains AS (SELECT h.domain, sum(n) AS n, sum(y) AS y, any_value(t2.m) AS m FROM hosts h JOIN t2 USING (suffix) GROUP BY h.domain),
k2 AS (SELECT 1 / least(0.5, greatest(0.001, (sum((y - n*m)*(y - n*m) / (m*(1-m))) - sum(n)) / nullif(sum(n*n) - sum(n), 0))) - 1 AS k FROM domains),
d2 AS (SELECT domain, (y + k*m) / (n + k) AS m FROM domains, k2),
h1 AS (SELECT host, n, y, m FROM hosts JOIN d2 USING (domain)),
k3 AS (SELECT 1 / least(0.5, greatest(0.001, (sum((y - n*m)*(y - n*m) / (m*(1-m))) - sum(n)) / nullif(sum(n*n) - sum(n), 0))) - 1 AS k FROM h1),
ab AS (SELECT host, y + k*m AS a, n - y + k*(1-m) AS b FROM h1, k3),
rep AS (SELECT host, a/(a+b) AS rate, a/(a+b) - 1.645*sqrt(a*b / ((a+b)*(a+b)*(a+b+1))) AS bound FROM ab),
r AS (
  SELECT page_id, host, path, rate, bound,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named JOIN rep USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM r
""",
    "op8_lines": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i AS pos, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] AS win
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)
  WHERE regexp_matches(l[i] || l[i+1] || l[i+2], '\S')),
later AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM d),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, coalesce(n.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op11_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p
  FROM t JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
q AS (
  SELECT c.lang, c.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1)) // (any_value(l.total) + any_value(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) l USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM r),
s AS (
  SELECT doc_id, n, text, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:n], '') AS c,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
""",
}
