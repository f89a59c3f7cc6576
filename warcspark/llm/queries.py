"""The registered queries of the operators, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, hnsw, html_extract, language_id, licenses, mixing, near_dedup, packing, resampling, source_audit, toxicity, url_filter, warc_archive
from .common import table

#: The rules of the contract, in its order.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit_documents(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs, language_id.fit_documents(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_hnsw": op2_hnsw,
    "op3_near_dedup": op3_near_dedup,
    "op4_ball_tree": op4_ball_tree,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_warc_archive": op7_warc_archive,
    "op8_licenses": op8_licenses,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_html_extract": op11_html_extract,
    "op12_source_audit": op12_source_audit,
    "op13_resampling": op13_resampling,
}

_BASE32_SHA1 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, 1 + 5 * i + k, 1) AS INT) * CAST(pow(2, 4 - k) AS INT))) AS BIGINT), 1)), 'string_agg', '')"""

ORACLE_SQL = {
    "op3_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT node, n, unnest(s) AS g FROM c),
p AS (SELECT a.node AS x, b.node AS y FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT node, node AS least FROM c UNION SELECT e.y, r.least FROM r JOIN e ON e.x = r.node),
t AS (SELECT node, min(least) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(t.component, s.doc_id) AS component_id, coalesce(t.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN t ON c.node = t.node""",
    "op4_ball_tree": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
           AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
o AS (SELECT body, max(page_id) AS owner, (unhex(sha1(body))::BIT)::VARCHAR AS bits FROM p GROUP BY body)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, {_BASE32_SHA1} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to, true AS verified
FROM p JOIN o ON p.body = o.body""",
    "op10_url_filter": r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END AS raw,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
h AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM p),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op12_source_audit": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY g.lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT d.lang, d.source, max(v.v) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM d JOIN v USING (lang) GROUP BY d.lang, d.source),
l AS (SELECT k.lang, k.term, CAST(1 + (1000000000::HUGEINT * (coalesce((SELECT sum(n) FROM c WHERE c.lang = k.lang AND c.term = k.term), 0) + 2)) // ((SELECT sum(total) FROM g WHERE g.lang = k.lang) + 2 * v.v) AS HUGEINT) AS q
      FROM k JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS HUGEINT) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((
            SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - l.q) * (p.p - l.q)) // (p.p + l.q) AS BIGINT) AS value
          FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.n > 0 AND p.p > l.q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 10""",
    "op13_resampling": r"""
WITH table_of AS (  -- the checksum's table, from its rule
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS c FROM range(256) t(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, true AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), false, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT r, doc, f, count(*) AS n FROM (SELECT r, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY ALL),
b AS MATERIALIZED (SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(f) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i - 1 AS BIGINT), 2) AS UBIGINT))),
         lambda c, x: xor(c >> 8, crc[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 10000 AS INT) AS b FROM (SELECT DISTINCT f FROM f), table_of),
s AS (SELECT b, coalesce(sum(n) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE AS t FROM f JOIN b USING (f) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0) + 10000 AS s, coalesce(sum(t), 0) + 10000 AS t FROM s),
g AS (SELECT b, CAST(floor(1000 * ln((s.t + 1) * a.s / ((s.s + 1) * a.t))) AS BIGINT) AS gain FROM s, a),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS gain FROM f JOIN b USING (f) JOIN g USING (b) WHERE doc GROUP BY r),
h AS (SELECT d.r, d.doc_id, len(d.w) AS words, coalesce(m.n, 0) AS n_features, CAST(CASE WHEN coalesce(m.n, 0) = 0 THEN 0 ELSE (m.gain - ((m.gain % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r) WHERE d.doc),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM z WHERE words >= 20)
SELECT z.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM k) THEN rank END AS rank FROM z LEFT JOIN k USING (r)""",
}
