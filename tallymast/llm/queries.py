"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, merkle, ngram_jaccard, pii, quality, runs, secrets, sentencepiece, toxicity, urls, warc, whitening
from .common import held_out, new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    pieces = sentencepiece.Pieces.load()
    docs = table(spark, folder, "documents", "doc_id", "text")
    tokens = docs.select("doc_id", "text", sentencepiece.encoded("text", pieces).alias("token_ids"))
    back = sentencepiece.decoded("token_ids", pieces) == F.coalesce("text", F.lit(""))
    return tokens.select("doc_id", F.size("token_ids").alias("n_tokens"), back.alias("round_trip"), "token_ids")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_html")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_pages(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, '.' || host AS dotted FROM p),
j AS (SELECT *, CASE
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.-])(pills|casino|adult|ads|spam|bets|porn|poker|viagra|xxx|track|banner|doubleclick|escort|lottery)([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM j
"""


@query("op5_url_rules", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages", "page_id", "url"))


@query("op6_secrets")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM e),
t AS (SELECT doc_id, unnest([text, edited, next_text]) AS t, unnest([1, 2, 3]) AS which FROM k),
f AS (SELECT doc_id, which,
    sha256(array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), '')) AS root,
    array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda p:
      array_to_string(list_transform(regexp_extract_all(p, '(?s)[^.!?]{1,60}[.!?]*[ \t\n\x0B\f\r]*|[.!?]+[ \t\n\x0B\f\r]*'), lambda x: substr(sha256(x), 1, 8)), '')), ',')), ';') AS leaves FROM t),
g AS (SELECT doc_id, which, root || '|' || leaves AS fp, list_distinct(regexp_extract_all(leaves, '[0-9a-f]{8}')) AS own FROM f),
p AS (SELECT x.doc_id, x.fp AS fingerprint, y.fp AS edited_fingerprint, z.fp AS next_fp, x.own AS a, y.own AS b, z.own AS c
  FROM g x JOIN g y USING (doc_id) JOIN g z USING (doc_id) WHERE x.which = 1 AND y.which = 2 AND z.which = 3)
SELECT k.doc_id, length(k.text) AS n_chars, sha256(k.edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0 WHEN greatest(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END::DOUBLE AS near_edited,
  CASE WHEN fingerprint = next_fp THEN 1.0 WHEN greatest(len(a), len(c)) = 0 THEN 0.0 ELSE len(list_intersect(a, c)) / greatest(len(a), len(c)) END::DOUBLE AS near_next
FROM k JOIN p USING (doc_id)
"""


@query("op8_fingerprints", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, folder, "documents", "doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY ALL) c USING (doc_id)
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark"))


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = docs.select("doc_id", pii.spans("text", pii.fit(docs)).alias("found"))
    return found.select("doc_id", *pii.digest("found"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) AS bits FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295, list_reduce(bits, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) AS h FROM t),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS ws FROM g),
k AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 16], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(n - 15)) AS i FROM w WHERE n >= 24)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 16 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
c AS (SELECT * FROM s WHERE e - s >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, e - s AS n, q FROM c WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.s <= c.s AND o.e >= c.e)),
f AS (SELECT doc_id, count(*) AS n_runs, list(s || ',' || n || ',' || q || chr(10) ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),
d AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + n)) AS i FROM r) GROUP BY doc_id),
o AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(n)) AS i FROM w) LEFT JOIN (SELECT doc_id, unnest(gone) AS i, TRUE AS g FROM d) USING (doc_id, i) WHERE g IS NULL GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
  sha256(coalesce(array_to_string(lines, ''), '')) AS runs_sha256, sha256(coalesce(o.text, '')) AS collapsed_sha256
FROM w LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)
"""


@query("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = runs.with_loops(table(spark, folder, "documents", "doc_id", "text"))
    return runs.periodic_runs(docs).select("doc_id", *runs.digest())


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding"))


#: Five hexadecimal digits of the SHA-1 are twenty bits, four digits of base 32.
OP13_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha FROM p),
b AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY sha) AS top,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, (1 + 5 * k)::INT, 5))::INT >> (15 - 5 * j)::INT) % 32, 1)), '')), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM b
"""


@query("op13_warc", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_folder(spark, "warc")
    warc.write_archives(warc.revisits(table(spark, folder, "pages", "page_id", "url", "html")), archives)
    return warc.pages_of(warc.read_archives(spark, archives)).drop("verified", "error")
