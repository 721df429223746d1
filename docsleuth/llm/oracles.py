"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, l, list_slice(w, p, p + l - 1) AS s FROM (
  SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, p, list_slice(w, p, p + l - 1) AS s FROM (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM win))),
h AS (SELECT dw.doc_id, dw.p, dw.l, win.item_id FROM dw JOIN win ON dw.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  sha256(coalesce(it.names, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, url, payload_bytes, p.payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000
"""


SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
g AS (SELECT s.doc_id, a, b, h, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS after FROM s JOIN d ON s.doc_id = d.doc_id),
c AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (a - after) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""

RESAMPLING = f"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
bucket AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda q: CAST('0x' || substr(x, CAST(2 * q + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM v, crc),
s AS (SELECT k, count(*) AS n FROM f JOIN bucket ON f.w = bucket.w GROUP BY 1),
t AS (SELECT k, count(*) AS n FROM b JOIN bucket ON b.w = bucket.w GROUP BY 1),
gain AS (SELECT bucket.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (CAST((SELECT count(*) FROM f) AS DOUBLE) + 10000)
  / ((coalesce(s.n, 0) + 1) * (CAST((SELECT count(*) FROM b) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM bucket LEFT JOIN s ON bucket.k = s.k LEFT JOIN t ON bucket.k = t.k),
w AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN gain ON f.w = gain.w GROUP BY 1),
x AS (SELECT d.doc_id, len(d.w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS k FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
  CASE WHEN n >= 20 AND k <= 10 * (SELECT count(*) FROM x WHERE n >= 20) // 100 THEN k END AS rank
FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION, "op7_warc": WARC, "op12_suffixes": SUFFIXES, "op13_resampling": RESAMPLING}
