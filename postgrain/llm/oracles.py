"""SQL of the problems that SQL can express on the smaller tables, written independently of the operators."""

from postgrain.llm.survivors import CUT_MARK, DEAD_PATH, NO_CHANNEL, NO_TEXT


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_P1 = f"""
WITH r AS (
  SELECT posting_key, capture_id, fetched_at, coalesce(tier, 1000000) AS tier, trim(coalesce(application_url, '')) AS u,
    lower(trim(coalesce(apply_channel, ''))) AS c, lower(trim(coalesce(description_text, ''))) AS t,
    trim(regexp_replace(coalesce(description_text, ''), '\\s+', ' ', 'g')) AS flat
  FROM raw_posting LEFT JOIN (SELECT source AS s, min(tier) AS tier FROM source_registry GROUP BY 1) ON source = s WHERE posting_key IS NOT NULL),
f AS (
  SELECT *, CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS nw, lower(regexp_extract(u, '(?i)^https?://[^/?#\\s]+\\.[^/?#\\s]+/+([^#\\s]+)', 1)) AS path FROM r),
g AS (
  SELECT *, nw >= 30 AND NOT regexp_matches(t, {_q(NO_TEXT)}) AND NOT regexp_matches(t, {_q(CUT_MARK)}) AND regexp_matches(regexp_replace(t, '\\s+$', ''), {_q("[.!?。।)\"'»”]$")}) AS d_ok,
    regexp_matches(u, '(?i)^mailto:[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') OR (path <> '' AND NOT regexp_matches(path, {_q(DEAD_PATH)}) AND NOT starts_with(path, '?') AND NOT regexp_matches(path, '/(?:login|signin|sign-in|404|error)(?:[/?.]|$)')) AS u_ok,
    c NOT IN ({', '.join(map(_q, NO_CHANNEL))}) AS c_ok FROM f),
h AS (SELECT *, max(CASE WHEN d_ok THEN nw END) OVER (PARTITION BY posting_key) AS most, count(*) OVER (PARTITION BY posting_key) AS n FROM g),
d AS (SELECT posting_key, capture_id FROM h WHERE d_ok AND nw >= 0.65 * most QUALIFY row_number() OVER (PARTITION BY posting_key ORDER BY fetched_at DESC NULLS LAST, capture_id) = 1),
u AS (SELECT posting_key, capture_id FROM h WHERE u_ok QUALIFY row_number() OVER (PARTITION BY posting_key ORDER BY tier, fetched_at DESC NULLS LAST, capture_id) = 1),
c AS (SELECT posting_key, capture_id FROM h WHERE c_ok QUALIFY row_number() OVER (PARTITION BY posting_key ORDER BY tier, fetched_at DESC NULLS LAST, capture_id) = 1)
SELECT k.posting_key, d.capture_id AS description_capture_id, u.capture_id AS url_capture_id, c.capture_id AS channel_capture_id
FROM (SELECT DISTINCT posting_key FROM h WHERE n >= 2) k LEFT JOIN d USING (posting_key) LEFT JOIN u USING (posting_key) LEFT JOIN c USING (posting_key)
"""

_P1_RECORDS = _P1[: _P1.rindex("SELECT k.posting_key")] + """, v AS (SELECT capture_id, max(description_text) AS t, max(application_url) AS u, max(trim(apply_channel)) AS c FROM raw_posting GROUP BY 1)
SELECT k.posting_key, k.n AS n_records, vd.t AS description_text, vu.u AS application_url, vc.c AS apply_channel
FROM (SELECT DISTINCT posting_key, n FROM h) k LEFT JOIN d USING (posting_key) LEFT JOIN u USING (posting_key) LEFT JOIN c USING (posting_key)
LEFT JOIN v vd ON vd.capture_id = d.capture_id LEFT JOIN v vu ON vu.capture_id = u.capture_id LEFT JOIN v vc ON vc.capture_id = c.capture_id
"""

_P2 = """
WITH w AS (SELECT id, regexp_extract_all(lower(description_text), '[\\p{L}\\p{N}]+') AS ws FROM jobs WHERE description_text IS NOT NULL),
s AS (SELECT DISTINCT id, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS sh FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS k) WHERE len(ws) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2)
SELECT x AS job_id_a, y AS job_id_b FROM p JOIN n n1 ON n1.id = x JOIN n n2 ON n2.id = y WHERE common >= 0.5 * (n1.n + n2.n - common)
"""

_P2_CLASSES = """
WITH w AS (SELECT id, description_text AS t, regexp_extract_all(lower(description_text), '[\\p{L}\\p{N}]+') AS ws FROM jobs WHERE description_text IS NOT NULL),
c AS (SELECT t, min(id) AS class_job_id, count(*) AS copies, any_value(ws) AS ws FROM w WHERE len(ws) >= 3 GROUP BY 1),
s AS (SELECT DISTINCT class_job_id AS id, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS sh FROM c, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS k)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n n1 ON n1.id = x JOIN n n2 ON n2.id = y WHERE common >= 0.5 * (n1.n + n2.n - common)),
k AS (SELECT id, count(*) AS links FROM (SELECT x AS id FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
SELECT w.id AS job_id, class_job_id, copies, coalesce(links, 0) AS links FROM w JOIN c USING (t) LEFT JOIN k ON k.id = class_job_id
"""

_P8 = """
WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 11], '') AS g FROM q, LATERAL (SELECT unnest(range(1, len(ws) - 10)) AS k) WHERE len(ws) >= 12),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN iw ON contains(s, g)
"""

_P6 = """
SELECT field, count(*) AS n FROM (SELECT 'city' AS field FROM jobs WHERE city <> '' UNION ALL SELECT 'raw_label' FROM form_question WHERE raw_label <> '') GROUP BY 1
"""

_P6_TOKENS = """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(lower(strip_accents(replace(city, 'ß', 'ss'))), '[''’]', '', 'g'), '[\\p{L}\\p{N}]+')) AS token FROM jobs WHERE city <> ''),
v AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(lower(strip_accents(replace(n, 'ß', 'ss'))), '[''’]', '', 'g'), '[\\p{L}\\p{N}]+')) AS w
  FROM (SELECT city AS n FROM city_ref UNION ALL SELECT unnest(other_names) FROM city_ref)),
p AS (SELECT token, w, damerau_levenshtein(token, w) AS d, CASE WHEN least(length(token), length(w)) <= 2 THEN 0 WHEN least(length(token), length(w)) <= 5 THEN 1 ELSE 2 END AS most FROM t, v),
m AS (SELECT token, w, d, min(d) OVER (PARTITION BY token) AS least_d FROM p WHERE d <= most)
SELECT t.token, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (d = least_d), '') AS nearest FROM t LEFT JOIN m USING (token) WHERE NOT regexp_matches(t.token, '^[0-9]+$') GROUP BY 1
"""

ORACLES = {"p1_records": _P1_RECORDS, "p2_classes": _P2_CLASSES, "p6_tokens": _P6_TOKENS, "p1_found": _P1, "p2_found": _P2, "p8_found": _P8, "p6_counts": _P6}
