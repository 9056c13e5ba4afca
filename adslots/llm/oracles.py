"""DuckDB SQL of the registered queries that SQL can express, over whole tables."""

OP6 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
wins AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, stratum, len(ws) AS n_words, len(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CAST(least(100, ceil(CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols / CAST(word_chars AS DOUBLE) END / 0.01::DOUBLE)) AS INT),
     CAST(least(100, ceil(CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines / CAST(n_lines AS DOUBLE) END / 0.01::DOUBLE)) AS INT),
     CAST(least(100, ceil(CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words / CAST(n_words AS DOUBLE) END / 0.01::DOUBLE)) AS INT),
     CAST(least(100, ceil(CASE WHEN n_words = 0 THEN 0 ELSE word_chars / CAST(n_words AS DOUBLE) END / 0.25::DOUBLE)) AS INT),
     CAST(least(100, ceil(CASE WHEN word_chars = 0 THEN 0 ELSE n_words / CAST(word_chars AS DOUBLE) END / 0.01::DOUBLE)) AS INT)] AS above
  FROM s),
l AS (SELECT doc_id, min(quality) > 0 AS good, md5(doc_id::VARCHAR) < '8' AS chooses FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
lab AS (SELECT row_number() OVER () AS rid, stratum, good, chooses, above FROM f JOIN l USING (doc_id) WHERE NOT base_failed),
tall AS (SELECT stratum, good, r AS rule, above[r] AS a FROM lab, range(1, 6) g(r) WHERE chooses),
n AS (SELECT stratum, rule, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad FROM tall GROUP BY ALL),
k AS (
  SELECT stratum, rule, step, count(*) FILTER (good AND a > step) AS k, count(*) FILTER (NOT good AND a > step) AS hit
  FROM tall, range(0, 100) g(step) GROUP BY ALL),
q AS (
  SELECT stratum, rule, step, hit / greatest(n_bad, 1)::DOUBLE - k / greatest(n, 1)::DOUBLE AS gain
  FROM k JOIN n USING (stratum, rule) WHERE k <= n * 0.02::DOUBLE),
best AS (
  SELECT stratum, rule, step FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step DESC) AS r FROM q WHERE gain > 0) WHERE r = 1),
c AS (SELECT rid, stratum, max(above[rule] - step) AS beyond FROM lab JOIN best USING (stratum) WHERE good AND NOT chooses GROUP BY rid, stratum),
cn AS (SELECT stratum, count(*) AS n FROM c GROUP BY stratum),
ct AS (SELECT stratum, t, count(*) FILTER (beyond > t) AS k FROM c, range(0, 101) g(t) GROUP BY ALL),
cp AS (
  SELECT stratum, t,
    CASE WHEN k > n * 0.02::DOUBLE THEN false ELSE
      (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02::DOUBLE) + (n - j) * ln(0.98::DOUBLE))) FROM range(0, k + 1) u(j))
      <= 0.05::DOUBLE / (SELECT count(DISTINCT stratum) FROM best) END AS ok
  FROM ct JOIN cn USING (stratum)),
cm AS (SELECT stratum, t, min(ok) OVER (PARTITION BY stratum ORDER BY t DESC) AS passes FROM cp),
slack AS (SELECT stratum, min(t) AS t FROM cm WHERE passes GROUP BY stratum),
rejected AS (
  SELECT DISTINCT doc_id FROM f JOIN best USING (stratum) JOIN slack USING (stratum) WHERE above[rule] > step + t)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM f LEFT JOIN rejected USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid),
t AS (SELECT *, max(k) OVER (PARTITION BY bid) AS n_terms FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY strlen(w) DESC, w) AS k
  FROM (SELECT DISTINCT bid, item_id, unnest(ws) AS w FROM b)) WHERE k <= 3),
dp AS (SELECT * FROM (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM t)),
nr AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM (
  SELECT c.rid, c.p, t.bid, t.item_id, count(DISTINCT o.k) AS others FROM dp c JOIN t ON c.w = t.w AND t.k = 1 AND t.n_terms = 3
    JOIN t o ON o.bid = t.bid AND o.k > 1 JOIN dp x ON x.rid = c.rid AND x.w = o.w AND abs(x.p - c.p) <= 10 GROUP BY ALL) WHERE others = 2 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid) LEFT JOIN nr USING (rid)
"""

OP3 = r"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(say, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fit AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(say, len(rule)) AS said FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
sh AS (SELECT hp.*, rule, said, array_to_string(s, '/') AS shape
  FROM (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
    CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' WHEN regexp_full_match(x, '[0-9]+\.[A-Za-z]+') THEN '#' || regexp_extract(x, '\.[A-Za-z]+$')
         WHEN regexp_full_match(x, '[0-9a-fA-F-]{8,}') THEN '#x' ELSE x END) AS s FROM hp) hp LEFT JOIN fit USING (page_id)),
p AS (SELECT host, shape, s, count(*) AS n, count(said) AS lab, count(*) FILTER (said = 'block') AS bad FROM sh GROUP BY ALL),
g AS (SELECT host, shape, s, n, lab, bad, 0 AS k, '' AS before FROM p WHERE len(s) > 0
  UNION ALL SELECT host, shape, s, n, lab, bad, k + 1, before || '/' || CASE WHEN NOT named THEN part WHEN bn < 3 THEN '*'
    WHEN k_all > 1 AND NOT coalesce((a + b + c + d) * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0) > 6.63, false)
      AND NOT coalesce((a2 + b2 + c2 + d2) * (a2 * d2 - b2 * c2) * (a2 * d2 - b2 * c2) / nullif((a2 + b2) * (c2 + d2) * (a2 + c2) * (b2 + d2), 0) > 6.63, false) THEN '*' ELSE part END
  FROM (SELECT *, m::DOUBLE AS a, (bn - m)::DOUBLE AS b, (m_all - m)::DOUBLE AS c, (n_all - bn - m_all + m)::DOUBLE AS d,
      bb::DOUBLE AS a2, (bl - bb)::DOUBLE AS b2, (bad_all - bb)::DOUBLE AS c2, (lab_all - bl - bad_all + bb)::DOUBLE AS d2
    FROM (SELECT *, max(place) OVER v AS k_all, sum(n) OVER v AS n_all, sum(lab) OVER v AS lab_all, sum(bad) OVER v AS bad_all, sum(CASE WHEN number THEN n ELSE 0 END) OVER v AS m_all
      FROM (SELECT *, dense_rank() OVER (PARTITION BY host, before, kind, named ORDER BY part) AS place
        FROM (SELECT *, 2 * m >= bn AS kind
          FROM (SELECT *, sum(n) OVER w AS bn, sum(lab) OVER w AS bl, sum(bad) OVER w AS bb, sum(CASE WHEN number THEN n ELSE 0 END) OVER w AS m
            FROM (SELECT *, s[k + 1] AS part, NOT starts_with(s[k + 1], '#') AS named, coalesce(starts_with(s[k + 2], '#'), false) AS number FROM g WHERE k < len(s))
            WINDOW w AS (PARTITION BY host, before, part))))
      WINDOW v AS (PARTITION BY host, before, kind, named)))),
tp AS (SELECT host, shape, before AS template FROM g WHERE k = len(s)),
pt AS (SELECT p.host, p.shape, n, lab, bad, coalesce(template, '') AS template FROM p LEFT JOIN tp USING (host, shape)),
leaf AS (SELECT host, template, sum(n)::BIGINT AS n, sum(lab)::BIGINT AS lab, sum(bad)::BIGINT AS bad FROM pt GROUP BY ALL),
ho AS (SELECT host, sum(lab)::BIGINT AS lab_h, sum(bad)::BIGINT AS bad_h FROM leaf GROUP BY ALL),
w AS (SELECT (coalesce(sum(bad_h), 0)::DOUBLE + 1) / (coalesce(sum(lab_h), 0)::DOUBLE + 2) AS p_all FROM ho),
v AS (SELECT host, template, (bad + 4.0::DOUBLE * ((bad_h + 4.0::DOUBLE * p_all) / (lab_h + 4.0::DOUBLE))) / (lab + 4.0::DOUBLE) >= 0.8::DOUBLE AND lab >= 5 AND lab >= 0.5::DOUBLE * n AS rejected FROM leaf JOIN ho USING (host), w)
SELECT page_id, sh.host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, pt.template
FROM sh JOIN pt ON pt.host = sh.host AND pt.shape = sh.shape JOIN v ON v.host = pt.host AND v.template = pt.template
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM top AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
