"""DuckDB SQL for the registered queries that SQL can express. Words, windows and rules are written out here anew."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS row, coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT row, item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT row, item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, n, row, item FROM dw JOIN bw USING (n, win)
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, row, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, r)
), f AS (SELECT min(place) AS first, arg_min(level, place) AS level FROM l WHERE level <= cap / weight
), t AS (
  SELECT l.source, source_size, r % 3 AS kind, least(CASE WHEN place < f.first THEN CAST(cap AS DOUBLE) ELSE f.level * weight END, CAST(cap AS DOUBLE)) AS target
  FROM l, f
), p AS (
  SELECT d.doc_id, d.size, d.k, t.*,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (SELECT *, least(start / greatest(target, 1e-9), 1.0) AS share FROM p
), x AS (
  SELECT *, CASE kind WHEN 0 THEN 2 * share / (sqrt(greatest(2.25 - 2 * share, 0)) + 1.5) WHEN 1 THEN share
    ELSE CASE WHEN share * 1.125 < 0.375 THEN 2 * share * 1.125 / (sqrt(0.25 + 2 * share * 1.125) + 0.5)
         ELSE 0.5 + 2 * (share * 1.125 - 0.375) / (sqrt(1 + 4 * (share * 1.125 - 0.375)) + 1) END END AS due
  FROM u
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN 2 * start + size <= 2 * target THEN 1 ELSE 0 END + CASE WHEN 2 * (start + source_size) + size <= 2 * target THEN 1 ELSE 0 END
                  + CASE WHEN 2 * (start + 2 * source_size) + size <= 2 * target THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND 2 * start + size <= 2 * target THEN round(due, 6) END AS position
FROM x
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

FILTER_AUDIT = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), f AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > least, false)} AS f
  FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f
), o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), s AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS earlier FROM (SELECT o FROM o WHERE len(o) = 5), range(1, 6) r(step)
), fails AS (
  SELECT part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: struct_extract(f, 'A') AND x = 'A' OR struct_extract(f, 'B') AND x = 'B'
    OR struct_extract(f, 'C') AND x = 'C' OR struct_extract(f, 'D') AND x = 'D' OR struct_extract(f, 'E') AND x = 'E') AS names
  FROM c
), counts AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, x,
    sum(n) FILTER (NOT list_has_any(names, string_split(earlier || x, ''))) AS kept,
    sum(n) FILTER (list_contains(names, x) AND NOT list_has_any(names, string_split(earlier, ''))) AS removed,
    sum(n) FILTER (list_contains(names, x) AND list_has_any(names, string_split(earlier, ''))) AS redundant,
    sum(n) FILTER (names = [x]) AS unique_fails,
    sum(good) FILTER (list_contains(names, x) AND NOT list_has_any(names, string_split(earlier, ''))) AS good_lost,
    sum(toxic) FILTER (list_contains(names, x) AND NOT list_has_any(names, string_split(earlier, ''))) AS toxic_lost
  FROM fails, s GROUP BY part, o, step, x
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM counts
"""

FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), h AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d
  FROM t
), f AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
              WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""

CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, role || chr(10) || text AS said FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST]  [/INST].</s>.') + length(role) + length(text)
    + len(regexp_extract_all(said, '<\\*/?s>|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES = {
    "op13_chat_format": CHAT_FORMAT,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op11_filter_audit": FILTER_AUDIT,
    "op2_decontamination": CONTAMINATION,
    "op4_topk": TOP_K,
    "op6_mixing": MIXING,
    "op7_ngram_join": JACCARD,
}
