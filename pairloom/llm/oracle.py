"""SQL twins of the registered queries, where SQL can say the same on whole tables."""

LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, p AS pos, lines[p] AS a, lines[p + 1] AS b, lines[p + 2] AS c
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM l)
),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w)
  WHERE n > 1
),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) v(k)),
each AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM l),
cut AS (
  SELECT e.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (c.pos IS NULL), '') AS kept
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)
"""

WORDS_4 = r"regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS_4} AS w FROM documents),
b AS (SELECT item_id, {WORDS_4} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
),
occ AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY 1),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

WORDS_5 = r"regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_5} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + 4) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.size + ny.size - k)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x
)
SELECT doc_id, coalesce(any_value(size), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP6 = f"""
WITH t AS (SELECT doc_id, {LOWERED.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, list_slice(w, p, p + 12) AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)
),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY words) AS first FROM win) WHERE doc_id > first
),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM later),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
cut AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

# Fixed values of the default template: marks around a turn by role, and control strings
# as first character and rest.
OP11 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(INST|SYS|ROLE)\]|\[\\*/TURN\]')) AS n_text,
         length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(INST|SYS|ROLE)\]|\[\\*/TURN\]')) AS n_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 20 + n_role END) AS BIGINT)
         AS formatted_chars
FROM f GROUP BY conv_id
"""

WORDS_12 = r"regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT doc_id, {WORDS_12} AS w FROM documents),
q AS (SELECT item_id, unnest({WORDS_12}) AS t FROM benchmark),
lens AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lens),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
idf AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, nn),
x AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nn) // ll)))) AS x
  FROM tf JOIN idf USING (t) JOIN lens USING (doc_id), total
),
s AS (SELECT item_id, doc_id, CAST(sum(c * x) AS BIGINT) AS score FROM (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL) JOIN x USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

# DuckDB has no crc32, so it is worked out bit by bit over the digits: each byte, then 8 steps.
OP13 = """
WITH RECURSIVE o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT DISTINCT c FROM o),
crc(c, step, r) AS (
  SELECT c, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (
    SELECT c, step, CASE WHEN step % 8 = 0 THEN xor(r, CAST(ascii(substr(CAST(c AS VARCHAR), step // 8 + 1, 1)) AS BIGINT)) ELSE r END AS x
    FROM crc WHERE step < 8 * length(CAST(c AS VARCHAR))
  )
),
h AS (SELECT c, c - c % 5 AS b, xor(r, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE step = 8 * length(CAST(c AS VARCHAR))),
rebuilt AS (
  SELECT h.c, 0 AS part, pos, role, text FROM h JOIN o ON o.c = h.b AND pos < h
  UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN o ON o.c = h.c AND pos >= h
),
seq AS (
  SELECT c, list(sha256(role || chr(0) || text) ORDER BY part, pos) AS s, list(strlen(text) ORDER BY part, pos) AS sizes FROM rebuilt GROUP BY c
),
every AS (SELECT h.c, coalesce(s, []) AS s, coalesce(sizes, []) AS sizes FROM h LEFT JOIN seq USING (c)),
m AS (
  SELECT c, d, list_slice(s, 1, d) AS p, len(s) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM every)
),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids
  FROM m GROUP BY p, d
),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
named AS (SELECT c, m.d, conv_id, n_convs, nodes.size, kids.n IS NULL AS leaf FROM m JOIN nodes USING (p) LEFT JOIN kids USING (p)),
under AS (
  SELECT a.d, a.conv_id, b.d AS e, b.conv_id AS k, any_value((b.n_convs - 1) * b.size) AS saved, any_value(b.leaf) AS leaf
  FROM named a JOIN named b ON a.c = b.c AND b.d >= a.d GROUP BY ALL
),
totals AS (SELECT d, conv_id, count_if(leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN totals t ON t.d = n.d AND t.conv_id = n.conv_id LEFT JOIN kids ON kids.p = n.p
LEFT JOIN nodes up ON n.d > 0 AND up.p = list_slice(n.p, 1, n.d - 1)
"""

ORACLES = {
    "op3_line_dedup": OP3,
    "op4_decontamination": OP4,
    "op5_jaccard_join": OP5,
    "op6_exact_dedup": OP6,
    "op10_substring_dedup": OP10,
    "op11_chat_formatting": OP11,
    "op12_lexical_search": OP12,
    "op13_prefix_trie": OP13,
}
