"""DuckDB SQL for the rows of the operators that SQL can express."""

from emberline.llm.licenses import TEMPLATES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '-') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
dl AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM dl
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) r USING (doc_id, g)),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) t(k) GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
         FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
hosts AS (SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host),
common AS (SELECT host, line FROM norm JOIN hosts USING (host) WHERE line <> '' GROUP BY host, line, documents
           HAVING count(DISTINCT text) >= 5 AND count(DISTINCT text) > 0.05 * documents),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM norm JOIN common USING (host, line) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
         FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_common_words, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 2 * (n_words - n_common_words) < n_words AS kept
FROM base"""

_W3 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT doc_id, {_W3} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_W3} AS w FROM benchmark)),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b WHERE k > 0)),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_TEMPLATES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_NORMAL = "list_filter(regexp_split_to_array(lower({}), '[^0-9a-z]+'), lambda x: x <> '')"

OP10 = f"""
WITH t AS (SELECT i, license, {_GRAMS} AS g FROM (SELECT i, license, {_NORMAL.format('t')} AS w FROM (VALUES {_TEMPLATES}) v(i, license, t))),
u AS (SELECT doc_id, n, {_GRAMS} AS g FROM (SELECT doc_id, row_number() OVER () AS n, {_NORMAL.format('line')} AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))),
s AS (SELECT doc_id, n, license, 2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice
      FROM u JOIN t ON len(u.g) BETWEEN len(t.g) * 2 / 3.0 - 0.001 AND len(t.g) * 1.5 + 0.001),
best AS (SELECT doc_id, count(DISTINCT n) AS n, max(struct_pack(d := dice, l := license)) AS b FROM s WHERE dice >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_units, b.l AS license, CAST(coalesce(b.d, 0) AS DOUBLE) AS dice
FROM documents d LEFT JOIN best USING (doc_id)"""

_W1 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_W1} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS vec, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec) <= 5)
SELECT p.anchor AS anchor_id, p.vec AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.vec ORDER BY n.score DESC, n.vec) AS INTEGER) AS rank,
  n.vec AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""

_W13 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT doc_id, {_W13} AS w FROM documents WHERE len({_W13}) > 0),
g AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d),
m AS (SELECT doc_id, 100 - 90 + (90 * CAST(len(w) AS BIGINT) * N) // L AS m FROM d, g),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_W13}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
