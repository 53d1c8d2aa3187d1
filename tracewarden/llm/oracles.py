"""DuckDB SQL for the queries of this folder that SQL can express on whole tables."""

from tracewarden.llm import licences

# Rows of documents as the operators read them: one per id, nulls as no words.
SPACED = r"regexp_extract_all(coalesce(max(text), ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(max(text), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RUNS = f"""
d AS (SELECT doc_id, {SPACED} AS w FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
runs AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + %(size)d - 1), ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - %(size)d + 2)) AS k FROM d)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY run) AS least FROM runs) WHERE doc_id > least),
cut AS (SELECT DISTINCT doc_id, unnest(range(k, k + %(size)d)) AS k FROM later)
"""

SUBSTRING = f"""
WITH {_RUNS % {"size": 13}},
gone AS (SELECT doc_id, list(k) AS ks FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

SUFFIX = f"""
WITH {_RUNS % {"size": 50}},
marked AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS opens FROM later),
numbered AS (SELECT doc_id, k, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM marked),
joined AS (SELECT doc_id, span, min(k) - 1 AS a, max(k) + 49 AS b FROM numbered GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n, string_agg(concat(a, '-', b), ',' ORDER BY a) AS l FROM joined GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS c FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_duplicate,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, coalesce(l, '') AS span_list
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS all_of FROM shingles GROUP BY doc_id),
classed AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, all_of) AS class_id FROM sized),
chosen AS (SELECT doc_id, n FROM classed WHERE doc_id = class_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM (SELECT s.* FROM shingles s SEMI JOIN chosen USING (doc_id)) a
  JOIN (SELECT s.* FROM shingles s SEMI JOIN chosen USING (doc_id)) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN chosen x ON x.doc_id = a JOIN chosen y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM chosen UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
lowest AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  coalesce(class_id, d.doc_id) AS class_id
FROM d LEFT JOIN classed ON d.doc_id = classed.doc_id LEFT JOIN lowest ON lowest.a = classed.class_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
parts AS (SELECT item_id, list_slice(w, k, k + 9) AS ws
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
uses AS (SELECT DISTINCT item_id, array_to_string(ws, ' ') AS win FROM parts),
wins AS (SELECT array_to_string(ws, ' ') AS win, any_value(ws) AS ws FROM parts GROUP BY 1),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM d),
counts AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
each AS (SELECT win, unnest(ws) AS t, unnest(range(0, len(ws))) AS o FROM wins),
ranked AS (SELECT win, t, o, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), o) AS r
  FROM each LEFT JOIN counts USING (t)),
alive AS (SELECT win FROM ranked GROUP BY win HAVING min(n) > 0),
anchor AS (SELECT win, t, r FROM ranked SEMI JOIN alive USING (win) WHERE r <= 3),
lead AS (SELECT win, doc_id, k FROM anchor JOIN tok USING (t) WHERE r = 1),
seen AS (SELECT DISTINCT lead.win, lead.doc_id, lead.k, a.r FROM lead JOIN anchor a ON a.win = lead.win AND a.r > 1
  JOIN tok ON tok.t = a.t AND tok.doc_id = lead.doc_id AND abs(tok.k - lead.k) <= 20),
needed AS (SELECT win, count(*) - 1 AS c FROM anchor GROUP BY win),
close AS (SELECT DISTINCT lead.win, lead.doc_id FROM lead JOIN needed USING (win)
  LEFT JOIN (SELECT win, doc_id, k, count(*) AS c FROM seen GROUP BY ALL) s
  ON s.win = lead.win AND s.doc_id = lead.doc_id AND s.k = lead.k WHERE coalesce(s.c, 0) = needed.c),
nearby AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN uses USING (win) GROUP BY doc_id),
sizes AS (SELECT DISTINCT len(ws) AS m FROM wins),
runs AS (SELECT doc_id, k, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes)),
hits AS (SELECT doc_id, k, m, win FROM runs SEMI JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hits JOIN uses USING (win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN nearby ON nearby.doc_id = d.doc_id
"""

LINES = """
WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM l),
h AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM n),
r AS (SELECT doc_id, i, line, (h + 31 * coalesce(lag(h) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS ends
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, line, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
g AS (SELECT doc_id, c, min(i) AS a, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS bytes FROM c GROUP BY doc_id, c),
f AS (SELECT doc_id, a, size, bytes, size > 1 AND row_number() OVER (PARTITION BY bytes ORDER BY doc_id, a) > 1 AS gone FROM g)
SELECT d.doc_id, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(sum(CASE WHEN gone THEN size ELSE 0 END), 0) AS BIGINT) AS n_removed,
  CASE WHEN max(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(bytes, chr(10) ORDER BY a) FILTER (WHERE NOT gone), '')) END AS kept_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""

# Every quotient of every source is ranked; the tables the driver compares have sources of one shard or a few.
MIXING = rf"""
WITH RECURSIVE d AS (SELECT doc_id, m.source AS source, CAST(len(regexp_extract_all(coalesce(m.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM (SELECT doc_id, max(struct_pack(text := text, source := source)) AS m FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM s),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t FROM w),
o AS (SELECT 3 * source_size / weight AS ratio, t, t - coalesce(sum(3 * source_size) OVER b, 0) AS rest, sum(weight) OVER a AS open
  FROM w, total WINDOW b AS (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  a AS (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT max(CAST(rest AS DOUBLE) / CAST(open AS DOUBLE)) AS l FROM (SELECT * FROM o WHERE rest / open <= ratio ORDER BY ratio LIMIT 1)),
g AS (SELECT w.*, least(CAST(3 * source_size AS DOUBLE), coalesce(l, 0.0) * weight) AS target FROM w, level),
q AS (SELECT place, target / (2 * j + 1) AS quotient
  FROM (SELECT place, target, unnest(range(0, CAST(floor(t / 16.0 + 0.5) AS BIGINT))) AS j FROM g, total)),
won AS (SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS r FROM q), total
  WHERE r <= floor(t / 16.0 + 0.5) GROUP BY place),
h AS (SELECT g.*, coalesce(quota, 0) AS quota, greatest(CAST(ceil(source_size / 2000000.0) AS BIGINT), 1) AS shards FROM g LEFT JOIN won USING (place)),
x AS (SELECT d.doc_id, d.size, h.*, CAST('0x' || substr(md5('shard:' || d.doc_id), 1, 12) AS BIGINT) % shards AS shard
  FROM d JOIN h ON h.source IS NOT DISTINCT FROM d.source),
y AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS quota FROM x GROUP BY place, shard),
z AS (SELECT place, shard, shard_size / (2 * j + 1) AS quotient, quota
  FROM (SELECT place, shard, shard_size, quota, unnest(range(0, quota)) AS j FROM y)),
v AS (SELECT place, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) AS r FROM z)
  WHERE r <= quota GROUP BY place, shard),
a AS (SELECT x.*, y.shard_size, least(coalesce(blocks, 0) * 16, 3 * shard_size) AS allowed,
  sum(x.size) OVER (PARTITION BY x.place, x.shard ORDER BY md5('mix:' || x.doc_id), x.doc_id) - x.size AS front
  FROM x JOIN y ON y.place = x.place AND y.shard = x.shard LEFT JOIN v ON v.place = x.place AND v.shard = x.shard)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN shard_size > 0 THEN (allowed // shard_size) * size + greatest(0, least(allowed % shard_size - front, size)) ELSE 0 END AS BIGINT) AS taken
FROM a
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT i, lang, source, t, count(*) AS n FROM (SELECT i, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT c.lang, c.source, c.t, sum(c.n) AS n FROM c SEMI JOIN kept ON kept.lang = c.lang AND kept.t = c.t GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.t, coalesce(cells.n, 0) AS n,
    1 + CAST((1000000000 * (coalesce(cells.n, 0) + 5)) // (coalesce(sizes.total, 0) + 5 * v) AS BIGINT) AS p,
    1 + CAST((1000000000 * (kept.n + 5)) // (l.total + 5 * v) AS BIGINT) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN sizes ON sizes.lang = g.lang AND sizes.source = g.source
  LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.t = kept.t),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""


HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _licences() -> str:
    rows, idf, other = licences.weights()
    known = ", ".join(f"('{n}', {i}, '{w}', {x})" for n, i, w, x in rows)
    worth = ", ".join(f"('{w}', {x})" for w, x in idf.items())
    return f"""
WITH known(licence, template, word, weight) AS (SELECT a, b, c, CAST(d AS DOUBLE) FROM (VALUES {known}) t(a, b, c, d)),
worth(word, idf) AS (SELECT a, CAST(b AS DOUBLE) FROM (VALUES {worth}) t(a, b)),
docs AS (SELECT doc_id, m.text AS text, coalesce(m.lang, 'none') AS lang, coalesce(m.source, 'none') AS source
  FROM (SELECT doc_id, max(struct_pack(text := text, lang := lang, source := source)) AS m FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)),
files AS (SELECT text, CASE WHEN coalesce(lower(string_split(text, chr(10))[1]) LIKE '%licen%', false)
  THEN (CASE WHEN length(text) < 300 THEN source WHEN length(text) < 1000 THEN source || '/' || lang
    ELSE source || '/' || lang || '/' || (doc_id // 100) END) || '/LICENSE.' || doc_id
  ELSE source || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM docs),
lines AS (SELECT DISTINCT path, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files WHERE text IS NOT NULL)),
tf AS (SELECT line, word, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word
  FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
valued AS (SELECT line, word, tf * coalesce(idf, {other}) AS value FROM tf LEFT JOIN worth USING (word)),
norms AS (SELECT line, sqrt(sum(value * value)) AS norm FROM valued GROUP BY line),
dots AS (SELECT line, licence, template, sum(value * weight) AS dot FROM valued JOIN known USING (word) GROUP BY ALL),
scores AS (SELECT path, licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (line) JOIN lines USING (line)
  WHERE round(dot / norm, 6) >= {licences.THRESHOLD}),
own AS (SELECT path, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) AS r FROM scores) WHERE r = 1),
speaking AS (SELECT * FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, licence, score,
  row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, licence, path) AS r FROM own
  WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licences.LICENCE_FILE}')) WHERE r = 1),
up AS (SELECT path, s.folder AS from_folder, s.licence, s.score, row_number() OVER (PARTITION BY path ORDER BY length(s.folder) DESC) AS r
  FROM files JOIN speaking s ON starts_with(path, s.folder || '/'))
SELECT files.path, coalesce(own.licence, up.licence) AS licence, coalesce(own.score, up.score) AS score,
  CASE WHEN own.path IS NOT NULL THEN 'own' WHEN up.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own.path IS NULL THEN up.from_folder END AS from_folder
FROM files LEFT JOIN own ON own.path = files.path LEFT JOIN up ON up.path = files.path AND up.r = 1
"""


ORACLES = {
    "op4_license_scan": _licences(),
    "op8_source_mixing": MIXING,
    "op2_line_dedup": LINES,
    "op5_benchmark_decontamination": DECONTAMINATION,
    "op6_substring_dedup": SUBSTRING,
    "op7_ngram_jaccard_join": NGRAM_JOIN,
    "op10_suffix_array_dedup": SUFFIX,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_source_divergence": DIVERGENCE,
}
