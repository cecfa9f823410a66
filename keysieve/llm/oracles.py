"""The registered queries as plain SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from keysieve.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SALT
from keysieve.llm.common import LOWER, UPPER
from keysieve.llm.decontam import WINDOW
from keysieve.llm.divergence import LEAST_DOCUMENTS, TOP_TERMS
from keysieve.llm.lines import LEAST_LENGTH

ASCII_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

MINHASH = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)])
    WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = doc.doc_id AS kept
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id JOIN least ON least.a = doc.doc_id
"""

LINES = f"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM cut),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {LEAST_LENGTH} GROUP BY key),
marked AS (SELECT k.*, coalesce(owner <> doc_id, false) AS gone FROM keyed k LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORDS = f"regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""
WITH doc AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
item AS MATERIALIZED (SELECT item_id, {WORDS} AS w FROM benchmark),
cut AS MATERIALIZED (
  SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS s FROM item WHERE len(w) > 0),
win AS MATERIALIZED (SELECT item_id, list_slice(w, s, s + least(len(w), {WINDOW}) - 1) AS words, least(len(w), {WINDOW}) AS n FROM cut),
sizes AS MATERIALIZED (SELECT DISTINCT n FROM win),
spot AS MATERIALIZED (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc, sizes WHERE len(w) >= n),
hit AS MATERIALIZED (
  SELECT doc_id, item_id, s, spot.n FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS words FROM spot) spot
  JOIN win ON win.n = spot.n AND win.words = spot.words),
covered AS MATERIALIZED (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit)
  GROUP BY doc_id),
found AS MATERIALIZED (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered ON covered.doc_id = doc.doc_id LEFT JOIN found ON found.doc_id = doc.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def centroids_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The rounds one after another; every distance is taken."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, arg_min(n, (d, n)) AS n, min(d) AS d FROM (
    SELECT rid, vec_id, n, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d
    FROM v, c{n}) GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""
sum{n} AS MATERIALIZED (
  SELECT n, place, sum(CAST(x AS BIGINT)) AS s, count(*) AS m FROM (
    SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{n} JOIN v USING (rid)) GROUP BY n, place),
mean{n} AS MATERIALIZED (
  SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY place) AS c FROM sum{n} GROUP BY n),
c{n + 1} AS MATERIALIZED (SELECT n, coalesce(mean{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN mean{n} USING (n))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
first AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS n FROM v),
c0 AS MATERIALIZED (SELECT n, v AS c FROM first WHERE n < {k}),{",".join(steps)},
inner_sum AS MATERIALIZED (SELECT n, CAST(sum(d) AS BIGINT) AS s FROM near{rounds} GROUP BY n)
SELECT vec_id, CAST(n AS INT) AS cluster, d AS distance, s AS cluster_inertia,
       (SELECT CAST(sum(s) AS BIGINT) FROM inner_sum) AS inertia,
       sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c], ',')) AS centroid_sha256
FROM near{rounds} JOIN inner_sum USING (n) JOIN c{rounds} USING (n)
"""


DIVERGENCE = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occurring AS MATERIALIZED (SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(w) AS term FROM doc)
  GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM occurring GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
size AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM doc),
cell AS MATERIALIZED (
  SELECT lang, source, term, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grp JOIN (SELECT lang, term FROM kept) k USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM occurring GROUP BY ALL) c USING (lang, source, term)),
total AS MATERIALIZED (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
share AS MATERIALIZED (
  SELECT lang, source, term, cell.n, CAST(1 + (1000000000 * (cell.n + 2)) // (total.n + 2 * v) AS BIGINT) AS p
  FROM cell JOIN total USING (lang, source) JOIN size USING (lang)),
pair AS MATERIALIZED (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
telling AS MATERIALIZED (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM share
  JOIN (SELECT lang, term, CAST(1 + (1000000000 * (kept.n + 2)) // (size.n + 2 * v) AS BIGINT) AS q FROM kept JOIN size USING (lang))
  USING (lang, term) WHERE n > 0 AND p > q),
part AS MATERIALIZED (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a
  JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM telling),
ranked AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM part)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

ORACLES = {
    "op2_minhash": MINHASH,
    "op6_lines": LINES,
    "op8_decontamination": DECONTAMINATION,
    "op10_topk": TOP_K,
    "op12_centroids": centroids_sql(),
    "op13_divergence": DIVERGENCE,
}
