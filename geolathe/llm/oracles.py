"""SQL that gives what the registered queries give, where SQL can: exact sets, counts, verdicts and neighbours."""

from __future__ import annotations

from . import ann, bitplanes, merkle, quality

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS t FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(lowest, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS lowest FROM reach GROUP BY a) r ON r.a = doc_id
"""

_VECTORS = "(SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0)"
NEIGHBOURS = f"""
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_distance(q.e, v.e) AS score FROM {_VECTORS} q JOIN {_VECTORS} v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
) WHERE rank <= {ann.K}
"""


def _rules() -> str:
    value = {k: f"ln((CAST({a} AS DOUBLE) + 1) / (CAST({b} AS DOUBLE) + 1))" for k, (a, b, _) in quality.MEASURES.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CAST(floor({v} / {quality.WIDTH}) AS INT) AS bucket FROM base WHERE NOT base_failed" for k, v in value.items())
    million, lent = quality.MILLION, quality.PRIOR * quality.MILLION
    high = {k: f"max(CASE WHEN measure = '{k}' THEN q75 + {quality.FENCE} * (q75 - q25) END) AS {k}_high" for k in value}
    low = {k: f"min(CASE WHEN measure = '{k}' THEN q25 - {quality.FENCE} * (q75 - q25) END) AS {k}_low" for k, m in quality.MEASURES.items() if m[2]}
    good = " AND ".join([f"{v} <= {k}_high" for k, v in value.items()] + [f"{value[k]} >= {k}_low" for k in low])
    at = lambda q: f"(min(CASE WHEN 100 * seen >= {q} * total THEN bucket END) + 0.5) * {quality.WIDTH}"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, {_WORDS})] AS lines FROM documents),
win AS (SELECT doc_id, unnest([{{'i': i, 'g': array_to_string(w[i:i + 4], ' ')}} FOR i IN range(1, len(w) - 3)], recursive := true) FROM t WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
 SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_shouts
 FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id)),
own AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({rows}) GROUP BY ALL),
whole AS (SELECT measure, bucket, sum(n) AS n FROM own GROUP BY measure, bucket),
corpus AS (SELECT *, sum(n) OVER (PARTITION BY measure) AS total FROM whole),
tongue AS (SELECT lang, measure, bucket, sum(n) AS n FROM (
 SELECT lang, measure, bucket, n * {million} AS n FROM own UNION ALL
 SELECT lang, g.measure, bucket, floor(CAST(n AS DOUBLE) * {lent} / CAST(total AS DOUBLE)) FROM (SELECT DISTINCT lang, measure FROM own) g JOIN corpus c ON g.measure = c.measure) GROUP BY ALL),
scaled AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS total FROM tongue),
merged AS (SELECT lang, source, measure, bucket, sum(n) AS n FROM (
 SELECT lang, source, measure, bucket, n * {million} AS n FROM own UNION ALL
 SELECT g.lang, g.source, g.measure, bucket, floor(CAST(n AS DOUBLE) * {lent} / CAST(total AS DOUBLE)) FROM (SELECT DISTINCT lang, source, measure FROM own) g JOIN scaled c ON g.measure = c.measure AND g.lang IS NOT DISTINCT FROM c.lang) GROUP BY ALL),
seen AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM merged),
q AS (SELECT lang, source, measure, {at(25)} AS q25, {at(75)} AS q75 FROM seen GROUP BY lang, source, measure),
fence AS (SELECT lang, source, {", ".join([*high.values(), *low.values()])} FROM q GROUP BY lang, source)
SELECT doc_id, {", ".join(quality.COUNTS[:5])}, base_failed, NOT base_failed AND coalesce({good}, true) AS kept, {", ".join([f"{k}_high" for k in high] + [f"{k}_low" for k in low])}
FROM base b LEFT JOIN fence f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


def _clusters() -> str:
    near = lambda c: f"(SELECT vec_id, x, d, rank FROM (SELECT v.vec_id, v.x, c.rank, list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, {bitplanes.COMPONENTS + 1})]) AS d FROM v, {c} c) QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY d, rank) = 1)"
    floored = "(list_sum(y) - ((list_sum(y) % len(y)) + len(y)) % len(y)) // len(y)"
    rounds = [
        f"c{k + 1} AS MATERIALIZED (SELECT c.rank, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT rank, list(m ORDER BY i) AS x FROM (SELECT rank, i, {floored} AS m FROM (SELECT rank, i, list(x[i]) AS y FROM {near(f'c{k}')}, (SELECT unnest(range(1, {bitplanes.COMPONENTS + 1})) AS i) GROUP BY rank, i)) GROUP BY rank) m ON m.rank = c.rank)"
        for k in range(bitplanes.ROUNDS)
    ]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor({bitplanes.SCALE} * CAST(e AS DOUBLE)) AS HUGEINT) FOR e IN embedding] AS x FROM embeddings WHERE len(embedding) = {bitplanes.COMPONENTS} AND len([e FOR e IN embedding IF e IS NULL OR isnan(e) OR abs(e) >= {bitplanes.LIMIT // bitplanes.SCALE}]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS rank, x FROM v QUALIFY rank < {bitplanes.CLUSTERS}),
{", ".join(rounds)},
last AS (SELECT * FROM {near(f"c{bitplanes.ROUNDS}")})
SELECT vec_id, CAST(l.rank AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.rank) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last l JOIN c{bitplanes.ROUNDS} c ON c.rank = l.rank
"""


def _manifest() -> str:
    tell = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(tell, [*merkle.FIELDS[:-1], text]))})"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ord(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    up = lambda t, by: f"SELECT {by}level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM (SELECT *, count(*) OVER ({'PARTITION BY source' if by else ''}) AS n FROM {t}) WHERE n > 1 GROUP BY {by}level, place // 3"
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 2 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS presented FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS id FROM docs),
low AS (SELECT source, CAST(0 AS BIGINT) AS level, place, leaf AS hash FROM leaves UNION ALL {up("low", "source, ")}),
height AS (SELECT source, max(level) AS height FROM low GROUP BY source),
sub AS (SELECT h.source, h.height, l.hash AS subroot, row_number() OVER (ORDER BY h.source NULLS FIRST) - 1 AS place FROM height h JOIN low l ON l.source IS NOT DISTINCT FROM h.source AND l.level = h.height),
high AS (SELECT CAST(0 AS BIGINT) AS level, place, subroot AS hash FROM sub UNION ALL {up("high", "")}),
top AS (SELECT level AS height, hash AS root FROM high ORDER BY level DESC LIMIT 1),
nodes AS MATERIALIZED (SELECT source, level, place, hash, 1 AS tier FROM low UNION ALL SELECT NULL, level, place, hash, 2 FROM high),
spots AS (SELECT d.id, d.source, 1 AS tier, k.level, d.place // CAST(pow(3, k.level) AS BIGINT) AS place FROM leaves d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(0, s.height)) AS level) k
 UNION ALL SELECT d.id, NULL, 2, k.level, s.place // CAST(pow(3, k.level) AS BIGINT) FROM leaves d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source, top, LATERAL (SELECT unnest(range(0, top.height)) AS level) k),
steps AS MATERIALIZED (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY a.tier, a.level) - 1 AS step, coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place < a.place), '') AS before, coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place > a.place), '') AS after
 FROM spots a JOIN nodes n ON n.tier = a.tier AND n.source IS NOT DISTINCT FROM a.source AND n.level = a.level AND n.place // 3 = a.place // 3 GROUP BY a.id, a.tier, a.level),
fold AS (SELECT id, CAST(0 AS BIGINT) AS step, presented AS h FROM leaves UNION ALL SELECT f.id, f.step + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.id = f.id AND s.step = f.step),
ends AS (SELECT id, arg_max(h, step) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY id)
SELECT d.doc_id, d.leaf, s.subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
FROM leaves d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source JOIN ends e ON e.id = d.id LEFT JOIN proofs p ON p.id = d.id, top t
"""


ORACLES = {"op2_quality_rules": _rules(), "op5_ngram_jaccard_join": JOIN, "op7_nearest_neighbours": NEIGHBOURS, "op11_bit_plane_clusters": _clusters(), "op13_merkle_manifest": _manifest()}
