"""SQL over the given tables for the operators that SQL can express."""

from __future__ import annotations

from tracewell.llm.mixing import BLOCK, PERIOD, TEMPERED
from tracewell.llm.urls import HOST_RULES, PATTERNS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS k FROM pages),
m AS (SELECT k, max(page_id) AS keeper FROM d GROUP BY k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM d JOIN m USING (k)"""

MIXING = f"""
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, pow(n::DOUBLE, {TEMPERED}) / sum(pow(n::DOUBLE, {TEMPERED})) OVER () * ({PERIOD} - count(*) OVER ()) AS exact, count(*) OVER () AS k FROM counts),
shares AS (SELECT source, n, (floor(exact) + 1 + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source) <= {PERIOD} - k - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM w),
s AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares, list(n ORDER BY source) AS ns FROM shares),
run(t, pick, before, done) AS (
  SELECT -1, 0::BIGINT, list_transform(shares, lambda x: 0::BIGINT), list_transform(shares, lambda x: 0::BIGINT) FROM s
  UNION ALL SELECT t + 1, p.pick, done, list_transform(done, lambda x, i: CASE WHEN i = p.pick THEN x + 1 ELSE x END)
  FROM run, s, LATERAL (SELECT list_sort(list_filter(list_transform(done, lambda x, i: CASE WHEN x < shares[i] AND x * {PERIOD} // shares[i] <= t + 1 THEN [ceil((x + 1) * {PERIOD}::DOUBLE / shares[i])::BIGINT, i] END), lambda y: y IS NOT NULL))[1][2] AS pick) p
  WHERE t < {PERIOD - 1}),
plan AS (SELECT t, names[pick] AS source, before[pick] AS nth, shares[pick] AS share, before, shares, ns FROM run, s WHERE t >= 0),
ranked AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR)) - 1 AS r FROM documents),
blocks AS (SELECT doc_id, r.source, r, r // {BLOCK} AS block, r // {BLOCK} // share AS round, r // {BLOCK} % share AS nth FROM ranked r JOIN shares USING (source))
SELECT b.doc_id, b.source, b.block, b.round * {PERIOD} + t AS slot, (list_sum(list_transform(before, lambda x, i: least(ns[i], (b.round * shares[i] + x) * {BLOCK}))) + r % {BLOCK})::BIGINT AS position
FROM blocks b JOIN plan p ON p.source = b.source AND p.nth = b.nth"""

VECTORS = """
WITH RECURSIVE pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT x, count(*) AS n FROM pairs GROUP BY x) ON x = vec_id LEFT JOIN (SELECT x AS z, min(y) AS low FROM reach GROUP BY x) ON z = vec_id"""

MINHASH = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) ON x = d.doc_id"""


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

NEGATIVES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scored AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT a, b AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b))::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM near JOIN scored USING (a) WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= 10"""


def _codes(parts: int, entries: int, rounds: int) -> str:
    assigned = "SELECT p.vec_id, p.part, arg_min(c.entry, d.d * 16 + c.entry) AS entry, min(d.d) AS error FROM p JOIN c{i} c USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) d GROUP BY p.vec_id, p.part"
    moved = """
a{i} AS MATERIALIZED ({assigned}),
s{i} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM p JOIN a{i} USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY ALL),
c{j} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (part, entry)),"""
    steps = "".join(moved.format(i=i, j=i + 1, assigned=assigned.format(i=i)) for i in range(rounds))
    return f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {_WHOLE}),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS x FROM w, (SELECT unnest(range({parts})) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM w QUALIFY entry < {entries}),
c0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN first USING (vec_id)),{steps}
given AS MATERIALIZED ({assigned.format(i=rounds)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM given GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN w USING (vec_id), book"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _urls() -> str:
    ruled = " ".join(
        f"WHEN (host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)}) THEN {_quoted(v + ' ' + h + p)}" for v, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    tried = " ".join(f"WHEN regexp_matches(lower(url), {_quoted(p.regex)}) THEN {_quoted(p.id)}" for p in sorted(PATTERNS, key=lambda p: (p.verdict != "block", p.id)))
    blocked = ", ".join(_quoted(p.id) for p in PATTERNS if p.verdict == "block")
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {ruled} END AS r FROM parts),
tried AS (SELECT *, CASE WHEN r IS NULL THEN CASE {tried} END END AS pattern FROM ruled)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, CASE WHEN r IS NOT NULL THEN split_part(r, ' ', 1) WHEN pattern IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict, pattern FROM tried"""


ORACLE = {"op1_warc": WARC, "op2_mixing": MIXING, "op5_vectors": VECTORS, "op8_minhash": MINHASH, "op10_url_filter": _urls(), "op11_hard_negatives": NEGATIVES, "op13_vector_codes": _codes(8, 16, 6)}
