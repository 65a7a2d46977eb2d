"""DuckDB SQL of the operators on vectors, repeated bytes and spelling variants."""

from __future__ import annotations


def _round(i: int, members: str) -> str:
    """One assignment of all vectors, and the centroids that follow from it."""
    return f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v.v) AS v,
         min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda k: (v.v[k] - m.v[k]) * (v.v[k] - m.v[k])))::BIGINT, c := m.c)) AS best
  FROM vectors v CROSS JOIN {members} m GROUP BY vec_id),
means{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v
  FROM (SELECT best.c AS c, k, sum(v[k])::BIGINT AS s, count(*)::BIGINT AS n FROM near{i}, range(1, 65) r(k) GROUP BY 1, 2) GROUP BY c),
centroids{i} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM {members} o LEFT JOIN means{i} n USING (c))"""


OP11_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16),
{",".join(_round(i, f"centroids{i - 1}") for i in (1, 2, 3))},
{_round(4, "centroids3")}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near4 JOIN centroids3 m ON m.c = best.c
"""

#: Windows are told apart by their MD5.
OP12_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(octet_length(x) - 99)) AS p,
         unnest(list_transform(range(octet_length(x) - 99), lambda i: md5(x[i + 1 : i + 100]))) AS w
  FROM d WHERE octet_length(x) >= 100),
firsts AS (SELECT w, min(struct_pack(doc_id := doc_id, p := p)) AS f FROM windows GROUP BY w HAVING count(*) > 1),
again AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE doc_id <> f.doc_id OR p <> f.p),
starts AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 IS NOT TRUE AS opens FROM again),
runs AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(hex(x[a + 1 : coalesce(b, octet_length(x))]), '' ORDER BY a) AS h
              FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
sizes AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(unhex(h), x)) AS kept_sha256
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

#: CRC-32 is worked out byte by byte over a table made by its rule.
OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce([b::BIGINT] || range(8), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) ORDER BY b) AS t FROM range(256) r(b)),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
runs AS MATERIALIZED (
  SELECT run, k, hex(encode(doc_id || ':' || run)) AS x FROM (SELECT doc_id, run, count(*) AS k FROM found GROUP BY ALL)),
hashed AS (
  SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
results AS (
  SELECT if(h % 31 = 0, left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2), run) AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
shorter AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 1000) r(i) WHERE i <= length(word)),
near AS (
  SELECT DISTINCT s.word, w.word AS other FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT DISTINCT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT a.word, b.word FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, min(struct_pack(m := -n, other := other)) AS b FROM near JOIN words ON words.word = other GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, if(-b.m >= 10 * n, b.other, NULL) AS form, if(-b.m >= 10 * n, -b.m, NULL)::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT max_by(root, step) FROM walk w WHERE w.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
