"""DuckDB text of the queries of vector codes and spelling variants."""

from __future__ import annotations


def vector_codes_sql(rounds: int) -> str:
    """The rounds written out; integers are exact in doubles."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, x.p, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS m
  FROM x JOIN c{k} ON x.p = c{k}.p GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, e, list(v ORDER BY i) AS c FROM (
  SELECT p, m.e AS e, i, floor(sum(x[i]) / count(*)) AS v FROM a{k}, range(1, 17) AS t(i) GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * 16 + 1:p * 16 + 16] AS x FROM ok, range(4) AS t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 256),{",".join(steps)},
books AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, c[i] AS v FROM c{rounds}, range(1, 17) AS t(i))),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books
"""


#: CRC-32 by its table of 256 entries, which the first common table derives from the reversed polynomial.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(b))),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM bytes, crc),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS MATERIALIZED (
  SELECT word, n, i, word[1:i - 1] || '?' || word[i + 1:] AS hole, word[1:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON g.rest = w.word
  UNION SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON g.rest = w.word),
near AS (SELECT a AS word, count(*) AS n_near, min({'n': -n, 'w': b}) AS best FROM pairs GROUP BY a),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 5 * w.n THEN best.w END AS form, CASE WHEN -best.n >= 5 * w.n THEN -best.n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk(word, tip, k) AS (
  SELECT word, form, 1 FROM formed WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN formed f ON w.tip = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(tip, k) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN last USING (word)
"""
