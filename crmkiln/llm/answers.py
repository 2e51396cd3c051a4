"""Answers in DuckDB's SQL to the queries of this folder that SQL can express, written apart from the operators."""

#: CRC-32 of a text ``s``, bit by bit as its polynomial (fixed value) says; ``t`` has the 256 steps of a byte.
_CRC_TABLE = """
crc_steps(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8)
"""


def _crc32(hexadecimal: str) -> str:
    byte = f"('0x' || {hexadecimal}[2 * i + 1 : 2 * i + 2])::BIGINT"
    bytes_ = f"list_transform(range(length({hexadecimal}) // 2), lambda i: {byte})"
    step = "lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), {step}), 4294967295)"


OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY doc, run),
bytes AS (SELECT run, k, hex(encode(doc || ':' || run)) AS x FROM counted),
hashed AS (SELECT run, k, {_crc32('x')} AS h FROM bytes, crc_table),
spelled AS (
  SELECT k, CASE WHEN h % 199 = 0
    THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (
  SELECT word, n, length(word) AS size, i, left(word, i::INT) || substring(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b
    ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n
  FROM near GROUP BY word, n),
forms AS (SELECT word, form, form_n FROM best WHERE form_n >= 5 * n),
chains(word, reached) AS (
  SELECT word, form FROM forms
  UNION ALL SELECT chains.word, forms.form FROM chains JOIN forms ON chains.reached = forms.word),
roots AS (SELECT word, reached AS root FROM chains WHERE reached NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""

ORACLE_SQL = {"op13_spelling_variants": OP13}
