"""SQL that states an operator's contract in another engine; the limits are written out, not taken from the code under test."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(@lower@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
item_words AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(@lower@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) AS b
  WHERE len(w) > 0
),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM item_words) AS i
),
places AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
    FROM doc_words, (SELECT DISTINCT n FROM windows) AS sizes WHERE len(w) >= n) AS d
),
hits AS (SELECT DISTINCT r, k, p.n AS n, item_id FROM places AS p JOIN windows AS v ON p.win = v.win AND p.n = v.n),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM hits) AS a GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) AS i GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN ids USING (r)
""".replace("@lower@", LOWER)

REPEAT_LIMITS = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))


def _gram(n: int) -> str:
    rest = " || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(1, n))
    return f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN w || ' ' || {rest} END AS g{n}"


REPETITION = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, pos, w, length(w) AS size FROM (
    SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts) AS t) AS u
),
grams AS (SELECT r, pos, size, {grams} FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
marks AS (
  SELECT r, pos, size, g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS m3, {marks} FROM grams
),
cover AS (SELECT r, size, bool_or(m3) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, {covers} FROM marks),
per_text AS (
  SELECT r, count(*) AS n_words, sum(size) AS word_chars, count(*) FILTER (WHERE c3) AS n_repeat_words, {shares} FROM cover GROUP BY r
),
lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY place) AS seen FROM (
    SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM (SELECT r, string_split(text, chr(10)) AS ls FROM texts) AS s) AS l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup_lines AS (
  SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM lines WHERE seen > 1 GROUP BY r
),
counts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(line_chars, 0) > 0.2 * coalesce(word_chars, 0) OR {limits} AS repeats
  FROM texts LEFT JOIN per_text USING (r) LEFT JOIN dup_lines USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR repeats) AS kept
FROM counts
""".format(
    grams=", ".join(_gram(n) for n in (3, *[n for n, _ in REPEAT_LIMITS])),
    marks=", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{n} ORDER BY pos) > 1 AS m{n}" for n, _ in REPEAT_LIMITS),
    covers=", ".join(f"bool_or(m{n}) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n, _ in REPEAT_LIMITS),
    shares=", ".join(f"coalesce(sum(size) FILTER (WHERE c{n}), 0) AS s{n}" for n, _ in REPEAT_LIMITS),
    limits=" OR ".join(f"coalesce(s{n}, 0) > {limit} * coalesce(word_chars, 0)" for n, limit in REPEAT_LIMITS),
)


#: CRC-32 byte by byte from its polynomial; near words by equal rests after one letter is taken out or covered.
SPELLING = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(@lower@, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) AS r
  WHERE length(run) >= 6 GROUP BY doc_id, run
),
spelled AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(c) - 64] END)) AS b
  FROM runs
),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS h FROM spelled, bytes
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) AS w
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
cuts AS (SELECT word, n, substr(word, 1, k) AS low, substr(word, k + 2) AS high FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words) AS p),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts AS a JOIN cuts AS b ON a.low || '*' || a.high = b.low || '*' || b.high AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts AS a JOIN words AS b ON a.low || a.high = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts AS a JOIN words AS b ON a.low || a.high = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
up AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms UNION ALL SELECT up.word, coalesce(f.form, f.word), f.form IS NULL FROM up JOIN forms AS f ON f.word = up.root WHERE NOT done)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM up WHERE done) AS r USING (word)
""".replace("@lower@", LOWER)

PHRASES = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(@lower@, '[.,;:!?\x0A-\x0D]')) AS p FROM documents) AS s
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (
  SELECT lang, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) AS sizes WHERE len(w) >= m) AS x
),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m > 1) AS c
),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (h.f + t.f) AS BIGINT) AS score
  FROM cuts AS c JOIN counts AS h ON h.lang = c.lang AND h.phrase = c.head JOIN counts AS t ON t.lang = c.lang AND t.phrase = c.tail
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(list_slice(w, k, k + size - 1), ' ') AS part FROM (
      SELECT lang, f, w, size, unnest(range(1, m - size + 2)) AS k FROM (
        SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS size FROM counts WHERE m > 2) AS a) AS b) AS c
  GROUP BY lang, part
),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM weakest AS s LEFT JOIN inside AS i ON i.lang = s.lang AND i.part = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""".replace("@lower@", LOWER)
