"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t, if(t = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' FROM range(2) r(t)
), shown AS (
  SELECT *, length(regexp_replace(regexp_replace(text,
      '([[])(\\*(?:/?SYS|/?INST|ROLE|/?TEXT)\])', '\1\\\2', 'g'),
      '(<)(\\*/s>)', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 ELSE 4 END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(if(role = 'assistant', length(text), 0)) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END) AS valid,
  bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
    AND arg_max(role, turn) = 'assistant' AS complete
FROM shown GROUP BY conv_id
"""

OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), shingles AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * k >= 75 * (s.n + t.n - k)
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles,
  least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS t
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.t, c.t) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), n AS (
  SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(string_split(text, chr(10))) AS n_lines,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g
  FROM d
), placed AS (
  SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS i FROM n
), twice AS (
  SELECT doc_id, i FROM placed
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS k FROM twice, range(3) r(j) GROUP BY doc_id
), counted AS (
  SELECT n.*, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words
  FROM n LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 2 * n_upper > n_letters) AS kept
FROM judged
"""



def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, round by round, in numbers that doubles hold exactly."""

    def near(book: str) -> str:
        return f"""
  SELECT vec_id, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT vec_id, p, e, list_dot_product(x, x) + list_dot_product(c, c)
      - 2 * list_dot_product(x, c) AS d
    FROM parts JOIN {book} USING (p)) GROUP BY vec_id, p"""

    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM kept, range({parts}) r(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
)"""
    for k in range(rounds):
        sql += f""", near{k} AS MATERIALIZED ({near(f"book{k}")}
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list(m ORDER BY j) AS m FROM (
      SELECT p, e, j, floor(sum(x[j]) / count(*)) AS m
      FROM near{k} JOIN parts USING (vec_id, p), unnest(range(1, len(x) + 1)) u(j)
      GROUP BY p, e, j) GROUP BY p, e) USING (p, e)
)"""
    last = f"book{rounds}"
    return f"""{sql}, last AS ({near(last)}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
    CAST(sum(d) AS BIGINT) AS error
  FROM last GROUP BY vec_id
), shown AS (
  SELECT sha256(string_agg(
    array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','),
    ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last}
)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), shown
"""


_TERMS = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t"
)

OP12 = f"""
WITH tf AS (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, {_TERMS} FROM benchmark)
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1)))
    AS BIGINT) AS w FROM tf, total GROUP BY t
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) //
    (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (t) JOIN tf USING (t) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

OP13 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM d, unnest(range(0, len(h) // 2 - 49)) u(i)
), firsts AS (
  SELECT s, min(doc_id) AS doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, i, i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS apart
  FROM w JOIN firsts USING (s) WHERE doc_id > doc
), numbered AS (
  SELECT doc_id, i, count(*) FILTER (coalesce(apart, true))
    OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits
), spans AS (
  SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY doc_id, span
), cut AS (
  SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans
), gone AS (
  SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low)
      || substr(any_value(h), 2 * max(high) + 1) AS kept
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

CHECK_SQL = {
    "op11_vector_codes": _vector_codes(),
    "op12_lexical_search": OP12,
    "op13_suffix_array_dedup": OP13,
    "op1_chat_formatting": OP1,
    "op2_ngram_jaccard_join": OP2,
    "op4_exact_topk": OP4,
    "op6_quality_rules": OP6,
}
