"""DuckDB SQL for the operator queries that SQL can express."""

from .licenses import TEMPLATES, key_positions

_WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
      FROM (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p
             || ' ' || lead(w, 4) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS x(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '{_WORD}') GROUP BY r),
m AS (
  SELECT doc_id, len(regexp_extract_all(t, '{_WORD}')) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + (100 * n_repeat_words > 20 * n_words)::BIGINT * 2
            + (2 * n_symbols > n_words)::BIGINT * 4 + (2 * n_dup_lines > n_lines)::BIGINT * 8
            + (10 * n_upper > 6 * n_letters)::BIGINT * 16 + (word_chars < 2 * n_words)::BIGINT * 32
            + (word_chars > 15 * n_words)::BIGINT * 64 + (n_words > 100000)::BIGINT * 128 AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) > 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits
FROM b
"""


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n,
                 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.size + 5 * l.v) AS p,
                 1 + 1000000000::HUGEINT * (k.total + 5) // (l.size + 5 * l.v) AS q
          FROM groups g JOIN langs l USING (lang) JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
                    FROM full_ x JOIN full_ y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) v
         ON (v.lang, v.a, v.b) = (a.lang, a.source, b.source)),
more AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM full_ WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pair
           UNION ALL
           SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM more) WHERE rank <= 50)
SELECT * FROM ranked
"""



def _licences() -> str:
    """Every template against every place: places with enough equal words and all words of the key phrases."""
    rows = []
    for k, t in enumerate(TEMPLATES):
        keys = key_positions(t)
        for i, w in enumerate(t.text.split()):
            in_key = "true" if i in keys else "false"
            rows.append(f"({k}, '{t.label}', {i}, '{w}', {in_key}, {len(t.text.split())}, {len(keys)}, {t.limit}, {str(t.base).lower()})")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM d),
t(k, label, pos, w, in_key, n, n_key, least, base) AS (VALUES {", ".join(rows)}),
p AS (SELECT r, k, label, base, i - pos AS start, count(*) / n::DOUBLE AS share
      FROM w JOIN t USING (w) WHERE i >= pos GROUP BY r, k, label, base, i - pos, n, n_key, least
      HAVING count(*) FILTER (WHERE in_key) = n_key AND count(*) / n::DOUBLE >= least),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
             max(start) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM p GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r)
"""


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format("text")} AS ws FROM documents),
b AS (SELECT item_id, {_PLAIN.format("text")} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS g
       FROM b, range(1, greatest(len(ws) - 12, 1) + 1) AS x(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM d, sizes, range(1, greatest(len(ws) - n + 1, 0) + 1) AS x(i)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, range(13) AS y(k) WHERE k < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

#: Shingle sets, all pairs that share a shingle, and components by repeated spreading of the smallest id.
OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
      FROM d, range(1, greatest(len(ws) - 3, 1) + 1) AS x(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

ORACLE_SQL = {"op2_minhash": OP2, "op5_licenses": _licences(), "op6_decontaminate": OP6, "op10_quality": OP10, "op12_divergence": OP12}
