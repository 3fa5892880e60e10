"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from reviewlake.llm.licenses import TEMPLATES, THRESHOLD, prepared

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, d.n, item_id FROM doc_windows d JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


# Base 32 of a SHA-1: five hexadecimal digits are four letters.
_WARC = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
parts AS (SELECT r, i, ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER AS v FROM p, range(8) t(i)),
digest AS (
  SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * j)) & 31)::BIGINT + 1, 1), '' ORDER BY i, j) AS d
  FROM parts, range(4) u(j) GROUP BY r),
firsts AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN digest USING (r) JOIN firsts USING (hex)
"""


_FIM = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, t[:a] AS prefix, t[a + 1:b] AS middle, t[b + 1:] AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def _encoded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# DuckDB has no crc32: eight shifts of the reflected polynomial for each digit of the id.
_CRC = """
crc(doc_id, i, c) AS (
  SELECT doc_id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, list_reduce(list_concat([xor(c, ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)], range(8)),
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
  FROM crc WHERE i < strlen(doc_id::VARCHAR)),
chosen AS (SELECT doc_id FROM crc WHERE i = strlen(doc_id::VARCHAR) AND xor(c, 4294967295) % 7 = 0)"""

_MERKLE = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN {_leaf('n_chars + 1')} END AS shown FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf, shown NULLS FIRST) AS r,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, shown NULLS FIRST) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
nodes(tree, level, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY tree, level, i // 2, (n + 1) // 2),
subroots AS (SELECT tree, level, h FROM nodes WHERE n = 1),
top(level, i, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1
  GROUP BY level, i // 2, (n + 1) // 2),
steps AS (SELECT tree, level, i, n, h FROM nodes UNION ALL SELECT -1, level, i, n, h FROM top),
climb(r, tree, t, level, i, n, h, p) AS (
  SELECT r, tree, tree, 0, i, n, coalesce(shown, leaf), '' FROM leaves
  UNION ALL
  SELECT c.r, c.tree, CASE WHEN c.n = 1 THEN -1 ELSE c.t END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN c.tree ELSE c.i // 2 END, CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 1) // 2 END,
    CASE WHEN c.n = 1 THEN c.h WHEN s.h IS NULL THEN sha256(c.h) WHEN c.i % 2 = 0 THEN sha256(c.h || s.h) ELSE sha256(s.h || c.h) END,
    c.p || CASE WHEN c.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM climb c LEFT JOIN steps s ON s.tree = c.t AND s.level = c.level AND s.i = xor(c.i, 1)
  WHERE c.n > 1 OR c.t >= 0),
ends AS (SELECT r, h, p FROM climb WHERE t = -1 AND n = 1),
root AS (SELECT h FROM top WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(ends.p) AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM leaves JOIN ends USING (r) JOIN subroots s USING (tree), root
"""


def _licenses() -> str:
    rows, _ = prepared(TEMPLATES, THRESHOLD)

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({text(n)}, [{', '.join(map(text, b))}])" for n, b, *_ in rows)
    return rf"""
WITH templates(name, grams) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text FROM documents),
units AS (
  SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '
\s*
'), [text])) AS unit FROM docs),
split AS (SELECT r, unit, string_split(trim(regexp_replace(unit, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (
  SELECT r, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM split WHERE len(w) > 1),
scored AS (
  SELECT r, name, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice FROM grams, templates t),
found AS (SELECT r, name, max(dice) AS dice FROM scored WHERE dice >= {THRESHOLD} GROUP BY r, name),
best AS (
  SELECT r, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses
  FROM found GROUP BY r)
SELECT doc_id, license, coalesce(dice, 0)::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM docs LEFT JOIN best USING (r)
"""


ORACLES: dict[str, str] = {
    "op5_decontaminate": _DECONTAMINATE,
    "op6_licenses": _licenses(),
    "op10_warc": _WARC,
    "op11_fill_in_middle": _FIM,
    "op12_merkle_manifest": _MERKLE,
}
