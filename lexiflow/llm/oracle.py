"""DuckDB twins of the operators whose result SQL can express: brute force over
the same tables, all pairs included, so for small tables only."""

from __future__ import annotations

#: Smallest id reachable over ``links`` (a, b), for every id of ``nodes``.
_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, w.b FROM reached r JOIN both_ways w ON r.other = w.a),
component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
"""

_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"

VECTOR_DEDUP = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
nodes AS (SELECT DISTINCT id FROM vectors),
links AS (
  SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.id < y.id AND x.usable AND y.usable
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= 0.9 ELSE false END),
{_COMPONENTS},
degree AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT v.id AS vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, v.id = c.component_id AS kept
FROM vectors v JOIN component c ON v.id = c.id LEFT JOIN degree d ON v.id = d.a
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""
WITH RECURSIVE worded AS (SELECT doc_id AS id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
nodes AS (SELECT DISTINCT id FROM worded),
sets AS (
  SELECT id, list_sort(list_distinct(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
  FROM worded),
class AS (SELECT s, min(id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.id AS a, y.id AS b FROM shingles x JOIN shingles y ON x.t = y.t AND x.id < y.id
  GROUP BY x.id, y.id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_COMPONENTS}
SELECT s.id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.class_id, s.id) AS class_id, c.component_id
FROM sets s JOIN component c ON s.id = c.id LEFT JOIN class k ON s.s = k.s
"""

SUBSTRING_DEDUP = f"""
WITH worded AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM worded)),
firsts AS (SELECT h, min(doc_id) AS doc_id FROM windows GROUP BY h),
starts AS (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON x.h = f.h WHERE f.doc_id < x.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM worded),
marked AS (
  SELECT o.doc_id, o.i, o.word,
         coalesce(o.i - max(s.i) OVER (PARTITION BY o.doc_id ORDER BY o.i) < 50, false) AS gone
  FROM words o LEFT JOIN starts s ON o.doc_id = s.doc_id AND o.i = s.i),
left_over AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(l.n_removed, 0) AS n_removed,
       sha256(coalesce(l.kept, '')) AS kept_sha256
FROM worded d LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""

#: CRC-32 of a short ASCII text, by the bitwise rule (reversed polynomial 0xEDB88320).
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def _encoded(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, i, h) of 8-ary trees over ``leaves`` (g, i, h), then what
    lies left and right of each node that has a parent."""
    return f"""
{name}_nodes(g, level, i, h) AS (
  SELECT g, 0, i, h FROM {leaves}
  UNION ALL
  SELECT g, any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}_nodes) WHERE c > 1 GROUP BY g, i // 8),
{name}_steps AS (
  SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b ON a.g = b.g AND a.level = b.level AND a.i // 8 = b.i // 8
  WHERE a.level < (SELECT max(t.level) FROM {name}_nodes t WHERE t.g = a.g)
  GROUP BY a.g, a.level, a.i)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT coalesce('=' || lang, '') AS g, doc_id, {_leaf('text')} AS h,
         CASE WHEN {_CRC32.format(text="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
{_tree("part", "leaves")},
subroots AS (SELECT g, arg_max(h, level) AS h FROM part_nodes GROUP BY g),
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g AS part FROM subroots),
{_tree("all", "(SELECT g, i, h FROM tops)")},
root AS (SELECT arg_max(h, level) AS root FROM all_nodes),
ways AS (
  SELECT x.g, x.i, s.level, s.l, s.r FROM leaves x JOIN part_steps s ON s.g = x.g AND s.i = x.i // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL
  SELECT x.g, x.i, 1000 + s.level, s.l, s.r FROM leaves x JOIN tops t ON t.part = x.g
    JOIN all_steps s ON s.i = t.i // CAST(pow(8, s.level) AS BIGINT)),
paths AS (SELECT g, i, list({{'l': l, 'r': r, 'h': ''}} ORDER BY level) AS path FROM ways GROUP BY g, i),
folded AS (
  SELECT x.doc_id, x.h AS leaf, s.h AS subroot, root.root,
         sha256(array_to_string(list_transform(coalesce(path, []), lambda p: p.l || p.r), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': '', 'r': '', 'h': coalesce(x.changed, x.h)}}, coalesce(path, [])),
                     lambda a, p: {{'l': '', 'r': '', 'h': sha256(p.l || a.h || p.r)}}).h AS folded_root
  FROM leaves x JOIN subroots s ON s.g = x.g CROSS JOIN root LEFT JOIN paths p ON p.g = x.g AND p.i = x.i)
SELECT *, folded_root = root AS verified FROM folded
"""
