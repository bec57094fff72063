"""DuckDB SQL for the rows of the queries that SQL can express (at small scale)."""

from __future__ import annotations

from .quality_rules import BIT, POLICIES, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

# unused ids or texts would need more columns; here every text has an id
OP4 = rf"""
WITH words AS (
  SELECT 'd' AS t, doc_id AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
spots AS (SELECT t, id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5),
grams AS (SELECT DISTINCT t, id, array_to_string(w[i:i + 4], ' ') AS g FROM spots),
items AS (SELECT id, count(*) AS n FROM grams WHERE t = 'i' GROUP BY id),
common AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c
           FROM grams d JOIN grams i ON d.t = 'd' AND i.t = 'i' AND d.g = i.g GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_common, c / n AS containment
FROM common JOIN items ON items.id = item_id WHERE 100 * c >= 75 * n
"""

OP6 = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM spots),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM (
    SELECT *, count(*) OVER (PARTITION BY g) AS c FROM windows) WHERE c > 1)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.p) AS t, count(*) AS n
         FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p GROUP BY each.doc_id)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

_BITS = " | ".join(f"(CASE WHEN {fails} THEN {BIT[rule]} ELSE 0 END)" for rule, fails in RULES.items())
_MASK = {p: sum(BIT[r] for r in rules) for p, rules in POLICIES.items()}
OP9 = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
               FROM documents),
spots AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM words WHERE len(w) >= 3),
three AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM spots),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM three) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(generate_series(i, i + 2)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT words.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
      FROM words LEFT JOIN again ON again.doc_id = words.doc_id),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {_MASK['base-1']}) <> 0 AS base_failed,
       (bits & {_MASK['base-1'] | _MASK['production-1']}) = 0 AS kept, bits
FROM b
"""

OP10 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE: dict[str, str] = {"op4_decontaminate": OP4, "op6_substring_dedup": OP6, "op9_quality_rules": OP9,
                          "op10_jaccard_join": OP10}
