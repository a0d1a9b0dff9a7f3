"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

import string

from candlewick.llm import filter_audit, jaccard_join, quality_rules

_WORD = r"[^ \t\n\x0B\f\r]+"
_WORDS = f"words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents)"


def _windows(name: str, n: int, of: str = "words") -> str:
    return f"{name} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {of} WHERE len(ws) >= {n}))"


SUBSTRING_DEDUP = f"""WITH {_WORDS}, {_windows("grams", 13)},
firsts AS (SELECT h, min(doc_id) AS d FROM grams GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM grams JOIN firsts ON grams.h = firsts.h WHERE d < doc_id),
listed AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN listed ON listed.doc_id = words.doc_id"""

JACCARD_JOIN = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS ws FROM documents),
{_windows("grams", jaccard_join.WORDS)},
shingles AS (SELECT DISTINCT doc_id, h FROM grams UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM words WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {jaccard_join.PERCENT} * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT reached.doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.doc_id GROUP BY reached.doc_id"""


def _inside(n: int) -> str:
    """Characters inside windows of n words after the first of each."""
    return f"""{_windows(f"grams_{n}", n)},
inside_{n} AS (SELECT doc_id, sum(length(ws[k])) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS r FROM grams_{n}) WHERE r > 1) JOIN words USING (doc_id) GROUP BY doc_id)"""


_LIMITS = quality_rules.LIMITS
QUALITY_RULES = f"""WITH {_WORDS}, {_windows("grams_3", 3)},
repeats AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS r FROM grams_3) WHERE r > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM words),
later AS (SELECT doc_id, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, '{_WORD}'), ''))) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM lines WHERE regexp_matches(line, '{_WORD}')) WHERE r > 1 GROUP BY doc_id),
{", ".join(_inside(n) for n in _LIMITS)},
counts AS (SELECT words.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(later.n, 0) AS n_dup_lines, coalesce(repeats.c, 0) AS n_repeat_words,
  coalesce(later.c, 0) AS line_chars, {", ".join(f"coalesce(inside_{n}.c, 0) AS chars_{n}" for n in _LIMITS)}
  FROM words LEFT JOIN repeats ON repeats.doc_id = words.doc_id LEFT JOIN later ON later.doc_id = words.doc_id {" ".join(f"LEFT JOIN inside_{n} ON inside_{n}.doc_id = words.doc_id" for n in _LIMITS)}),
judged AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (line_chars > {quality_rules.LINE_LIMIT}::DOUBLE * word_chars{"".join(f" OR chars_{n} > {m}::DOUBLE * word_chars" for n, m in _LIMITS.items())}) AS kept FROM judged"""

_LETTERS = filter_audit.FILTERS
_NAMES = [f"x{i}" for i in range(len(_LETTERS))]
_AT = "instr('" + _LETTERS + "', substr(filter_order, {}, 1)) - 1"
FILTER_AUDIT = f"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
split AS (SELECT docs.doc_id, part, docs.t, first, regexp_extract_all(docs.t, '{_WORD}') AS ws FROM docs JOIN firsts ON docs.t = firsts.t),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < {filter_audit.LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN split.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN known ON known.doc_id = split.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(string_split('{",".join(_LETTERS)}', ',')) AS f),
orders AS (SELECT {" || ".join(f"{x}.f" for x in _NAMES)} AS filter_order FROM {", ".join(f"letters {x}" for x in _NAMES)} WHERE len(list_distinct([{", ".join(f"{x}.f" for x in _NAMES)}])) = {len(_LETTERS)}),
steps AS (SELECT filter_order, step, (1 << ({_AT.format("step")})) AS own, list_sum(list_transform(range(1, step), lambda i: 1 << ({_AT.format("i")}))) AS earlier FROM orders, (SELECT unnest(range(1, {len(_LETTERS) + 1})) AS step)),
cells AS (SELECT part, filter_order, step, own, mask, n, good, toxic, mask & own > 0 AS fails, mask & coalesce(earlier, 0)::INT > 0 AS gone FROM counts, steps),
sums AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM cells GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""

EXACT_DEDUP = r"""WITH own AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS k, length(coalesce(text, '')) AS points FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER best = 1 AS kept, sha256(k) AS text_sha256
FROM own WINDOW best AS (PARTITION BY k ORDER BY points DESC, doc_id NULLS LAST)"""

ORACLES = {"op11_filter_audit": FILTER_AUDIT, "op12_exact_dedup": EXACT_DEDUP, "op4_quality_rules": QUALITY_RULES, "op8_jaccard_join": JACCARD_JOIN, "op10_substring_dedup": SUBSTRING_DEDUP}
