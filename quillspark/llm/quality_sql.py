"""DuckDB SQL of the quality-rules query, written independently of its DataFrame form."""

from quillspark.llm.quality_rules import ALPHA, DELTA, GRIDS, LANGUAGES, MIN_WORDS

_STRATA, _LEVELS = len(LANGUAGES) + 1, len(next(iter(GRIDS.values())))
_P = f"{ALPHA}::DOUBLE"
#: Does any rule reject at level g?
_HIT = " OR ".join(f"{rule} >= CAST([{', '.join(map(str, grid))}] AS DOUBLE[])[g + 1]" for rule, grid in GRIDS.items())
_SHARES = {
    "symbol_share": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "shout_share": ("n_shouts", "n_words"),
    "word_length": ("word_chars", "n_words"),
}

OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN {LANGUAGES} THEN lang ELSE 'other' END AS stratum FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
base AS (
  SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
         len(regexp_extract_all(text, '!')) AS n_shouts, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id
),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {", ".join(f"CAST(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS DOUBLE) AS {name}" for name, (a, b) in _SHARES.items())}
  FROM base
),
marked AS (SELECT doc_id, avg(quality) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tested AS (
  SELECT stratum, g, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({_HIT})) AS lost, count(*) FILTER (NOT good AND ({_HIT})) AS caught
  FROM f JOIN marked USING (doc_id), range({_LEVELS}) AS levels(g) WHERE NOT base_failed GROUP BY ALL
),
tails AS (
  SELECT *, n > 0 AND lost < n * {_P} AND list_sum(list_transform(range(0, lost + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P})))) <= {DELTA}::DOUBLE / {_STRATA} AS ok
  FROM tested
),
so_far AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY g) AS certified FROM tails),
best AS (SELECT stratum, g, row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, g) AS k FROM so_far WHERE certified),
hit AS (SELECT DISTINCT doc_id FROM f JOIN best USING (stratum) WHERE k = 1 AND ({_HIT}))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.doc_id IS NULL AS kept, stratum,
       {", ".join(GRIDS)}
FROM f LEFT JOIN hit ON hit.doc_id = f.doc_id
"""
