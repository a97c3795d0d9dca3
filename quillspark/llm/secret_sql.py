"""DuckDB SQL of the secret-scan query: each rule's expression on every text, places from gaps and matches."""

from quillspark.llm.secret_scan import BASE, RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(k: int) -> str:
    """CTEs that give rule ``k``'s spans as rows (doc_id, start, kind, end)."""
    rule, p = RULES[k], _quoted(RULES[k].pattern)
    return f"""
    m{k} AS (
      SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {rule.group}) AS counted
      FROM t WHERE regexp_matches(text, {p})
    ),
    i{k} AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m{k}),
    s{k} AS (
      SELECT doc_id, {k} AS kind, length(counted[i]) AS counts, length(found[i]) AS size,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
      FROM i{k}
    )"""


_PARTS = ",".join(_spans(k) for k in range(len(RULES)))
_ALL = " UNION ALL ".join(
    f"SELECT doc_id, CAST(start AS BIGINT) AS start, kind, CAST(start + size AS BIGINT) AS stop FROM s{k} WHERE counts >= {rule.least}" for k, rule in enumerate(RULES)
)
_KIND = "(ARRAY[" + ", ".join(f"'{r.kind}'" for r in RULES) + "])[kind + 1]"
_LIST = f"string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"

OP5 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{_PARTS},
spans AS ({_ALL}),
grouped AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
         {_LIST} FILTER (kind < {len(BASE)}) AS base, {_LIST} AS spans
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN grouped ON grouped.doc_id = t.doc_id
"""
