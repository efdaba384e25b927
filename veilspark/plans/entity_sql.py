"""Checking SQL for detection: the registry applied by set operations and windows.

It shares the patterns with the engine but not the method: spans are rows, overlaps are settled by
window functions, and texts are rebuilt by ordered aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilspark.functions import recognizers as R

_VALID = {
    R.CREDIT_CARD.entity_type: (
        "(SELECT sum(CASE WHEN (len(d) - i) % 2 = 0 THEN d[i] WHEN d[i] > 4 THEN 2 * d[i] - 9 ELSE 2 * d[i] END) % 10 "
        "FROM (SELECT list_transform(string_split(regexp_replace(value, '[ -]', '', 'g'), ''), lambda c: c::INT) AS d), "
        "range(1, 20) t(i) WHERE i <= len(d)) = 0"
    ),
    R.US_SSN.entity_type: (
        "substr(value, 1, 3) NOT IN ('000', '666') AND value NOT LIKE '9%' AND substr(value, 5, 2) <> '00' "
        "AND substr(value, 8, 4) <> '0000'"
    ),
    R.IBAN.entity_type: (
        "CAST(array_to_string(list_transform(string_split(concat(substr(replace(value, ' ', ''), 5), "
        "substr(replace(value, ' ', ''), 1, 4)), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' "
        "THEN CAST(ord(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97 = 1"
    ),
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _hits(source: str, key: str, recognizer: R.Recognizer) -> str:
    pattern = _quoted(("(?i)" if recognizer.ignore_case else "") + recognizer.pattern)
    words = ", ".join(f"'{w}'" for w in recognizer.context)
    score = 1.0 if recognizer.validator else recognizer.score
    valid = _VALID[recognizer.entity_type] if recognizer.validator else "true"
    return f"""
      SELECT {key} AS k, '{recognizer.entity_type}' AS entity_type, s AS "start", s + length(value) AS "end", value,
        round(CASE WHEN list_has_any(string_split_regex(lower(array_to_string(list_slice(
          string_split(rtrim(regexp_replace(substr(text, 1, s), '\\s+', ' ', 'g')), ' '), -5, -1), ' ')), '\\W+'), [{words}])
          THEN least(1.0, greatest({score} + 0.35, 0.4)) ELSE {score} END::DOUBLE, 4) AS score
      FROM (SELECT {key}, text, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s
            FROM (SELECT {key}, text, m, g, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT {key}, text, regexp_extract_all(text, '{pattern}') AS m,
                          string_split_regex(text, '{pattern}') AS g FROM {source}
                        WHERE regexp_matches(text, '{pattern}'))))
      WHERE {valid}"""


def entities(source: str, key: str, registry: Iterable[R.Recognizer] = R.DEFAULT_REGISTRY,
             threshold: float = 0.35) -> str:
    """CTEs ``raw`` and ``entities(k, entity_type, start, end, value, score)`` over ``source(key, text)``."""
    union = " UNION ALL ".join(_hits(source, key, r) for r in registry)
    return f"""
    raw AS (SELECT DISTINCT * FROM ({union})),
    entities AS (
      SELECT * FROM raw a WHERE score >= {threshold} AND NOT EXISTS (
        SELECT 1 FROM raw b WHERE a.k = b.k AND a.entity_type = b.entity_type AND b.score >= a.score
          AND b."start" <= a."start" AND b."end" >= a."end"
          AND (b."start" < a."start" OR b."end" > a."end" OR b.score > a.score)))"""


def rewritten(source: str, key: str, replacement: str) -> str:
    """CTE ``rewritten(k, text)``; ``replacement`` is SQL over ``entity_type`` and ``value``."""
    return f"""
    ordered AS (
      SELECT *, coalesce(max("end") OVER (PARTITION BY k ORDER BY "start", "end" DESC, score DESC, entity_type
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM entities),
    kept AS (
      SELECT k, entity_type, "start",
        least("end", coalesce(lead("start") OVER (PARTITION BY k ORDER BY "start"), 2147483647)) AS "end"
      FROM ordered WHERE "end" > reach),
    cut AS (
      SELECT kept.*, coalesce(lag("end") OVER (PARTITION BY k ORDER BY "start"), 0) AS before,
        "end" = max("end") OVER (PARTITION BY k) AS final FROM kept),
    pieces AS (
      SELECT k, "start", concat(substr(text, before + 1, "start" - before), {replacement},
        CASE WHEN final THEN substr(text, "end" + 1) ELSE '' END) AS piece
      FROM (SELECT c.*, s.text, substr(s.text, c."start" + 1, c."end" - c."start") AS value
            FROM cut c JOIN {source} s ON c.k = s.{key})),
    rewritten AS (
      SELECT s.{key} AS k, coalesce(p.text, s.text) AS text FROM {source} s
      LEFT JOIN (SELECT k, string_agg(piece, '' ORDER BY "start") AS text FROM pieces GROUP BY k) p ON p.k = s.{key})"""


#: Replacement by entity type, as SQL.
REPLACE = (
    "CASE WHEN entity_type IN ('PERSON', 'EMAIL_ADDRESS', 'PHONE_NUMBER', 'CREDIT_CARD', 'LOCATION', "
    "'CUSTOMER_ID', 'CASE_ID') THEN concat('<', entity_type, '>') ELSE '<PII>' END"
)
MASK = (
    "CASE WHEN entity_type IN ('PHONE_NUMBER', 'EMAIL_ADDRESS', 'PERSON') "
    "THEN concat(repeat('*', least(length(value), 100)), substr(value, 101)) ELSE '<PII>' END"
)
REDACT = "''"
