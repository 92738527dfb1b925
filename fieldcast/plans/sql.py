"""Shared DuckDB SQL fragments for the oracle (CTE bodies, not Spark code)."""

from __future__ import annotations

from fieldcast import constants as C

PCOLS = ", ".join(C.FEATURE_COLUMNS)

A_LONG = f"""
SELECT a.row_id, a.pos, {", ".join("p." + c for c in C.FEATURE_COLUMNS)},
       trim(a.soaId) AS indicator, a.labelName, a.answer
FROM f_answers a JOIN f_profiles p ON a.row_id = p.row_id
WHERE a.soaId IS NOT NULL AND length(trim(a.soaId)) > 0
"""

FIRST = f"""
SELECT {PCOLS}, indicator, answer FROM (
  SELECT *, row_number() OVER (PARTITION BY {PCOLS}, indicator ORDER BY row_id, pos) AS rn FROM a_long) t
WHERE rn = 1
"""

SECTION_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(C.SECTION_MAP.items())) + ") t(prefix, section)"

PREFIX = r"upper(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"


def section_of(x: str) -> str:
    return f"coalesce((SELECT s.section FROM sections s WHERE s.prefix = {PREFIX.format(x=x)}), 'General')"


NUMERIC_TEST = (r"(regexp_full_match({v}, '[0-9.\-]+') AND regexp_matches({v}, '[0-9]') "
                r"AND length({v}) - length(replace({v}, '.', '')) <= 1 "
                r"AND length({v}) - length(replace({v}, '-', '')) <= 1)")

META_CTES = [
    ("sections", SECTION_VALUES),
    ("vals", """SELECT DISTINCT indicator, trim(answer) AS value FROM a_long
                WHERE answer IS NOT NULL AND trim(answer) NOT IN ('', 'null', 'None')"""),
    ("ids", "SELECT DISTINCT indicator FROM a_long"),
    ("st", f"""SELECT indicator, count(*) AS n_values,
                 bool_and(value IN ('True', 'False', 'true', 'false', '1', '0')) AS all_bool,
                 bool_and({NUMERIC_TEST.format(v='value')}) AS all_num,
                 avg(length(value)) AS avg_len
               FROM vals GROUP BY indicator"""),
    ("ty", """SELECT i.indicator, coalesce(st.n_values, 0) AS n_values, st.all_bool, st.all_num,
                 CASE WHEN coalesce(st.n_values, 0) = 0 THEN 'text'
                      WHEN st.all_bool THEN 'radio'
                      WHEN st.all_num AND st.n_values <= 75 THEN 'radio'
                      WHEN st.all_num THEN 'number'
                      WHEN st.n_values <= 50 AND (st.n_values >= 7 OR st.avg_len > 40) THEN 'checkbox'
                      WHEN st.n_values <= 50 THEN 'radio'
                      ELSE 'text' END AS type
              FROM ids i LEFT JOIN st ON i.indicator = st.indicator"""),
    ("op", """SELECT v.indicator,
                 CASE WHEN bool_or(t.all_num) THEN list(v.value ORDER BY TRY_CAST(v.value AS DOUBLE) NULLS LAST, v.value)
                      ELSE list(v.value ORDER BY v.value) END AS options
              FROM vals v JOIN ty t ON v.indicator = t.indicator
              WHERE t.type IN ('radio', 'checkbox') AND NOT t.all_bool
              GROUP BY v.indicator"""),
    ("infer", """SELECT t.indicator, t.type, t.n_values,
                   CASE WHEN t.all_bool AND t.n_values > 0 THEN ['False', 'True']
                        ELSE coalesce(op.options, CAST([] AS VARCHAR[])) END AS options
                 FROM ty t LEFT JOIN op ON t.indicator = op.indicator"""),
    ("lab", """SELECT i.indicator, coalesce(l.labelName, '') AS labelName
               FROM ids i LEFT JOIN (
                 SELECT indicator, trim(labelName) AS labelName,
                        row_number() OVER (PARTITION BY indicator ORDER BY row_id, pos) AS rn
                 FROM a_long WHERE length(trim(labelName)) > 0) l
               ON i.indicator = l.indicator AND l.rn = 1"""),
    ("meta", f"""SELECT f.indicator, f.type, {section_of('f.indicator')} AS section, l.labelName,
                   false AS conditional, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS parent_value,
                   f.options, f.type = 'checkbox' AS multi
                 FROM infer f JOIN lab l ON f.indicator = l.indicator"""),
]
