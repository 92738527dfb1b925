"""DuckDB SQL for the fixture views (FIXTURES.md §B), used as CTE prefixes by
the oracle SQL of every registered query."""

from __future__ import annotations

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = sql.strip()
    DEPS[name] = deps or []


_view("f_profiles", """
SELECT o.o_orderkey AS row_id,
       n.n_name AS country_code,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'ARROZ' WHEN 1 THEN 'Rice' WHEN 2 THEN 'Weizen'
            WHEN 3 THEN ' Wheat' WHEN 4 THEN 'Mais' ELSE 'Soybean' END AS crop_name,
       c.c_mktsegment AS partner,
       CASE WHEN o.o_orderkey % 33 = 0 THEN o.o_orderpriority END AS subpartner,
       CASE WHEN o.o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS irrigation,
       CASE o.o_orderkey % 10 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'n/a'
            ELSE CAST(o.o_custkey % 13 AS VARCHAR) END AS hired_workers,
       o.o_totalprice AS area,
       CAST(year(o.o_orderdate) AS INT) AS planYear
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
              JOIN nation n ON c.c_nationkey = n.n_nationkey
""")

_view("f_answers", """
SELECT l_orderkey AS row_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS pos,
       CASE l_linenumber WHEN 1 THEN 'BH-1' WHEN 2 THEN ' BH-2' WHEN 3 THEN 'CM-5' WHEN 4 THEN 'NM-4'
            WHEN 5 THEN 'SM-5' WHEN 6 THEN 'WI-6' ELSE 'ZZ-7' END AS soaId,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('Label ', CAST(l_linenumber AS VARCHAR)) END AS labelName,
       CASE WHEN l_partkey % 17 = 0 THEN NULL
            WHEN l_linenumber = 1 THEN l_returnflag
            WHEN l_linenumber = 2 THEN l_linestatus
            WHEN l_linenumber = 3 THEN concat('Type ', CAST(l_partkey % 20 AS VARCHAR))
            WHEN l_linenumber = 4 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
            WHEN l_linenumber = 5 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
            WHEN l_linenumber = 6 THEN CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END
            ELSE concat('Supplier ', CAST(l_suppkey AS VARCHAR)) END AS answer,
       l_quantity * 2 AS confidence,
       100 - l_tax * 100 AS model_accuracy
FROM lineitem
""")

_view("f_items", """
SELECT run_id, indicator, predicted_value, confidence,
       CASE WHEN confidence >= 70 THEN 'green' WHEN confidence >= 40 THEN 'amber' ELSE 'red' END AS ui_status,
       model_accuracy
FROM (SELECT CAST(row_id AS VARCHAR) AS run_id, trim(soaId) AS indicator, answer AS predicted_value,
             confidence, model_accuracy,
             ROW_NUMBER() OVER (PARTITION BY row_id, trim(soaId) ORDER BY pos) AS rn
      FROM f_answers) t
WHERE rn = 1
""", ["f_answers"])

_view("f_feedback", """
SELECT event_id AS id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'BH-1' WHEN 'click' THEN 'BH-2' WHEN 'signup' THEN 'CM-5'
            WHEN 'purchase' THEN 'WI-6' ELSE 'QQ-9' END AS indicator,
       CASE WHEN event_id % 50 = 0 THEN '' WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'F'
            WHEN event_type = 'signup' THEN concat('Type ', regexp_extract(props, '[0-9]+', 0))
            ELSE 'True' END AS actual_value,
       CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INT) AS was_helpful,
       concat('Country', CAST(user_id % 25 AS VARCHAR)) AS country_code,
       CASE event_id % 4 WHEN 0 THEN 'ARROZ' WHEN 1 THEN 'Rice' WHEN 2 THEN ' Wheat' ELSE 'Soybean' END AS crop_name,
       concat('Partner', CAST(user_id % 5 AS VARCHAR)) AS partner,
       CASE WHEN event_id % 10 = 0 THEN concat('Sub', CAST(user_id % 3 AS VARCHAR)) END AS subpartner,
       CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS irrigation,
       CAST(user_id % 13 AS VARCHAR) AS hired_workers,
       value AS area,
       CAST(year(ts) AS INT) AS "planYear"
FROM events
""")

_view("f_models", """
SELECT indicator, avg(model_accuracy) / 100 AS accuracy, count(*) AS training_samples
FROM f_items WHERE indicator <> 'SM-5' GROUP BY indicator
""", ["f_items"])

_view("f_registry_log", """
SELECT strftime(date_trunc('hour', ts), 'v_%Y%m%d_%H%M%S') AS version,
       ts AS created_at,
       concat('models/', strftime(date_trunc('hour', ts), 'v_%Y%m%d_%H%M%S'), '/model') AS model_path,
       CAST(user_id % 300 AS INT) AS total_models,
       value AS avg_accuracy,
       CAST(event_id AS INT) AS training_rows,
       props AS notes,
       event_id AS write_id
FROM events WHERE event_type = 'purchase'
""")


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in DEPS.get(n, []):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names: list[str], ctes: list[tuple[str, str]], body: str) -> str:
    """Build ``WITH <fixture views>, <extra ctes> <body>``."""
    parts = [f"{n} AS (\n{VIEWS[n]}\n)" for n in _closure(names)]
    parts += [f"{n} AS (\n{sql.strip()}\n)" for n, sql in ctes]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
