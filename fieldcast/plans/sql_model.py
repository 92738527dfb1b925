"""DuckDB SQL for the count-model chain (oracle side only)."""

from __future__ import annotations

from fieldcast import constants as C
from fieldcast.plans.sql import A_LONG, META_CTES, PCOLS

NB_FEATURES = C.FEATURE_COLUMNS + [name for name, _, _ in C.INTERACTIONS]
CATEGORICAL = C.CATEGORY_COLUMNS + [name for name, _, _ in C.INTERACTIONS]

SYN_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''"))
    for k, v in sorted(C.CROP_SYNONYMS.items())) + ") t(local, canonical)"


def coerce(c: str) -> str:
    return (f"(CASE WHEN CAST({c} AS VARCHAR) = 'True' THEN 1.0 WHEN CAST({c} AS VARCHAR) = 'False' THEN 0.0 "
            f"ELSE coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0) END)")


def prepared_cols(a: str = "") -> dict[str, str]:
    """SQL for the 8 categorical texts (after normalisation) and 3 coerced numerics."""
    p = f"{a}." if a else ""
    crop = (f"(CASE WHEN {p}crop_name IS NULL THEN 'Unknown' ELSE coalesce((SELECT y.canonical FROM syn y "
            f"WHERE y.local = trim({p}crop_name)), trim({p}crop_name)) END)")
    cats = {"country_code": f"coalesce({p}country_code, 'Unknown')", "crop_name": crop,
            "partner": f"coalesce({p}partner, 'Unknown')", "subpartner": f"coalesce({p}subpartner, 'Unknown')",
            "irrigation": f"coalesce({p}irrigation, 'Unknown')"}
    out = dict(cats)
    for name, x, y in C.INTERACTIONS:
        out[name] = f"concat_ws('_', {cats[x]}, {cats[y]})"
    for c in C.NUMERIC_COLUMNS:
        out[c] = coerce(f'{p}"{c}"')
    return out


def bucket_cols(a: str = "") -> dict[str, str]:
    """SQL for the 11 model features as text (numerics bucketed)."""
    pc = prepared_cols(a)
    ip = "CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
    out = {k: v for k, v in pc.items() if k not in C.NUMERIC_COLUMNS}
    out["hired_workers"] = ip.format(x=pc["hired_workers"])
    out["area"] = ip.format(x=f"log2(1 + greatest({pc['area']}, 0.0))")
    out["planYear"] = ip.format(x=pc["planYear"])
    return {f: out[f] for f in NB_FEATURES}


FIRST_ROWS = f"""
SELECT {PCOLS}, indicator, answer, row_id AS first_row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {PCOLS}, indicator ORDER BY row_id, pos) AS rn FROM a_long) t
WHERE rn = 1"""


def _stack(src: str, keep: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, {f} AS value FROM {src}" for f in NB_FEATURES)


def base_ctes() -> list[tuple[str, str]]:
    """a_long .. ex (modelled training rows) .. split."""
    bc = bucket_cols("e")
    feats = ", ".join(f"{v} AS {k}" if k != "planYear" else f'{v} AS "planYear"' for k, v in bc.items())
    return [
        ("a_long", A_LONG), *META_CTES, ("syn", SYN_VALUES),
        ("first_rows", FIRST_ROWS),
        ("modelled", """SELECT indicator FROM first_rows GROUP BY indicator
                        HAVING count(answer) >= 20 AND count(DISTINCT answer) > 1"""),
        ("ex", f"""SELECT e.indicator, e.answer AS class, e.first_row_id AS row_key, {feats}
                   FROM first_rows e WHERE e.answer IS NOT NULL AND e.indicator IN (SELECT indicator FROM modelled)"""),
        ("sp0", """SELECT ex.*, count(*) OVER (PARTITION BY indicator, class) AS n_c,
                          row_number() OVER (PARTITION BY indicator, class ORDER BY row_key) AS rank_c,
                          row_number() OVER (PARTITION BY indicator ORDER BY row_key) AS rank_i,
                          count(*) OVER (PARTITION BY indicator) AS n
                   FROM ex"""),
        ("sps", "SELECT indicator, count(DISTINCT class) AS k, min(n_c) AS min_c FROM sp0 GROUP BY indicator"),
        ("sp1", """SELECT sp0.*, sps.k, sps.min_c,
                          (n >= 50 AND ((CASE WHEN sps.k <= 20 AND sps.min_c >= 2 THEN rank_c ELSE rank_i END) - 1) % 5 = 0) AS is_test0,
                          CAST(greatest(2, least(5, sps.min_c)) AS INT) AS n_folds,
                          CAST((rank_c - 1) % greatest(2, least(5, sps.min_c)) AS INT) AS fold
                   FROM sp0 JOIN sps ON sp0.indicator = sps.indicator"""),
        ("spk", "SELECT indicator, count(DISTINCT class) AS kt FROM sp1 WHERE NOT is_test0 GROUP BY indicator"),
        ("split", """SELECT sp1.*, NOT (n >= 50 AND coalesce(spk.kt, 0) = sp1.k) AS eval_on_train,
                            is_test0 AND (n >= 50 AND coalesce(spk.kt, 0) = sp1.k) AS is_test
                     FROM sp1 LEFT JOIN spk ON sp1.indicator = spk.indicator"""),
        ("feats", "SELECT * FROM (VALUES " + ", ".join(f"('{f}')" for f in NB_FEATURES) + ") t(feature)"),
    ]


def model_ctes(p: str, train: str) -> list[tuple[str, str]]:
    """Count model over the rows of ``train`` (CTE names prefixed ``p``)."""
    return [
        (f"{p}cls", f"""SELECT indicator, class, n_class,
                          row_number() OVER (PARTITION BY indicator ORDER BY class) - 1 AS idx,
                          count(*) OVER (PARTITION BY indicator) AS n_classes,
                          sum(n_class) OVER (PARTITION BY indicator) AS n_rows
                        FROM (SELECT indicator, class, count(*) AS n_class FROM {train} GROUP BY indicator, class) t"""),
        (f"{p}st", _stack(train, "indicator, class")),
        (f"{p}fv", f"SELECT indicator, class, feature, value, count(*) AS n FROM {p}st GROUP BY indicator, class, feature, value"),
        (f"{p}voc", f"""SELECT indicator, feature, count(*) + 1 AS V
                        FROM (SELECT DISTINCT indicator, feature, value FROM {p}fv) t GROUP BY indicator, feature"""),
        (f"{p}base", f"""SELECT c.indicator, c.class, any_value(ln(c.n_class / c.n_rows)) - sum(ln(c.n_class + coalesce(v.V, 1))) AS base
                         FROM {p}cls c CROSS JOIN feats f
                         LEFT JOIN {p}voc v ON v.indicator = c.indicator AND v.feature = f.feature
                         GROUP BY c.indicator, c.class"""),
    ]


#: Classes whose scores stand in one list; an indicator of many classes has several lists.
SCORE_BLOCK = 500


def score_ctes(p: str, m: str, rows: str, key: str) -> list[tuple[str, str]]:
    """Scores and decisions of ``rows`` (key, indicator, features) under model ``m``: the scores of a
    block of classes are one list, so that no row per input and class is kept."""
    looks = " ".join(f"""LEFT JOIN {p}cell c{j} ON c{j}.indicator = r.indicator AND c{j}.blk = b.blk
                                    AND c{j}.feature = '{f}' AND c{j}.value = r."{f}\"""" for j, f in enumerate(NB_FEATURES))
    total = " + ".join(f"coalesce(c{j}.d[i], 0.0)" for j in range(len(NB_FEATURES)))
    return [
        (f"{p}qs", _stack(rows, f"{key}, indicator")),
        (f"{p}blk", f"""SELECT indicator, c.idx // {SCORE_BLOCK} AS blk, list(class ORDER BY c.idx) AS classes, list(b.base ORDER BY c.idx) AS bases
                        FROM {m}cls c JOIN {m}base b USING (indicator, class) GROUP BY ALL"""),
        (f"{p}cell", f"""SELECT v.indicator, v.feature, v.value, c.idx // {SCORE_BLOCK} AS blk, list(ln(1 + coalesce(f.n, 0)) ORDER BY c.idx) AS d
                         FROM (SELECT DISTINCT indicator, feature, value FROM {m}fv) v JOIN {m}cls c ON c.indicator = v.indicator
                         LEFT JOIN {m}fv f ON f.indicator = v.indicator AND f.feature = v.feature AND f.value = v.value AND f.class = c.class
                         GROUP BY ALL"""),
        (f"{p}sc", f"""SELECT r.{key}, r.indicator, b.blk, b.classes,
                         list_transform(range(1, len(b.bases) + 1), lambda i: b.bases[i] + {total}) AS s
                       FROM {rows} r JOIN {p}blk b ON b.indicator = r.indicator {looks}"""),
        (f"{p}top", f"""SELECT {key}, indicator, blk, classes, list_transform(s, lambda x: round(x, 9)) AS snapped, list_max(s) AS top, s FROM {p}sc"""),
        (f"{p}dec", f"""SELECT {key}, indicator, blk, list_max(snapped) AS best, classes[list_position(snapped, list_max(snapped))] AS class, top,
                          list_sum(list_transform(s, lambda x: exp(x - top))) AS z FROM {p}top"""),
        (f"{p}win", f"""SELECT *, row_number() OVER w AS rn, max(top) OVER (PARTITION BY {key}, indicator) AS high FROM {p}dec
                        WINDOW w AS (PARTITION BY {key}, indicator ORDER BY best DESC, blk)"""),
        (f"{p}pred", f"""SELECT {key}, indicator, max(CASE WHEN rn = 1 THEN class END) AS predicted_class,
                           100.0 / sum(z * exp(top - high)) AS confidence
                         FROM {p}win GROUP BY {key}, indicator"""),
    ]


def eval_ctes() -> list[tuple[str, str]]:
    """Holdout evaluation: model on training slots, predictions on test slots, metrics."""
    return [
        ("tr", "SELECT * FROM split WHERE NOT is_test OR eval_on_train"),
        ("te", "SELECT * FROM split WHERE is_test OR eval_on_train"),
        *model_ctes("h_", "tr"),
        *score_ctes("e_", "h_", "te", "row_key"),
        ("preds", """SELECT t.indicator, t.row_key, t.class AS actual, p.predicted_class AS predicted
                     FROM te t JOIN e_pred p ON p.row_key = t.row_key AND p.indicator = t.indicator"""),
        ("cm", "SELECT indicator, actual, predicted, count(*) AS n FROM preds GROUP BY indicator, actual, predicted"),
        ("per0", """SELECT coalesce(s.indicator, q.indicator) AS indicator, coalesce(s.class, q.class) AS class,
                           coalesce(s.support, 0) AS support, coalesce(q.npred, 0) AS npred
                    FROM (SELECT indicator, actual AS class, sum(n) AS support FROM cm GROUP BY 1, 2) s
                    FULL JOIN (SELECT indicator, predicted AS class, sum(n) AS npred FROM cm GROUP BY 1, 2) q
                    ON s.indicator = q.indicator AND s.class = q.class"""),
        ("per", """SELECT p.*, coalesce(t.tp, 0) AS tp, c.idx, c.n_classes,
                          CASE WHEN p.npred > 0 THEN coalesce(t.tp, 0) / p.npred ELSE 0.0 END AS pr,
                          CASE WHEN p.support > 0 THEN coalesce(t.tp, 0) / p.support ELSE 0.0 END AS rc
                   FROM per0 p
                   LEFT JOIN (SELECT indicator, actual AS class, sum(n) AS tp FROM cm WHERE actual = predicted GROUP BY 1, 2) t
                     ON t.indicator = p.indicator AND t.class = p.class
                   LEFT JOIN h_cls c ON c.indicator = p.indicator AND c.class = p.class"""),
        ("per2", "SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f FROM per"),
        ("metrics", """SELECT indicator, sum(tp) / sum(support) AS accuracy,
                          CASE WHEN max(n_classes) = 2 THEN coalesce(max(CASE WHEN idx = 1 THEN pr END), 0.0)
                               ELSE sum(pr * support) / sum(support) END AS precision,
                          CASE WHEN max(n_classes) = 2 THEN coalesce(max(CASE WHEN idx = 1 THEN rc END), 0.0)
                               ELSE sum(rc * support) / sum(support) END AS recall,
                          CASE WHEN max(n_classes) = 2 THEN coalesce(max(CASE WHEN idx = 1 THEN f END), 0.0)
                               ELSE sum(f * support) / sum(support) END AS f1_score,
                          sum(support) AS test_samples
                   FROM per2 GROUP BY indicator"""),
    ]


def request_ctes() -> list[tuple[str, str]]:
    """Every profile (order) as a prediction request, scored for every modelled indicator."""
    bc = bucket_cols("p")
    feats = ", ".join(f"{v} AS {k}" if k != "planYear" else f'{v} AS "planYear"' for k, v in bc.items())
    prev = bucket_cols("pp")["planYear"]
    return [
        ("reqp", f"""SELECT p.row_id AS profile_id, m.indicator, {feats}
                     FROM f_profiles p CROSS JOIN modelled m"""),
        *model_ctes("m_", "ex"),
        *score_ctes("r_", "m_", "reqp", "profile_id"),
    ]
