"""Queries over prediction items, runs, feedback, registry and model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import features as FE
from fieldcast.operators import history as H
from fieldcast.operators import metadata as M
from fieldcast.operators import score as S
from fieldcast.plans.context import PROFILE_COLS, Ctx
from fieldcast.plans.oracle_views import with_views
from fieldcast.plans.registry import query
from fieldcast.plans.sql import A_LONG, FIRST, META_CTES, SECTION_VALUES

DEC = "decimal(18,6)"

# ---------------------------------------------------------------- SQL pieces
SYN_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''"))
    for k, v in sorted(C.CROP_SYNONYMS.items())) + ") t(local, canonical)"
CROP_NORM = "CASE WHEN {c} IS NULL THEN 'Unknown' ELSE coalesce((SELECT y.canonical FROM syn y WHERE y.local = trim({c})), trim({c})) END"
SEC = r"coalesce((SELECT s.section FROM sections s WHERE s.prefix = upper(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))), 'General')"

ITEM_CTES = [("sections", SECTION_VALUES), ("syn", SYN_VALUES),
             ("items_sec", f"SELECT i.*, {SEC.format(x='i.indicator')} AS section FROM f_items i")]
SCORE_CTES = ITEM_CTES + [
    ("sc_all", """
SELECT run_id, section, GROUPING(section) AS g, sum(sw) AS sum_sw, sum(w) AS sum_w
FROM (SELECT run_id, section,
             (CASE ui_status WHEN 'green' THEN confidence WHEN 'amber' THEN confidence * 0.6 ELSE 0.0 END)
               * (coalesce(model_accuracy, 50.0) / 100.0) AS sw,
             coalesce(model_accuracy, 50.0) / 100.0 AS w
      FROM items_sec) t
GROUP BY GROUPING SETS ((run_id), (run_id, section))"""),
    ("sc", "SELECT run_id, section, g, CASE WHEN sum_w > 0 THEN sum_sw / sum_w ELSE 0.0 END AS score FROM sc_all"),
    ("band", """
SELECT run_id, score, r AS score_rounded,
       CASE WHEN r >= 80 THEN 'Excellent' WHEN r >= 60 THEN 'Good'
            WHEN r >= 40 THEN 'Needs Improvement' ELSE 'Poor' END AS band,
       CASE WHEN r >= 80 THEN 'green' WHEN r >= 60 THEN 'amber'
            WHEN r >= 40 THEN 'orange' ELSE 'red' END AS band_color,
       concat(CAST(CAST(round_even(greatest(0.0, r - 7), 0) AS BIGINT) AS VARCHAR), '–',
              CAST(CAST(round_even(least(100.0, r + 7), 0) AS BIGINT) AS VARCHAR)) AS score_range
FROM (SELECT run_id, CAST(score AS DECIMAL(18,6)) AS score, round(round(score, 9), 1) AS r FROM sc WHERE g = 1) t"""),
    ("summ", """
SELECT run_id, count(*) AS total_indicators,
       count(*) FILTER (WHERE ui_status = 'green') AS auto_filled_count,
       count(*) FILTER (WHERE ui_status <> 'green' OR ui_status IS NULL) AS needs_review_count,
       CAST(avg(confidence) AS DECIMAL(18,6)) AS average_confidence,
       count(*) FILTER (WHERE confidence >= 80) AS high_confidence,
       count(*) FILTER (WHERE ui_status = 'green') * 0.5 AS saved_minutes
FROM items_sec GROUP BY run_id"""),
    ("runs", f"""
SELECT s.run_id, o.o_orderdate AS created_at, p.country_code AS country, {CROP_NORM.format(c='p.crop_name')} AS crop,
       p.partner, p.subpartner, p.irrigation, p.hired_workers, p.area, CAST(p.planYear AS VARCHAR) AS plan_year,
       s.total_indicators, s.auto_filled_count AS auto_filled, s.needs_review_count AS needs_review,
       s.average_confidence AS avg_confidence, b.score AS sustainability_score, b.band AS sustainability_band
FROM summ s JOIN f_profiles p ON CAST(s.run_id AS BIGINT) = p.row_id
            JOIN orders o ON o.o_orderkey = p.row_id
            JOIN band b ON b.run_id = s.run_id"""),
]
RUN_VIEWS = ["f_items", "f_profiles"]


def _oracle(body: str, views=None, ctes=None) -> str:
    return with_views(views or RUN_VIEWS, ctes if ctes is not None else SCORE_CTES, body)


# ---------------------------------------------------------------- Spark pieces
def items_sec(ctx: Ctx) -> DataFrame:
    return M.with_section(ctx.items, ctx.spark)


def scores(ctx: Ctx) -> DataFrame:
    return S.weighted_scores(items_sec(ctx))


def runs(ctx: Ctx) -> DataFrame:
    """D10 prediction_runs derived from the items: summary, score and plan context."""
    it = items_sec(ctx)
    summ = S.run_summary(it)
    band = S.score_presentation(scores(ctx).filter("overall"))
    prof = FE.normalize_crop(ctx.profiles, ctx.spark)
    orders = ctx.table("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("created_at"))
    j = (summ.join(band, "run_id")
             .join(prof, F.col("run_id").cast("bigint") == prof["row_id"])
             .join(orders, "row_id"))
    return j.select("run_id", "created_at", F.col("country_code").alias("country"), F.col("crop_name").alias("crop"),
                    "partner", "subpartner", "irrigation", "hired_workers", "area",
                    F.col("planYear").cast("string").alias("plan_year"), "total_indicators",
                    F.col("auto_filled_count").alias("auto_filled"), F.col("needs_review_count").alias("needs_review"),
                    F.col("average_confidence").alias("avg_confidence"),
                    F.col("score").alias("sustainability_score"), F.col("band").alias("sustainability_band"))


# ---------------------------------------------------------------- runs & scores
@query("run_summary", oracle=_oracle("SELECT * FROM summ"))
def run_summary(ctx: Ctx):
    """Per-run counts, mean confidence, high-confidence count, saved minutes."""
    return S.run_summary(items_sec(ctx))


@query("runs_from_items", oracle=_oracle("SELECT * FROM runs", RUN_VIEWS))
def runs_from_items(ctx: Ctx):
    """The runs table written alongside its items (one cached items plan feeds both)."""
    return runs(ctx)


@query("sustainability_score", oracle=_oracle("SELECT run_id, CAST(score AS DECIMAL(18,6)) AS score FROM sc WHERE g = 1"))
def sustainability_score(ctx: Ctx):
    """Overall weighted score per run."""
    return scores(ctx).filter("overall").select("run_id", F.col("score").cast(DEC).alias("score"))


@query("section_scores", oracle=_oracle("SELECT run_id, section, CAST(score AS DECIMAL(18,6)) AS score FROM sc WHERE g = 0"))
def section_scores(ctx: Ctx):
    """Weighted score per (run, section) from the same grouping-sets aggregation."""
    return scores(ctx).filter(~F.col("overall")).select("run_id", "section", F.col("score").cast(DEC).alias("score"))


@query("score_band", oracle=_oracle("SELECT run_id, score_rounded, band, band_color, score_range FROM band"))
def score_band(ctx: Ctx):
    """Band, colour and range text of each run's score."""
    return S.score_presentation(scores(ctx).filter("overall")).drop("score")


@query("review_groups", oracle=_oracle("""
SELECT run_id, indicator, section, CASE WHEN ui_status = 'green' THEN 'auto_filled' ELSE 'needs_review' END AS review_group
FROM items_sec"""))
def review_groups(ctx: Ctx):
    """U4: every prediction lands in exactly one of auto_filled / needs_review."""
    return items_sec(ctx).select("run_id", "indicator", "section", X.review_group("ui_status").alias("review_group"))


@query("policy_bands", oracle=_oracle("""
SELECT run_id, indicator, confidence,
       CASE WHEN confidence >= 70 THEN 'auto_fill' WHEN confidence >= 40 THEN 'suggest' ELSE 'suggest_low' END AS policy,
       CASE WHEN confidence >= 70 THEN 'green' WHEN confidence >= 40 THEN 'amber' ELSE 'red' END AS ui_status
FROM f_items"""))
def policy_bands(ctx: Ctx):
    """Confidence -> policy and UI status."""
    it = ctx.items
    return it.select("run_id", "indicator", "confidence", X.confidence_policy("confidence").alias("policy"),
                     X.confidence_status("confidence").alias("ui_status"))


@query("run_items", oracle=_oracle("""
SELECT run_id, indicator, section, predicted_value, confidence, ui_status, model_accuracy
FROM items_sec WHERE run_id = '7' ORDER BY indicator"""))
def run_items(ctx: Ctx, run_id: str = "7"):
    """The items of one run, by indicator (a point look-up; the filter reaches the scan)."""
    from fieldcast.sources.fixtures import items as fixture_items
    it = M.with_section(fixture_items(ctx.spark, ctx.sf_dir, run_key=int(run_id)), ctx.spark)
    return (it.filter(F.col("run_id") == run_id)
            .select("run_id", "indicator", "section", "predicted_value", "confidence", "ui_status", "model_accuracy")
            .orderBy("indicator"))


@query("prediction_history", oracle=_oracle("""
SELECT * FROM runs WHERE crop = 'Rice' AND partner = 'BUILDING'
ORDER BY created_at DESC, run_id DESC LIMIT 50""", RUN_VIEWS))
def prediction_history(ctx: Ctx, crop: str = "Rice", partner: str = "BUILDING", limit: int = C.HISTORY_LIMIT):
    """Newest runs, optionally filtered by crop and partner ('' = no filter)."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    r = runs(ctx)
    if crop:
        r = r.filter(F.col("crop") == crop)
    if partner:
        r = r.filter(F.col("partner") == partner)
    return r.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


@query("top_crops", oracle=_oracle("""
SELECT crop, count(*) AS cnt FROM runs WHERE crop IS NOT NULL GROUP BY crop ORDER BY cnt DESC, crop LIMIT 5""", RUN_VIEWS))
def top_crops(ctx: Ctx):
    """The five most predicted crops (ties by name)."""
    return (runs(ctx).filter(F.col("crop").isNotNull()).groupBy("crop").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), "crop").limit(C.TOP_CROPS))


@query("table_counts", oracle=_oracle("""
SELECT 'total_prediction_runs' AS metric, (SELECT count(*) FROM runs) AS value
UNION ALL SELECT 'total_feedback_entries', (SELECT count(*) FROM f_feedback)
UNION ALL SELECT 'registered_model_versions', (SELECT count(DISTINCT version) FROM f_registry_log)""",
                                   RUN_VIEWS + ["f_feedback", "f_registry_log"]))
def table_counts(ctx: Ctx):
    """Row counts of the history tables, one row per metric."""
    parts = [runs(ctx).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_prediction_runs")),
             ctx.feedback.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_feedback_entries")),
             ctx.registry_log.agg(F.countDistinct("version").alias("value"))
                .withColumn("metric", F.lit("registered_model_versions"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "value")


@query("predictions_with_section", oracle=with_views(["f_profiles", "f_answers", "f_items"],
       [("a_long", A_LONG), *META_CTES], """
SELECT i.run_id, i.indicator, coalesce(m.section, 'General') AS section, coalesce(m.labelName, '') AS labelName,
       i.predicted_value, i.confidence
FROM f_items i LEFT JOIN meta m ON i.indicator = m.indicator"""))
def predictions_with_section(ctx: Ctx):
    """Predictions joined with question metadata (section defaults to General)."""
    m = ctx.meta.select("indicator", "section", "labelName")
    j = ctx.items.join(m, "indicator", "left")
    return j.select("run_id", "indicator", F.coalesce("section", F.lit(C.DEFAULT_SECTION)).alias("section"),
                    F.coalesce("labelName", F.lit("")).alias("labelName"), "predicted_value", "confidence")


@query("predictions_by_label", oracle=with_views(["f_profiles", "f_answers", "f_items"],
       [("a_long", A_LONG), *META_CTES], """
SELECT run_id, label, indicator, value, confidence FROM (
  SELECT i.run_id, trim(m.labelName) AS label, i.indicator, i.predicted_value AS value, i.confidence,
         row_number() OVER (PARTITION BY i.run_id, trim(m.labelName) ORDER BY i.indicator DESC) AS rn
  FROM f_items i JOIN meta m ON i.indicator = m.indicator
  WHERE trim(m.labelName) <> '') t WHERE rn = 1"""))
def predictions_by_label(ctx: Ctx):
    """Predictions keyed by label; blank labels dropped; the last indicator wins."""
    m = ctx.meta.select("indicator", F.trim("labelName").alias("label")).filter(F.col("label") != "")
    j = ctx.items.join(m, "indicator")
    best = j.groupBy("run_id", "label").agg(
        F.max_by(F.struct("indicator", F.col("predicted_value").alias("value"), "confidence"), F.col("indicator")).alias("b"))
    return best.select("run_id", "label", "b.indicator", "b.value", "b.confidence")


@query("items_flatten", oracle=with_views(["f_profiles", "f_answers", "f_items"], [("a_long", A_LONG), *META_CTES], """
SELECT i.run_id, i.indicator,
       CASE WHEN m.type = 'checkbox' THEN coalesce(i.predicted_value, '')
            ELSE coalesce(nullif(i.predicted_value, ''), '') END AS predicted_value
FROM f_items i LEFT JOIN meta m ON i.indicator = m.indicator"""))
def items_flatten(ctx: Ctx):
    """Value, or the first suggested option for checkbox questions, or ''."""
    from fieldcast.operators.predict import shape_values
    p = shape_values(ctx.items.withColumnRenamed("predicted_value", "predicted_class"), ctx.meta)
    return p.select("run_id", "indicator", X.flatten_value("value", "suggestedOptions").alias("predicted_value"))


@query("export_predictions", oracle=with_views(["f_profiles", "f_answers", "f_items"], [("a_long", A_LONG), *META_CTES], """
SELECT i.run_id, i.indicator AS "Indicator",
       CASE WHEN m.type = 'checkbox' THEN
              CASE WHEN i.predicted_value IS NULL THEN '[]' ELSE concat('[''', i.predicted_value, ''']') END
            ELSE i.predicted_value END AS "Predicted_Value",
       printf('%.1f%%', i.confidence) AS "Confidence_%"
FROM f_items i LEFT JOIN meta m ON i.indicator = m.indicator"""))
def export_predictions(ctx: Ctx):
    """Export rows (value, else the options list as text; confidence as '%.1f%%')."""
    from fieldcast.operators.predict import export_rows, shape_values
    p = shape_values(ctx.items.withColumnRenamed("predicted_value", "predicted_class"), ctx.meta)
    return export_rows(p, key="run_id")


# ---------------------------------------------------------------- registry
@query("registry_latest", oracle=with_views(["f_registry_log"], [], """
SELECT version, created_at, model_path, total_models, avg_accuracy, training_rows, notes FROM (
  SELECT *, row_number() OVER (PARTITION BY version ORDER BY created_at DESC, write_id DESC) AS rn
  FROM f_registry_log) t WHERE rn = 1"""))
def registry_latest(ctx: Ctx):
    """Keyed upsert view of the registry log (latest write per version)."""
    return H.latest_per_key(ctx.registry_log, "version", "created_at", "write_id").drop("write_id")


@query("model_versions", oracle=with_views(["f_registry_log"], [], """
SELECT version, model_path, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY version ORDER BY created_at DESC, write_id DESC) AS rn
  FROM f_registry_log) t WHERE rn = 1 ORDER BY version DESC"""))
def model_versions(ctx: Ctx):
    """Registered versions, newest first."""
    latest = H.latest_per_key(ctx.registry_log, "version", "created_at", "write_id")
    return latest.select("version", "model_path", "created_at").orderBy(F.col("version").desc())


@query("version_label", oracle="SELECT event_id, strftime(ts, 'v_%Y%m%d_%H%M%S') AS version FROM events")
def version_label(ctx: Ctx):
    """Version label of a save time."""
    return ctx.table("events").select("event_id", X.version_label("ts").alias("version"))


# ---------------------------------------------------------------- feedback
FB = ["f_feedback"]


@query("feedback_counts", oracle=with_views(FB, [], """
SELECT indicator, count(*) AS total,
       CAST(sum(CASE WHEN was_helpful = 1 THEN 1 ELSE 0 END) AS BIGINT) AS helpful,
       CAST(sum(CASE WHEN was_helpful = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_helpful
FROM f_feedback GROUP BY indicator"""))
def feedback_counts(ctx: Ctx):
    """Feedback totals per indicator."""
    return H.feedback_counts(ctx.feedback)


@query("corrections_for_indicator", oracle=with_views(FB, [], """
SELECT i.indicator, CAST(coalesce(nullif(n, 0), 1) AS BIGINT) AS corrections
FROM (VALUES ('CM-5'), ('XX-0')) i(indicator) JOIN (
  SELECT 'CM-5' AS indicator, count(*) AS n FROM f_feedback WHERE indicator = 'CM-5'
  UNION ALL SELECT 'XX-0', count(*) FROM f_feedback WHERE indicator = 'XX-0') c USING (indicator)"""))
def corrections_for_indicator(ctx: Ctx):
    """A10: corrections of one indicator that has feedback, and of one that has none (1)."""
    return H.corrections_for(ctx.feedback, "CM-5").unionByName(H.corrections_for(ctx.feedback, "XX-0"))


@query("feedback_for_indicator", oracle=with_views(FB, [], """
SELECT * FROM f_feedback WHERE indicator = 'CM-5' ORDER BY created_at DESC"""))
def feedback_for_indicator(ctx: Ctx, indicator: str = "CM-5"):
    """P10: feedback of one indicator, newest first."""
    return ctx.feedback.filter(F.col("indicator") == indicator).orderBy(F.col("created_at").desc())


@query("feedback_entries", oracle=with_views(FB, [], """
SELECT id, indicator, actual_value AS actual, country_code AS input_country_code, crop_name AS input_crop_name,
       partner AS input_partner, subpartner AS input_subpartner, irrigation AS input_irrigation,
       hired_workers AS input_hired_workers, area AS input_area, "planYear" AS "input_planYear"
FROM f_feedback WHERE actual_value IS NOT NULL AND actual_value <> ''"""))
def feedback_entries(ctx: Ctx):
    """Usable feedback shaped as (indicator, actual, input), input flattened."""
    return H.usable_feedback(ctx.feedback).select(
        "id", "indicator", F.col("actual_value").alias("actual"),
        *[F.col(c).alias(f"input_{c}") for c in PROFILE_COLS])


@query("valid_feedback", oracle=with_views(FB, [], """
SELECT id, indicator, actual_value,
       coalesce(indicator <> '' AND actual_value <> '', false) AS accepted
FROM f_feedback"""))
def valid_feedback(ctx: Ctx):
    """A feedback post needs a non-empty indicator and actual value."""
    ok = F.coalesce((F.col("indicator") != "") & (F.col("actual_value") != ""), F.lit(False))
    return ctx.feedback.select("id", "indicator", "actual_value", ok.alias("accepted"))


@query("partner_feedback", oracle=with_views(FB, [], """
SELECT id, indicator, actual_value, partner FROM f_feedback
WHERE actual_value IS NOT NULL AND actual_value <> '' AND lower(partner) = lower('PARTNER2')"""))
def partner_feedback(ctx: Ctx, partner: str = "PARTNER2"):
    """Usable feedback of one partner, matched case-insensitively."""
    return (H.usable_feedback(ctx.feedback).filter(F.lower("partner") == partner.lower())
            .select("id", "indicator", "actual_value", "partner"))


@query("most_corrected", oracle=with_views(FB, [], """
SELECT partner, indicator, n_corrections, rank FROM (
  SELECT partner, indicator, n_corrections,
         row_number() OVER (PARTITION BY partner ORDER BY n_corrections DESC, indicator) AS rank
  FROM (SELECT lower(partner) AS partner, indicator, count(*) AS n_corrections
        FROM f_feedback WHERE actual_value IS NOT NULL AND actual_value <> ''
        GROUP BY lower(partner), indicator) c) t
WHERE rank <= 10"""))
def most_corrected(ctx: Ctx):
    """Each partner's ten most corrected indicators (ties by indicator)."""
    c = (H.usable_feedback(ctx.feedback).groupBy(F.lower("partner").alias("partner"), "indicator")
         .agg(F.count(F.lit(1)).alias("n_corrections")))
    return H.top_k_per_group(c, "partner", [F.col("n_corrections").desc(), "indicator"], C.TOP_CORRECTED) \
            .withColumn("rank", F.col("rank").cast("bigint"))


@query("partner_footprint", oracle=with_views(["f_profiles", "f_answers"], [("a_long", A_LONG), ("first_ans", FIRST)], """
SELECT lower(partner) AS partner,
       list_sort(list(DISTINCT country_code) FILTER (WHERE country_code IS NOT NULL)) AS countries,
       list_sort(list(DISTINCT crop_name) FILTER (WHERE crop_name IS NOT NULL)) AS crops
FROM first_ans WHERE answer IS NOT NULL GROUP BY lower(partner)"""))
def partner_footprint(ctx: Ctx):
    """Countries and crops seen in each partner's training profiles.  The
    sets are bounded by the country / crop vocabularies and built map-side."""
    t = ctx.first.filter(F.col("answer").isNotNull())
    return t.groupBy(F.lower("partner").alias("partner")).agg(
        F.array_sort(F.collect_set("country_code")).alias("countries"),
        F.array_sort(F.collect_set("crop_name")).alias("crops"))


READY_CTES = [("a_long", A_LONG), ("first_ans", FIRST),
              ("usable", "SELECT * FROM f_feedback WHERE actual_value IS NOT NULL AND actual_value <> ''"),
              ("ready", """SELECT indicator, count(*) AS n_corrections FROM usable GROUP BY indicator
                           HAVING count(*) >= 10 AND indicator IN (SELECT indicator FROM f_models)"""),
              ("classes", "SELECT DISTINCT indicator, answer AS class FROM first_ans WHERE answer IS NOT NULL"),
              ("uc0", """SELECT u.* FROM usable u WHERE u.indicator IN (SELECT indicator FROM ready)
                         AND EXISTS (SELECT 1 FROM classes c WHERE c.indicator = u.indicator AND c.class = u.actual_value)"""),
              ("uc", """SELECT * FROM uc0 WHERE indicator IN
                        (SELECT indicator FROM uc0 GROUP BY indicator HAVING count(*) >= 2)""")]
READY_VIEWS = ["f_feedback", "f_models", "f_profiles", "f_answers"]


def model_classes(ctx: Ctx) -> DataFrame:
    """Classes each model knows: distinct non-null first answers per indicator."""
    return (ctx.first.filter(F.col("answer").isNotNull())
            .select("indicator", F.col("answer").alias("class")).distinct())


@query("feedback_ready", oracle=with_views(["f_feedback", "f_models"], READY_CTES[2:4], "SELECT * FROM ready"))
def feedback_ready(ctx: Ctx):
    """Indicators with a model and at least 10 usable corrections."""
    return H.feedback_ready(ctx.feedback, ctx.models)


@query("usable_corrections", oracle=with_views(READY_VIEWS, READY_CTES, "SELECT id, indicator, actual_value FROM uc"))
def usable_corrections(ctx: Ctx):
    """Corrections whose value is a known class, for ready indicators with >= 2 of them."""
    ready = H.feedback_ready(ctx.feedback, ctx.models)
    return H.known_class_corrections(ctx.feedback, ready, model_classes(ctx)).select("id", "indicator", "actual_value")


# ---------------------------------------------------------------- metadata / models
META_VIEWS = ["f_profiles", "f_answers", "f_models"]
META_SQL = [("a_long", A_LONG), *META_CTES]


@query("question_catalog", oracle=with_views(META_VIEWS, META_SQL, """
SELECT m.indicator AS "indicatorCode", m.labelName AS "labelName", m.type, m.section,
       (f.indicator IS NOT NULL) OR m.type NOT IN ('text', 'number') AS "aiAvailable",
       (f.indicator IS NULL) AND m.type IN ('text', 'number') AS "manualEntry", m.options
FROM meta m LEFT JOIN f_models f ON m.indicator = f.indicator"""))
def question_catalog(ctx: Ctx):
    """Question list with AI-availability flags."""
    return H.question_catalog(ctx.meta, ctx.models)


@query("question_policy", oracle=with_views(META_VIEWS[:2], META_SQL, """
SELECT indicator, CASE WHEN type IN ('text', 'number') THEN 'manual' WHEN type = 'checkbox' THEN 'suggest'
                       WHEN conditional THEN 'suggest' ELSE 'auto' END AS policy FROM meta"""))
def question_policy(ctx: Ctx):
    """v2 question policy from metadata."""
    return ctx.meta.select("indicator", X.question_policy("type", "conditional").alias("policy"))


@query("question_policy_v1", oracle=with_views(META_VIEWS[:2], META_SQL, """
SELECT indicator, CASE WHEN type = 'text' THEN 'skip' WHEN type = 'checkbox' THEN 'suggest'
                       WHEN conditional THEN 'suggest' WHEN type = 'radio' AND len(options) = 2 THEN 'suggest'
                       ELSE 'auto' END AS policy FROM meta"""))
def question_policy_v1(ctx: Ctx):
    """v1 question policy."""
    return ctx.meta.select("indicator", X.question_policy_v1("type", "options", "conditional").alias("policy"))


@query("run_summary_v1", oracle=with_views(["f_profiles", "f_answers", "f_items"], META_SQL + [
    ("pol", """SELECT indicator, CASE WHEN type = 'text' THEN 'skip' WHEN type = 'checkbox' THEN 'suggest'
                       WHEN conditional THEN 'suggest' WHEN type = 'radio' AND len(options) = 2 THEN 'suggest'
                       ELSE 'auto' END AS policy FROM meta""")], """
SELECT i.run_id, count(*) AS total_predictions,
       count(*) FILTER (WHERE p.policy = 'auto' AND i.confidence >= 80) AS high_confidence,
       CAST(avg(i.confidence) AS DECIMAL(18,6)) AS avg_confidence
FROM f_items i JOIN pol p ON i.indicator = p.indicator
WHERE p.policy <> 'skip' GROUP BY i.run_id"""))
def run_summary_v1(ctx: Ctx):
    """v1 summary: text questions skipped; high confidence = auto policy and >= 80."""
    pol = ctx.meta.select("indicator", X.question_policy_v1("type", "options", "conditional").alias("policy"))
    j = ctx.items.join(pol, "indicator").filter(F.col("policy") != "skip")
    return j.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if((F.col("policy") == "auto") & (F.col("confidence") >= C.HIGH_CONFIDENCE_THRESHOLD)).alias("high_confidence"),
        F.avg("confidence").cast(DEC).alias("avg_confidence"))


MODEL_SEC = [("sections", SECTION_VALUES),
             ("msec", f"SELECT f.*, {SEC.format(x='f.indicator')} AS section FROM f_models f")]


def models_sec(ctx: Ctx) -> DataFrame:
    return M.with_section(ctx.models, ctx.spark)


@query("section_stats", oracle=with_views(["f_models"], MODEL_SEC, """
SELECT section, count(*) AS indicator_count, CAST(avg(accuracy) * 100 AS DECIMAL(18,6)) AS average_accuracy
FROM msec GROUP BY section ORDER BY section"""))
def section_stats(ctx: Ctx):
    """Models per section and their mean accuracy (percent)."""
    return (models_sec(ctx).groupBy("section")
            .agg(F.count(F.lit(1)).alias("indicator_count"), (F.avg("accuracy") * 100).cast(DEC).alias("average_accuracy"))
            .orderBy("section"))


@query("model_stats", oracle=with_views(["f_models"], [], """
SELECT count(*) AS total_models, CAST(coalesce(avg(accuracy), 0) AS DECIMAL(18,6)) AS average_accuracy,
       CAST(sum(training_samples) AS BIGINT) AS training_samples FROM f_models"""))
def model_stats(ctx: Ctx):
    """Number of models and mean accuracy (nulls skipped; none -> 0)."""
    return ctx.models.agg(F.count(F.lit(1)).alias("total_models"),
                          F.coalesce(F.avg("accuracy"), F.lit(0.0)).cast(DEC).alias("average_accuracy"),
                          F.sum("training_samples").cast("bigint").alias("training_samples"))


@query("metrics_dashboard", oracle=with_views(["f_models"], MODEL_SEC, """
SELECT indicator, section, training_samples, CAST(coalesce(accuracy, 0) * 100 AS DECIMAL(18,6)) AS accuracy
FROM msec ORDER BY accuracy DESC, indicator"""))
def metrics_dashboard(ctx: Ctx):
    """Per-indicator metrics in percent, best first (null -> 0)."""
    m = models_sec(ctx)
    return (m.select("indicator", "section", "training_samples",
                     (F.coalesce("accuracy", F.lit(0.0)) * 100).cast(DEC).alias("accuracy"))
            .orderBy(F.col("accuracy").desc(), "indicator"))


@query("metrics_by_section", oracle=with_views(["f_models"], MODEL_SEC, """
SELECT indicator, section, training_samples, CAST(coalesce(accuracy, 0) * 100 AS DECIMAL(18,6)) AS accuracy
FROM msec WHERE lower(section) = lower(trim(' Biodiversity & Habitat '))"""))
def metrics_by_section(ctx: Ctx, section: str = " Biodiversity & Habitat "):
    """The dashboard filtered to one section, case-insensitive; blank = all."""
    m = models_sec(ctx)
    if section.strip():
        m = m.filter(F.lower("section") == section.strip().lower())
    return m.select("indicator", "section", "training_samples",
                    (F.coalesce("accuracy", F.lit(0.0)) * 100).cast(DEC).alias("accuracy"))


TARGETS = "SELECT DISTINCT indicator FROM a_long WHERE answer IS NOT NULL"


def targets(ctx: Ctx) -> DataFrame:
    """Target indicators: the pivot's columns (indicators with any answer)."""
    return ctx.answers.filter(F.col("answer").isNotNull()).select("indicator").distinct()


@query("coverage_semi", oracle=with_views(META_VIEWS, [("a_long", A_LONG), ("t", TARGETS)],
       "SELECT indicator FROM t WHERE indicator IN (SELECT indicator FROM f_models)"))
def coverage_semi(ctx: Ctx):
    """Target indicators that have a model."""
    return targets(ctx).join(ctx.models.select("indicator"), "indicator", "left_semi")


@query("coverage_anti", oracle=with_views(META_VIEWS, [("a_long", A_LONG), ("t", TARGETS)],
       "SELECT indicator FROM t WHERE indicator NOT IN (SELECT indicator FROM f_models)"))
def coverage_anti(ctx: Ctx):
    """Target indicators skipped (no model)."""
    return targets(ctx).join(ctx.models.select("indicator"), "indicator", "left_anti")


@query("coverage_report", oracle=with_views(META_VIEWS, [("a_long", A_LONG), ("t", TARGETS)], """
SELECT count(f.indicator) AS covered, count(*) AS total,
       CAST(count(f.indicator) * 100.0 / count(*) AS DECIMAL(18,6)) AS coverage_pct
FROM t LEFT JOIN f_models f ON t.indicator = f.indicator"""))
def coverage_report(ctx: Ctx):
    """Covered / total target indicators."""
    return H.coverage(targets(ctx), ctx.models)


@query("orphan_items", oracle=with_views(["f_items", "f_profiles"], [], """
SELECT i.run_id, i.indicator FROM f_items i
WHERE NOT EXISTS (SELECT 1 FROM f_profiles p WHERE p.row_id = CAST(i.run_id AS BIGINT))"""))
def orphan_items(ctx: Ctx):
    """Items whose run does not exist (foreign-key check as an anti join)."""
    it = ctx.items.withColumn("_rid", F.col("run_id").cast("bigint"))
    p = ctx.profiles.select(F.col("row_id").alias("_rid"))
    return it.join(p, "_rid", "left_anti").select("run_id", "indicator")


# Hand-set conditional metadata (v1 style): BH-2 is asked only when BH-1 is 'A'.
CONDITIONAL_OVERRIDES = [("BH-2", True, "BH-1", "A")]


@query("conditional_questions", oracle=with_views(["f_items"], [], """
SELECT i.run_id, i.indicator, i.predicted_value FROM f_items i
LEFT JOIN f_items p ON i.indicator = 'BH-2' AND p.run_id = i.run_id AND p.indicator = 'BH-1'
WHERE i.indicator <> 'BH-2' OR p.predicted_value = 'A'"""))
def conditional_questions(ctx: Ctx):
    """A conditional question is kept only when its parent's prediction in
    the same run equals the required value (parents resolved first)."""
    from fieldcast.operators.predict import resolve_conditionals
    ov = ctx.spark.createDataFrame(CONDITIONAL_OVERRIDES,
                                   "indicator string, conditional boolean, parent string, parent_value string")
    return resolve_conditionals(ctx.items.withColumnRenamed("predicted_value", "value"), ov, key="run_id") \
        .select("run_id", "indicator", F.col("value").alias("predicted_value"))


@query("manual_override", oracle=with_views(["f_profiles", "f_answers", "f_items", "f_models"], META_SQL + [
    ("manual", "SELECT indicator, type FROM meta WHERE type IN ('text', 'number')"),
    ("model_rows", """SELECT run_id, indicator, predicted_value AS value, confidence,
         CASE WHEN confidence >= 70 THEN 'auto_fill' WHEN confidence >= 40 THEN 'suggest' ELSE 'suggest_low' END AS policy,
         ui_status, 'count_model_v1' AS source, CAST(NULL AS VARCHAR) AS reason
       FROM f_items WHERE indicator IN (SELECT indicator FROM f_models)"""),
    ("manual_rows", """SELECT r.run_id, m.indicator, CAST(NULL AS VARCHAR) AS value, 0.0 AS confidence,
         'manual_entry' AS policy, 'red' AS ui_status, 'no_model' AS source,
         concat('Open ', m.type, ' field — AI cannot predict free-form input') AS reason
       FROM (SELECT DISTINCT run_id FROM f_items) r CROSS JOIN manual m""")], """
SELECT * FROM model_rows
UNION ALL
SELECT * FROM manual_rows mr WHERE NOT EXISTS
  (SELECT 1 FROM model_rows x WHERE x.run_id = mr.run_id AND x.indicator = mr.indicator)"""))
def manual_override(ctx: Ctx):
    """Manual rows for free-form questions, then model rows override the same key."""
    from fieldcast.operators.predict import manual_rows
    model_rows = (ctx.items.join(ctx.models.select("indicator"), "indicator", "left_semi")
                  .select("run_id", "indicator", F.col("predicted_value").alias("value"), "confidence",
                          X.confidence_policy("confidence").alias("policy"), "ui_status",
                          F.lit(C.SOURCE_MODEL).alias("source"), F.lit(None).cast("string").alias("reason")))
    run_ids = ctx.items.select("run_id").distinct()
    manual = manual_rows(run_ids, ctx.meta, key="run_id")
    return manual.join(model_rows.select("run_id", "indicator"), ["run_id", "indicator"], "left_anti") \
                 .unionByName(model_rows)


# ---------------------------------------------------------------- profiles
PLAN_SQL = """
SELECT row_id AS plan_id,
       CASE WHEN row_id % 7 = 0 THEN '' ELSE country_code END AS "countryCode", country_code AS country,
       CASE WHEN row_id % 11 = 0 THEN NULL ELSE crop_name END AS "cropName", crop_name AS crop,
       partner AS "partnerCode", partner, subpartner AS "subPartnerCode", subpartner,
       CASE row_id % 4 WHEN 0 THEN 'rainfed' WHEN 1 THEN 'drip' WHEN 2 THEN '' ELSE NULL END AS "irrigationType",
       hired_workers AS "hiredWorkers", hired_workers, CASE WHEN row_id % 5 = 0 THEN NULL ELSE area END AS "farmArea",
       area, "planYear"
FROM f_profiles"""


def plans(ctx: Ctx) -> DataFrame:
    """Plan-API-shaped records derived from the profiles (camelCase fields with gaps)."""
    p = ctx.profiles
    rid = F.col("row_id")
    return p.select(
        rid.alias("plan_id"),
        F.when(rid % 7 == 0, F.lit("")).otherwise(F.col("country_code")).alias("countryCode"),
        F.col("country_code").alias("country"), F.lit(None).cast("string").alias("country_code"),
        F.when(rid % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("crop_name")).alias("cropName"),
        F.col("crop_name").alias("crop"), F.lit(None).cast("string").alias("crop_name"),
        F.col("partner").alias("partnerCode"), "partner",
        F.col("subpartner").alias("subPartnerCode"), "subpartner",
        F.when(rid % 4 == 0, "rainfed").when(rid % 4 == 1, "drip").when(rid % 4 == 2, "").alias("irrigationType"),
        F.col("hired_workers").alias("hiredWorkers"), "hired_workers",
        F.when(rid % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("area")).alias("farmArea"), "area",
        "planYear", F.lit(None).cast("int").alias("plan_year"))


@query("plan_to_profile", oracle=with_views(["f_profiles"], [("plans", PLAN_SQL)], """
SELECT plan_id, coalesce(nullif("countryCode", ''), nullif(country, '')) AS country_code,
       coalesce(nullif("cropName", ''), nullif(crop, '')) AS crop_name,
       coalesce(nullif("partnerCode", ''), nullif(partner, '')) AS partner,
       coalesce(nullif("subPartnerCode", ''), nullif(subpartner, '')) AS subpartner,
       CASE WHEN "irrigationType" IS NOT NULL AND "irrigationType" NOT IN ('rainfed', 'none', '') THEN 'True' ELSE 'False' END AS irrigation,
       coalesce(nullif("hiredWorkers", ''), nullif(hired_workers, '')) AS hired_workers,
       coalesce("farmArea", area) AS area, "planYear"
FROM plans"""))
def plan_to_profile(ctx: Ctx):
    """P5: plan record -> profile with fallbacks and the irrigation rule."""
    return H.plan_to_profile(plans(ctx))


@query("normalize_crop", oracle=with_views(["f_profiles"], [("syn", SYN_VALUES)],
       f"SELECT row_id, {CROP_NORM.format(c='crop_name')} AS crop_name FROM f_profiles"))
def normalize_crop(ctx: Ctx):
    """Crop names through the synonym dictionary."""
    return FE.normalize_crop(ctx.profiles, ctx.spark).select("row_id", "crop_name")


@query("interaction_features", oracle=with_views(["f_profiles"], [("syn", SYN_VALUES)], f"""
SELECT row_id,
       concat_ws('_', {CROP_NORM.format(c='crop_name')}, coalesce(country_code, 'Unknown')) AS crop_country,
       concat_ws('_', {CROP_NORM.format(c='crop_name')}, coalesce(partner, 'Unknown')) AS crop_partner,
       concat_ws('_', coalesce(country_code, 'Unknown'), coalesce(partner, 'Unknown')) AS country_partner
FROM f_profiles"""))
def interaction_features(ctx: Ctx):
    """Interaction terms on normalised categories."""
    return FE.prepare(ctx.profiles, ctx.spark).select("row_id", "crop_country", "crop_partner", "country_partner")


COERCE = ("CASE WHEN CAST({c} AS VARCHAR) = 'True' THEN 1.0 WHEN CAST({c} AS VARCHAR) = 'False' THEN 0.0 "
          "ELSE coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0) END")


@query("coerce_numeric", oracle=with_views(["f_profiles"], [], f"""
SELECT row_id, {COERCE.format(c='hired_workers')} AS hired_workers, {COERCE.format(c='area')} AS area,
       {COERCE.format(c='"planYear"')} AS "planYear" FROM f_profiles"""))
def coerce_numeric(ctx: Ctx):
    """Numeric features as doubles (True/False -> 1/0, junk or null -> 0)."""
    return FE.coerce_numerics(ctx.profiles).select("row_id", "hired_workers", "area", "planYear")
