"""History tables and analytics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X


def usable_feedback(fb: DataFrame) -> DataFrame:
    """Feedback with a non-empty actual value."""
    return fb.filter(F.col("actual_value").isNotNull() & (F.col("actual_value") != ""))


def feedback_counts(fb: DataFrame) -> DataFrame:
    """Total / helpful / not helpful per indicator."""
    return fb.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("was_helpful") == 1, 1).otherwise(0)).cast("bigint").alias("helpful"),
        F.sum(F.when(F.col("was_helpful") == 0, 1).otherwise(0)).cast("bigint").alias("not_helpful"))


def corrections_for(fb: DataFrame, indicator: str) -> DataFrame:
    """A10: (indicator, corrections) of one indicator: its feedback rows, 1 if it has none."""
    n = fb.filter(F.col("indicator") == indicator).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(indicator).alias("indicator"), F.coalesce(F.nullif("n", F.lit(0)), F.lit(1)).cast("bigint").alias("corrections"))


def feedback_ready(fb: DataFrame, models: DataFrame, min_corrections: int = C.MIN_CORRECTIONS) -> DataFrame:
    """A16 + J8: indicators with a model and at least ``min_corrections`` usable corrections."""
    counts = usable_feedback(fb).groupBy("indicator").agg(F.count(F.lit(1)).alias("n_corrections"))
    return (counts.filter(F.col("n_corrections") >= min_corrections)
                  .join(models.select("indicator"), "indicator", "left_semi"))


def known_class_corrections(fb: DataFrame, ready: DataFrame, classes: DataFrame) -> DataFrame:
    """Corrections of ready indicators whose actual value is a class the model
    knows; an indicator keeps its corrections only if at least two survive."""
    c = usable_feedback(fb).join(ready.select("indicator"), "indicator", "left_semi")
    known = classes.select("indicator", F.col("class").alias("actual_value"))
    c = c.join(known, ["indicator", "actual_value"], "left_semi")
    n = c.groupBy("indicator").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    return c.join(n.select("indicator"), "indicator", "left_semi")


def latest_per_key(log: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row per key (upsert view over an append-only log)."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k_per_group(df: DataFrame, group: str, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group by ``order``; Spark plans this as a group limit
    before the window (WindowGroupLimit), so a hot group never sorts whole."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def coverage(targets: DataFrame, models: DataFrame) -> DataFrame:
    """Covered / total target indicators and the ratio."""
    t = targets.select("indicator").distinct()
    m = models.select("indicator").distinct().withColumn("_has", F.lit(1))
    j = t.join(m, "indicator", "left")
    return j.agg(F.count("_has").alias("covered"), F.count(F.lit(1)).alias("total")) \
            .withColumn("coverage_pct", (F.col("covered") * 100.0 / F.col("total")).cast("decimal(18,6)"))


def question_catalog(meta: DataFrame, models: DataFrame) -> DataFrame:
    """Questions with availability flags."""
    m = models.select("indicator").distinct().withColumn("_has", F.lit(True))
    j = meta.join(m, "indicator", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    free = F.col("type").isin("text", "number")
    return j.select(F.col("indicator").alias("indicatorCode"), "labelName", "type", "section",
                    (has | ~free).alias("aiAvailable"), (~has & free).alias("manualEntry"), "options")


def plan_to_profile(plans: DataFrame) -> DataFrame:
    """P5: plan record -> profile, with truthiness fallbacks (H4) and the irrigation rule."""
    t = X.truthy
    irr = F.col("irrigationType")
    irrigated = irr.isNotNull() & ~irr.isin("rainfed", "none", "")
    return plans.select(
        "plan_id",
        F.coalesce(t("countryCode"), t("country_code"), t("country")).alias("country_code"),
        F.coalesce(t("cropName"), t("crop_name"), t("crop")).alias("crop_name"),
        F.coalesce(t("partnerCode"), t("partner")).alias("partner"),
        F.coalesce(t("subPartnerCode"), t("subpartner")).alias("subpartner"),
        F.when(irrigated, "True").otherwise("False").alias("irrigation"),
        F.coalesce(t("hiredWorkers"), t("hired_workers")).alias("hired_workers"),
        F.coalesce(F.col("farmArea"), F.col("area")).alias("area"),
        F.coalesce(F.col("planYear"), F.col("plan_year")).alias("planYear"))
