"""Run summaries and sustainability scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X

DEC = "decimal(18,6)"


def run_summary(pred: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: count, auto-filled (green), needs review, mean and high confidence."""
    green = F.col("ui_status") == "green"
    return (pred.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_indicators"),
        F.count_if(green).alias("auto_filled_count"),
        F.count_if(~green | F.col("ui_status").isNull()).alias("needs_review_count"),
        F.avg("confidence").cast(DEC).alias("average_confidence"),
        F.count_if(F.col("confidence") >= C.HIGH_CONFIDENCE_THRESHOLD).alias("high_confidence"))
        .withColumn("saved_minutes", F.col("auto_filled_count") * C.MINUTES_PER_AUTO_FILL))


def weighted_scores(pred: DataFrame, key: str = "run_id") -> DataFrame:
    """Weighted mean of per-item scores, per run and per (run, section), in one
    aggregation over GROUPING SETS ((run), (run, section)).  Weight = model
    accuracy / 100; green counts its confidence, amber 0.6 x, red/manual 0."""
    st = F.col("ui_status")
    w = F.coalesce(F.col("model_accuracy"), F.lit(50.0)) / 100.0
    s = (F.when(st == "green", F.col("confidence"))
          .when(st == "amber", F.col("confidence") * C.AMBER_SCORE_FACTOR).otherwise(F.lit(0.0)))
    df = pred.select(key, "section", (s * w).alias("sw"), w.alias("w"))
    agg = df.groupingSets([[key], [key, "section"]], key, "section").agg(
        F.sum("sw").alias("sum_sw"), F.sum("w").alias("sum_w"), F.grouping("section").alias("_g"))
    score = F.when(F.col("sum_w") > 0, F.col("sum_sw") / F.col("sum_w")).otherwise(F.lit(0.0))
    return agg.select(key, "section", F.col("_g").cast("boolean").alias("overall"), score.alias("score"))


def score_presentation(scores: DataFrame, key: str = "run_id") -> DataFrame:
    """Band, colour and range from the score rounded to one decimal.

    The score is first snapped to 9 decimals: a weighted mean of round inputs
    often sits exactly on a .x5 tie, and float noise from summation order must
    not decide which way it rounds."""
    r = F.round(F.round("score", 9), 1)
    return scores.select(key, F.col("score").cast(DEC).alias("score"), r.alias("score_rounded"),
                         X.score_band(r).alias("band"), X.score_band_color(r).alias("band_color"),
                         X.score_range(r).alias("score_range"))
