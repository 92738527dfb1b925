"""Folding user corrections into the count model.

Corrections become counts: per (indicator, class, feature, value) for those
whose class the model knows, with '__class__' rows for the classes and
'__usable__' rows for all usable corrections of an indicator.  Counts of
separate batches add up, so a stream counts each batch once, and the rules
(enough usable corrections, two of known classes) apply to the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import countmodel as CM
from fieldcast.operators import history as H

INPUTS = ["country_code", "crop_name", "partner", "subpartner", "irrigation", "hired_workers", "area", "planYear"]
COUNTS = ["indicator", "class", "feature", "value"]


def feedback_record(posts: DataFrame) -> DataFrame:
    """Posted feedback as stored rows: an id where none is given (made
    once, so write the result before it is read twice), and ``helpful`` (true,
    false or null) as 1, 0 or null."""
    out = posts if "id" in posts.columns else posts.withColumn("id", F.expr("uuid()"))
    return out.withColumn("was_helpful", X.helpful_flag("helpful")).drop("helpful")


def save_feedback(posts: DataFrame, folder: str) -> DataFrame:
    """Append valid posts to ``folder/accepted`` and the others to
    ``folder/rejected``, and return the accepted rows with their ids."""
    from fieldcast.operators.util import materialize
    rows = materialize(feedback_record(posts), "feedback")
    valid = F.coalesce((F.col("indicator") != "") & (F.col("actual_value") != ""), F.lit(False))
    rows.filter(~valid).write.mode("append").parquet(f"{folder}/rejected")
    accepted = rows.filter(valid)
    accepted.write.mode("append").parquet(f"{folder}/accepted")
    return accepted


def correction_examples(fb: DataFrame, model: CM.CountModel, modelled: DataFrame, spark) -> DataFrame:
    """Usable corrections of modelled indicators to known classes, as training
    rows with all eight inputs of the record."""
    from fieldcast.operators.features import prepare
    known = model.classes.join(modelled.select("indicator"), "indicator", "left_semi") \
        .select("indicator", F.col("class").alias("actual_value"))
    rows = H.usable_feedback(fb).join(known, ["indicator", "actual_value"], "left_semi") \
        .select("indicator", F.col("actual_value").alias("class"), *INPUTS)
    return CM.bucket_features(prepare(rows, spark)).select("indicator", "class", *CM.NB_FEATURES)


def correction_counts(fb: DataFrame, model: CM.CountModel, modelled: DataFrame, spark) -> DataFrame:
    """(indicator, class, feature, value, n) of one batch of feedback."""
    corr = correction_examples(fb, model, modelled, spark)
    cells = CM.stack(corr, ["indicator", "class"]).select(*COUNTS)
    classes = corr.select("indicator", "class", F.lit("__class__").alias("feature"), F.lit("").alias("value"))
    usable = H.usable_feedback(fb).join(modelled.select("indicator"), "indicator", "left_semi") \
        .select("indicator", F.lit("").alias("class"), F.lit("__usable__").alias("feature"), F.lit("").alias("value"))
    return cells.unionByName(classes).unionByName(usable).groupBy(*COUNTS).agg(F.count(F.lit(1)).alias("n"))


def fold_counts(model: CM.CountModel, counts: DataFrame, min_corrections: int = C.MIN_CORRECTIONS) -> DataFrame:
    """M7: the model's counts plus those of all batches of corrections, for
    indicators with ``min_corrections`` usable corrections and two known ones."""
    total = counts.groupBy(*COUNTS).agg(F.sum("n").alias("n"))
    ready = total.filter((F.col("feature") == "__usable__") & (F.col("n") >= min_corrections)).select("indicator")
    two = total.filter(F.col("feature") == "__class__").groupBy("indicator").agg(F.sum("n").alias("k")).filter("k >= 2")
    corr = total.filter(F.col("feature") != "__usable__").join(ready, "indicator", "left_semi") \
        .join(two.select("indicator"), "indicator", "left_semi")
    classes = model.classes.select("indicator", "class", F.lit("__class__").alias("feature"),
                                   F.lit("").alias("value"), F.col("n_class").alias("n"))
    every = model.fv.select(*COUNTS, "n").unionByName(classes).unionByName(corr)
    return every.groupBy(*COUNTS).agg(F.sum("n").cast("bigint").alias("n"))


def fold_corrections(model: CM.CountModel, fb: DataFrame, modelled: DataFrame, spark) -> DataFrame:
    """M7: counts of the union of training rows and corrections — equal to
    refitting on the union, computed incrementally.  '__class__' rows carry the
    class counts."""
    return fold_counts(model, correction_counts(fb, model, modelled, spark))
