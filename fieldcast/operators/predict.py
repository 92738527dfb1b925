"""Shaping predictions: value vs suggested options, policies, manual rows,
conditional questions and export rows (X7, X13, X14, U5, J9, S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X


def shape_values(pred: DataFrame, meta: DataFrame) -> DataFrame:
    """Checkbox questions carry the class in ``suggestedOptions`` (a one-element
    list, empty when there is no class); the others in ``value``."""
    m = meta.select("indicator", F.col("type").alias("_type"))
    j = pred.join(F.broadcast(m), "indicator", "left")
    cb = F.col("_type") == "checkbox"
    cls = F.col("predicted_class")
    opts = F.when(cb, F.when(cls.isNull(), F.array().cast("array<string>")).otherwise(F.array(cls)))
    return j.withColumn("value", F.when(cb, F.lit(None).cast("string")).otherwise(cls)) \
            .withColumn("suggestedOptions", opts).drop("_type")


def add_policy(pred: DataFrame, conf: str = "confidence") -> DataFrame:
    """Policy and UI status from the confidence."""
    return pred.withColumn("policy", X.confidence_policy(conf)).withColumn("ui_status", X.confidence_status(conf))


def export_rows(pred: DataFrame, key: str = "profile_id") -> DataFrame:
    """Indicator, Predicted_Value (value, else the options list as text),
    Confidence_% printed with one decimal."""
    opts = F.col("suggestedOptions")
    listed = F.when(F.size(opts) == 0, F.lit("[]")).otherwise(X.options_repr(opts))
    val = F.when(F.col("value").isNull() & opts.isNotNull(), listed).otherwise(F.col("value"))
    return pred.select(key, F.col("indicator").alias("Indicator"), val.alias("Predicted_Value"),
                       F.format_string("%.1f%%", F.col("confidence")).alias("Confidence_%"))


def write_export(pred: DataFrame, folder: str, key: str = "profile_id") -> None:
    """The export rows as CSV files with a header, written by the tasks."""
    export_rows(pred, key).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def manual_rows(keys: DataFrame, meta: DataFrame, key: str = "profile_id", modelled: list[str] | None = None) -> DataFrame:
    """One manual-entry row per free-form question (text / number), or if
    the modelled questions are given per question that is not one of them, for
    each key.  The question list is metadata (bounded by the questionnaire), read
    once and expanded per key with ``explode`` — no join."""
    asked = F.col("type").isin("text", "number") if modelled is None else ~F.col("indicator").isin(modelled)
    qs = meta.filter(asked).select("indicator", "type").orderBy("indicator").collect()
    if not qs:
        return keys.select(key).limit(0).select(
            key, F.lit(None).cast("string").alias("indicator"), F.lit(None).cast("string").alias("value"),
            F.lit(0.0).alias("confidence"), F.lit("manual_entry").alias("policy"), F.lit("red").alias("ui_status"),
            F.lit(C.SOURCE_NO_MODEL).alias("source"), F.lit(None).cast("string").alias("reason"))
    arr = F.array(*[F.struct(F.lit(r["indicator"]).alias("indicator"), F.lit(r["type"]).alias("type")) for r in qs])
    e = keys.select(key, F.explode(arr).alias("_q"))
    return e.select(key, F.col("_q.indicator").alias("indicator"), F.lit(None).cast("string").alias("value"),
                    F.lit(0.0).alias("confidence"), F.lit("manual_entry").alias("policy"),
                    F.lit("red").alias("ui_status"), F.lit(C.SOURCE_NO_MODEL).alias("source"),
                    X.manual_reason(F.col("_q.type")).alias("reason"))


def resolve_conditionals(pred: DataFrame, conditions: DataFrame, key: str = "profile_id",
                         value_col: str = "value") -> DataFrame:
    """Drop a conditional question's prediction unless its parent's
    prediction for the same key equals the required value.

    Parents are resolved before children (by depth), so a dropped parent drops
    its children.  Depth comes from the condition table (questionnaire-sized,
    read on the driver); each level is one join on (key, parent)."""
    conds = [r.asDict() for r in conditions.filter(F.coalesce("conditional", F.lit(False))).collect()]
    parent_of = {c["indicator"]: (c["parent"], c["parent_value"]) for c in conds}

    def depth(ind: str, seen=()) -> int:
        if ind not in parent_of or ind in seen:
            return 0
        return 1 + depth(parent_of[ind][0], seen + (ind,))

    levels: dict[int, list[str]] = {}
    for ind in parent_of:
        levels.setdefault(depth(ind), []).append(ind)
    kept = pred.filter(~F.col("indicator").isin(list(parent_of))) if parent_of else pred
    for d in sorted(levels):
        ids = levels[d]
        cond = conditions.filter(F.col("indicator").isin(ids)).select("indicator", "parent", "parent_value")
        cand = pred.filter(F.col("indicator").isin(ids)).join(cond, "indicator")
        par = kept.select(F.col(key).alias("_k"), F.col("indicator").alias("_pi"), F.col(value_col).alias("_pv"))
        ok = cand.join(par, (cand[key] == par["_k"]) & (cand["parent"] == par["_pi"]), "left") \
                 .filter(F.col("_pv") == F.col("parent_value"))
        kept = kept.unionByName(ok.select(*pred.columns))
    return kept


def fill_failed(pred: DataFrame) -> DataFrame:
    """X25 (v1 behaviour): a prediction that failed is kept as 'Unknown' with
    confidence 0; the v2 behaviour is simply to drop such rows (inner join)."""
    return pred.withColumn("predicted_class", F.coalesce("predicted_class", F.lit("Unknown"))) \
               .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
