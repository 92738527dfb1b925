"""Question metadata derived from the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators.util import materialize


def section_map(spark: SparkSession) -> DataFrame:
    """D15 as a 40-row DataFrame (a literal; safe to broadcast)."""
    return spark.createDataFrame(sorted(C.SECTION_MAP.items()), "prefix string, section string")


def with_section(df: DataFrame, spark: SparkSession, id_col: str = "indicator") -> DataFrame:
    """Section from the id's letter prefix, 'General' when unknown."""
    sm = F.broadcast(section_map(spark))
    out = df.withColumn("_prefix", X.section_prefix(id_col))
    out = out.join(sm, out["_prefix"] == sm["prefix"], "left").drop("prefix", "_prefix")
    return out.withColumn("section", F.coalesce(F.col("section"), F.lit(C.DEFAULT_SECTION)))


def value_summary(answers: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """One pass over the answers: (indicator, value, first_label) where value is
    the cleaned answer (null for blanks) and first_label the earliest non-blank
    label in that group as struct(order, label).  Everything question_meta
    needs derives from this table, which is bounded by the number of distinct
    answers, so it is written once and the answers are read once."""
    order_cols = order_cols or ["row_id", "pos"]
    lab = X.strip("labelName")
    first_label = F.min(F.when(lab.isNotNull() & (F.length(lab) > 0),
                               F.struct(F.struct(*order_cols).alias("o"), lab.alias("label"))))
    return (answers.select("indicator", X.clean_answer("answer").alias("value"), "labelName", *order_cols)
                   .groupBy("indicator", "value").agg(first_label.alias("first_label")))


def infer_types(answers: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """(indicator, type, n_values, options) from the observed answers.

    Counts and flags are plain aggregates over the distinct values; option
    lists are only gathered for indicators with at most 75 values, so no
    unbounded list is ever collected into one group."""
    summary = summary if summary is not None else materialize(value_summary(answers))
    values = summary.filter(F.col("value").isNotNull()).select("indicator", "value")
    all_ids = summary.select("indicator").distinct()
    stats = (values.groupBy("indicator").agg(
        F.count("value").alias("n_values"),
        F.bool_and(X.is_boolean_text("value")).alias("all_bool"),
        F.bool_and(X.is_numeric_text("value")).alias("all_num"),
        F.avg(F.length("value")).alias("avg_len")))
    stats = all_ids.join(stats, "indicator", "left").fillna({"n_values": 0})
    n, all_bool, all_num, avg_len = (F.col("n_values"), F.col("all_bool"), F.col("all_num"), F.col("avg_len"))
    q_type = (F.when(n == 0, "text")
               .when(all_bool, "radio")
               .when(all_num & (n <= C.MAX_NUMERIC_OPTIONS), "radio")
               .when(all_num, "number")
               .when((n <= C.MAX_TEXT_OPTIONS) & ((n >= C.CHECKBOX_MIN_OPTIONS) | (avg_len > C.CHECKBOX_MIN_AVG_LEN)),
                     "checkbox")
               .when(n <= C.MAX_TEXT_OPTIONS, "radio")
               .otherwise("text"))
    stats = stats.withColumn("type", q_type)
    listed = (stats.filter((F.col("type") != "text") & (F.col("type") != "number") & ~F.col("all_bool"))
                   .select("indicator", "all_num"))
    small = values.join(listed, "indicator")
    # numeric options sort by value (non-parsable last, H7), text by code point
    num = F.col("value").try_cast("double")
    sort_key = F.when(F.col("all_num"), F.struct(num.isNull().alias("k0"), num.alias("k1"), F.col("value").alias("k2"))) \
                .otherwise(F.struct(F.lit(False).alias("k0"), F.lit(None).cast("double").alias("k1"),
                                    F.col("value").alias("k2")))
    opts = (small.groupBy("indicator")
                 .agg(F.array_sort(F.collect_list(F.struct(sort_key.alias("k"), F.col("value").alias("v"))))
                      .alias("_o"))
                 .select("indicator", F.transform("_o", lambda s: s["v"]).alias("options")))
    out = stats.join(opts, "indicator", "left")
    options = (F.when(F.col("all_bool") & (n > 0), F.array(*[F.lit(o) for o in C.BOOLEAN_OPTIONS]))
                .otherwise(F.coalesce(F.col("options"), F.array().cast("array<string>"))))
    return out.select("indicator", "type", "n_values", options.alias("options"))


def question_meta(answers: DataFrame, spark: SparkSession, order_cols: list[str] | None = None) -> DataFrame:
    """(indicator, type, section, labelName, conditional, parent, parent_value,
    options, multi).  Conditional questions come only from overrides (H9).
    The answers are read once (see :func:`value_summary`)."""
    summary = materialize(value_summary(answers, order_cols))
    types = infer_types(answers, summary)
    labels = summary.groupBy("indicator").agg(
        F.coalesce(F.min("first_label").getField("label"), F.lit("")).alias("labelName"))
    meta = with_section(types.join(labels, "indicator", "left"), spark)
    return meta.select(
        "indicator", "type", "section",
        F.coalesce("labelName", F.lit("")).alias("labelName"),
        F.lit(False).alias("conditional"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("parent_value"),
        "options",
        (F.col("type") == "checkbox").alias("multi"))


def apply_overrides(meta: DataFrame, overrides: DataFrame) -> DataFrame:
    """Hand-set metadata (e.g. conditional parents) wins over derived values."""
    o = overrides.select("indicator", *[F.col(c).alias(f"_o_{c}") for c in overrides.columns if c != "indicator"])
    out = meta.join(o, "indicator", "left")
    for c in overrides.columns:
        if c != "indicator" and c in meta.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"_o_{c}"), F.col(c)))
    return out.select(*meta.columns)
