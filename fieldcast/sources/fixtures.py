"""Driver tables -> domain tables.

The driver ships TPC-H-style parquet tables.  These functions derive the
domain tables (profiles, answers, prediction items, feedback, model
metrics, model registry) from them with plain DataFrame expressions, so
every operator downstream runs over whole driver tables and its work grows
with them.  The mapping is the one fixed in FIXTURES.md §B; the registry
log (events with event_type 'purchase') is our own addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.functions import scalar as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: list[tuple[object, object]], default: object) -> Column:
    expr = None
    for k, v in mapping:
        cond = col == F.lit(k)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per order: (row_id, country_code, crop_name, partner, subpartner,
    irrigation, hired_workers, area, planYear)."""
    from fieldcast.operators.util import spread
    # the scan alone is spread: its partitions are known without running anything
    o = spread(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("o_orderkey")
    crop = _case(k % 6, [(0, F.lit("ARROZ")), (1, F.lit("Rice")), (2, F.lit("Weizen")),
                         (3, F.lit(" Wheat")), (4, F.lit("Mais"))], F.lit("Soybean"))
    hired = _case(k % 10, [(0, F.lit("True")), (1, F.lit("False")), (2, F.lit("n/a"))],
                  (F.col("o_custkey") % 13).cast("string"))
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .select(k.alias("row_id"),
                     F.col("n_name").alias("country_code"),
                     crop.alias("crop_name"),
                     F.col("c_mktsegment").alias("partner"),
                     F.when(k % 33 == 0, F.col("o_orderpriority")).alias("subpartner"),
                     F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("irrigation"),
                     hired.alias("hired_workers"),
                     F.col("o_totalprice").alias("area"),
                     F.year("o_orderdate").cast("int").alias("planYear")))


# Columns that order a row's answer list (``pos`` is the rank in this order).
_ANSWER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                 "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _answer_columns() -> list[Column]:
    ln = F.col("l_linenumber")
    soa = _case(ln, [(1, F.lit("BH-1")), (2, F.lit(" BH-2")), (3, F.lit("CM-5")), (4, F.lit("NM-4")),
                     (5, F.lit("SM-5")), (6, F.lit("WI-6"))], F.lit("ZZ-7"))
    answer = (F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
               .when(ln == 1, F.col("l_returnflag"))
               .when(ln == 2, F.col("l_linestatus"))
               .when(ln == 3, F.concat(F.lit("Type "), (F.col("l_partkey") % 20).cast("string")))
               .when(ln == 4, F.floor("l_quantity").cast("bigint").cast("string"))
               .when(ln == 5, F.floor("l_extendedprice").cast("bigint").cast("string"))
               .when(ln == 6, F.when(F.col("l_discount") > 0.05, "True").otherwise("False"))
               .otherwise(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))))
    return [soa.alias("soaId"),
            F.when(ln % 2 == 1, F.concat(F.lit("Label "), ln.cast("string"))).alias("labelName"),
            answer.alias("answer"),
            (F.col("l_quantity") * 2).alias("confidence"),
            (100 - F.col("l_tax") * 100).alias("model_accuracy")]


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records as they come out of each row's nested list: (row_id, pos,
    soaId, labelName, answer, confidence, model_accuracy).  ``pos`` is the
    position in the row's list; the order is total (no duplicate lineitem rows).
    The window shuffles once on the order key; a later join on ``row_id``
    reuses that partitioning and ordering: the key gets its name, and the answers
    their texts, after the window.  In one ``select`` they would be made before it,
    so their texts would be shuffled too, and the rows once more for the join."""
    from fieldcast.operators.util import dealt
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*_ANSWER_ORDER)
    return li.withColumn("_pos", F.row_number().over(w).cast("int")) \
             .select(F.col("l_orderkey").alias("row_id"), F.col("_pos").alias("pos"), *_answer_columns())


def items(spark: SparkSession, sf_dir: str, run_key: int | None = None) -> DataFrame:
    """Prediction items: first answer per (run, indicator) with its confidence band.
    ``min_by`` over the list order aggregates map-side; no window sort needed.
    ``run_key`` restricts to one run with a filter the parquet scan receives."""
    li = table(spark, sf_dir, "lineitem")
    if run_key is not None:
        li = li.filter(F.col("l_orderkey") == F.lit(run_key))
    a = li.select(F.col("l_orderkey").alias("row_id"),
                  F.struct(*_ANSWER_ORDER).alias("ord"),
                  *_answer_columns()).withColumn("indicator", F.trim("soaId"))
    first = (a.groupBy("row_id", "indicator")
              .agg(F.min_by(F.struct("answer", "confidence", "model_accuracy"), F.col("ord")).alias("r")))
    conf = F.col("r.confidence")
    return first.select(
        F.col("row_id").cast("string").alias("run_id"),
        "indicator",
        F.col("r.answer").alias("predicted_value"),
        conf.alias("confidence"),
        F.when(conf >= 70, "green").when(conf >= 40, "amber").otherwise("red").alias("ui_status"),
        F.col("r.model_accuracy").alias("model_accuracy"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User feedback rows from ``events``."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    indicator = _case(et, [("view", F.lit("BH-1")), ("click", F.lit("BH-2")), ("signup", F.lit("CM-5")),
                           ("purchase", F.lit("WI-6"))], F.lit("QQ-9"))
    actual = (F.when(F.col("event_id") % 50 == 0, F.lit(""))
               .when(et == "view", F.lit("A"))
               .when(et == "click", F.lit("F"))
               .when(et == "signup", F.concat(F.lit("Type "), F.regexp_extract("props", "[0-9]+", 0)))
               .otherwise(F.lit("True")))
    helpful = X.helpful_flag(F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        indicator.alias("indicator"),
        actual.alias("actual_value"),
        helpful.alias("was_helpful"),
        F.concat(F.lit("Country"), (F.col("user_id") % 25).cast("string")).alias("country_code"),
        _case(F.col("event_id") % 4, [(0, F.lit("ARROZ")), (1, F.lit("Rice")), (2, F.lit(" Wheat"))],
              F.lit("Soybean")).alias("crop_name"),
        F.concat(F.lit("Partner"), (F.col("user_id") % 5).cast("string")).alias("partner"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Sub"), (F.col("user_id") % 3).cast("string"))).alias("subpartner"),
        F.when(F.col("event_id") % 2 == 0, "True").otherwise("False").alias("irrigation"),
        (F.col("user_id") % 13).cast("string").alias("hired_workers"),
        F.col("value").alias("area"),
        F.year("ts").cast("int").alias("planYear"))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture model table: one row per indicator with a model (all but SM-5)."""
    return (items(spark, sf_dir).filter(F.col("indicator") != "SM-5")
            .groupBy("indicator")
            .agg((F.avg("model_accuracy") / 100).alias("accuracy"),
                 F.count(F.lit(1)).alias("training_samples")))


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-registry writes: every 'purchase' event registers the version of its
    hour, so several writes hit the same version and the upsert has work to do."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    version = F.date_format(F.date_trunc("hour", "ts"), "'v_'yyyyMMdd_HHmmss")
    return e.select(
        version.alias("version"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("models/"), version, F.lit("/model")).alias("model_path"),
        (F.col("user_id") % 300).cast("int").alias("total_models"),
        F.col("value").alias("avg_accuracy"),
        F.col("event_id").cast("int").alias("training_rows"),
        F.col("props").alias("notes"),
        F.col("event_id").alias("write_id"))
