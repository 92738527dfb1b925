"""Profile features: crop normalisation, interactions, numeric coercion, label
encoders and modes (X4-X6, J2, J4, A4, A5, M1, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators.util import BROADCAST_MAX_ROWS, materialize

CATEGORICAL = C.CATEGORY_COLUMNS + [name for name, _, _ in C.INTERACTIONS]
FEATURE_NAMES = ([f"{c}_encoded" if c in C.CATEGORY_COLUMNS else c for c in C.FEATURE_COLUMNS]
                 + [f"{name}_encoded" for name, _, _ in C.INTERACTIONS])


def synonyms_table(spark: SparkSession, synonyms: dict[str, str] | None = None) -> DataFrame:
    """D14 without identity entries or note keys (keys starting with '_')."""
    syn = C.CROP_SYNONYMS if synonyms is None else synonyms
    rows = sorted((k.strip(), v.strip()) for k, v in syn.items()
                  if not k.startswith("_") and k.strip() != v.strip())
    return spark.createDataFrame(rows, "local string, canonical string")


def normalize_crop(df: DataFrame, spark: SparkSession, col: str = "crop_name",
                   synonyms: DataFrame | None = None) -> DataFrame:
    """Trimmed crop mapped through the synonym table; null -> 'Unknown'.
    The synonym table is a small literal dictionary, broadcast."""
    syn = F.broadcast(synonyms if synonyms is not None else synonyms_table(spark))
    t = df.withColumn("_crop_t", X.strip(F.col(col)))
    j = t.join(syn, t["_crop_t"] == syn["local"], "left")
    norm = F.when(F.col(col).isNull(), F.lit(C.UNKNOWN)).otherwise(F.coalesce("canonical", "_crop_t"))
    return j.withColumn(col, norm).drop("_crop_t", "local", "canonical")


def add_interactions(df: DataFrame) -> DataFrame:
    """crop_country, crop_partner, country_partner."""
    return df.withColumns({name: X.interaction(a, b) for name, a, b in C.INTERACTIONS})


def coerce_numerics(df: DataFrame) -> DataFrame:
    """hired_workers, area, planYear as doubles (True/False -> 1/0, junk -> 0)."""
    return df.withColumns({c: X.coerce_number(c) for c in C.NUMERIC_COLUMNS})


def prepare(df: DataFrame, spark: SparkSession, synonyms: DataFrame | None = None) -> DataFrame:
    """Raw profile -> the 8 categorical texts (null -> 'Unknown') + 3 numerics.
    ``synonyms`` (local, canonical) is the user's own table, as S6 reads it."""
    out = normalize_crop(df, spark, synonyms=synonyms)
    out = out.withColumns({c: X.category(c) for c in C.CATEGORY_COLUMNS if c != "crop_name"})
    out = add_interactions(out)
    return coerce_numerics(out)


def stack_categories(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., feature, value) — one row per categorical feature."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in CATEGORICAL])
    return df.select(*keep, F.explode(pairs).alias("_fv")).select(*keep, "_fv.feature", "_fv.value")


def fit_encoders(train: DataFrame) -> DataFrame:
    """(feature, value, code): sorted distinct values plus 'Unknown', coded
    0..n-1 in code-point order.  Distinct first (map-side), then a small window."""
    vals = stack_categories(train, []).distinct()
    unk = vals.select("feature").distinct().withColumn("value", F.lit(C.UNKNOWN))
    allv = vals.unionByName(unk).distinct()
    from pyspark.sql import Window
    w = Window.partitionBy("feature").orderBy("value")
    return allv.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def fit_modes(train: DataFrame) -> DataFrame:
    """A5: most frequent value per feature, ties -> smallest value."""
    counts = stack_categories(train, []).groupBy("feature", "value").count()
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))).alias("mode_value"))


def encode(df: DataFrame, encoders: DataFrame, modes: DataFrame, keep: list[str],
           unseen: str = "mode") -> DataFrame:
    """Categorical text -> code; an unseen value takes the mode's code
    (``unseen='mode'``) or the code of 'Unknown' (``unseen='unknown'``).

    The encoder is a dictionary bounded by the vocabulary: it is materialised,
    its size checked, and each of the 8 look-ups is then a broadcast hash join
    (the profile side never shuffles).  The 8 fallback codes are read to the
    driver as literals."""
    enc = materialize(encoders)
    small = enc.count() <= BROADCAST_MAX_ROWS
    fallback_value = (modes.select("feature", F.col("mode_value").alias("value")) if unseen == "mode"
                      else encoders.select("feature").distinct().withColumn("value", F.lit(C.UNKNOWN)))
    fb_rows = fallback_value.join(enc, ["feature", "value"]).select("feature", "code").collect()
    fallback = {r["feature"]: r["code"] for r in fb_rows}
    out = df
    for c in CATEGORICAL:
        e = (enc.filter(F.col("feature") == c)
                .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")))
        e = F.broadcast(e) if small else e
        out = (out.join(e, out[c] == e[f"_v_{c}"], "left")
                  .withColumn(f"{c}_encoded", F.coalesce(F.col(f"_c_{c}"), F.lit(fallback.get(c))).cast("int"))
                  .drop(f"_v_{c}", f"_c_{c}"))
    return out.select(*keep, *FEATURE_NAMES)
