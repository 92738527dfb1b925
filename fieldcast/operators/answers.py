"""Long answer table: explode, clean, first answer, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import constants as C
from fieldcast.functions import scalar as X

ANSWER_ITEM = T.StructType([
    T.StructField("soaId", T.StringType()),
    T.StructField("labelName", T.StringType()),
    T.StructField("answer", T.VariantType()),
])


def _answer_text(v) -> F.Column:
    """JSON scalar -> text as the reference stringifies it: booleans become
    'True'/'False' (H6); strings unchanged; numbers in their shortest form."""
    kind = F.schema_of_variant(v)
    as_bool = F.try_variant_get(v, "$", "boolean")
    return (F.when(v.isNull() | (kind == "NULL"), F.lit(None).cast("string"))
             .when(kind == "BOOLEAN", F.when(as_bool, "True").otherwise("False"))
             .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"),
                   F.try_variant_get(v, "$", "double").cast("string"))
             .otherwise(F.try_variant_get(v, "$", "string")))


def explode_cells(raw: DataFrame, cell_col: str = "labelsAnswersMap", keep: list[str] | None = None,
                  row_id_col: str = "row_id") -> DataFrame:
    """Parse the JSON list in ``cell_col`` and emit one row per element
    with its position.  A null, empty or unparsable cell yields no rows."""
    keep = keep if keep is not None else [c for c in raw.columns if c != cell_col]
    parsed = F.from_json(F.col(cell_col), T.ArrayType(ANSWER_ITEM), {"mode": "PERMISSIVE"})
    df = raw.select(*keep, parsed.alias("_items"))
    df = df.select(*keep, F.posexplode("_items").alias("pos", "_it"))
    return df.select(*keep, (F.col("pos") + 1).cast("int").alias("pos"),
                     F.col("_it.soaId").alias("soaId"),
                     F.col("_it.labelName").alias("labelName"),
                     _answer_text(F.col("_it.answer")).alias("answer"))


def bad_json_rows(raw: DataFrame, cell_col: str = "labelsAnswersMap") -> DataFrame:
    """P2 side output: rows whose cell is present but not a JSON list."""
    parsed = F.from_json(F.col(cell_col), T.ArrayType(ANSWER_ITEM), {"mode": "PERMISSIVE"})
    return raw.filter(F.col(cell_col).isNotNull() & parsed.isNull())


def clean_indicators(df: DataFrame, id_col: str = "soaId") -> DataFrame:
    """indicator = trimmed id; rows with a null or blank id are dropped."""
    return (df.withColumn("indicator", X.strip(F.col(id_col)))
              .filter(F.col("indicator").isNotNull() & (F.length("indicator") > 0)))


def answers_long(raw_answers: DataFrame, profiles: DataFrame,
                 profile_cols: list[str] | None = None) -> DataFrame:
    """D3: (row_id, pos, <profile>, indicator, labelName, answer).

    Both inputs are keyed by ``row_id``; the join is a sort-merge join on it
    (the answers side is already clustered by row_id when it comes from a
    window over the row key, so only the profile side shuffles)."""
    profile_cols = profile_cols or C.FEATURE_COLUMNS
    a = clean_indicators(raw_answers).select("row_id", "pos", "indicator", "labelName", "answer")
    p = profiles.select("row_id", *profile_cols)
    return a.join(p, "row_id").select("row_id", "pos", *profile_cols, "indicator", "labelName", "answer")


def _order_key(order_cols: list[str]) -> F.Column:
    return F.struct(*[F.col(c) for c in order_cols])


def first_answer(answers: DataFrame, profile_cols: list[str] | None = None,
                 order_cols: list[str] | None = None, null_keys: str = "keep") -> DataFrame:
    """The first answer (in input order) per (profile, indicator).

    ``min_by`` over the order key is deterministic and aggregates map-side,
    so a hot profile or indicator never gathers its rows in one task.
    A null first answer is kept as null (H2).  ``min(struct(order..., answer))``
    is the same choice as ``min_by`` (the order is unique) with a cheaper buffer.  ``null_keys='drop'`` drops
    profiles with a null key column, as a pandas pivot does (H1)."""
    profile_cols = profile_cols or C.FEATURE_COLUMNS
    order_cols = order_cols or ["row_id", "pos"]
    if null_keys == "drop":
        for c in profile_cols:
            answers = answers.filter(F.col(c).isNotNull())
    first = F.min(F.struct(*[F.col(c) for c in order_cols], F.col("answer").alias("_a")))
    return (answers.groupBy(*profile_cols, "indicator")
                   .agg(first.getField("_a").alias("answer")))


#: A profile of more rows than this is hot: its answers are never sorted in one task.
HOT_PROFILE_ROWS = 100_000


def hot_profiles(profiles: DataFrame, profile_cols: list[str] | None = None) -> list[int]:
    """The hashes of profiles that very many rows share: a list of at most all rows / ``HOT_PROFILE_ROWS``."""
    name = F.xxhash64(*(profile_cols or C.FEATURE_COLUMNS)).alias("_h")
    return [r["_h"] for r in profiles.select(name).groupBy("_h").count().filter(F.col("count") > HOT_PROFILE_ROWS).collect()]


def first_answer_rows(answers: DataFrame, profile_cols: list[str] | None = None, order_cols: list[str] | None = None,
                      tasks: int | None = None, hot: list[int] | None = None) -> DataFrame:
    """Like :func:`first_answer`, plus ``first_row_id``: the row the answer came from.

    The aggregation sorts its rows, since its buffer holds text.  ``tasks`` deals them by
    profile and indicator to that many tasks, where each is sorted once; the
    profiles whose hashes are ``hot`` are still aggregated before they are shuffled."""
    profile_cols = profile_cols or C.FEATURE_COLUMNS
    order_cols = order_cols or ["row_id", "pos"]
    if tasks:
        keys = [*profile_cols, "indicator"]
        if not hot:
            return first_answer_rows(answers.repartition(tasks, *keys), profile_cols, order_cols)
        of_hot = F.xxhash64(*profile_cols).isin(hot)
        return first_answer_rows(answers.filter(~of_hot).repartition(tasks, *keys), profile_cols, order_cols) \
            .unionByName(first_answer_rows(answers.filter(of_hot), profile_cols, order_cols))
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                           F.col("answer").alias("_a"), F.col("row_id").alias("_r")))
    r = answers.groupBy(*profile_cols, "indicator").agg(first.alias("_f"))
    return r.select(*profile_cols, "indicator", F.col("_f._a").alias("answer"),
                    F.col("_f._r").alias("first_row_id"))


def pivot_answers(answers: DataFrame, indicators: list[str], profile_cols: list[str] | None = None,
                  order_cols: list[str] | None = None, null_keys: str = "keep") -> DataFrame:
    """One row per distinct profile, one column per indicator.

    One aggregation: for each indicator ``min_by(answer, order)`` restricted to
    that indicator's rows (the order key is null elsewhere, and min_by skips
    null keys).  Profiles whose cells are all null are dropped (H2).  The
    indicator list is passed explicitly, so no extra job discovers it."""
    profile_cols = profile_cols or C.FEATURE_COLUMNS
    order_cols = order_cols or ["row_id", "pos"]
    if null_keys == "drop":
        for c in profile_cols:
            answers = answers.filter(F.col(c).isNotNull())
    # min of (order, answer) restricted to one indicator's rows = its first answer
    key = F.struct(*[F.col(c) for c in order_cols], F.col("answer").alias("_a"))
    aggs = [F.min(F.when(F.col("indicator") == ind, key)).getField("_a").alias(ind) for ind in indicators]
    wide = answers.groupBy(*profile_cols).agg(*aggs)
    if indicators:
        from functools import reduce
        wide = wide.filter(reduce(lambda a, b: a | b, [F.col(f"`{i}`").isNotNull() for i in indicators]))
    return wide


def indicators_with_answers(answers: DataFrame) -> list[str]:
    """Sorted indicators that hold at least one non-null answer (the pivot's
    column list; bounded by the questionnaire size, not by the data)."""
    rows = (answers.filter(F.col("answer").isNotNull()).select("indicator").distinct()
                   .orderBy("indicator").collect())
    return [r[0] for r in rows]
