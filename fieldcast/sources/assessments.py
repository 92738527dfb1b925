"""Assessment inputs: CSV with a JSON answer cell, feedback JSON lines, synonym
dictionaries and request records (S1-S6, P4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import constants as C
from fieldcast.functions import scalar as X

FEEDBACK_JSONL_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("actual", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("input", T.MapType(T.StringType(), T.StringType())),
])

REQUEST_FIELDS = {
    "country_code": ["country"],
    "crop_name": ["crop"],
    "partner": ["partner"],
    "subpartner": ["subpartner"],
    "irrigation": ["irrigation"],
    "hired_workers": ["hired_workers"],
    "area": ["area"],
    "planYear": ["planYear", "plan_year"],
}


def read_assessments(spark: SparkSession, path: str, cell_col: str = "labelsAnswersMap") -> DataFrame:
    """CSV with a quoted JSON cell ("" escapes), header names stripped and
    aliased, missing feature columns added as nulls, and a ``row_id`` in input
    order (a monotonically increasing id: unique and ordered within and across
    file splits).  Only files with a cell over several lines are read whole by
    one task each; all others are split."""
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", has_line_breaks(spark, path)).option("encoding", "UTF-8").csv(path))
    raw = normalize_columns(raw)
    raw = add_missing_features(raw)
    return raw.withColumn("row_id", F.monotonically_increasing_id()).select(
        "row_id", *C.FEATURE_COLUMNS, *[c for c in raw.columns if c not in C.FEATURE_COLUMNS])


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes on over a line's end: such a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip header names, then map the aliases to canonical names."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumnsRenamed({a: b for a, b in C.COLUMN_ALIASES.items() if a in df.columns and b not in df.columns})


def add_missing_features(df: DataFrame) -> DataFrame:
    """S3: feature columns absent from the input become null columns."""
    missing = [c for c in C.FEATURE_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def read_feedback_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines feedback; malformed lines are dropped."""
    return spark.read.schema(FEEDBACK_JSONL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_feedback_jsonl(df: DataFrame, path: str) -> None:
    """Append feedback records as JSON lines."""
    df.write.mode("append").json(path)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """{local: canonical} JSON object -> (local, canonical); identity entries
    and note keys (starting with '_') dropped; a missing file gives no rows."""
    schema = "local string, canonical string"
    try:
        obj = spark.read.option("multiLine", True).text(path, wholetext=True)
    except Exception:  # noqa: BLE001 - optional file
        return spark.createDataFrame([], schema)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
    kv = obj.select(F.explode(m).alias("local", "canonical"))
    kv = kv.select(X.strip("local").alias("local"), X.strip("canonical").alias("canonical"))
    return kv.filter(~F.col("local").startswith("_") & (F.col("local") != F.col("canonical")))


def request_to_profile(requests: DataFrame) -> DataFrame:
    """API-style request records -> canonical profile columns (first present
    alternative wins, e.g. planYear then plan_year)."""
    cols = []
    for target, sources in REQUEST_FIELDS.items():
        present = [F.col(s) for s in sources if s in requests.columns]
        expr = F.coalesce(*present) if len(present) > 1 else (present[0] if present else F.lit(None))
        cols.append(expr.cast("double" if target == "area" else "int" if target == "planYear" else "string")
                    .alias(target))
    keep = [c for c in ["request_id", "profile_id"] if c in requests.columns]
    return requests.select(*keep, *cols)
