"""Feedback as a stream: running counts (T2) and an incremental model refresh.

The feedback log is a folder of parquet files (append-only).  Both jobs read
it with ``readStream`` and run by default with ``trigger(availableNow=True)``:
every file present is processed in micro-batches, then the query stops; run it
on a schedule, or give the refresh ``processingTime='1 hour'``.  The checkpoint
location is the only coordination: a restarted job resumes after the last
committed batch, and each batch's output is keyed by ``batch_id``, so a replayed
batch overwrites rather than duplicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import constants as C
from fieldcast.operators import countmodel as CM
from fieldcast.operators import history as H
from fieldcast.operators.util import materialize
from fieldcast.session import shared_dir
from fieldcast.sources import store

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("actual_value", T.StringType()),
    T.StructField("was_helpful", T.IntegerType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("crop_name", T.StringType()),
    T.StructField("partner", T.StringType()),
    T.StructField("subpartner", T.StringType()),
    T.StructField("irrigation", T.StringType()),
    T.StructField("hired_workers", T.StringType()),
    T.StructField("area", T.DoubleType()),
    T.StructField("planYear", T.IntegerType()),
])


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def land_feedback(fb: DataFrame, folder: str, files: int = 8) -> str:
    """Write feedback rows as a log of ``files`` parquet files, grouped by day,
    the way an append-only landing folder fills up."""
    (fb.select(*[f.name for f in FEEDBACK_SCHEMA.fields])
       .repartition(files, F.to_date("created_at"))
       .write.mode("append").parquet(folder))
    return folder


def feedback_counts_stream(spark: SparkSession, source: str, out: str, checkpoint: str,
                           files_per_trigger: int = 2) -> None:
    """Running (total, helpful, not_helpful) per indicator.  Stateful
    aggregation in complete mode; the state is one row per indicator."""
    stream = (spark.readStream.schema(FEEDBACK_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    counts = H.feedback_counts(stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (counts.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _state(spark: SparkSession, out: str, before: int | None = None) -> tuple[int, DataFrame] | None:
    """The newest committed correction counts (of batches below ``before``) and their batch."""
    done = [int(name) for name in store.committed(spark, f"{out}/state")]
    done = [b for b in done if before is None or b < before]
    return (max(done), spark.read.parquet(f"{out}/state/{max(done):012d}")) if done else None


def refit_stream(spark: SparkSession, source: str, out: str, checkpoint: str, model: CM.CountModel,
                 modelled: DataFrame, files_per_trigger: int = 2, trigger: dict | None = None, publish=None):
    """Each micro-batch is read once and added to the correction counts so far.

    The counts after batch N are one table, ``out/state/N``, that counts once its
    marker stands; the table before the last is dropped, so the state does not
    grow with the number of batches.  A replayed batch starts from the table
    before it and writes the same one again.  ``publish(counts, fresh, batch_id)``
    is then called with the counts so far and those of the batch.  ``trigger`` is
    Spark's: ``{"availableNow": True}`` by default, which returns when the log is
    read, or ``{"processingTime": "1 hour"}``, which returns the running query."""
    from fieldcast.operators.feedback import COUNTS, correction_counts
    stream = (spark.readStream.schema(FEEDBACK_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source))

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = materialize(correction_counts(batch, model, modelled, spark), "corrections")
        past = _state(spark, out, batch_id)
        total = fresh if past is None else fresh.unionByName(past[1]).groupBy(*COUNTS).agg(F.sum("n").alias("n"))
        name = f"{batch_id:012d}"
        total.coalesce(1).write.mode("overwrite").parquet(f"{out}/state/{name}")
        store.commit(spark, f"{out}/state", name)
        if publish:
            publish(spark.read.parquet(f"{out}/state/{name}"), fresh, batch_id)
        if past:
            store.drop_before(spark, f"{out}/state", f"{past[0]:012d}")

    trigger = trigger or {"availableNow": True}
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if "processingTime" not in trigger:
        q.awaitTermination()
    return q


def publisher(spark: SparkSession, root: str, registry_dir: str, model: CM.CountModel, tables: dict[str, DataFrame],
              min_corrections: int = C.MIN_CORRECTIONS):
    """What ``refit_stream`` calls: a new version wherever a batch has corrections of an indicator that has enough.

    The version is named by the batch, so a replayed batch finds it published.
    ``tables`` are the base version's (its metadata, encoders and modes stay)."""
    from fieldcast.operators.feedback import fold_counts

    def publish(counts: DataFrame, fresh: DataFrame, batch_id: int) -> bool:
        enough = counts.filter((F.col("feature") == "__usable__") & (F.col("n") >= min_corrections)).select("indicator")
        if fresh.filter(F.col("feature") == "__class__").join(enough, "indicator", "left_semi").isEmpty():
            return False
        folded = materialize(fold_counts(model, counts, min_corrections), "folded")
        is_class = F.col("feature") == "__class__"
        refit = CM.from_counts(folded.filter(is_class).select("indicator", "class", F.col("n").alias("n_class")), folded.filter(~is_class))
        parts = {**tables, "classes": refit.classes, "fv": refit.fv, "vocab": refit.vocab}
        return store.publish(spark, root, f"v_stream_{batch_id:012d}", parts, registry_dir=registry_dir, notes=f"feedback batch {batch_id}")

    return publish


def latest_model(spark: SparkSession, out: str, model: CM.CountModel) -> DataFrame:
    """Counts with the corrections of all batches so far."""
    from fieldcast.operators.feedback import fold_counts
    state = _state(spark, out)
    none = spark.createDataFrame([], "indicator string, class string, feature string, value string, n long")
    return fold_counts(model, state[1] if state else none)
