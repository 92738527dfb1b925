"""Helpers for intermediate tables that several plans reuse."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.session import shared_dir

# A dictionary side above this many rows is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 2_000_000
# So is one of more bytes than this, strings and arrays counted in full.
BROADCAST_MAX_BYTES = 128_000_000


_collecting: list[list[str]] = []


@contextmanager
def collected_tables():
    """The paths that ``materialize`` writes meanwhile, for ``drop_tables`` once nothing reads them any more."""
    _collecting.append([])
    try:
        yield _collecting[-1]
    finally:
        _collecting.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediate tables and empty the list."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Used for training rows, model and dictionary tables that several joins
    read: computed exactly once (``Dataset.checkpoint`` would compute an
    uncached plan twice), stored on shared storage so executor loss does not
    lose them, and read back with column pruning and filter push-down.  The
    folder is unique per call; a retried write overwrites its own output."""
    path = shared_dir(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    if _collecting:
        _collecting[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows and its bytes are few."""
    def width(field):
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        if kind in ("array", "map", "struct"):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        return F.lit(8)
    total = sum((width(f) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("bytes")).first()
    small = size["n"] <= BROADCAST_MAX_ROWS and (size["bytes"] or 0) <= BROADCAST_MAX_BYTES
    return F.broadcast(df) if small else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table scan at least one partition per core (for scans only: asking
    a plan with shuffles for its partitions would run them).

    A narrow plan keeps its input's partitioning; a small input file read as
    one split would run the whole stage in one task.  When the plan has fewer
    partitions than the cluster's default parallelism, rows are hash-spread
    by ``keys`` once; on large inputs (many splits) this is a no-op."""
    spark = df.sparkSession
    target = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


#: Rows that a task sorts at once; a table of more than the session's partitions hold so is dealt to more.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """The tasks that ``rows`` are to be dealt to, or none if the session's own shuffles hold them. These have
    the session's partitions, and of these adaptive execution may leave one per core: it goes by compressed
    bytes, which say little about the rows of a table of repeated values."""
    n, parts = -(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, parts) if n > min(parts, spark.sparkContext.defaultParallelism) else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table scan (its count is read from the file footers) dealt by ``keys`` to as many tasks as its
    rows ask for, if the session's shuffles have fewer: a sort that fits in memory is not spilled.
    It is the shuffle that a window or join on ``keys`` would make."""
    n = tasks_for(df.sparkSession, df.count())
    return df.repartition(n, *keys) if n else df


def distributed_rank(df: DataFrame, group_cols: list[str], order_col: str, out: str = "rank", tasks: int = 0) -> DataFrame:
    """Exact 1-based ``row_number()`` within each group ordered by ``order_col``
    (which must be unique within a group), without gathering a group in one task.

    Rows are range-partitioned on (group, order), so a hot group spans several
    ordered partitions.  A row's place in its sorted partition is written with it
    (range bounds are sampled at run time: a second evaluation could partition
    differently), and the counts of a group in each partition (at most one row per
    partition and one per group, cumulated with a window) give its rank: the rows
    are shuffled once.  ``tasks``: partitions at least."""
    from pyspark.sql import Window
    spark = df.sparkSession
    target = max(tasks, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the number of a partition in the upper bits, the place in it below
    s = (df.repartitionByRange(target, *group_cols, order_col)
           .sortWithinPartitions(*group_cols, order_col)
           .withColumn("_at", F.monotonically_increasing_id()))
    s = materialize(s, "ranked").withColumn("_pid", F.shiftright("_at", 33))
    counts = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_from")).drop("_cnt", "_from")
    return s.join(F.broadcast(materialize(offsets, "rank_offsets")), ["_pid", *group_cols]) \
            .withColumn(out, F.col("_off") + F.col("_at") + 1).drop("_pid", "_at", "_off")


# A group with more rows than this is ranked by the distributed path.
HOT_GROUP_ROWS = 2_000_000


def rank_within(df: DataFrame, group_cols: list[str], order_col: str, out: str = "rank",
                hot_rows: int = HOT_GROUP_ROWS, deal: bool = False) -> DataFrame:
    """Exact ``row_number()`` within groups, safe for hot groups.

    Group sizes are counted first.  Groups up to ``hot_rows`` rows are ranked
    by an ordinary window (one sort task per group is cheap); larger groups —
    at most total_rows / hot_rows of them, so their keys form a bounded list —
    go through :func:`distributed_rank`, which spreads them over ordered range
    partitions.  With ``deal`` both get as many tasks as their rows ask for."""
    from pyspark.sql import Window
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
    size = F.col("_size")
    told = sizes.agg(F.collect_list(F.when(size > hot_rows, F.struct(*group_cols))).alias("hot"),
                     F.sum(F.when(size > hot_rows, size)).alias("warm"), F.sum(size).alias("all")).first()
    hot, warm_rows = told["hot"], told["warm"] or 0
    tasks = tasks_for(df.sparkSession, (told["all"] or 0) - warm_rows) if deal else None
    w = Window.partitionBy(*group_cols).orderBy(order_col)

    def plain(rows: DataFrame) -> DataFrame:
        return (rows.repartition(tasks, *group_cols) if tasks else rows).withColumn(out, F.row_number().over(w))
    if not hot:
        return plain(df)
    schema = df.select(*group_cols).schema
    keys = F.broadcast(df.sparkSession.createDataFrame(hot, schema))
    cold = plain(df.join(keys, group_cols, "left_anti"))
    warm = distributed_rank(df.join(keys, group_cols, "left_semi"), group_cols, order_col, out,
                            (tasks_for(df.sparkSession, warm_rows) or 0) if deal else 0)
    return cold.unionByName(warm.select(*cold.columns))
