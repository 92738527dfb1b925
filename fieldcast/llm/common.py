"""Shared pieces of the llm operators: reading tables and cutting Arrow batches.

Conventions that hold for every operator here:

* An operator selects the columns that it needs by name before anything else,
  so further columns of its input, whatever their names, never clash.
* A null text is an empty text.  A null ``doc_id`` sorts after every other one
  (``LAST_ID`` inside the operators) and comes out as null again.
* A row that repeats another one wholly gives the same result as that row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id while rows are compared: after every other id.
LAST_ID = 2**63 - 1

#: Bytes of text that a Python task works on at once (a longer text is one piece).
CHUNK_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart: a digest of 128 bits and the length in bytes (null: as the empty text)."""
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", F.md5(text.cast("binary")), F.octet_length(text))


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc long, text binary) of a documents table: what the Arrow tasks read."""
    return docs.select(id_or_last().alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column of each piece holds about ``limit`` bytes."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that tasks can import it wherever they run."""
    import os
    import shutil
    import tempfile

    context = spark.sparkContext
    if getattr(context, "_fieldcast_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "fieldcast"), "zip", root, "fieldcast")
    context.addPyFile(archive)
    context._fieldcast_shipped = True
