"""Files in the shared folder that tasks write and read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from fieldcast.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the one that the cluster shares."""
    return shared_dir(spark, f"files/{name}-{uuid.uuid4().hex}")


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_output(path: str):
    system, inner = _filesystem(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_input(path: str):
    system, inner = _filesystem(path)
    return system.open_input_file(inner)
