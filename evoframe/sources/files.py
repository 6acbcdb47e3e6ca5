"""Small files in whatever store a path names: manifests and statistics, never data."""

from __future__ import annotations

import json

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, the default one where it names none."""
    store, at = _at(spark, path)
    return store.makeQualified(at).toString()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    store, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def write_json(spark: SparkSession, path: str, held: dict, overwrite: bool = True) -> bool:
    """Write a document; False, and nothing written, if it is there already and is not to be replaced."""
    store, at = _at(spark, path)
    try:
        stream = store.create(at, overwrite)
    except Exception as error:
        if not overwrite and store.exists(at):
            return False
        raise error
    stream.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    stream.close()
    return True


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A document; None for one whose writer was lost before its end."""
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (ValueError, CapturedException):
        return None
    finally:
        stream.close()
