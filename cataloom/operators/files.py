"""Stored files: metadata and events of puts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators.catalog import delete, upsert


def put_files(metadata: DataFrame, saved: DataFrame, now: Column, order: list[Column], key: str = "file_name", time: str = "last_saved_at") -> tuple[DataFrame, DataFrame]:
    """(metadata, events) after some files were saved: the time of each is set, and each gives a FileSaved event."""
    stamped = saved.withColumn(time, now)
    return upsert(metadata, stamped, key, order), _events(saved, key, "FileSaved")


def delete_files(metadata: DataFrame, gone: DataFrame, key: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(metadata, events) after some files were deleted; a file that was not there gives no event."""
    known = metadata.join(gone.select(key).distinct(), key, "left_semi")
    return delete(metadata, gone, key), _events(known, key, "FileDeleted")


def _events(files: DataFrame, key: str, kind: str) -> DataFrame:
    return files.select(F.lit("file").alias("topic"), F.col(key).cast("string").alias("key"), F.lit(kind).alias("event")).distinct()
