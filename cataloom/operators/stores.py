"""Documents and key-value pairs with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators.catalog import delete, upsert
from cataloom.operators.search import live


def get_many(store: DataFrame, keys: DataFrame, key: str, now: Column) -> DataFrame:
    """Live rows of the asked keys."""
    return store.where(live(F.col("expires_at"), now)).join(keys.select(key), key, "left_semi")


def put_many(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return upsert(store, rows, key, [F.col("updated_at")])


def delete_many(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return delete(store, keys, key)


def delete_expired(store: DataFrame, now: Column) -> DataFrame:
    return store.where(live(F.col("expires_at"), now))


def count_matching(store: DataFrame, key: str, pattern: str) -> DataFrame:
    return store.where(F.col(key).like(pattern)).agg(F.count("*").alias("n"))


def delete_matching(store: DataFrame, key: str, pattern: str) -> DataFrame:
    return store.where(~F.col(key).like(pattern))


def increment(store: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """Counters after deltas; a new key starts at 0."""
    return store.select(key, value).unionByName(deltas.select(key, value)).groupBy(key).agg(F.sum(value).cast("long").alias(value))


def count_by_field(documents: DataFrame, json: str, path: str, values: list[str] | None = None) -> DataFrame:
    """Documents by the value of a field, of all values or of some."""
    rows = documents.select(F.try_variant_get(F.col(json), f"$.{path}", "string").alias("value"))
    if values is not None:
        rows = rows.where(F.col("value").isin(values))
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def json_entries(rows: DataFrame, json: str) -> DataFrame:
    """A row for each top-level entry of a variant column: ``key`` of an object's field (null in an array), ``pos`` and
    ``value``, a variant. Rows whose value is null, a scalar or empty give none."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(json).outer()))


def entries_containing(rows: DataFrame, json: str, path: str, value: object) -> DataFrame:
    """Rows of which the array at a path has a value, or the object has it in a field, compared as text."""
    at = f"$.{path}" if path else "$"
    entries = F.coalesce(F.try_variant_get(json, at, "array<variant>"), F.map_values(F.try_variant_get(json, at, "map<string,variant>")))
    return rows.where(F.coalesce(F.exists(entries, lambda v: F.try_variant_get(v, "$", "string") == F.lit(str(value))), F.lit(False)))
