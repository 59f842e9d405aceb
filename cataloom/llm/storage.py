"""Shared-folder storage: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made where none is named, and tables written, by application.
_made: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one under the warehouse, which a cluster shares;
    a temporary folder only in local mode, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _made:
            if spark.sparkContext.master.startswith("local"):
                _made[app] = "file://" + tempfile.mkdtemp(prefix="cataloom-")
            else:
                _made[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cataloom-{app}"
        found = _made[app]
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The tables stay until ``discard`` or ``clear``, as results that are not yet read depend on them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cataloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing unread depends on any more."""
    for frame in frames:
        spark = frame.sparkSession
        _written[spark.sparkContext.applicationId].remove(frame.stored_at)
        _delete(spark, frame.stored_at)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are over: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> int:
    """Delete the tables that this application has stored, once their results are read; returns how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def light_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python functions get at most ``rows`` rows at a time: batches are counted in rows and texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)
