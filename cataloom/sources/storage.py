"""Written tables between the steps of a query: what several steps read is made once, and deleted when Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a folder under the warehouse, or a temporary one in local mode, where
    driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _made:
        local = spark.sparkContext.master.startswith("local")
        _made[app] = "file://" + tempfile.mkdtemp(prefix="cataloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cataloom-{app}"
    return _made[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for tables that results not yet read depend on; ``forget`` deletes it, at the latest when Python ends."""
    path = f"{shared_dir(spark)}/cataloom/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def forget(spark: SparkSession) -> int:
    """Delete this session's folders once their results are read; returns how many there were."""
    mine = [(s, path) for s, path in _folders if s is spark]
    for one in mine:
        _folders.remove(one)
        _delete(*one)
    return len(mine)


@atexit.register
def _forget_all() -> None:
    while _folders:
        spark, path = _folders.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the driver's JVM may be gone before Python ends
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
