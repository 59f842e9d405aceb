"""Table scans: Parquet, and the other file formats that Spark reads, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; columns and filters are pushed into the scan by what follows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of_folder(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(file_name, html): stored HTML files under a folder, each read whole, named by their path below ``base``."""
    from pyspark.sql import functions as F

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), "^.*?" + base.rstrip("/") + "/", "")
    return files.select(F.regexp_replace(name, r"\.html$", "").alias("file_name"), F.col("value").alias("html"))
