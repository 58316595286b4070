"""Lines of text files with their numbers.

A file is read in splits by many tasks. Counting the lines of each split and
summing the counts of the splits before it gives every line its number in the
file, whatever the split size; no file is ever one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_rows(scan: DataFrame, name: str = "line") -> DataFrame:
    """A plain scan of files with each row's file (``file``) and number in it,
    from 0. The scan runs twice (the first time it only counts); what the
    counts take is one row per split."""
    raw = scan.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                      F.monotonically_increasing_id().alias("_at"))
    splits = raw.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("_file"), F.col("_start").alias("_s"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per split: without the hint the estimate is the size of the files, and all their rows would be shuffled
    out = raw.join(F.broadcast(splits), (raw["file"] == splits["_file"]) & (raw["_start"] == splits["_s"]))
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_s", "_start", "_at", "_first", "_before")


def numbered_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(value, *partition columns, file, line) of the text files of ``path``;
    blank lines count. ``schema`` gives the types of partition columns, with ``value``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return numbered_rows(reader.text(path))
