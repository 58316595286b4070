"""LibSVM text in and out, through Spark's own ``libsvm`` data source."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.functions.random import md5_id
from plexnet.sources.lines import numbered_rows
from plexnet.sources.tables import split_column


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None,
                split: str | None = None) -> DataFrame:
    """(id, features ARRAY<DOUBLE>, label, split) from LibSVM files (1-based
    indices; missing indices are 0). Give ``num_features`` so train and
    validation files agree on the width. ``split`` fixes the split name for
    every row (the reference reads '<name>train' and '<name>val' files);
    otherwise rows are split by md5 of the id. The id is md5 of the file and
    the example's number in it: rows with equal lines have different ids, and
    a file gives the same ids however it is cut into splits. Wide data should
    stay sparse: see ``sources.sparse.read_libsvm_sparse``."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", int(num_features))
    df = numbered_rows(reader.load(path), "_number")
    feats = vector_to_array(F.col("features"), "float64")
    out = df.select(md5_id(F.col("file"), F.col("_number")).alias("id"), F.col("label").cast("double").alias("label"), feats.alias("features"))
    sp = F.lit(split) if split is not None else split_column(F.col("id"))
    return out.select("id", "features", "label", sp.alias("split"))


def write_libsvm(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (label, features) as LibSVM text (zeros are left out)."""
    (examples.select(F.col("label").cast("double").alias("label"),
                     array_to_vector(F.col("features")).alias("features"))
     .write.mode(mode).format("libsvm").save(path))
