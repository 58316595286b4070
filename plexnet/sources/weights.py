"""Weight files and parameter tables.

Text form (one file per model): first line ``n0_n1_..._nk_activation``, then
one value per line for every layer, row and column in row-major order
(row 0 of each layer is the bias). Reading: missing trailing values stay 0,
extra values are an error. Many models are read and written at once, one
folder ``model_id=<id>`` per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.operators.params import KEYS, layer_shapes
from plexnet.sources.lines import numbered_lines

TEXT_SCHEMA = "value string, model_id string"
PARAMS_FILE_SCHEMA = ("layer int, row int, col int, theta double, velocity double, gacc double, "
                      "model_id string")


#: Positions that one row spreads into when missing last values are filled in.
CHUNK = 65_536


def write_weights_text(params: DataFrame, path: str, activation="sigmoid", mode: str = "overwrite") -> None:
    """Header and flat weights per model; ``activation`` is a name, a dict
    model_id -> name or a DataFrame (model_id, activation). Lines are streamed
    in (layer, row, col) order: each model's rows go to one task (one file per
    model is the format) and are sorted there, so no model is ever held as a
    single row or array."""
    shapes = layer_shapes(params)
    sizes = (shapes.groupBy("model_id")
             .agg(F.sort_array(F.collect_list(F.struct("layer", "rows", "cols"))).alias("_l"))
             .select("model_id", F.concat(F.array(F.element_at("_l", 1)["rows"] - 1),
                                          F.transform("_l", lambda s: s["cols"])).alias("sizes")))
    if isinstance(activation, dict):
        activation = params.sparkSession.createDataFrame(list(activation.items()), "model_id string, activation string")
    if isinstance(activation, DataFrame):
        sizes = sizes.join(activation.select("model_id", F.col("activation").alias("_act")), "model_id", "left")
    else:
        sizes = sizes.withColumn("_act", F.lit(activation))
    header = sizes.select(
        "model_id", F.lit(0).alias("_k"), F.lit(-1).alias("layer"), F.lit(0).alias("row"),
        F.lit(0).alias("col"),
        F.concat(F.array_join(F.transform("sizes", lambda s: s.cast("string")), "_"), F.lit("_"),
                 F.coalesce("_act", F.lit("sigmoid"))).alias("value"))
    values = params.select("model_id", F.lit(1).alias("_k"), "layer", "row", "col",
                           F.col("theta").cast("string").alias("value"))
    lines = (header.unionByName(values).repartition("model_id")
             .sortWithinPartitions("model_id", "_k", "layer", "row", "col"))
    lines.select("model_id", "value").write.mode(mode).partitionBy("model_id").text(path)


def read_weights_text(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, layer, row, col, theta, activation) of every model file:
    folders ``model_id=<id>`` as ``write_weights_text`` makes them, or plain
    files (one, a folder or a glob of them) with the file's path as model id.
    A file is read in splits by many tasks; a line's number gives its weight's
    place. A blank line between values raises, since later weights would move;
    blank lines at the end are ignored, and missing last values stay 0."""
    if "model_id" in spark.read.text(path).columns:
        lines = numbered_lines(spark, path, TEXT_SCHEMA)
    else:
        lines = numbered_lines(spark, path).withColumn("model_id", F.col("file"))
    lines = lines.select("model_id", "file", "line", F.trim(F.regexp_replace("value", r"\s", " ")).alias("value"))
    hdr = F.split(F.col("value"), "_")  # of any line: the ones that are no header give nulls
    head = lines.where("line = 0").select(
        "model_id", "file", F.transform(F.slice(hdr, 1, F.size(hdr) - 1), lambda x: x.try_cast("int")).alias("sizes"),
        F.element_at(hdr, -1).alias("activation"))
    n_layers = F.greatest(F.size("sizes") - 1, F.lit(1))
    layer_size = F.transform(F.sequence(F.lit(1), n_layers),
                             lambda j: (F.get("sizes", j - 1).cast("bigint") + 1) * F.get("sizes", j))
    ends = F.transform(F.sequence(F.lit(1), n_layers),
                       lambda k: F.aggregate(F.slice(layer_size, 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    head = head.withColumn("ends", ends).withColumn("n_weights", F.get("ends", F.size("ends") - 1))
    found = lines.groupBy("model_id", "file").agg(F.max(F.when(F.col("value") != "", F.col("line"))).alias("n_values"),
                                                  (F.count_if(F.col("value") != "") - 1).alias("n_full"))
    files = head.join(found, ["model_id", "file"])
    for what, bad in (("no header of layer sizes", F.col("n_weights").isNull()), ("more values than the header allows", F.col("n_values") > F.col("n_weights")),
                      ("a blank line between values", F.col("n_full") != F.col("n_values"))):
        wrong = files.where(bad).select("model_id")
        first = [r[0] for r in wrong.limit(5).collect()]
        if first:
            raise ValueError(f"weight files with {what}: first {len(first)} of {wrong.count()}: {first}")
    shape = ["sizes", "ends", "activation"]
    given = lines.where("line > 0 AND value <> ''").join(head, ["model_id", "file"]).select(
        "model_id", (F.col("line") - 1).alias("pos"), F.col("value").cast("double").alias("theta"), *shape)
    # positions that the file leaves out, a chunk of them per row first
    rest = files.where("n_values < n_weights").withColumn("_chunk", F.explode(F.sequence(F.expr(f"n_values div {CHUNK}"), F.expr(f"(n_weights - 1) div {CHUNK}"))))
    rest = rest.select("model_id", F.explode(F.sequence(F.greatest("n_values", F.col("_chunk") * CHUNK), F.least(F.col("n_weights") - 1, F.col("_chunk") * CHUNK + CHUNK - 1))).alias("pos"),
                       F.lit(0.0).alias("theta"), *shape)
    g = given.unionAll(rest).withColumn("layer", F.size(F.filter("ends", lambda e: e <= F.col("pos"))))
    start = F.coalesce(F.get("ends", F.col("layer") - 1), F.lit(0))
    cols = F.get("sizes", F.col("layer") + 1)
    local = F.col("pos") - start
    return g.select("model_id", F.col("layer").cast("int").alias("layer"), local.alias("_local"), cols.alias("_cols"), "theta", "activation").select(
        "model_id", "layer", F.expr("_local div _cols").cast("int").alias("row"), (F.col("_local") % F.col("_cols")).cast("int").alias("col"), "theta", "activation")


def write_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Native table form: Parquet, one folder per model."""
    cols = [c for c in ("velocity", "gacc") if c in params.columns]
    params.select(*KEYS, "theta", *cols).write.mode(mode).partitionBy("model_id").parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PARAMS_FILE_SCHEMA).parquet(path)
    return df.select(*KEYS, "theta", "velocity", "gacc")
