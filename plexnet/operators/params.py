"""Parameter tables.

``params(model_id, layer, row, col, theta, velocity, gacc)``: layer l is an
(n_in + 1) x n_out matrix whose row 0 is the bias. All operators here work on
every model of a grid or a stored archive at once, keyed by ``model_id``.
The tables are parameter sized; the data never enters them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexnet.functions.random import md5_normal, md5_uniform

KEYS = ["model_id", "layer", "row", "col"]
PARAMS_COLS = KEYS + ["theta", "velocity", "gacc"]


def architecture(models: DataFrame, n_features: int) -> DataFrame:
    """Per model: layer sizes [features, hidden..., outputs], number of
    weight layers, weights and neurons."""
    sizes = F.concat(F.array(F.lit(int(n_features))), F.col("hidden"), F.array(F.col("outputs")))
    m = models.withColumn("sizes", sizes)
    n_layers = F.size("sizes") - 1
    weights = F.aggregate(
        F.sequence(F.lit(1), n_layers), F.lit(0).cast("bigint"),
        lambda acc, j: acc + (F.element_at("sizes", j) + 1) * F.element_at("sizes", j + 1))
    neurons = F.aggregate(F.col("hidden"), F.lit(0), lambda acc, h: acc + h) + F.col("outputs")
    return m.select("model_id", "sizes", n_layers.alias("n_layers"),
                    weights.alias("n_weights"), neurons.alias("n_neurons"))


def layer_grid(models: DataFrame, n_features: int) -> DataFrame:
    """(model_id, layer, n_in, n_out) for every weight layer."""
    arch = architecture(models, n_features)
    return (arch.select("model_id", "sizes",
                        F.posexplode(F.slice("sizes", 1, F.size("sizes") - 1)).alias("layer", "n_in"))
            .select("model_id", "layer", "n_in",
                    F.element_at("sizes", F.col("layer") + 2).alias("n_out")))


def weight_grid(models: DataFrame, n_features: int) -> DataFrame:
    """Every (model_id, layer, row, col) of the networks."""
    lg = layer_grid(models, n_features)
    return (lg.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_in"))))
              .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1))))


def init_theta(init: Column, fan: Column, seed: Column, n_features: int, outputs: Column) -> Column:
    """Fresh weight for the (layer, row, col) in scope; bias rows are 0.

    xuniform: U(-e, e), e = sqrt(6 / (F + O)), as u*2e - e
    xnormal:  N(0, 1) * sqrt(3 / (F + O))
    deeplearning: N(0, 1) * sqrt(1 / n), n = F, O or (F + O) / 2 by fan mode
    (F, O are the network-wide input and output widths, as in the reference)."""
    f = F.lit(float(n_features))
    o = outputs.cast("double")
    key = (seed, F.col("layer"), F.col("row"), F.col("col"))
    u = md5_uniform(*key)
    z = md5_normal(*key)
    eps_a = F.sqrt(F.lit(6.0) / (f + o))
    eps_b = F.sqrt(F.lit(3.0) / (f + o))
    n = (F.when(fan == "fan_in", f).when(fan == "fan_out", o)
         .when(fan == "fan_avg", (f + o) / 2.0))
    draw = (F.when(init == "xuniform", u * 2.0 * eps_a - eps_a)
            .when(init == "xnormal", z * eps_b)
            .when(init == "deeplearning", z * F.sqrt(F.lit(1.0) / n)))
    return F.when(F.col("row") == 0, F.lit(0.0)).otherwise(draw)


def init_params(models: DataFrame, n_features: int) -> DataFrame:
    """Fresh parameters (theta drawn, velocity and gradient sum zero)."""
    wg = weight_grid(models, n_features)
    cfg = models.select("model_id", "init", "fan", "seed", "outputs")
    theta = init_theta(F.col("init"), F.col("fan"), F.col("seed"), n_features, F.col("outputs"))
    return zero_state(wg.join(cfg, "model_id").select(*KEYS, theta.alias("theta")))


def zero_state(params: DataFrame) -> DataFrame:
    """Zero velocity and accumulated gradients (optimiser state)."""
    return params.select(*KEYS, "theta", F.lit(0.0).alias("velocity"), F.lit(0.0).alias("gacc"))


def layer_shapes(params: DataFrame) -> DataFrame:
    """Rows, columns and weight count of every stored layer."""
    return (params.groupBy("model_id", "layer")
            .agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"),
                 F.count(F.lit(1)).alias("n")))


def check_shapes(stored: DataFrame, fresh: DataFrame, layers_taken: DataFrame) -> None:
    """Raise when a stored layer that is taken over has another shape than the
    fresh one (the reference does not check)."""
    s = layer_shapes(stored).alias("s")
    f = layer_shapes(fresh).alias("f")
    bad = (layers_taken.alias("t")
           .join(s, ["model_id", "layer"]).join(f, ["model_id", "layer"], "left")
           .where((F.col("f.rows").isNull()) | (F.col("s.rows") != F.col("f.rows"))
                  | (F.col("s.cols") != F.col("f.cols")) | (F.col("s.n") != F.col("s.rows") * F.col("s.cols")))
           .select("model_id", "layer", F.col("s.rows").alias("stored_rows"),
                   F.col("s.cols").alias("stored_cols"), F.col("f.rows").alias("rows"),
                   F.col("f.cols").alias("cols"))
           .limit(5).collect())
    if bad:
        raise ValueError(f"stored weights do not fit the network: {[r.asDict() for r in bad]}")


def warm_start(fresh: DataFrame, stored: DataFrame, mode: str = "AE", check: bool = True) -> DataFrame:
    """Combine stored weights with fresh ones.

    AE: every stored layer, fresh layers after them; PT: stored layers except
    the stored last one; RND: fresh only. ``stored`` holds (model_id, layer,
    row, col, theta) for the same model ids as ``fresh``."""
    if mode == "RND":
        return fresh
    if mode not in ("AE", "PT"):
        raise ValueError("warm start mode must be AE, PT or RND")
    st = stored.select(*KEYS, F.col("theta").alias("stored_theta"))
    last = stored.groupBy("model_id").agg(F.max("layer").alias("last_layer"))
    keep = st.join(last, "model_id")
    if mode == "PT":
        keep = keep.where(F.col("layer") < F.col("last_layer"))
    keep = keep.drop("last_layer")
    if check:
        check_shapes(stored, fresh, keep.select("model_id", "layer").distinct())
    out = fresh.join(keep, KEYS, "left")
    return out.select(*KEYS, F.coalesce("stored_theta", "theta").alias("theta"),
                      "velocity", "gacc")


def weight_norms(params: DataFrame) -> DataFrame:
    """Sum of squared weights without bias rows, per model."""
    return (params.groupBy("model_id")
            .agg(F.sum(F.when(F.col("row") > 0, F.col("theta") * F.col("theta"))
                       .otherwise(F.lit(0.0))).alias("sq_weights")))


def flatten_params(params: DataFrame, value: str = "theta") -> DataFrame:
    """Row-major flat array per model, ordered by (layer, row, col)."""
    st = F.sort_array(F.collect_list(F.struct("layer", "row", "col", value)))
    return (params.groupBy("model_id").agg(st.alias("_s"))
            .select("model_id", F.transform("_s", lambda s: s[value]).alias("flat")))


def weight_positions(models: DataFrame, n_features: int) -> DataFrame:
    """(model_id, layer, row, col, pos): position in the row-major flat array."""
    lg = layer_grid(models, n_features).withColumn("size", (F.col("n_in") + 1) * F.col("n_out"))
    w = Window.partitionBy("model_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    lg = lg.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))
    wg = (lg.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_in"))))
            .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1))))
    return wg.select(*KEYS, (F.col("offset") + F.col("row") * F.col("n_out") + F.col("col"))
                     .cast("bigint").alias("pos"))


def unflatten_params(flat: DataFrame, models: DataFrame, n_features: int,
                     value: str = "theta") -> DataFrame:
    """Inverse of ``flatten_params``: flat arrays back to (layer, row, col)."""
    ex = flat.select("model_id", F.posexplode("flat").alias("pos", value))
    pos = weight_positions(models, n_features)
    return pos.join(ex, ["model_id", "pos"]).select(*KEYS, value)


#: Values of one row of a flat model.
FLAT_CHUNK = 65_536


def _layer_ends(shapes: DataFrame) -> DataFrame:
    """(model_id, starts, cols) from ``shapes(model_id, layer, rows, cols)``: where each layer begins in the
    flat array, and its width. One row a model, one entry a layer."""
    w = Window.partitionBy("model_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("rows").cast("bigint") * F.col("cols")
    each = shapes.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return each.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("layer", "start", "cols"))).alias("_l")).select(
        "model_id", F.col("_l.start").alias("starts"), F.col("_l.cols").alias("cols"))


def flatten_chunks(params: DataFrame, chunk: int = FLAT_CHUNK, value: str = "theta") -> DataFrame:
    """(model_id, chunk, flat): the row-major flat array of every model in
    pieces of ``chunk`` values, so that no model is ever one row. A weight's
    place follows from the shapes of the layers before it."""
    ends = _layer_ends(layer_shapes(params))
    at = params.select(*KEYS, F.col(value).alias("_v")).join(ends, "model_id").select(
        "model_id", (F.get("starts", F.col("layer")) + F.col("row").cast("bigint") * F.get("cols", F.col("layer")) + F.col("col")).alias("pos"), "_v")
    pieces = at.groupBy("model_id", F.expr(f"pos div {int(chunk)}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "_v"))).alias("_s"))
    return pieces.select("model_id", "chunk", F.col("_s._v").alias("flat"))


def unflatten_chunks(flat: DataFrame, models: DataFrame, n_features: int, chunk: int = FLAT_CHUNK, value: str = "theta") -> DataFrame:
    """Inverse of ``flatten_chunks``: (model_id, layer, row, col, <value>)."""
    shapes = layer_grid(models, n_features).select("model_id", "layer", (F.col("n_in") + 1).alias("rows"), F.col("n_out").alias("cols"))
    each = flat.select("model_id", "chunk", F.posexplode("flat").alias("_i", value)).join(_layer_ends(shapes), "model_id")
    each = each.withColumn("pos", F.col("chunk") * int(chunk) + F.col("_i")).withColumn("layer", F.size(F.filter("starts", lambda s: s <= F.col("pos"))) - 1)
    each = each.withColumn("_local", F.col("pos") - F.get("starts", F.col("layer"))).withColumn("_cols", F.get("cols", F.col("layer")))
    return each.select("model_id", F.col("layer").cast("int").alias("layer"), F.expr("CAST(_local div _cols AS INT)").alias("row"), F.expr("CAST(_local % _cols AS INT)").alias("col"), value)


def n_weights_of(sizes: list[int]) -> int:
    return sum((sizes[i] + 1) * sizes[i + 1] for i in range(len(sizes) - 1))


def init_scale(init: str, fan: str, n_features: int, outputs: int) -> float:
    if init == "xuniform":
        return math.sqrt(6.0 / (n_features + outputs))
    if init == "xnormal":
        return math.sqrt(3.0 / (n_features + outputs))
    n = {"fan_in": n_features, "fan_out": outputs, "fan_avg": (n_features + outputs) / 2.0}[fan]
    return math.sqrt(1.0 / n)
