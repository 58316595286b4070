"""The distributed pass: score, evaluate and gradient sums.

Plan shape (``explain`` shows it): Scan parquet (pruned to the fixture's
columns) -> Project -> [InMemoryTableScan when cached] -> MapInArrow ->
HashAggregate(partial) -> Exchange(model_id, layer, row, col) ->
HashAggregate(final). Rows of the data never shuffle; only parameter-sized
partial sums do, one block per task. The weights of all models travel once
per pass in a broadcast variable whose size is checked against
``MAX_BROADCAST_BYTES`` first.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plexnet.functions.activations import get_activation
from plexnet.operators.kernel import (BLOCK_COLS, BLOCKS_SCHEMA, N_SCALARS, SCALAR_NAMES,
                                      SUMS_SCHEMA, NetSpec, score_kernel, sums_kernel)
from plexnet.session import scratch_path
from plexnet.shipping import ensure_importable

# The weights shipped with one pass must fit a broadcast: their size is
# (sum of weights over models) x 8 bytes (twice for Nesterov look-ahead
# weights), known from the architecture before anything is shipped. A grid
# over the bound is split into groups, one scan per group (``group_specs``);
# only a single model over the bound is refused.
MAX_BROADCAST_BYTES = 1 << 30


def specs_from_pandas(params_pdf: pd.DataFrame, models_pdf: pd.DataFrame,
                      value: str = "theta", lookahead_mu: dict | None = None) -> list[NetSpec]:
    """Dense weight matrices per model from a parameter table on the driver
    (parameter sized; the size is checked before it is broadcast)."""
    cfg = models_pdf.set_index("model_id")
    specs = []
    for mid, g in params_pdf.groupby("model_id", sort=True):
        if mid not in cfg.index:
            continue
        row = cfg.loc[mid]
        ws, las = [], []
        for layer, gl in g.groupby("layer", sort=True):
            rows = int(gl["row"].max()) + 1
            cols = int(gl["col"].max()) + 1
            if len(gl) != rows * cols:
                raise ValueError(f"model {mid} layer {layer}: {len(gl)} weights for {rows}x{cols}")
            w = np.zeros((rows, cols))
            w[gl["row"].to_numpy(), gl["col"].to_numpy()] = gl[value].to_numpy()
            ws.append(w)
            if lookahead_mu is not None:
                v = np.zeros((rows, cols))
                v[gl["row"].to_numpy(), gl["col"].to_numpy()] = gl["velocity"].to_numpy()
                las.append(w + lookahead_mu.get(mid, 0.0) * v)
        outputs = int(row["outputs"])
        if ws[-1].shape[1] != outputs:
            raise ValueError(f"model {mid}: output layer has {ws[-1].shape[1]} units, expected {outputs}")
        specs.append(NetSpec(model_id=str(mid), weights=ws, activation=str(row["activation"]),
                             multi=outputs > 1, loss=str(row.get("loss", "log") or "log"),
                             lookahead=las if lookahead_mu is not None and mid in lookahead_mu else None))
    return specs


def specs_from_frames(params: DataFrame, models: DataFrame, **kw) -> list[NetSpec]:
    """Weights of a parameter table, after a check of its size: a model over
    the broadcast bound is refused before any of it comes to the driver
    (``operators.sharded`` takes such models)."""
    each = 16 if kw.get("lookahead_mu") else 8
    for r in params.groupBy("model_id").agg((F.count("*") * each).alias("size")).where(F.col("size") > MAX_BROADCAST_BYTES).limit(1).collect():
        raise ValueError(f"model {r['model_id']} has {r['size']} bytes of weights, over the broadcast bound {MAX_BROADCAST_BYTES}")
    p = params.select("model_id", "layer", "row", "col", "theta",
                      *(["velocity"] if kw.get("lookahead_mu") else [])).toArrow().to_pandas()
    m = models.select("model_id", "outputs", "activation", "loss").toPandas()
    return specs_from_pandas(p, m, **kw)


def spec_bytes(spec: NetSpec) -> int:
    n = sum(int(w.size) for w in spec.weights)
    return 8 * n * (2 if spec.lookahead is not None else 1)


def group_specs(specs: list[NetSpec], max_bytes: int | None = None) -> list[list[NetSpec]]:
    """Models in groups whose weights fit one broadcast (first fit, in order)."""
    bound = int(max_bytes or MAX_BROADCAST_BYTES)
    groups, cur, size = [], [], 0
    for s in specs:
        b = spec_bytes(s)
        if b > bound:
            raise ValueError(f"model {s.model_id} has {b} bytes of weights, over the broadcast "
                             f"bound {bound}")
        if cur and size + b > bound:
            groups.append(cur)
            cur, size = [], 0
        cur.append(s)
        size += b
    if cur:
        groups.append(cur)
    return groups


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def balance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Opt-in: spread an under-partitioned file scan (e.g. one Parquet row group read
    as a single task) round-robin over the cluster's cores. Use it on a bare
    scan only: counting partitions there lists files and runs no job (on a
    plan with a shuffle, adaptive execution would have to run that shuffle
    to count). Inputs that already have at least that many partitions (any
    large table) are left alone, so no shuffle is added at scale."""
    if df.isStreaming:
        return df
    target = int(min_partitions or df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def _broadcast(spark, specs):
    ensure_importable(spark)
    bc = spark.sparkContext.broadcast(specs)
    for shipped in _SHIPPED.get():
        shipped.append(bc)
    return bc


_SHIPPED: ContextVar[tuple] = ContextVar("shipped", default=())


@contextmanager
def released_broadcasts():
    """Destroy the weight broadcasts of all passes built in the block when it
    ends. Only for passes whose results are read inside the block."""
    own: list = []
    token = _SHIPPED.set((*_SHIPPED.get(), own))
    try:
        yield
    finally:
        _SHIPPED.reset(token)
        for bc in own:
            bc.destroy()


def activations_of(specs: list[NetSpec]) -> dict:
    """name -> (function, derivative) in NumPy of the specs' activations. They
    travel inside the task's closure, so that activations registered on the
    driver work on every executor."""
    return {s.activation: (get_activation(s.activation).numpy, get_activation(s.activation).d_numpy) for s in specs}


def _width(examples: DataFrame, specs: list[NetSpec]) -> int:
    widths = {int(s.weights[0].shape[0]) - 1 for s in specs}
    if len(widths) != 1:
        raise ValueError(f"models of one pass must share the input width, got {sorted(widths)}")
    return widths.pop()


def sums_pass(examples: DataFrame, specs: list[NetSpec], train: Column | None = None,
              batch: Column | None = None, val: Column | None = None,
              with_grads: bool = True, layout: str = "keyed",
              draw: tuple | None = None, draw_key: str = "bkey", merge_groups: int | None = None) -> DataFrame:
    """One scan of ``examples`` for all models: gradient sums of the rows
    where ``batch`` holds, costs of ``train`` rows and metrics of ``val`` rows.
    Returns (model_id, layer, row, col, value); layer -1 rows are the scalar
    sums named in ``kernel.SCALAR_NAMES``. With ``layout="blocks"`` it returns
    (model_id, block, v0..v63) instead: the same sums, 64 to a row (what the
    training loop reads). ``draw=(fraction, seed, epoch)`` narrows the batch
    rows to the mini-batch drawn from the key column ``draw_key`` inside the
    kernel (same numbers as ``examples.in_batch``). ``merge_groups`` merges the
    sums of the tasks in two levels (see :func:`merged_sums`)."""
    groups = group_specs(specs)
    if len(groups) > 1:
        return _union([sums_pass(examples, g, train, batch, val, with_grads, layout, draw, draw_key, merge_groups)
                       for g in groups])
    spark = examples.sparkSession
    n_features = _width(examples, specs)
    bc = _broadcast(spark, specs)
    no = F.lit(False)
    src = examples.select("features", "label",
                          (train if train is not None else no).alias("_t"),
                          (batch if batch is not None else no).alias("_b"),
                          (val if val is not None else no).alias("_v"),
                          *([F.col(draw_key).alias("_k")] if draw is not None else []))

    acts = activations_of(specs)

    def fn(batches):
        return sums_kernel(batches, bc.value, n_features, with_grads, layout, draw, acts)

    if layout == "blocks":
        return merged_sums(src.mapInArrow(fn, BLOCKS_SCHEMA), ["model_id", "block"], BLOCK_COLS, merge_groups)
    return merged_sums(src.mapInArrow(fn, SUMS_SCHEMA), ["model_id", "layer", "row", "col"], ["value"], merge_groups)


def merged_sums(parts: DataFrame, key: list[str], cols: list[str], groups: int | None = None) -> DataFrame:
    """Sums of the tasks' partial sums by ``key``. With ``groups``, sums are
    merged inside that many groups of tasks first, then across the groups:
    a task of the last exchange reads at most one row per key and group, however
    many map tasks there are, and no key's sums meet in a single task before.
    About the square root of the number of map tasks balances the two levels."""
    if groups is not None:
        parts = parts.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(int(groups)))).groupBy(*key, "_group").sum(*cols).toDF(*key, "_group", *cols)
    # GroupedData.sum over the columns: one call to plan (64 separate sum()
    # columns cost about a second of py4j round trips per pass)
    return parts.groupBy(*key).sum(*cols).toDF(*key, *cols)


def stored_sums(sums: DataFrame) -> DataFrame:
    """The parameter-sized sums of a pass, run once and written to the shared
    folder. The steps read sums in several branches; without this each branch
    would run its own network pass over the data."""
    spark = sums.sparkSession
    path = scratch_path(spark, "sums")
    sums.write.parquet(path)
    return spark.read.schema(sums.schema).parquet(path)


def scalars_wide(sums: DataFrame) -> DataFrame:
    """The scalar rows of a pass as one row per model with named columns."""
    aggs = [F.sum(F.when(F.col("row") == i, F.col("value"))).alias(name)
            for i, name in enumerate(SCALAR_NAMES)]
    return sums.where(F.col("layer") == -1).groupBy("model_id").agg(*aggs)


def score(examples: DataFrame, params: DataFrame, models: DataFrame, what: str = "p",
          specs: list[NetSpec] | None = None, keep: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """(id, model_id, p ARRAY<DOUBLE>) for every example and model, with the
    example's columns named in ``keep``. ``id_col`` may have any type. Works
    on streaming DataFrames too (mapInArrow is a narrow, stateless operator)."""
    specs = specs if specs is not None else specs_from_frames(params, models)
    groups = group_specs(specs)
    if len(groups) > 1:
        return _union([score(examples, params, models, what, g, keep, id_col) for g in groups])
    spark = examples.sparkSession
    n_features = _width(examples, specs)
    bc = _broadcast(spark, specs)

    acts = activations_of(specs)

    def fn(batches):
        return score_kernel(batches, bc.value, n_features, what, acts)

    src = examples.select("features", id_col, *keep)
    kept = src.drop("features").schema
    schema = StructType([kept[id_col], StructField("model_id", StringType()),
                         StructField("p", ArrayType(DoubleType())), *(kept[c] for c in keep)])
    return src.mapInArrow(fn, schema)


def linear_layer(examples: DataFrame, params: DataFrame, models: DataFrame) -> DataFrame:
    """First layer pre-activations [1, x] . W0 as (id, model_id, p)."""
    return score(examples, params, models, what="z1")


def evaluate(examples: DataFrame, params: DataFrame, models: DataFrame,
             specs: list[NetSpec] | None = None) -> DataFrame:
    """The validation pass: cost, count, correct predictions, squared error
    and label moments per model in one scan of all given rows."""
    specs = specs if specs is not None else specs_from_frames(params, models)
    blocks = sums_pass(examples, specs, val=F.lit(True), with_grads=False, layout="blocks")
    w = blocks.where("block = -1").select("model_id", *(F.col(f"v{i}").alias(c) for i, c in enumerate(SCALAR_NAMES)))
    n = F.col("val_n")
    return w.select(
        "model_id", n.cast("bigint").alias("n"),
        (F.col("val_cost") / n).alias("cost"),
        (F.col("val_correct") / n).alias("accuracy"),
        F.col("val_sqe").alias("sqe"),
        (F.col("val_sum_y2") - F.col("val_sum_y") * F.col("val_sum_y") / n).alias("sst"))


def gradient_sums(examples: DataFrame, params: DataFrame, models: DataFrame,
                  batch: Column | None = None, specs: list[NetSpec] | None = None,
                  lookahead_mu: dict | None = None, merge_groups: int | None = None) -> DataFrame:
    """Summed per-example gradients (model_id, layer, row, col, value) over
    the rows where ``batch`` holds (all rows by default), plus the scalar
    rows of layer -1 (batch_n is the event count)."""
    if specs is None:
        specs = specs_from_frames(params, models, lookahead_mu=lookahead_mu)
    return sums_pass(examples, specs, batch=batch if batch is not None else F.lit(True), merge_groups=merge_groups)
