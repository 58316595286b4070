"""Structured Streaming: scoring a stream and online training.

``score_stream``: the scoring pass is a narrow, stateless mapInArrow, so it
runs unchanged on a streaming DataFrame.

``fit_stream`` re-aims the reference's online mode: every micro-batch is
one mini-batch. ``foreachBatch`` computes its gradient sums with the same
distributed pass as ``fit``, applies the update and writes the parameters
to ``<run_dir>/params/batch_id=<n>``. A replayed batch (after a driver
restart the engine re-runs the last uncommitted batch) finds its output and
only reloads it, so every batch is applied exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.operators.params import PARAMS_COLS
from plexnet.operators.passes import released_broadcasts, score, sums_pass
from plexnet.operators.steps import momentum_value
from plexnet.plans.fit import (_params_df, _specs, committed_folders, grads_from_blocks, numpy_step, states_from_pandas,
                               states_to_pandas)
from plexnet.session import scratch_path


def score_stream(stream: DataFrame, params: DataFrame, models: DataFrame) -> DataFrame:
    """Streaming (id, model_id, p) for a streaming examples DataFrame."""
    return score(stream, params, models)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _batches_done(spark: SparkSession, run_dir: str) -> list[int]:
    return committed_folders(spark, f"{run_dir}/params", "batch_id=")


def fit_stream(stream: DataFrame, models: DataFrame, initial_params: DataFrame,
               run_dir: str | None = None, available_now: bool = True,
               processing_time: str | None = None):
    """Train on a streaming examples DataFrame (id, features, label); returns
    (run_dir, the StreamingQuery after it stopped or while it runs)."""
    spark = stream.sparkSession
    run_dir = run_dir or scratch_path(spark, "fit_stream")
    mcfg = models.toPandas().set_index("model_id")
    done = _batches_done(spark, run_dir)
    start = spark.read.parquet(f"{run_dir}/params/batch_id={done[-1]}") if done else initial_params
    state = {"states": states_from_pandas(start.select(*PARAMS_COLS).toPandas())}

    def on_batch(batch_df: DataFrame, batch_id: int) -> None:
        out = f"{run_dir}/params/batch_id={batch_id}"
        if _exists(spark, f"{out}/_SUCCESS"):
            state["states"] = states_from_pandas(spark.read.parquet(out).select(*PARAMS_COLS).toPandas())
            return
        states = state["states"]
        look = {m: momentum_value(batch_id, float(mcfg.loc[m, "itert"]), float(mcfg.loc[m, "maxmu"]))
                for m in states if mcfg.loc[m, "optimizer"] == "nesterov"}
        specs = _specs(states, mcfg, look)
        with released_broadcasts():
            sums = sums_pass(batch_df.select("features", "label"), specs, train=F.lit(True), batch=F.lit(True),
                             layout="blocks").toPandas()
        grads, sc = grads_from_blocks(sums, states)
        new = {}
        for m, st in states.items():
            if m not in sc.index or not sc.loc[m, "batch_n"]:          # empty micro-batch
                new[m] = st
                continue
            mu = momentum_value(batch_id, float(mcfg.loc[m, "itert"]), float(mcfg.loc[m, "maxmu"]))
            new[m] = numpy_step(st, grads[m], sc.loc[m, "batch_n"], sc.loc[m, "train_n"], mcfg.loc[m], mu)
        _params_df(spark, states_to_pandas(new)).write.mode("overwrite").parquet(out)
        state["states"] = new

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{run_dir}/checkpoint")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return run_dir, q


def latest_params(spark: SparkSession, run_dir: str) -> DataFrame:
    done = _batches_done(spark, run_dir)
    if not done:
        raise ValueError(f"no parameters written under {run_dir}")
    return spark.read.parquet(f"{run_dir}/params/batch_id={done[-1]}")
