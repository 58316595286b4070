"""The whole training job of the reference, composed from the operators:
LibSVM train and validation files in, a grid of topologies x learning rates
trained together, cost history, weight files and summary lines out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plexnet.plans.fit import FitResult, fit
from plexnet.plans.grid import model_grid
from plexnet.sources.libsvm import read_libsvm
from plexnet.sources.sinks import write_history, write_model_summary
from plexnet.sources.weights import write_weights_text


@dataclass
class JobOutput:
    result: FitResult
    history_path: str
    weights_path: str
    summary_path: str


def train_job(spark: SparkSession, train_path: str, val_path: str, out_dir: str,
              topologies: str = "20", rates: str = "0.1", data_name: str = "data",
              num_features: int | None = None, stored_weights: str | None = None,
              warm: str = "RND", save_best: bool = False, full_batch: bool = False, checkpoint_every: int = 0,
              run_dir: str | None = None, resume_from: str | None = None, **settings) -> JobOutput:
    """Read '<name>train' and '<name>val' LibSVM files, train every
    (topology, rate) of the grid in the same passes, write the cost history
    (CSV), the weights (text files, last or best epoch) and one summary line
    per model under ``out_dir``. ``stored_weights`` (a folder written by
    ``write_weights_text``, model ids as in the grid) enables the AE/PT warm
    starts. ``checkpoint_every``, ``run_dir`` and ``resume_from`` are those of ``fit``."""
    train = read_libsvm(spark, train_path, num_features, split="train")
    val = read_libsvm(spark, val_path, num_features, split="val")
    examples = train.unionByName(val)
    models = model_grid(spark, topologies, rates, **settings)
    stored = None
    if stored_weights is not None and warm != "RND":
        from plexnet.sources.weights import read_weights_text
        stored = read_weights_text(spark, stored_weights).drop("activation")
    res = fit(examples, models, stored=stored, warm=warm, full_batch=full_batch, checkpoint_every=checkpoint_every,
              run_dir=run_dir, resume_from=resume_from)
    paths = (f"{out_dir}/history", f"{out_dir}/weights", f"{out_dir}/summary")
    write_history(res.history, paths[0])
    acts = {r["model_id"]: r["activation"] for r in models.select("model_id", "activation").collect()}
    write_weights_text(res.best_params if save_best else res.params, paths[1], activation=acts)
    write_model_summary(res.summary, paths[2], data_name, mode="overwrite", warm=warm, stored=(stored_weights or "") if warm != "RND" else "")
    return JobOutput(res, *paths)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True)
            .schema("epoch int, cost_train double, cost_val double, model_id string").csv(path)
            .select("model_id", "epoch", "cost_train", "cost_val"))

