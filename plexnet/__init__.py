"""plexnet: feed-forward network training, scoring and checking on Spark DataFrames.

Main entry points (each is a plain function of DataFrames):

  fixture / examples_from_table / read_libsvm     examples(id, features, label, split)
  model_grid / single_model                       the models table
  init_params / warm_start                        parameter tables
  fit                                             the training loop (one pass per epoch)
  score / evaluate / gradient_sums                distributed passes
  gradient_check / hessian_product                diagnostics
  fit_stream / score_stream                       Structured Streaming
  train_job                                       LibSVM files in, history/weights/summary out

Names are imported on first use, so Python workers that only need the batch
kernel do not load the driver-side modules.
"""

from importlib import import_module

_EXPORTS = {
    "gradient_check": "plexnet.operators.diagnose", "hessian_product": "plexnet.operators.diagnose",
    "init_params": "plexnet.operators.params", "warm_start": "plexnet.operators.params",
    "evaluate": "plexnet.operators.passes", "gradient_sums": "plexnet.operators.passes",
    "score": "plexnet.operators.passes", "fit": "plexnet.plans.fit",
    "model_grid": "plexnet.plans.grid", "single_model": "plexnet.plans.grid",
    "train_job": "plexnet.plans.job", "read_libsvm": "plexnet.sources.libsvm",
    "examples_from_table": "plexnet.sources.tables", "fixture": "plexnet.sources.tables",
    "fit_stream": "plexnet.streaming.fit_stream", "score_stream": "plexnet.streaming.fit_stream",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'plexnet' has no attribute {name!r}")
