"""Model settings and the model grid.

A grid is a small ``models`` DataFrame, one row per network; every operator
and the training loop read per-model settings from it, so one pass can train
networks of different shapes, rates and optimisers together.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Default settings of the reference trainer
#   seed 4237842, init xnormal, fan fan_in, hidden layers "20", outputs 1,
#   epochs 200, itert 1, learning rate 0.1, learning_mod "",
#   lambda 1e-10, maxmu 0.95, activation sigmoid, optimizer momentum,
#   gradient SGD, mini-batch about 512 rows drawn with seed 2332
# ---------------------------------------------------------------------------
DEFAULTS = {
    "seed": 4237842,
    "init": "xnormal",
    "fan": "fan_in",
    "hidden": "20",
    "outputs": 1,
    "epochs": 200,
    "itert": 1.0,
    "rate": 0.1,
    "learning_mod": "",
    "lmbda": 1e-10,
    "maxmu": 0.95,
    "activation": "sigmoid",
    "optimizer": "momentum",
    "gradient": "SGD",
    "batch_size": 512,
    "batch_seed": 2332,
    "loss": "log",
}

OPTIMIZERS = ("vanilla", "momentum", "nesterov")
INITS = ("xuniform", "xnormal", "deeplearning")
FANS = ("fan_in", "fan_out", "fan_avg")
GRADIENTS = ("SGD", "olGD")
LOSSES = ("log", "squared")
LEARNING_MODS = ("", "ADA")

MODELS_SCHEMA = (
    "model_id string, hidden array<int>, outputs int, activation string, rate double, "
    "lmbda double, optimizer string, learning_mod string, maxmu double, itert double, "
    "init string, fan string, seed bigint, epochs int, batch_size int, batch_seed bigint, "
    "gradient string, loss string")

_FIELDS = [f.strip().split(" ")[0] for f in MODELS_SCHEMA.split(",")]


def _hidden(topology) -> list[int]:
    if isinstance(topology, str):
        return [int(h) for h in topology.split(",") if h.strip()]
    return [int(h) for h in topology]


def model_settings(**overrides) -> dict:
    unknown = set(overrides) - set(DEFAULTS) - {"model_id"}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    s = dict(DEFAULTS)
    s.update(overrides)
    from plexnet.functions.activations import get_activation
    get_activation(s["activation"])
    for key, allowed in (("optimizer", OPTIMIZERS), ("init", INITS), ("fan", FANS),
                         ("gradient", GRADIENTS), ("loss", LOSSES), ("learning_mod", LEARNING_MODS)):
        if s[key] not in allowed:
            raise ValueError(f"{key} must be one of {allowed}, got {s[key]!r}")
    if int(s["outputs"]) < 1:
        raise ValueError("outputs must be >= 1")
    return s


def _row(model_id: str, s: dict) -> tuple:
    vals = dict(s)
    vals["model_id"] = model_id
    vals["hidden"] = _hidden(s["hidden"])
    vals["rate"] = float(vals["rate"])
    vals["lmbda"] = float(vals["lmbda"])
    vals["maxmu"] = float(vals["maxmu"])
    vals["itert"] = float(vals["itert"])
    vals["outputs"] = int(vals["outputs"])
    vals["epochs"] = int(vals["epochs"])
    vals["batch_size"] = int(vals["batch_size"])
    return tuple(vals[f] for f in _FIELDS)


def model_grid(spark: SparkSession, topologies="20", rates="0.1", **base) -> DataFrame:
    """Cross product of topologies ('-' separated, hidden sizes ',' separated)
    and learning rates (',' separated); model_id is '<topology>@<rate>'."""
    topo = topologies.split("-") if isinstance(topologies, str) else list(topologies)
    rts = rates.split(",") if isinstance(rates, str) else [str(r) for r in rates]
    rows = []
    for t, r in itertools.product(topo, rts):
        t_str = t if isinstance(t, str) else ",".join(str(h) for h in t)
        s = model_settings(hidden=t_str, rate=float(r), **base)
        rows.append(_row(f"{t_str}@{r}", s))
    return spark.createDataFrame(rows, MODELS_SCHEMA)


def single_model(spark: SparkSession, model_id: str = "m0", **settings) -> DataFrame:
    return spark.createDataFrame([_row(model_id, model_settings(**settings))], MODELS_SCHEMA)


def models_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    out = []
    for r in rows:
        r = dict(r)
        mid = r.pop("model_id")
        out.append(_row(mid, model_settings(**r)))
    return spark.createDataFrame(out, MODELS_SCHEMA)
