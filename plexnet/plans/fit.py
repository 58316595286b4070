"""The training loop: one distributed pass per epoch for all models.

Epoch t (``fuse=True``):

  pass(t) over the cached examples, weights theta_t of every model:
      train rows  -> data cost of theta_t
      batch rows  -> gradient sums at theta_t (Nesterov: at theta_t + mu v_t)
      val rows    -> metrics of theta_t, i.e. the validation of epoch t-1
  step(t) -> theta_{t+1}

After the last epoch one more validation pass scores theta_T. The
reference's feed, back and val scans (>= 5 scans and >= 7 jobs an epoch)
become one scan and one Spark job per epoch, for the whole grid at once.

The pass is the data-sized work and runs on Spark (mapInArrow + built-in
sum aggregate). Its result and the weights are parameter sized; the weights
must reach the driver anyway to be broadcast, so the update is applied there
with NumPy by default (``step="driver"``), the same rule as the DataFrame
operators of ``operators.steps`` (``step="dataframe"`` runs those instead;
tests hold both equal). With ``checkpoint_every`` parameters and history are
written to the shared checkpoint folder and ``resume_from`` restarts there.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexnet.operators import examples as E
from plexnet.operators.kernel import SCALAR_NAMES, NetSpec
from plexnet.operators.params import PARAMS_COLS, init_params, warm_start
from plexnet.operators.passes import released_broadcasts, scalars_wide, sums_pass
from plexnet.operators.steps import CLIP_THRESHOLD, momentum_value, optimizer_step
from plexnet.session import scratch_path

PARAMS_SCHEMA = ("model_id string, layer int, row int, col int, theta double, "
                 "velocity double, gacc double")
HISTORY_SCHEMA = ("model_id string, epoch int, cost_train double, cost_val double, "
                  "acc_val double, sqe_val double")
SORT = ["model_id", "layer", "row", "col"]
log = logging.getLogger(__name__)


@dataclass
class FitResult:
    params: DataFrame          # last weights (what the reference saves)
    best_params: DataFrame     # weights of the best validation epoch
    history: DataFrame         # one row per model and epoch
    summary: DataFrame         # one row per model


# --- parameter state on the driver (parameter sized) -----------------------

class NetState:
    """theta, velocity and gacc matrices of one model."""

    def __init__(self, theta: list, velocity: list, gacc: list):
        self.theta, self.velocity, self.gacc = theta, velocity, gacc

    def copy(self) -> "NetState":
        return NetState([a.copy() for a in self.theta], [a.copy() for a in self.velocity],
                        [a.copy() for a in self.gacc])

    def sq_weights(self) -> float:
        return float(sum((w[1:] ** 2).sum() for w in self.theta))


def states_from_pandas(pdf: pd.DataFrame) -> dict:
    out = {}
    for mid, g in pdf.groupby("model_id", sort=True):
        mats = {"theta": [], "velocity": [], "gacc": []}
        for _, gl in g.groupby("layer", sort=True):
            rows, cols = int(gl["row"].max()) + 1, int(gl["col"].max()) + 1
            if len(gl) != rows * cols:
                raise ValueError(f"model {mid}: layer is not a full {rows}x{cols} matrix")
            r, c = gl["row"].to_numpy(), gl["col"].to_numpy()
            for k in mats:
                a = np.zeros((rows, cols))
                a[r, c] = gl[k].to_numpy()
                mats[k].append(a)
        out[str(mid)] = NetState(mats["theta"], mats["velocity"], mats["gacc"])
    return out


def states_to_pandas(states: dict) -> pd.DataFrame:
    parts = []
    for mid, st in sorted(states.items()):
        for l, w in enumerate(st.theta):
            r, c = np.indices(w.shape)
            parts.append(pd.DataFrame({
                "model_id": mid, "layer": np.int32(l), "row": r.ravel().astype(np.int32),
                "col": c.ravel().astype(np.int32), "theta": w.ravel(),
                "velocity": st.velocity[l].ravel(), "gacc": st.gacc[l].ravel()}))
    if not parts:
        return pd.DataFrame(columns=PARAMS_COLS)
    return pd.concat(parts, ignore_index=True)[PARAMS_COLS]


def _params_df(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(pdf[PARAMS_COLS], PARAMS_SCHEMA)


def grads_from_sums(sums_pdf: pd.DataFrame, states: dict) -> tuple[dict, pd.DataFrame]:
    """Gradient-sum matrices per model and the wide scalar table."""
    grads = {m: [np.zeros_like(w) for w in st.theta] for m, st in states.items()}
    g = sums_pdf[sums_pdf["layer"] >= 0]
    for (mid, layer), gl in g.groupby(["model_id", "layer"], sort=False):
        if mid in grads:
            grads[mid][int(layer)][gl["row"].to_numpy(), gl["col"].to_numpy()] = gl["value"].to_numpy()
    sc = sums_pdf[sums_pdf["layer"] == -1]
    wide = (sc.pivot_table(index="model_id", columns="row", values="value", aggfunc="sum")
            .reindex(columns=range(len(SCALAR_NAMES))).fillna(0.0))
    wide.columns = list(SCALAR_NAMES)
    return grads, wide


def grads_from_blocks(blocks_pdf: pd.DataFrame, states: dict) -> tuple[dict, pd.DataFrame]:
    """Gradient-sum matrices per model and the wide scalar table from the
    block layout of a pass (``sums_pass(layout="blocks")``)."""
    from plexnet.operators.kernel import BLOCK_COLS, N_SCALARS
    grads, scal = {}, {}
    for mid, st in states.items():
        grads[mid] = [np.zeros_like(w) for w in st.theta]
        scal[mid] = np.zeros(N_SCALARS)
    for mid, g in blocks_pdf.groupby("model_id", sort=False):
        if mid not in grads:
            continue
        g = g.sort_values("block")
        sc = g[g["block"] == -1]
        if len(sc):
            scal[mid] = sc[BLOCK_COLS].to_numpy()[0, :N_SCALARS]
        body = g[g["block"] >= 0]
        if len(body):
            flat = body[BLOCK_COLS].to_numpy().ravel()
            off = 0
            for l, w in enumerate(grads[mid]):
                grads[mid][l] = flat[off:off + w.size].reshape(w.shape).copy()
                off += w.size
    wide = pd.DataFrame.from_dict(scal, orient="index", columns=list(SCALAR_NAMES))
    return grads, wide


def numpy_step(st: NetState, gsum: list, m: float, n_train: float, cfg, mu: float) -> NetState:
    """The update rule of ``operators.steps`` on one model's matrices."""
    if not m or m <= 0:
        return st                      # empty batch: no update (the reference gets NaN)
    lam, rate = float(cfg["lmbda"]), float(cfg["rate"])
    opt, ada_mode = cfg["optimizer"], cfg["learning_mod"] == "ADA"
    new = st.copy()
    for l, w in enumerate(st.theta):
        g = gsum[l] / m
        g[1:] += lam * w[1:]
        new.gacc[l] = st.gacc[l] + g
        l1 = np.abs(g).sum(axis=0).max()
        gc = g * CLIP_THRESHOLD / l1 if l1 > CLIP_THRESHOLD else g
        nrm = np.sqrt((new.gacc[l] ** 2).sum())
        ada = rate / nrm if nrm > 0 else None
        if opt == "vanilla":
            if ada is None:
                continue
            t = w.copy()
            t[1:] *= 1.0 - ada * lam / n_train
            new.theta[l] = t - ada * gc
        else:
            eta = ada if ada_mode else rate
            if eta is None:
                continue
            new.velocity[l] = mu * st.velocity[l] - eta * gc
            new.theta[l] = w + new.velocity[l]
    return new


def best_epoch(history: DataFrame) -> DataFrame:
    """Running best validation cost per model: lowest cost so far (later ties
    win, as with the reference's <=), best epoch counted from 1."""
    w = Window.partitionBy("model_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    h = history.withColumn("best_cost", F.min("cost_val").over(w))
    h = h.withColumn("_is_best", F.col("cost_val") == F.col("best_cost"))
    return h.withColumn(
        "best_epoch",
        F.max(F.when(F.col("_is_best"), F.col("epoch") + 1)).over(w)).drop("_is_best")


def _specs(states: dict, mcfg: pd.DataFrame, lookahead_mu: dict) -> list[NetSpec]:
    specs = []   # grouped under the broadcast bound by sums_pass
    for mid, st in sorted(states.items()):
        c = mcfg.loc[mid]
        la = None
        if mid in lookahead_mu:
            la = [w + lookahead_mu[mid] * v for w, v in zip(st.theta, st.velocity)]
        specs.append(NetSpec(model_id=mid, weights=st.theta, activation=str(c["activation"]),
                             multi=int(c["outputs"]) > 1, loss=str(c["loss"] or "log"), lookahead=la))
    return specs


def fit(examples: DataFrame, models: DataFrame, stored: DataFrame | None = None, **kw) -> "FitResult":
    """Train every model of ``models`` on ``examples`` (id, features, label,
    split); see ``_fit``. The examples are cached while the loop runs and
    released when it ends, also by an error. ``max_partitions`` merges the
    cached partitions (see ``cache_examples``)."""
    seeds = [r[0] for r in models.select("batch_seed").distinct().limit(2).collect()]
    if len(seeds) != 1:
        raise ValueError("models of one fit must share batch_seed; fit them separately")
    ex = E.cache_examples(examples, batch_seed=int(seeds[0]), max_partitions=kw.pop("max_partitions", None))
    try:
        return _fit(ex, models, stored, **kw)
    finally:
        ex.unpersist()


def _fit(ex: DataFrame, models: DataFrame, stored: DataFrame | None = None,
        warm: str = "RND", full_batch: bool = False, fuse: bool = True, step: str = "driver",
        checkpoint_every: int = 0, run_dir: str | None = None,
        initial_params: DataFrame | None = None, resume_from: str | None = None,
        timings: list | None = None, merge_groups: int | None = None) -> FitResult:
    """Train every model of ``models`` on cached examples. Returns last and
    best parameters, history and summary tables. ``timings``, when given,
    receives the wall seconds of every epoch. ``merge_groups`` merges the sums
    of many map tasks in two levels (``passes.merged_sums``).

    ``checkpoint_every`` writes weights, optimiser state, best weights and
    history of the run so far under ``run_dir``; ``resume_from`` continues
    from the last checkpoint that was completely written, with the same
    outcome as a run that was never stopped."""
    import time
    if step not in ("driver", "dataframe"):
        raise ValueError("step must be 'driver' or 'dataframe'")
    spark = ex.sparkSession
    mp = models.toPandas()   # the grid: one row per model
    for col in ("batch_size", "batch_seed", "gradient"):
        if mp[col].nunique() > 1:
            raise ValueError(f"models of one fit must share {col}; fit them separately")
    outputs_max = int(mp["outputs"].max())
    # counts, widths and bad rows per split in one job (it also fills the cache)
    t0 = time.perf_counter()
    stats = E.split_stats(ex, outputs_max).collect()
    log.info("setup: cache fill and checks %.2fs", time.perf_counter() - t0)
    counts = {r["split"]: int(r["n"]) for r in stats}
    widths = {int(r["min_width"]) for r in stats} | {int(r["max_width"]) for r in stats}
    if len(widths) != 1:
        raise ValueError(f"feature width differs between rows or splits: {sorted(widths)}")
    n_features = widths.pop()
    for r in stats:
        if r["null_features"] or r["bad_values"] or r["bad_labels"] or r["label_out_of_range"] \
                or (outputs_max > 1 and r["label_not_integer"]):
            raise ValueError(f"bad examples: {r.asDict()}")
    n_train = counts.get("train", 0)
    if n_train == 0:
        raise ValueError("no train rows")
    if counts.get("val", 0) == 0:
        raise ValueError("no validation rows: the best epoch is the one of lowest validation cost")

    start, saved = 0, None
    if resume_from is not None:
        run_dir = resume_from
        done = committed_folders(spark, f"{resume_from}/params", "epoch=")
        if done:
            start = max(done)
            saved = spark.read.parquet(f"{resume_from}/params/epoch={start}").toPandas()
            check_shapes(saved, mp, n_features, f"{resume_from}/params/epoch={start}")
            initial_params = spark.createDataFrame(saved[PARAMS_COLS], PARAMS_SCHEMA)
    if initial_params is not None:
        p0 = initial_params
    else:
        p0 = init_params(models, n_features)
        if stored is not None and warm != "RND":
            p0 = warm_start(p0, stored, warm)
    t0 = time.perf_counter()
    states = states_from_pandas(p0.select(*PARAMS_COLS).toPandas())
    log.info("setup: initial parameters %.2fs", time.perf_counter() - t0)

    mcfg = mp.set_index("model_id")
    epochs = mcfg["epochs"].astype(int).to_dict()
    t_max = max(epochs.values())
    size, seed = int(mp["batch_size"].iloc[0]), int(mp["batch_seed"].iloc[0])
    online = mp["gradient"].iloc[0] == "olGD"
    frac = 1.0 if full_batch else E.batch_fraction(n_train, size)
    is_train, is_val = F.col("split") == "train", F.col("split") == "val"
    if checkpoint_every and run_dir is None:
        run_dir = scratch_path(spark, "fit")

    hist_rows: list = []
    pending: dict = {}
    best = {m: np.inf for m in epochs}
    best_states = {m: states[m].copy() for m in epochs}
    if saved is not None:
        b = saved.assign(theta=saved["best_theta"], velocity=saved["best_velocity"], gacc=saved["best_gacc"])
        best_states = states_from_pandas(b[PARAMS_COLS])
        for r in spark.read.parquet(f"{resume_from}/progress/epoch={start}").collect():
            row = {k: r[k] for k in ("model_id", "epoch", "cost_train")}
            if r["pending"]:   # its validation comes with the first pass
                pending[r["model_id"]] = row | {"_sq": r["sq"]}
            else:
                hist_rows.append(row | {k: r[k] for k in ("cost_val", "acc_val", "sqe_val")})
                best[r["model_id"]] = min(best[r["model_id"]], r["cost_val"])

    def close_epoch(vals: pd.DataFrame, weights: dict):
        for m, row in pending.items():
            r = vals.loc[m]
            vn = r["val_n"] if r["val_n"] else np.nan
            sq = row.pop("_sq")
            cost_val = r["val_cost"] / vn + float(mcfg.loc[m, "lmbda"]) / 2.0 * sq
            row.update(cost_val=cost_val, acc_val=r["val_correct"] / vn,
                       sqe_val=r["val_sqe"] if int(mcfg.loc[m, "outputs"]) == 1 else None)
            hist_rows.append(row)
            if cost_val <= best[m]:
                best[m] = cost_val
                best_states[m] = weights[m].copy()
        pending.clear()

    picks: dict | None = None
    for t in range(start, t_max + 1):
        t_start = time.perf_counter()
        active = [m for m in epochs if t < epochs[m]]
        mus = {m: momentum_value(t, float(mcfg.loc[m, "itert"]), float(mcfg.loc[m, "maxmu"]))
               for m in epochs}
        if t == t_max:
            if fuse and pending:   # validation of the last weights
                with released_broadcasts():
                    vs = sums_pass(ex, _specs(states, mcfg, {}), val=is_val, with_grads=False, layout="blocks").toPandas()
                _, vals = grads_from_blocks(vs, states)
                close_epoch(vals, states)
            break
        look = {m: mus[m] for m in active if mcfg.loc[m, "optimizer"] == "nesterov"}
        specs = _specs(states, mcfg, look)
        if online:
            if picks is None:  # of all epochs, in one job
                picks = {r["epoch"]: r["id"] for r in E.online_picks(ex, range(t, t_max), seed).collect()}
            batch = is_train & (F.col("id") == F.lit(picks[t]))
        else:
            batch = is_train
        # the mini-batch draw runs in the kernel: no epoch constant enters the
        # Spark plan, so its generated code is compiled once, not every epoch
        draw = (frac, seed, t) if (not online and frac < 1.0) else None
        val_flag = is_val if (fuse and pending) else None
        if step == "driver":
            with released_broadcasts():
                sums = sums_pass(ex, specs, train=is_train, batch=batch, val=val_flag, layout="blocks",
                                 draw=draw, merge_groups=merge_groups).toPandas()
            grads, sc = grads_from_blocks(sums, states)
            new_states = {}
            for m, st in states.items():
                if m in active:
                    new_states[m] = numpy_step(st, grads[m], sc.loc[m, "batch_n"],
                                               sc.loc[m, "train_n"], mcfg.loc[m], mus[m])
                else:
                    new_states[m] = st
        else:
            # the pass output is read by several branches of the step plan
            with released_broadcasts():
                sums = sums_pass(ex, specs, train=is_train, batch=batch, val=val_flag, draw=draw,
                                 merge_groups=merge_groups)
                sums = sums.persist(StorageLevel.MEMORY_AND_DISK)
                out = optimizer_step(_params_df(spark, states_to_pandas(states)), sums, models, t,
                                     scalars_wide(sums)).toPandas()
                sums.unpersist()
            sc = out.groupby("model_id")[list(SCALAR_NAMES)].first().fillna(0.0)
            stepped = states_from_pandas(out[PARAMS_COLS])
            new_states = {m: (stepped[m] if m in active else st) for m, st in states.items()}
        if fuse and pending:
            close_epoch(sc, states)       # val rows of pass t scored theta_t
        for m in active:
            r = sc.loc[m]
            sq = new_states[m].sq_weights()
            pending[m] = dict(model_id=m, epoch=t, _sq=sq,
                              cost_train=r["train_cost"] / r["train_n"]
                              + float(mcfg.loc[m, "lmbda"]) / 2.0 * sq)
        states = new_states
        if not fuse:
            with released_broadcasts():
                vs = sums_pass(ex, _specs(states, mcfg, {}), val=is_val, with_grads=False, layout="blocks").toPandas()
            _, vals = grads_from_blocks(vs, states)
            close_epoch(vals, states)
        if checkpoint_every and (t + 1) % checkpoint_every == 0:
            _save(spark, run_dir, t + 1, states, best_states, hist_rows, pending)
        log.info("epoch %d: %.2fs", t, time.perf_counter() - t_start)
        if timings is not None:
            timings.append(time.perf_counter() - t_start)

    history = spark.createDataFrame(
        pd.DataFrame(hist_rows, columns=["model_id", "epoch", "cost_train", "cost_val", "acc_val",
                                         "sqe_val"]), HISTORY_SCHEMA)
    if checkpoint_every:
        history.write.mode("overwrite").parquet(f"{run_dir}/history")
    summary = model_summary(history, models, n_features)
    return FitResult(params=_params_df(spark, states_to_pandas(states)),
                     best_params=_params_df(spark, states_to_pandas(best_states)),
                     history=history, summary=summary)


PROGRESS_SCHEMA = HISTORY_SCHEMA + ", pending boolean, sq double"


def _save(spark: SparkSession, run_dir: str, epoch: int, states: dict, best_states: dict, hist_rows: list,
          pending: dict) -> None:
    """One checkpoint: the history first, the weights last, so that a complete
    ``params`` folder vouches for the whole checkpoint."""
    rows = [(r["model_id"], r["epoch"], r["cost_train"], r["cost_val"], r["acc_val"], r["sqe_val"], False, None)
            for r in hist_rows]
    rows += [(m, r["epoch"], r["cost_train"], None, None, None, True, r["_sq"]) for m, r in pending.items()]
    rows = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    spark.createDataFrame(rows, PROGRESS_SCHEMA).write.mode("overwrite").parquet(f"{run_dir}/progress/epoch={epoch}")
    now, best = states_to_pandas(states), states_to_pandas(best_states)
    for c in ("theta", "velocity", "gacc"):
        now[f"best_{c}"] = best[c]
    schema = PARAMS_SCHEMA + ", best_theta double, best_velocity double, best_gacc double"
    spark.createDataFrame(now, schema).write.mode("overwrite").parquet(f"{run_dir}/params/epoch={epoch}")


def committed_folders(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers n of the sub folders ``<prefix>n`` whose write was committed
    (they hold ``_SUCCESS``), sorted; on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix)
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def check_shapes(params_pdf: pd.DataFrame, models_pdf: pd.DataFrame, n_features: int, where: str) -> None:
    """Raise unless stored weights have exactly the layers of the models."""
    have = {(str(m), int(l)): (int(g["row"].max()) + 1, int(g["col"].max()) + 1, len(g))
            for (m, l), g in params_pdf.groupby(["model_id", "layer"])}
    want = {}
    for r in models_pdf.itertuples():
        sizes = [n_features, *list(r.hidden), int(r.outputs)]
        want.update({(r.model_id, i): (a + 1, b, (a + 1) * b) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))})
    if have != want:
        raise ValueError(f"{where}: stored layers {have} do not fit the models' {want}")


def model_summary(history: DataFrame, models: DataFrame, n_features: int) -> DataFrame:
    """One row per model: settings, hidden layer count, best epoch and cost."""
    b = best_epoch(history)
    w = Window.partitionBy("model_id").orderBy(F.col("epoch").desc())
    lastrow = (b.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
               .select("model_id", "best_epoch", "best_cost",
                       F.col("epoch").alias("last_epoch"), F.col("cost_val").alias("last_cost_val"),
                       F.col("acc_val").alias("last_acc_val")))
    m = models.select("model_id", "hidden", "epochs", "rate", "optimizer", "maxmu", "itert", "init",
                      "fan", "lmbda", "activation", F.size("hidden").alias("hidden_layers"))
    return m.join(lastrow, "model_id", "left").withColumn("n_features", F.lit(int(n_features)))
