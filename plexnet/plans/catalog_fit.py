"""Registered queries of the training loop, sinks, streaming and diagnostics.

The fit oracles chain whole epochs in SQL (full batch over the train rows):
forward pass, backpropagation, mean gradient, accumulate, clip, update,
then the next epoch on the new parameter table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.operators import diagnose as D
from plexnet.operators import params as P
from plexnet.operators.examples import feature_width_value
from plexnet.functions.random import sql_mix_uniform as mix_sql
from plexnet.plans import sqltext as Q
from plexnet.plans.catalog import (NET_FIT_E, NET_FIT_L, NET_FIT_N, NET_LV, _models, query, r6)
from plexnet.plans.fit import best_epoch, fit
from plexnet.sources import tables as T

FIT_EPOCHS = 2
HIST_EPOCHS = 3


def _fit_ctes(net: Q.Net, epochs: int, ex_train: str = "extr",
              minibatch: tuple[int, int] | None = None, online: int | None = None) -> tuple[list[str], list[str]]:
    """CTEs of ``epochs`` epochs, full batch or, with ``minibatch=(size,
    seed)``, on the rows drawn for each epoch, or with ``online=seed`` on the
    one row of the smallest draw; returns (ctes, parameter tables P_0 ..
    P_epochs)."""
    tag = re.sub(r"\W", "_", "n" + net.model_id.lower())
    p0 = f"p_{tag}_0"
    ctes = [f"{p0} AS MATERIALIZED ({Q.init_params(net)})"]
    names = [p0]
    for t in range(epochs):
        pre = f"{tag}_t{t}_"
        batch = ex_train
        if minibatch is not None:
            size, seed = minibatch
            batch = f"{pre}batch"
            draw = mix_sql(Q.md5_bits("id", Q.q(str(seed))), seed, t)
            ctes.append(f"{batch} AS MATERIALIZED (SELECT * FROM {ex_train} WHERE {draw} < "
                        f"least({Q.d(1.0)}, {Q.d(float(size))} / (SELECT count(*) FROM {ex_train})))")
        if online is not None:
            batch = f"{pre}batch"
            draw = mix_sql(Q.md5_bits("id", Q.q(str(online))), online, t + 10)
            ctes.append(f"{batch} AS MATERIALIZED (SELECT * FROM {ex_train} ORDER BY {draw}, id LIMIT 1)")
        bc, gs = Q.backprop_ctes(net, batch, names[-1], pre)
        mc, mg = Q.mean_gradient_ctes(net, names[-1], gs, f"(SELECT count(*) FROM {batch})", pre)
        mu = Q.momentum_mu(t, net.itert, net.maxmu)
        sc, new = Q.step_ctes(net, mg, pre, net.optimizer, mu,
                              n_train=f"(SELECT count(*) FROM {ex_train})")
        ctes += bc + mc + sc
        names.append(new)
    return ctes, names


def _ex_ctes(fx: str) -> list[str]:
    return [f"exall AS MATERIALIZED ({Q.fixture(fx)})",
            "extr AS MATERIALIZED (SELECT * FROM exall WHERE split = 'train')",
            "exva AS MATERIALIZED (SELECT * FROM exall WHERE split = 'val')"]


def _fit_sql(fx: str, *nets: Q.Net) -> str:
    ctes = _ex_ctes(fx)
    outs = []
    for n in nets:
        c, names = _fit_ctes(n, FIT_EPOCHS)
        # the Nesterov gradient is taken at theta + mu * v
        if n.optimizer == "nesterov":
            c, names = _fit_ctes_nesterov(n, FIT_EPOCHS)
        ctes += c
        outs.append(f"SELECT model_id, layer, row, col, {Q.r6('theta')} AS theta, "
                    f"{Q.r6('velocity')} AS velocity, {Q.r6('gacc')} AS gacc FROM {names[-1]}")
    return Q.with_clause(ctes) + " UNION ALL ".join(outs)


def _fit_ctes_nesterov(net: Q.Net, epochs: int, ex_train: str = "extr"):
    tag = net.model_id.lower()
    p0 = f"p_{tag}_0"
    ctes = [f"{p0} AS MATERIALIZED ({Q.init_params(net)})"]
    names = [p0]
    for t in range(epochs):
        pre = f"{tag}_t{t}_"
        mu = Q.momentum_mu(t, net.itert, net.maxmu)
        look = f"{pre}look"
        ctes.append(f"{look} AS MATERIALIZED (SELECT model_id, layer, row, col, theta + {Q.d(mu)} * velocity "
                    f"AS theta, velocity, gacc FROM {names[-1]})")
        bc, gs = Q.backprop_ctes(net, ex_train, look, pre)
        mc, mg = Q.mean_gradient_ctes(net, names[-1], gs, f"(SELECT count(*) FROM {ex_train})", pre)
        sc, new = Q.step_ctes(net, mg, pre, "momentum", mu)
        ctes += bc + mc + sc
        names.append(new)
    return ctes, names


def _fit_query(fx: str, *nets: Q.Net):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        ex = T.fixture(spark, sf, fx)
        rows = []
        for n in nets:
            s = n.settings()
            s["epochs"] = FIT_EPOCHS
            rows.append(s)
        from plexnet.plans.grid import models_from_rows
        models = models_from_rows(spark, rows)
        r = fit(ex, models, full_batch=True)
        return r.params.select(*P.KEYS, r6(F.col("theta")).alias("theta"),
                               r6(F.col("velocity")).alias("velocity"), r6(F.col("gacc")).alias("gacc"))
    return fn


query("fit_binary", lambda: _fit_sql("L", NET_FIT_L))(_fit_query("L", NET_FIT_L))
query("fit_multi", lambda: _fit_sql("E", NET_FIT_E))(_fit_query("E", NET_FIT_E))
query("fit_grid", lambda: _fit_sql("L", NET_FIT_L, NET_LV, NET_FIT_N))(
    _fit_query("L", NET_FIT_L, NET_LV, NET_FIT_N))


# --- history and best epoch -------------------------------------------------

def _history_sql(net: Q.Net, epochs: int, **mode) -> tuple[list[str], str]:
    ctes = _ex_ctes("L")
    c, h, _ = _history_ctes(net, epochs, "h", **mode)
    return [*ctes, *c, f"hist AS ({h})"], "hist"


def _history_ctes(net: Q.Net, epochs: int, tag: str, **mode) -> tuple[list[str], str, list[str]]:
    """(CTEs, SELECT of the history, parameter tables) of one net."""
    ctes, names = _fit_ctes(net, epochs, **mode)
    rows = []
    for t in range(epochs):
        cur, nxt = names[t], names[t + 1]
        pre_tr, pre_va = f"{tag}{t}tr_", f"{tag}{t}va_"
        ftr, otr = Q.forward_ctes(net, "extr", cur, pre_tr)
        fva, ova = Q.forward_ctes(net, "exva", nxt, pre_va)
        ctes += ftr + fva
        ctes.append(f"{pre_tr}c AS ({Q.row_cost(net, otr, 'extr')})")
        ctes.append(f"{pre_va}c AS ({Q.row_cost(net, ova, 'exva')})")
        ctes.append(f"{pre_va}pr AS ({Q.predict_expr(net, ova)})")
        sq = f"(SELECT sum(CASE WHEN row > 0 THEN theta * theta ELSE 0.0 END) FROM {nxt})"
        reg = f"{Q.d(net.lmbda)} / 2.0 * {sq}"
        rows.append(
            f"SELECT {Q.q(net.model_id)} AS model_id, CAST({t} AS INTEGER) AS epoch, "
            f"(SELECT avg(cost) FROM {pre_tr}c) + {reg} AS cost_train, "
            f"(SELECT avg(cost) FROM {pre_va}c) + {reg} AS cost_val, "
            f"(SELECT avg(CASE WHEN pr.pred = e.label THEN 1.0 ELSE 0.0 END) FROM {pre_va}pr pr "
            f"JOIN exva e ON e.id = pr.id) AS acc_val")
    return ctes, " UNION ALL ".join(rows), names


def _fit_history(spark, sf, net: Q.Net, epochs: int) -> DataFrame:
    from plexnet.plans.grid import models_from_rows
    s = net.settings()
    s["epochs"] = epochs
    r = fit(T.fixture(spark, sf, "L"), models_from_rows(spark, [s]), full_batch=True)
    return r.history


@query("fit_history", lambda: Q.with_clause(_history_sql(NET_FIT_L, HIST_EPOCHS)[0])
       + f"SELECT model_id, epoch, {Q.r6('cost_train')} AS cost_train, {Q.r6('cost_val')} AS cost_val, "
         f"{Q.r6('acc_val')} AS acc_val FROM hist")
def q_fit_history(spark, sf):
    h = _fit_history(spark, sf, NET_FIT_L, HIST_EPOCHS)
    return h.select("model_id", "epoch", r6(F.col("cost_train")).alias("cost_train"),
                    r6(F.col("cost_val")).alias("cost_val"), r6(F.col("acc_val")).alias("acc_val"))


@query("best_epoch", lambda: Q.with_clause(_history_sql(NET_FIT_L, HIST_EPOCHS)[0])
       + "SELECT model_id, epoch, " + Q.r6("min(round(cost_val, 9)) OVER w") + " AS best_cost, "
         "max(CASE WHEN round(cost_val, 9) = mn THEN epoch + 1 END) OVER w AS best_epoch FROM "
         "(SELECT *, min(round(cost_val, 9)) OVER w AS mn FROM hist WINDOW w AS (PARTITION BY model_id ORDER BY epoch "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
         "WINDOW w AS (PARTITION BY model_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_best_epoch(spark, sf):
    h = _fit_history(spark, sf, NET_FIT_L, HIST_EPOCHS)
    # compare costs at 9 digits so float noise cannot decide a tie
    b = best_epoch(h.withColumn("cost_val", F.round("cost_val", 9)))
    return b.select("model_id", "epoch", r6(F.col("best_cost")).alias("best_cost"), "best_epoch")


def _best_params_sql() -> str:
    c, h, names = _history_ctes(NET_FIT_L, 4, "h", minibatch=(512, 2332))
    tables = " UNION ALL ".join(f"SELECT {t} AS epoch, * FROM {n}" for t, n in enumerate(names[1:]))
    return Q.with_clause([*_ex_ctes("L"), *c, f"hist AS ({h})", f"allp AS ({tables})"]) + (
        f"SELECT model_id, layer, row, col, {Q.r6('theta')} AS theta, {Q.r6('velocity')} AS velocity, "
        f"{Q.r6('gacc')} AS gacc FROM allp WHERE epoch = (SELECT epoch FROM hist ORDER BY cost_val, epoch DESC LIMIT 1)")


def _hist_out(h: DataFrame) -> DataFrame:
    return h.select("model_id", "epoch", *(r6(F.col(c)).alias(c) for c in ("cost_train", "cost_val", "acc_val")))


def _state_out(p: DataFrame) -> DataFrame:
    return p.select(*P.KEYS, *(r6(F.col(c)).alias(c) for c in ("theta", "velocity", "gacc")))


_HIST_SQL = ("SELECT model_id, epoch, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in ("cost_train", "cost_val", "acc_val"))
             + " FROM hist")


@query("best_params", _best_params_sql)
def q_best_params(spark, sf):
    from plexnet.plans.grid import models_from_rows
    s = NET_FIT_L.settings()
    s["epochs"] = 4
    r = fit(T.fixture(spark, sf, "L"), models_from_rows(spark, [s]))
    return _state_out(r.best_params)


def _sgd_sql() -> str:
    ctes = _ex_ctes("L")
    c, names = _fit_ctes(NET_FIT_L, FIT_EPOCHS, minibatch=(512, 2332))
    return (Q.with_clause(ctes + c) + f"SELECT model_id, layer, row, col, {Q.r6('theta')} AS theta, "
            f"{Q.r6('velocity')} AS velocity, {Q.r6('gacc')} AS gacc FROM {names[-1]}")


@query("fit_sgd", _sgd_sql)
def q_fit_sgd(spark, sf):
    """Two mini-batch epochs (about 512 drawn rows each), the reference's default mode."""
    from plexnet.plans.grid import models_from_rows
    s = NET_FIT_L.settings()
    s.update(epochs=FIT_EPOCHS, batch_size=512, batch_seed=2332)
    r = fit(T.fixture(spark, sf, "L"), models_from_rows(spark, [s]))
    return r.params.select(*P.KEYS, r6(F.col("theta")).alias("theta"),
                           r6(F.col("velocity")).alias("velocity"), r6(F.col("gacc")).alias("gacc"))


@query("fit_minibatch", lambda: Q.with_clause(_history_sql(NET_FIT_L, 5, minibatch=(512, 2332))[0]) + _HIST_SQL)
def q_fit_minibatch(spark, sf):
    """SGD with the default mini-batch of about 512 rows a epoch."""
    from plexnet.plans.grid import models_from_rows
    s = NET_FIT_L.settings()
    s["epochs"] = 5
    return _hist_out(fit(T.fixture(spark, sf, "L"), models_from_rows(spark, [s])).history)


@query("fit_online", lambda: Q.with_clause(_history_sql(NET_FIT_L, 3, online=2332)[0]) + _HIST_SQL)
def q_fit_online(spark, sf):
    """Online mode: one drawn example per epoch."""
    from plexnet.plans.grid import models_from_rows
    s = NET_FIT_L.settings()
    s.update(epochs=3, gradient="olGD")
    return _hist_out(fit(T.fixture(spark, sf, "L"), models_from_rows(spark, [s])).history)


# --- sinks -----------------------------------------------------------------

@query("history_sink", lambda: Q.with_clause(_history_sql(NET_FIT_L, 2)[0])
       + f"SELECT epoch, {Q.r6('cost_train')} AS cost_train, {Q.r6('cost_val')} AS cost_val, model_id "
         "FROM hist")
def q_history_sink(spark, sf):
    """The cost history written as CSV (header epoch,cost_train,cost_val) and read back."""
    from plexnet.session import scratch_path
    from plexnet.sources.sinks import write_history
    h = _fit_history(spark, sf, NET_FIT_L, 2)
    path = scratch_path(spark, "history")
    write_history(h, path)
    back = spark.read.option("header", True).schema(
        "epoch int, cost_train double, cost_val double, model_id string").csv(path)
    return back.select("epoch", r6(F.col("cost_train")).alias("cost_train"),
                       r6(F.col("cost_val")).alias("cost_val"), "model_id")


def _summary_sql() -> str:
    ctes, h = _history_sql(NET_FIT_L, 2)
    n = NET_FIT_L
    return Q.with_clause([*ctes, f"low AS (SELECT min(cost_val) AS c FROM {h})"]) + (
        f"SELECT 'L;{n.sizes[1]} 2 {n.rate};1;' || CAST((SELECT max(epoch) + 1 FROM {h} JOIN low ON cost_val = c) AS VARCHAR) || ';' || "
        f"replace(printf('%.3f', c), '.', ',') || ';{n.optimizer}_{n.maxmu}_{n.itert};RND_ 1.0E-10' AS value FROM low")


@query("model_summary", _summary_sql)
def q_model_summary(spark, sf):
    from plexnet.plans.fit import model_summary
    from plexnet.plans.grid import models_from_rows
    from plexnet.session import scratch_path
    from plexnet.sources.sinks import write_model_summary
    s = NET_FIT_L.settings()
    s["epochs"] = 2
    models = models_from_rows(spark, [s])
    r = fit(T.fixture(spark, sf, "L"), models, full_batch=True)
    path = scratch_path(spark, "summary")
    write_model_summary(r.summary, path, "L")
    return spark.read.text(path)


# --- streaming ---------------------------------------------------------------

NET_V = Q.Net("V4", [2, 4, 1], activation="tanh", init="xnormal", rate=0.3)


@query("score_stream", lambda: Q.with_clause(
    [f"ex AS MATERIALIZED ({Q.fixture('V')})", f"P AS MATERIALIZED ({Q.init_params(NET_V)})"]
    + Q.forward_ctes(NET_V, "ex", "P", "f_")[0]) + f"SELECT id, {Q.r6('p')} AS p FROM f_out")
def q_score_stream(spark, sf):
    from plexnet.session import scratch_path
    from plexnet.streaming.fit_stream import score_stream
    models = _models(spark, NET_V)
    params = P.init_params(models, 2)
    stream = T.events_examples(T.events_stream(spark, sf))
    out = scratch_path(spark, "score_stream")
    q = (score_stream(stream, params, models).select("id", F.element_at("p", 1).alias("p"))
         .writeStream.format("parquet").option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start(f"{out}/data"))
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data").select("id", r6(F.col("p")).alias("p"))


def _fit_stream_sql() -> str:
    """The table arrives as one micro-batch: one step over all its rows."""
    c, names = _fit_ctes(NET_V, 1, ex_train="ex")
    return Q.with_clause([f"ex AS MATERIALIZED ({Q.fixture('V')})", *c]) + (
        f"SELECT model_id, layer, row, col, {Q.r6('theta')} AS theta, {Q.r6('velocity')} AS velocity, "
        f"{Q.r6('gacc')} AS gacc FROM {names[-1]}")


@query("fit_stream", _fit_stream_sql)
def q_fit_stream(spark, sf):
    from plexnet.streaming.fit_stream import fit_stream, latest_params
    models = _models(spark, NET_V)
    params = P.init_params(models, 2)
    stream = T.events_examples(T.events_stream(spark, sf))
    run_dir, _ = fit_stream(stream, models, params)
    return _state_out(latest_params(spark, run_dir))


# --- diagnostics ---------------------------------------------------------------

NET_CHECK = Q.Net("check", [4, 4, 4, 1], activation="sigmoid", init="deeplearning", fan="fan_in",
                  seed=D.CHECK_SEED, lmbda=D.CHECK_LAMBDA)


@query("gradient_check")
def q_gradient_check(spark, sf):
    ex = T.fixture(spark, sf, "L")
    w = feature_width_value(ex)
    models = _models(spark, NET_CHECK)
    return D.gradient_check(ex, P.init_params(models, w), models)


def _hessian_sql() -> str:
    net = NET_FIT_L
    ctes = [f"ex AS MATERIALIZED (SELECT * FROM ({Q.fixture('L')}) f WHERE split = 'train')",
            f"P0 AS MATERIALIZED ({Q.init_params(net)})"]
    bc0, gs0 = Q.backprop_ctes(net, "ex", "P0", "h0_")
    mc0, mg0 = Q.mean_gradient_ctes(net, "P0", gs0, "(SELECT count(*) FROM ex)", "h0_")
    ctes += bc0 + mc0 + [f"P1 AS MATERIALIZED (SELECT model_id, layer, row, col, theta - {Q.d(D.HESSIAN_EPS)} "
                         f"* g AS theta, velocity, gacc FROM {mg0})"]
    bc1, gs1 = Q.backprop_ctes(net, "ex", "P1", "h1_")
    mc1, mg1 = Q.mean_gradient_ctes(net, "P1", gs1, "(SELECT count(*) FROM ex)", "h1_")
    ctes += bc1 + mc1
    hd = f"(b.g - a.g) / {Q.d(D.HESSIAN_EPS)} + {Q.d(net.lmbda)} * a.g"
    return Q.with_clause(ctes) + (
        f"SELECT a.model_id, a.layer, a.row, a.col, {Q.r6(hd, 4)} AS hd FROM {mg0} a JOIN {mg1} b "
        "ON a.layer = b.layer AND a.row = b.row AND a.col = b.col")


@query("hessian_product", _hessian_sql)
def q_hessian_product(spark, sf):
    ex = T.fixture(spark, sf, "L").where(F.col("split") == "train")
    models = _models(spark, NET_FIT_L)
    hp = D.hessian_product(ex, P.init_params(models, 4), models)
    return hp.select(*P.KEYS, r6(F.col("hd"), 4).alias("hd"))


# --- the whole job ------------------------------------------------------------

JOB_NETS = [Q.Net(f"{h}@0.5", [4, h, 1], rate=0.5) for h in (8, 4)]


def _train_job_sql() -> str:
    ctes, rows = _ex_ctes("L"), []
    for i, net in enumerate(JOB_NETS):
        c, h, _ = _history_ctes(net, 3, f"h{i}_")
        ctes += c
        rows.append(h)
    return Q.with_clause([*ctes, "hist AS (" + " UNION ALL ".join(rows) + ")"]) + (
        f"SELECT model_id, epoch, {Q.r6('cost_train')} AS cost_train, {Q.r6('cost_val')} AS cost_val FROM hist")


@query("train_job", _train_job_sql)
def q_train_job(spark, sf):
    """The reference's job end to end: fixture L written as LibSVM train and
    val files, a 2 x 1 grid trained together, history, weights and summary
    written; returns the history read back from its CSV."""
    from plexnet.plans.job import read_history, train_job
    from plexnet.session import scratch_path
    from plexnet.sources.libsvm import write_libsvm
    ex = T.fixture(spark, sf, "L")
    base = scratch_path(spark, "job")
    write_libsvm(ex.where(F.col("split") == "train"), f"{base}/Ltrain")
    write_libsvm(ex.where(F.col("split") == "val"), f"{base}/Lval")
    out = train_job(spark, f"{base}/Ltrain", f"{base}/Lval", f"{base}/out", topologies="8-4",
                    rates="0.5", data_name="L", num_features=4, epochs=3, full_batch=True)
    return read_history(spark, out.history_path).select(
        "model_id", "epoch", r6(F.col("cost_train")).alias("cost_train"), r6(F.col("cost_val")).alias("cost_val"))
