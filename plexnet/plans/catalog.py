"""Registered queries: one Spark builder per operator key of SURVEY section 2,
each over whole tables of a scale folder, plus its DuckDB oracle SQL where
the operator is expressible in SQL.

Compared values are rounded to 6 digits (sums over many rows too; their
float order differs between engines only far below that).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexnet.functions import activations as A
from plexnet.functions.random import md5_normal
from plexnet.functions.random import sql_mix_uniform as mix_sql
from plexnet.operators import examples as E
from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.operators import steps as S
from plexnet.operators.metrics import accuracy, cross_entropy, log_loss, output_error, predict, reg_cost, squared_error
from plexnet.plans import sqltext as Q
from plexnet.plans.grid import model_grid, models_from_rows
from plexnet.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql()
        return fn
    return deco


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)


# ---------------------------------------------------------------------------
# networks used by the queries (fixed architectures over the fixtures)
# ---------------------------------------------------------------------------
NET_L = Q.Net("L8", [4, 8, 1], activation="sigmoid", init="xnormal")
NET_L2 = Q.Net("L84", [4, 8, 4, 1], activation="tanh", init="xuniform", rate=0.5, lmbda=0.01)
NET_LA = Q.Net("L84ada", [4, 8, 4, 1], activation="tanh", init="xuniform", rate=0.5, lmbda=0.01,
               learning_mod="ADA")
NET_LV = Q.Net("L84v", [4, 8, 4, 1], activation="ELU", init="deeplearning", fan="fan_avg",
               rate=0.3, lmbda=0.01, optimizer="vanilla")
NET_LSQ = Q.Net("L8sq", [4, 8, 1], activation="LReLU", init="xnormal", loss="squared")
NET_E = Q.Net("E16", [64, 16, 10], activation="ReLU", init="deeplearning", fan="fan_avg")
NET_FIT_L = Q.Net("L8fit", [4, 8, 1], activation="sigmoid", init="xnormal", rate=0.5)
NET_FIT_E = Q.Net("E16fit", [64, 16, 10], activation="tanh", init="xuniform", rate=0.1)
NET_FIT_N = Q.Net("L84nes", [4, 8, 4, 1], activation="sigmoid", init="xnormal", rate=0.3,
                  optimizer="nesterov")


def _models(spark: SparkSession, *nets: Q.Net) -> DataFrame:
    return models_from_rows(spark, [n.settings() for n in nets])


def _params(spark: SparkSession, *nets: Q.Net, state: bool = False) -> tuple[DataFrame, DataFrame]:
    m = _models(spark, *nets)
    p = P.init_params(m, nets[0].n_features)
    return m, (with_state(p) if state else p)


def with_state(params: DataFrame) -> DataFrame:
    """Optimiser state drawn from md5 of the keys (for step operators that
    need a non-zero velocity and gradient sum): v = 0.01 N, gacc = 0.1 N."""
    keys = [F.col(k) for k in P.KEYS]
    return params.select(*P.KEYS, "theta", (F.lit(0.01) * md5_normal(*keys, "v")).alias("velocity"),
                         (F.lit(0.1) * md5_normal(*keys, "g")).alias("gacc"))


def _sql(ctes: list[str], body: str) -> str:
    return Q.with_clause(ctes) + body


def _ex_cte(name: str, where: str | None = None) -> str:
    w = f" WHERE {where}" if where else ""
    return f"ex AS MATERIALIZED (SELECT * FROM ({Q.fixture(name)}) f{w})"


def _params_cte(*nets: Q.Net, state: bool = False, name: str = "P") -> str:
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(Q.init_params(n, state) for n in nets) + ")"


#: Momentum of the first epoch.
MU0 = S.momentum_value(0, 1.0, 0.95)


def _trained(spark: SparkSession, sf: str, *pairs: tuple[Q.Net, str]) -> DataFrame:
    """Parameters after one full-batch momentum step on the fixture of each
    net: weights, velocities and gradient sums that come from the table."""
    out = []
    for fx in dict.fromkeys(f for _, f in pairs):
        ex = T.fixture(spark, sf, fx)
        m = _models(spark, *(n for n, f in pairs if f == fx))
        p = with_state(P.init_params(m, E.feature_width_value(ex)))
        sums = PS.stored_sums(PS.gradient_sums(ex, p, m))
        out.append(S.step_momentum(S.mean_gradient(sums, p, m), m, MU0).select(
            *P.KEYS, "theta", "velocity", "gacc"))
    return PS.stored_sums(PS._union(out))


def _trained_ctes(*pairs: tuple[Q.Net, str], name: str = "P") -> list[str]:
    """The same parameters in SQL, as the table ``name``."""
    ctes, tables, tag = [], [], name.lower()
    for fx in dict.fromkeys(f for _, f in pairs):
        ctes.append(f"{tag}_ex_{fx} AS MATERIALIZED ({Q.fixture(fx)})")
    for i, (net, fx) in enumerate(pairs):
        ex, p0 = f"{tag}_ex_{fx}", f"{tag}_{i}_p"
        ctes.append(f"{p0} AS MATERIALIZED ({Q.init_params(net, True)})")
        bc, gs = Q.backprop_ctes(net, ex, p0, f"{tag}_{i}_b_")
        mc, mg = Q.mean_gradient_ctes(net, p0, gs, f"(SELECT count(*) FROM {ex})", f"{tag}_{i}_m_")
        sc, new = Q.step_ctes(net, mg, f"{tag}_{i}_s_", "momentum", MU0, n_train=f"(SELECT count(*) FROM {ex})")
        ctes += bc + mc + sc
        tables.append(f"SELECT model_id, layer, row, col, theta, velocity, gacc FROM {new}")
    return [*ctes, f"{name} AS MATERIALIZED (" + " UNION ALL ".join(tables) + ")"]


# ---------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------

def _feature_cols(c: str = "features", n: int = 4) -> list[Column]:
    return [r6(F.element_at(c, i + 1)).alias(f"f{i}") for i in range(n)]


@query("examples_scan", lambda: _sql([_ex_cte("L")],
       "SELECT id, label, split, " + ", ".join(Q.r6(f"features[{i + 1}]") + f" AS f{i}" for i in range(4))
       + " FROM ex"))
def q_examples_scan(spark, sf):
    ex = T.fixture(spark, sf, "L")
    return ex.select("id", "label", "split", *_feature_cols())


@query("examples_scan_documents", lambda: _sql([_ex_cte("D")],
       "SELECT id, label, split, " + ", ".join(Q.r6(f"features[{i + 1}]") + f" AS f{i}" for i in range(5))
       + " FROM ex"))
def q_examples_scan_documents(spark, sf):
    """Fixture D: text statistics of whole documents (regex character shares)."""
    ex = T.fixture(spark, sf, "D")
    return ex.select("id", "label", "split", *_feature_cols(n=5))


def _labels_sql() -> str:
    def lab(fx):
        return f"(SELECT id, label FROM ({Q.fixture(fx)}) q)"
    return _sql([f"e AS {lab('E')}", f"e2 AS {lab('E2')}", f"es AS {lab('ES')}"],
                "SELECT e.id, e.label AS label_e, e2.label AS label_e2, es.label AS label_es "
                "FROM e JOIN e2 ON e.id = e2.id JOIN es ON e.id = es.id")


@query("examples_labels_embeddings", _labels_sql)
def q_examples_labels_embeddings(spark, sf):
    """Fixtures E, E2 and ES: the three labels derived from embeddings."""
    e = T.fixture(spark, sf, "E").select("id", F.col("label").alias("label_e"))
    e2 = T.fixture(spark, sf, "E2").select("id", F.col("label").alias("label_e2"))
    es = T.fixture(spark, sf, "ES").select("id", F.col("label").alias("label_es"))
    return e.join(e2, "id").join(es, "id")


@query("examples_labels_multi", lambda: _sql([_ex_cte("LM"), "dt AS (" + Q.fixture("DT") + ")"],
       "SELECT 'LM' AS fixture, label, count(*) AS n FROM ex GROUP BY label "
       "UNION ALL SELECT 'DT' AS fixture, label, count(*) AS n FROM dt GROUP BY label"))
def q_examples_labels_multi(spark, sf):
    """Fixtures LM (3 classes from l_returnflag) and DT (rare toxic class): label counts."""
    def counts(name):
        return (T.fixture(spark, sf, name).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(name).alias("fixture"), "label", "n"))
    return counts("LM").unionByName(counts("DT"))


@query("example_counts", lambda: _sql([_ex_cte("D")],
       "SELECT split, count(*) AS n FROM ex GROUP BY split"))
def q_example_counts(spark, sf):
    return E.count_examples(T.fixture(spark, sf, "D"))


@query("feature_width", lambda: _sql([_ex_cte("E")],
       "SELECT CAST(min(len(features)) AS INTEGER) AS min_width, "
       "CAST(max(len(features)) AS INTEGER) AS max_width, count(*) AS n FROM ex"))
def q_feature_width(spark, sf):
    return E.feature_width(T.fixture(spark, sf, "E"))


def _libsvm_roundtrip(spark, sf):
    from plexnet.session import scratch_path
    from plexnet.sources.libsvm import read_libsvm, write_libsvm
    ex = T.fixture(spark, sf, "L")
    path = scratch_path(spark, "libsvm")
    write_libsvm(ex, path)
    return read_libsvm(spark, path, num_features=4)


@query("libsvm_scan", lambda: _sql([_ex_cte("L")],
       "SELECT label, " + ", ".join(Q.r6(f"features[{i + 1}]") + f" AS f{i}" for i in range(4))
       + ", 1 AS rows_of_id, true AS has_split FROM ex"))
def q_libsvm_scan(spark, sf):
    back = _libsvm_roundtrip(spark, sf)
    of_id = Window.partitionBy("id")
    return back.select("label", *_feature_cols(), F.count(F.lit(1)).over(of_id).cast("int").alias("rows_of_id"),
                       F.col("split").isin("train", "val").alias("has_split"))


TWO = ((NET_L2, "L"), (NET_E, "E"))
_THETA_SQL = "SELECT model_id, layer, row, col, " + Q.r6("theta") + " AS theta FROM P"


@query("weights_text_roundtrip", lambda: _sql(_trained_ctes(*TWO), _THETA_SQL))
def q_weights_text_roundtrip(spark, sf):
    from plexnet.session import scratch_path
    from plexnet.sources.weights import read_weights_text, write_weights_text
    path = scratch_path(spark, "weights")
    write_weights_text(_trained(spark, sf, *TWO), path, activation={n.model_id: n.activation for n, _ in TWO})
    back = read_weights_text(spark, path)
    return back.select("model_id", "layer", "row", "col", r6(F.col("theta")).alias("theta"))


@query("params_roundtrip", lambda: _sql(_trained_ctes((NET_L2, "L")),
       "SELECT model_id, layer, row, col, " + Q.r6("theta") + " AS theta, " + Q.r6("velocity")
       + " AS velocity, " + Q.r6("gacc") + " AS gacc FROM P"))
def q_params_roundtrip(spark, sf):
    from plexnet.session import scratch_path
    from plexnet.sources.weights import read_params, write_params
    path = scratch_path(spark, "params")
    write_params(_trained(spark, sf, (NET_L2, "L")), path)
    back = read_params(spark, path)
    return back.select("model_id", "layer", "row", "col", r6(F.col("theta")).alias("theta"),
                       r6(F.col("velocity")).alias("velocity"), r6(F.col("gacc")).alias("gacc"))


# ---------------------------------------------------------------------------
# 2.2 checks, split, grid
# ---------------------------------------------------------------------------

def _validate_sql() -> str:
    return _sql([_ex_cte("LM")], """SELECT count(*) AS n,
  count(*) FILTER (WHERE features IS NULL OR len(features) = 0) AS null_features,
  count(*) FILTER (WHERE features IS NOT NULL AND len(list_filter(features, lambda x: x IS NULL OR isnan(x))) > 0) AS bad_values,
  count(*) FILTER (WHERE label IS NULL OR isnan(label)) AS bad_labels,
  count(*) FILTER (WHERE label IS NOT NULL AND NOT isnan(label) AND (label < 0 OR label >= 2)) AS label_out_of_range,
  count(*) FILTER (WHERE label IS NOT NULL AND NOT isnan(label) AND label <> floor(label)) AS label_not_integer,
  CAST(min(len(features)) AS INTEGER) AS min_width, CAST(max(len(features)) AS INTEGER) AS max_width
FROM ex""")


@query("validate_examples", _validate_sql)
def q_validate_examples(spark, sf):
    return E.validate_examples(T.fixture(spark, sf, "LM"), outputs=2)


@query("split_examples", lambda: _sql([_ex_cte("E")],
       f"SELECT id, {Q.split_expr('id', 0.3, 7)} AS split FROM ex"))
def q_split_examples(spark, sf):
    return E.split_examples(T.fixture(spark, sf, "E"), 0.3, 7).select("id", "split")


GRID_TOPOLOGIES = "8-16,8-4,4,4"
GRID_RATES = "0.1,0.01"


def _grid_sql() -> str:
    rows = []
    for t in GRID_TOPOLOGIES.split("-"):
        hs = [int(h) for h in t.split(",")]
        for r in GRID_RATES.split(","):
            rows.append((f"{t}@{r}", t, float(r), hs))
    vals = []
    for mid, t, r, hs in rows:
        sizes = "[" + ", ".join(["w.f"] + [str(h) for h in hs] + ["1"]) + "]"
        vals.append(f"SELECT {Q.q(mid)} AS model_id, {Q.q(t)} AS hidden, {Q.d(r)} AS rate, "
                    f"{sizes} AS sizes FROM w")
    return _sql([_ex_cte("L"), "w AS (SELECT CAST(max(len(features)) AS INTEGER) AS f FROM ex)",
                 "g AS (" + " UNION ALL ".join(vals) + ")"],
                "SELECT model_id, hidden, rate, array_to_string(sizes, ',') AS sizes, "
                "CAST(len(sizes) - 1 AS INTEGER) AS n_layers, "
                "CAST(list_sum(list_transform(range(1, len(sizes)), lambda j: (sizes[j] + 1) * sizes[j + 1])) AS BIGINT) AS n_weights "
                "FROM g")


@query("model_grid", _grid_sql)
def q_model_grid(spark, sf):
    w = E.feature_width_value(T.fixture(spark, sf, "L"))
    g = model_grid(spark, GRID_TOPOLOGIES, GRID_RATES)
    arch = P.architecture(g, w)
    return (g.select("model_id", F.array_join(F.transform("hidden", lambda h: h.cast("string")), ",")
                     .alias("hidden"), "rate")
            .join(arch, "model_id")
            .select("model_id", "hidden", "rate", F.array_join(F.transform("sizes", lambda h: h.cast("string")), ",")
                    .alias("sizes"), "n_layers", "n_weights"))


# ---------------------------------------------------------------------------
# 2.3 scalar functions over fixture Z
# ---------------------------------------------------------------------------

def _act_query(name: str, derivative: bool):
    key = f"act_{'d_' if derivative else ''}{ {'sigmoid': 'sigmoid', 'tanh': 'tanh', 'ReLU': 'relu', 'LReLU': 'lrelu', 'ELU': 'elu'}[name] }"

    def sql():
        return _sql([f"z AS ({Q.z_values()})"],
                    f"SELECT id, {Q.r6('z')} AS z, {Q.r6(Q.act(name, 'z', derivative))} AS a FROM z")

    def fn(spark, sf):
        act = A.get_activation(name)
        f = act.d_column if derivative else act.column
        z = T.z_values(spark, sf)
        return z.select("id", r6(F.col("z")).alias("z"), r6(f(F.col("z"))).alias("a"))

    query(key, sql)(fn)


for _n in ("sigmoid", "tanh", "ReLU", "LReLU", "ELU"):
    _act_query(_n, False)
    _act_query(_n, True)


@query("clip_prob", lambda: _sql(
    [f"z AS ({Q.z_values()})", f"s AS (SELECT id, z, {Q.act('sigmoid', Q.d(8.0) + ' * z')} AS p FROM z)"],
    f"SELECT id, {Q.r6('p')} AS p, {Q.r6('-ln(' + Q.clip_prob('p') + ')')} AS nlogp, "
    f"{Q.r6('-ln(' + Q.d(1.0) + ' - ' + Q.clip_prob('p') + ')')} AS nlog1mp FROM s"))
def q_clip_prob(spark, sf):
    z = T.z_values(spark, sf)
    p = A.sigmoid(F.lit(8.0) * F.col("z"))
    pc = A.clip_prob(p)
    return z.select("id", r6(p).alias("p"), r6(-F.log(pc)).alias("nlogp"),
                    r6(-F.log(F.lit(1.0) - pc)).alias("nlog1mp"))


@query("softmax", lambda: _sql(
    [_ex_cte("E"),
     f"x AS (SELECT id, CAST(generate_subscripts(features, 1) AS INTEGER) - 1 AS k, "
     f"unnest(features) * {Q.d(20.0)} AS z FROM ex)",
     "m AS (SELECT id, k, z, max(z) OVER (PARTITION BY id) AS mz FROM x)"],
    f"SELECT id, k, {Q.r6('exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY id)')} AS p FROM m"))
def q_softmax(spark, sf):
    ex = T.fixture(spark, sf, "E")
    sm = A.softmax(F.transform("features", lambda x: x * 20.0))
    return ex.select("id", F.posexplode(sm).alias("k", "p")).select("id", "k", r6(F.col("p")).alias("p"))


@query("apply_activation", lambda: _sql(
    [_ex_cte("E"),
     f"x AS (SELECT id, CAST(generate_subscripts(features, 1) AS INTEGER) - 1 AS k, "
     f"unnest(features) * {Q.d(5.0)} AS z FROM ex)"],
    f"SELECT id, k, {Q.r6(Q.act('ELU', 'z', True))} AS a FROM x"))
def q_apply_activation(spark, sf):
    ex = T.fixture(spark, sf, "E").withColumn("z", F.transform("features", lambda x: x * 5.0))
    out = A.apply_activation(ex, "z", "ELU", derivative=True, out="a")
    return out.select("id", F.posexplode("a").alias("k", "a")).select("id", "k", r6(F.col("a")).alias("a"))


# ---------------------------------------------------------------------------
# 2.4 forward pass, scoring, metrics
# ---------------------------------------------------------------------------

def _forward_sql(net: Q.Net, fx: str, body_fn, where: str | None = None, state=False) -> str:
    ctes = [_ex_cte(fx, where), _params_cte(net, state=state)]
    fc, out = Q.forward_ctes(net, "ex", "P", "f_")
    return _sql(ctes + fc, body_fn(out))


def _score(spark, sf, net: Q.Net, fx: str, what="p", where: Column | None = None, keep=()):
    ex = T.fixture(spark, sf, fx)
    if where is not None:
        ex = ex.where(where)
    m, p = _params(spark, net)
    return PS.score(ex, p, m, what=what, keep=keep), ex, m, p


@query("linear_layer", lambda: _sql(
    [_ex_cte("L"), _params_cte(NET_L)] + Q.forward_ctes(NET_L, "ex", "P", "f_")[0][:2],
    f"SELECT id, col AS k, {Q.r6('z')} AS z FROM f_z1"))
def q_linear_layer(spark, sf):
    s, *_ = _score(spark, sf, NET_L, "L", what="z1")
    return s.select("id", F.posexplode("p").alias("k", "z")).select("id", "k", r6(F.col("z")).alias("z"))


@query("score_binary", lambda: _forward_sql(NET_L, "L", lambda o: f"SELECT id, {Q.r6('p')} AS p FROM {o}"))
def q_score_binary(spark, sf):
    s, *_ = _score(spark, sf, NET_L, "L")
    return s.select("id", r6(F.element_at("p", 1)).alias("p"))


@query("score_multi", lambda: _forward_sql(NET_E, "E", lambda o: f"SELECT id, col AS k, {Q.r6('p')} AS p FROM {o}"))
def q_score_multi(spark, sf):
    s, *_ = _score(spark, sf, NET_E, "E")
    return s.select("id", F.posexplode("p").alias("k", "p")).select("id", "k", r6(F.col("p")).alias("p"))


@query("predict_binary", lambda: _forward_sql(NET_L, "L", lambda o: Q.predict_expr(NET_L, o)))
def q_predict_binary(spark, sf):
    s, *_ = _score(spark, sf, NET_L, "L")
    return predict(s, False).select("id", "pred")


@query("predict_multi", lambda: _forward_sql(NET_E, "E", lambda o: Q.predict_expr(NET_E, o)))
def q_predict_multi(spark, sf):
    s, *_ = _score(spark, sf, NET_E, "E")
    return predict(s, True).select("id", "pred")


def _labelled(spark, sf, net, fx, where=None):
    return _score(spark, sf, net, fx, where=where, keep=("label",))[0]


def _metric_sql(net, fx, select, where=None):
    def body(o):
        return f"SELECT {Q.q(net.model_id)} AS model_id, {select} FROM {o} o JOIN ex e ON e.id = o.id"
    return _forward_sql(net, fx, body, where)


@query("log_loss", lambda: _metric_sql(
    NET_L, "L", "count(*) AS n, " + Q.r6(
        f"avg(-(e.label * ln({Q.clip_prob('o.p')}) + ({Q.d(1.0)} - e.label) * ln({Q.d(1.0)} - {Q.clip_prob('o.p')})))")
    + " AS log_loss"))
def q_log_loss(spark, sf):
    return log_loss(_labelled(spark, sf, NET_L, "L")).select("model_id", "n", r6(F.col("log_loss")).alias("log_loss"))


@query("cross_entropy", lambda: _metric_sql(
    NET_E, "E", "count(*) AS n, " + Q.r6("avg(-ln(o.p))") + " AS cross_entropy")
    .replace("JOIN ex e ON e.id = o.id", "JOIN ex e ON e.id = o.id AND o.col = CAST(e.label AS INTEGER)"))
def q_cross_entropy(spark, sf):
    return cross_entropy(_labelled(spark, sf, NET_E, "E")).select(
        "model_id", "n", r6(F.col("cross_entropy")).alias("cross_entropy"))


@query("accuracy", lambda: _sql(
    [_ex_cte("L", "split = 'val'"), _params_cte(NET_L)] + Q.forward_ctes(NET_L, "ex", "P", "f_")[0],
    f"SELECT {Q.q(NET_L.model_id)} AS model_id, count(*) AS n, "
    + Q.r6(f"avg(CASE WHEN pr.pred = e.label THEN {Q.d(1.0)} ELSE {Q.d(0.0)} END)")
    + f" AS accuracy FROM ({Q.predict_expr(NET_L, 'f_out')}) pr JOIN ex e ON e.id = pr.id"))
def q_accuracy(spark, sf):
    s = _labelled(spark, sf, NET_L, "L", where=F.col("split") == "val")
    return accuracy(s, False).select("model_id", "n", r6(F.col("accuracy")).alias("accuracy"))


@query("squared_error", lambda: _metric_sql(
    NET_L, "L", Q.r6("sum(pow(e.label - o.p, 2))", 4) + " AS sqe, "
    + Q.r6("sum(e.label * e.label) - sum(e.label) * sum(e.label) / count(*)", 4) + " AS sst, "
    + Q.r6(f"{Q.d(1.0)} - sum(pow(e.label - o.p, 2)) / (sum(e.label * e.label) - sum(e.label) * sum(e.label) / count(*))")
    + " AS r2"))
def q_squared_error(spark, sf):
    s = squared_error(_labelled(spark, sf, NET_L, "L"))
    return s.select("model_id", r6(F.col("sqe"), 4).alias("sqe"), r6(F.col("sst"), 4).alias("sst"),
                    r6(F.col("r2")).alias("r2"))


def _evaluate_sql(net: Q.Net, where: str | None = "split = 'val'", extra_cost=None) -> str:
    ctes = [_ex_cte("L", where), _params_cte(net)]
    fc, out = Q.forward_ctes(net, "ex", "P", "f_")
    ctes += fc + [f"c AS ({Q.row_cost(net, out, 'ex')})",
                  f"pr AS ({Q.predict_expr(net, out)})"]
    return _sql(ctes, f"SELECT {Q.q(net.model_id)} AS model_id, (SELECT count(*) FROM ex) AS n, "
                      f"{Q.r6('(SELECT avg(cost) FROM c)')} AS cost, "
                      f"{Q.r6('(SELECT avg(CASE WHEN pr.pred = e.label THEN 1.0 ELSE 0.0 END) FROM pr JOIN ex e ON e.id = pr.id)')} AS accuracy, "
                      f"{Q.r6('(SELECT sum(pow(e.label - o.p, 2)) FROM ' + out + ' o JOIN ex e ON e.id = o.id)', 4)} AS sqe")


@query("evaluate", lambda: _evaluate_sql(NET_L))
def q_evaluate(spark, sf):
    ex = T.fixture(spark, sf, "L").where(F.col("split") == "val")
    m, p = _params(spark, NET_L)
    ev = PS.evaluate(ex, p, m)
    return ev.select("model_id", "n", r6(F.col("cost")).alias("cost"), r6(F.col("accuracy")).alias("accuracy"),
                     r6(F.col("sqe"), 4).alias("sqe"))


@query("squared_loss", lambda: _evaluate_sql(NET_LSQ))
def q_squared_loss(spark, sf):
    ex = T.fixture(spark, sf, "L").where(F.col("split") == "val")
    m, p = _params(spark, NET_LSQ)
    ev = PS.evaluate(ex, p, m)
    return ev.select("model_id", "n", r6(F.col("cost")).alias("cost"), r6(F.col("accuracy")).alias("accuracy"),
                     r6(F.col("sqe"), 4).alias("sqe"))


@query("reg_cost", lambda: _sql(
    [_ex_cte("L", "split = 'val'"), _params_cte(NET_L2)] + Q.forward_ctes(NET_L2, "ex", "P", "f_")[0]
    + [f"c AS ({Q.row_cost(NET_L2, 'f_out', 'ex')})",
       "w AS (SELECT sum(CASE WHEN row > 0 THEN theta * theta ELSE 0.0 END) AS sq FROM P)"],
    f"SELECT {Q.q(NET_L2.model_id)} AS model_id, {Q.r6('(SELECT avg(cost) FROM c)')} AS cost, "
    f"{Q.r6('(SELECT avg(cost) FROM c) + ' + Q.d(NET_L2.lmbda) + ' / 2.0 * (SELECT sq FROM w)')} AS reg_cost"))
def q_reg_cost(spark, sf):
    ex = T.fixture(spark, sf, "L").where(F.col("split") == "val")
    m, p = _params(spark, NET_L2)
    ev = PS.evaluate(ex, p, m).select("model_id", "cost")
    return reg_cost(ev, p, m).select("model_id", r6(F.col("cost")).alias("cost"),
                                     r6(F.col("reg_cost")).alias("reg_cost"))


@query("output_error", lambda: _forward_sql(
    NET_L, "L", lambda o: f"SELECT o.id, o.col AS k, {Q.r6('o.p - e.label')} AS e FROM {o} o JOIN ex e ON e.id = o.id"))
def q_output_error(spark, sf):
    s = output_error(_labelled(spark, sf, NET_L, "L"), multi=False)
    return s.select("id", F.posexplode("e").alias("k", "e")).select("id", "k", r6(F.col("e")).alias("e"))


@query("output_error_multi", lambda: _forward_sql(
    NET_E, "E", lambda o: "SELECT o.id, o.col AS k, " + Q.r6(
        "o.p - CASE WHEN o.col = CAST(e.label AS INTEGER) THEN 1.0 ELSE 0.0 END")
    + f" AS e FROM {o} o JOIN ex e ON e.id = o.id"))
def q_output_error_multi(spark, sf):
    s = output_error(_labelled(spark, sf, NET_E, "E"), multi=True)
    return s.select("id", F.posexplode("e").alias("k", "e")).select("id", "k", r6(F.col("e")).alias("e"))


# ---------------------------------------------------------------------------
# 2.5 backpropagation and gradient sums
# ---------------------------------------------------------------------------

def _gsum_sql(net: Q.Net, fx: str, state=False, P_name="P", extra=None) -> tuple[list[str], str]:
    ctes = [_ex_cte(fx), _params_cte(net, state=state)]
    if extra:
        ctes += extra
    bc, gs = Q.backprop_ctes(net, "ex", P_name, "b_")
    return ctes + bc, gs


def _gsums(spark, sf, net: Q.Net, fx: str, state=False, lookahead_mu=None):
    ex = T.fixture(spark, sf, fx)
    m, p = _params(spark, net, state=state)
    la = {net.model_id: lookahead_mu} if lookahead_mu is not None else None
    return PS.gradient_sums(ex, p, m, lookahead_mu=la), ex, m, p


def _gsum_query_sql(net, fx):
    ctes, gs = _gsum_sql(net, fx)
    return _sql(ctes, f"SELECT {Q.q(net.model_id)} AS model_id, layer, row, col, {Q.r6('g', 4)} AS g FROM {gs}")


def _gsum_out(sums):
    return sums.where(F.col("layer") >= 0).select("model_id", "layer", "row", "col",
                                                  r6(F.col("value"), 4).alias("g"))


@query("gradient_sums", lambda: _gsum_query_sql(NET_L2, "L"))
def q_gradient_sums(spark, sf):
    return _gsum_out(_gsums(spark, sf, NET_L2, "L")[0])


@query("gradient_sums_multi", lambda: _gsum_query_sql(NET_E, "E"))
def q_gradient_sums_multi(spark, sf):
    return _gsum_out(_gsums(spark, sf, NET_E, "E")[0])


def _mg_sql(net: Q.Net, add_velocity=False, look_mu=None) -> tuple[list[str], str]:
    """CTEs up to the mean-gradient table (with state), over all rows of L."""
    extra = None
    P_name = "P"
    if look_mu is not None:
        extra = [f"PL AS MATERIALIZED (SELECT model_id, layer, row, col, theta + {Q.d(look_mu)} * velocity "
                 f"AS theta, velocity, gacc FROM P)"]
        P_name = "PL"
    ctes, gs = _gsum_sql(net, "L", state=True, P_name=P_name, extra=extra)
    mc, mg = Q.mean_gradient_ctes(net, "P", gs, "(SELECT count(*) FROM ex)", "m_", add_velocity)
    return ctes + mc, mg


def _mg(spark, sf, net: Q.Net, add_velocity=False, look_mu=None):
    sums, ex, m, p = _gsums(spark, sf, net, "L", state=True, lookahead_mu=look_mu)
    return S.mean_gradient(PS.stored_sums(sums), p, m, add_velocity=add_velocity), m, ex


def _keys_out(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*P.KEYS, *[r6(F.col(c), digits).alias(c) for c in cols])


def _keys_sql(ctes, table, *cols, digits: int = 6) -> str:
    return _sql(ctes, "SELECT model_id, layer, row, col, "
                + ", ".join(f"{Q.r6(c, digits)} AS {c}" for c in cols) + f" FROM {table}")


@query("mean_gradient", lambda: _keys_sql(*_mg_sql(NET_L2), "g"))
def q_mean_gradient(spark, sf):
    return _keys_out(_mg(spark, sf, NET_L2)[0], "g")


@query("mean_gradient_velocity", lambda: _keys_sql(*_mg_sql(NET_L2, add_velocity=True), "g"))
def q_mean_gradient_velocity(spark, sf):
    return _keys_out(_mg(spark, sf, NET_L2, add_velocity=True)[0], "g")


# ---------------------------------------------------------------------------
# 2.6 sampling
# ---------------------------------------------------------------------------

@query("minibatch", lambda: _sql(
    [_ex_cte("L"), "n AS (SELECT count(*) AS n FROM ex WHERE split = 'train')"],
    f"SELECT id FROM ex WHERE split = 'train' AND {mix_sql(Q.md5_bits('id', Q.q('2332')), 2332, 3)} < "
    f"least({Q.d(1.0)}, {Q.d(512.0)} / (SELECT n FROM n))"))
def q_minibatch(spark, sf):
    ex = T.fixture(spark, sf, "L")
    n = ex.where(F.col("split") == "train").count()
    return E.minibatch(ex, 3, n, 512, 2332).select("id")


@query("online_example", lambda: _sql(
    [_ex_cte("L")],
    f"SELECT id, label, split FROM ex WHERE id = (SELECT arg_min(id, ({mix_sql(Q.md5_bits('id', Q.q('2332')), 2332, 10)}, id)) "
    f"FROM ex WHERE split = 'train')"))
def q_online_example(spark, sf):
    ex = T.fixture(spark, sf, "L")
    return E.online_example(ex, 0, 2332).select("id", "label", "split")


def _epoch_table(spark, sf) -> DataFrame:
    """Epoch numbers 0..49 taken from the data (distinct quantities - 1)."""
    return (T.table(spark, sf, "lineitem").select((F.col("l_quantity") - 1).cast("int").alias("epoch"))
            .distinct())


_EPOCHS_SQL = "e AS (SELECT DISTINCT CAST(l_quantity - 1 AS INTEGER) AS epoch FROM lineitem)"


@query("momentum_schedule", lambda: _sql(
    [_EPOCHS_SQL],
    "SELECT epoch, " + ", ".join(
        Q.r6(f"least({Q.d(1.0)} - pow({Q.d(2.0)}, {Q.d(-1.0)} - log2(epoch / {Q.d(it)} + {Q.d(1.0)})), {Q.d(0.95)})")
        + f" AS mu_{i}" for i, it in ((1, 1.0), (3, 3.0))) + " FROM e"))
def q_momentum_schedule(spark, sf):
    e = _epoch_table(spark, sf)
    return e.select("epoch", *[r6(S.momentum_schedule(F.col("epoch"), F.lit(it), F.lit(0.95))).alias(f"mu_{i}")
                               for i, it in ((1, 1.0), (3, 3.0))])


@query("nesterov_schedule", lambda: _sql(
    [_EPOCHS_SQL],
    f"SELECT epoch, {Q.r6(f'least({Q.d(1.0)} - {Q.d(3.0)} / (epoch + {Q.d(5.0)}), {Q.d(0.95)})')} AS mu FROM e"))
def q_nesterov_schedule(spark, sf):
    e = _epoch_table(spark, sf)
    return e.select("epoch", r6(S.nesterov_schedule(F.col("epoch"), F.lit(0.95))).alias("mu"))


# ---------------------------------------------------------------------------
# 2.7 parameter tables
# ---------------------------------------------------------------------------

@query("architecture", lambda: _sql(
    [_ex_cte("E"), "w AS (SELECT CAST(max(len(features)) AS INTEGER) AS f FROM ex)"],
    f"SELECT {Q.q(NET_E.model_id)} AS model_id, array_to_string([w.f, 16, 10], ',') AS sizes, "
    f"CAST(2 AS INTEGER) AS n_layers, CAST((w.f + 1) * 16 + 17 * 10 AS BIGINT) AS n_weights, "
    f"CAST(26 AS INTEGER) AS n_neurons FROM w"))
def q_architecture(spark, sf):
    w = E.feature_width_value(T.fixture(spark, sf, "E"))
    a = P.architecture(_models(spark, NET_E), w)
    return a.select("model_id", F.array_join(F.transform("sizes", lambda h: h.cast("string")), ",").alias("sizes"),
                    "n_layers", "n_weights", "n_neurons")


def _init_query(net: Q.Net, fx: str):
    """Fresh weights with the width of the fixture, a column of the plan."""
    def fn(spark, sf):
        ex = T.fixture(spark, sf, fx)
        p = P.init_params(_models(spark, net), E.feature_width_value(ex))
        width = E.feature_width(ex).select(F.col("max_width").cast("int").alias("n_features"))   # one row
        return p.crossJoin(width).select(*P.KEYS, r6(F.col("theta")).alias("theta"), "n_features")
    return fn


def _init_sql(net: Q.Net, fx: str) -> str:
    return _sql([_ex_cte(fx), _params_cte(net)],
                "SELECT model_id, layer, row, col, " + Q.r6("theta")
                + " AS theta, (SELECT CAST(max(len(features)) AS INTEGER) FROM ex) AS n_features FROM P")


NET_INIT_U = Q.Net("U", [4, 8, 4, 1], init="xuniform", seed=11)
NET_INIT_N = Q.Net("N", [64, 16, 10], init="xnormal", seed=12)
NET_INIT_F = Q.Net("F", [64, 16, 10], init="deeplearning", fan="fan_out", seed=13)

query("init_xuniform", lambda: _init_sql(NET_INIT_U, "L"))(_init_query(NET_INIT_U, "L"))
query("init_xnormal", lambda: _init_sql(NET_INIT_N, "E"))(_init_query(NET_INIT_N, "E"))
query("init_fan", lambda: _init_sql(NET_INIT_F, "E"))(_init_query(NET_INIT_F, "E"))


@query("zero_state", lambda: _sql(_trained_ctes((NET_L2, "L")),
       "SELECT model_id, layer, row, col, " + Q.r6("theta") + f" AS theta, {Q.d(0.0)} AS velocity, "
       f"{Q.d(0.0)} AS gacc FROM P"))
def q_zero_state(spark, sf):
    p = P.zero_state(_trained(spark, sf, (NET_L2, "L")))
    return p.select(*P.KEYS, r6(F.col("theta")).alias("theta"), "velocity", "gacc")


NET_AE_STORED = Q.Net("W", [4, 8, 6], init="xnormal", seed=21)
NET_AE_FRESH = Q.Net("W", [4, 8, 6, 1], init="xuniform", seed=22)
NET_PT_STORED = Q.Net("W", [4, 8, 6, 1], init="xnormal", seed=31)


def _warm_sql(stored: Q.Net, fresh: Q.Net, mode: str) -> str:
    last = stored.n_layers - 1
    cond = f"s.layer <= {last}" if mode == "AE" else f"s.layer < {last}"
    return _sql(_trained_ctes((stored, "L"), name="S") + [f"Fr AS ({Q.init_params(fresh)})"],
                "SELECT f.model_id, f.layer, f.row, f.col, "
                + Q.r6("coalesce(s.theta, f.theta)") + " AS theta FROM Fr f LEFT JOIN S s ON "
                f"s.layer = f.layer AND s.row = f.row AND s.col = f.col AND {cond}")


def _warm_query(stored: Q.Net, fresh: Q.Net, mode: str):
    def fn(spark, sf):
        w = E.feature_width_value(T.fixture(spark, sf, "L"))
        st = _trained(spark, sf, (stored, "L"))
        fr = P.init_params(_models(spark, fresh), w)
        out = P.warm_start(fr, st, mode)
        return out.select(*P.KEYS, r6(F.col("theta")).alias("theta"))
    return fn


query("warm_start_ae", lambda: _warm_sql(NET_AE_STORED, NET_AE_FRESH, "AE"))(
    _warm_query(NET_AE_STORED, NET_AE_FRESH, "AE"))
query("warm_start_pt", lambda: _warm_sql(NET_PT_STORED, NET_AE_FRESH, "PT"))(
    _warm_query(NET_PT_STORED, NET_AE_FRESH, "PT"))


THREE = ((NET_L, "L"), (NET_L2, "L"), (NET_LV, "L"))


@query("layer_shapes", lambda: _sql(_trained_ctes(*THREE),
       "SELECT model_id, layer, max(row) + 1 AS rows, max(col) + 1 AS cols, count(*) AS n FROM P "
       "GROUP BY model_id, layer"))
def q_layer_shapes(spark, sf):
    return P.layer_shapes(_trained(spark, sf, *THREE))


_FLAT_SQL = ("SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY layer, row, col) - 1 "
             "AS INTEGER) AS pos, " + Q.r6("theta") + " AS theta FROM P")


@query("flatten_params", lambda: _sql(_trained_ctes(*THREE), _FLAT_SQL))
def q_flatten_params(spark, sf):
    f = P.flatten_params(_trained(spark, sf, *THREE))
    return f.select("model_id", F.posexplode("flat").alias("pos", "theta")).select(
        "model_id", "pos", r6(F.col("theta")).alias("theta"))


@query("unflatten_params", lambda: _sql(_trained_ctes(*THREE), _THETA_SQL))
def q_unflatten_params(spark, sf):
    w = E.feature_width_value(T.fixture(spark, sf, "L"))
    models = _models(spark, NET_L, NET_L2, NET_LV)
    flat = P.flatten_params(_trained(spark, sf, *THREE))
    back = P.unflatten_params(flat, models, w)
    return back.select(*P.KEYS, r6(F.col("theta")).alias("theta"))


@query("weight_norms", lambda: _sql(_trained_ctes(*THREE),
       "SELECT model_id, " + Q.r6("sum(CASE WHEN row > 0 THEN theta * theta ELSE 0.0 END)")
       + " AS sq_weights FROM P GROUP BY model_id"))
def q_weight_norms(spark, sf):
    n = P.weight_norms(_trained(spark, sf, *THREE))
    return n.select("model_id", r6(F.col("sq_weights")).alias("sq_weights"))


# ---------------------------------------------------------------------------
# 2.8 optimiser steps (gradients of NET_L2 over all rows of L, md5 state)
# ---------------------------------------------------------------------------

@query("l1_norm", lambda: _sql(_mg_sql(NET_L2)[0],
       f"SELECT model_id, layer, {Q.r6('max(cs)')} AS l1 FROM (SELECT model_id, layer, col, sum(abs(g)) AS cs "
       f"FROM {_mg_sql(NET_L2)[1]} GROUP BY model_id, layer, col) GROUP BY model_id, layer"))
def q_l1_norm(spark, sf):
    g, *_ = _mg(spark, sf, NET_L2)
    return S.l1_norm(g).select("model_id", "layer", r6(F.col("l1")).alias("l1"))


def _clip_sql(kind: str) -> str:
    ctes, mg = _mg_sql(NET_L2)
    nrm = "max(cs)" if kind == "l1" else "sqrt(sum(sq))"
    ctes.append(f"n AS (SELECT layer, {nrm} AS nrm FROM (SELECT layer, col, sum(abs(g)) AS cs, "
                f"sum(g * g) AS sq FROM {mg} GROUP BY layer, col) GROUP BY layer)")
    return _sql(ctes, f"SELECT m.model_id, m.layer, m.row, m.col, "
                      f"{Q.r6('CASE WHEN n.nrm > 1.0 THEN m.g * 1.0 / n.nrm ELSE m.g END')} AS gc "
                      f"FROM {mg} m JOIN n ON n.layer = m.layer")


@query("clip_l1", lambda: _clip_sql("l1"))
def q_clip_l1(spark, sf):
    g, *_ = _mg(spark, sf, NET_L2)
    return _keys_out(S.clip_l1(g), "gc")


@query("clip_l2", lambda: _clip_sql("l2"))
def q_clip_l2(spark, sf):
    g, *_ = _mg(spark, sf, NET_L2)
    return _keys_out(S.clip_l2(g), "gc")


@query("accumulate_gradients", lambda: _keys_sql(
    _mg_sql(NET_L2)[0], f"(SELECT *, gacc + coalesce(g, 0.0) AS gacc2 FROM {_mg_sql(NET_L2)[1]}) x", "gacc2")
    .replace("AS gacc2 FROM (SELECT", "AS gacc FROM (SELECT", 1))
def q_accumulate_gradients(spark, sf):
    g, *_ = _mg(spark, sf, NET_L2)
    return _keys_out(S.accumulate_gradients(g), "gacc")


@query("adaptive_rate", lambda: _sql(
    _mg_sql(NET_L2)[0],
    f"SELECT model_id, layer, {Q.r6(f'CASE WHEN sqrt(sum(pow(gacc + g, 2))) > 0 THEN {Q.d(NET_L2.rate)} / sqrt(sum(pow(gacc + g, 2))) END')} "
    f"AS ada_rate FROM {_mg_sql(NET_L2)[1]} GROUP BY model_id, layer"))
def q_adaptive_rate(spark, sf):
    g, m, _ = _mg(spark, sf, NET_L2)
    return S.adaptive_rate(S.accumulate_gradients(g), m).select(
        "model_id", "layer", r6(F.col("ada_rate")).alias("ada_rate"))


def _step_sql(net: Q.Net, optimizer: str, mu: float, look=False) -> str:
    ctes, mg = _mg_sql(net, look_mu=mu if look else None)
    sc, new = Q.step_ctes(net, mg, "s_", optimizer, mu, n_train="(SELECT count(*) FROM ex)")
    return _keys_sql(ctes + sc, new, "theta", "velocity", "gacc")


@query("step_vanilla", lambda: _step_sql(NET_LV, "vanilla", 0.0))
def q_step_vanilla(spark, sf):
    g, m, ex = _mg(spark, sf, NET_LV)
    n = ex.count()
    return _keys_out(S.step_vanilla(g, m, n), "theta", "velocity", "gacc")


@query("step_momentum", lambda: _step_sql(NET_L2, "momentum", MU0))
def q_step_momentum(spark, sf):
    g, m, _ = _mg(spark, sf, NET_L2)
    return _keys_out(S.step_momentum(g, m, MU0), "theta", "velocity", "gacc")


@query("step_momentum_ada", lambda: _step_sql(NET_LA, "momentum", MU0))
def q_step_momentum_ada(spark, sf):
    g, m, _ = _mg(spark, sf, NET_LA)
    return _keys_out(S.step_momentum(g, m, MU0), "theta", "velocity", "gacc")


@query("lookahead", lambda: _sql(_trained_ctes((NET_L2, "L")),
       "SELECT model_id, layer, row, col, " + Q.r6(f"theta + {Q.d(MU0)} * velocity") + " AS theta FROM P"))
def q_lookahead(spark, sf):
    return _keys_out(S.lookahead(_trained(spark, sf, (NET_L2, "L")), MU0), "theta")


@query("step_nesterov", lambda: _step_sql(NET_L2, "momentum", MU0, look=True))
def q_step_nesterov(spark, sf):
    g, m, _ = _mg(spark, sf, NET_L2, look_mu=MU0)
    return _keys_out(S.step_momentum(g, m, MU0), "theta", "velocity", "gacc")


# ---------------------------------------------------------------------------
# 2.9 diagnostics
# ---------------------------------------------------------------------------

@query("perturb", lambda: _sql(
    _mg_sql(NET_L2)[0],
    f"SELECT model_id, layer, row, col, {Q.r6(f'theta - {Q.d(1e-4)} * g')} AS theta FROM {_mg_sql(NET_L2)[1]}"))
def q_perturb(spark, sf):
    g, m, _ = _mg(spark, sf, NET_L2)
    w = E.feature_width_value(T.fixture(spark, sf, "L"))
    p = with_state(P.init_params(m, w))
    return _keys_out(S.perturb(p, g), "theta")
