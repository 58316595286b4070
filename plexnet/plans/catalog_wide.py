"""Registered queries of wide sparse examples, models in tiles, sums merged in
two levels and text files with numbered lines, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexnet.operators import curvature as CV
from plexnet.operators import params as P
from plexnet.operators import sharded as SH
from plexnet.operators import sparse as SP
from plexnet.operators.passes import gradient_sums
from plexnet.plans import sqltext as Q
from plexnet.plans.catalog import (NET_E, NET_L2, TWO, _THETA_SQL, _ex_cte, _forward_sql, _gsum_out, _gsum_query_sql, _models, _params, _params_cte, _sql, _trained,
                                   _trained_ctes, query, r6)
from plexnet.plans.catalog_fit import NET_V, _state_out
from plexnet.session import scratch_path
from plexnet.sources import sparse as SS
from plexnet.sources import tables as T

# ---------------------------------------------------------------------------
# wide sparse examples: hashed words of whole documents
# ---------------------------------------------------------------------------
WIDTH = 1 << 18
NET_W = Q.Net("W4", [WIDTH, 4, 1], activation="tanh", init="deeplearning", fan="fan_out")

_WORDS_SQL = r"""words AS MATERIALIZED (SELECT doc_id AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 262144 AS i FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+')) AS w FROM documents))"""
_NONZERO_SQL = "nz AS MATERIALIZED (SELECT id, i, count(*) / sum(count(*)) OVER (PARTITION BY id) AS v FROM words GROUP BY id, i)"


def _labelled_sql(where: str = "TRUE") -> str:
    return ("ex AS MATERIALIZED (SELECT d.doc_id AS id, CAST(l.quality AS DOUBLE) AS label FROM documents d "
            f"LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE {where})")


def _input_sql(pre: str) -> str:
    return (f"{pre}a0 AS MATERIALIZED (SELECT nz.id, CAST(i + 1 AS INTEGER) AS i, v AS a FROM nz JOIN ex ON ex.id = nz.id "
            f"UNION ALL SELECT id, 0 AS i, {Q.d(1.0)} AS a FROM ex)")


def _touched_sql() -> str:
    """Weights of the rows that the documents touch, and of the layers above."""
    return (f"P AS MATERIALIZED (SELECT model_id, layer, row, col, {Q.init_theta(NET_W)} AS theta FROM ("
            f"SELECT {Q.q(NET_W.model_id)} AS model_id, 0 AS layer, r.i AS row, CAST(c.range AS INTEGER) AS col "
            f"FROM (SELECT DISTINCT CAST(i + 1 AS INTEGER) AS i FROM nz UNION SELECT 0) r, range(0, {NET_W.sizes[1]}) c "
            f"UNION ALL SELECT * FROM ({Q.weight_grid(NET_W)}) wg WHERE layer > 0) t)")


def _wide_sql(pre: str, where: str, backward: bool) -> tuple[list[str], str]:
    ctes, out = (Q.backprop_ctes if backward else Q.forward_ctes)(NET_W, "ex", "P", pre)
    return [_WORDS_SQL, _NONZERO_SQL, _labelled_sql(where), _touched_sql(), _input_sql(pre), *ctes[1:]], out


def _wide(spark, sf, labelled: bool):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    if labelled:
        labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
        docs = docs.join(labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")), "id")
    keep = ("id", "label") if labelled else ("id",)
    m, p = _params(spark, NET_W)
    return SS.hashed_words(docs, WIDTH, keep=keep), p, m


def _wide_score_sql() -> str:
    ctes, out = _wide_sql("f_", "TRUE", False)
    return _sql(ctes, f"SELECT id, {Q.r6('p')} AS p FROM {out}")


@query("sparse_score", _wide_score_sql)
def q_sparse_score(spark, sf):
    ex, p, m = _wide(spark, sf, False)
    return SP.score(ex, p, m, WIDTH).select("id", r6(F.element_at("p", 1)).alias("p"))


@query("sparse_linear_layer", lambda: _sql(_wide_sql("f_", "TRUE", False)[0][:6], f"SELECT id, col AS k, {Q.r6('z')} AS z FROM f_z1"))
def q_sparse_linear_layer(spark, sf):
    ex, p, m = _wide(spark, sf, False)
    z = SP.score(ex, p, m, WIDTH, what="z1")
    return z.select("id", F.posexplode("p").alias("k", "z")).select("id", "k", r6(F.col("z")).alias("z"))


def _wide_gradient_sql() -> str:
    ctes, gs = _wide_sql("b_", "l.quality IS NOT NULL", True)
    return _sql(ctes, f"SELECT {Q.q(NET_W.model_id)} AS model_id, layer, row, col, {Q.r6('g', 4)} AS g FROM {gs}")


@query("sparse_gradient_sums", _wide_gradient_sql)
def q_sparse_gradient_sums(spark, sf):
    ex, p, m = _wide(spark, sf, True)
    return _gsum_out(SP.gradient_sums(ex, p, m, WIDTH))


def _wide_evaluate_sql() -> str:
    ctes, out = _wide_sql("f_", "l.quality IS NOT NULL", False)
    return _sql(ctes, f"SELECT count(*) AS n, {Q.r6('avg(c.cost)')} AS cost, {Q.r6('avg(CASE WHEN q.pred = ex.label THEN 1.0 ELSE 0.0 END)')} AS accuracy "
                      f"FROM ({Q.row_cost(NET_W, out, 'ex')}) c JOIN ({Q.predict_expr(NET_W, out)}) q ON q.id = c.id JOIN ex ON ex.id = c.id")


@query("sparse_evaluate", _wide_evaluate_sql)
def q_sparse_evaluate(spark, sf):
    ex, p, m = _wide(spark, sf, True)
    return SP.evaluate(ex, p, m, WIDTH).select("n", r6(F.col("cost")).alias("cost"), r6(F.col("accuracy")).alias("accuracy"))


@query("sparse_libsvm_scan", lambda: _sql([_WORDS_SQL, _NONZERO_SQL, _labelled_sql("l.quality IS NOT NULL")],
       f"SELECT label, i, count(*) AS n, {Q.r6('sum(v)')} AS v FROM nz JOIN ex ON ex.id = nz.id GROUP BY label, i"))
def q_sparse_libsvm_scan(spark, sf):
    """Written as LibSVM text and read back; the label and the entries of all rows."""
    path = scratch_path(spark, "sparse-libsvm")
    SS.write_libsvm_sparse(_wide(spark, sf, True)[0], path)
    back = SS.read_libsvm_sparse(spark, path)
    each = back.select("label", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return each.groupBy("label", F.col("e.indices").cast("bigint").alias("i")).agg(F.count("*").alias("n"), r6(F.sum("e.values")).alias("v"))


# ---------------------------------------------------------------------------
# a model in tiles (2 x 2 here, so that every layer has several)
# ---------------------------------------------------------------------------
SMALL_TILE = 2


def _sharded(spark, sf, net, fx, tile):
    m, p = _params(spark, net)
    return SH.ShardedPass(T.fixture(spark, sf, fx), p, m, tile=tile)


@query("sharded_score", lambda: _forward_sql(NET_E, "E", lambda o: f"SELECT id, col AS k, {Q.r6('p')} AS p FROM {o}"))
def q_sharded_score(spark, sf):
    s = _sharded(spark, sf, NET_E, "E", 8).score()
    return s.select("id", F.posexplode("p").alias("k", "p")).select("id", "k", r6(F.col("p")).alias("p"))


@query("sharded_gradient_sums", lambda: _gsum_query_sql(NET_L2, "L"))
def q_sharded_gradient_sums(spark, sf):
    return _gsum_out(_sharded(spark, sf, NET_L2, "L", SMALL_TILE).gradient_sums())


@query("sharded_evaluate", lambda: _forward_sql(
    NET_L2, "L", lambda o: f"SELECT count(*) AS n, {Q.r6('avg(c.cost)')} AS cost, {Q.r6('avg(CASE WHEN q.pred = ex.label THEN 1.0 ELSE 0.0 END)')} AS accuracy "
    f"FROM ({Q.row_cost(NET_L2, o, 'ex')}) c JOIN ({Q.predict_expr(NET_L2, o)}) q ON q.id = c.id JOIN ex ON ex.id = c.id"))
def q_sharded_evaluate(spark, sf):
    e = _sharded(spark, sf, NET_L2, "L", SMALL_TILE).evaluate()
    return e.select("n", r6(F.col("cost")).alias("cost"), r6(F.col("accuracy")).alias("accuracy"))


# ---------------------------------------------------------------------------
# sums merged in two levels; numbered lines
# ---------------------------------------------------------------------------
@query("gradient_sums_two_level", lambda: _gsum_query_sql(NET_L2, "L"))
def q_gradient_sums_two_level(spark, sf):
    m, p = _params(spark, NET_L2)
    ex = T.fixture(spark, sf, "L").repartition(64, "id")
    return _gsum_out(gradient_sums(ex, p, m, merge_groups=8))


@query("numbered_lines", lambda: _sql([_ex_cte("L")], f"SELECT {Q.r6('label')} AS label, count(*) AS n, 0 AS gaps FROM ex GROUP BY label"))
def q_numbered_lines(spark, sf):
    """Fixture L as LibSVM text, read in splits of 64 kB: every line has its own number, without gaps."""
    from plexnet.sources.libsvm import write_libsvm
    from plexnet.sources.lines import numbered_lines
    path = scratch_path(spark, "lines")
    write_libsvm(T.fixture(spark, sf, "L"), path)
    lines = numbered_lines(spark, path)
    per_file = lines.groupBy("file").agg((F.max("line") + 1 - F.count("*")).alias("gap"), (F.count("*") - F.count_distinct("line")).alias("twice"))
    gaps = per_file.agg(F.sum(F.abs("gap") + F.col("twice")).cast("int").alias("gaps"))
    label = r6(F.substring_index("value", " ", 1).cast("double")).alias("label")
    return lines.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(gaps))


# ---------------------------------------------------------------------------
# exact Hessian-vector product; gradient check over all rows
# ---------------------------------------------------------------------------
def _hv_sql(net: Q.Net, fx: str) -> str:
    """The backward pass and its derivative along the velocity column."""
    ctes = [_ex_cte(fx), _params_cte(net, state=True)]
    bc, _ = Q.backprop_ctes(net, "ex", "P", "h_")
    ctes += bc
    last = net.n_layers
    on = f"p.model_id = {Q.q(net.model_id)} AND p.layer = {{}}"
    for k in range(last):  # z' = a'.W + a.V
        terms = f"SELECT a.id, p.col, a.a * p.velocity AS t FROM h_a{k} a JOIN P p ON {on.format(k)} AND p.row = a.i"
        if k:
            terms += f" UNION ALL SELECT a.id, p.col, a.a * p.theta FROM h_ra{k} a JOIN P p ON {on.format(k)} AND p.row = a.i"
        ctes.append(f"h_rz{k + 1} AS MATERIALIZED (SELECT id, col, sum(t) AS rz FROM ({terms}) GROUP BY id, col)")
        if k + 1 < last:
            ctes.append(f"h_ra{k + 1} AS MATERIALIZED (SELECT z.id, z.col + 1 AS i, {Q.act(net.activation, 'z.z', True)} * r.rz AS a "
                        f"FROM h_z{k + 1} z JOIN h_rz{k + 1} r USING (id, col))")
    ctes.append(f"h_re{last} AS MATERIALIZED (SELECT o.id, o.col, o.p * ({Q.d(1.0)} - o.p) * r.rz AS e FROM h_out o JOIN h_rz{last} r USING (id, col))")
    grads = []
    for k in range(last - 1, -1, -1):
        terms = f"SELECT a.i AS row, e.col, a.a * e.e AS t FROM h_a{k} a JOIN h_re{k + 1} e USING (id)"
        if k:
            terms += f" UNION ALL SELECT a.i AS row, e.col, a.a * e.e FROM h_ra{k} a JOIN h_e{k + 1} e USING (id)"
        grads.append(f"SELECT CAST({k} AS INTEGER) AS layer, row, col, sum(t) AS t FROM ({terms}) GROUP BY row, col")
        if k:
            back = ("SELECT e.id, p.row - 1 AS col, sum(p.theta * e.e) AS s FROM {} e JOIN P p ON " + on.format(k) + " AND p.col = e.col AND p.row > 0 GROUP BY e.id, p.row")
            along = back.replace("p.theta", "p.velocity")
            curve = f"({Q.d(-2.0)} * tanh(z.z) * ({Q.d(1.0)} - tanh(z.z) * tanh(z.z)))"
            ctes.append(f"h_re{k} AS MATERIALIZED (SELECT z.id, z.col, (u.s + v.s) * {Q.act(net.activation, 'z.z', True)} + w.s * {curve} * r.rz AS e FROM h_z{k} z "
                        f"JOIN ({back.format(f'h_re{k + 1}')}) u USING (id, col) JOIN ({along.format(f'h_e{k + 1}')}) v USING (id, col) "
                        f"JOIN ({back.format(f'h_e{k + 1}')}) w USING (id, col) JOIN h_rz{k} r USING (id, col))")
    hv = f"g.t / (SELECT count(*) FROM ex) + CASE WHEN p.row > 0 THEN {Q.d(net.lmbda)} * p.velocity ELSE 0 END"
    return _sql(ctes, f"SELECT p.model_id, p.layer, p.row, p.col, {Q.r6(hv)} AS hv FROM P p JOIN ({' UNION ALL '.join(grads)}) g "
                      "ON g.layer = p.layer AND g.row = p.row AND g.col = p.col")


@query("hessian_vector", lambda: _hv_sql(NET_L2, "L"))
def q_hessian_vector(spark, sf):
    m, p = _params(spark, NET_L2, state=True)
    hv = CV.hessian_vector(T.fixture(spark, sf, "L"), p, m, p.select(*P.KEYS, "velocity"), "velocity")
    return hv.select(*P.KEYS, r6(F.col("hv")).alias("hv"))


NET_G = Q.Net("G2", [4, 2, 1], activation="tanh", init="deeplearning", fan="fan_out")


def _check_sql(net: Q.Net) -> str:
    """Two forward passes over all rows per weight: every variant is a model of its own."""
    bc, gs = Q.backprop_ctes(net, "ex", "P", "b_")
    eps = Q.d(CV.CHECK_EPS)
    ctes = [_ex_cte("L"), _params_cte(net), *bc,
            "v AS MATERIALIZED (SELECT w.layer AS wl, w.row AS wr, w.col AS wc, s.sign, p.layer, p.row, p.col, p.theta + CASE WHEN p.layer = w.layer "
            f"AND p.row = w.row AND p.col = w.col THEN s.sign * {eps} ELSE 0 END AS theta FROM P w, P p, (SELECT unnest([1, -1]) AS sign) s)",
            "v1 AS MATERIALIZED (SELECT a.id, v.wl, v.wr, v.wc, v.sign, v.col, tanh(sum(a.a * v.theta)) AS a FROM b_a0 a JOIN v ON v.layer = 0 AND v.row = a.i "
            "GROUP BY ALL)",
            f"v2 AS MATERIALIZED (SELECT id, wl, wr, wc, sign, {Q.act('sigmoid', 'sum(t)')} AS p FROM ("
            "SELECT a.id, a.wl, a.wr, a.wc, a.sign, a.a * v.theta AS t FROM v1 a JOIN v ON v.layer = 1 AND v.row = a.col + 1 AND v.wl = a.wl AND v.wr = a.wr AND v.wc = a.wc AND v.sign = a.sign "
            "UNION ALL SELECT ex.id, v.wl, v.wr, v.wc, v.sign, v.theta FROM ex, v WHERE v.layer = 1 AND v.row = 0) GROUP BY id, wl, wr, wc, sign)"]
    pc = Q.clip_prob("v2.p")
    cost = f"-(ex.label * ln({pc}) + ({Q.d(1.0)} - ex.label) * ln({Q.d(1.0)} - {pc}))"
    numeric = (f"(SELECT wl AS layer, wr AS row, wc AS col, sum(sign * {cost}) / (2 * {eps}) / (SELECT count(*) FROM ex) AS n FROM v2 JOIN ex USING (id) GROUP BY wl, wr, wc)")
    analytic = "g.g / (SELECT count(*) FROM ex)"
    return _sql(ctes, f"SELECT {Q.q(net.model_id)} AS model_id, n.layer, n.row, n.col, {Q.r6(analytic)} AS analytic, {Q.r6('n.n', 5)} AS numeric, true AS agrees "
                      f"FROM {numeric} n JOIN {gs} g ON g.layer = n.layer AND g.row = n.row AND g.col = n.col")


@query("gradient_check_all", lambda: _check_sql(NET_G))
def q_gradient_check_all(spark, sf):
    m, p = _params(spark, NET_G)
    c = CV.check_gradients(T.fixture(spark, sf, "L"), p, m)
    return c.select(*P.KEYS, r6(F.col("analytic")).alias("analytic"), r6(F.col("numeric"), 5).alias("numeric"), (F.col("rel_error") < 1e-3).alias("agrees"))


# ---------------------------------------------------------------------------
# flat weights in pieces; a stream of several micro-batches with a restart
# ---------------------------------------------------------------------------
PIECE = 100


@query("flatten_chunks", lambda: _sql(_trained_ctes(*TWO), f"SELECT model_id, pos // {PIECE} AS chunk, list({Q.r6('theta')} ORDER BY pos) AS flat FROM ("
       "SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY layer, row, col) - 1 AS pos FROM P) t GROUP BY model_id, chunk"))
def q_flatten_chunks(spark, sf):
    f = P.flatten_chunks(_trained(spark, sf, *TWO), PIECE)
    return f.select("model_id", "chunk", F.transform("flat", lambda v: r6(v)).alias("flat"))


@query("unflatten_chunks", lambda: _sql(_trained_ctes(*TWO), _THETA_SQL))
def q_unflatten_chunks(spark, sf):
    trained = _trained(spark, sf, *TWO)
    models = {n.model_id: n for n, _ in TWO}
    back = None
    for name, net in models.items():
        one = P.unflatten_chunks(P.flatten_chunks(trained.where(F.col("model_id") == name), PIECE), _models(spark, net), net.n_features, PIECE)
        back = one if back is None else back.unionAll(one)
    return back.select(*P.KEYS, r6(F.col("theta")).alias("theta"))


BATCHES = 4


def _stream_sql() -> str:
    """Four steps in a row, each over the rows of one micro-batch."""
    ctes = [f"all_ex AS MATERIALIZED ({Q.fixture('V')})", f"s0 AS MATERIALIZED ({Q.init_params(NET_V)})"]
    last = "s0"
    for t in range(BATCHES):
        ctes.append(f"ex{t} AS MATERIALIZED (SELECT * FROM all_ex WHERE id % {BATCHES} = {t})")
        bc, gs = Q.backprop_ctes(NET_V, f"ex{t}", last, f"s{t}_")
        mc, mg = Q.mean_gradient_ctes(NET_V, last, gs, f"(SELECT count(*) FROM ex{t})", f"s{t}_")
        sc, last = Q.step_ctes(NET_V, mg, f"s{t}_", "momentum", Q.momentum_mu(t, NET_V.itert, NET_V.maxmu))
        ctes += bc + mc + sc
    return Q.with_clause(ctes) + f"SELECT model_id, layer, row, col, {Q.r6('theta')} AS theta, {Q.r6('velocity')} AS velocity, {Q.r6('gacc')} AS gacc FROM {last}"


@query("fit_stream_batches", _stream_sql)
def q_fit_stream_batches(spark, sf):
    """The events arrive as four files, each a micro-batch; the query is stopped after two and started again."""
    from plexnet.streaming.fit_stream import fit_stream, latest_params
    models, base = _models(spark, NET_V), scratch_path(spark, "stream")
    params = P.init_params(models, 2)
    events = spark.read.parquet(f"{sf}/events.parquet")
    run_dir = f"{base}/run"
    for t in range(BATCHES):
        events.where(F.col("event_id") % BATCHES == t).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if t % 2:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            fit_stream(T.events_examples(stream), models, params, run_dir)
    return _state_out(latest_params(spark, run_dir))
