"""DuckDB SQL text for the correctness oracles.

Written from the formulas (never from our Spark plans): the fixtures, md5
draws, a relational forward pass (activations joined with the weight table,
summed per unit), backpropagation as joins and sums, and the optimiser rules.
Networks are unrolled per layer for a known architecture. Every value that is
compared is rounded to 6 digits and has 0.0 added (turns -0.0 into 0.0).
"""

from __future__ import annotations

import math

from plexnet.functions.random import TWO_POW_48

# ---------------------------------------------------------------------------
# small helpers
# ---------------------------------------------------------------------------


def d(x: float) -> str:
    """A DOUBLE literal (bare decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0.0 AS DOUBLE))"


def md5_hex(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def md5_uniform(*parts: str) -> str:
    return f"(CAST(('0x' || substr({md5_hex(*parts)}, 1, 12)) AS BIGINT) / {d(TWO_POW_48)})"


def md5_bits(*parts: str) -> str:
    return f"CAST(('0x' || substr({md5_hex(*parts)}, 1, 12)) AS BIGINT)"


def md5_normal(*parts: str) -> str:
    u1 = f"({d(1.0)} - {md5_uniform(*parts, repr('a'))})"
    u2 = md5_uniform(*parts, repr("b"))
    return f"(sqrt({d(-2.0)} * ln({u1})) * cos({d(2.0 * math.pi)} * {u2}))"


def md5_id(*parts: str) -> str:
    return f"CAST(('0x' || substr({md5_hex(*parts)}, 1, 15)) AS BIGINT)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# activations (z is an SQL expression)
# ---------------------------------------------------------------------------

def act(name: str, z: str, derivative: bool = False) -> str:
    if name == "sigmoid":
        s = f"({d(1.0)} / ({d(1.0)} + exp(-({z}))))"
        return f"({s} * ({d(1.0)} - {s}))" if derivative else s
    if name == "tanh":
        return f"({d(1.0)} - pow(tanh({z}), 2))" if derivative else f"tanh({z})"
    if name == "ReLU":
        return (f"(CASE WHEN ({z}) >= 0 THEN {d(1.0)} ELSE {d(0.0)} END)" if derivative
                else f"(CASE WHEN ({z}) >= 0 THEN ({z}) ELSE {d(0.0)} END)")
    if name == "LReLU":
        return (f"(CASE WHEN ({z}) >= 0 THEN {d(1.0)} ELSE {d(0.01)} END)" if derivative
                else f"(CASE WHEN ({z}) >= 0 THEN ({z}) ELSE {d(0.01)} * ({z}) END)")
    if name == "ELU":
        neg = f"({d(0.05)} * (exp({z}) - {d(1.0)}))"
        return (f"(CASE WHEN ({z}) >= 0 THEN {d(1.0)} ELSE {neg} + {d(0.05)} END)" if derivative
                else f"(CASE WHEN ({z}) >= 0 THEN ({z}) ELSE {neg} END)")
    raise ValueError(name)


def clip_prob(p: str) -> str:
    return f"greatest(least({p}, {d(1.0 - 1e-14)}), {d(1e-14)})"


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------

def split_expr(id_expr: str = "id", frac: float = 0.2, seed=None) -> str:
    parts = [id_expr, q("split")] + ([q(str(seed))] if seed is not None else [])
    return f"(CASE WHEN {md5_uniform(*parts)} < {d(frac)} THEN 'val' ELSE 'train' END)"


LINEITEM_ID = md5_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "CAST(round(l_extendedprice * 100) AS BIGINT)",
                     "strftime(l_shipdate, '%Y%m%d')")


def fixture(name: str) -> str:
    """SELECT text of the fixture (id, features, label, split)."""
    if name in ("L", "LM"):
        if name == "L":
            lab = (f"CAST(CASE WHEN l_extendedprice * ({d(1.0)} - l_discount) > {d(50000.0)} "
                   f"THEN 1 ELSE 0 END AS DOUBLE)")
        else:
            lab = ("CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END "
                   "AS DOUBLE)")
        inner = (f"SELECT {LINEITEM_ID} AS id, "
                 f"[l_quantity / {d(50.0)}, l_extendedprice / {d(105000.0)}, "
                 f"l_discount * {d(10.0)}, l_tax * {d(12.5)}] AS features, {lab} AS label "
                 f"FROM lineitem")
    elif name in ("E", "E2", "ES"):
        lab = {"E": "CAST(label AS DOUBLE)",
               "E2": "CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS DOUBLE)",
               "ES": ("CAST(CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0 "
                      "THEN 1 ELSE 0 END AS DOUBLE)")}[name]
        inner = (f"SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, {lab} AS label "
                 f"FROM embeddings")
    elif name in ("D", "DT"):
        def share(pat):
            return (f"CAST(length(text) - length(regexp_replace(text, '{pat}', '', 'g')) AS DOUBLE)"
                    f" / CAST(n_chars AS DOUBLE)")
        feats = (f"[ln(CAST(n_chars AS DOUBLE)), {share('[0-9]')}, {share(chr(10))}, "
                 f"{share('[!-/:-@\\[-`{-~]')}, {share('[ \\t\\n\\r]')}]")
        lab = "quality" if name == "D" else "toxic"
        inner = (f"SELECT d.doc_id AS id, {feats} AS features, CAST({lab} AS DOUBLE) AS label "
                 f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    elif name == "V":
        inner = (f"SELECT event_id AS id, [ln({d(1.0)} + value), hour(ts) / {d(24.0)}] AS features, "
                 f"CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS label "
                 f"FROM events")
    else:
        raise ValueError(name)
    return f"SELECT id, features, label, {split_expr('id')} AS split FROM ({inner}) fx"


def z_values() -> str:
    return f"SELECT {LINEITEM_ID} AS id, (l_quantity - {d(25.0)}) / {d(5.0)} AS z FROM lineitem"


# ---------------------------------------------------------------------------
# networks
# ---------------------------------------------------------------------------

class Net:
    """A network known at query build time (mirrors one row of ``models``)."""

    def __init__(self, model_id: str, sizes: list[int], activation="sigmoid", init="xnormal",
                 fan="fan_in", seed=4237842, rate=0.1, lmbda=1e-10, optimizer="momentum",
                 learning_mod="", maxmu=0.95, itert=1.0, loss="log"):
        self.model_id, self.sizes = model_id, list(sizes)
        self.activation, self.init, self.fan, self.seed = activation, init, fan, seed
        self.rate, self.lmbda, self.optimizer, self.learning_mod = rate, lmbda, optimizer, learning_mod
        self.maxmu, self.itert, self.loss = maxmu, itert, loss

    @property
    def n_features(self) -> int:
        return self.sizes[0]

    @property
    def outputs(self) -> int:
        return self.sizes[-1]

    @property
    def multi(self) -> bool:
        return self.outputs > 1

    @property
    def n_layers(self) -> int:
        return len(self.sizes) - 1

    def settings(self) -> dict:
        return dict(model_id=self.model_id, hidden=",".join(str(h) for h in self.sizes[1:-1]),
                    outputs=self.outputs, activation=self.activation, init=self.init, fan=self.fan,
                    seed=self.seed, rate=self.rate, lmbda=self.lmbda, optimizer=self.optimizer,
                    learning_mod=self.learning_mod, maxmu=self.maxmu, itert=self.itert, loss=self.loss)


def weight_grid(net: Net) -> str:
    """(model_id, layer, row, col) of the network, as INTEGER columns."""
    parts = []
    for l in range(net.n_layers):
        parts.append(
            f"SELECT {q(net.model_id)} AS model_id, CAST({l} AS INTEGER) AS layer, "
            f"CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col "
            f"FROM range(0, {net.sizes[l] + 1}) r, range(0, {net.sizes[l + 1]}) c")
    return " UNION ALL ".join(parts)


def init_theta(net: Net) -> str:
    f, o = float(net.n_features), float(net.outputs)
    key = (q(str(net.seed)), "layer", "row", "col")
    if net.init == "xuniform":
        e = math.sqrt(6.0 / (f + o))
        draw = f"({md5_uniform(*key)} * {d(2.0)} * {d(e)} - {d(e)})"
    elif net.init == "xnormal":
        draw = f"({md5_normal(*key)} * {d(math.sqrt(3.0 / (f + o)))})"
    else:
        n = {"fan_in": f, "fan_out": o, "fan_avg": (f + o) / 2.0}[net.fan]
        draw = f"({md5_normal(*key)} * sqrt({d(1.0)} / {d(n)}))"
    return f"(CASE WHEN row = 0 THEN {d(0.0)} ELSE {draw} END)"


def init_params(net: Net, with_state: bool = False) -> str:
    """SELECT of (model_id, layer, row, col, theta, velocity, gacc)."""
    if with_state:
        key = ("model_id", "layer", "row", "col")
        vel = f"{d(0.01)} * {md5_normal(*key, q('v'))}"
        gacc = f"{d(0.1)} * {md5_normal(*key, q('g'))}"
    else:
        vel, gacc = d(0.0), d(0.0)
    return (f"SELECT model_id, layer, row, col, {init_theta(net)} AS theta, {vel} AS velocity, "
            f"{gacc} AS gacc FROM ({weight_grid(net)}) wg")


def forward_ctes(net: Net, ex: str, P: str, pre: str, rows: str = "TRUE") -> tuple[list[str], str]:
    """CTEs of a forward pass over table ``ex`` (id, features, label) with
    parameter table ``P``. Returns (ctes, name of output table (id, col, z, p))."""
    ctes = [
        f"{pre}a0 AS MATERIALIZED (SELECT id, CAST(generate_subscripts(features, 1) AS INTEGER) AS i, "
        f"unnest(features) AS a FROM {ex} WHERE {rows} "
        f"UNION ALL SELECT id, 0 AS i, {d(1.0)} AS a FROM {ex} WHERE {rows})"]
    for l in range(net.n_layers):
        ctes.append(
            f"{pre}z{l + 1} AS MATERIALIZED (SELECT a.id, p.col, sum(a.a * p.theta) AS z "
            f"FROM {pre}a{l} a JOIN {P} p ON p.model_id = {q(net.model_id)} AND p.layer = {l} "
            f"AND p.row = a.i GROUP BY a.id, p.col)")
        if l < net.n_layers - 1:
            ctes.append(
                f"{pre}a{l + 1} AS MATERIALIZED (SELECT id, col + 1 AS i, {act(net.activation, 'z')} AS a "
                f"FROM {pre}z{l + 1} UNION ALL SELECT DISTINCT id, 0 AS i, {d(1.0)} AS a FROM {pre}z{l + 1})")
    zl = f"{pre}z{net.n_layers}"
    if net.multi:
        ctes.append(
            f"{pre}out AS MATERIALIZED (SELECT id, col, z, exp(z - mz) / sum(exp(z - mz)) OVER "
            f"(PARTITION BY id) AS p FROM (SELECT id, col, z, max(z) OVER (PARTITION BY id) AS mz "
            f"FROM {zl}) sm)")
    else:
        ctes.append(f"{pre}out AS MATERIALIZED (SELECT id, col, z, {act('sigmoid', 'z')} AS p FROM {zl})")
    return ctes, f"{pre}out"


def row_cost(net: Net, out: str, ex: str) -> str:
    """SELECT (id, cost) per example row."""
    if net.multi:
        # log-softmax of the true class: z[class] - logsumexp(z)
        return (f"SELECT o.id, -(o.z - (m.mz + ln(m.se))) AS cost FROM {out} o JOIN "
                f"(SELECT id, max(z) AS mz, sum(exp(z - mz2)) AS se FROM "
                f"(SELECT id, z, max(z) OVER (PARTITION BY id) AS mz2 FROM {out}) GROUP BY id) m "
                f"ON o.id = m.id JOIN {ex} e ON e.id = o.id WHERE o.col = CAST(e.label AS INTEGER)")
    pc = clip_prob("o.p")
    if net.loss == "squared":
        c = f"pow(e.label - o.p, 2) / {d(2.0)}"
    else:
        c = f"-(e.label * ln({pc}) + ({d(1.0)} - e.label) * ln({d(1.0)} - {pc}))"
    return f"SELECT o.id, {c} AS cost FROM {out} o JOIN {ex} e ON e.id = o.id WHERE o.col = 0"


def predict_expr(net: Net, out: str) -> str:
    """SELECT (id, pred) per row."""
    if net.multi:
        return f"SELECT id, CAST(arg_min(col, -p) AS DOUBLE) AS pred FROM {out} GROUP BY id"
    return f"SELECT id, CASE WHEN p >= {d(0.5)} THEN {d(1.0)} ELSE {d(0.0)} END AS pred FROM {out}"


def backprop_ctes(net: Net, ex: str, P: str, pre: str, rows: str = "TRUE") -> tuple[list[str], str]:
    """Forward pass on the rows where ``rows`` holds, then backpropagation.
    Returns (ctes, name of (layer, row, col, g) gradient-sum table)."""
    ctes, out = forward_ctes(net, ex, P, pre, rows)
    L = net.n_layers
    if net.multi:
        ctes.append(
            f"{pre}e{L} AS MATERIALIZED (SELECT o.id, o.col, o.p - CASE WHEN o.col = CAST(x.label AS INTEGER) "
            f"THEN {d(1.0)} ELSE {d(0.0)} END AS e FROM {out} o JOIN {ex} x ON x.id = o.id)")
    elif net.loss == "squared":
        ctes.append(
            f"{pre}e{L} AS MATERIALIZED (SELECT o.id, o.col, (o.p - x.label) * o.p * ({d(1.0)} - o.p) AS e "
            f"FROM {out} o JOIN {ex} x ON x.id = o.id)")
    else:
        ctes.append(
            f"{pre}e{L} AS MATERIALIZED (SELECT o.id, o.col, o.p - x.label AS e FROM {out} o "
            f"JOIN {ex} x ON x.id = o.id)")
    grads = []
    for l in range(L - 1, -1, -1):
        # gradient of layer l: sum over rows of a_l (with bias i = 0) times e_{l+1}
        ctes.append(
            f"{pre}g{l} AS MATERIALIZED (SELECT CAST({l} AS INTEGER) AS layer, a.i AS row, e.col, "
            f"sum(a.a * e.e) AS g FROM {pre}a{l} a JOIN {pre}e{l + 1} e ON a.id = e.id "
            f"GROUP BY a.i, e.col)")
        grads.append(f"SELECT * FROM {pre}g{l}")
        if l > 0:
            ctes.append(
                f"{pre}e{l} AS MATERIALIZED (SELECT s.id, s.j AS col, s.s * {act(net.activation, 'z.z', True)} AS e "
                f"FROM (SELECT e.id, p.row - 1 AS j, sum(p.theta * e.e) AS s FROM {pre}e{l + 1} e "
                f"JOIN {P} p ON p.model_id = {q(net.model_id)} AND p.layer = {l} AND p.col = e.col "
                f"AND p.row > 0 GROUP BY e.id, p.row) s JOIN {pre}z{l} z ON z.id = s.id AND z.col = s.j)")
    ctes.append(f"{pre}gs AS MATERIALIZED ({' UNION ALL '.join(grads)})")
    return ctes, f"{pre}gs"


def mean_gradient_ctes(net: Net, P: str, gs: str, m: str, pre: str, add_velocity: bool = False):
    """(model_id, layer, row, col, theta, velocity, gacc, g) with g = sum/m + lambda*theta."""
    vel = " + p.velocity" if add_velocity else ""
    return [
        f"{pre}mg AS MATERIALIZED (SELECT p.model_id, p.layer, p.row, p.col, p.theta, p.velocity, p.gacc, "
        f"CASE WHEN {m} > 0 THEN coalesce(g.g, {d(0.0)}) / {m}{vel} + CASE WHEN p.row > 0 THEN "
        f"{d(net.lmbda)} * p.theta ELSE {d(0.0)} END END AS g "
        f"FROM {P} p LEFT JOIN {gs} g ON g.layer = p.layer AND g.row = p.row AND g.col = p.col "
        f"WHERE p.model_id = {q(net.model_id)})"], f"{pre}mg"


def step_ctes(net: Net, G: str, pre: str, optimizer: str, mu: float, n_train: str = "NULL",
              learning_mod: str | None = None):
    """One update from a mean-gradient table G (with theta, velocity, gacc, g).
    Returns (ctes, table of model_id, layer, row, col, theta, velocity, gacc)."""
    lm = net.learning_mod if learning_mod is None else learning_mod
    ctes = [
        f"{pre}acc AS MATERIALIZED (SELECT *, gacc + coalesce(g, {d(0.0)}) AS gacc2 FROM {G})",
        f"{pre}nrm AS MATERIALIZED (SELECT layer, max(cs) AS l1, sqrt(sum(asq)) AS an FROM "
        f"(SELECT layer, col, sum(abs(g)) AS cs, sum(gacc2 * gacc2) AS asq FROM {pre}acc "
        f"GROUP BY layer, col) GROUP BY layer)",
        f"{pre}pre AS MATERIALIZED (SELECT a.*, CASE WHEN n.l1 > {d(1.0)} THEN a.g * {d(1.0)} / n.l1 "
        f"ELSE a.g END AS gc, CASE WHEN n.an > 0 THEN {d(net.rate)} / n.an END AS ada "
        f"FROM {pre}acc a JOIN {pre}nrm n ON n.layer = a.layer)"]
    if optimizer == "vanilla":
        eta = "ada"
        theta = (f"CASE WHEN g IS NULL OR {eta} IS NULL THEN theta ELSE theta * CASE WHEN row > 0 THEN "
                 f"{d(1.0)} - {eta} * {d(net.lmbda)} / {n_train} ELSE {d(1.0)} END - {eta} * gc END")
        vel = "velocity"
    else:
        eta = "ada" if lm == "ADA" else d(net.rate)
        vnew = f"({d(mu)} * velocity - {eta} * gc)"
        theta = f"CASE WHEN g IS NULL OR {eta} IS NULL THEN theta ELSE theta + {vnew} END"
        vel = f"CASE WHEN g IS NULL OR {eta} IS NULL THEN velocity ELSE {vnew} END"
    ctes.append(
        f"{pre}new AS MATERIALIZED (SELECT model_id, layer, row, col, {theta} AS theta, {vel} AS velocity, "
        f"gacc2 AS gacc FROM {pre}pre)")
    return ctes, f"{pre}new"


def momentum_mu(epoch: int, itert: float, maxmu: float) -> float:
    return min(1.0 - 2.0 ** (-1.0 - math.log2(epoch / itert + 1.0)), maxmu)


def with_clause(ctes: list[str]) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
