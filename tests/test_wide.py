"""Sparse examples, models in tiles, sums merged in two levels, numbered lines."""

import os

import numpy as np
import pytest
from conftest import SF_SMALL

from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.operators import sharded as SH
from plexnet.operators import sparse as SP
from plexnet.operators import steps as S
from plexnet.plans.grid import models_from_rows
from plexnet.sources import sparse as SS
from plexnet.sources import tables as T
from plexnet.sources.libsvm import read_libsvm, write_libsvm
from plexnet.sources.lines import numbered_lines
from plexnet.sources.weights import read_weights_text, write_weights_text
from pyspark.sql import functions as F

BASE = dict(fan="fan_in", seed=11, rate=0.3, lmbda=0.01, optimizer="momentum", learning_mod="", maxmu=0.95, itert=1.0)


def nets(spark, width, *rows):
    m = models_from_rows(spark, [dict(model_id=i, hidden=h, outputs=o, activation=a, init="xnormal", loss=loss, **BASE) for i, h, o, a, loss in rows])
    return m, P.init_params(m, width)


def keyed(sums):
    return {(r.model_id, r.layer, r.row, r.col): r.value for r in sums.collect()}


def same(a, b, skip=()):
    a = {k: v for k, v in a.items() if not (k[1] == -1 and k[2] in skip)}
    b = {k: v for k, v in b.items() if k in a or not (k[1] == -1 and k[2] in skip)}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9, rel=1e-9), k


@pytest.fixture(scope="module")
def sparse_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        k = np.sort(rng.choice(40, rng.integers(0, 9), replace=False))
        rows.append((i, k.tolist(), rng.normal(size=len(k)).tolist(), float(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "id bigint, indices array<int>, values array<double>, label double").repartition(4)


@pytest.mark.parametrize("hidden,outputs,loss", [("6", 3, "log"), ("5,4", 3, "log"), ("", 3, "log"), ("70", 3, "log")])
def test_sparse_passes_equal_dense_ones(spark, sparse_rows, hidden, outputs, loss, monkeypatch):
    monkeypatch.setattr(SP, "HELD_PRODUCTS", 64)  # rows come in many pieces
    dense = SS.to_dense(sparse_rows, 40)
    if hidden == "":
        m, p = nets(spark, 40, ("a", "4", outputs, "tanh", loss))
        specs = [s for s in PS.specs_from_frames(p, m)]
        specs[0].weights = [np.random.default_rng(1).normal(size=(41, 3))]  # no hidden layer at all
    else:
        m, p = nets(spark, 40, ("a", hidden, outputs, "tanh", loss), ("b", hidden, outputs, "ReLU", loss))
        specs = PS.specs_from_frames(p, m)
    want = {(r.id, r.model_id): r.p for r in PS.score(dense, p, m, specs=specs).collect()}
    got = {(r.id, r.model_id): r.p for r in SP.score(sparse_rows, p, m, 40, specs=specs).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    dense_sums = keyed(PS.gradient_sums(dense, p, m, specs=specs))
    sums = keyed(SP.gradient_sums(sparse_rows, p, m, 40, specs=specs))
    used = {i for r in sparse_rows.collect() for i in r.indices}
    absent = [k for k in dense_sums if k not in sums and k[1] >= 0]
    assert all(k[1] == 0 and k[2] - 1 not in used and dense_sums[k] == 0 for k in absent)  # untouched rows are not sent
    same({k: v for k, v in sums.items() if k[1] >= 0}, {k: v for k, v in dense_sums.items() if k in sums and k[1] >= 0})
    a, b = (e.orderBy("model_id").collect() for e in (SP.evaluate(sparse_rows, p, m, 40, specs=specs), PS.evaluate(dense, p, m, specs=specs)))
    for x, y in zip(a, b, strict=True):
        assert (x.n, x.accuracy) == (y.n, y.accuracy) and x.cost == pytest.approx(y.cost)


def test_sparse_steps_train(spark):
    """Full-batch momentum on hashed words lowers the cost; steps take the sparse sums as they are."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").join(
        spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality is not null"), "doc_id").select("text", F.col("quality").cast("double").alias("label"))
    ex = SS.hashed_words(docs, 4096, keep=("label",)).persist()
    m, p = nets(spark, 4096, ("w", "4", 1, "tanh", "log"))
    costs = []
    for _ in range(3):
        costs.append(SP.evaluate(ex, p, m, 4096).first().cost)
        sums = PS.stored_sums(SP.gradient_sums(ex, p, m, 4096))
        p = PS.stored_sums(S.step_momentum(S.mean_gradient(sums, p, m), m, 0.5).select(*P.KEYS, "theta", "velocity", "gacc"))
    assert costs[0] > costs[1] > costs[2]
    ex.unpersist()


def test_no_dense_row_and_no_shuffle_of_rows(spark, sparse_rows):
    m, p = nets(spark, 1 << 20, ("a", "2", 3, "tanh", "log"))
    specs = [type(s)(s.model_id, [np.zeros((1 << 20, 2)), np.zeros((3, 3))], "tanh", True) for s in PS.specs_from_frames(*nets(spark, 3, ("a", "2", 3, "tanh", "log"))[::-1])]
    specs[0].weights[0] = np.zeros(((1 << 20) + 1, 2))
    pass_ = SP.sums_pass(sparse_rows, specs, 1 << 20)
    plan = pass_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "features" not in plan
    assert pass_.where("layer = 0").count() <= 41


@pytest.mark.parametrize("bad,match", [(([40], [1.0]), "not one of 0..39"), (([-1], [1.0]), "not one of"), (([1, 2], [1.0]), "pair up"), ((None, None), "null sparse"), (([None], [1.0]), "pair up")])
def test_bad_sparse_rows_raise(spark, bad, match):
    m, p = nets(spark, 40, ("a", "2", 1, "tanh", "log"))
    ex = spark.createDataFrame([(1, *bad, 1.0)], "id bigint, indices array<int>, values array<double>, label double")
    with pytest.raises(Exception, match=match):
        SP.score(ex, p, m, 40).collect()


def test_sparse_libsvm_round_trip(spark, sparse_rows, tmp_path):
    path = str(tmp_path / "svm")
    SS.write_libsvm_sparse(sparse_rows, path)
    back = SS.read_libsvm_sparse(spark, path)
    assert back.select("id").distinct().count() == 300 and SS.sparse_width(back) == SS.sparse_width(sparse_rows)
    rows = lambda df: sorted((r.label, tuple(r.indices), tuple(r["values"])) for r in df.collect())
    assert rows(back) == rows(sparse_rows)
    with open(tmp_path / "odd.svm", "w") as f:
        f.write("# a comment\n\n1 3:0.5\t1:2\n  \n0\n")
    odd = SS.read_libsvm_sparse(spark, str(tmp_path / "odd.svm")).orderBy("label").collect()
    assert [(r.label, r.indices, r["values"]) for r in odd] == [(0.0, [], []), (1.0, [2, 0], [0.5, 2.0])]
    assert SS.hashed_words(spark.createDataFrame([(None,), ("",), ("A a b",)], "text string"), 16).collect()[2]["values"] in ([2 / 3, 1 / 3], [1 / 3, 2 / 3], [1.0])


@pytest.mark.parametrize("tile,rows", [(1, 7), (2, 64), (3, 1), (256, 256)])
def test_sharded_passes_equal_broadcast_ones(spark, tile, rows):
    ex = T.fixture(spark, SF_SMALL, "L").limit(400).repartition(3)
    ex = spark.createDataFrame(ex.collect(), ex.schema).repartition(3)
    m, p = nets(spark, 4, ("a", "5,3", 1, "tanh", "log"), ("b", "3,4", 1, "ELU", "squared"))
    s = SH.ShardedPass(ex, p, m, tile=tile, rows=rows)
    want = {(r.id, r.model_id): r.p for r in PS.score(ex, p, m).collect()}
    got = {(r.id, r.model_id): r.p for r in s.score().collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    sums = keyed(s.gradient_sums())
    same({k: v for k, v in sums.items() if k[1] >= 0}, {k: v for k, v in keyed(PS.gradient_sums(ex, p, m)).items() if k[1] >= 0})
    a, b = s.evaluate().orderBy("model_id").collect(), PS.evaluate(ex, p, m).orderBy("model_id").collect()
    for x, y in zip(a, b, strict=True):
        assert (x.n, x.accuracy) == (y.n, y.accuracy) and x.cost == pytest.approx(y.cost) and x.sqe == pytest.approx(y.sqe)


def test_a_model_over_the_bound_is_refused_before_it_is_collected_and_trains_in_tiles(spark, monkeypatch):
    ex = T.fixture(spark, SF_SMALL, "E").limit(60)
    ex = spark.createDataFrame(ex.collect(), ex.schema).repartition(2)
    m, p = nets(spark, 64, ("e", "9", 10, "tanh", "log"))
    want = keyed(PS.gradient_sums(ex, p, m))
    monkeypatch.setattr(PS, "MAX_BROADCAST_BYTES", 1000)
    monkeypatch.setattr(PS, "specs_from_pandas", lambda *a, **k: pytest.fail("the weights came to the driver"))
    with pytest.raises(ValueError, match="over the broadcast bound"):
        PS.score(ex, p, m)
    got = keyed(SH.ShardedPass(ex, p, m, tile=4).gradient_sums())
    same({k: v for k, v in got.items() if k[1] >= 0}, {k: v for k, v in want.items() if k[1] >= 0})


def test_sharded_pass_of_no_rows(spark):
    ex = T.fixture(spark, SF_SMALL, "L").limit(0)
    m, p = nets(spark, 4, ("a", "2", 1, "tanh", "log"))
    s = SH.ShardedPass(ex, p, m)
    assert s.score().count() == 0 and s.gradient_sums().count() == 0 and s.evaluate().count() == 0
    with pytest.raises(ValueError, match="number of layers"):
        SH.ShardedPass(ex, *nets(spark, 4, ("a", "2", 1, "tanh", "log"), ("b", "2,2", 1, "tanh", "log"))[::-1])


def test_two_level_merge_bounds_the_last_exchange(spark):
    """2,000 map tasks, 7 groups: the last exchange gets at most groups x keys rows, with the same sums."""
    parts = spark.range(0, 20_000, 1, 2_000).selectExpr("CAST(id % 10 AS INT) AS block", "1.0D AS v0", "CAST(id AS DOUBLE) AS v1")
    one = {r.block: (r.v0, r.v1) for r in PS.merged_sums(parts, ["block"], ["v0", "v1"]).collect()}
    first = parts.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(7))).groupBy("block", "_group").sum("v0", "v1")
    assert first.count() == 70
    two = PS.merged_sums(parts, ["block"], ["v0", "v1"], 7)
    assert {r.block: (r.v0, r.v1) for r in two.collect()} == one and len(one) == 10
    plan = two._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(block") == 2 and plan.count("_group") >= 2


def test_fit_with_two_level_merge(spark):
    from plexnet.plans.fit import fit
    ex = T.fixture(spark, SF_SMALL, "L").limit(500).repartition(6)
    ex = spark.createDataFrame(ex.collect(), ex.schema).repartition(6)
    m = models_from_rows(spark, [dict(model_id="a", hidden="3", outputs=1, activation="tanh", init="xnormal", epochs=2, **BASE)])
    a, b = (fit(ex, m, merge_groups=g).history.orderBy("epoch").collect() for g in (None, 2))
    assert [r.cost_train for r in a] == pytest.approx([r.cost_train for r in b])


def ids_at(spark, path, size, read):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = read(spark, path)
        return df.rdd.getNumPartitions(), sorted((r.id, r.label) for r in df.select("id", "label").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("read", [lambda s, p: read_libsvm(s, p, 4), SS.read_libsvm_sparse])
def test_libsvm_ids_do_not_depend_on_the_split_size(spark, read, tmp_path):
    path = str(tmp_path / "l")
    write_libsvm(T.fixture(spark, SF_SMALL, "L").coalesce(2), path)
    (few, a), (many, b) = (ids_at(spark, path, size, read) for size in ("128m", "64k"))
    assert many > few and a == b and len({i for i, _ in a}) == len(a) == T.fixture(spark, SF_SMALL, "L").count()


def test_numbered_lines_of_every_kind(spark, tmp_path):
    texts = {"a.txt": "x\n\ny\n", "b.txt": "", "c.txt": "\n", "d.txt": "".join(f"line {i}\n" for i in range(30_000))}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = {}
        for r in numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(os.path.basename(r.file), []).append((r.line, r.value))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(t.splitlines())) for k, t in texts.items() if t}


def test_weight_files_are_read_in_splits(spark, tmp_path):
    m, p = nets(spark, 300, ("big", "40", 1, "tanh", "log"), ("small", "2", 1, "ReLU", "log"))
    path = str(tmp_path / "w")
    write_weights_text(p, path, activation=m.select("model_id", "activation"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        back = read_weights_text(spark, path)
        assert numbered_lines(spark, f"{path}/model_id=big").rdd.getNumPartitions() > 4
        got = {(r.model_id, r.layer, r.row, r.col): (r.theta, r.activation) for r in back.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    acts = {"big": "tanh", "small": "ReLU"}
    assert got == {(r.model_id, r.layer, r.row, r.col): (r.theta, acts[r.model_id]) for r in p.collect()}


def test_missing_last_values_stay_zero(spark, tmp_path, monkeypatch):
    from plexnet.sources import weights
    monkeypatch.setattr(weights, "CHUNK", 4)
    (tmp_path / "m.txt").write_text("3_4_1_tanh\r\n1.5\r\n-2\r\n\r\n \r\n")
    (tmp_path / "none.txt").write_text("1_1_sigmoid\n")
    got = sorted((os.path.basename(r.model_id), r.layer, r.row, r.col, r.theta) for r in read_weights_text(spark, str(tmp_path)).collect())
    want = [("m.txt", 0, r, c, {(0, 0): 1.5, (0, 1): -2.0}.get((r, c), 0.0)) for r in range(4) for c in range(4)] + [("m.txt", 1, r, 0, 0.0) for r in range(5)]
    assert got == want + [("none.txt", 0, 0, 0, 0.0), ("none.txt", 0, 1, 0, 0.0)]
    (tmp_path / "m.txt").write_text("1_2_tanh\n1\n\n2\n")
    with pytest.raises(ValueError, match="blank line"):
        read_weights_text(spark, str(tmp_path))
    (tmp_path / "m.txt").write_text("1_1_tanh\n1\n2\n3\n")
    with pytest.raises(ValueError, match="more values"):
        read_weights_text(spark, str(tmp_path))


