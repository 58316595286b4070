"""What a task holds and what a pass shuffles does not grow with the input."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plexnet.functions.random import md5_bits, mix_uniform, np_mix_uniform
from plexnet.operators import examples as E
from plexnet.operators import kernel as K
from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.operators import sharded as SH
from plexnet.plans.grid import models_from_rows
from plexnet.session import ensure_checkpoint_dir
from plexnet.sources import sparse as SS
from plexnet.sources.lines import numbered_lines
from pyspark.sql import functions as F


def labelled(spark, n, partitions=3):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label double").repartition(partitions)


def nets(spark):
    base = dict(outputs=1, init="xnormal", fan="fan_in", seed=11, rate=0.3, lmbda=0.01, optimizer="momentum", learning_mod="", maxmu=0.95, itert=1.0)
    m = models_from_rows(spark, [dict(model_id="a", hidden="5,3", activation="tanh", loss="log", **base), dict(model_id="b", hidden="3,4", activation="ELU", loss="squared", **base)])
    return m, P.init_params(m, 4)


@pytest.mark.parametrize("held", [1, 3 * 13 * 40, 10**6])
def test_sharded_groups_keep_the_sums_and_store_no_activations(spark, held, monkeypatch):
    monkeypatch.setattr(SH, "HELD", held, raising=False)
    ex, (m, p) = labelled(spark, 150), nets(spark)
    base = f"{ensure_checkpoint_dir(spark)}/plexnet"
    base = base.removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    s = SH.ShardedPass(ex, p, m, tile=2, rows=16)
    got = {(r.model_id, r.layer, r.row, r.col): r.value for r in s.gradient_sums().where("layer >= 0").collect()}
    assert {n.split("-")[1] for n in set(os.listdir(base)) - before} == {"tiles", "blocks"}
    want = {(r.model_id, r.layer, r.row, r.col): r.value for r in PS.gradient_sums(ex, p, m).where("layer >= 0").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {(r.model_id, r.n) for r in s.evaluate().collect()} == {("a", 150), ("b", 150)}


def test_sums_of_a_long_task_hold_little():
    rng = np.random.default_rng(6)
    n, spec = 10_000, K.NetSpec("a", [rng.normal(size=(5, 8)), rng.normal(size=(9, 4)), rng.normal(size=(5, 1))], "tanh")
    yes, no = pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))
    x, y = rng.normal(size=(n, 4)), (np.arange(n) % 2).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(x.ravel())), pa.array(y), yes, yes, no],
                                       ["features", "label", "_t", "_b", "_v"])
    tracemalloc.start()
    sums = pa.Table.from_batches(K.sums_kernel((batch for _ in range(50)), [spec], 4)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    one = pa.Table.from_batches(K.sums_kernel(iter([batch]), [spec], 4)).to_pydict()
    assert sums["value"] == pytest.approx([50 * v for v in one["value"]])
    wide = list(K.merged(iter([batch]), units=996, values=100_000))  # a large batch is cut
    assert [len(b) for b in wide] == [100] * 100 and pa.Table.from_batches(wide).equals(pa.Table.from_batches([batch]))


def test_a_draw_hashes_its_key_once(spark):
    ex = spark.range(500).withColumn("split", F.lit("train"))
    key = md5_bits(F.col("id"), 7)
    got = ex.select(key.alias("k"), mix_uniform(key, 7, 3).alias("u")).collect()
    assert [r.u for r in got] == np_mix_uniform(np.array([r.k for r in got]), 7, 3).tolist()
    plan = E.minibatch(ex, 3, 500, 50, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert spark.range(1).select(mix_uniform(F.lit(None).cast("bigint"), 7, 3).alias("u")).first().u is None


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    plan = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
