"""Parameter tables, weight files, warm start (FIXTURES part 3 'weights_2_3_1')."""

import numpy as np
import pytest

from plexnet.operators import params as P
from plexnet.plans.grid import model_grid, single_model
from pyspark.sql import functions as F
from plexnet.sources.weights import read_weights_text, write_weights_text


def test_architecture_counts(spark):
    m = model_grid(spark, "20,10-40", "0.1")
    a = {r["model_id"]: r for r in P.architecture(m, 7).collect()}
    assert a["20,10@0.1"]["sizes"] == [7, 20, 10, 1]
    assert a["20,10@0.1"]["n_weights"] == 8 * 20 + 21 * 10 + 11 * 1
    assert a["40@0.1"]["n_neurons"] == 41


def test_init_distributions(spark):
    m = single_model(spark, "u", hidden="64,64", init="xuniform", outputs=1)
    t = P.init_params(m, 16).toPandas()
    w = t[t.row > 0].theta
    e = np.sqrt(6.0 / 17)
    assert (w.abs() <= e).all() and abs(w.mean()) < 0.05
    assert (t[t.row == 0].theta == 0).all()
    m = single_model(spark, "n", hidden="64,64", init="xnormal")
    w = P.init_params(m, 16).toPandas().query("row > 0").theta
    assert w.std() == pytest.approx(np.sqrt(3.0 / 17), rel=0.1)


def test_init_same_for_same_seed_across_models(spark):
    g = model_grid(spark, "5", "0.1,0.2")
    t = P.init_params(g, 3).toPandas()
    a = t[t.model_id == "5@0.1"].sort_values(["layer", "row", "col"]).theta.values
    b = t[t.model_id == "5@0.2"].sort_values(["layer", "row", "col"]).theta.values
    assert np.array_equal(a, b)


def _weights_2_3_1(spark):
    return P.init_params(single_model(spark, "w231", hidden="3", activation="tanh"), 2)


def test_weights_text_roundtrip(spark, tmp_path):
    p = _weights_2_3_1(spark)
    path = str(tmp_path / "w")
    write_weights_text(p, path, activation="tanh")
    files = [f for f in (tmp_path / "w" / "model_id=w231").iterdir() if f.name.endswith(".txt")]
    lines = files[0].read_text().splitlines()
    assert lines[0] == "2_3_1_tanh" and len(lines) == 1 + 13
    back = read_weights_text(spark, path).toPandas().sort_values(["layer", "row", "col"])
    want = p.toPandas().sort_values(["layer", "row", "col"])
    assert np.array_equal(back.theta.values, want.theta.values)
    assert set(back.activation) == {"tanh"}


def test_weights_text_short_and_long(spark, tmp_path):
    d = tmp_path / "short" / "model_id=s"
    d.mkdir(parents=True)
    (d / "part-0.txt").write_text("2_3_1_tanh\n0.5\n0.25\n")
    back = read_weights_text(spark, str(tmp_path / "short")).toPandas()
    assert len(back) == 13 and back.theta.sum() == 0.75
    d = tmp_path / "long" / "model_id=l"
    d.mkdir(parents=True)
    (d / "part-0.txt").write_text("2_3_1_tanh\n" + "1.0\n" * 14)
    with pytest.raises(ValueError, match="more values"):
        read_weights_text(spark, str(tmp_path / "long"))


def test_warm_start_modes_and_shape_check(spark):
    stored = P.init_params(single_model(spark, "w", hidden="3", outputs=4, seed=1), 2)
    fresh = P.init_params(single_model(spark, "w", hidden="3,4", seed=2), 2)
    ae = P.warm_start(fresh, stored, "AE").toPandas()
    s = stored.toPandas().set_index(["layer", "row", "col"]).theta
    f = fresh.toPandas().set_index(["layer", "row", "col"]).theta
    a = ae.set_index(["layer", "row", "col"]).theta
    assert all(a[k] == s[k] for k in s.index)
    assert all(a[k] == f[k] for k in f.index if k[0] == 2)
    pt = P.warm_start(fresh, stored, "PT").toPandas().set_index(["layer", "row", "col"]).theta
    assert all(pt[k] == s[k] for k in s.index if k[0] == 0)
    assert all(pt[k] == f[k] for k in f.index if k[0] >= 1)
    wrong = P.init_params(single_model(spark, "w", hidden="5", outputs=4), 2)
    with pytest.raises(ValueError, match="do not fit"):
        P.warm_start(fresh, wrong, "AE")


def test_flatten_unflatten_roundtrip(spark):
    m = model_grid(spark, "3-2,2", "0.1")
    p = P.init_params(m, 4)
    back = P.unflatten_params(P.flatten_params(p), m, 4).toPandas()
    a = p.toPandas().sort_values(["model_id", "layer", "row", "col"]).theta.values
    b = back.sort_values(["model_id", "layer", "row", "col"]).theta.values
    assert np.array_equal(a, b)


def test_chunks_of_a_large_model(spark):
    """Two million weights in pieces of 65,536: the longest row is a piece, and the way back is exact."""
    m = models_of(spark, "1000,999")
    p = P.init_params(m, 999)
    flat = P.flatten_chunks(p)
    n = 1000 * 1000 + 1001 * 999 + 1000
    sizes = {r.chunk: r.n for r in flat.select("chunk", F.size("flat").alias("n")).collect()}
    assert sum(sizes.values()) == n and max(sizes.values()) == 65_536 and sorted(sizes) == list(range(-(-n // 65_536)))
    back = P.unflatten_chunks(flat, m, 999)
    both = back.join(p.select(*P.KEYS, F.col("theta").alias("want")), P.KEYS)
    assert both.agg(F.count("*"), F.count_if(F.col("theta") == F.col("want"))).first()[:] == (n, n)


def models_of(spark, hidden):
    from plexnet.plans.grid import single_model
    return single_model(spark, "big", hidden=hidden, init="xnormal")
