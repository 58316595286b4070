"""Plan properties the design relies on (checked on the physical plan)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from plexnet.operators import examples as E
from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.plans.grid import model_grid
from plexnet.sources.tables import fixture


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_pass_shuffles_only_partial_sums(spark):
    ex = E.cache_examples(fixture(spark, SF_SMALL, "L"), 2332)
    ex.count()
    m = model_grid(spark, "4-3,3", "0.5,0.1")
    specs = PS.specs_from_frames(P.init_params(m, 4), m)
    tr = F.col("split") == "train"
    s = PS.sums_pass(ex, specs, train=tr, batch=tr, val=~tr, layout="blocks", draw=(0.1, 2332, 3))
    plan = _plan(s)
    # one scan of the cache for all 4 models, one exchange (of the block sums)
    assert plan.count("MapInArrow") == 1
    assert plan.count("InMemoryTableScan") == 1
    assert plan.count("Exchange hashpartitioning(model_id") == 1
    assert "Sort" not in plan
    ex.unpersist()


def test_fixture_scan_is_pruned(spark):
    L = fixture(spark, SF_SMALL, "L").select("features", "label")
    plan = L._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "l_linestatus" not in plan


def test_same_plan_for_every_epoch(spark):
    """The mini-batch draw lives in the kernel: epochs differ only in the
    Python function, not in generated code."""
    ex = E.cache_examples(fixture(spark, SF_SMALL, "L"), 2332)
    m = model_grid(spark, "3", "0.5")
    specs = PS.specs_from_frames(P.init_params(m, 4), m)
    tr = F.col("split") == "train"
    plans = [_plan(PS.sums_pass(ex, specs, train=tr, batch=tr, layout="blocks", draw=(0.1, 2332, e)))
             for e in (1, 2)]
    strip = [p.split("MapInArrow")[0] + p.split("MapInArrow")[1].split("\n", 1)[1] for p in plans]
    import re
    norm = [re.sub(r"#\d+L?|plan_id=\d+", "", p) for p in strip]
    assert norm[0] == norm[1]
    ex.unpersist()
