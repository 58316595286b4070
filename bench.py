"""Benchmark: headline work of the engine at one scale.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints ONE JSON line. Every query runs over whole tables. Single passes
are timed as the median of 3 runs after one warm-up run; training is timed
per epoch inside ``fit`` (median epoch, steady state) and as the whole fit
including setup (cache fill, checks, init, final validation).

  score_L        score 1 network over all lineitem rows (fixture L; md5 ids)
  evaluate_L     validation pass (cost, accuracy, squared error) over all rows of L
  grad_L         gradient sums over all rows of L (one distributed pass)
  epoch_L_1      sec/epoch, 1 model, fixture L, mini-batch SGD (fused pass)
  epoch_L_8      sec/epoch, 8 models trained in the same scans
  epoch_L_full   sec/epoch, full-batch gradient over all train rows
  epoch_E_1      sec/epoch, multi-class 64-16-10 on fixture E
  epoch_D_1      sec/epoch, fixture D (documents + labels, text features)
  fit_L_1        whole fit of epoch_L_1 ($BENCH_EPOCHS epochs, setup included)
  fit_L_8        whole fit of epoch_L_8

The metric ``value`` is the sum of the query times (seconds).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plexnet.operators import params as P  # noqa: E402
from plexnet.operators import passes as PS  # noqa: E402
from plexnet.plans.fit import fit  # noqa: E402
from plexnet.plans.grid import model_grid, single_model  # noqa: E402
from plexnet.session import local_session  # noqa: E402
from plexnet.sources.tables import fixture  # noqa: E402

EPOCHS = int(os.environ.get("BENCH_EPOCHS", "10"))


def median_of_3(fn) -> float:
    fn()
    runs = []
    for _ in range(3):
        t = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t)
    return statistics.median(runs)


def fit_times(ex, models, **kw) -> tuple[float, float]:
    """(median seconds per epoch, whole fit seconds)."""
    ep: list = []
    t = time.perf_counter()
    fit(ex, models, timings=ep, **kw).history.collect()
    total = time.perf_counter() - t
    return statistics.median(ep[1:] or ep), total


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="plexnet-bench")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    L = fixture(spark, sf_dir, "L", spread=True)
    m1 = single_model(spark, "L8", hidden="8", rate=0.5, epochs=EPOCHS)
    p1 = P.init_params(m1, 4)
    specs = PS.specs_from_frames(p1, m1)

    q = {}
    q["score_L"] = median_of_3(lambda: PS.score(L, p1, m1, specs=specs).write.format("noop")
                               .mode("overwrite").save())
    q["evaluate_L"] = median_of_3(lambda: PS.evaluate(L, p1, m1, specs=specs).collect())
    q["grad_L"] = median_of_3(lambda: PS.sums_pass(L, specs, batch=F.lit(True)).collect())
    q["epoch_L_1"], q["fit_L_1"] = fit_times(L, m1)
    grid = model_grid(spark, "8-16-8,8-16,16-4", "0.5,0.1", epochs=EPOCHS)
    q["epoch_L_8"], q["fit_L_8"] = fit_times(L, grid)
    q["epoch_L_full"], _ = fit_times(L, m1, full_batch=True)
    mE = single_model(spark, "E16", hidden="16", outputs=10, activation="ReLU", rate=0.1, epochs=EPOCHS)
    q["epoch_E_1"], _ = fit_times(fixture(spark, sf_dir, "E", spread=True), mE)
    mD = single_model(spark, "D8", hidden="8", rate=0.5, epochs=EPOCHS)
    q["epoch_D_1"], _ = fit_times(fixture(spark, sf_dir, "D", spread=True), mD)
    q = {k: round(v, 4) for k, v in q.items()}
    print(json.dumps({"metric": "sum_of_query_seconds", "value": round(sum(q.values()), 4),
                      "unit": "sec", "queries": q, "sf": sf, "cpus": cpus, "epochs": EPOCHS}))
    spark.stop()


if __name__ == "__main__":
    main()
