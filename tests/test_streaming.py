"""Streaming: scoring a stream equals batch scoring; online training applies
each micro-batch once, also when the query is started again."""

import numpy as np

from conftest import SF_SMALL
from plexnet.operators import params as P
from plexnet.operators.passes import score
from plexnet.plans.grid import single_model
from plexnet.sources.tables import events_examples, events_stream, fixture
from plexnet.streaming.fit_stream import fit_stream, latest_params


def test_score_stream_equals_batch(spark, tmp_path):
    m = single_model(spark, "v", hidden="3")
    p = P.init_params(m, 2)
    out = str(tmp_path / "s")
    q = (score(events_examples(events_stream(spark, SF_SMALL)), p, m).writeStream.format("parquet")
         .option("checkpointLocation", out + "_ck").trigger(availableNow=True).start(out))
    q.awaitTermination()
    s = spark.read.parquet(out).toPandas().sort_values("id")
    b = score(fixture(spark, SF_SMALL, "V"), p, m).toPandas().sort_values("id")
    assert np.allclose(np.stack(s.p.values), np.stack(b.p.values))


def test_fit_stream_replay_safe(spark, tmp_path):
    m = single_model(spark, "v", hidden="3", rate=0.3)
    p = P.init_params(m, 2)
    run = str(tmp_path / "run")
    fit_stream(events_examples(events_stream(spark, SF_SMALL)), m, p, run_dir=run)
    first = latest_params(spark, run).toPandas().sort_values(["layer", "row", "col"])
    assert not np.allclose(first.theta.values,
                           p.toPandas().sort_values(["layer", "row", "col"]).theta.values)
    # started again on the same checkpoint: no new data, nothing applied twice
    fit_stream(events_examples(events_stream(spark, SF_SMALL)), m, p, run_dir=run)
    again = latest_params(spark, run).toPandas().sort_values(["layer", "row", "col"])
    assert np.array_equal(first.theta.values, again.theta.values)
