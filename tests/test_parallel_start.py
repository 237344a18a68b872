"""k-means|| start and relocation of empty clusters; one shared RFM."""

import numpy as np
import pytest

import __spark_entry__ as E
from perkframe import plans
from perkframe.operators import segments
from perkframe.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def cost(rows, model):
    x = (np.array(rows) - np.array(model.means)) / np.array(model.stds)
    return float(((x[:, None] - np.array(model.centers)[None]) ** 2).sum(2).min(1).sum())


@pytest.fixture(scope="module")
def rfm(spark):
    return segments.rfm(fx.order_transactions(spark, SF)).cache()


def test_same_for_any_partitioning_and_no_worse_than_buckets(spark, rfm):
    rows = [[float(r[f]) for f in segments.FEATURES] for r in rfm.collect()]
    models = [segments.fit_segments(rfm.repartition(n), start="parallel") for n in (1, 4, 7)]
    for m in models[1:]:
        assert np.allclose(m.centers, models[0].centers, atol=1e-9)
    assert cost(rows, models[0]) <= cost(rows, segments.fit_segments(rfm)) * 1.001


def test_empty_clusters_move_to_far_rows(spark, monkeypatch):
    rows = [(float(v), float(v), float(v)) for v in [0.0] * 40 + [1.0] * 40 + [50.0, 100.0]]
    df = spark.createDataFrame(rows, "recency DOUBLE, frequency DOUBLE, monetary DOUBLE").repartition(3)
    # four starts, two of which no row is nearest to
    monkeypatch.setattr(segments, "parallel_start", lambda z, k: [[0.0] * 3, [0.1] * 3, [90.0] * 3, [91.0] * 3])
    model = segments.fit_segments(df, start="parallel")
    counts = {r["cluster"]: r["count"] for r in segments.assign_segments(df, model).groupBy("cluster").count().collect()}
    assert len(counts) == 4 and sorted(counts.values()) == [1, 1, 40, 40]
    kept = segments.fit_segments(df, start="buckets")
    assert cost(rows, model) <= cost(rows, kept)


def test_fewer_distinct_rows_than_clusters(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)] * 5 + [(2.0, 1.0, 1.0)] * 5,
                               "recency DOUBLE, frequency DOUBLE, monetary DOUBLE")
    model = segments.fit_segments(df, start="parallel")
    assert 1 <= len(model.centers) <= 2
    assert segments.assign_segments(df, model).select("cluster").distinct().count() == len(model.centers)
    with pytest.raises(ValueError):
        segments.fit_segments(df, start="other")


def test_bundle_computes_rfm_once_and_lets_it_go(spark):
    s = E._spark_ready(spark)
    t = fx.transaction_events(s, SF)
    model = segments.SegmentModel.with_scaler_of(segments.rfm(t), E.FIXED_CENTERS)
    with plans.segment_bundle(fx.offer_events(s, SF), t, E.OFFER_TYPES, 5.0, 150.0, model) as bundle:
        assert list(bundle) == ["offers", "transactions", "rfm", "advanced_metrics", "basket", "segment_stats"]
        first = bundle["segment_stats"].collect()
        for name in ("rfm", "basket", "segment_stats", "advanced_metrics"):
            plan = bundle[name]._jdf.queryExecution().executedPlan().toString()
            assert "InMemoryTableScan" in plan
        assert bundle._shared.storageLevel.useMemory
    assert not bundle._shared.storageLevel.useMemory  # released
    assert sorted(map(tuple, bundle["segment_stats"].collect())) == sorted(map(tuple, first))
