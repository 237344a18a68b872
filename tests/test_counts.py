"""One-pass quantiles by value counts (J12; B3, B4, C6, E19)."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from perkframe.operators import cleaning
from perkframe.operators.quantiles import percentiles, percentiles_of

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e12, 1e12, allow_nan=False, allow_infinity=False)), min_size=1, max_size=200)
quantiles = st.lists(st.sampled_from([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]), min_size=1, max_size=4, unique=True)


def wanted(xs, qs):
    xs = [x for x in xs if x is not None]
    return [None] * len(qs) if not xs else list(np.percentile(np.array(xs), [q * 100 for q in qs], method="linear"))


def close(got, want):
    return all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9))
               for g, w in zip(got, want, strict=True))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=values, ys=values, qs=quantiles)
def test_counts_equal_numpy_for_several_columns(spark, xs, ys, qs):
    n = max(len(xs), len(ys))
    rows = list(zip(xs + [None] * (n - len(xs)), ys + [None] * (n - len(ys))))
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE").repartition(3)
    for slabs in (True, False):
        got = percentiles_of(df, {"x": qs, "y": [0.5]}, slabs=slabs).collect()
        if not got:  # no value at all
            assert set(xs + ys) == {None}
            continue
        assert close(got[0]["_q_x"], wanted(xs, qs)) and close(got[0]["_q_y"], wanted(ys, [0.5]))


def test_both_ways_agree_per_group(spark):
    df = spark.sql("SELECT id % 3 AS k, CAST(id * id % 97 AS DOUBLE) / 7 - 5 AS v FROM range(3000) "
                   "UNION ALL SELECT NULL, 1.0D UNION ALL SELECT 1, NULL")
    rows = lambda d: sorted((r["k"], [round(x, 9) for x in r[-1]]) for r in d.collect())
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    want = rows(percentiles(df, "v", qs, ["k"]))
    assert rows(percentiles(df, "v", qs, ["k"], method="counts")) == want
    assert rows(percentiles_of(df, {"v": qs}, ["k"])) == want


def test_customers_are_scanned_once_for_their_statistics(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.sql("SELECT id AS customer_id, 20130101 AS became_member_on, 'M' AS gender, CAST(id % 130 AS INT) AS age, "
              "CAST(id * 37 % 1000 AS DOUBLE) AS income FROM range(500)").write.parquet(path)
    out = cleaning.clean_customers(spark.read.parquet(path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the rows themselves, and one scan for the counts, whose exchange both rankings share
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan
    slow = cleaning.iqr_clip_fill_median(cleaning.replace_above_with_median(
        spark.read.parquet(path), domain="large"))
    key = lambda d: sorted((r["customer_id"], r["age"], r["income"]) for r in d.collect())
    assert key(out) == key(slow)
