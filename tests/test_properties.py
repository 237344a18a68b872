"""Property tests: exact operators against numpy on random inputs."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from perkframe.operators.quantiles import percentiles

values = st.lists(st.one_of(st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)
quantiles = st.lists(st.sampled_from([0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]),
                     min_size=1, max_size=4, unique=True)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=values, qs=quantiles, accuracy=st.sampled_from([2, 10, 100_000]))
def test_bracketed_percentiles_equal_numpy_linear(spark, xs, qs, accuracy):
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = percentiles(df, "x", qs, method="bracket", accuracy=accuracy).collect()[0]["_q"]
    want = np.percentile(np.array(xs), [q * 100 for q in qs], method="linear")
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9), (g, w)
