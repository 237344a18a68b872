"""Exact likelihood of ARIMA(1,1,1), and series with far-off times."""

import datetime as dt

import numpy as np

from perkframe.operators import timeseries as ts


def dense_likelihood(w, phi, theta):
    """From the covariance matrix of ARMA(1,1)."""
    n = len(w)
    g0 = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    g1 = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    gamma = np.array([g0] + [g1 * phi ** (k - 1) for k in range(1, n)])
    cov = gamma[np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])]
    s2 = float(w @ np.linalg.solve(cov, w)) / n
    return -0.5 * (n * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(cov)[1]), s2


def some_series(count):
    rng = np.random.default_rng(6)
    for _ in range(count):
        n, phi, theta = int(rng.integers(3, 40)), rng.uniform(-.95, .95), rng.uniform(-.95, .95)
        e = rng.normal(size=n + 50)
        w = np.zeros(n + 50)
        for t in range(1, n + 50):
            w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
        yield np.cumsum(w[50:]) + 100


def test_likelihood_equals_the_dense_covariance():
    rng, kernel = np.random.default_rng(1), ts._exact_kernel()
    for y in some_series(200):
        phi, theta = rng.uniform(-.98, .98, 2)
        w = np.diff(y)
        got, _ = kernel.likelihood(w[None, :], np.array([[phi]]), np.array([[theta]]))
        want, _ = dense_likelihood(w, phi, theta)
        assert np.isclose(got[0, 0], want, rtol=1e-7, atol=1e-7)


def test_fit_is_at_least_the_best_of_the_grid_and_a_local_best():
    kernel = ts._exact_kernel()
    g = np.arange(ts.GRID_N**2)
    p, q = (ts.GRID_LO + ts.GRID_STEP * (g // ts.GRID_N)) / 100, (ts.GRID_LO + ts.GRID_STEP * (g % ts.GRID_N)) / 100
    for y in some_series(60):
        phi, theta, fc, value = kernel(y[None, :], 5)
        grid, _ = kernel.likelihood(np.diff(y)[None, :], p[None, :], q[None, :])
        assert value[0] >= grid.max() and abs(phi[0]) < 1 and abs(theta[0]) < 1
        assert np.isclose(value[0], dense_likelihood(np.diff(y), phi[0], theta[0])[0], rtol=1e-6, atol=1e-6)
        near = [(np.clip(phi[0] + a, -.9999, .9999), np.clip(theta[0] + b, -.9999, .9999))
                for a in (-1e-4, 0, 1e-4) for b in (-1e-4, 0, 1e-4)]
        around, _ = kernel.likelihood(np.diff(y)[None, :], np.array([[a for a, _ in near]]), np.array([[b for _, b in near]]))
        assert around.max() <= value[0] + 1e-5
        assert np.isfinite(fc).all()


def test_one_step_forecast_is_the_conditional_mean():
    for y in some_series(20):
        phi, theta, fc, _ = ts._exact_kernel()(y[None, :], 1)
        w, n = np.diff(y), len(y)
        g0 = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
        g1 = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
        gamma = np.array([g0] + [g1 * phi ** (k - 1) for k in range(1, n)]).ravel()
        cov = gamma[np.abs(np.arange(n - 1)[:, None] - np.arange(n - 1)[None, :])]
        want = y[-1] + gamma[n - 1:0:-1] @ np.linalg.solve(cov, w)
        assert np.isclose(fc[0, 0], want, rtol=1e-6, atol=1e-6)


def test_series_of_several_keys(spark):
    series = list(some_series(6)) + [np.array([1.0, 2.0]), np.full(9, 5.0)]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(days=i), float(v)) for k, y in enumerate(series) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k INT, period TIMESTAMP_NTZ, amount DOUBLE").repartition(3)
    out = ts.forecast(df, "k", steps=4, method="exact").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["k"], r["date"])):
        got.setdefault(r["k"], []).append(r["forecast"])
    assert set(got) == set(range(8)) - {6}  # two points are too few
    for k, fc in got.items():
        assert np.allclose(fc, ts.fit_forecast_series(series[k], 4, "exact")[2], rtol=1e-9)
    assert got[7] == [5.0] * 4  # a constant series goes on


def test_far_off_time_makes_no_large_row(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 5), 2.0), (1, dt.datetime(2024, 1, 1, 7, 30), 3.0),
            (2, dt.datetime(9999, 12, 31, 23), 1.0), (2, dt.datetime(9000, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "k INT, time TIMESTAMP_NTZ, amount DOUBLE")
    out = ts.resample(df, freq="hour", key="k")
    got = out.groupBy("k").agg({"*": "count", "amount": "sum", "period": "max"}).orderBy("k").collect()
    hours = (dt.datetime(9999, 12, 31, 23) - dt.datetime(9000, 1, 1)).days * 24 + 24
    assert [(r["count(1)"], r["sum(amount)"]) for r in got] == [(3, 5.0), (hours, 5.0)]
    assert "array" not in {t for _, t in out.dtypes}
    small = sorted((r["period"], r["amount"]) for r in out.filter("k = 1").collect())
    assert small == [(dt.datetime(2024, 1, 1, h), v) for h, v in ((5, 2.0), (6, 0.0), (7, 3.0))]
    weeks = ts.resample(df.filter("k = 2"), freq="week", key="k")
    r = weeks.selectExpr("count(*) AS n", "count(DISTINCT period) AS d",
                         "count_if(dayofweek(period) <> 1) AS wrong").first()
    assert r["n"] == r["d"] and r["wrong"] == 0
