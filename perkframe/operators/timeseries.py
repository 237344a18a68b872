"""Zero-filled time series (F1-F3), many-series ARIMA(1,1,1) forecast
and history + forecast in one table (F5).

Series are keyed: with ``key=None`` the whole table is one series (the
reference's case), with a key every group is its own series, so one job
forecasts thousands of series.  Everything is per-key work: a spine of
periods per key, arrays of one key's *periods* (bounded by the time span,
not by the number of rows), higher-order functions for the recursions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import micros_between

# Candidate grid of the CSS fit, phi and theta in
# {-0.95, -0.90, ..., 0.95}; horizon of the reference forecast.
GRID_LO, GRID_STEP, GRID_N = -95, 5, 39  # in hundredths
DEFAULT_STEPS = 30

#: Periods: unit and number of it that a period lasts.
_UNITS = {"hour": ("HOUR", 1), "day": ("DAY", 1), "week": ("DAY", 7)}
#: Periods that one row stands for before they are listed.
PIECE = 4096


def _period(time_col: str, freq: str) -> Column:
    t = F.col(time_col).cast("timestamp_ntz")
    if freq == "week":
        # pandas 'W' = weeks Monday..Sunday labelled by their Sunday
        return F.timestamp_add("DAY", F.lit(6), F.date_trunc("week", t).cast("timestamp_ntz"))
    return F.date_trunc(freq, t).cast("timestamp_ntz")


def resample(df: DataFrame, time_col: str = "time", value_col: str = "amount",
             freq: str = "day", key: str | None = None, name: str | None = None) -> DataFrame:
    """Sum of ``value_col`` per period (per key), missing periods 0.

    A key's span is known as (first period, number of periods).  It is cut into
    pieces of ``PIECE`` periods, the pieces are dealt out evenly, and each lists
    its own, so no row holds a whole series: a far-off time makes many small
    rows instead of a large one.
    """
    name = name or value_col
    keys = [key] if key else []
    unit, length = _UNITS[freq]
    base = df.filter(F.col(time_col).isNotNull())
    if key:
        base = base.filter(F.col(key).isNotNull())
    sums = (base.groupBy(*keys, _period(time_col, freq).alias("period"))
            .agg(F.sum(F.col(value_col).cast("double")).alias("_v")))
    step = length * (3_600_000_000 if unit == "HOUR" else 86_400_000_000)
    spans = (sums.groupBy(*keys).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
             .withColumn("_n", F.expr(f"timestampdiff(MICROSECOND, _lo, _hi) div {step}"))
             .filter("_n IS NOT NULL"))  # no rows at all
    pieces = (spans.select(*keys, "_lo", "_n", F.explode(F.expr(f"sequence(0L, _n div {PIECE})")).alias("_i"))
              .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_i"))
    listed = F.explode(F.expr(f"sequence(_i * {PIECE}, least(_n, (_i + 1) * {PIECE} - 1))"))
    spine = (pieces.withColumn("_k", listed)
             .select(*keys, F.expr(f"timestampadd({unit}, _k * {length}, _lo)").alias("period")))
    return (spine.join(sums, [*keys, "period"], "left")
            .select(*keys, "period", F.coalesce("_v", F.lit(0.0)).cast("double").alias(name)))


def resample_daily(df, time_col="time", value_col="amount", key=None):
    """F1."""
    return resample(df, time_col, value_col, "day", key)


def resample_hourly(df, time_col="time", value_col="amount", key=None):
    """F2."""
    return resample(df, time_col, value_col, "hour", key)


def resample_weekly(df, time_col="time", value_col="amount", key=None):
    """F3."""
    return resample(df, time_col, value_col, "week", key)


def _css_kernel():
    """The CSS fit as a function that stands alone: it is sent to the workers
    whole, so they need numpy and pandas but not this package."""
    lo, step, n = GRID_LO, GRID_STEP, GRID_N

    def fit(Y, steps: int):
        """S series of equal length L (rows of ``Y``) against all grid
        candidates; returns (phi[S], theta[S], forecasts[S, steps]).

        ``argmin`` keeps the first minimum and the grid is ordered by (phi,
        theta), which is the (SSE, phi, theta) tie-break."""
        import numpy as np
        g = np.arange(n * n)
        phi, theta = (lo + step * (g // n)) / 100.0, (lo + step * (g % n)) / 100.0
        W = np.diff(Y, axis=1)                                # [S, L-1]
        pw = np.repeat(W[:, :1], phi.size, axis=1)            # [S, G]
        e = np.zeros_like(pw)
        sse = np.zeros_like(pw)
        for t in range(1, W.shape[1]):
            x = W[:, t:t + 1]
            e = x - phi * pw - theta * e
            sse = sse + e * e
            pw = np.repeat(x, phi.size, axis=1)
        best = np.argmin(sse, axis=1)
        p, q = phi[best], theta[best]
        w1 = p * W[:, -1] + q * e[np.arange(Y.shape[0]), best]
        h = np.arange(1, steps + 1, dtype="float64")
        fc = Y[:, -1:] + w1[:, None] * (1.0 - np.power(p[:, None], h)) / (1.0 - p[:, None])
        return p, q, fc

    return fit


def _exact_kernel():
    """The exact maximum likelihood fit as a function that stands alone (see
    :func:`_css_kernel`)."""
    lo, grid_step, n = GRID_LO, GRID_STEP, GRID_N
    limit, rounds, close = 0.9999, 400, 1e-7

    def likelihood(W, phi, theta):
        """Log-likelihood of differences W[S, T] under ARMA(1,1) without mean
        for candidates phi, theta [S, G], the variance at its best value, and
        the forecast of the next difference.

        The Kalman filter of this model has a scalar recursion: the next
        difference is forecast as phi * w + (theta / v) * e, with e the last
        error and v its variance over that of the shocks, which starts at the
        stationary one and goes to 1."""
        import numpy as np
        v = (1.0 + 2.0 * phi * theta + theta * theta) / (1.0 - phi * phi)
        ahead, squares, logs = np.zeros_like(phi), np.zeros_like(phi), np.zeros_like(phi)
        for t in range(W.shape[1]):
            w = W[:, t:t + 1]
            e = w - ahead
            squares = squares + e * e / v
            logs = logs + np.log(v)
            ahead = phi * w + theta * e / v
            v = 1.0 + theta * theta - theta * theta / v
        T = W.shape[1]
        with np.errstate(divide="ignore"):
            return -0.5 * (T * (np.log(2.0 * np.pi * squares / T) + 1.0) + logs), ahead

    def fit(Y, steps: int):
        """S series of equal length (rows of ``Y``): (phi[S], theta[S],
        forecasts[S, steps], log-likelihood[S]).

        Starts at the best point of the grid and walks to the best of the
        neighbours in 16 directions and at three distances, which double after
        a step and halve when no neighbour is better: never below the grid's
        best point, and inside |phi|, |theta| < 1."""
        import numpy as np
        W = np.diff(Y, axis=1)
        S = len(Y)
        g = np.arange(n * n)
        p, q = (lo + grid_step * (g // n)) / 100.0, (lo + grid_step * (g % n)) / 100.0
        value, _ = likelihood(W, np.repeat(p[None, :], S, 0), np.repeat(q[None, :], S, 0))
        flat = ~np.isfinite(value).all(axis=1)  # no variance at all: nothing to fit
        best = np.argmax(np.where(flat[:, None], 0.0, value), axis=1)
        phi, theta = np.where(flat, 0.0, p[best]), np.where(flat, 0.0, q[best])
        held, width = value[np.arange(S), best], np.full(S, grid_step / 200.0)
        angle = np.arange(16) * (np.pi / 8.0)
        a, b = (np.concatenate([f(angle) * r for r in (1.0, 0.25, 0.0625)])[None, :] for f in (np.cos, np.sin))
        for _ in range(rounds):
            if (width < close).all():
                break
            cp = np.clip(phi[:, None] + a * width[:, None], -limit, limit)
            cq = np.clip(theta[:, None] + b * width[:, None], -limit, limit)
            value, _ = likelihood(W, cp, cq)
            k = np.argmax(np.where(flat[:, None], 0.0, value), axis=1)
            top = value[np.arange(S), k]
            up = (top > held) & ~flat
            phi, theta = np.where(up, cp[np.arange(S), k], phi), np.where(up, cq[np.arange(S), k], theta)
            held, width = np.where(up, top, held), np.where(up, np.minimum(width * 2.0, 0.05), width / 2.0)
        _, ahead = likelihood(W, phi[:, None], theta[:, None])
        h = np.arange(1, steps + 1, dtype="float64")
        geo = (1.0 - np.power(phi[:, None], h)) / (1.0 - phi[:, None])
        return phi, theta, Y[:, -1:] + ahead * geo, held

    fit.likelihood = likelihood
    return fit


def fit_forecast_series(y, steps: int = DEFAULT_STEPS, method: str = "css"):
    """Fit of one ordered series ``y``: (phi, theta, forecasts) or None for
    fewer than 3 points."""
    import numpy as np
    y = np.asarray(y, dtype="float64")
    if len(y) < 3:
        return None
    p, t, fc = (_css_kernel() if method == "css" else _exact_kernel())(y[None, :], steps)[:3]
    return p[0], t[0], fc[0]


def forecast(series: DataFrame, key: str | None = None, period: str = "period",
             value: str = "amount", steps: int = DEFAULT_STEPS,
             chunk: int = 256, method: str = "css") -> DataFrame:
    """ARIMA(1,1,1) without drift, fitted per series by conditional sum
    of squares over a (phi, theta) grid (``method="css"``) or by exact maximum
    likelihood (``method="exact"``: see :func:`_exact_kernel`), then ``steps`` forecasts, one period
    apart: the step is that between the series' last two periods (an hour, a
    day, a week).

    For the grid, with w_t = y_t - y_(t-1): e_1 = 0, e_t = w_t - phi*w_(t-1) - theta*e_(t-1),
    SSE = sum e_t^2; the winner is the least (SSE, phi, theta).  Forecast
    y_(T+h) = y_T + w1 * (1 - phi^h) / (1 - phi), w1 = phi*w_T + theta*e_T.
    Series with fewer than 3 points get no rows.  Output (key, date, forecast).

    Spark builds one row per series (its values in period order, bounded by
    the time span, never by the row count) with a group-by, then
    ``mapInPandas`` scores whole chunks of equal-length series against the
    1,521 candidates as 2-D numpy arrays: one Python call per Arrow batch,
    sequential only in t.
    """
    keys = [key] if key else []
    key_type = dict(series.dtypes)[key] if key else None
    out_schema = (f"`{key}` {key_type}, " if key else "") + "date TIMESTAMP_NTZ, forecast DOUBLE"
    arr = (series.groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct(
               F.col(period).alias("p"), F.col(value).cast("double").alias("y")))).alias("_s"))
           .filter(F.size("_s") >= 3)
           .select(*keys, F.col("_s.y").alias("_y"), F.element_at("_s", -1)["p"].alias("_last"),
                   micros_between(F.element_at("_s", -2)["p"], F.element_at("_s", -1)["p"]).alias("_step")))
    cols = keys + ["date", "forecast"]
    if method not in ("css", "exact"):
        raise ValueError(f"unknown method {method!r}")
    kernel = _css_kernel() if method == "css" else _exact_kernel()

    def fit(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            lens = pdf["_y"].map(len).to_numpy()
            parts = []
            for L in np.unique(lens[lens >= 3]):
                idx = np.flatnonzero(lens == L)
                for c0 in range(0, idx.size, chunk):
                    sel = idx[c0:c0 + chunk]
                    Y = np.stack([np.asarray(v, dtype="float64") for v in pdf["_y"].iloc[sel]])
                    fc = kernel(Y, steps)[2]
                    last = pdf["_last"].iloc[sel].to_numpy().astype("datetime64[us]")
                    step = pdf["_step"].iloc[sel].to_numpy().astype("timedelta64[us]")
                    dates = (last[:, None] + np.arange(1, steps + 1) * step[:, None]).astype("datetime64[ns]")
                    part = {"date": dates.ravel(), "forecast": fc.ravel()}
                    if key:
                        part[key] = np.repeat(pdf[key].iloc[sel].to_numpy(), steps)
                    parts.append(pd.DataFrame(part)[cols])
            yield pd.concat(parts) if parts else pd.DataFrame({c: [] for c in cols})

    return arr.mapInPandas(fit, out_schema)


def history_and_forecast(series: DataFrame, key: str | None = None, period: str = "period",
                         value: str = "amount", steps: int = DEFAULT_STEPS, method: str = "css") -> DataFrame:
    """actuals and forecast in one (key, date, kind, value) table."""
    keys = [key] if key else []
    hist = series.select(*keys, F.col(period).alias("date"), F.lit("actual").alias("kind"),
                         F.col(value).cast("double").alias("value"))
    fc = forecast(series, key, period, value, steps, method=method).select(
        *keys, "date", F.lit("forecast").alias("kind"), F.col("forecast").alias("value"))
    return hist.unionByName(fc)
