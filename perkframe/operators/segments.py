"""RFM scoring and reproducible k-means segmentation (E2, M1-M4, E3, E6, E7,
E17, E18, E26).

The model is tiny (three means, three deviations, k centres) and lives on the
driver; scoring is one Catalyst expression per row (nearest centre, ties to
the lowest id).  Fitting is Lloyd's algorithm where each round is one
distributed pass: assign every customer, then ``groupBy(cluster)`` sums
with map-side combine, so only k rows per partition are shuffled and k rows
reach the driver.  Start centres are a deterministic function of the data
(no sampling), so the result does not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attach_scalars, clamp_nonneg, days_between, round2
from ..sources import versions

FEATURES = ("recency", "frequency", "monetary")


def rfm(df: DataFrame, key: str = "customer_id", time_col: str = "time",
        event_col: str = "event", amount: str = "amount", with_basket: bool = False
        ) -> DataFrame:
    """Per customer recency (whole days from the customer's last event to
    the table's last event), frequency (non-null events), monetary (sum of
    amount, at least 0).

    One group-by over the rows (map-side combined); the table's last time is
    a global partial aggregate of the input attached as one row.  With
    ``with_basket`` the same aggregate also yields E6's ``transaction_count``
    (all rows) and ``amount`` (plain sum), so a basket needs neither a
    second shuffle nor a join (see :func:`basket_from_segmented`).
    """
    aggs = [F.max(time_col).alias("_last"), F.count(event_col).alias("frequency"),
            F.sum(amount).alias("_spend")]
    if with_basket:
        aggs.append(F.count(F.lit(1)).alias("transaction_count"))
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    gmax = df.agg(F.max(time_col).alias("_gmax"))
    spend = F.coalesce(F.col("_spend"), F.lit(0.0))
    extra = [F.col("transaction_count"), spend.alias("amount")] if with_basket else []
    return (attach_scalars(per, gmax)
            .select(key,
                    days_between(F.col("_last"), F.col("_gmax")).alias("recency"),
                    F.col("frequency"),
                    clamp_nonneg(spend).alias("monetary"), *extra))


@dataclass
class SegmentModel:
    """Scaler (population mean / std per feature) + centres in z-space."""

    means: list[float]
    stds: list[float]
    centers: list[list[float]]
    features: tuple[str, ...] = FEATURES
    iterations: int = 0
    converged: bool = True
    scaler: DataFrame | None = None

    def _bounds(self, i: int) -> tuple[Column, Column]:
        if self.scaler is not None:
            return F.col(f"_m{i}"), F.col(f"_s{i}")
        return F.lit(float(self.means[i])), F.lit(float(self.stds[i]))

    def _cluster_of_z(self) -> Column:
        """Nearest centre of the ``_z`` struct, lowest index on ties."""
        ds = []
        for j, c in enumerate(self.centers):
            terms = [(F.col("_z")[f"z{i}"] - F.lit(float(v))) * (F.col("_z")[f"z{i}"] - F.lit(float(v)))
                     for i, v in enumerate(c)]
            d = terms[0]
            for t in terms[1:]:
                d = d + t
            ds.append(F.struct(d.alias("d"), F.lit(j).alias("id")))
        return F.array_min(F.array(*ds))["id"].cast("int")

    def _known(self) -> Column:
        known = F.lit(True)
        for f in self.features:
            known = known & F.col(f).isNotNull()
        return known

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """M3: add the index of the nearest centre (squared Euclid in z-space).

        A data-derived scaler is a one-row aggregate attached by broadcast;
        z-scores are computed once per row into a struct.  A row with a NULL
        feature has no nearest centre: its cluster is NULL.
        """
        drop = ["_z"]
        if self.scaler is not None:
            from ..functions import attach_scalars
            df = attach_scalars(df, self.scaler)
            drop += list(self.scaler.columns)
        z = []
        for i, f in enumerate(self.features):
            m, sd = self._bounds(i)
            z.append(((F.col(f).cast("double") - m) / sd).alias(f"z{i}"))
        return (df.withColumn("_z", F.struct(*z))
                .withColumn(name, F.when(self._known(), self._cluster_of_z()))
                .drop(*drop))

    @classmethod
    def with_scaler_of(cls, rfm_df: DataFrame, centers, features=FEATURES) -> "SegmentModel":
        """Given centres, the scaler is taken from ``rfm_df`` lazily: a one-row
        aggregate (population mean / std, std 0 -> 1), no driver trip."""
        aggs = []
        for i, f in enumerate(features):
            sd = F.stddev_pop(F.col(f).cast("double"))
            aggs += [F.avg(F.col(f).cast("double")).alias(f"_m{i}"),
                     F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
                     .alias(f"_s{i}")]
        return cls(means=[], stds=[], centers=[list(c) for c in centers],
                   features=tuple(features), scaler=rfm_df.agg(*aggs))

    def resolved(self) -> "SegmentModel":
        """The same model with a data-derived scaler read into numbers (its
        single row)."""
        if self.scaler is None:
            return self
        row = self.scaler.first()
        n = len(self.features)
        return SegmentModel(means=[float(row[f"_m{i}"]) for i in range(n)],
                            stds=[float(row[f"_s{i}"]) for i in range(n)],
                            centers=self.centers, features=self.features,
                            iterations=self.iterations, converged=self.converged)

    def save(self, path: str) -> None:
        """Two small Parquet tables, scaler and centres, replaced in one
        step (``sources.versions``): a reader never has one of each model."""
        if self.scaler is not None:
            return self.resolved().save(path)
        spark = SparkSession.getActiveSession()
        scaler = [(f, float(m), float(s)) for f, m, s in zip(self.features, self.means, self.stds)]
        rows = [(j, *map(float, c)) for j, c in enumerate(self.centers)]
        schema = "cluster INT, " + ", ".join(f"{f} DOUBLE" for f in self.features)

        def write(folder: str) -> None:
            spark.createDataFrame(scaler, "feature STRING, mean DOUBLE, std DOUBLE") \
                .coalesce(1).write.parquet(f"{folder}/scaler")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/centers")

        versions.replace(spark, path, write)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SegmentModel":
        """Read a saved model (k + 3 rows); missing path -> AnalysisException."""
        path = versions.current(spark, path) or path
        sc = {r["feature"]: r for r in spark.read.parquet(f"{path}/scaler").collect()}
        cen = spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()
        feats = tuple(c for c in cen[0].asDict() if c != "cluster") if cen else FEATURES
        return cls(means=[sc[f]["mean"] for f in feats], stds=[sc[f]["std"] for f in feats],
                   centers=[[r[f] for f in feats] for r in cen], features=feats)


def _scaler_stats(rfm_df: DataFrame, features=FEATURES):
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"),
                 F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    row = rfm_df.agg(*aggs).first()
    if any(row[f"m_{f}"] is None for f in features):
        raise ValueError("no rows with a value of every feature to fit on")
    means = [float(row[f"m_{f}"]) for f in features]
    raw = [float(row[f"s_{f}"] or 0.0) for f in features]
    return means, [r if r else 1.0 for r in raw], raw


def fit_scaler(rfm_df: DataFrame, features=FEATURES) -> tuple[list[float], list[float]]:
    """M1: population mean and std per feature (std 0 -> 1); one aggregate."""
    means, stds, _ = _scaler_stats(rfm_df, features)
    return means, stds


def scaled(rfm_df: DataFrame, means, stds, features=FEATURES) -> DataFrame:
    """Z-scores per feature (columns z0, z1, ...)."""
    return rfm_df.select(*[((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).alias(f"z{i}")
                           for i, (f, m, s) in enumerate(zip(features, means, stds))])


def start_centers(z: DataFrame, k: int, seed_feature: int = 2) -> list[list[float]]:
    """Deterministic start: bucket by z(seed feature) at standard-normal cut
    points inv_cdf(i/k); each centre is its bucket's mean; empty buckets are
    dropped.  One aggregate, k rows to the driver."""
    cuts = [NormalDist().inv_cdf(i / k) for i in range(1, k)]
    b = None
    for c in cuts:
        t = (F.col(f"z{seed_feature}") >= F.lit(c)).cast("int")
        b = t if b is None else b + t
    n = len([c for c in z.columns if c.startswith("z")])
    rows = (z.groupBy(b.alias("b")).agg(*[F.avg(f"z{i}").alias(f"c{i}") for i in range(n)])
            .orderBy("b").collect())
    return [[float(r[f"c{i}"]) for i in range(n)] for r in rows]


def _draw(n: int, turn) -> Column:
    """A number in [0, 1) that a row's z-scores and ``turn`` decide, so that it
    is the same however the rows are partitioned (which changes the last bits
    of sums, and so of scores)."""
    h = F.xxhash64(*[F.round(F.col(f"z{i}"), 7) for i in range(n)], F.lit(turn))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _nearest_distance(centers: list[list[float]]) -> Column:
    """Squared distance of a row's z-scores to the nearest of ``centers``."""
    points = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in c) + ")" for c in centers)
    terms = " + ".join(f"(z{i} - c[{i}]) * (z{i} - c[{i}])" for i in range(len(centers[0])))
    return F.expr(f"array_min(transform(array({points}), c -> {terms}))")


def parallel_start(z: DataFrame, k: int, turns: int = 5, restarts: int = 20) -> list[list[float]]:
    """k-means|| start: each of ``turns`` passes draws rows with a chance in
    proportion to their distance from the candidates so far (8 k a pass on
    average), one more pass counts the rows nearest to each candidate, and the
    few weighted candidates are clustered on the driver, ``restarts`` times.

    Draws depend on the rows' values and sums are decimals, so the result is
    the same for any partitioning and order of the rows.
    """
    import numpy as np
    n = len([c for c in z.columns if c.startswith("z")])
    cols = [f"z{i}" for i in range(n)]
    first = z.agg(F.min(F.struct(_draw(n, "first").alias("u"), *cols)).alias("p")).first()["p"]
    if first is None:
        return []
    found = [[float(first[c]) for c in cols]]
    for turn in range(turns):
        near = z.withColumn("_d", _nearest_distance(found).cast("decimal(38,15)"))
        cost = float(near.agg(F.sum("_d")).first()[0])
        if cost <= 0:
            break  # every row is a candidate already
        drawn = (near.filter(_draw(n, turn) * F.lit(cost) < F.lit(8.0 * k) * F.col("_d").cast("double"))
                 .select(*cols).distinct().orderBy(*cols).collect())  # 8 k rows on average, equal rows are one
        found += [[float(r[c]) for c in cols] for r in drawn]
    found = sorted({tuple(c) for c in found})
    points = ", ".join("array(" + ", ".join(f"{v!r}D" for v in c) + ")" for c in found)
    terms = " + ".join(f"(z{i} - c[{i}]) * (z{i} - c[{i}])" for i in range(n))
    nearest = F.expr(f"array_min(transform(array({points}), (c, i) -> named_struct('d', {terms}, 'i', i))).i")
    counts = {r["i"]: r["n"] for r in z.groupBy(nearest.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    P = np.array(found)
    w = np.array([counts.get(i, 0) for i in range(len(P))], dtype="float64")
    best = None
    for seed in range(restarts):
        rng = np.random.default_rng(seed)
        C = P[[int(rng.choice(len(P), p=w / w.sum()))]]
        while len(C) < min(k, len(P)):
            d = ((P[:, None] - C[None]) ** 2).sum(2).min(1) * w
            if d.sum() <= 0:
                break
            C = np.vstack([C, P[int(rng.choice(len(P), p=d / d.sum()))]])
        for _ in range(50):
            d = ((P[:, None] - C[None]) ** 2).sum(2)
            a = d.argmin(1)
            new = np.array([np.average(P[a == j], axis=0, weights=w[a == j]) if w[a == j].sum() else C[j]
                            for j in range(len(C))])
            if np.allclose(new, C, rtol=0, atol=1e-12):
                break
            C = new
        cost = float((((P[:, None] - C[None]) ** 2).sum(2).min(1) * w).sum())
        if best is None or cost < best[0] - 1e-12:
            best = cost, C
    return sorted([float(v) for v in c] for c in best[1])


def _farthest(z: DataFrame, centers: list[list[float]], m: int) -> list[list[float]]:
    """The ``m`` distinct rows farthest from their nearest centre."""
    n = len(centers[0])
    cols = [f"z{i}" for i in range(n)]
    rows = (z.select(*cols, _nearest_distance(centers).alias("_d")).distinct()
            .orderBy(F.col("_d").desc(), *cols).limit(m).collect())
    return [[float(r[c]) for c in cols] for r in rows if r["_d"] > 0]


def fit_segments(rfm_df: DataFrame, k: int = 4, max_iter: int = 300, tol: float = 1e-4,
                 features=FEATURES, start: str = "buckets") -> SegmentModel:
    """M1 + M2: scaler, then Lloyd's k-means from :func:`start_centers`
    (``start="buckets"``) or :func:`parallel_start` (``start="parallel"``).

    The scaled table is persisted (memory, spilling to disk) for the rounds;
    if an executor is lost its blocks are recomputed from the short lineage.
    Convergence as in scikit-learn's k-means (used by the surveyed app): stop
    after the first round whose summed squared centre shift is at most
    ``tol`` times the mean variance of the scaled features, or at
    ``max_iter`` (``converged`` tells which).  A cluster that loses every
    member keeps its centre, or with ``start="parallel"`` moves to the row
    farthest from its centre, as in scikit-learn.  Rows with a NULL feature are not fitted on; a
    table without any other row raises ``ValueError``.
    """
    rfm_df = rfm_df.dropna(subset=list(features))
    means, stds, raw = _scaler_stats(rfm_df, features)
    # population variance of a z-score column: 1, or 0 for a constant feature
    tol_abs = tol * sum((r / s) ** 2 for r, s in zip(raw, stds)) / len(features)
    z = scaled(rfm_df, means, stds, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if start not in ("buckets", "parallel"):
            raise ValueError(f"unknown start {start!r}")
        centers = start_centers(z, k) if start == "buckets" else parallel_start(z, k)
        n = len(features)
        spark = z.sparkSession
        kk = len(centers)
        cen_schema = ", ".join(f"c{j}_{i} DOUBLE" for j in range(kk) for i in range(n))
        # distances read the centres from a one-row frame, not from literals,
        # so every round runs the same generated code (no recompilation)
        dist = []
        for j in range(kk):
            d = None
            for i in range(n):
                t = (F.col(f"z{i}") - F.col(f"c{j}_{i}")) * (F.col(f"z{i}") - F.col(f"c{j}_{i}"))
                d = t if d is None else d + t
            dist.append(F.struct(d.alias("d"), F.lit(j).alias("id")))
        nearest = F.array_min(F.array(*dist))["id"].alias("c")
        centre_means = [F.avg(f"z{i}").alias(f"m{i}") for i in range(n)]
        it, done = 0, False
        for it in range(1, max_iter + 1):
            cen = spark.createDataFrame([tuple(float(v) for c in centers for v in c)], cen_schema)
            rows = (attach_scalars(z, cen).select(nearest, *[f"z{i}" for i in range(n)])
                    .groupBy("c").agg(*centre_means).collect())
            new = [list(c) for c in centers]
            for r in rows:
                new[r["c"]] = [float(r[f"m{i}"]) for i in range(n)]
            lost = sorted(set(range(kk)) - {r["c"] for r in rows})
            if lost and start == "parallel":
                for j, far in zip(lost, _farthest(z, centers, len(lost))):
                    new[j] = far
            shift = sum((a - b) ** 2 for c0, c1 in zip(centers, new) for a, b in zip(c0, c1))
            centers = new
            if shift <= tol_abs:
                done = True
                break
    finally:
        z.unpersist()
    return SegmentModel(means=means, stds=stds, centers=centers, features=tuple(features),
                        iterations=it, converged=done)


def assign_segments(rfm_df: DataFrame, model: SegmentModel) -> DataFrame:
    """M3: add ``cluster`` (nearest centre of a fitted model)."""
    return model.assign(rfm_df, "cluster")


def segment_customers(transactions: DataFrame, model: SegmentModel,
                      with_basket: bool = False) -> DataFrame:
    """M4: RFM of the given transactions scored with a previously fitted model."""
    return assign_segments(rfm(transactions, with_basket=with_basket), model)


def segment_kpis(rfm_df: DataFrame) -> DataFrame:
    """Customers and mean recency / frequency / monetary; one row."""
    return rfm_df.agg(F.count(F.lit(1)).alias("customers"),
                      F.avg("recency").alias("avg_recency"),
                      F.avg("frequency").alias("avg_frequency"),
                      F.avg("monetary").alias("avg_monetary"))


def basket(transactions: DataFrame, segmented: DataFrame, key: str = "customer_id") -> DataFrame:
    """E6 (+D2, D3): per customer row count, amount, amount/count, cluster.

    D2's self-join of two aggregates is one aggregate here; the join to the
    segmented customers is on the same key as both group-bys, so the two
    sides arrive hash-partitioned alike and no further shuffle is needed.
    """
    agg = (transactions.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount")))
    return (agg.withColumn("avg_basket_size", F.col("amount") / F.col("transaction_count"))
            .join(segmented.select(key, "cluster"), key, "inner"))


def basket_from_segmented(segmented: DataFrame, key: str = "customer_id") -> DataFrame:
    """E6 from customers scored by :func:`segment_customers` /
    :func:`assign_segments` on an RFM built ``with_basket=True``: the basket
    columns come from the same per-customer aggregate (no join)."""
    return segmented.select(key, "transaction_count", "amount",
                            (F.col("amount") / F.col("transaction_count")).alias("avg_basket_size"),
                            "cluster")


def segment_stats(basket_df: DataFrame) -> DataFrame:
    """Per cluster mean transaction_count and avg_basket_size, rounded to 2
    (half even, as pandas)."""
    return (basket_df.groupBy("cluster")
            .agg(round2(F.avg("transaction_count")).alias("avg_transactions"),
                 round2(F.avg("avg_basket_size")).alias("avg_basket_size")))


def segment_size_value(rfm_df: DataFrame) -> DataFrame:
    """Per cluster size and mean monetary."""
    return rfm_df.groupBy("cluster").agg(F.count(F.lit(1)).alias("segment_size"),
                                         F.avg("monetary").alias("avg_monetary"))


def segment_summary(rfm_df: DataFrame) -> DataFrame:
    """Per cluster mean recency / frequency / monetary, key-ordered (H4)."""
    return (rfm_df.groupBy("cluster")
            .agg(F.avg("recency").alias("recency"), F.avg("frequency").alias("frequency"),
                 F.avg("monetary").alias("monetary"))
            .orderBy("cluster"))


def segment_distribution(df: DataFrame) -> DataFrame:
    """E26 + H3: rows per cluster, largest first."""
    return (df.filter(F.col("cluster").isNotNull()).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("cluster")))
