
import datetime as dt
import math

from pyspark.sql import functions as F

from perkframe import plans
from perkframe.operators import (customers, distributions, filters, offers, segments,
                                 timeseries)


def test_null_key_and_all_null_sum(spark):
    df = spark.createDataFrame([(None, 5.0), ("a", None)], "customer_id STRING, amount DOUBLE")
    out = {r["customer_id"]: r["total_spend"] for r in customers.with_customer_total(df).collect()}
    assert out == {None: None, "a": 0.0}
    clv = customers.customer_lifetime_value(df.withColumn("age", F.lit(30.0))).collect()
    assert [(r["customer_id"], r["total_spend"]) for r in clv] == [("a", 0.0)]


def test_zero_difficulty_roi_is_null(spark):
    df = spark.createDataFrame([("X", 0, 0)], "offer_type STRING, difficulty INT, reward INT")
    assert offers.roi_by_offer_type(df).collect()[0]["roi"] is None


def test_unobserved_age_label(spark):
    df = spark.createDataFrame([(20.0, "a"), (20.0, "b"), (40.0, "a"), (120.0, "a")],
                               "age DOUBLE, offer_type STRING")
    rows = {(r["age_group"], r["offer_type"]): r["percentage"]
            for r in distributions.age_group_share(df).collect()}
    assert len(rows) == 8
    assert rows[("18-30", "a")] == 0.5 and rows[("18-30", "b")] == 0.5
    assert rows[("31-45", "a")] == 1.0 and rows[("31-45", "b")] == 0.0
    assert [v for k, v in rows.items() if k[0] in ("46-60", "60+")] == [None] * 4


def test_week_edges(spark):
    ts = [dt.datetime(1970, 1, 4, 23), dt.datetime(1970, 1, 5, 0), dt.datetime(1970, 1, 20)]
    df = spark.createDataFrame([(t, 1.0) for t in ts], "time TIMESTAMP_NTZ, amount DOUBLE")
    got = {r["period"].date(): r["amount"] for r in timeseries.resample_weekly(df).collect()}
    assert got == {dt.date(1970, 1, 4): 1.0, dt.date(1970, 1, 11): 1.0,
                   dt.date(1970, 1, 18): 0.0, dt.date(1970, 1, 25): 1.0}


def test_missing_days_zero_filled(spark):
    ts = [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 4, 1)]
    df = spark.createDataFrame([(t, 2.0) for t in ts], "time TIMESTAMP_NTZ, amount DOUBLE")
    got = [r["amount"] for r in timeseries.resample_daily(df).orderBy("period").collect()]
    assert got == [2.0, 0.0, 0.0, 2.0]


def test_empty_lists(spark):
    df = spark.createDataFrame([("a", "[]"), ("b", "['x', 'y']")], "offer_type STRING, channels STRING")
    assert filters.filter_offer_types(df, []).count() == 0
    assert filters.filter_window_types(df, None, []).count() == 2
    ex = plans.explode_channels(df).collect()
    assert sorted((r["offer_type"], r["channels"]) for r in ex if r["offer_type"] == "a") == [("a", None)]
    assert len(ex) == 3


def test_tie_goes_to_smaller_key(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)],
                               "offer_type STRING, success_rate DOUBLE")
    r = offers.top_group(df, "offer_type").collect()[0]
    assert r["offer_type"] == "a" and r["success_rate"] == 0.5


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(i, 5, 1, float(i)) for i in range(6)],
                               "customer_id INT, recency INT, frequency BIGINT, monetary DOUBLE")
    means, stds = segments.fit_scaler(df)
    assert stds[0] == 1.0 and stds[1] == 1.0
    z = segments.scaled(df, means, stds).collect()
    assert all(r["z0"] == 0.0 for r in z)


def test_unmatched_customer_gets_minus_one(spark):
    o = spark.createDataFrame([(1, True), (2, False)], "customer_id INT, offer_success BOOLEAN")
    r = spark.createDataFrame([(1, 3)], "customer_id INT, cluster INT")
    got = {x["customer_id"]: x["cluster"] for x in offers.attach_segment(o, r).collect()}
    assert got == {1: 3, 2: -1}


def test_no_new_customers_cac_zero(spark):
    rfm = spark.createDataFrame([(1, 40, 2, 10.0)],
                                "customer_id INT, recency INT, frequency BIGINT, monetary DOUBLE")
    o = spark.createDataFrame([(5,)], "reward INT")
    r = customers.advanced_metrics(rfm, o).collect()[0]
    assert r["cac"] == 0.0 and r["churn_rate"] == 1.0 and r["clv"] == 20.0


def test_nearest_centre_and_ties(spark):
    model = segments.SegmentModel(means=[0, 0, 0], stds=[1, 1, 1],
                                  centers=[[0, 0, 0], [2, 0, 0], [1, 0, 0]])
    df = spark.createDataFrame([(1, 0.4, 0.0, 0.0), (2, 1.5, 0.0, 0.0), (3, 0.5, 0.0, 0.0)],
                               "customer_id INT, recency DOUBLE, frequency DOUBLE, monetary DOUBLE")
    got = {r["customer_id"]: r["cluster"] for r in segments.assign_segments(df, model).collect()}
    assert got == {1: 0, 2: 1, 3: 0}  # 0.5 is equidistant from 0 and 1 -> lowest id


def test_share_sums_to_one_and_corr_symmetric(spark):
    from perkframe.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    o = plans.prepare_offer_events(fx.offer_events(spark, sf))
    share = distributions.age_group_share(o).groupBy("age_group").agg(F.sum("percentage").alias("s"))
    for r in share.collect():
        assert r["s"] is None or math.isclose(r["s"], 1.0)
    cm = {(r["var1"], r["var2"]): r["corr"] for r in
          customers.correlation_matrix(o, segments.rfm(fx.transaction_events(spark, sf))).collect()}
    assert len(cm) == 25
    for (a, b), v in cm.items():
        assert cm[(b, a)] == v
        if a == b:
            assert v == 1.0


def test_result_independent_of_partitioning(spark):
    from perkframe.sources import fixtures as fx
    lt = fx.order_transactions(spark, "/root/testdata/sf0.001")
    base = sorted(map(tuple, segments.rfm(lt).collect()))
    for n in (1, 4, 7):
        got = sorted(map(tuple, segments.rfm(lt.repartition(n)).collect()))
        assert len(got) == len(base)
        for a, b in zip(got, base):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-12)
    m1 = segments.fit_segments(segments.rfm(lt.repartition(1)))
    m7 = segments.fit_segments(segments.rfm(lt.repartition(7)))
    for a, b in zip(m1.centers, m7.centers):
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b))


def test_model_roundtrip(spark, tmp_path):
    from perkframe import sources
    from perkframe.sources import fixtures as fx
    r = segments.rfm(fx.order_transactions(spark, "/root/testdata/sf0.001"))
    m = segments.fit_segments(r)
    m.save(str(tmp_path / "m"))
    m2 = sources.load_model(spark, str(tmp_path / "m"))
    assert m2.centers == m.centers and m2.means == m.means and m2.stds == m.stds
    a = segments.assign_segments(r, m).orderBy("customer_id").collect()
    b = segments.assign_segments(r, m2).orderBy("customer_id").collect()
    assert a == b


def test_forecast_matches_direct_recursion():
    import numpy as np
    y = np.array([3.0, 5.0, 4.0, 6.0, 8.0, 7.0])
    phi, theta, fc = timeseries.fit_forecast_series(y, 3)
    w = np.diff(y)
    best = None
    for p in np.arange(-95, 100, 5) / 100.0:
        for t in np.arange(-95, 100, 5) / 100.0:
            e, pw, sse = 0.0, w[0], 0.0
            for x in w[1:]:
                e = x - p * pw - t * e
                sse += e * e
                pw = x
            cand = (sse, p, t, e)
            best = cand if best is None or cand[:3] < best[:3] else best
    assert math.isclose(phi, best[1]) and math.isclose(theta, best[2])
    w1 = best[1] * w[-1] + best[2] * best[3]
    assert math.isclose(fc[0], y[-1] + w1)


def test_bracketed_percentiles_are_exact(spark):
    import random
    from perkframe.operators.quantiles import percentiles
    random.seed(3)
    rows = [(random.choice("abc"), random.random() * 100 if random.random() > 0.1 else None)
            for _ in range(3000)] + [("d", 1.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for acc in (10, 100_000):  # a coarse sketch forces the widened-bracket path
        for keys in ([], ["g"]):
            a = {tuple(r[:-1]): r[-1] for r in percentiles(df, "x", qs, keys, "bracket", acc).collect()}
            exact = F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("q")
            b = {tuple(r[:-1]): r[-1] for r in df.groupBy(*keys).agg(exact).collect()}
            assert a.keys() == b.keys()
            for k in a:
                assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a[k], b[k]))


def test_redemption_hot_pair_across_days(spark):
    rows = [(1, "c", "o", "offer received", dt.datetime(2024, 1, 1, 10)),
            (2, "c", "o", "offer completed", dt.datetime(2024, 1, 1, 10)),
            (3, "c", "o", "offer completed", dt.datetime(2024, 1, 3, 9)),
            (4, "c", "o", "offer received", dt.datetime(2024, 1, 3, 12)),
            (5, "c", "o", "offer completed", dt.datetime(2024, 1, 3, 18)),
            (6, "c", "x", "offer completed", dt.datetime(2024, 1, 4, 0))]
    df = spark.createDataFrame(rows, "event_id INT, customer_id STRING, offer_id STRING, "
                                     "event STRING, time TIMESTAMP_NTZ")
    got = {r["event_id"]: r["time_to_redemption"] for r in offers.time_to_redemption(df).collect()}
    assert got == {2: 0.0, 3: (2 * 24 - 1) / 24, 5: 0.25, 6: None}


def test_data_scaler_model_saves_and_scores_alike(spark, tmp_path):
    from perkframe import sources
    from perkframe.sources import fixtures as fx
    r = segments.rfm(fx.order_transactions(spark, "/root/testdata/sf0.001"))
    m = segments.SegmentModel.with_scaler_of(r, [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    m.save(str(tmp_path / "m"))
    m2 = sources.load_model(spark, str(tmp_path / "m"))
    a = segments.assign_segments(r, m).orderBy("customer_id").collect()
    b = segments.assign_segments(r, m2).orderBy("customer_id").collect()
    assert a == b


def test_guards_renames_and_projection(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "customer_id INT, total_spend DOUBLE, z STRING")
    assert filters.is_empty(df.filter("customer_id > 5"))
    assert not filters.is_empty(df)
    assert filters.rename(df, {"z": "segment"}).columns == ["customer_id", "total_spend", "segment"]
    assert filters.select_if_present(df, ["customer_id", "total_spend"], "customer_id").columns \
        == ["customer_id", "total_spend"]
    assert filters.select_if_present(df, ["customer_id"], "missing").columns == df.columns


def test_describe_matches_spark_percentile(spark):
    from perkframe.sources import fixtures as fx
    o = fx.offer_events(spark, "/root/testdata/sf0.001")
    got = {r["statistic"]: r["value"] for r in distributions.describe_column(o, "income").collect()}
    q = o.agg(F.percentile("income", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    for name, want in zip(("25%", "50%", "75%"), q):
        assert math.isclose(got[name], want, rel_tol=1e-12), name


def test_every_customer_gets_its_nearest_centre(spark):
    from perkframe.sources import fixtures as fx
    r = segments.rfm(fx.order_transactions(spark, "/root/testdata/sf0.001"))
    m = segments.fit_segments(r)
    rows = segments.assign_segments(r, m).collect()
    assert len(rows) == r.count()
    for row in rows:
        z = [(float(row[f]) - mu) / sd for f, mu, sd in zip(segments.FEATURES, m.means, m.stds)]
        d = [sum((a - b) ** 2 for a, b in zip(z, c)) for c in m.centers]
        assert row["cluster"] == d.index(min(d))


def test_empty_inputs_do_not_fail(spark):
    from perkframe.operators.quantiles import percentiles
    from perkframe.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    o = plans.prepare_offer_events(fx.offer_events(spark, sf)).filter(F.lit(False))
    t = fx.transaction_events(spark, sf).filter(F.lit(False))
    rfm = segments.rfm(t)
    assert rfm.count() == 0
    assert percentiles(t, "amount", [0.5]).collect()[0]["_q"] == [None]
    assert distributions.histogram(t, "amount").count() == 0
    assert distributions.box_stats(t, "amount", "event").count() == 0
    assert timeseries.forecast(timeseries.resample_daily(t, key="customer_id"),
                               key="customer_id").count() == 0
    row = offers.offer_insights(plans.explode_channels(o), t, rfm.withColumn("cluster", F.lit(0)))
    r = row.collect()[0]
    assert r["total_offers"] == 0 and r["total_revenue"] == 0.0
    assert r["offer_completion_rate"] is None and r["top_offer_type"] is None
    assert customers.transaction_overview(t).collect()[0]["total_transactions"] == 0


def test_hot_key_results_match_direct_formulations(spark):
    """A third of the rows on one customer / offer (derived from the given
    table): bucketed redemption equals one window per pair; totals and RFM
    equal direct pandas sums."""
    from pyspark.sql import Window

    from perkframe.sources import fixtures as fx
    sf = "/root/testdata/sf0.01"
    hot = F.col("event_id") % 3 == 0
    o = (fx.offer_events(spark, sf)
         .withColumn("customer_id", F.when(hot, F.lit(0)).otherwise(F.col("customer_id")))
         .withColumn("offer_id", F.when(hot, F.lit("0")).otherwise(F.col("offer_id"))))
    got = {r["event_id"]: r["time_to_redemption"] for r in offers.time_to_redemption(o).collect()}
    w = (Window.partitionBy("customer_id", "offer_id").orderBy("time", "event_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    direct = (o.filter(F.col("event").isin("offer completed", "offer received"))
              .filter("customer_id IS NOT NULL AND offer_id IS NOT NULL")
              .withColumn("_r", F.max(F.when(F.col("event") == "offer received", F.col("time"))).over(w))
              .filter(F.col("event") == "offer completed")
              .select("event_id", ((F.unix_seconds(F.col("time").cast("timestamp"))
                                     - F.unix_seconds(F.col("_r").cast("timestamp"))) / 86400.0)
                      .alias("d")))
    want = {r["event_id"]: r["d"] for r in direct.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None and want[k] is None) or math.isclose(got[k], want[k]) for k in got)

    t = (fx.transaction_events(spark, sf)
         .withColumn("customer_id", F.when(hot, F.lit(0)).otherwise(F.col("customer_id"))))
    pdf = t.toPandas()
    sums = pdf.groupby("customer_id")["amount"].sum()
    tot = {r["customer_id"]: r["total_spend"]
           for r in customers.with_customer_total(t).select("customer_id", "total_spend")
           .distinct().collect()}
    assert all(math.isclose(tot[k], sums[k], rel_tol=1e-9) for k in sums.index)
    r = {x["customer_id"]: x for x in segments.rfm(t).collect()}
    assert r[0]["frequency"] == int((pdf["customer_id"] == 0).sum())
    assert math.isclose(r[0]["monetary"], max(sums[0], 0.0), rel_tol=1e-9)


def test_plain_sums_of_small_and_large_amounts(spark):
    df = spark.createDataFrame([("a", 0.004)] * 1000 + [("b", 1e17), ("c", float("nan"))],
                               "customer_id STRING, amount DOUBLE")
    got = {r["customer_id"]: r["total_spend"] for r in
           customers.with_customer_total(df).select("customer_id", "total_spend").distinct().collect()}
    assert math.isclose(got["a"], 4.0) and got["b"] == 1e17 and math.isnan(got["c"])
    day = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0.333)], "time TIMESTAMP_NTZ, amount DOUBLE")
    assert timeseries.resample_daily(day).collect()[0]["amount"] == 0.333


def test_pivot_keeps_every_cluster(spark):
    import pytest
    perf = spark.createDataFrame([("A", 0, 0.5), ("A", 7, 0.25), ("B", -1, 1.0)],
                                 "offer_type STRING, cluster INT, conversion_rate DOUBLE")
    got = {r["offer_type"]: r for r in offers.pivot_performance(perf).collect()}
    assert got["A"]["cluster_7"] == 0.25 and got["B"]["cluster_m1"] == 1.0
    with pytest.raises(Exception, match="no column for cluster 7"):
        offers.pivot_performance(perf, [-1, 0]).collect()


def test_rows_without_an_event_are_kept(spark):
    from perkframe.sources import split_events
    df = spark.createDataFrame([(1, "transaction"), (2, None), (3, "offer viewed")], "id INT, event STRING")
    o, t = split_events(df)
    assert sorted(r["id"] for r in o.collect()) == [2, 3] and [r["id"] for r in t.collect()] == [1]


def test_null_feature_has_no_cluster_and_is_not_fitted(spark):
    import pytest
    schema = "customer_id INT, recency INT, frequency BIGINT, monetary DOUBLE"
    df = spark.createDataFrame([(i, i, i, float(i)) for i in range(8)] + [(9, None, 3, 1.0)], schema)
    m = segments.fit_segments(df)
    assert m.converged and all(v == v for c in m.centers for v in c)
    assert {r["customer_id"]: r["cluster"] for r in segments.assign_segments(df, m).collect()}[9] is None
    assert not segments.fit_segments(df, max_iter=0).converged
    with pytest.raises(ValueError):
        segments.fit_segments(df.filter("customer_id = 9"))


def test_python_literals_with_none(spark):
    from perkframe.functions import parse_dict, parse_list
    df = spark.createDataFrame([("{'offer_id': 'x', 'reward': None}", "['a', None]"),
                                ("{'amount': 4.5, 'offer_id': \"None's (b)\"}", "('a', 'True',)"),
                                ("oops", "oops"), (None, None)], "d STRING, l STRING")
    rows = df.select(parse_dict("d").alias("d"), parse_list("l").alias("l")).collect()
    assert rows[0]["d"]["offer_id"] == "x" and rows[0]["d"]["reward"] is None and rows[0]["l"] == ["a", None]
    assert rows[1]["d"]["offer_id"] == "None's (b)" and rows[1]["d"]["amount"] == 4.5
    assert rows[1]["l"] == ["a", "True"]
    assert rows[2]["l"] is None and rows[3]["d"] is None


def test_hours_of_every_numeric_type(spark):
    import pytest
    from perkframe.functions import to_timestamp_if_hours
    for kind, value in (("INT", 2), ("DOUBLE", 2.5), ("DECIMAL(6,2)", "2.5"), ("STRING", "2.5")):
        df = spark.sql(f"SELECT CAST({value!r} AS {kind}) AS time")
        got = to_timestamp_if_hours(to_timestamp_if_hours(df)).first()[0]
        assert got == dt.datetime(1970, 1, 1, 2, 0 if kind == "INT" else 30), kind
    with pytest.raises(TypeError):
        to_timestamp_if_hours(spark.sql("SELECT true AS time"))


def test_session_zone_plays_no_part(spark):
    from perkframe.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    was = spark.conf.get("spark.sql.session.timeZone")
    got = {}
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            o, t = plans.build_event_tables(fx.raw_events(spark, sf), fx.raw_customers(spark, sf),
                                            fx.raw_offers(spark, sf))
            got[zone] = [sorted(map(str, x.collect())) for x in
                         (t, segments.rfm(t), offers.time_to_redemption(o))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got["UTC"] == got["America/New_York"]


def test_tied_values_are_one_row_of_a_window_group(spark):
    from perkframe.operators.quantiles import bracket_counts, percentiles
    df = spark.range(100_000).select(F.when(F.col("id") % 10 > 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("x"))
    assert percentiles(df, "x", [0.05, 0.5, 0.9]).first()[0][1] == 7.0
    rows = df.select(F.col("x").alias("_v"), F.lit(0.0).alias("_elo0"), F.lit(50.0).alias("_ehi0"),
                     F.lit(0).alias("_eb0"), F.lit(50_000).alias("_k0"), F.lit(50_000.0).alias("_pos0"))
    counted = bracket_counts(rows, [], 1)
    assert counted.count() == 7 and counted.agg(F.max("_w")).first()[0] == 90_000


def test_weekly_series_gets_weekly_forecasts(spark):
    rows = [(dt.datetime(2024, 1, 7) + dt.timedelta(weeks=i), float(i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "period TIMESTAMP_NTZ, amount DOUBLE")
    got = sorted(r["date"] for r in timeseries.forecast(df, steps=3).collect())
    assert got == [rows[-1][0] + dt.timedelta(weeks=h) for h in (1, 2, 3)]


def test_forecast_worker_function_needs_no_package(tmp_path):
    """The pickled kernel runs in a process that can't import the library."""
    import subprocess
    import sys
    from pyspark.cloudpickle import dumps
    (tmp_path / "f").write_bytes(dumps(timeseries._css_kernel()))
    code = ("import pickle, numpy as np\nf = pickle.load(open('f', 'rb'))\n"
            "print(f(np.array([[3., 5, 4, 6, 8, 7]]), 1)[2][0, 0])")
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    want = timeseries.fit_forecast_series([3.0, 5, 4, 6, 8, 7], 1)[2][0]
    assert done.returncode == 0, done.stderr
    assert math.isclose(float(done.stdout), want)


def test_income_is_clipped_and_ages_are_fenced(spark):
    from perkframe.operators import cleaning
    df = spark.createDataFrame([(float(v),) for v in [*range(10, 30), 1000, -1000]] + [(None,)], "income DOUBLE")
    got = [r["income"] for r in cleaning.iqr_clip_fill_median(df).collect()]
    assert max(got) < 1000 and min(got) > -1000 and got[-1] == 19.5
    ages = df.withColumnRenamed("income", "age")
    assert filters.iqr_filter(ages).count() == 20


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest
    from perkframe.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_binned_density_is_close_to_the_plain_one(spark):
    df = spark.range(2000).select((F.col("id") % 997).cast("double").alias("x"))
    a = [r["density"] for r in distributions.density_estimate(df, "x").orderBy("x").collect()]
    b = [r["density"] for r in distributions.density_estimate(df, "x", binned=True).orderBy("x").collect()]
    assert all(math.isclose(x, y, rel_tol=1e-3) for x, y in zip(a, b))


def test_basket_by_join_equals_the_one_aggregate(spark):
    """D2 + D3 as the surveyed app does them, against E6 without a join."""
    from perkframe.sources import fixtures as fx
    lt = fx.order_transactions(spark, "/root/testdata/sf0.001")
    model = segments.SegmentModel(means=[200.0, 10.0, 1e6], stds=[100.0, 3.0, 5e5],
                                  centers=[[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    columns = ["customer_id", "transaction_count", "amount", "avg_basket_size", "cluster"]
    joined = segments.basket(lt, segments.segment_customers(lt, model)).select(*columns).orderBy("customer_id").collect()
    once = (segments.basket_from_segmented(segments.segment_customers(lt, model, with_basket=True))
            .select(*columns).orderBy("customer_id").collect())
    assert len(joined) == len(once) > 0
    for a, b in zip(joined, once):
        assert a[0] == b[0] and a[1] == b[1] and a[4] == b[4] and math.isclose(a[2], b[2]) and math.isclose(a[3], b[3])


def test_known_fences_filter_alike(spark):
    from perkframe.sources import fixtures as fx
    o = fx.offer_events(spark, "/root/testdata/sf0.001")
    fences = filters.bounds_of(filters.iqr_fences(o, "age"))
    assert filters.iqr_filter(o, fences=fences).count() == filters.iqr_filter(o).count() < o.count()
    assert filters.iqr_filter(o, fences=(None, None)).count() == 0
