"""

Every query reads the driver's Parquet tables through the fixture views in
``perkframe.sources.fixtures`` (FIXTURES.md) and runs over whole tables.
The oracle SQL in ``checks/oracle.py`` + below is written independently
from the definitions, against the same tables.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks.oracle import kmeans_sql, q, rfm_sql, scaler_sql, set_centers  # noqa: E402
from perkframe import plans, sources  # noqa: E402
from perkframe.functions import materialize, micros_between, parse_list  # noqa: E402
from perkframe.operators import (cleaning, customers, distributions, filters,  # noqa: E402
                                 offers, segments, timeseries)
from perkframe.session import ensure_conf, scratch_path  # noqa: E402
from perkframe.sources import fixtures as fx  # noqa: E402

# Fixed query parameters (the dashboard's widget values).
OFFER_TYPES = ["PROMO", "STANDARD", "SMALL"]
TXN_AMOUNT = (5.0, 150.0)
ORDER_AMOUNT = (50000.0, 400000.0)
SEGMENTS = [0, 2]
KMEANS_ROUNDS = 60
# Centres of the scoring queries (z-space: recency, frequency, monetary).
FIXED_CENTERS = [
    [1.0, -0.8, -0.8],
    [-0.5, -0.6, -0.6],
    [-0.5, 0.6, 0.5],
    [-0.7, 1.6, 1.8],
]
set_centers(FIXED_CENTERS)


# ---------------------------------------------------------------- fixtures
def _O(s, d):
    return fx.offer_events(s, d)


def _T(s, d):
    return fx.transaction_events(s, d)


def _OP(s, d):
    return plans.prepare_offer_events(_O(s, d), age_fences=fx.age_fences(s, d))


def _OX(s, d):
    """P4 with channels: prepared offers (P1) exploded per channel."""
    return plans.load_and_prepare(_O(s, d), _T(s, d), channels=True, age_fences=fx.age_fences(s, d))[0]


def _L(s, d):
    return fx.order_transactions(s, d)


def _seg(txns: DataFrame, with_basket: bool = False) -> DataFrame:
    """RFM of ``txns`` scored with the fixed centres and its own scaler."""
    r = segments.rfm(txns, with_basket=with_basket)
    return segments.assign_segments(r, segments.SegmentModel.with_scaler_of(r, FIXED_CENTERS))


def _basket_L(s, d):
    return segments.basket_from_segmented(_seg(_L(s, d), with_basket=True))


def _seg_with(txns: DataFrame, scaler_source: DataFrame) -> DataFrame:
    """RFM of ``txns`` scored with the fixed centres, scaler of another table
    (a model fitted on unfiltered data, applied to filtered data)."""
    model = segments.SegmentModel.with_scaler_of(segments.rfm(scaler_source), FIXED_CENTERS)
    return segments.assign_segments(segments.rfm(txns), model)


def _arr_text(c="channels"):
    return F.array_join(F.col(c), "|").alias(c)


# ---------------------------------------------------------------- queries
def _q_clean_customers(s, d):
    """B1-B4.  The DATE is shown as ISO text (engines hand dates to pandas as
    different Python types)."""
    return cleaning.clean_customers(fx.raw_customers(s, d)).select(
        "customer_id", F.date_format("became_member_on", "yyyy-MM-dd").alias("became_member_on"),
        "gender", "age", "income")


def _q_clean_offers(s, d):
    o = cleaning.clean_offers(fx.raw_offers(s, d))
    return o.select("offer_id", "offer_type", "difficulty", "reward", "duration",
                    _arr_text(), F.size("channels").alias("n_channels"))


def _q_clean_events(s, d):
    return cleaning.clean_events(fx.raw_events(s, d)).select(
        "event_id", "customer_id", "event", "time", "offer_id", "amount", "event_reward")


def _q_literal_texts(s, d):
    """J7 over whole texts: every document's text, written as a Python literal
    with escapes, bare words and a tuple around it, is read back."""
    text = F.col("text")
    for raw, escape in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escape))
    literal = F.concat(F.lit("(None, '"), text, F.lit("', \"it's (None)\", True, (1, None,), )"))
    items = parse_list(literal)
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", items.alias("x"))
    return docs.select("doc_id", F.size("x").alias("n_items"), F.md5(F.col("x")[1]).alias("text_md5"),
                       F.col("x")[0].isNull().alias("none_first"),
                       F.concat_ws("|", F.col("x")[2], F.col("x")[3], F.col("x")[4]).alias("rest"))


def _lazy_event_tables(s, d):
    """B1-B11 as one lazy plan from the raw views (no materialisation)."""
    return plans.build_event_tables(fx.raw_events(s, d), fx.raw_customers(s, d),
                                    fx.raw_offers(s, d))


def _q_offer_rows(s, d):
    return _lazy_event_tables(s, d)[0].select("event_id", "customer_id", "event", "time", "offer_id", "offer_type",
                           "difficulty", "reward", "duration", _arr_text(), "gender", "age",
                           "income")


def _q_transaction_rows(s, d):
    return _lazy_event_tables(s, d)[1]


def _q_winsorized_amounts(s, d):
    return cleaning.winsorize(_L(s, d), "amount").select("event_id", "customer_id", "amount")


def _q_offers_by_type_filter(s, d):
    return filters.filter_offer_types(_O(s, d), OFFER_TYPES).select(
        "event_id", "customer_id", "offer_type")


def _q_amount_filter(s, d):
    return filters.filter_amount(_T(s, d), *TXN_AMOUNT).select("event_id", "amount")


def _q_dates_amount_filter(s, d):
    t = _T(s, d)
    return filters.filter_dates_amount(
        t, filters.bounds_of(filters.campaign_window(t, 3, 20)),
        filters.bounds_of(filters.column_bounds(t, "amount"))).select("event_id", "time", "amount")


def _q_window_types_filter(s, d):
    o = _O(s, d)
    return filters.filter_window_types(o, filters.bounds_of(filters.campaign_window(o, 5, 25)),
                                       OFFER_TYPES).select(
        "event_id", "time", "offer_type")


def _q_window_types_segments_filter(s, d):
    o = _O(s, d)
    win = filters.bounds_of(filters.campaign_window(o, 2, 28))
    o = offers.attach_segment(o, _seg(_T(s, d)))
    return filters.filter_window_types_segments(o, win, OFFER_TYPES, SEGMENTS).select(
        "event_id", "cluster")


def _q_iqr_age_filter(s, d):
    return filters.iqr_filter(_O(s, d), "age").select("event_id", "age")


def _q_offer_success_rows(s, d):
    return offers.with_offer_success(_O(s, d)).select("event_id", "offer_success")


def _q_offer_success_by_receive(s, d):
    """C7 with the customer's own receives."""
    return offers.with_offer_success(_O(s, d), anchor="customer").select("event_id", "offer_success")


def _q_success_by_offer_type(s, d):
    return offers.success_by_offer_type(_OP(s, d))


def _q_prepared_offer_events(s, d):
    return _OP(s, d).select("event_id", "offer_id", "offer_success", "age")


def _q_prepared_transactions(s, d):
    return plans.prepare_transaction_events(_T(s, d)).select(
        "event_id", "customer_id", "amount", "total_spend")


def _q_exploded_channels(s, d):
    return _OX(s, d).select("event_id", "channels")


def _q_rfm(s, d):
    return segments.rfm(_L(s, d))


def _q_rfm_points(s, d):
    return filters.rfm_points(_seg(_L(s, d)))


def _q_basket_points(s, d):
    return filters.basket_points(_basket_L(s, d))


def _q_segment_slice_filtered(s, d):
    t = _T(s, d)
    with plans.segment_bundle(
            _O(s, d), t, OFFER_TYPES, *TXN_AMOUNT,
            model=segments.SegmentModel.with_scaler_of(segments.rfm(t), FIXED_CENTERS)) as bundle:
        return filters.segment_slice(bundle["rfm"], 1)  # one frame: nothing to keep


def _q_segment_bundle_rows(s, d):
    """P5: all rows of the six frames of one bundle, in one long table.  They
    are read while the bundle keeps its RFM aggregate, which is then released."""
    t = _T(s, d)
    model = segments.SegmentModel.with_scaler_of(segments.rfm(t), FIXED_CENTERS)

    def rows(frame, key, a, b, c, cluster="'none'"):
        # the cluster as text: engines hand integers with NULLs to pandas differently
        return frame.selectExpr(f"CAST({key} AS BIGINT) AS id", f"CAST({a} AS DOUBLE) AS a", f"CAST({b} AS DOUBLE) AS b",
                                f"CAST({c} AS DOUBLE) AS c", f"coalesce(CAST({cluster} AS STRING), 'none') AS cluster")

    with plans.segment_bundle(_O(s, d), t, OFFER_TYPES, *TXN_AMOUNT, model=model) as bundle:
        shown = {"offers": ("event_id", "difficulty", "reward", "duration"),
                 "transactions": ("event_id", "amount", "age", "NULL"),
                 "rfm": ("customer_id", "recency", "frequency", "monetary", "cluster"),
                 "advanced_metrics": ("0", "clv", "churn_rate", "cac"),
                 "basket": ("customer_id", "transaction_count", "amount", "avg_basket_size", "cluster"),
                 "segment_stats": ("cluster", "avg_transactions", "avg_basket_size", "NULL", "cluster")}
        out = None
        for name in bundle:
            part = rows(bundle[name], *shown[name]).withColumn("frame", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return materialize(out)


def _q_unpivot_segment_stats(s, d):
    st = segments.segment_stats(_basket_L(s, d))
    return distributions.unpivot_metrics(st, ["cluster"], ["avg_transactions", "avg_basket_size"])


def _q_fit_segments(s, d):
    model = segments.fit_segments(segments.rfm(_L(s, d)), k=4)
    rows = [(j, *c) for j, c in enumerate(model.centers)]
    df = s.createDataFrame(rows, "cluster INT, recency DOUBLE, frequency DOUBLE, monetary DOUBLE")
    return df.select("cluster", *[F.round(c, 4).alias(c) for c in
                                  ("recency", "frequency", "monetary")])


def _q_segment_customers(s, d):
    lt = _L(s, d)
    path = scratch_path(s, f"model-{uuid.uuid4().hex}")
    plans.train_segments(lt, path)
    model = sources.load_model(s, path)
    return segments.segment_customers(filters.filter_amount(lt, *ORDER_AMOUNT), model).select(
        "customer_id", "cluster")


def _q_distinct_offer_types(s, d):
    return filters.distinct_values(_O(s, d), "offer_type")


def _q_home_kpis(s, d):
    return customers.home_kpis(_OP(s, d), _T(s, d))


def _q_customer_clv(s, d):
    return customers.customer_clv(segments.rfm(_L(s, d)))


def _q_segment_kpis(s, d):
    return segments.segment_kpis(segments.rfm(_L(s, d)))


def _q_clv_by_customer(s, d):
    return customers.customer_lifetime_value(fx.long_transactions(s, d))


def _q_top_customers(s, d):
    return customers.top_customers(customers.customer_lifetime_value(fx.long_transactions(s, d)))


def _q_drilldown_totals(s, d):
    """E33.  Rollup labels are shown as text: a subtotal row has NULL labels,
    and engines hand nullable integers to pandas as different types."""
    return customers.drilldown_totals(_seg(_L(s, d)), ["cluster", "frequency"],
                                      ["monetary", "recency"]).withColumns({
        "cluster": F.col("cluster").cast("string"),
        "frequency": F.col("frequency").cast("string"),
        "level": F.col("level").cast("int")})


def _q_assign_segments(s, d):
    return _seg(_L(s, d)).select("customer_id", "cluster")


def _q_segment_distribution(s, d):
    return segments.segment_distribution(_seg(_L(s, d)))


def _q_segment_summary(s, d):
    return segments.segment_summary(_seg(_L(s, d)))


def _q_segment_size_value(s, d):
    return segments.segment_size_value(_seg(_L(s, d)))


def _q_basket(s, d):
    """E6 from the customers' one aggregate (D2, D3 without a join)."""
    return _basket_L(s, d).select("customer_id", "transaction_count", "amount", "avg_basket_size", "cluster")


def _q_segment_stats(s, d):
    return segments.segment_stats(_basket_L(s, d))


def _segmented_offers(s, d):
    return offers.attach_segment(_OP(s, d), _seg(_T(s, d)))


def _q_offer_performance(s, d):
    return offers.offer_performance(_segmented_offers(s, d))


def _q_pivot_performance(s, d):
    return offers.pivot_performance(offers.offer_performance(_segmented_offers(s, d)),
                                    [-1, *range(len(FIXED_CENTERS))])


def _q_success_by_segment(s, d):
    return offers.success_by_segment(_segmented_offers(s, d))


def _q_channel_success_rate(s, d):
    return offers.channel_success_rate(_OP(s, d))


def _q_completion_by_channel(s, d):
    return offers.completion_by_channel(_OP(s, d))


def _q_channel_success_by_hour(s, d):
    return offers.channel_success_by_hour(_OP(s, d))


def _q_success_by_channel(s, d):
    return offers.success_by_channel(_OX(s, d))


def _q_roi_by_offer_type(s, d):
    return offers.roi_by_offer_type(_OP(s, d))


def _q_advanced_metrics(s, d):
    return customers.advanced_metrics(segments.rfm(_L(s, d)), _O(s, d))


def _q_offer_insights_filtered(s, d):
    """E15 on the page's window (C8 + C4), as the reference shows it."""
    ox, t = _OX(s, d), plans.prepare_transaction_events(_T(s, d))
    win = filters.bounds_of(filters.campaign_window(ox, 1, 30))
    fo = filters.filter_window_types(ox, win, None)
    ft = filters.filter_window_types(t, win, None)
    return offers.offer_insights(fo, ft, _seg_with(ft, _T(s, d)))


def _q_offer_insights(s, d):
    t = _T(s, d)
    return offers.offer_insights(_OX(s, d), t, _seg(t))


def _q_transaction_overview(s, d):
    return customers.transaction_overview(_T(s, d))


def _q_best_offer_type(s, d):
    """H2 over E12."""
    return offers.top_group(offers.success_by_offer_type(_OP(s, d)), "offer_type")


def _q_empty_guard(s, d):
    """C12 for a selection that has rows and one that has none."""
    o = _O(s, d)
    picked = {"some": filters.filter_offer_types(o, OFFER_TYPES), "none": filters.filter_offer_types(o, [])}
    return o.groupBy().agg(*[F.lit(filters.is_empty(df)).alias(k) for k, df in picked.items()])


def _q_renamed_success(s, d):
    """C16 over E12."""
    return filters.rename(offers.success_by_offer_type(_OP(s, d)),
                          {"offer_type": "type", "success_rate": "rate"})


def _q_describe_age(s, d):
    return distributions.describe_column(_OP(s, d), "age", method="counts")


def _q_age_group_counts(s, d):
    return distributions.age_group_counts(_OP(s, d))


def _q_age_group_share(s, d):
    return distributions.age_group_share(_OP(s, d))


def _q_success_over_time(s, d):
    return offers.success_over_time(_OP(s, d))


def _q_offer_funnel(s, d):
    return offers.offer_funnel(_OX(s, d))


def _q_time_to_redemption(s, d):
    return offers.time_to_redemption(_O(s, d))


def _q_correlation_matrix(s, d):
    return customers.correlation_matrix(_O(s, d), segments.rfm(_T(s, d)))


def _q_histogram_clv(s, d):
    return distributions.histogram(customers.customer_clv(segments.rfm(_L(s, d))), "clv")


def _q_box_rfm(s, d):
    sg = _seg(_L(s, d)).select("cluster", *[F.col(c).cast("double").alias(c)
                                            for c in segments.FEATURES])
    long = distributions.unpivot_metrics(sg, ["cluster"], list(segments.FEATURES),
                                         "variable", "value")
    return distributions.box_stats(long, "value", ["cluster", "variable"])


def _q_box_income_by_gender(s, d):
    return distributions.box_stats(_O(s, d), "income", "gender")


def _q_box_redemption(s, d):
    return distributions.box_stats(offers.time_to_redemption(_O(s, d)), "time_to_redemption",
                                   "offer_type")


def _q_density_age(s, d):
    return distributions.density_estimate(_OP(s, d), "age", method="counts")


def _q_daily_amount(s, d):
    return timeseries.resample_daily(_T(s, d))


def _q_hourly_amount(s, d):
    return timeseries.resample_hourly(_T(s, d))


def _q_weekly_amount(s, d):
    return timeseries.resample_weekly(_L(s, d))


def _q_forecast(s, d):
    daily = timeseries.resample_daily(_T(s, d), key="customer_id")
    return timeseries.forecast(daily, key="customer_id")


def _q_history_and_forecast(s, d):
    return timeseries.history_and_forecast(timeseries.resample_daily(_T(s, d)))


def _q_parquet_roundtrip(s, d):
    path = scratch_path(s, f"parquet-{uuid.uuid4().hex}")
    sources.write_parquet(_T(s, d).drop("event_date"), path)
    return sources.read_parquet(s, path, sources.TRANSACTION_EVENTS_SCHEMA)


def _q_csv_roundtrip(s, d):
    path = scratch_path(s, f"csv-{uuid.uuid4().hex}")
    sources.write_csv(fx.raw_offers(s, d), path)
    return sources.read_csv(s, path, "offer_id STRING, offer_type STRING, difficulty INT, "
                                     "reward INT, duration INT, channels STRING")


def _q_table_roundtrip(s, d):
    name = f"offer_events_{uuid.uuid4().hex[:12]}"
    path = scratch_path(s, name)
    sources.write_table(_OP(s, d).select("event_id", "customer_id", "event", "offer_id",
                                         "offer_success"),
                        name, bucket_by=(8, "customer_id"), path=path)
    return sources.read_table(s, name)


def _q_load_all_roundtrip(s, d):
    """A2-A4: event tables stored with ``time`` in hours, loaded back."""
    base = scratch_path(s, f"events-{uuid.uuid4().hex}")
    hours = micros_between(F.lit("1970-01-01 00:00:00"), "time") / F.lit(3_600_000_000.0)
    o = _O(s, d).select("event_id", "customer_id", "event", hours.alias("time"), "age")
    t = _T(s, d).select("event_id", "customer_id", "event", hours.alias("time"), "age")
    sources.write_parquet(o, f"{base}/offer_events")
    sources.write_parquet(t, f"{base}/transaction_events")
    lo, lt = sources.load_all(s, f"{base}/offer_events", f"{base}/transaction_events")
    return lo.unionByName(lt)


def _q_csv_inferred(s, d):
    """A5 with inferred types: documents written as CSV, whose quoted texts span
    lines, and read back with a type for every column and no bad record."""
    path = scratch_path(s, f"csv-inferred-{uuid.uuid4().hex}")
    docs = s.read.parquet(f"{d}/documents.parquet")
    sources.write_csv(docs.withColumn("share", F.expr("n_chars / 4"))
                      .withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 1000 AS INT))")), path)
    back = sources.read_csv_inferred(s, path)
    status = F.when(F.col(sources.BAD).isNull(), F.lit("good")).otherwise(F.lit("bad"))
    return (back.groupBy(status.alias("status"), F.typeof("doc_id").alias("id_type"), F.typeof("share").alias("share_type"),
                         F.typeof("day").alias("day_type"), F.typeof("text").alias("text_type"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum("doc_id").alias("ids"),
                 F.sum("share").alias("shares"), F.sum(F.datediff("day", F.lit("2024-01-01").cast("date"))).alias("days"),
                 F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("read_chars")))


def _q_table_replaced(s, d):
    """A table replaced by a derivation of itself, after a write that fails
    and so leaves it as it was."""
    path = scratch_path(s, f"replaced-{uuid.uuid4().hex}")
    name = f"replaced_{uuid.uuid4().hex}"
    sources.write_table(_T(s, d).select("event_id", "amount"), name, path=path)
    held = sources.read_table(s, name)
    try:
        sources.write_table(held.withColumn("amount", F.expr(
            "IF(event_id >= 0, CAST(raise_error('stopped') AS DOUBLE), 0D)")), name, path=path)
    except Exception as stopped:  # noqa: BLE001
        if "stopped" not in str(stopped):
            raise
    sources.write_table(held.withColumn("amount", F.expr("amount * 2")), name, path=path)
    return sources.read_table(s, name)


def _q_forecast_exact(s, d):
    """F4 by exact maximum likelihood, a series per customer."""
    daily = timeseries.resample_daily(_T(s, d), key="customer_id")
    return timeseries.forecast(daily, key="customer_id", method="exact")


def _q_fit_segments_parallel(s, d):
    """M2 with the k-means|| start: centres, and what they cost."""
    rfm = segments.rfm(_L(s, d))
    model = segments.fit_segments(rfm, k=4, start="parallel")
    sizes = (segments.assign_segments(rfm, model).filter("cluster IS NOT NULL")
             .groupBy("cluster").agg(F.count(F.lit(1)).alias("customers")))
    rows = [(i, *map(float, c)) for i, c in enumerate(model.centers)]
    centers = s.createDataFrame(rows, "cluster INT, recency DOUBLE, frequency DOUBLE, monetary DOUBLE")
    return sizes.join(centers, "cluster").select(
        "cluster", "customers", *[F.round(c, 4).alias(c) for c in segments.FEATURES])


def _q_age_median_cap(s, d):
    return cleaning.replace_above_with_median(fx.raw_customers(s, d), "age", 100).select(
        "customer_id", "age")


def _q_income_iqr_fill(s, d):
    return cleaning.iqr_clip_fill_median(fx.raw_customers(s, d), "income").select(
        "customer_id", "income")


def _q_segment_distribution_offers(s, d):
    return segments.segment_distribution(_segmented_offers(s, d))


def _q_histogram_total_spend(s, d):
    return distributions.histogram(customers.customer_lifetime_value(fx.long_transactions(s, d)),
                                   "total_spend")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k[3:]: v for k, v in globals().items() if k.startswith("_q_")
}


def _spark_ready(spark: SparkSession) -> SparkSession:
    ensure_conf(spark)
    # Python workers of a local master find the library wherever the session
    # was started; on a cluster it is installed (pyproject.toml) or shipped
    here, env = os.path.dirname(os.path.abspath(__file__)), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))
    return spark


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: success rate by offer type from raw events (sf0.001)."""
    return _q_success_by_offer_type(_spark_ready(spark), "/root/testdata/sf0.001")


def _corpus() -> tuple[dict, dict]:
    """Queries and SQL of the corpus operators; none where their subpackage,
    the pipeline module or a library that they need is not installed."""
    found: tuple[dict, dict] = ({}, {})
    try:
        ops = importlib.import_module("perkframe.llm.queries")
        pipeline = importlib.import_module("corpus_pipeline")
    except ImportError as missing:
        if missing.name not in ("perkframe.llm", "perkframe.llm.queries", "corpus_pipeline"):
            warnings.warn(f"corpus operators are left out: {missing}", stacklevel=2)
        return found
    found[0].update(ops.QUERIES, pipeline=pipeline.run)
    found[1].update(ops.ORACLE_SQL)
    if pipeline.ORACLE_SQL:
        found[1]["pipeline"] = pipeline.ORACLE_SQL
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(f):
        return lambda spark, sf_dir: f(_spark_ready(spark), sf_dir)
    return {k: wrap(v) for k, v in (_QUERIES | _corpus()[0]).items()}


# ---------------------------------------------------------------- oracle
_TYPES = ", ".join(f"'{t}'" for t in OFFER_TYPES)


def _seg_of(src: str, scaler_src: str | None = None) -> str:
    from checks.oracle import assign_sql
    sc = scaler_sql(rfm_sql(scaler_src or src))
    return assign_sql(rfm_sql(src), sc)


def _box_sql(rel: str, value: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"b.{x} = q.{x}" for x in keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"""
, BX AS (SELECT {k}, CAST({value} AS DOUBLE) AS v FROM {rel} WHERE {value} IS NOT NULL AND {nn}),
BQ AS (SELECT {k}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
              quantile_cont(v, 0.75) AS q3 FROM BX GROUP BY ALL)
SELECT {", ".join("q." + x for x in keys)}, q.q1, q.median, q.q3,
       min(v) FILTER (WHERE v >= q.q1 - 1.5 * (q.q3 - q.q1) AND v <= q.q3 + 1.5 * (q.q3 - q.q1))
         AS whisker_low,
       max(v) FILTER (WHERE v >= q.q1 - 1.5 * (q.q3 - q.q1) AND v <= q.q3 + 1.5 * (q.q3 - q.q1))
         AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= q.q1 - 1.5 * (q.q3 - q.q1)
                                   AND v <= q.q3 + 1.5 * (q.q3 - q.q1))) AS outliers
FROM BX b JOIN BQ q ON {on}
GROUP BY {", ".join("q." + x for x in keys)}, q.q1, q.median, q.q3"""


def _redemption_sql() -> str:
    return """(
SELECT event_id, customer_id, offer_id, offer_type,
       (epoch_us(time) - epoch_us(recv)) / 86400000000.0 AS time_to_redemption
FROM (SELECT *, last_value(CASE WHEN event = 'offer received' THEN time END IGNORE NULLS)
                OVER (PARTITION BY customer_id, offer_id ORDER BY time, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recv
      FROM O WHERE customer_id IS NOT NULL AND offer_id IS NOT NULL
        AND event IN ('offer completed', 'offer received'))
WHERE event = 'offer completed')"""


def _resample_sql(src: str, unit: str, period: str, key: str | None = None) -> str:
    kc = f"{key}, " if key else ""
    kn = f" AND {key} IS NOT NULL" if key else ""
    ks = f"s.{key}, " if key else ""
    kon = f"s.{key} = v.{key} AND " if key else ""
    return f"""(
WITH sums AS (SELECT {kc}{period} AS period, sum(amount) AS v FROM {src}
              WHERE time IS NOT NULL{kn} GROUP BY ALL),
spine AS (SELECT {kc}unnest(generate_series(min(period), max(period), INTERVAL {unit})) AS period
          FROM sums {"GROUP BY " + key if key else ""})
SELECT {ks}s.period, CAST(coalesce(v.v, 0) AS DOUBLE) AS amount
FROM spine s LEFT JOIN sums v ON {kon}s.period = v.period)"""


_DAY = "CAST(date_trunc('day', time) AS TIMESTAMP)"
_HOUR = "CAST(date_trunc('hour', time) AS TIMESTAMP)"
_WEEK = "CAST(date_trunc('week', time) AS TIMESTAMP) + INTERVAL 6 DAY"


def _forecast_sql(series: str, key: str | None) -> str:
    """F4 over a (key, period, amount) relation, CSS on the 39 x 39 grid."""
    kc = f"{key}, " if key else ""
    kj = f"a.{key} = b.{key} AND " if key else ""
    kp = f"PARTITION BY {key} " if key else ""
    return f"""
, S AS (SELECT {kc}period, amount AS y,
               amount - lag(amount) OVER ({kp}ORDER BY period) AS w,
               row_number() OVER ({kp}ORDER BY period) AS t,
               count(*) OVER ({kp.strip()}) AS n,
               last_value(period) OVER ({kp}ORDER BY period
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_period,
               last_value(amount) OVER ({kp}ORDER BY period
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS yT
        FROM {series}),
G AS (SELECT (-95 + 5 * (g // 39)) / 100.0 AS phi, (-95 + 5 * (g % 39)) / 100.0 AS theta
      FROM range(0, 1521) r(g)),
R AS (
  WITH RECURSIVE rec AS (
    SELECT {kc}phi, theta, t, w AS pw, 0.0::DOUBLE AS e, 0.0::DOUBLE AS sse, n, last_period, yT
    FROM S CROSS JOIN G WHERE t = 2 AND n >= 3
    UNION ALL
    SELECT {"a." + key + ", " if key else ""}a.phi, a.theta, b.t, b.w,
           b.w - a.phi * a.pw - a.theta * a.e,
           a.sse + (b.w - a.phi * a.pw - a.theta * a.e) * (b.w - a.phi * a.pw - a.theta * a.e),
           a.n, a.last_period, a.yT
    FROM rec a JOIN S b ON {kj}b.t = a.t + 1)
  SELECT * FROM rec),
B AS (SELECT {kc}arg_min(struct_pack(phi := phi, theta := theta, wT := pw, eT := e,
                                     yT := yT, lp := last_period),
                         struct_pack(sse := sse, phi := phi, theta := theta)) AS b
      FROM R WHERE t = n GROUP BY ALL)
SELECT {kc}CAST(b.lp + to_days(CAST(h AS INTEGER)) AS TIMESTAMP) AS date,
       b.yT + (b.phi * b.wT + b.theta * b.eT) * (1.0 - pow(b.phi, h)) / (1.0 - b.phi) AS forecast
FROM B CROSS JOIN range(1, 31) r(h)"""


def _oracles() -> dict[str, str]:
    T_F = f"(SELECT * FROM T WHERE amount BETWEEN {TXN_AMOUNT[0]} AND {TXN_AMOUNT[1]})"
    L_F = f"(SELECT * FROM L WHERE amount BETWEEN {ORDER_AMOUNT[0]} AND {ORDER_AMOUNT[1]})"
    SEGO = (f"(SELECT OP.* EXCLUDE (cluster_), CAST(coalesce(cluster_, -1) AS INTEGER) AS cluster "
            f"FROM (SELECT OP.*, s.cluster AS cluster_ FROM OP LEFT JOIN SEG_T s "
            f"ON OP.customer_id = s.customer_id) OP)")
    BASKET = """(SELECT a.customer_id, a.transaction_count, a.amount,
                    a.amount / a.transaction_count AS avg_basket_size, s.cluster
             FROM (SELECT customer_id, count(*) AS transaction_count,
                          coalesce(sum(amount), 0.0) AS amount
                   FROM L WHERE customer_id IS NOT NULL GROUP BY customer_id) a
             JOIN SEG_L s ON a.customer_id = s.customer_id)"""
    SEG_STATS = f"""(SELECT cluster,
        CAST(round_even(CAST(avg(transaction_count) AS DECIMAL(38, 10)), 2) AS DOUBLE)
          AS avg_transactions,
        CAST(round_even(CAST(avg(avg_basket_size) AS DECIMAL(38, 10)), 2) AS DOUBLE)
          AS avg_basket_size
      FROM {BASKET} GROUP BY cluster)"""
    CLV = """(SELECT customer_id, coalesce(sum(amount), 0.0) AS total_spend,
                 avg(age) AS customer_age,
                 coalesce(sum(amount), 0.0) / nullif(avg(age), 0) AS annual_value
          FROM (SELECT L.*, c.age FROM L LEFT JOIN clean_customers c
                ON L.customer_id = c.customer_id)
          WHERE customer_id IS NOT NULL GROUP BY customer_id)"""
    RATE = "avg(CAST(offer_success AS INTEGER))"
    AGEG = """CASE WHEN age > 0 AND age <= 30 THEN '18-30' WHEN age > 30 AND age <= 45 THEN '31-45'
                   WHEN age > 45 AND age <= 60 THEN '46-60' WHEN age > 60 AND age <= 100 THEN '60+'
              END"""
    AGE_COUNTS = f"""(SELECT g.age_group, g.offer_type, coalesce(c.n, 0) AS count
        FROM (SELECT DISTINCT offer_type, unnest(['18-30', '31-45', '46-60', '60+']) AS age_group
              FROM OP WHERE offer_type IS NOT NULL) g
        LEFT JOIN (SELECT {AGEG} AS age_group, offer_type, count(*) AS n FROM OP
                   WHERE {AGEG} IS NOT NULL AND offer_type IS NOT NULL GROUP BY ALL) c
          ON g.age_group = c.age_group AND g.offer_type = c.offer_type)"""
    out = {
        "clean_customers": q("SELECT customer_id, strftime(became_member_on, '%Y-%m-%d') "
                             "AS became_member_on, gender, age, income FROM clean_customers"),
        "clean_offers": q("SELECT offer_id, offer_type, difficulty, reward, duration, "
                          "array_to_string(channels, '|') AS channels, "
                          "CAST(len(channels) AS INTEGER) AS n_channels FROM clean_offers"),
        "clean_events": q("SELECT event_id, customer_id, event, time, offer_id, amount, "
                          "event_reward FROM clean_events"),
        "offer_rows": q("SELECT event_id, customer_id, event, time, offer_id, offer_type, "
                        "difficulty, reward, duration, array_to_string(channels, '|') AS channels, "
                        "gender, age, income FROM O"),
        "transaction_rows": q("SELECT * FROM T"),
        "winsorized_amounts": q("""
SELECT event_id, customer_id,
       CASE WHEN amount IS NULL THEN NULL WHEN amount < p1 THEN p1 WHEN amount > p99 THEN p99
            ELSE amount END AS amount
FROM L CROSS JOIN (SELECT quantile_cont(amount, 0.01) AS p1, quantile_cont(amount, 0.99) AS p99
                   FROM L)"""),
        "offers_by_type_filter": q(f"SELECT event_id, customer_id, offer_type FROM O "
                                   f"WHERE offer_type IN ({_TYPES})"),
        "amount_filter": q(f"SELECT event_id, amount FROM {T_F}"),
        "dates_amount_filter": q("""
SELECT event_id, time, amount FROM T CROSS JOIN
  (SELECT CAST(min(time) AS DATE) AS d0, floor(max(amount)) AS hi FROM T) w
WHERE CAST(time AS DATE) BETWEEN w.d0 + 2 AND w.d0 + 19 AND amount BETWEEN 0 AND w.hi"""),
        "window_types_filter": q(f"""
SELECT event_id, time, offer_type FROM O CROSS JOIN (SELECT CAST(min(time) AS DATE) AS d0 FROM O) w
WHERE time >= CAST(w.d0 + 4 AS TIMESTAMP) AND time <= CAST(w.d0 + 24 AS TIMESTAMP)
  AND offer_type IN ({_TYPES})"""),
        "window_types_segments_filter": q(f"""
SELECT event_id, cluster FROM (
  SELECT O.*, CAST(coalesce(s.cluster, -1) AS INTEGER) AS cluster
  FROM O LEFT JOIN SEG_T s ON O.customer_id = s.customer_id) x
CROSS JOIN (SELECT CAST(min(time) AS DATE) AS d0 FROM O) w
WHERE time >= CAST(w.d0 + 1 AS TIMESTAMP) AND time <= CAST(w.d0 + 27 AS TIMESTAMP)
  AND offer_type IN ({_TYPES}) AND cluster IN ({", ".join(map(str, SEGMENTS))})"""),
        "iqr_age_filter": q("""
SELECT event_id, age FROM O CROSS JOIN
  (SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM O) f
WHERE age >= q1 - 1.5 * (q3 - q1) AND age <= q3 + 1.5 * (q3 - q1)"""),
        "offer_success_rows": q("SELECT event_id, offer_success FROM OS"),
        "offer_success_by_receive": q("""
, E AS (SELECT *, CASE event WHEN 'offer received' THEN 0 ELSE 1 END AS stage FROM O
        WHERE event IN ('offer received', 'offer completed') AND customer_id IS NOT NULL
          AND offer_id IS NOT NULL AND time IS NOT NULL),
R AS (SELECT *, max(CASE WHEN stage = 0 THEN time END) OVER (PARTITION BY customer_id, offer_id
                    ORDER BY time, stage, event_id ROWS UNBOUNDED PRECEDING) AS recv FROM E),
D AS (SELECT *, row_number() OVER (PARTITION BY customer_id, offer_id, recv ORDER BY time, event_id) AS k
      FROM R WHERE stage = 1 AND recv IS NOT NULL)
SELECT O.event_id, coalesce(D.k = 1 AND D.time <= D.recv + to_days(D.duration), false) AS offer_success
FROM O LEFT JOIN D ON O.event_id = D.event_id"""),
        "literal_texts": q("""
SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE 5 END AS n_items, md5(text) AS text_md5,
       true AS none_first, 'it''s (None)|true|[1,null]' AS rest FROM documents"""),
        "csv_inferred": q("""
SELECT 'good' AS status, 'bigint' AS id_type, 'double' AS share_type, 'date' AS day_type, 'string' AS text_type,
       count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS ids,
       sum(n_chars / 4) AS shares, CAST(sum(doc_id % 1000) AS BIGINT) AS days,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS read_chars FROM documents"""),
        "table_replaced": q("SELECT event_id, amount * 2 AS amount FROM T"),
        "segment_bundle_rows": q(f"""
, S AS MATERIALIZED (SELECT * FROM {_seg_of(T_F, 'T')}),
FO AS (SELECT * FROM O WHERE offer_type IN ({_TYPES})),
B AS (SELECT a.customer_id, a.n, a.amount, a.amount / a.n AS size, S.cluster
      FROM (SELECT customer_id, count(*) AS n, coalesce(sum(amount), 0.0) AS amount FROM {T_F}
            WHERE customer_id IS NOT NULL GROUP BY customer_id) a JOIN S ON a.customer_id = S.customer_id)
SELECT 'offers' AS frame, event_id AS id, CAST(difficulty AS DOUBLE) AS a, CAST(reward AS DOUBLE) AS b,
       CAST(duration AS DOUBLE) AS c, 'none' AS cluster FROM FO
UNION ALL SELECT 'transactions', event_id, amount, CAST(age AS DOUBLE), NULL, 'none' FROM {T_F}
UNION ALL SELECT 'rfm', customer_id, recency, frequency, monetary, coalesce(CAST(cluster AS VARCHAR), 'none') FROM S
UNION ALL SELECT 'basket', customer_id, n, amount, size, coalesce(CAST(cluster AS VARCHAR), 'none') FROM B
UNION ALL SELECT 'advanced_metrics', 0, avg(monetary * frequency), avg(CAST(recency > 30 AS INTEGER)),
       CASE WHEN count_if(frequency = 1) > 0
            THEN (SELECT CAST(coalesce(sum(reward), 0) AS DOUBLE) FROM FO) / count_if(frequency = 1) ELSE 0.0 END,
       'none' FROM S
UNION ALL SELECT 'segment_stats', cluster, CAST(round_even(CAST(avg(n) AS DECIMAL(38, 10)), 2) AS DOUBLE),
       CAST(round_even(CAST(avg(size) AS DECIMAL(38, 10)), 2) AS DOUBLE), NULL,
       coalesce(CAST(cluster AS VARCHAR), 'none') FROM B GROUP BY cluster"""),
        "success_by_offer_type": q(f"SELECT offer_type, {RATE} AS success_rate FROM OP "
                                   f"WHERE offer_type IS NOT NULL GROUP BY offer_type"),
        "prepared_offer_events": q("SELECT event_id, offer_id, offer_success, age FROM OP"),
        "prepared_transactions": q("""
SELECT T.event_id, T.customer_id, T.amount, s.total_spend FROM T LEFT JOIN
  (SELECT customer_id, coalesce(sum(amount), 0.0) AS total_spend FROM T
   WHERE customer_id IS NOT NULL GROUP BY customer_id) s ON T.customer_id = s.customer_id"""),
        "exploded_channels": q("SELECT event_id, channels FROM OX"),
        "rfm": q("SELECT * FROM RFM_L"),
        "rfm_points": q("SELECT customer_id, recency, frequency, monetary, cluster FROM SEG_L"),
        "basket_points": q(f"SELECT customer_id, transaction_count, avg_basket_size, cluster "
                           f"FROM {BASKET}"),
        "segment_slice_filtered": q(f"SELECT * FROM {_seg_of(T_F, 'T')} WHERE cluster = 1"),
        "unpivot_segment_stats": q(f"""
SELECT cluster, 'avg_transactions' AS metric, avg_transactions AS value FROM {SEG_STATS}
UNION ALL
SELECT cluster, 'avg_basket_size' AS metric, avg_basket_size AS value FROM {SEG_STATS}"""),
        "fit_segments": q(f"SELECT c AS cluster, round(c0, 4) AS recency, round(c1, 4) AS frequency,"
                          f" round(c2, 4) AS monetary FROM KF",
                          kmeans_sql("RFM_L", 4, KMEANS_ROUNDS)),
        "segment_customers": q(f"""
SELECT r.customer_id, CAST(arg_min(k.c, struct_pack(d := (r.z0 - k.c0) * (r.z0 - k.c0)
        + (r.z1 - k.c1) * (r.z1 - k.c1) + (r.z2 - k.c2) * (r.z2 - k.c2), c := k.c)) AS INTEGER)
       AS cluster
FROM (SELECT customer_id, (CAST(recency AS DOUBLE) - m0) / s0 AS z0,
             (CAST(frequency AS DOUBLE) - m1) / s1 AS z1,
             (CAST(monetary AS DOUBLE) - m2) / s2 AS z2
      FROM {rfm_sql(L_F)} CROSS JOIN KS) r
CROSS JOIN KF k GROUP BY r.customer_id""", kmeans_sql("RFM_L", 4, KMEANS_ROUNDS)),
        "distinct_offer_types": q("SELECT DISTINCT offer_type FROM O"),
        "home_kpis": q("""
SELECT o.total_customers, o.conversion_rate, t.total_revenue, t.avg_transaction FROM
 (SELECT count(DISTINCT customer_id) + max(CAST(customer_id IS NULL AS INTEGER)) AS total_customers,
         count_if(event = 'offer completed') / nullif(count_if(event = 'offer received'), 0)
           AS conversion_rate FROM OP) o
CROSS JOIN (SELECT coalesce(sum(amount), 0.0) AS total_revenue, avg(amount) AS avg_transaction
            FROM T) t"""),
        "customer_clv": q("SELECT customer_id, monetary * frequency AS clv FROM RFM_L"),
        "segment_kpis": q("SELECT count(*) AS customers, avg(recency) AS avg_recency, "
                          "avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary "
                          "FROM RFM_L"),
        "clv_by_customer": q(f"SELECT * FROM {CLV}"),
        "top_customers": q(f"SELECT customer_id, total_spend, annual_value FROM {CLV} "
                           f"ORDER BY total_spend DESC, customer_id LIMIT 10"),
        "drilldown_totals": q("""
SELECT CAST(cluster AS VARCHAR) AS cluster, CAST(frequency AS VARCHAR) AS frequency,
       sum(monetary) AS sum_monetary, CAST(sum(recency) AS BIGINT) AS sum_recency,
       count(*) AS rows, CAST(GROUPING(cluster, frequency) AS INTEGER) AS level
FROM SEG_L GROUP BY ROLLUP (cluster, frequency)"""),
        "assign_segments": q("SELECT customer_id, cluster FROM SEG_L"),
        "segment_distribution": q("SELECT cluster, count(*) AS count FROM SEG_L "
                                  "WHERE cluster IS NOT NULL GROUP BY cluster"),
        "segment_summary": q("SELECT cluster, avg(recency) AS recency, avg(frequency) AS frequency,"
                             " avg(monetary) AS monetary FROM SEG_L GROUP BY cluster"),
        "segment_size_value": q("SELECT cluster, count(*) AS segment_size, "
                                "avg(monetary) AS avg_monetary FROM SEG_L GROUP BY cluster"),
        "basket": q(f"SELECT * FROM {BASKET}"),
        "segment_stats": q(f"SELECT * FROM {SEG_STATS}"),
        "offer_performance": q(f"SELECT offer_type, cluster, {RATE} AS conversion_rate, "
                               f"count(offer_success) AS total_offers FROM {SEGO} "
                               f"WHERE offer_type IS NOT NULL GROUP BY ALL"),
        "pivot_performance": q(f"""
SELECT offer_type,
       first(r) FILTER (WHERE cluster = -1) AS cluster_m1, first(r) FILTER (WHERE cluster = 0) AS cluster_0,
       first(r) FILTER (WHERE cluster = 1) AS cluster_1, first(r) FILTER (WHERE cluster = 2) AS cluster_2,
       first(r) FILTER (WHERE cluster = 3) AS cluster_3
FROM (SELECT offer_type, cluster, {RATE} AS r FROM {SEGO} WHERE offer_type IS NOT NULL GROUP BY ALL)
GROUP BY offer_type"""),
        "success_by_segment": q(f"SELECT cluster, {RATE} AS success_rate FROM {SEGO} "
                                f"GROUP BY cluster"),
        "channel_success_rate": q(f"SELECT channels AS channel, {RATE} AS success_rate FROM OX "
                                  f"WHERE channels IS NOT NULL GROUP BY channels"),
        "completion_by_channel": q("SELECT channels, offer_success, count(offer_id) AS offer_count "
                                   "FROM OX WHERE channels IS NOT NULL GROUP BY ALL"),
        "channel_success_by_hour": q(f"SELECT CAST(hour(time) AS INTEGER) AS hour, channels, "
                                     f"{RATE} AS success_rate FROM OX WHERE channels IS NOT NULL "
                                     f"AND time IS NOT NULL GROUP BY ALL"),
        "success_by_channel": q(f"SELECT channels, {RATE} AS success_rate FROM OX "
                                f"WHERE channels IS NOT NULL GROUP BY channels"),
        "roi_by_offer_type": q("""
SELECT offer_type, CAST((sum(reward) - sum(difficulty)) AS DOUBLE) / nullif(sum(difficulty), 0) AS roi
FROM OP WHERE offer_type IS NOT NULL GROUP BY offer_type"""),
        "advanced_metrics": q(f"""
SELECT r.clv, r.churn_rate,
       CASE WHEN r.n_new > 0 THEN CAST(o.spend AS DOUBLE) / r.n_new ELSE 0.0 END AS cac
FROM (SELECT avg(monetary * frequency) AS clv, avg(CAST(recency > 30 AS INTEGER)) AS churn_rate,
             count_if(frequency = 1) AS n_new FROM {rfm_sql("L")}) r
CROSS JOIN (SELECT coalesce(sum(reward), 0) AS spend FROM O) o"""),
        "offer_insights_filtered": q("""
, W AS (SELECT CAST(CAST(min(time) AS DATE) AS TIMESTAMP) AS ws,
               CAST(CAST(min(time) AS DATE) + 29 AS TIMESTAMP) AS we FROM OX),
FO AS (SELECT OX.* FROM OX CROSS JOIN W WHERE time >= ws AND time <= we),
FT AS (SELECT T.* FROM T CROSS JOIN W WHERE time >= ws AND time <= we),
FSEG AS (SELECT * FROM """ + _seg_of("FT", "T") + """),
FOS AS (SELECT FO.*, CAST(coalesce(s.cluster, -1) AS INTEGER) AS cl FROM FO
        LEFT JOIN FSEG s ON FO.customer_id = s.customer_id),
BT AS (SELECT arg_min(offer_type, struct_pack(a := -r, b := offer_type)) AS k, max(r) AS r FROM
       (SELECT offer_type, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS
        WHERE offer_type IS NOT NULL GROUP BY ALL)),
BS AS (SELECT arg_min(cl, struct_pack(a := -r, b := cl)) AS k, max(r) AS r FROM
       (SELECT cl, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS GROUP BY ALL)),
BC AS (SELECT arg_min(channels, struct_pack(a := -r, b := channels)) AS k, max(r) AS r FROM
       (SELECT channels, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS
        WHERE channels IS NOT NULL GROUP BY ALL))
SELECT BT.k AS top_offer_type, BT.r AS top_offer_type_rate, BS.k AS top_segment,
       BS.r AS top_segment_rate, BC.k AS top_channel, BC.r AS top_channel_rate,
       (SELECT coalesce(sum(amount), 0.0) FROM FT) AS total_revenue,
       (SELECT avg(amount) FROM FT) AS avg_transaction_value,
       (SELECT count(*) FROM FO) AS total_offers,
       (SELECT avg(CAST(offer_success AS INTEGER)) FROM FO) AS offer_completion_rate,
       (SELECT count(DISTINCT customer_id) FROM FO) AS total_customers_impacted
FROM BT, BS, BC"""),
        "offer_insights": q("""
, FO AS (SELECT * FROM OX),
FT AS (SELECT * FROM T),
FSEG AS (SELECT * FROM """ + _seg_of("T") + """),
FOS AS (SELECT FO.*, CAST(coalesce(s.cluster, -1) AS INTEGER) AS cl FROM FO
        LEFT JOIN FSEG s ON FO.customer_id = s.customer_id),
BT AS (SELECT arg_min(offer_type, struct_pack(a := -r, b := offer_type)) AS k, max(r) AS r FROM
       (SELECT offer_type, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS
        WHERE offer_type IS NOT NULL GROUP BY ALL)),
BS AS (SELECT arg_min(cl, struct_pack(a := -r, b := cl)) AS k, max(r) AS r FROM
       (SELECT cl, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS GROUP BY ALL)),
BC AS (SELECT arg_min(channels, struct_pack(a := -r, b := channels)) AS k, max(r) AS r FROM
       (SELECT channels, avg(CAST(offer_success AS INTEGER)) AS r FROM FOS
        WHERE channels IS NOT NULL GROUP BY ALL))
SELECT BT.k AS top_offer_type, BT.r AS top_offer_type_rate, BS.k AS top_segment,
       BS.r AS top_segment_rate, BC.k AS top_channel, BC.r AS top_channel_rate,
       (SELECT coalesce(sum(amount), 0.0) FROM FT) AS total_revenue,
       (SELECT avg(amount) FROM FT) AS avg_transaction_value,
       (SELECT count(*) FROM FO) AS total_offers,
       (SELECT avg(CAST(offer_success AS INTEGER)) FROM FO) AS offer_completion_rate,
       (SELECT count(DISTINCT customer_id) FROM FO) AS total_customers_impacted
FROM BT, BS, BC"""),
        "transaction_overview": q("""
SELECT count(*) AS total_transactions, coalesce(sum(amount), 0.0) AS total_revenue,
       avg(amount) AS avg_transaction_value FROM T"""),
        "best_offer_type": q(f"""
SELECT arg_min(offer_type, struct_pack(a := -r, b := offer_type)) AS offer_type, max(r) AS success_rate
FROM (SELECT offer_type, {RATE} AS r FROM OP WHERE offer_type IS NOT NULL GROUP BY offer_type)"""),
        "empty_guard": q(f"SELECT count(*) = 0 AS some, true AS none FROM O WHERE offer_type IN ({_TYPES})"),
        "renamed_success": q(f"SELECT offer_type AS type, {RATE} AS rate FROM OP "
                             f"WHERE offer_type IS NOT NULL GROUP BY offer_type"),
        "describe_age": q("""
SELECT statistic, value FROM (
  SELECT CAST(count(age) AS DOUBLE) AS "count", avg(age) AS "mean", stddev_samp(age) AS "std",
         min(age) AS "min", quantile_cont(age, 0.25) AS "25%", quantile_cont(age, 0.5) AS "50%",
         quantile_cont(age, 0.75) AS "75%", max(age) AS "max" FROM OP)
UNPIVOT INCLUDE NULLS (value FOR statistic IN ("count", "mean", "std", "min", "25%", "50%", "75%", "max"))"""),
        "age_group_counts": q(f"SELECT * FROM {AGE_COUNTS}"),
        "age_group_share": q(f"SELECT age_group, offer_type, count, CAST(count AS DOUBLE) / "
                             f"nullif(sum(count) OVER (PARTITION BY age_group), 0) AS percentage "
                             f"FROM {AGE_COUNTS}"),
        "success_over_time": q(f"SELECT time, offer_type, {RATE} AS success_rate FROM OP "
                               f"WHERE time IS NOT NULL AND offer_type IS NOT NULL GROUP BY ALL"),
        "offer_funnel": q("SELECT event, count(*) AS count, count(*) / max(count(*)) OVER () "
                          "AS percent_initial FROM OX WHERE event IS NOT NULL GROUP BY event"),
        "time_to_redemption": q(f"SELECT * FROM {_redemption_sql()}"),
        "correlation_matrix": q(f"""
, M AS (SELECT CAST(o.age AS DOUBLE) AS age, o.income, CAST(r.recency AS DOUBLE) AS recency,
               CAST(r.frequency AS DOUBLE) AS frequency, r.monetary
        FROM O o
        JOIN {rfm_sql("T")} r ON o.customer_id = r.customer_id),
V AS (SELECT unnest(['age', 'income', 'recency', 'frequency', 'monetary']) AS v,
             generate_subscripts(['age', 'income', 'recency', 'frequency', 'monetary'], 1) AS i),
C AS (SELECT * FROM (SELECT
   CASE WHEN stddev_pop(age) > 0 THEN 1.0 END AS "age|age", corr(age, income) AS "age|income",
   corr(age, recency) AS "age|recency", corr(age, frequency) AS "age|frequency",
   corr(age, monetary) AS "age|monetary",
   CASE WHEN stddev_pop(income) > 0 THEN 1.0 END AS "income|income",
   corr(income, recency) AS "income|recency", corr(income, frequency) AS "income|frequency",
   corr(income, monetary) AS "income|monetary",
   CASE WHEN stddev_pop(recency) > 0 THEN 1.0 END AS "recency|recency",
   corr(recency, frequency) AS "recency|frequency", corr(recency, monetary) AS "recency|monetary",
   CASE WHEN stddev_pop(frequency) > 0 THEN 1.0 END AS "frequency|frequency",
   corr(frequency, monetary) AS "frequency|monetary",
   CASE WHEN stddev_pop(monetary) > 0 THEN 1.0 END AS "monetary|monetary" FROM M)
 UNPIVOT INCLUDE NULLS (corr FOR pair IN (COLUMNS(*))))
SELECT split_part(pair, '|', 1) AS var1, split_part(pair, '|', 2) AS var2, corr FROM C
UNION ALL
SELECT split_part(pair, '|', 2) AS var1, split_part(pair, '|', 1) AS var2, corr FROM C
WHERE split_part(pair, '|', 1) <> split_part(pair, '|', 2)"""),
        "histogram_clv": q("""
, X AS (SELECT monetary * frequency AS x FROM RFM_L WHERE monetary * frequency IS NOT NULL),
S AS (SELECT (max(x) - min(x)) / 20.0 AS span FROM X),
P AS (SELECT CASE WHEN span <= 0 THEN 1.0 ELSE
        pow(10.0, floor(log10(span))) * CASE WHEN span / pow(10.0, floor(log10(span))) <= 1 THEN 1.0
          WHEN span / pow(10.0, floor(log10(span))) <= 2 THEN 2.0
          WHEN span / pow(10.0, floor(log10(span))) <= 5 THEN 5.0 ELSE 10.0 END END AS step FROM S)
SELECT floor(x / step) * step AS bin_start, floor(x / step) * step + step AS bin_end,
       count(*) AS count
FROM X CROSS JOIN P GROUP BY floor(x / step) * step, step"""),
        "box_rfm": q(", LONGV AS (SELECT * FROM (SELECT cluster, CAST(recency AS DOUBLE) AS recency, "
                     "CAST(frequency AS DOUBLE) AS frequency, monetary FROM SEG_L) "
                     "UNPIVOT INCLUDE NULLS (value FOR variable IN (recency, frequency, monetary)))"
                     + _box_sql("LONGV", "value", ["cluster", "variable"])),
        "box_income_by_gender": q(", OO AS (SELECT * FROM O)"
                                  + _box_sql("OO", "income", ["gender"])),
        "box_redemption": q(f", RD AS (SELECT * FROM {_redemption_sql()})"
                            + _box_sql("RD", "time_to_redemption", ["offer_type"])),
        "density_age": q("""
, ST AS (SELECT min(age) AS lo, max(age) AS hi, count(age) AS n, stddev_samp(age) AS sd,
                quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM OP),
H AS (SELECT lo, hi, n, 1.06 * CASE WHEN (q3 - q1) / 1.34 > 0 THEN least(sd, (q3 - q1) / 1.34)
                                    ELSE sd END * pow(CAST(n AS DOUBLE), -0.2) AS h FROM ST),
A AS (SELECT CAST(age AS DOUBLE) AS a, count(*) AS w FROM OP WHERE age IS NOT NULL GROUP BY 1),
GR AS (SELECT i, lo + (hi - lo) * i / 99.0 AS g, h, n FROM H CROSS JOIN range(0, 100) r(i))
SELECT GR.g AS age,
       sum(A.w * exp(-0.5 * pow((GR.g - A.a) / GR.h, 2.0))) / (CAST(GR.n AS DOUBLE) * GR.h * sqrt(2 * pi()))
         AS density
FROM GR CROSS JOIN A GROUP BY GR.i, GR.g, GR.h, GR.n"""),
        "daily_amount": q(f"SELECT * FROM {_resample_sql('T', '1 DAY', _DAY)}"),
        "hourly_amount": q(f"SELECT * FROM {_resample_sql('T', '1 HOUR', _HOUR)}"),
        "weekly_amount": q(f"SELECT * FROM {_resample_sql('L', '7 DAY', _WEEK)}"),
        "forecast": q(f", DS AS (SELECT * FROM "
                      f"{_resample_sql('T', '1 DAY', _DAY, 'customer_id')})"
                      + _forecast_sql("DS", "customer_id")),
        "history_and_forecast": q(f", DS AS (SELECT * FROM {_resample_sql('T', '1 DAY', _DAY)})"
                                  + _forecast_sql("DS", None).replace(
                                      "SELECT CAST(b.lp", "SELECT 'forecast' AS kind, CAST(b.lp", 1)
                                  .replace(" AS forecast\nFROM B", " AS value\nFROM B", 1)
                                  + "\nUNION ALL SELECT 'actual' AS kind, period AS date, "
                                    "amount AS value FROM DS"),
        "parquet_roundtrip": q("SELECT * FROM T"),
        "load_all_roundtrip": q("SELECT event_id, customer_id, event, time, age FROM O "
                                "UNION ALL SELECT event_id, customer_id, event, time, age FROM T"),
        "age_median_cap": q("""
SELECT customer_id, CASE WHEN age > 100 THEN (SELECT quantile_cont(age, 0.5) FROM raw_customers)
                         ELSE CAST(age AS DOUBLE) END AS age
FROM raw_customers"""),
        "income_iqr_fill": q("SELECT customer_id, income FROM clean_customers"),
        "segment_distribution_offers": q(f"SELECT cluster, count(*) AS count FROM {SEGO} "
                                         f"GROUP BY cluster"),
        "histogram_total_spend": q(f"""
, X AS (SELECT total_spend AS x FROM {CLV} WHERE total_spend IS NOT NULL),
S AS (SELECT (max(x) - min(x)) / 20.0 AS span FROM X),
P AS (SELECT CASE WHEN span <= 0 THEN 1.0 ELSE
        pow(10.0, floor(log10(span))) * CASE WHEN span / pow(10.0, floor(log10(span))) <= 1 THEN 1.0
          WHEN span / pow(10.0, floor(log10(span))) <= 2 THEN 2.0
          WHEN span / pow(10.0, floor(log10(span))) <= 5 THEN 5.0 ELSE 10.0 END END AS step FROM S)
SELECT floor(x / step) * step AS bin_start, floor(x / step) * step + step AS bin_end,
       count(*) AS count
FROM X CROSS JOIN P GROUP BY floor(x / step) * step, step"""),
        "csv_roundtrip": q("SELECT * FROM raw_offers"),
        "table_roundtrip": q("SELECT event_id, customer_id, event, offer_id, offer_success FROM OP"),
    }
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _oracles().items() if k in _QUERIES} | _corpus()[1]
