"""Customer-level operators: totals on rows, KPIs, lifetime value, churn /
acquisition metrics, correlation, drill-down totals, top customers.

Per-customer work is a ``groupBy(customer_id)`` with map-side partial
aggregation; "value on every row" (G2) is that aggregate joined back rather
than a window, so a customer holding a third of the rows is combined
map-side and the join's hot partition is split by AQE instead of one task
sorting a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine one-row aggregates (global aggregates) into a single row."""
    from ..functions import attach_scalars
    out = parts[0]
    for p in parts[1:]:
        out = attach_scalars(out, p)
    return out


def with_customer_total(df: DataFrame, key: str = "customer_id", amount: str = "amount",
                        name: str = "total_spend") -> DataFrame:
    """Per-customer sum of ``amount`` on every row (NULL key -> NULL)."""
    totals = (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(name)))
    return df.join(totals, key, "left")


def home_kpis(offers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Total customers (distinct, a NULL id counted once), completed /
    received, total and mean transaction amount; one row."""
    o = offers.agg(
        (F.count_distinct("customer_id")
         + F.max(F.col("customer_id").isNull().cast("int"))).alias("total_customers"),
        F.try_divide(F.count_if(F.col("event") == "offer completed"),
                     F.count_if(F.col("event") == "offer received")).cast("double")
        .alias("conversion_rate"),
    )
    t = transactions.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_revenue"),
                         F.avg("amount").alias("avg_transaction"))
    return one_row(o, t)


def customer_lifetime_value(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """E5: per customer total_spend, customer_age (mean), annual_value = spend / age (Q11)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_spend"),
                 F.avg("age").alias("customer_age"))
            .withColumn("annual_value", safe_ratio("total_spend", "customer_age")))


def top_customers(clv: DataFrame, n: int = 10, by: str = "total_spend",
                  key: str = "customer_id") -> DataFrame:
    """H1: the ``n`` largest by ``by`` (ties -> smaller key), projected as C17.

    ``orderBy().limit()`` plans ``TakeOrderedAndProject``: a per-partition
    top-n, then a merge of n rows per partition.
    """
    from .filters import select_if_present
    top = clv.orderBy(F.col(by).desc(), F.col(key)).limit(n)
    return select_if_present(top, [key, by, "annual_value"], key)


def advanced_metrics(rfm: DataFrame, offers: DataFrame, churn_days: int = 30) -> DataFrame:
    """One row: clv (mean monetary*frequency), churn_rate (share with
    recency > churn_days, Q9), cac (reward over all offer rows / customers
    with frequency 1; 0 when there are none, Q15)."""
    r = rfm.agg(
        F.avg(F.col("monetary") * F.col("frequency")).alias("clv"),
        F.avg((F.col("recency") > F.lit(churn_days)).cast("int")).cast("double").alias("churn_rate"),
        F.count_if(F.col("frequency") == 1).alias("_new"),
    )
    spend = offers.agg(F.coalesce(F.sum("reward"), F.lit(0)).cast("double").alias("_spend"))
    out = one_row(r, spend)
    return out.select("clv", "churn_rate",
                      F.when(F.col("_new") > 0, F.col("_spend") / F.col("_new"))
                      .otherwise(F.lit(0.0)).alias("cac"))


def customer_clv(rfm: DataFrame) -> DataFrame:
    """Per customer clv = monetary * frequency."""
    return rfm.select("customer_id", (F.col("monetary") * F.col("frequency")).alias("clv"))


def transaction_overview(df: DataFrame) -> DataFrame:
    """Count, sum and mean of amount; one row."""
    return df.agg(F.count(F.lit(1)).alias("total_transactions"),
                  F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_revenue"),
                  F.avg("amount").alias("avg_transaction_value"))


def correlation_matrix(offers: DataFrame, rfm: DataFrame,
                       columns: Sequence[str] = ("age", "income", "recency", "frequency",
                                                 "monetary"),
                       key: str = "customer_id") -> DataFrame:
    """Pearson correlation in long form (var1, var2, corr), pairwise
    complete (a row counts for a pair when both values are non-null).

    One aggregate computes every pair (``corr`` is algebraic, combined
    map-side); the result is unpivoted and mirrored.  A diagonal entry is 1
    when the column varies, else NULL.
    """
    cols = list(columns)
    rcols = [c for c in cols if c in rfm.columns and c not in offers.columns]
    merged = offers.join(rfm.select(key, *rcols), key, "inner")
    aggs = []
    for i, a in enumerate(cols):
        aggs.append(F.when(F.stddev_pop(F.col(a).cast("double")) > 0, F.lit(1.0))
                    .alias(f"{a}|{a}"))
        for b in cols[i + 1:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}"))
    wide = merged.agg(*aggs)
    pairs = [c for c in wide.columns]
    long = wide.unpivot([], pairs, "pair", "corr")
    a, b = F.split_part("pair", F.lit("|"), F.lit(1)), F.split_part("pair", F.lit("|"), F.lit(2))
    upper = long.select(a.alias("var1"), b.alias("var2"), "corr")
    lower = long.filter(a != b).select(b.alias("var1"), a.alias("var2"), "corr")
    return upper.unionByName(lower)


def drilldown_totals(df: DataFrame, group_cols: Sequence[str], sum_cols: Sequence[str]
                     ) -> DataFrame:
    """Nested grouping with a sum at every level (grid row grouping).

    ``rollup`` gives every prefix of ``group_cols`` plus the grand total;
    ``level`` is Spark's ``grouping_id`` (0 = finest).
    """
    return (df.rollup(*group_cols)
            .agg(*[F.sum(c).alias(f"sum_{c}") for c in sum_cols],
                 F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level")))
