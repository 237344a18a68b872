"""DuckDB SQL oracle for every registered query.

code.  ``base(...)`` returns a ``WITH`` prefix holding the logical views;
DuckDB skips CTEs a query does not reference.
"""

from __future__ import annotations

from statistics import NormalDist

# Money is summed as exact cents: sum(x).
_CENTERS: list[list[float]] = []


def set_centers(centers: list[list[float]]) -> None:
    """The centres that scored customers are compared with."""
    _CENTERS[:] = centers


_CTES: list[tuple[str, str]] = [
    ("raw_customers", """
SELECT c_custkey AS customer_id,
       CAST(20130101 + (c_custkey % 4) * 10000 + (c_custkey % 12) * 100 + c_custkey % 28 AS INTEGER)
         AS became_member_on,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS gender,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN 118 WHEN c_custkey % 19 = 0 THEN 95
                 ELSE 18 + c_custkey % 25 END AS INTEGER) AS age,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 17 = 3 THEN c_acctbal + 100000.0
            WHEN c_custkey % 17 = 5 THEN c_acctbal - 100000.0 ELSE c_acctbal END AS income
FROM customer"""),
    ("cust_stats", """
SELECT quantile_cont(age, 0.5) AS age_med, quantile_cont(income, 0.25) AS iq1,
       quantile_cont(income, 0.5) AS imed, quantile_cont(income, 0.75) AS iq3
FROM raw_customers"""),
    ("clean_customers", """
SELECT r.customer_id,
       CAST(strptime(CAST(r.became_member_on AS VARCHAR), '%Y%m%d') AS DATE) AS became_member_on,
       coalesce(r.gender, 'Unknown') AS gender,
       CASE WHEN r.age > 100 THEN s.age_med ELSE CAST(r.age AS DOUBLE) END AS age,
       CASE WHEN r.income IS NULL THEN s.imed
            WHEN r.income < s.iq1 - 1.5 * (s.iq3 - s.iq1) THEN s.iq1 - 1.5 * (s.iq3 - s.iq1)
            WHEN r.income > s.iq3 + 1.5 * (s.iq3 - s.iq1) THEN s.iq3 + 1.5 * (s.iq3 - s.iq1)
            ELSE r.income END AS income
FROM raw_customers r CROSS JOIN cust_stats s"""),
    ("raw_offers", """
SELECT CAST(p_partkey AS VARCHAR) AS offer_id, p_type AS offer_type,
       CAST(CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END AS INTEGER) AS difficulty,
       CAST(p_partkey % 11 AS INTEGER) AS reward,
       CAST(3 + p_size % 8 AS INTEGER) AS duration,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            WHEN p_partkey % 13 = 5 THEN '[''' || split_part(p_name, ' ', 1) || ''', None]'
            ELSE '[''' || split_part(p_name, ' ', 1) || ''', ''' || split_part(p_name, ' ', 2) || ''']'
       END AS channels
FROM part"""),
    ("clean_offers", """
SELECT offer_id, offer_type, difficulty, reward, duration,
       from_json(replace(replace(channels, '''', '"'), 'None', 'null'), '["VARCHAR"]') AS channels
FROM raw_offers"""),
    ("raw_events", """
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL ELSE user_id END AS customer_id,
       CASE WHEN event_id % 103 = 0 THEN NULL
            WHEN event_type = 'view' THEN 'offer received' WHEN event_type = 'click' THEN 'offer viewed'
            WHEN event_type = 'purchase' THEN 'offer completed'
            WHEN user_id % 29 = 0 THEN 'offer viewed' ELSE 'transaction' END AS event,
       CASE WHEN event_type IN ('view', 'click', 'purchase')
            THEN CASE event_id % 31 WHEN 0 THEN replace(v, '}', ', ''reward'': None}')
                                    WHEN 1 THEN replace(v, '}', ', ''reward'': 5}') ELSE v END
            WHEN event_id % 97 = 0 THEN '{''amount'': None}'
            ELSE '{''amount'': ' || CAST(value AS VARCHAR) || '}' END AS value,
       CASE WHEN event_id % 107 = 0 THEN NULL ELSE
            CASE WHEN event_type NOT IN ('view', 'click', 'purchase') AND floor(h / 24) = 11 THEN h + 24
                 ELSE h END + CASE WHEN event_id % 41 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS time
FROM (SELECT *, replace(replace(props, '"k"', '"offer_id"'), '"', '''') AS v,
             floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000) AS h
      FROM events)"""),
    ("clean_events", """
SELECT event_id, customer_id, event, time,
       json_extract_string(j, '$.offer_id') AS offer_id,
       TRY_CAST(json_extract_string(j, '$.amount') AS DOUBLE) AS amount,
       TRY_CAST(json_extract_string(j, '$.reward') AS INTEGER) AS event_reward
FROM (SELECT *, replace(replace(value, '''', '"'), 'None', 'null') AS j FROM raw_events)"""),
    ("amount_caps", """
SELECT quantile_cont(amount, 0.01) AS p1, quantile_cont(amount, 0.99) AS p99 FROM clean_events"""),
    ("merged", """
SELECT e.event_id, e.customer_id, e.event, e.offer_id,
       CAST(make_timestamp(CAST(round(e.time * 3600000000) AS BIGINT)) AS TIMESTAMP) AS time,
       CASE WHEN e.amount < p1 THEN p1 WHEN e.amount > p99 THEN p99 ELSE e.amount END AS amount,
       c.gender, c.age, c.income,
       o.offer_type, o.difficulty, o.reward, o.duration, o.channels
FROM clean_events e CROSS JOIN amount_caps
LEFT JOIN clean_customers c ON e.customer_id = c.customer_id
LEFT JOIN clean_offers o ON e.offer_id = o.offer_id"""),
    ("O", """
SELECT event_id, customer_id, event,
       time,
       offer_id, offer_type, difficulty, reward, duration, channels, gender, age, income
FROM merged WHERE event IS DISTINCT FROM 'transaction'"""),
    ("T", """
SELECT event_id, customer_id, event,
       time,
       amount, age
FROM merged WHERE event = 'transaction'"""),
    # Success flag against the offer's first row, then the age IQR filter
    ("first_time", """
SELECT offer_id, min(time) AS ft FROM O WHERE offer_id IS NOT NULL GROUP BY offer_id"""),
    ("OS", """
SELECT O.*, coalesce(O.event = 'offer completed' AND O.time <= f.ft + to_days(O.duration), false)
         AS offer_success
FROM O LEFT JOIN first_time f ON O.offer_id = f.offer_id"""),
    ("age_fence", """
SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM OS"""),
    ("OP", """
SELECT OS.* FROM OS CROSS JOIN age_fence a
WHERE OS.age >= a.q1 - 1.5 * (a.q3 - a.q1) AND OS.age <= a.q3 + 1.5 * (a.q3 - a.q1)"""),
    ("OX", """
SELECT * EXCLUDE (channels, ch), ch AS channels
FROM (SELECT *, unnest(CASE WHEN channels IS NULL OR len(channels) = 0 THEN [NULL::VARCHAR]
                            ELSE channels END) AS ch FROM OP)"""),
    # long-history transactions from orders
    ("L", """
SELECT o_orderkey AS event_id, o_custkey AS customer_id, o_orderstatus AS event,
       o_orderdate AS time, o_totalprice AS amount
FROM orders"""),
]

def rfm_sql(src: str) -> str:
    """E2 over a transaction relation ``src`` (customer_id, event, time, amount)."""
    return f"""(
SELECT p.customer_id,
       CAST(floor((epoch_us(g.gmax) - epoch_us(p.last)) / 86400000000) AS INTEGER) AS recency,
       p.frequency,
       CASE WHEN coalesce(p.spend, 0) > 0 THEN coalesce(p.spend, 0) ELSE 0.0 END AS monetary
FROM (SELECT customer_id, max(time) AS last, count(event) AS frequency, sum(amount) AS spend
      FROM {src} GROUP BY customer_id) p
CROSS JOIN (SELECT max(time) AS gmax FROM {src}) g
WHERE p.customer_id IS NOT NULL)"""


def scaler_sql(rfm_rel: str) -> str:
    return f"""(
SELECT avg(recency) AS m0, CASE WHEN coalesce(stddev_pop(recency), 0) = 0 THEN 1
                                ELSE stddev_pop(recency) END AS s0,
       avg(frequency) AS m1, CASE WHEN coalesce(stddev_pop(frequency), 0) = 0 THEN 1
                                  ELSE stddev_pop(frequency) END AS s1,
       avg(monetary) AS m2, CASE WHEN coalesce(stddev_pop(monetary), 0) = 0 THEN 1
                                 ELSE stddev_pop(monetary) END AS s2
FROM {rfm_rel})"""


def assign_sql(rfm_rel: str, scaler_rel: str, centers=None) -> str:
    """M3: nearest centre, ties to the lowest index."""
    def z(i, f):
        return f"((CAST(r.{f} AS DOUBLE) - s.m{i}) / s.s{i})"
    ds = []
    for c in centers or _CENTERS:
        terms = [f"(({z(i, f)} - {c[i]!r}) * ({z(i, f)} - {c[i]!r}))"
                 for i, f in enumerate(["recency", "frequency", "monetary"])]
        ds.append(" + ".join(terms))
    dl = "[" + ", ".join(ds) + "]"
    return f"""(
SELECT r.customer_id, r.recency, r.frequency, r.monetary,
       CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster
FROM (SELECT r.*, {dl} AS d FROM {rfm_rel} r CROSS JOIN {scaler_rel} s) r)"""


_SEG = [
    ("RFM_L", lambda: "SELECT * FROM " + rfm_sql("L")),
    ("SCALER_L", lambda: "SELECT * FROM " + scaler_sql("RFM_L")),
    ("SEG_L", lambda: "SELECT * FROM " + assign_sql("RFM_L", "SCALER_L")),
    ("RFM_T", lambda: "SELECT * FROM " + rfm_sql("T")),
    ("SCALER_T", lambda: "SELECT * FROM " + scaler_sql("RFM_T")),
    ("SEG_T", lambda: "SELECT * FROM " + assign_sql("RFM_T", "SCALER_T")),
]


def base() -> str:
    parts = [f"{n} AS ({sql.strip()})" for n, sql in _CTES]
    parts += [f"{n} AS ({f().strip()})" for n, f in _SEG]
    return "WITH " + ",\n".join(parts) + "\n"


def q(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """A full oracle statement: base views (+ extra CTEs) and ``body``."""
    head = base()
    if extra:
        head = head.rstrip() + ",\n" + ",\n".join(f"{n} AS ({s.strip()})" for n, s in extra) + "\n"
    if body.lstrip().startswith(","):
        # the body continues the WITH list with its own CTEs
        return head.rstrip() + "\n" + body.lstrip()
    return head + body


def kmeans_sql(rfm_rel: str, k: int = 4, rounds: int = 60, tol: float = 1e-4
               ) -> list[tuple[str, str]]:
    """M1 + M2 unrolled: scaler, start centres by normal-quantile buckets of
    z(monetary), ``rounds`` Lloyd steps as chained CTEs, and ``KF`` = the
    centres after the first round whose summed squared shift is at most
    tol * mean population variance of the scaled features."""
    cuts = [NormalDist().inv_cdf(i / k) for i in range(1, k)]
    bucket = " + ".join(f"CAST(z2 >= {c!r} AS INTEGER)" for c in cuts)
    ctes = [
        ("KS", "SELECT * FROM " + scaler_sql(rfm_rel)),
        ("KZ", f"""SELECT (CAST(recency AS DOUBLE) - m0) / s0 AS z0,
                          (CAST(frequency AS DOUBLE) - m1) / s1 AS z1,
                          (CAST(monetary AS DOUBLE) - m2) / s2 AS z2
                   FROM {rfm_rel} CROSS JOIN KS"""),
        ("K0", f"""SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS c,
                          c0, c1, c2
                   FROM (SELECT {bucket} AS b, avg(z0) AS c0, avg(z1) AS c1, avg(z2) AS c2
                         FROM KZ GROUP BY 1)"""),
    ]
    for r in range(1, rounds + 1):
        prev = f"K{r - 1}"
        ctes.append((f"A{r}", f"""
SELECT z.*, arg_min(c.c, struct_pack(d := (z.z0 - c.c0) * (z.z0 - c.c0) + (z.z1 - c.c1) * (z.z1 - c.c1)
                                        + (z.z2 - c.c2) * (z.z2 - c.c2), c := c.c)) AS cl
FROM (SELECT row_number() OVER () AS rid, * FROM KZ) z CROSS JOIN {prev} c
GROUP BY ALL"""))
        ctes.append((f"K{r}", f"""
SELECT p.c, coalesce(n.c0, p.c0) AS c0, coalesce(n.c1, p.c1) AS c1, coalesce(n.c2, p.c2) AS c2
FROM {prev} p LEFT JOIN (SELECT cl AS c, avg(z0) AS c0, avg(z1) AS c1, avg(z2) AS c2
                          FROM A{r} GROUP BY cl) n ON p.c = n.c"""))
    ctes.append(("KALL", " UNION ALL ".join(f"SELECT {r} AS r, * FROM K{r}"
                                            for r in range(rounds + 1))))
    ctes.append(("KSHIFT", """
SELECT a.r, sum((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1)
                + (a.c2 - b.c2) * (a.c2 - b.c2)) AS shift
FROM KALL a JOIN KALL b ON a.c = b.c AND b.r = a.r - 1 GROUP BY a.r"""))
    ctes.append(("KTOL", f"""
SELECT {tol!r} * (var_pop(z0) + var_pop(z1) + var_pop(z2)) / 3 AS tol FROM KZ"""))
    ctes.append(("KF", f"""
SELECT c, c0, c1, c2 FROM KALL
WHERE r = (SELECT coalesce(min(r) FILTER (WHERE shift <= tol), {rounds})
           FROM KSHIFT CROSS JOIN KTOL)"""))
    return ctes
