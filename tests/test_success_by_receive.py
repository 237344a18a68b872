"""C7 with anchor='customer'."""

import datetime as dt
import random

from perkframe.operators import offers

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    """rows: (event_id, customer, offer, event, time, duration)."""
    won = set()
    pairs = {(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None}
    for pair in pairs:
        mine = [r for r in rows if (r[1], r[2]) == pair and r[4] is not None
                and r[3] in ("offer received", "offer completed")]
        mine.sort(key=lambda r: (r[4], r[3] == "offer completed", r[0]))
        held, used = None, True
        for r in mine:
            if r[3] == "offer received":
                if held != r[4]:
                    held, used = r[4], False
            elif held is not None and not used:
                used = True
                if r[5] is not None and r[4] <= held + r[5] * DAY:
                    won.add(r[0])
    return {r[0]: r[0] in won for r in rows}


def check(spark, rows):
    df = spark.createDataFrame(
        rows, "event_id LONG, customer_id LONG, offer_id STRING, event STRING, time TIMESTAMP_NTZ, duration INT")
    out = offers.with_offer_success(df.repartition(4), anchor="customer")
    assert out.columns == [*df.columns, "offer_success"]
    assert {r["event_id"]: r["offer_success"] for r in out.collect()} == brute(rows)


def test_random_events(spark):
    rng = random.Random(4)
    events = ["offer received", "offer completed", "offer viewed", None]
    rows = [(i, rng.choice([1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice(events),
             rng.choice([None] + [T0 + k * DAY / 2 for k in range(40)]), rng.choice([None, 0, 1, 3]))
            for i in range(900)]
    check(spark, rows)


def test_each_receive_is_used_once_and_in_time(spark):
    def row(i, event, days, duration=2):
        return (i, 1, "a", event, T0 + days * DAY, duration)
    check(spark, [row(1, "offer received", 0), row(2, "offer completed", 1), row(3, "offer completed", 1.5),
                  row(4, "offer received", 3), row(5, "offer completed", 6), row(6, "offer completed", 6),
                  row(7, "offer received", 7), row(8, "offer completed", 9), row(9, "offer completed", 7)])


def test_hot_pair(spark):
    """A third of the rows on one customer and offer: one window row a time."""
    rows = [(i, 1, "a", "offer received" if i % 5 == 0 else "offer completed", T0 + (i % 48) * DAY / 24, 1)
            for i in range(2000)]
    rows += [(i, i % 900, "b", "offer completed" if i % 2 else "offer received", T0 + (i % 9) * DAY, 3)
             for i in range(2000, 6000)]
    check(spark, rows)
