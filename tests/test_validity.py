"""Intervals against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from docugrain.operators import validity

DAY = datetime.date(2020, 1, 1)


def test_dyadic_intervals_make_up_the_range(spark):
    rnd, ranges = random.Random(2), [(0, 0), (0, 2**16 - 1), (5, 4), (7, 7), (1, 2**16 - 2)]
    ranges += [tuple(sorted((rnd.randrange(2**16), rnd.randrange(2**16)))) for _ in range(200)]
    for r in spark.createDataFrame(ranges, "a int, b int").select("a", "b", validity.dyadic(F.col("a"), F.col("b")).alias("d")).collect():
        days = sorted(range_ for x in r.d for range_ in [(x.n << x.level, (x.n + 1 << x.level) - 1)])
        assert sum(hi - lo + 1 for lo, hi in days) == max(0, r.b - r.a + 1)
        assert all(x[1] + 1 == y[0] for x, y in zip(days, days[1:], strict=False)) and (not days or (days[0][0], days[-1][1]) == (r.a, r.b))
        assert len(days) <= 2 * validity.LEVELS


def test_hot_keys_nulls_and_salts(spark):
    rnd = random.Random(3)
    day = lambda lo, hi: DAY + datetime.timedelta(days=rnd.randint(lo, hi))
    versions = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([None, day(-50, 300)]), rnd.choice([None, day(0, 400), day(0, 400)])) for i in range(60)]
    asked = [(k, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *[day(0, 365)] * 9])) for k in range(800)]
    v = spark.createDataFrame(versions, "k int, id int, since date, until date")
    q = spark.createDataFrame(asked, "q int, k int, day date")
    want = sorted((a, i) for a, k, d in asked for vk, i, s, e in versions if k is not None and k == vk and d and (s is None or s <= d) and (e is None or e >= d))
    for group in (10, 10**6):
        got = validity.holding(q, v, "k", "day", "since", "until", ["id"], group)
        assert sorted((r.q, r.id) for r in got.collect()) == want and got.columns == ["q", "k", "day", "since", "until", "id"]
    assert validity.holding(q.limit(0), v, "k", "day", "since", "until", ["id"]).count() == 0
    assert validity.holding(q, v.limit(0), "k", "day", "since", "until", ["id"]).count() == 0


def test_tallies_and_conflicts_equal_plain_loops(spark):
    rnd = random.Random(5)
    day = lambda lo, hi: DAY + datetime.timedelta(days=rnd.randint(lo, hi))
    versions = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([None, datetime.date(1, 1, 1), *[day(-50, 300)] * 8]), rnd.choice([None, *[day(-60, 400)] * 4])) for i in range(400)]
    asked = [(rnd.choice([1, 1, 2, 3, None]), rnd.choice([None, *[day(0, 365)] * 9])) for _ in range(300)]
    v, q = spark.createDataFrame(versions, "k int, id int, since date, until date"), spark.createDataFrame(asked, "k int, day date")
    want = {}
    for k, d in set(asked):
        ids = [i for vk, i, s, e in versions if k is not None and k == vk and d and (s is None or s <= d) and (e is None or e >= d)]
        if ids:
            want[k, d] = (len(ids), min(ids), max(ids))
    got = validity.tallies(q, v, "k", "day", "since", "until", "id").collect()
    assert {(r.k, r.day): (r.n, r["first"], r["last"]) for r in got} == want and len(got) == len(want)
    for some in (versions, [x for x in versions if x[2] != datetime.date(1, 1, 1)]):
        least, low, high = min(s for _, _, s, _ in some if s), datetime.date.min, datetime.date.max
        held = [(k, i, s or low, e or high, s or least) for k, i, s, e in some if k is not None and (e or high) >= (s or least)]
        pairs = {}
        for k, i, s, _, at in held:
            own = [j for kk, j, ss, ee, _ in held if kk == k and (ss, j) < (s, i) and ee >= at]
            if own:
                pairs[k, i] = (len(own), min(own))
        got = validity.conflicts(spark.createDataFrame(some, "k int, id int, since date, until date"), "k", "id", "since", "until").collect()
        assert {(r.k, r.id): (r.n, r["first"]) for r in got} == pairs and len(got) == len(pairs)


def test_work_of_tallies_is_not_that_of_pairs(spark):
    """Ten million pairs of versions and days that never come to be rows."""
    v, q = spark.range(5000).selectExpr("1 as k", "id", "cast(null as date) as since", "cast(null as date) as until"), spark.range(2000).selectExpr("1 as k", "date'2020-01-01' as day")
    assert [(r.n, r["first"], r["last"]) for r in validity.tallies(q, v, "k", "day", "since", "until", "id").collect()] == [(5000, 0, 4999)]
