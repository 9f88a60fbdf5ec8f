import random

import pytest

from lorespark.operators import insight


def crowded(spark):
    """Many mentions a day, and times without any that are longer than a lag reaches."""
    pick = random.Random(3)
    starts = (0, 400, 100_000_000)
    data = [(f"e{i % 6}", pick.choice(starts) + pick.randrange(40), n) for n, i in enumerate(range(600))]
    data += [("few", 3, 1000 + i) for i in range(4)] + [("e0", None, 2000)]
    return spark.createDataFrame(data, "entity string, day int, entry int"), data


def by_day(data):
    out = {}
    for entity, day, entry in data:
        if day is not None:
            out.setdefault(entity, []).append((day, entry))
    return {e: sorted(x) for e, x in out.items()}


@pytest.mark.parametrize("together", [1, 64])
def test_lags_of_crowded_days_match_a_loop(spark, together):
    df, data = crowded(spark)
    series, want = {e: x for e, x in by_day(data).items() if len(x) >= insight.MIN_MENTIONS}, {}
    for a, b in ((a, b) for a in series for b in series if a != b):
        for nth, (day, _) in enumerate(series[a]):
            for lag in range(13):
                if any(day + max(lag - 1, 0) <= x <= day + lag + 1 for x, _ in series[b]):
                    want.setdefault((a, b, lag), [0, 0])[1 - nth % 2] += 1
    got = {(r.a, r.b, r.lag): [r.selected, r.held_out] for r in insight.lag_counts(df, 12, together=together).collect()}
    assert got == want


def test_no_mentions_have_no_lags(spark):
    df, _ = crowded(spark)
    assert insight.lag_counts(df.filter("entity = 'few'"), 12).count() == 0
    assert insight.lag_counts(df.limit(0), 12).count() == 0


def test_evidence_of_crowded_days_is_the_first_in_order(spark):
    df, data = crowded(spark)
    series, leads = by_day(data), [("e0", "e1", 0), ("e1", "e2", 4), ("few", "e3", 2)]
    want = []
    for a, b, lag in leads:
        for day, entry in series[a]:
            if later := [(x, e) for x, e in series[b] if day + max(lag - 1, 0) <= x <= day + lag + 1]:
                want.append((a, b, entry, min(later)[1]))
    found = insight.lead_evidence(spark.createDataFrame(leads, "a string, b string, lag int"), df)
    assert sorted(map(tuple, found.collect())) == sorted(want)
