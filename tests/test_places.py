"""Places in few large groups come from a sort over all tasks."""

from attestra.operators import ranking as K
from attestra.plans import registry


def test_places_in_few_large_groups(spark):
    rows = [(k % 3 if k % 3 else None, (k * 7919) % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g long, a long, b long")
    got = {r.b: (r.g, r.place) for r in K.numbered(df, ["g"], ["a", "b"], "place", 8).collect()}
    want = {}
    for g in (None, 1, 2):
        for place, (_, b) in enumerate(sorted((a, b) for x, a, b in rows if x == g)):
            want[b] = g, place
    assert got == want


def test_frontier_checks_sort_no_list_in_one_task(spark):
    plan = registry.QUERIES["frontier_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # what is left of windows runs over a row per range; the rows of lists and boards are read back, not sorted and joined in each check
    assert plan.count("row_number") == 0 and plan.count("lineitem") == 0
