"""Tasks of shuffles grow in number with the table, so that one task's memory doesn't."""

import re

from attestra.operators import confidence as C
from attestra.operators import ranking as K


def test_effects_of_many_entries_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 50)
    entries = spark.createDataFrame([(f"b{k % 3}", f"e{k}", k, "d", [f"e{k - 3}"] if k > 2 else [], [f"e{k - 6}"] if k > 5 and k % 7 == 0 else [], 0.5) for k in range(500)], "board_id string, entry_id string, seq long, document string, supports array<string>, contradicts array<string>, confidence double")
    plan = C.effects(entries)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)]
    assert len(dealt) >= 4 and {*dealt} == {10}
    assert C.confidences(entries).count() == 500
