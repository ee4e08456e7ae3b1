import json

import pyarrow as pa

from millrace.functions import slices
from millrace.operators import interaction as I


def test_rows_become_objects_slice_by_slice(spark, monkeypatch):
    """What one slice makes is Arrow data before the next slice is read: no list is as long as the batch."""
    seen = []
    array = pa.array
    monkeypatch.setattr(pa, "array", lambda x, *a, **k: (seen.append(len(x)), array(x, *a, **k))[1])
    made = []
    monkeypatch.setattr(slices.F, "arrow_udf", lambda run, returns: lambda *texts: made.append(run))
    slices.row_function("string", pa.string(), lambda s, t: t, most=100)(None, None)
    raw = array([None, *(str(k) * 20 for k in range(9)), "x" * 500])
    out = list(made[0](iter([(raw, raw), (raw[:0], raw[:0])])))
    assert out[0].to_pylist() == raw.to_pylist() and len(out[1]) == 0
    assert max(seen) <= 4 and sum(seen) == len(raw)


def test_both_sides_share_one_worker(spark):
    """Source and target are drawn by one Python step, not by one for each."""
    rows = spark.createDataFrame([("a", json.dumps([{"text": "x", "clickEvent": {}}]), "{")], "key string, s string, t string")
    plan = rows.select(I.rendered_both(rows.s, rows.t).alias("d"), I.rendered(rows.s).alias("one"))
    row = plan.collect()[0]
    assert row.d.a == row.one and row.d.b is None
    steps = I.changes(rows, "key", "s", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "over_many" in steps and "over_one" not in steps
    assert [r.problem for r in I.changes(rows, "key", "s", "t").collect()] == ["unreadable"]
