"""Event sequences on literals: above all what becomes of the first event."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyflow.operators.sequence import EventSeq

T = datetime(2024, 1, 1)


def seq(spark, values, gaps=None, part="p"):
    at, rows = 0, []
    for i, v in enumerate(values):
        at += (gaps or [1] * len(values))[i]
        rows.append((part, T + timedelta(seconds=at), i, v))
    return EventSeq(spark.createDataFrame(rows, "p string, ts timestamp_ntz, i int, value int"), ["p"], ["ts", "i"])


def values(s, column="value"):
    df = s if not isinstance(s, EventSeq) else s.df
    return [r[column] for r in df.orderBy(*[c for c in ("ts", "i", "chunk") if c in df.columns]).collect()]


def test_transforms(spark):
    s = seq(spark, [1, 1, 2, 2, 1])
    assert values(s.map(F.col("value") * 10)) == [10, 10, 20, 20, 10]
    assert values(s.deduped()) == [1, 2, 1]
    assert values(s.distinct()) == [1, 2]
    assert values(seq(spark, [None, None, 1, None]).deduped()) == [None, 1, None]
    assert values(s.scan(F.sum("value"), "t"), "t") == [1, 2, 4, 6, 7]
    assert values(s.pairwise(), "previous") == [1, 1, 2, 2]
    assert values(s.window(2), "window") == [[1], [1, 1], [1, 2], [2, 2], [2, 1]]
    assert values(s.cold()) == [1, 2, 2, 1]
    with pytest.raises(ValueError):
        s.window(0)


def test_results(spark):
    s = seq(spark, [1, 0, 2]).try_map(F.col("value") * 2, F.col("value") == 0, F.lit("zero"))
    assert [tuple(v) for v in values(s, "result")] == [(2, None), (None, "zero"), (4, None)]
    assert values(s.map_ok(lambda v: v + 1).unwrap_or(-1), "result") == [3, -1, 5]
    assert values(s.map_err(F.upper).catch_error(lambda e: F.length(e)), "result") == [2, 4, 4]


def test_parts(spark):
    s = seq(spark, [1, 2, 3, 4, 5])
    assert values(s.take(2)) == [1, 2] and values(s.take(0)) == [] and values(s.skip(3)) == [4, 5] and values(s.first()) == [1]
    assert values(s.take_while(F.col("value") < 3)) == [1, 2] and values(s.skip_while(F.col("value") < 3)) == [3, 4, 5]
    assert values(s.last()) == [5] and values(s.first().last()) == []
    assert s.first().last_or(9).first().last == 9 and s.last_or(9).first().last == 5
    assert values(s.buffer_count(3), "buffer") == [[2, 3, 4], [5]]
    assert values(s.drop_newest(2)) == [2, 3]


def test_take_until_leaves_out_both_seeds(spark):
    s, stop = seq(spark, [1, 2, 3, 4]), seq(spark, [0, 0], [0, 3])
    assert values(s.take_until(stop)) == [2]
    assert values(s.take_until(stop.first())) == [2, 3, 4]


def test_buffer_time_has_empty_stretches(spark):
    out = seq(spark, [0, 1, 2, 3], [0, 1, 1, 25]).buffer_time(timedelta(seconds=10)).orderBy("tick")
    assert [r.buffer for r in out.collect()] == [[1, 2], [], [3]]


def test_state_transitions(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(["idle", "load", "load", "ready", "idle"])], "p string, i int, state string")
    s = EventSeq(df, ["p"], ["i"], "state")
    declared = {("idle", "load"): F.lit("go"), ("load", "ready"): F.lit("done")}
    assert values(s.state_transition(declared), "transition") == ["go", "done"]
    assert values(s.state_transition(declared, F.col("state") != "load"), "transition") == ["done"]
    assert values(s.invalid_transitions(list(declared)), "state") == ["load", "idle"]


def test_timers(spark):
    s = seq(spark, [0, 1, 2, 3, 4], [0, 1, 1, 10, 1])
    assert values(s.debounce(timedelta(seconds=5))) == [2, 4]
    assert values(s.throttle(timedelta(seconds=2))) == [0, 2, 3]
    assert values(s.audit(timedelta(seconds=5))) == [2, 4]
    out = s.timeout(timedelta(seconds=5)).df.orderBy("ts").collect()
    assert [(r.signal, r.value) for r in out] == [("value", 1), ("value", 2), ("error", None)] and out[-1].ts == T + timedelta(seconds=7)
    later = s.delay(timedelta(seconds=1)).df.orderBy("i").collect()
    assert [r.value for r in later] == [1, 2, 3, 4] and later[0].ts == T + timedelta(seconds=2)
    alone = seq(spark, [7])
    assert values(alone.delay(timedelta(seconds=1))) == [] and values(alone.timeout(timedelta(seconds=1))) == []
    late = seq(spark, [0, 1], [0, 9]).timeout(timedelta(seconds=5)).df.collect()
    assert [(r.signal, r.value, r.ts) for r in late] == [("error", None, T + timedelta(seconds=5))]


def test_combinations(spark):
    a, b = seq(spark, [1, 2, 3], [0, 2, 2]), seq(spark, [10, 20], [1, 2])
    assert [(r.left, r.right) for r in a.join(b).orderBy("ts").collect()] == [(1, 10), (2, 10), (2, 20), (3, 20)]
    assert [r["values"] for r in a.join_vec(b).orderBy("ts").collect()] == [[1, 10], [2, 10], [2, 20], [3, 20]]
    assert [(r.left, r.right) for r in a.with_latest_from(b).orderBy("ts").collect()] == [(2, 10), (3, 20)]
    assert values(a.sample(b), "left") == [1, 2]
    assert values(a.merge(b)) == [10, 2, 20, 3]
    assert values(a.concat(seq(spark, [7, 8, 9], [0, 1, 9]))) == [1, 2, 3, 9]
    assert [(r.left, r.right) for r in a.zip(b).collect()] == [(2, 20)]
    assert sorted((r.ts, r.outer, r.value) for r in a.merge_map(b, "outer").collect()) == [
        (T + timedelta(seconds=t), o, v) for t, o, v in [(1, 1, 10), (2, 2, 10), (3, 1, 20), (3, 2, 20), (4, 3, 20)]
    ]


def test_each_outer_value_has_its_own_inner_sequence(spark):
    outer = seq(spark, [1, 2, 1], [0, 2, 4])  # at 0, 2 and 6
    rows = [("p", T + timedelta(seconds=t), 100 + t, v, k) for t, v, k in [(1, 10, 1), (3, 11, 1), (4, 20, 2), (5, 12, 1), (7, 13, 1)]]
    inner = EventSeq(spark.createDataFrame(rows, "p string, ts timestamp_ntz, i int, value int, k int"), ["p"], ["ts", "i"])
    got = outer.switch_map(inner, by="k").orderBy("ts").collect()
    assert [((r.ts - T).seconds, r.outer, r.inner) for r in got] == [(1, 1, 10), (4, 2, 20), (6, 1, 12), (7, 1, 13)]
    got = outer.merge_map(inner, by="k").collect()
    assert sorted(((r.ts - T).seconds, r.outer, r.value) for r in got) == [(1, 1, 10), (3, 1, 11), (4, 2, 20), (5, 1, 12), (6, 1, 12), (7, 1, 13), (7, 1, 13)]


def test_comparison_with_what_was_given(spark):
    out = seq(spark, [0, 2, 4, 5, 9]).changed_by(lambda now, last: abs(now - last) < 3)
    assert values(out) == [0, 4, 9]


def test_retry(spark):
    df = spark.createDataFrame([("p", i, v, v < 0) for i, v in enumerate([0, -1, 1, -1, -1, 2])], "p string, i int, value int, failed boolean")
    s = EventSeq(df, ["p"], ["i"])
    out = s.retry(2, "failed").orderBy("i").collect()
    assert [(r.value, r.signal) for r in out] == [(1, "value"), (-1, "error")]


def test_batches_and_bounds(spark):
    df = spark.createDataFrame([("p", i, i % 2, i // 4) for i in range(8)], "p string, i int, k int, flush int")
    s = EventSeq(df.withColumn("value", F.col("i")), ["p"], ["i"])
    assert sorted((r.tick, r.k, r.value) for r in s.batch(F.col("flush"), ["k"]).collect()) == [(0, 0, 2), (0, 1, 3), (1, 0, 6), (1, 1, 7)]
    assert s.no_coalesce().batch(F.col("flush"), ["k"]).count() == 8
    assert values(s.bounded("flush", 1, "drop_oldest")) == [3, 7] and values(s.bounded("flush", 1, "drop_newest")) == [0, 4]
    assert s.bounded("flush", 4, "error").df.count() == 8
    with pytest.raises(Exception, match="buffer is full"):
        s.bounded("flush", 3, "error").df.collect()


def test_a_source_has_no_seed(spark):
    s = seq(spark, [1, 2, 3])._with_seed(False)
    assert values(s.cold()) == [1, 2, 3] and values(s.drop_newest(2)) == [1, 2] and values(s.first().last()) == [1]
    assert [r.buffer for r in s.buffer_count(2).orderBy("chunk").collect()] == [[1, 2], [3]]
    assert values(s.merge(s.take(1))) == [1, 1, 2, 3]


def test_folds_keep_values_exact(spark):
    from decimal import Decimal

    from keyflow.operators.fold import fold_sequence

    big = 9007199254740993
    rows = [("p", 0, big, float("nan"), Decimal("1.10"), T), ("p", 1, None, 1.0, None, None), ("q", 0, big, None, Decimal("2.00"), T)]
    kinds = "p string, i int, n long, x double, d decimal(10,2), ts timestamp_ntz"
    df = spark.createDataFrame(rows, kinds)
    out = fold_sequence(df, ["p"], ["i"], kinds, lambda: 0, lambda s, e: (s + 1, [e[1:]])).orderBy("p", "i").collect()
    assert [tuple(r)[:3] + tuple(r)[4:] for r in out] == [r[:3] + r[4:] for r in rows]
    assert out[0].x != out[0].x and [r.x for r in out[1:]] == [1.0, None]
    kept = EventSeq(df, ["p"], ["i"], "n").changed_by(lambda now, last: now == last).orderBy("p", "i").collect()
    assert [r.n for r in kept] == [big, None, big] and kept[0].x != kept[0].x and kept[0].d == Decimal("1.10")


def test_timers_over_many_batches(spark):
    """Against a plain loop, with sequences longer than an Arrow batch."""
    import random

    rng, rows = random.Random(3), []
    for p in ("a", "b", "c"):
        at = 0
        for i in range(400):
            at += rng.choice([0, 1, 1, 2, 9])
            rows.append((p, T + timedelta(seconds=at), i, i))
    s = EventSeq(spark.createDataFrame(rows, "p string, ts timestamp_ntz, i int, value int"), ["p"], ["ts", "i"])
    throttled, audited = [], []
    for p in ("a", "b", "c"):
        last, end, held = None, None, None
        for n, (_, t, i, _) in enumerate(r for r in rows if r[0] == p):
            if last is None or t - last >= timedelta(seconds=6):
                last = t
                throttled.append((p, i))
            if n and end is not None and t < end:
                held = i
            elif n:
                if held is not None:
                    audited.append((p, held))
                end, held = t + timedelta(seconds=6), i
        audited.append((p, held))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert sorted((r.p, r.i) for r in s.throttle(timedelta(seconds=6)).collect()) == sorted(throttled)
        assert sorted((r.p, r.i) for r in s.audit(timedelta(seconds=6)).collect()) == sorted(audited)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ends_are_never_coalesced(spark):
    rows = [("p", 0, 1, "value"), ("p", 1, 2, "value"), ("p", 2, 3, "error"), ("p", 3, 4, None), ("p", 4, 5, "error"), ("p", 5, 6, "complete")]
    s = EventSeq(spark.createDataFrame(rows, "p string, i int, value int, signal string"), ["p"], ["i"])
    got = s.batch(F.lit(0), ["p"], "signal").collect()
    assert sorted((r.value, r.signal) for r in got) == [(3, "error"), (4, "value"), (5, "error"), (6, "complete")]
