"""Registered queries of event sequences: the events of each user, in order, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from keyflow.operators.fold import fold_native
from keyflow.operators.sequence import EventSeq
from keyflow.plans.registry import query
from keyflow.sources.tables import load

_KEY = ["user_id", "event_id"]


def _events(spark, d, condition: str | None = None) -> EventSeq:
    df = load(spark, d, "events").df.select("user_id", "ts", "event_id", "event_type", "value")
    return EventSeq(df.filter(condition) if condition else df, ["user_id"], ["ts", "event_id"])


def _types(spark, d) -> EventSeq:
    s = _events(spark, d)
    return EventSeq(s.df.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


_W = "PARTITION BY user_id ORDER BY ts, event_id"
_UPTO = f"({_W} ROWS UNBOUNDED PRECEDING)"
_RN = f"(SELECT *, row_number() OVER ({_W}) AS rn FROM events)"


@query("SELECT user_id, event_id, value * 2 + 1 AS value FROM events")
def seq_map(spark, d):
    return _events(spark, d).map(F.col("value") * 2 + 1).df.select(*_KEY, "value")


@query("SELECT user_id, event_id, value FROM events WHERE value > 50")
def seq_filter(spark, d):
    return _events(spark, d).filter(F.col("value") > 50).df.select(*_KEY, "value")


@query("SELECT count(*) AS seen, max(value) AS most FROM events WHERE event_type = 'purchase'")
def seq_tap(spark, d):
    """What is observed while the events go by."""
    from pyspark.sql import Observation

    seen = Observation("purchases")
    s = _events(spark, d, "event_type = 'purchase'").tap(seen, F.count(F.lit(1)).alias("seen"), F.max("value").alias("most"))
    s.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["seen"], seen.get["most"])], "seen long, most double")


@query("SELECT user_id, event_id, CASE WHEN value >= 10 THEN round(100 / value, 4) END AS ok, CASE WHEN value < 10 THEN 'small' END AS err FROM events")
def seq_try_map(spark, d):
    s = _events(spark, d).try_map(F.round(100 / F.col("value"), 4), F.col("value") < 10, F.lit("small"))
    return s.df.select(*_KEY, "result.ok", "result.err")


@query("SELECT user_id, event_id, CASE WHEN value < 10 THEN -5 ELSE value + 1 END AS result FROM events")
def seq_results(spark, d):
    """map_ok, map_err and catch_error in a row."""
    s = _events(spark, d).try_map(F.col("value"), F.col("value") < 10, F.lit("small"))
    s = s.map_ok(lambda v: v + 1).map_err(F.length).catch_error(lambda e: (-e).cast("double"))
    return s.df.select(*_KEY, "result")


@query("SELECT user_id, event_id, CASE WHEN value < 10 THEN 0 ELSE value END AS result FROM events")
def seq_unwrap_or(spark, d):
    return _events(spark, d).try_map(F.col("value"), F.col("value") < 10, F.lit("small")).unwrap_or(0.0).df.select(*_KEY, "result")


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER ({_W}) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def seq_deduped(spark, d):
    return _types(spark, d).deduped().df.select(*_KEY, "event_type")


@query(f"SELECT user_id, event_id, value FROM (SELECT *, lag(floor(value / 25)) OVER ({_W}) AS b FROM events) WHERE b IS NULL OR b <> floor(value / 25)")
def seq_distinct_until_changed_by(spark, d):
    return _events(spark, d).distinct_until_changed_by(F.floor(F.col("value") / 25)).df.select(*_KEY, "value")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, value AS held, true AS given FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.event_id, s.rn, CASE WHEN abs(s.value - held) < 30 THEN held ELSE s.value END, abs(s.value - held) >= 30 FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id, event_id, held AS value FROM r WHERE given
""")
def seq_changed_by(spark, d):
    """A comparison that isn't an equivalence: with the last value that was given."""
    s = _events(spark, d)
    s = EventSeq(s.df.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    return s.changed_by(lambda now, last: abs(now - last) < 30).select(*_KEY, "value")


@query("SELECT user_id, min(event_id) AS event_id, event_type FROM events GROUP BY user_id, event_type")
def seq_distinct(spark, d):
    return _types(spark, d).distinct().df.select(*_KEY, "event_type")


@query(f"SELECT user_id, event_id, round(sum(value) OVER {_UPTO}, 2) AS total, max(value) OVER {_UPTO} AS most FROM events")
def seq_scan(spark, d):
    s = _events(spark, d)
    return s.scan(F.sum("value"), "total").scan(F.max("value"), "most").df.select(*_KEY, F.round("total", 2).alias("total"), "most")


@query("SELECT user_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) AS BIGINT) AS state FROM events GROUP BY user_id")
def seq_fold(spark, d):
    """An arbitrary fold without Python."""
    s = _events(spark, d)
    return fold_native(s.df, s.partition, s.order, "value", F.lit(0).cast("long"), lambda a, v: a + F.when(v > 50, 1).otherwise(-1))


@query(f"SELECT user_id, event_id, previous, value FROM (SELECT *, lag(value) OVER ({_W}) AS previous, row_number() OVER ({_W}) AS rn FROM events) WHERE rn > 1")
def seq_pairwise(spark, d):
    return _events(spark, d).pairwise().df.select(*_KEY, "previous", "value")


@query(f"SELECT user_id, event_id, count(*) OVER w AS n, max(value) OVER w AS most FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def seq_window(spark, d):
    df = _events(spark, d).window(3).df
    return df.select(*_KEY, F.size("window").cast("long").alias("n"), F.array_max("window").alias("most"))


@query(f"""SELECT user_id, event_id, b AS from_state, CASE WHEN event_type = 'click' THEN 'opened' ELSE 'bought' END AS transition
FROM (SELECT *, lag(event_type) OVER ({_W}) AS b FROM events) WHERE ((b = 'view' AND event_type = 'click') OR (b = 'click' AND event_type = 'purchase')) AND value > 20""")
def seq_state_transition(spark, d):
    s = _events(spark, d)
    s = EventSeq(s.df, s.partition, s.order, "event_type")
    out = s.state_transition({("view", "click"): F.lit("opened"), ("click", "purchase"): F.lit("bought")}, F.col("value") > 20)
    return out.df.select(*_KEY, "from_state", "transition")


@query(f"""SELECT user_id, event_id, concat_ws(',', CASE b WHEN 'view' THEN 'left view' END, CASE event_type WHEN 'click' THEN 'opened' ELSE 'bought' END, CASE event_type WHEN 'purchase' THEN 'at till' END, 'moved') AS fired
FROM (SELECT *, lag(event_type) OVER ({_W}) AS b FROM events) WHERE (b = 'view' AND event_type = 'click') OR (b = 'click' AND event_type = 'purchase')""")
def seq_state_hooks(spark, d):
    """Hooks in their order: exit, transition, enter, any."""
    on = {("view", "click"): F.lit("opened"), ("click", "purchase"): F.lit("bought")}
    out = _types(spark, d).state_hooks(on, {"view": F.lit("left view")}, {"purchase": F.lit("at till")}, F.lit("moved"))
    return out.df.select(*_KEY, F.array_join("fired", ",").alias("fired"))


@query("SELECT user_id, event_id, CAST(floor((rn - 1) / 4) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)")
def seq_source_buffer(spark, d):
    """A source without a current value: its first event is in the first chunk."""
    s = _events(spark, d)
    s = EventSeq(s.df, s.partition, s.order, "event_id", seed=False)
    return s.buffer_count(4).select("user_id", F.explode("buffer").alias("event_id"), "chunk").select(*_KEY, "chunk")


@query(f"SELECT user_id, event_id, b AS from_state, event_type FROM (SELECT *, lag(event_type) OVER ({_W}) AS b FROM events) WHERE b IS NOT NULL AND NOT (b = 'view' AND event_type = 'click')")
def seq_invalid_transitions(spark, d):
    return _types(spark, d).invalid_transitions([("view", "click")]).df.select(*_KEY, "from_state", "event_type")


@query(f"SELECT user_id, event_id FROM {_RN} WHERE rn > 1")
def seq_cold(spark, d):
    return _events(spark, d).cold().df.select(*_KEY)


@query(f"SELECT user_id, event_id FROM {_RN} WHERE rn <= 5")
def seq_take(spark, d):
    return _events(spark, d).take(5).df.select(*_KEY)


@query(f"SELECT user_id, event_id, value FROM {_RN} WHERE rn = 1")
def seq_first(spark, d):
    return _events(spark, d).first().df.select(*_KEY, "value")


@query(f"SELECT user_id, event_id FROM {_RN} WHERE rn > 7")
def seq_skip(spark, d):
    return _events(spark, d).skip(7).df.select(*_KEY)


@query(f"SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN value < 90 THEN 0 ELSE 1 END) OVER {_UPTO} AS f FROM events) WHERE f = 0")
def seq_take_while(spark, d):
    return _events(spark, d).take_while(F.col("value") < 90).df.select(*_KEY)


@query(f"SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN value < 90 THEN 0 ELSE 1 END) OVER {_UPTO} AS f FROM events) WHERE f = 1")
def seq_skip_while(spark, d):
    return _events(spark, d).skip_while(F.col("value") < 90).df.select(*_KEY)


@query(f"""WITH n AS (SELECT user_id, min(event_id) AS stop FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM events WHERE event_type = 'purchase') WHERE rn > 1 GROUP BY 1)
SELECT e.user_id, e.event_id FROM {_RN} e LEFT JOIN n ON n.user_id = e.user_id WHERE rn > 1 AND (stop IS NULL OR event_id < stop)""")
def seq_take_until(spark, d):
    return _events(spark, d).take_until(_events(spark, d, "event_type = 'purchase'")).df.select(*_KEY)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING count(*) > 1")
def seq_last(spark, d):
    return _events(spark, d).last().df.select(*_KEY, "value")


@query("SELECT user_id, CASE WHEN count(*) > 1 THEN arg_max(value, event_id) ELSE -1 END AS last FROM events WHERE value > 98 GROUP BY user_id")
def seq_last_or(spark, d):
    return _events(spark, d, "value > 98").last_or(-1.0)


@query(f"SELECT user_id, CAST(floor((rn - 2) / 4) AS BIGINT) AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM {_RN} WHERE rn > 1 GROUP BY 1, 2")
def seq_buffer_count(spark, d):
    s = _events(spark, d)
    s = EventSeq(s.df.withColumn("id", F.col("event_id").cast("string")), s.partition, s.order, "id")
    return s.buffer_count(4).select("user_id", "chunk", F.array_join("buffer", ",").alias("ids"))


@query(f"""WITH c AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS tick FROM {_RN} WHERE rn > 1),
t AS (SELECT user_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM c GROUP BY 1)
SELECT t.user_id, t.tick, count(event_id) AS n FROM t LEFT JOIN c ON c.user_id = t.user_id AND c.tick = t.tick GROUP BY 1, 2""")
def seq_buffer_time(spark, d):
    return _events(spark, d).buffer_time(timedelta(days=1)).select("user_id", "tick", F.size("buffer").cast("long").alias("n"))


@query(f"SELECT user_id, event_id FROM {_RN} WHERE rn BETWEEN 2 AND 4")
def seq_drop_newest(spark, d):
    return _events(spark, d).drop_newest(3).df.select(*_KEY)


@query("SELECT user_id, event_id FROM events")
def seq_drop_oldest(spark, d):
    return _events(spark, d).drop_oldest(3).sample_latest().df.select(*_KEY)


@query(f"SELECT user_id, event_id, ts + INTERVAL 1 HOUR AS emit_ts FROM (SELECT *, lead(ts) OVER ({_W}) AS n, row_number() OVER ({_W}) AS rn FROM events) WHERE rn > 1 AND (n IS NULL OR n - ts > INTERVAL 1 HOUR)")
def seq_debounce(spark, d):
    return _events(spark, d).debounce(timedelta(hours=1)).df.select(*_KEY, "emit_ts")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, ts AS held, true AS given FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.event_id, s.rn, CASE WHEN s.ts - held < INTERVAL 6 HOUR THEN held ELSE s.ts END, s.ts - held >= INTERVAL 6 HOUR FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id, event_id, held AS ts FROM r WHERE given
""")
def seq_throttle(spark, d):
    return _timed(spark, d).throttle(timedelta(hours=6)).select(*_KEY, "ts")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) - 1 AS n FROM events),
r AS (SELECT user_id, event_id, rn, n, ts + INTERVAL 6 HOUR AS until, CAST(NULL AS BIGINT) AS given FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.event_id, s.rn, s.n, CASE WHEN s.ts < until THEN until ELSE s.ts + INTERVAL 6 HOUR END, CASE WHEN s.ts < until THEN NULL ELSE r.event_id END FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id, given AS event_id FROM r WHERE given IS NOT NULL UNION ALL SELECT user_id, event_id FROM r WHERE rn = n
""")
def seq_audit(spark, d):
    return _timed(spark, d).audit(timedelta(hours=6)).select(*_KEY)


def _timed(spark, d) -> EventSeq:
    s = _events(spark, d)
    return EventSeq(s.df.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id")


@query(f"SELECT user_id, event_id, ts + INTERVAL 90 SECOND AS ts FROM {_RN} WHERE rn > 1")
def seq_delay(spark, d):
    return _events(spark, d).delay(timedelta(seconds=90)).df.select(*_KEY, "ts")


@query(f"""WITH g AS (SELECT *, lag(ts) OVER ({_W}) AS b FROM events), l AS (SELECT *, sum(CASE WHEN ts - b > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER {_UPTO} AS late FROM g),
p AS (SELECT *, sum(CASE WHEN late > 0 THEN 1 ELSE 0 END) OVER {_UPTO} AS place, row_number() OVER ({_W}) AS rn FROM l)
SELECT user_id, event_id, CASE WHEN late > 0 THEN 'error' ELSE 'value' END AS signal, CASE WHEN late > 0 THEN b + INTERVAL 12 HOUR ELSE ts END AS ts, CASE WHEN late = 0 THEN value END AS value FROM p WHERE place <= 1 AND rn > 1""")
def seq_timeout(spark, d):
    return _events(spark, d).timeout(timedelta(hours=12)).df.select(*_KEY, "signal", "ts", "value")


# two sequences: a user's views and clicks

_BOTH = f"""WITH b AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS src, value FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT *, last_value(CASE WHEN src = 0 THEN value END IGNORE NULLS) OVER {_UPTO} AS "left", last_value(CASE WHEN src = 1 THEN value END IGNORE NULLS) OVER {_UPTO} AS "right" FROM b) """


def _views(spark, d) -> EventSeq:
    return _events(spark, d, "event_type = 'view'")


def _clicks(spark, d) -> EventSeq:
    return _events(spark, d, "event_type = 'click'")


@query(_BOTH + 'SELECT user_id, event_id, "left", "right" FROM l WHERE "left" IS NOT NULL AND "right" IS NOT NULL')
def seq_join(spark, d):
    return _views(spark, d).join(_clicks(spark, d)).select(*_KEY, "left", "right")


@query(_BOTH + 'SELECT user_id, event_id, "left" AS a, "right" AS b FROM l WHERE "left" IS NOT NULL AND "right" IS NOT NULL')
def seq_join_vec(spark, d):
    return _views(spark, d).join_vec(_clicks(spark, d)).select(*_KEY, F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query(_BOTH + 'SELECT user_id, event_id, "left", "right" FROM l WHERE src = 0 AND "right" IS NOT NULL')
def seq_with_latest_from(spark, d):
    return _views(spark, d).with_latest_from(_clicks(spark, d)).select(*_KEY, "left", "right")


@query(_BOTH + 'SELECT user_id, event_id, "left" FROM l WHERE src = 1 AND "left" IS NOT NULL')
def seq_sample(spark, d):
    """A user's latest view at each click."""
    return _views(spark, d).sample(_clicks(spark, d)).select(*_KEY, "left")


@query(f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM events WHERE event_type = 'view') WHERE rn > 1 UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'click'")
def seq_merge(spark, d):
    return _views(spark, d).merge(_clicks(spark, d)).select(*_KEY, "value")


@query(f"""WITH s AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT *, row_number() OVER ({_W}) AS rn FROM events WHERE event_type = 'click')
SELECT user_id, event_id, 0 AS src FROM events WHERE event_type = 'signup' UNION ALL SELECT c.user_id, event_id, 1 FROM c LEFT JOIN s ON c.user_id = s.user_id WHERE rn > 1 AND (e IS NULL OR event_id > e)""")
def seq_concat(spark, d):
    return _events(spark, d, "event_type = 'signup'").concat(_clicks(spark, d)).select(*_KEY, "src")


@query(f"""WITH a AS (SELECT *, row_number() OVER ({_W}) - 1 AS place FROM events WHERE event_type = 'view'), b AS (SELECT *, row_number() OVER ({_W}) - 1 AS place FROM events WHERE event_type = 'click')
SELECT a.user_id, a.place, a.value AS "left", b.value AS "right" FROM a JOIN b ON a.user_id = b.user_id AND a.place = b.place WHERE a.place > 0""")
def seq_zip(spark, d):
    return _views(spark, d).zip(_clicks(spark, d)).select("user_id", F.col("place").cast("long").alias("place"), "left", "right")


@query(_BOTH.replace('"left"', '"outer"').replace('"right"', '"inner"') + 'SELECT user_id, event_id, "outer", "inner" FROM l WHERE "outer" IS NOT NULL AND "inner" IS NOT NULL')
def seq_switch_map(spark, d):
    return _views(spark, d).switch_map(_clicks(spark, d)).select(*_KEY, "outer", "inner")


_BY = """WITH o AS (SELECT user_id, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS topic FROM events WHERE event_type = 'view'),
i AS (SELECT user_id, ts, event_id, value, event_id % 4 AS topic FROM events WHERE event_type = 'click') """


@query(_BY + """
SELECT o.user_id, o.event_id, o.topic AS "outer", (SELECT arg_max(i.value, i.event_id) FROM i WHERE i.user_id = o.user_id AND i.topic = o.topic AND i.event_id < o.event_id) AS "inner" FROM o
WHERE EXISTS (SELECT 1 FROM i WHERE i.user_id = o.user_id AND i.topic = o.topic AND i.event_id < o.event_id)
UNION ALL SELECT i.user_id, i.event_id, i.topic, i.value FROM i WHERE i.topic = (SELECT arg_max(o.topic, o.event_id) FROM o WHERE o.user_id = i.user_id AND o.event_id < i.event_id)""")
def seq_switch_map_by(spark, d):
    """Views open the sequence of the clicks of their topic, and close the one before."""
    outer = _views(spark, d).map(F.floor(F.col("value") / 25))
    inner = _clicks(spark, d)
    inner = EventSeq(inner.df.withColumn("topic", F.col("event_id") % 4), inner.partition, inner.order)
    return outer.switch_map(inner, by="topic").select(*_KEY, "outer", "inner")


@query("""
SELECT c.user_id, c.event_id, c.value, v.event_id AS outer_event_id FROM events c JOIN events v ON c.user_id = v.user_id AND v.event_type = 'signup' AND c.event_type = 'purchase' AND c.event_id >= v.event_id
UNION ALL SELECT v.user_id, v.event_id, arg_max(c.value, c.event_id), v.event_id FROM events c JOIN events v ON c.user_id = v.user_id AND v.event_type = 'signup' AND c.event_type = 'purchase' AND c.event_id < v.event_id GROUP BY ALL
""")
def seq_merge_map(spark, d):
    return _events(spark, d, "event_type = 'signup'").merge_map(_events(spark, d, "event_type = 'purchase'")).select(*_KEY, "value", "outer_event_id")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, value, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, value, 0 AS tries, false AS over_, CAST(NULL AS VARCHAR) AS signal FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.event_id, s.rn, s.value, CASE WHEN s.failed THEN tries + 1 ELSE 0 END, s.failed AND tries + 1 >= 3, CASE WHEN NOT s.failed THEN 'value' WHEN tries + 1 >= 3 THEN 'error' END
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1 WHERE NOT over_)
SELECT user_id, event_id, value, signal FROM r WHERE signal IS NOT NULL
""")
def seq_retry(spark, d):
    """Three failures in a row end a user's sequence."""
    s = _events(spark, d)
    s = EventSeq(s.df.select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("failed")), s.partition, s.order)
    return s.retry(3, "failed").select(*_KEY, "value", "signal")


@query("SELECT CAST(floor(event_id / 50) AS BIGINT) AS tick, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def seq_batch(spark, d):
    return _events(spark, d).batch(F.floor(F.col("event_id") / 50), ["user_id"]).select("tick", "user_id", "value")


@query("""
SELECT CAST(floor(event_id / 50) AS BIGINT) AS tick, user_id, arg_max(value, event_id) AS value, 'value' AS signal FROM events WHERE event_type <> 'error' GROUP BY 1, 2
UNION ALL SELECT CAST(floor(event_id / 50) AS BIGINT), user_id, value, 'error' FROM events WHERE event_type = 'error'""")
def seq_batch_signals(spark, d):
    """Errors are given one by one, whatever the batch coalesces."""
    s = _events(spark, d)
    s = EventSeq(s.df.withColumn("signal", F.when(F.col("event_type") == "error", "error").otherwise("value")), s.partition, s.order)
    return s.batch(F.floor(F.col("event_id") / 50), ["user_id"], "signal").select("tick", "user_id", "value", "signal")


@query("SELECT CAST(floor(event_id / 50) AS BIGINT) AS tick, user_id, event_id FROM events")
def seq_no_coalesce(spark, d):
    return _events(spark, d).no_coalesce().batch(F.floor(F.col("event_id") / 50), ["user_id"]).select("tick", *_KEY)


def _bounded(spark, d, policy: str):
    s = _events(spark, d)
    s = EventSeq(s.df.withColumn("flush", F.floor(F.col("event_id") / 500)), s.partition, s.order)
    return s.bounded("flush", 2, policy).df.select("flush", *_KEY)


_FLUSH = "SELECT CAST(floor(event_id / 500) AS BIGINT) AS flush, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(event_id / 500) ORDER BY event_id %s) <= 2"


@query(_FLUSH % "DESC")
def bounded_drop_oldest(spark, d):
    return _bounded(spark, d, "drop_oldest")


@query(_FLUSH % "ASC")
def bounded_drop_newest(spark, d):
    return _bounded(spark, d, "drop_newest")


@query("SELECT range AS tick, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (range * 1.5) AS ts, range * 1.5 AS elapsed FROM range(1000)")
def interval(spark, d):
    from keyflow.sources.tables import interval as ticks

    return ticks(spark, "2024-01-01", timedelta(seconds=1.5), 1000).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT unnest([3, 1, 2]) AS value, unnest([0, 1, 2]::BIGINT[]) AS seq, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * unnest([0, 1, 2]) AS ts")
def from_iter(spark, d):
    from keyflow.sources.tables import from_iter as replay

    return replay(spark, [3, 1, 2], "int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
