"""A live view after random changes is what its definition gives over the changed tables."""

import random

import pytest
from pyspark.sql import functions as F

from keyflow.operators.keyed import KeyedTable
from keyflow.streaming.views import BoundedOutput, LiveView, Subscription, restarting


def _define(roots):
    return roots["left"].map_joined_values(roots["right"], F.col("k"), F.col("fk"), {"n": F.count(F.lit(1)), "total": F.sum("v")}, {"n": 0, "total": 0})


def test_view_follows_random_changes(spark, tmp_path):
    rng, left, right = random.Random(4), {i: i * 10 for i in range(6)}, {i: (i % 4, i) for i in range(10)}

    def frames():
        return {
            "left": KeyedTable(spark.createDataFrame(list(left.items()), "k long, a long"), "k"),
            "right": KeyedTable(spark.createDataFrame([(k, *v) for k, v in right.items()], "r long, fk long, v long"), "r"),
        }

    view = LiveView(spark, str(tmp_path / "view"), frames(), _define, {"left": "k", "right": "fk"}, "k")
    seen: list = []
    stop = view.subscribe(lambda batch, df: seen.append((batch, df.count())))
    for step in range(4):
        logs = {"left": [], "right": []}
        for ord_ in range(12):
            if rng.random() < 0.5:
                k = rng.randrange(8)
                if rng.random() < 0.3:
                    left.pop(k, None)
                    logs["left"].append((ord_, "remove", k, None))
                else:
                    left[k] = rng.randrange(3)
                    logs["left"].append((ord_, "update", k, (left[k],)))
            else:
                k = rng.randrange(14)
                if rng.random() < 0.3:
                    right.pop(k, None)
                    logs["right"].append((ord_, "remove", k, None))
                else:
                    right[k] = (rng.choice([0, 1, 2, 3, 9, None]), rng.randrange(5))
                    logs["right"].append((ord_, "update", k, right[k]))
        frames_ = {
            "left": spark.createDataFrame(logs["left"], "ord int, op string, k long, new struct<a: long>"),
            "right": spark.createDataFrame(logs["right"], "ord int, op string, r long, new struct<fk: long, v: long>"),
        }
        view.apply(step, frames_)
        want = sorted(map(tuple, _define(frames()).df.select("k", "a", "n", "total").collect()))
        assert sorted(map(tuple, view.output.df.select("k", "a", "n", "total").collect())) == want
    assert len(seen) == 5
    stop()
    with pytest.raises(ValueError):
        view.apply(0, {})


def _tables(spark, right=((0, 1, 5),)):
    return {"left": KeyedTable(spark.createDataFrame([(1, 10), (2, 20)], "k long, a long"), "k"), "right": KeyedTable(spark.createDataFrame(list(right), "r long, fk long, v long"), "r")}


def _right(spark, *rows):
    return {"right": spark.createDataFrame(list(rows), "ord int, op string, r long, new struct<fk: long, v: long>")}


def _rows(view):
    return sorted(map(tuple, view.output.df.select("k", "n", "total").collect()))


def test_a_view_goes_on_after_a_restart(spark, tmp_path):
    schema = "ord int, op string, r long, new struct<fk: long, v: long>"
    view = lambda: LiveView(spark, str(tmp_path / "view"), _tables(spark), _define, {"left": "k", "right": "fk"}, "k")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for i in (1, 2):
        spark.createDataFrame([(0, "insert", i, (1, 7))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        now = view()
        assert now.version == i - 2
        now.follow({"right": stream()}, str(tmp_path / "cp")).awaitTermination()
        assert _rows(now) == [(1, 1 + i, 5 + 7 * i), (2, 0, 0)]
    assert _rows(view()) == [(1, 3, 19), (2, 0, 0)]
    assert [(r.batch_id, r.changed) for r in view().report().orderBy("batch_id").collect()] == [(0, {"right": 1, "output": 1}), (1, {"right": 1, "output": 1})]


@pytest.mark.parametrize("cut", ["root", "output", "record"])
def test_a_batch_cut_short_is_done_again(spark, tmp_path, monkeypatch, cut):
    make = lambda: LiveView(spark, str(tmp_path / "view"), _tables(spark), _define, {"left": "k", "right": "fk"}, "k", full_every=2)
    view = make()
    view.apply(0, _right(spark, (0, "insert", 5, (2, 3))))

    def die(*_):
        raise KeyboardInterrupt

    if cut == "record":
        monkeypatch.setattr(view, "_record", die)
    else:
        monkeypatch.setattr(view.stored["right" if cut == "root" else "output"], "copy" if cut == "output" else "put", die)
    with pytest.raises(KeyboardInterrupt):
        view.apply(1, _right(spark, (0, "update", 5, (1, 3)), (1, "remove", 0, None)))
    again = make()
    assert again.version == 0 and _rows(again) == [(1, 1, 5), (2, 1, 3)]
    again.apply(1, _right(spark, (0, "update", 5, (1, 3)), (1, "remove", 0, None)))
    again.apply(2, _right(spark, (0, "insert", 8, (2, 9))))
    assert _rows(again) == _rows(make()) == [(1, 1, 3), (2, 1, 9)]
    for i in range(3, 7):
        again.apply(i, _right(spark, (0, "insert", 8, (2, 9 + i))))
    assert _rows(again) == _rows(make()) == [(1, 1, 3), (2, 1, 15)]
    assert len(list((tmp_path / "view" / "root-right" / "full").iterdir())) <= 3


def test_a_batch_writes_only_what_it_changes(spark, tmp_path):
    tables = _tables(spark, [(i, i % 1000, i) for i in range(100_000)])
    tables["left"] = KeyedTable(spark.range(1000).selectExpr("id as k", "id as a"), "k")
    view = LiveView(spark, str(tmp_path / "view"), tables, _define, {"left": "k", "right": "fk"}, "k")
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "view").rglob("*.parquet"))
    before = size()
    view.apply(0, _right(spark, (0, "update", 5, (6, 1))))
    assert size() - before < before / 10
    assert {tuple(r) for r in view.output.df.filter("k in (5, 6)").select("k", "n").collect()} == {(5, 99), (6, 101)}


def test_several_roots_and_readers(spark, tmp_path):
    rows = [("right", 0, "insert", '{"r": 4, "fk": 2, "v": 8}'), ("left", 1, "update", '{"k": 2, "a": 10}'), ("right", 2, "remove", '{"r": 0}')]
    spark.createDataFrame(rows, "root string, ord int, op string, entry string").coalesce(1).write.parquet(str(tmp_path / "log"))
    view = LiveView(spark, str(tmp_path / "view"), _tables(spark), _define, {"left": "k", "right": "fk"}, "k")
    grouped, one, said = [], [], []

    def bad(batch, df):
        if batch >= 0:
            raise ValueError("no")

    view.subscribe(bad)
    view.subscribe_result(lambda batch, df: said.append(batch) or ("late" if batch >= 0 else None))
    view.subscribe_grouped("a", lambda batch, df: grouped.append(sorted(map(tuple, df.collect()))))
    view.subscribe_parent("a", 10, lambda batch, df: one.append(sorted(map(tuple, df.collect()))))
    view.follow(spark.readStream.schema("root string, ord int, op string, entry string").parquet(str(tmp_path / "log")), str(tmp_path / "cp")).awaitTermination()
    assert _rows(view) == [(1, 0, 0), (2, 1, 8)]
    assert grouped == [[(10, "insert", 1), (20, "insert", 2)], [(10, "insert", 2), (10, "update", 1), (20, "remove", 2)]]
    assert one == [[("insert", 1)], [("insert", 2), ("update", 1)]]
    assert said == [-1, 0] and sorted(str(e) for _, e in view.failures) == ["late", "no"]


def test_resets(spark):
    from keyflow.operators import changes

    state = KeyedTable(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k long, v long"), "k")
    log = spark.createDataFrame([(0, "insert", 9, (9,)), (1, "initial", 1, (1,)), (1, "initial", 4, (4,)), (2, "update", 4, (5,))], "ord int, op string, k long, new struct<v: long>")
    assert sorted(map(tuple, changes.apply_changes(state, log, resets=True).df.collect())) == [(1, 1), (4, 5)]
    assert sorted((r.op, r.k) for r in changes.effective(state, log, resets=True).collect()) == [("insert", 4), ("remove", 2), ("remove", 3)]
    empty = spark.createDataFrame([(0, "initial", None, None)], log.schema)
    assert changes.apply_changes(state, empty, resets=True).df.count() == 0 and changes.effective(state, empty, resets=True).count() == 3
    plain = log.filter("ord = 0")
    assert changes.apply_changes(state, plain, resets=True).df.count() == 4 and changes.effective(state, plain, resets=True).count() == 1


def test_sources_and_bounded_inputs(spark, tmp_path):
    import threading

    from keyflow.sources.inputs import BoundedInput, Source

    source = Source(spark, str(tmp_path / "s"), "int")
    with source.batched():
        source.emit(1)
        source.emit(2)
    source.emit(3)
    source.complete()
    source.emit(4)
    assert [tuple(r) for r in source.events().orderBy("seq").collect()] == [(0, "value", 1), (1, "value", 2), (2, "value", 3), (3, "complete", None)]
    sizes: list = []
    q = source.stream().writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(sizes) == [1, 1, 2]
    newest = BoundedInput(Source(spark, str(tmp_path / "n"), "int"), 2, "drop_newest")
    assert [newest.push(i) for i in range(3)] == [True, True, False] and newest.flush() == 2
    assert newest.metrics() == {"total_pushed": 2, "dropped_count": 1, "backpressure_events": 1}
    newest.close()
    assert not newest.push(1) and [r.signal for r in newest.source.events().orderBy("seq").collect()] == ["value", "value", "complete"]
    failing = BoundedInput(Source(spark, str(tmp_path / "e"), "int"), 1, "error")
    assert failing.push(1) and not failing.push(2) and failing.closed
    waiting = BoundedInput(Source(spark, str(tmp_path / "b"), "int"), 1, "block")
    assert waiting.push(1) and not waiting.push(2, timeout=0.01)
    threading.Timer(0.2, waiting.flush).start()
    assert waiting.push(3)


def test_async_readers_wait_for_rows(spark, tmp_path):
    import asyncio

    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    out = BoundedOutput(4)
    out.follow(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))

    async def read():
        return [r.id async for r in out.stream()]

    assert sorted(asyncio.run(read())) == list(range(30))


def test_profile(spark):
    from keyflow.streaming.views import profiled

    assert {r["name"]: r["rows"] for r in profiled({"a": spark.range(5), "b": spark.range(7)})} == {"a": 5, "b": 7}


def test_bounded_output(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    out = BoundedOutput(4, dropping=True)
    restarting(lambda: out.follow(stream(), str(tmp_path / "cp")), 2)
    assert len(list(out)) == 4 and out.dropped == 6 and out.try_recv() is None
    with Subscription(stream().writeStream.format("memory").queryName("x").start()) as s:
        query = s.queries[0]
    assert not query.isActive


def test_registered_queries_have_sql():
    from keyflow.plans import registry

    assert len(registry.QUERIES) > 90 and set(registry.QUERIES) == set(registry.ORACLE_SQL)
