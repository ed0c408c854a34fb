"""Keyed tables and changelogs on literals."""

import pytest
from pyspark.sql import functions as F

from keyflow.operators import changes, keyed
from keyflow.operators.keyed import KeySet, KeyedTable, Relation


def table(spark, rows, ddl, key):
    return KeyedTable(spark.createDataFrame(rows, ddl), key)


@pytest.fixture(scope="module")
def users(spark):
    return table(spark, [("a", 1), ("b", None), ("c", 3)], "id string, n int", "id")


@pytest.fixture(scope="module")
def posts(spark):
    return table(spark, [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "q", "w")], "post long, user string, title string", "post")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_select_and_projections(users):
    assert rows(users.select(F.col("n") > 1).df) == [("c", 3)]
    assert rows(users.map_values(m=F.col("n") + 1).df) == [("a", 2), ("b", None), ("c", 4)]
    assert rows(users.filter_map_values(F.col("n").isNotNull(), m=-F.col("n")).df) == [("a", -1), ("c", -3)]


def test_map_entries_rejects_equal_keys(users):
    assert rows(users.map_entries({"k": F.upper("id")}, {"n": F.col("n")}).df) == [("A", 1), ("B", None), ("C", 3)]
    with pytest.raises(Exception, match="duplicate key"):
        users.map_entries({"k": F.lit("same")}, {"n": F.col("n")}).df.collect()


def test_flat_map_keeps_source_key(users):
    out = users.flat_map_entries(F.when(F.col("n") > 1, F.array(F.lit(7), F.lit(7))))
    assert out.key == ["id", "local_key"] and rows(out.df) == [("c", 0, 7), ("c", 1, 7)]


RELATION = Relation("posts", "id", "user")


def test_foreign_keys_skip_null(users, posts):
    assert rows(users.inner_join_fk(posts, RELATION).df.select("id", "post")) == [("a", 1), ("a", 2)]
    nested = {r.id: [m.post for m in r.matches] for r in users.left_join_fk(posts, RELATION).df.collect()}
    assert nested == {"a": [1, 2], "b": [], "c": []}
    assert rows(users.left_semi_join_fk(posts, RELATION).df) == [("a", 1)]


def test_computed_keys_match_null_with_null(spark, users):
    right = table(spark, [(1, None), (2, 3)], "r long, m int", "r")
    assert rows(users.inner_join_by(right, F.col("n"), F.col("m")).df.select("id", "r")) == [("b", 1), ("c", 2)]
    assert rows(users.left_semi_join_by(right, F.col("n"), F.col("m")).df.select("id")) == [("b",), ("c",)]
    nested = {r.id: [m.r for m in r.matches] for r in users.left_join_by(right, F.col("n"), F.col("m")).df.collect()}
    assert nested == {"a": [], "b": [1], "c": [2]}


def test_multi_join_takes_each_right_row_once(spark, posts):
    left = table(spark, [(1, ["a", "a", "q"]), (2, []), (3, None), (4, ["none"]), (5, [None])], "k long, names array<string>", "k")
    out = {r.k: [m.post for m in r.matches] for r in left.multi_left_join_by(posts, F.col("names"), F.col("user")).df.collect()}
    assert out == {1: [1, 2, 4], 2: [], 3: [], 4: [], 5: [3]}


def shuffled(df):
    """Bytes that the action on df before this call put into shuffles, uncompressed."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return walk(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_multi_join_gathers_a_set_of_keys_once_for_many_rows(spark):
    n, m = 2000, 300
    left = table(spark, [(i, [1, 2, 1] if i % 2 else [2, 1]) for i in range(n)], "k long, names array<int>", "k")
    right = table(spark, [(i, i % 3) for i in range(m)], "r long, of int", "r")
    df = left.multi_left_join_by(right, F.col("names"), F.col("of")).df
    assert {tuple(x.r for x in r.matches) for r in df.collect()} == {tuple(i for i in range(m) if i % 3)}
    assert 0 < shuffled(df) < 1_000_000  # some 400,000 pairs of 8 bytes a number would take more


def test_multi_join_in_shares_is_what_plain_loops_give(spark, monkeypatch):
    monkeypatch.setattr(keyed, "SHARE_ROWS", 3)
    sets = [[1, 2], [2, 1, 2], [None, 1], [None], [], None, [7], [0], [3, None, 0, 1]]
    rows_ = [(i, f"v{i}" if i % 5 else None, sets[i * i % len(sets)]) for i in range(200)]
    ours = [(i, [1, 2, 3, None, 0, 9][i % 6]) for i in range(30)]
    right = table(spark, ours, "r long, of int", "r")
    want = {i: [r for r, of in ours if keys and of in keys] for i, _, keys in rows_}
    left = table(spark, rows_, "k long, v string, names array<int>", "k")
    out = left.multi_left_join_by(right, F.col("names"), F.col("of"))
    assert {r.k: [x.r for x in r.matches] for r in out.df.collect()} == want and out.df.columns == ["k", "v", "names", "matches"]
    made = {"n": F.size, "least": lambda found: F.array_min(F.transform(found, lambda x: x["r"]))}
    out = left.multi_left_join_by(right, F.col("names"), F.col("of"), made=made).df
    assert {r.k: (r.n, r.least) for r in out.collect()} == {k: (len(x), min(x, default=None)) for k, x in want.items()}
    twice = table(spark, [(1, [1]), (1, [2]), (2, [1]), (3, [2])], "k long, names array<int>", "k")
    got = sorted((r.k, r.names, [x.of for x in r.matches]) for r in twice.multi_left_join_by(right, F.col("names"), F.col("of")).df.collect())
    assert got == [(1, [1], [1] * 5), (1, [2], [2] * 5), (2, [1], [1] * 5), (3, [2], [2] * 5)]
    two = table(spark, [(i // 20, i % 20, keys) for i, _, keys in rows_], "a int, b int, names array<int>", ["a", "b"])
    assert {20 * r.a + r.b: [x.r for x in r.matches] for r in two.multi_left_join_by(right, F.col("names"), F.col("of")).df.collect()} == want


def test_joined_values_are_what_the_nested_join_gives(users, posts):
    direct = users.map_joined_values(posts, F.col("id"), F.col("user"), {"posts": F.count(F.lit(1)), "last": F.max("post")}, {"posts": 0})
    nested = users.left_join_fk(posts, RELATION).df.select("id", "n", F.size("matches").cast("long").alias("posts"), F.array_max(F.transform("matches", lambda m: m["post"])).alias("last"))
    assert rows(direct.df) == rows(nested)


def test_groups_and_views(users, posts):
    assert {r.user: [x.post for x in r.rows] for r in posts.group_by("user", F.col("user")).df.collect()} == {"a": [1, 2], None: [3], "q": [4]}
    assert rows(posts.count_by("user", F.col("user")).df) == sorted([("a", 2), (None, 1), ("q", 1)], key=repr)
    nested = posts.nest(F.col("user"))
    assert [r.post for r in nested.children_of("a").collect()] == [1, 2] and nested.lookup_parent(4).first()[0] == "q"
    assert users.contains_key("a") and not users.contains_key("zz") and users.get_value("c").n == 3 and users.size().first()[0] == 3
    assert not users.is_empty() and len(users.snapshot()) == 3 and "id" in users.describe()["key"]


def test_sets(spark):
    s = KeySet(spark.createDataFrame([(1,), (1,), (2,)], "v int"), "v")
    s = s.insert(spark.createDataFrame([(3,)], "v int")).remove(spark.createDataFrame([(1,)], "v int"))
    assert rows(s.df) == [(2,), (3,)] and s.contains(3) and not s.contains(1)


def test_diff_is_null_safe_and_applies(spark, users):
    new = table(spark, [("a", 1), ("b", 2), ("d", None)], "id string, n int", "id")
    log = changes.diff(users, new)
    assert sorted((r.op, r.id) for r in log.collect()) == [("insert", "d"), ("remove", "c"), ("update", "b")]
    back = changes.apply_changes(users, log.withColumn("ord", F.lit(1)))
    assert rows(back.df) == rows(new.df)
    assert changes.diff(back, new).isEmpty()


def test_the_last_change_of_a_batch_holds(spark, users):
    ddl = "ord int, op string, id string, new struct<n: int>"
    log = spark.createDataFrame([(1, "update", "a", (9,)), (2, "remove", "a", None), (3, "insert", "e", (5,)), (4, "update", "c", (3,))], ddl)
    assert rows(changes.apply_changes(users, log).df) == [("b", None), ("c", 3), ("e", 5)]
    assert sorted((r.op, r.id) for r in changes.effective(users, log).collect()) == [("insert", "e"), ("remove", "a")]


def test_a_row_that_moves_leaves_its_old_parent(spark):
    old = table(spark, [(1, "p"), (2, "p"), (3, None)], "k long, parent string", "k")
    new = table(spark, [(1, "q"), (3, "p")], "k long, parent string", "k")
    out = rows(changes.grouped_changes(changes.diff(old, new), "parent", ["k"]))
    assert out == [("p", "insert", 3), ("p", "remove", 1), ("p", "remove", 2), ("q", "insert", 1)]
