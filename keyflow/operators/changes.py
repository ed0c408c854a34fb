"""Changelogs of keyed tables: (batch_id, ord, op, key…, old struct, new struct), op being insert, update or remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyflow.operators.keyed import KeyedTable


def diff(old: KeyedTable, new: KeyedTable) -> DataFrame:
    """(op, key…, old, new) of each key whose row differs; equal rows (NULL and NaN equal themselves) give nothing."""
    a = old.df.select(*old.key, F.struct(*old.values).alias("old"))
    b = new.df.select(*[F.col(c).alias(k) for k, c in zip(old.key, new.key, strict=True)], F.struct(*old.values).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").otherwise("update")
    return a.join(b, old.key, "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), *old.key, "old", "new")


#: Putting new contents in the place of all old ones changes just what differs.
replace_all = diff


def since_reset(log: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The changes from the last ``initial`` on, its own rows being inserts; and its place, a row with NULL if there is none.

    A reset replaces all contents: its rows share one place and have op ``initial``; one with a NULL key and a NULL new says
    that nothing comes in its place.
    """
    reset = log.agg(F.max(F.when(F.col("op") == "initial", F.col(order))).alias("__reset"))
    since = reset.scalar()
    return log.filter(since.isNull() | (F.col(order) >= since)), reset


def _entries(log: DataFrame, key: list[str]) -> DataFrame:
    """The log without the rows that only say that all is gone."""
    none = F.col("op") == "initial"
    for k in key:
        none = none & F.col(k).isNull()
    return log.filter(~none)


def coalesce(log: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """The last change of each key."""
    return log.groupBy(*key).agg(F.max_by(F.struct("op", "new"), order).alias("last")).select(*key, "last.op", "last.new")


def apply_changes(state: KeyedTable, log: DataFrame, order: str = "ord", resets: bool = False) -> KeyedTable:
    """state after the changes, of which the last of each key holds. resets: whether the log may have ``initial`` rows."""
    rows = state.df
    if resets:
        log, reset = since_reset(log, order)
        log, rows = _entries(log, state.key), rows.filter(reset.scalar().isNull())
    last = coalesce(log, state.key, order)
    kept = rows.join(last.select(*state.key), state.key, "left_anti")
    put = last.filter("op <> 'remove'").select(*state.key, *[F.col(f"new.`{c}`").alias(c) for c in state.values])
    return KeyedTable(kept.unionByName(put.select(*state.df.columns)), state.key)


def upsert(state: KeyedTable, rows: DataFrame) -> KeyedTable:
    """state with rows put in by key."""
    return KeyedTable(state.df.join(rows.select(*state.key), state.key, "left_anti").unionByName(rows.select(*state.df.columns)), state.key)


def remove(state: KeyedTable, keys: DataFrame) -> KeyedTable:
    return KeyedTable(state.df.join(keys.select(*state.key), state.key, "left_anti"), state.key)


def effective(state: KeyedTable, log: DataFrame, order: str = "ord", resets: bool = False) -> DataFrame:
    """The changes that a log makes to state, coalesced: (op, key…, old, new), without those that change nothing."""
    old = state.df.select(*state.key, F.struct(*state.values).alias("old"))
    how, gone = "left", F.lit(False)
    if resets:
        log, reset = since_reset(log, order)
        log, how = _entries(log, state.key), "full"
        gone = F.col("__op").isNull()  # a row of the state that the log doesn't name goes with a reset only
    last = coalesce(log, state.key, order).withColumnRenamed("op", "__op")
    new = F.when(F.col("__op") == "remove", F.lit(None)).otherwise(F.col("new"))
    joined = last.withColumn("new", new).join(old, state.key, how)
    if resets:
        joined = joined.filter(~gone | reset.scalar().isNotNull())
    joined = joined.filter(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").otherwise("update")
    return joined.select(op.alias("op"), *state.key, "old", "new")


def key_changes(log: DataFrame, key: list[str]) -> DataFrame:
    """Keys that came or went; an update changes no key."""
    return log.filter("op in ('insert', 'remove')").select(*[c for c in log.columns if c in ("batch_id", "ord")], "op", *key)


def running_size(log: DataFrame, start: int = 0) -> DataFrame:
    """(batch_id, size): rows after each batch. Batches are summed first, so that only those go to the running sum."""
    step = F.when(F.col("op") == "insert", 1).when(F.col("op") == "remove", -1).otherwise(0)
    batches = log.groupBy("batch_id").agg(F.sum(step).alias("step"))
    return batches.select("batch_id", (F.sum("step").over(Window.orderBy("batch_id")) + F.lit(start)).cast("long").alias("size"))


def grouped_changes(log: DataFrame, parent: str, key: list[str]) -> DataFrame:
    """Changes by parent: a row that moves leaves its old parent and comes to the new one."""
    a, b = F.col(f"old.{parent}"), F.col(f"new.{parent}")
    moved = (F.col("op") == "update") & ~a.eqNullSafe(b)
    tagged = F.when(moved, F.array(F.struct(F.lit("remove").alias("op"), a.alias("parent")), F.struct(F.lit("insert").alias("op"), b.alias("parent"))))
    tagged = tagged.otherwise(F.array(F.struct(F.col("op").alias("op"), F.coalesce(b, a).alias("parent"))))
    return log.select(*key, F.explode(tagged).alias("t")).select("t.parent", "t.op", *key).filter("parent is not null")


def watch_key(log: DataFrame, condition: Column, value: str) -> DataFrame:
    """The values that one key has over time; NULL once it is removed."""
    return log.filter(condition).select("batch_id", "ord", F.col(f"new.{value}").alias(value))
