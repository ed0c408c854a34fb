"""Keyed tables: DataFrames with a unique key, and the relational operators between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one set of keys (multi_left_join_by) that share one copy of its matches, and the most copies of a set's.
SHARE_ROWS, SHARES = 4_000, 64


@dataclass(frozen=True)
class Relation:
    """A named foreign-key relation: which column of the child holds the parent's key. NULL means no parent."""

    name: str
    parent_key: str
    child_fk: str


def assert_unique_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df, of which any action fails if a key occurs twice."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key))
    fail = F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*key))))
    return df.withColumn("__copies", copies).filter(F.when(F.col("__copies") > 1, fail.cast("boolean")).otherwise(F.lit(True))).drop("__copies")


class KeyedTable:
    """Rows by key. All operators are lazy; nothing is read before an action on ``df``."""

    def __init__(self, df: DataFrame, key: str | Sequence[str], name: str = ""):
        self.df, self.key, self.name = df, [key] if isinstance(key, str) else list(key), name

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key]

    def _with(self, df: DataFrame, key: Sequence[str] | None = None) -> KeyedTable:
        return KeyedTable(df, self.key if key is None else list(key), self.name)

    # rows

    def select(self, condition: Column) -> KeyedTable:
        """Rows whose values meet the condition (which may use the key as well: select_by)."""
        return self._with(self.df.filter(condition))

    select_by = select

    def map_values(self, **columns: Column) -> KeyedTable:
        """The same keys with new values."""
        return self._with(self.df.select(*self.key, *[c.alias(n) for n, c in columns.items()]))

    def filter_map_values(self, keep: Column, **columns: Column) -> KeyedTable:
        """New values for the rows that have one."""
        return self._with(self.df.filter(keep).select(*self.key, *[c.alias(n) for n, c in columns.items()]))

    def map_entries(self, key: dict[str, Column], values: dict[str, Column]) -> KeyedTable:
        """New keys and values; an action fails where two rows get the same key."""
        df = self.df.select(*[c.alias(n) for n, c in (key | values).items()])
        return self._with(assert_unique_key(df, list(key)), list(key))

    def filter_map_entries(self, keep: Column, key: dict[str, Column], values: dict[str, Column]) -> KeyedTable:
        return self.select(keep).map_entries(key, values)

    def flat_map_entries(self, items: Column, local_key: str = "local_key", value: str = "item") -> KeyedTable:
        """A row for each element of an array, under (key, place in the array)."""
        return self._with(self.df.select(*self.key, F.posexplode(items).alias(local_key, value)), [*self.key, local_key])

    # a live value for each row

    def select_cell(self, gates: DataFrame, by: str, order: str, gate: str) -> KeyedTable:
        """Rows whose latest gate (by order, for the row's value of ``by``) is true."""
        latest = gates.groupBy(by).agg(F.max_by(gate, order).alias("__gate")).filter("__gate").select(by)
        return self._with(self.df.join(latest, by, "left_semi"))

    def project_cell(self, cells: DataFrame, by: str, order: str, cell: str, key: dict[str, Column], values: dict[str, Column]) -> KeyedTable:
        """Entries made from a row and its latest live value; rows without one have none."""
        latest = cells.groupBy(by).agg(F.max_by(cell, order).alias(cell)).filter(F.col(cell).isNotNull())
        return self._with(self.df.join(latest, by).select(*[c.alias(n) for n, c in (key | values).items()]), list(key))

    # joins

    def inner_join(self, right: KeyedTable) -> KeyedTable:
        """Rows of both with the same key."""
        return self._with(self.df.join(right.df.toDF(*[*self.key, *right.values]), self.key))

    def inner_join_fk(self, right: KeyedTable, relation: Relation) -> KeyedTable:
        """Each right row with the row that its foreign key names, under both keys."""
        on = self.df[relation.parent_key] == right.df[relation.child_fk]
        return self._with(self.df.join(right.df, on), [*self.key, *right.key])

    def inner_join_by(self, right: KeyedTable, left_on: Column, right_on: Column) -> KeyedTable:
        """All pairs with equal computed keys, under both keys; NULL equals NULL."""
        joined = self.df.withColumn("__on", left_on).join(right.df.withColumn("__on_right", right_on), F.col("__on").eqNullSafe(F.col("__on_right")))
        return self._with(joined.drop("__on", "__on_right"), [*self.key, *right.key])

    def _matches(self, right: KeyedTable, on: Column, aggregates: dict[str, Column]) -> DataFrame:
        return right.df.groupBy(on.alias("__on")).agg(*[c.alias(n) for n, c in aggregates.items()])

    @staticmethod
    def nested(right: KeyedTable) -> Column:
        """The right rows as an array in the order of their keys."""
        return F.sort_array(F.collect_list(F.struct(*right.key, *right.values)))

    def left_join_by(self, right: KeyedTable, left_on: Column, right_on: Column, null_safe: bool = True, name: str = "matches") -> KeyedTable:
        """Each row with the array of its right rows; an empty one where there are none."""
        kind = right.df.select(F.array(F.struct(*right.key, *right.values)).alias("x")).schema["x"].dataType
        found = self._matches(right, right_on, {name: self.nested(right)})
        return self._left(found, left_on, null_safe, {name: F.coalesce(F.col(name), F.array().cast(kind))})

    def left_join(self, right: KeyedTable, name: str = "matches") -> KeyedTable:
        return self.left_join_by(right, F.struct(*self.key), F.struct(*[F.col(c).alias(k) for k, c in zip(self.key, right.key, strict=True)]), False, name)

    def left_join_fk(self, right: KeyedTable, relation: Relation, name: str = "matches") -> KeyedTable:
        return self.left_join_by(right, F.col(relation.parent_key), F.col(relation.child_fk), False, name)

    def map_joined_values(self, right: KeyedTable, left_on: Column, right_on: Column, aggregates: dict[str, Column], empty: dict[str, object] | None = None, null_safe: bool = False) -> KeyedTable:
        """Each row with aggregates of its right rows, which are aggregated before the join: no array is ever made."""
        found = self._matches(right, right_on, aggregates)
        empty = empty or {}
        return self._left(found, left_on, null_safe, {n: F.coalesce(F.col(n), F.lit(empty[n])) if n in empty else F.col(n) for n in aggregates})

    def _left(self, found: DataFrame, left_on: Column, null_safe: bool, columns: dict[str, Column]) -> KeyedTable:
        left, found = self.df.withColumn("__left", left_on), found.withColumnRenamed("__on", "__right")
        on = F.col("__left").eqNullSafe(F.col("__right")) if null_safe else F.col("__left") == F.col("__right")
        return self._with(left.join(found, on, "left").select(*self.df.columns, *[c.alias(n) for n, c in columns.items()]))

    def left_semi_join(self, right: KeyedTable) -> KeyedTable:
        return self._with(self.df.join(right.df.select(*[F.col(c).alias(k) for k, c in zip(self.key, right.key, strict=True)]), self.key, "left_semi"))

    def left_semi_join_fk(self, right: KeyedTable, relation: Relation) -> KeyedTable:
        return self._with(self.df.join(right.df, self.df[relation.parent_key] == right.df[relation.child_fk], "left_semi"))

    def left_semi_join_by(self, right: KeyedTable, left_on: Column, right_on: Column) -> KeyedTable:
        """Rows with a match on computed keys; NULL equals NULL."""
        keys = right.df.select(right_on.alias("__right"))
        left = self.df.withColumn("__left", left_on)
        return self._with(left.join(keys, F.col("__left").eqNullSafe(F.col("__right")), "left_semi").drop("__left"))

    def multi_left_join_by(self, right: KeyedTable, left_keys: Column, right_on: Column, name: str = "matches", made: dict[str, Callable[[Column], Column]] | None = None) -> KeyedTable:
        """Each row with the right rows that match any key of an array, each right row once; NULL equals NULL.

        Matches are gathered for each distinct set of keys (for each share of the rows, where many have a set), so that
        what is shuffled doesn't grow with rows times matches. ``made``: columns to make there of the matches, in place of the array.
        """
        made = made or {name: lambda matches: matches}
        none = F.array().cast(right.df.select(F.array(F.struct(*right.key, *right.values)).alias("x")).schema["x"].dataType)
        asks = reduce(and_, [F.col(k).isNotNull() for k in self.key], F.size(left_keys) > 0)
        left = self.df.withColumn("__set", F.when(asks, F.sort_array(F.array_distinct(left_keys))))
        # stands for the set, which may be long: the least key that has it, and its hash, lest sets mix where a key comes twice against the contract
        first = F.struct(F.min(self.key[0] if len(self.key) == 1 else F.struct(*self.key)), F.xxhash64("__set"), F.size("__set"))
        shares = F.least(F.ceil(F.count(F.lit(1)) / SHARE_ROWS), F.lit(SHARES))
        sets = left.filter(F.size("__set") > 0).groupBy("__set").agg(first.alias("__first"), shares.alias("__shares"))
        pairs = sets.select("__first", "__shares", F.explode("__set").alias("__left"))
        pairs = pairs.join(right.df.withColumn("__right", right_on), F.col("__left").eqNullSafe(F.col("__right")))
        pairs = pairs.withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
        found = pairs.groupBy("__first", "__share").agg(self.nested(right).alias("__found"))  # a set's keys are distinct and a right row has one: no pair comes twice
        found = found.select(F.col("__first").alias("__of"), F.col("__share").alias("__part"), *[f(F.col("__found")).alias(f"__made_{n}") for n, f in made.items()])
        left = left.join(sets.withColumnRenamed("__set", "__asked"), F.col("__set") == F.col("__asked"), "left")
        left = left.withColumn("__share", F.pmod(F.xxhash64(*self.key), F.coalesce("__shares", F.lit(SHARES))))
        left = left.join(found, (F.col("__first") == F.col("__of")) & (F.col("__share") == F.col("__part")), "left")
        return self._with(left.select(*self.df.columns, *[F.when(F.col("__of").isNull(), f(none)).otherwise(F.col(f"__made_{n}")).alias(n) for n, f in made.items()]))

    # groups

    def group_by(self, group: str, on: Column, name: str = "rows") -> KeyedTable:
        """For each group its rows as an array in the order of their keys."""
        return self._with(self.df.groupBy(on.alias(group)).agg(self.nested(self).alias(name)), [group])

    def count_by(self, group: str, on: Column, name: str = "n") -> KeyedTable:
        return self._with(self.df.groupBy(on.alias(group)).agg(F.count(F.lit(1)).alias(name)), [group])

    def nest(self, parent: Column, name: str = "parent_key") -> NestedTable:
        return NestedTable(self.df.withColumn(name, parent), self.key, name)

    # views and point reads

    def get(self, *key) -> DataFrame:
        """The row of one key, or none."""
        condition = F.lit(True)
        for k, v in zip(self.key, key, strict=True):
            condition &= F.col(k) == F.lit(v)
        return self.df.filter(condition)

    def contains_key(self, *key) -> bool:
        return not self.get(*key).isEmpty()

    def get_value(self, *key):
        return self.get(*key).select(*self.values).first()

    def entries(self) -> DataFrame:
        return self.df

    def items(self) -> DataFrame:
        return self.df.select(*self.values)

    def keys(self) -> DataFrame:
        return self.df.select(*self.key)

    def size(self, name: str = "size") -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias(name))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def for_each(self, f: Callable) -> None:
        for row in self.df.toLocalIterator():
            f(row)

    def snapshot(self) -> list:
        return self.df.collect()

    def share(self) -> KeyedTable:
        """One computation for several readers."""
        return self._with(self.df.persist())

    def materialize(self, path: str) -> KeyedTable:
        """The table written as Parquet and read from there."""
        self.df.write.mode("overwrite").parquet(path)
        return self._with(self.df.sparkSession.read.schema(self.df.schema).parquet(path))

    def describe(self) -> dict:
        """What this view depends on."""
        plan = self.df._jdf.queryExecution().optimizedPlan()
        return {"name": self.name, "key": self.key, "files": list(self.df.inputFiles()), "plan": plan.toString()}


class NestedTable(KeyedTable):
    """A table whose rows are grouped under a parent's key; NULL: under none."""

    def __init__(self, df: DataFrame, key: Sequence[str], parent: str):
        super().__init__(df, key)
        self.parent = parent

    def children_of(self, parent) -> DataFrame:
        return self.df.filter(F.col(self.parent) == F.lit(parent))

    def lookup_parent(self, *key) -> DataFrame:
        return self.get(*key).select(self.parent)

    def grouped(self, name: str = "children") -> DataFrame:
        return self.df.filter(F.col(self.parent).isNotNull()).groupBy(self.parent).agg(F.sort_array(F.collect_set(F.struct(*self.key))).alias(name))


class KeySet(KeyedTable):
    """A set: a table that is all key."""

    def __init__(self, df: DataFrame, column: str):
        super().__init__(df.select(column).distinct(), column)

    def insert(self, values: DataFrame) -> KeySet:
        return KeySet(self.df.unionByName(values.select(*self.key)), self.key[0])

    def remove(self, values: DataFrame) -> KeySet:
        return KeySet(self.df.join(values.select(*self.key), self.key, "left_anti"), self.key[0])

    def contains(self, value) -> bool:
        return self.contains_key(value)
