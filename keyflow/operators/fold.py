"""Folds over ordered sequences, for operators that depend on what they gave before.

Rows come to Python as Arrow batches, sorted, one sequence after the other; values keep their types (no pandas), and only a
state is held between batches, however long a sequence is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def fold_native(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, init: Column, step: Callable[[Column, Column], Column], name: str = "state") -> DataFrame:
    """The last state of each partition, by an SQL aggregate over its sorted events: no Python; a partition must fit in memory."""
    events = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*partition).agg(events.alias("__e")).select(*partition, F.aggregate(F.transform("__e", lambda x: x["__v"]), init, step).alias(name))


def _numbered(df: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with each row's place in its sequence, each sequence's rows together and in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def _stretches(n: list[int]) -> list[tuple[int, int]]:
    """Where the sequences of a batch begin and end; the first may go on from the batch before."""
    begins = [i for i, x in enumerate(n) if x == 1 or i == 0]
    return list(zip(begins, [*begins[1:], len(n)], strict=True))


def fold_sequence(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], schema: str, init: Callable[[], object],
    step: Callable[[object, tuple], tuple[object, Iterable[tuple]]], finish: Callable[[object], Iterable[tuple]] = lambda state: (),
) -> DataFrame:
    """Rows that step gives for each event in order, and finish at the end of each partition; the partition's columns come first.

    step(state, event) gives the next state and rows; an event is a tuple in the order of df's columns, with exact values:
    NULL is None, NaN stays NaN. schema: of the rows, with the partition's columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    part, out_schema = list(partition), StructType.fromDDL(schema)
    at = [df.columns.index(c) for c in part]

    def run(batches):
        kind = to_arrow_schema(out_schema)
        key, state, out = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for batch in batches:
            *columns, places = [c.to_pylist() for c in batch.columns]
            for event, n in zip(zip(*columns, strict=True), places, strict=True):
                if n == 1:
                    if key is not None:
                        out += [key + tuple(r) for r in finish(state)]
                    key, state = tuple(event[i] for i in at), init()
                state, made = step(state, event)
                out += [key + tuple(r) for r in made]
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        if key is not None:
            out += [key + tuple(r) for r in finish(state)]
        yield batch_of(out)

    return _numbered(df, part, order).mapInArrow(run, schema)


def pick_sequence(df: DataFrame, partition: Sequence[str], order: Sequence[str], uses: Sequence[str], pick: Callable[[object, list[list]], tuple], label: str | None = None) -> DataFrame:
    """The events that pick chooses, all their columns as they are.

    pick(state, columns) gets one sequence's events, as far as a batch has them: the columns ``uses`` as lists (timestamps as
    microseconds). It gives the next state and the places chosen, ascending; with ``label`` also a text for each of them,
    which becomes a column of that name. The first state is None. Other columns never become Python values.
    """
    kinds = StructType([*df.schema.fields, StructField(label, StringType())] if label else df.schema.fields)

    def run(batches):
        state = None
        for batch in batches:
            plain = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in (batch.column(u) for u in uses)]
            columns, places = [c.to_pylist() for c in plain], batch.column("__n").to_pylist()
            chosen, labels = [], []
            for a, b in _stretches(places):
                state = None if places[a] == 1 else state
                state, some, *texts = pick(state, [c[a:b] for c in columns])
                chosen += [a + i for i in some]
                labels += texts[0] if texts else []
            out = batch.drop_columns(["__n"]).take(pa.array(chosen, pa.int64()))
            yield out.append_column(label, pa.array(labels, pa.string())) if label else out

    return _numbered(df, partition, order).mapInArrow(run, kinds)
