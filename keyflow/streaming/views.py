"""Live views: tables and what is derived from them, kept up to date by micro-batches of changes.

A view has root tables and a definition whose output keys depend on known columns of the roots' rows. A batch is coalesced by
key, rows whose change has no effect are dropped, and the definition is evaluated again only for the output keys that the
old or the new rows touch. What a batch writes is the changes that it makes; a table is its last full copy and the changes
since, and is copied anew every so many batches. A record of each batch, written last, says that it is done: a view that is
opened again in its folder goes on from there, and a batch that was cut short is done again under the same names.
"""

from __future__ import annotations

import asyncio
import queue
import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.functions.files import delete
from keyflow.operators import changes
from keyflow.operators.keyed import KeyedTable

_RECORD = "batch_id long, base long, touched array<string>, seconds double, changed map<string, long>"


class _Stored:
    """A table in a folder: a full copy, and the changes of later batches."""

    def __init__(self, spark: SparkSession, folder: str, table: KeyedTable):
        self.spark, self.folder, self.key, self.schema = spark, folder, table.key, table.df.schema
        one = table.df.select(F.struct(*table.values).alias("x")).schema["x"].dataType.simpleString()
        keys = ", ".join(f"`{k}` {self.schema[k].dataType.simpleString()}" for k in self.key)
        self.changes_schema = f"op string, {keys}, old {one}, new {one}, ord long"
        self.base, self.batches, self.superseded = -1, [], []

    def copy(self, table: KeyedTable, version: int) -> None:
        table.df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/full/v{version}")

    def put(self, made: DataFrame, batch: int) -> DataFrame:
        """Writes a batch's changes and gives them as they were written."""
        made.withColumn("ord", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/changes/v{batch}")
        return self.log([batch])

    def log(self, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(self.changes_schema).parquet(*[f"{self.folder}/changes/v{b}" for b in batches])

    def table(self, batches: list[int] | None = None) -> KeyedTable:
        full = KeyedTable(self.spark.read.schema(self.schema).parquet(f"{self.folder}/full/v{self.base}"), self.key)
        batches = self.batches if batches is None else batches
        return changes.apply_changes(full, self.log(batches)) if batches else full


class LiveView:
    """define(roots) gives the output table; touches[root]: the column of that root's rows which is an output key.

    folder: where the view is kept. If a view is there already, it is opened as it was after its last batch, and the roots
    given only say its columns. A view belongs to one stream's checkpoint: batches are told apart by their ids. full_every:
    after so many batches the tables are copied in full, and what they replace is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, roots: dict[str, KeyedTable], define: Callable[[dict[str, KeyedTable]], KeyedTable], touches: dict[str, str], output_key: str, full_every: int = 16):
        self.spark, self.folder, self.define, self.touches, self.output_key, self.full_every = spark, folder, define, touches, output_key, full_every
        self.stored = {n: _Stored(spark, f"{folder}/root-{n}", t) for n, t in roots.items()}
        output = define(roots)
        self.stored["output"] = _Stored(spark, f"{folder}/output", output)
        self.observers: list[tuple[Callable, Callable]] = []
        self.failures: list[tuple[int, Exception]] = []
        records = self._records()
        if not records:
            for name, table in roots.items():
                self.stored[name].copy(table, -1)
            self.stored["output"].copy(define({n: self.stored[n].table() for n in roots}), -1)
            records = [self._record(-1, -1, [], 0.0, {})]
        self.version, self.base = records[-1].batch_id, records[-1].base
        for name, s in self.stored.items():
            s.base, s.batches = self.base, [r.batch_id for r in records if r.batch_id > self.base and name in r.touched]

    def _records(self) -> list:
        try:
            found = self.spark.read.schema(_RECORD).option("recursiveFileLookup", True).parquet(f"{self.folder}/batches")
        except AnalysisException:
            return []
        return sorted(found.collect(), key=lambda r: r.batch_id)  # a row for each batch

    def _record(self, batch: int, base: int, touched: list[str], seconds: float, changed: dict[str, int]):
        row = self.spark.createDataFrame([(batch, base, touched, seconds, changed)], _RECORD)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batches/b{batch}")
        return row.first()

    @property
    def roots(self) -> dict[str, KeyedTable]:
        return {n: s.table() for n, s in self.stored.items() if n != "output"}

    @property
    def output(self) -> KeyedTable:
        return self.stored["output"].table()

    # readers

    def _snapshot(self) -> DataFrame:
        table = self.output
        return table.df.select(F.lit("insert").alias("op"), *table.key, F.lit(None).cast("int").alias("old"), F.struct(*table.values).alias("new"))

    def subscribe(self, f: Callable[[int, DataFrame], None]) -> Callable[[], None]:
        """f gets the output as inserts at once and each batch's changes afterwards; the result ends that.

        An f that raises later doesn't stop the batch or the other readers: see ``failures``.
        """
        return self._reader(f, lambda made: made)

    def subscribe_result(self, f: Callable[[int, DataFrame], str | None]) -> Callable[[], None]:
        """Like subscribe, for an f that gives the text of an error, or None."""

        def call(batch: int, made: DataFrame) -> None:
            if error := f(batch, made):
                raise RuntimeError(error)

        return self._reader(call, lambda made: made)

    def subscribe_grouped(self, parent: str, f: Callable[[int, DataFrame], None]) -> Callable[[], None]:
        """f gets changes as (parent, op, key…): a row that moves leaves one parent and comes to another."""
        return self._reader(f, lambda made: changes.grouped_changes(made, parent, self.stored["output"].key))

    def subscribe_parent(self, parent: str, value, f: Callable[[int, DataFrame], None]) -> Callable[[], None]:
        """f gets the changes (op, key…) of the rows under one parent."""
        return self._reader(f, lambda made: changes.grouped_changes(made, parent, self.stored["output"].key).filter(F.col("parent") == F.lit(value)).drop("parent"))

    def _reader(self, f: Callable, shape: Callable[[DataFrame], DataFrame]) -> Callable[[], None]:
        now = self._snapshot()
        f(self.version, shape(now.withColumn("old", F.lit(None).cast(now.schema["new"].dataType))))
        reader = (f, shape)
        self.observers.append(reader)
        return lambda: self.observers.remove(reader)

    # changes

    def apply(self, batch_id: int, logs: dict[str, DataFrame]) -> DataFrame:
        """Changes the roots by their logs (ord, op, key, new) and gives the changes of the output."""
        if batch_id <= self.version:
            raise ValueError(f"batch {batch_id} was applied before")
        began, touched, roots, changed = time.time(), None, self.roots, {}
        for name, log in logs.items():
            root, s = roots[name], self.stored[name]
            made = s.put(changes.effective(root, log), batch_id)
            changed[name] = made.count()
            column = self.touches[name]
            if column in root.key:
                keys = made.select(F.col(column).alias(self.output_key))
            else:  # a row that moves touches where it was and where it goes
                keys = made.select(F.explode(F.array(f"old.{column}", f"new.{column}")).alias(self.output_key))
            touched = keys if touched is None else touched.unionByName(keys)
            roots[name] = s.table([*s.batches, batch_id])
        out = self.stored["output"]
        old = out.table()
        if touched is None:
            made = changes.diff(old, old).limit(0)
        else:
            touched = touched.filter(F.col(self.output_key).isNotNull()).distinct()
            near = {n: KeyedTable(t.df.join(touched.withColumnRenamed(self.output_key, "__k"), F.col(self.touches[n]) == F.col("__k"), "left_semi"), t.key) for n, t in roots.items()}
            made = changes.diff(KeyedTable(old.df.join(touched, self.output_key, "left_semi"), old.key), self.define(near))
        made = out.put(made, batch_id)
        changed["output"] = made.count()
        base = batch_id if sum(b > self.base for b in [batch_id, *out.batches]) >= self.full_every else self.base
        if base == batch_id:
            for name, s in self.stored.items():
                s.copy(s.table([*s.batches, batch_id] if name in changed else None), batch_id)
        self._record(batch_id, base, list(changed), time.time() - began, changed)
        self._done(batch_id, base, list(changed))
        for f, shape in list(self.observers):
            try:
                f(batch_id, shape(made.drop("ord")))
            except Exception as e:  # one reader's failure is its own
                self.failures.append((batch_id, e))
        return made.drop("ord")

    def _done(self, batch: int, base: int, names: list[str]) -> None:
        for name, s in self.stored.items():
            if name in names:
                s.batches.append(batch)
            if base != self.base:  # what the copy before last replaced goes; what this one replaces may still be read
                for path in s.superseded:
                    delete(self.spark, path)
                s.superseded = [f"{s.folder}/full/v{s.base}", *(f"{s.folder}/changes/v{b}" for b in s.batches)]
                s.base, s.batches = base, []
        self.version, self.base = batch, base

    def follow(self, streams: dict[str, DataFrame] | DataFrame, checkpoint: str):
        """Applies a stream of changes; gives the running query.

        streams: one root's changes (ord, op, key…, new) under its name; or for several roots one stream with their changes
        in order, as (root, ord, op, entry), entry being the row's key and values as JSON.
        """
        if isinstance(streams, DataFrame):
            stream, split = streams, self._by_root
        else:
            if len(streams) != 1:
                raise ValueError("give several roots' changes as one stream with a column root")
            ((name, stream),) = streams.items()
            split = lambda batch: {name: batch}

        def put(batch: DataFrame, batch_id: int) -> None:
            if batch_id > self.version:
                self.apply(batch_id, split(batch))

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _by_root(self, batch: DataFrame) -> dict[str, DataFrame]:
        logs = {}
        for name, s in self.stored.items():
            if name == "output":
                continue
            values = [c for c in s.schema.names if c not in s.key]
            row = batch.filter(F.col("root") == name).withColumn("__row", F.from_json("entry", s.schema))
            new = F.when(F.col("op") != "remove", F.struct(*[F.col(f"__row.`{c}`").alias(c) for c in values]))
            logs[name] = row.select("ord", "op", *[F.col(f"__row.`{k}`").alias(k) for k in s.key], new.alias("new"))
        return logs

    def report(self) -> DataFrame:
        """For each batch its seconds, and how many changes of each table had an effect."""
        return self.spark.createDataFrame([r for r in self._records() if r.batch_id >= 0], _RECORD).select("batch_id", "seconds", "changed")


class BoundedOutput:
    """A pull consumer of a stream's rows: a queue of bounded size, which makes the stream wait or drops what doesn't fit.

    Readers wait for rows until the stream has ended (``close``, which ``follow`` calls then) and all are read.
    """

    def __init__(self, size: int, dropping: bool = False):
        self.queue: queue.Queue = queue.Queue(size)
        self.dropping, self.dropped, self.closed = dropping, 0, False

    def put_batch(self, batch: DataFrame, batch_id: int = 0) -> None:
        for row in batch.toLocalIterator():
            try:
                self.queue.put(row, block=not self.dropping)
            except queue.Full:
                self.dropped += 1

    def follow(self, stream: DataFrame, checkpoint: str):
        import threading

        query = stream.writeStream.foreachBatch(self.put_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

        def wait() -> None:
            try:
                query.awaitTermination()
            except Exception:  # noqa: S110  the query's own exception() tells
                pass
            finally:
                self.close()

        threading.Thread(target=wait, daemon=True).start()
        return query

    def close(self) -> None:
        """No more rows will come."""
        self.closed = True

    def recv(self, timeout: float | None = None):
        return self.queue.get(timeout=timeout)

    def try_recv(self):
        try:
            return self.queue.get_nowait()
        except queue.Empty:
            return None

    def _next(self):
        """The next row; None at the end."""
        while True:
            ended = self.closed
            try:
                return self.queue.get(timeout=0.05)
            except queue.Empty:
                if ended:
                    return None

    def __iter__(self) -> Iterator:
        while (row := self._next()) is not None:
            yield row

    async def stream(self):
        """The rows as they come, for async readers, until the stream ends."""
        while (row := await asyncio.to_thread(self._next)) is not None:
            yield row


class Subscription:
    """Stops a streaming query when it is left or closed."""

    def __init__(self, *queries):
        self.queries = list(queries)

    def close(self) -> None:
        while self.queries:
            self.queries.pop().stop()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def restarting(start: Callable[[], object], times: int, again: Callable[[Exception], bool] = lambda e: True):
    """Runs a streaming query to its end; one that fails is started again, so many times in all."""
    for attempt in range(1, times + 1):
        try:
            q = start()
            q.awaitTermination()
            return q
        except Exception as e:
            if attempt == times or not again(e):
                raise


def profiled(parts: dict[str, DataFrame]) -> list[dict]:
    """Runs each part once and tells its rows and seconds, the slowest first: the report of a pass."""
    from pyspark.sql import Observation

    out = []
    for name, df in parts.items():
        seen, began = Observation(f"pass-{name}-{id(df)}"), time.time()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        out.append({"name": name, "rows": seen.get["rows"], "seconds": time.time() - began})
    return sorted(out, key=lambda r: -r["seconds"])
