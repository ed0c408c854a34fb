"""Ordered event sequences, one for each value of the partition columns.

``seed``: the first event of a sequence is what a subscriber would see at once. Operators that count it treat it like any
other event; those that suppress it leave it out (each method says which). A sequence from a source that has no current
value has no such event (``seed=False``): then nothing is left out. The end of the data is the sequence's end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyflow.functions import results
from keyflow.operators.fold import pick_sequence


def _micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def _interval(d: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(d.total_seconds()).cast("decimal(18,6)"))


class EventSeq:
    def __init__(self, df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str = "value", ts: str = "ts", coalesce: bool = True, seed: bool = True, name: str = ""):
        self.df, self.partition, self.order, self.value, self.ts = df, list(partition), list(order), value, ts
        self.coalesces, self.seed, self.name = coalesce, int(seed), name

    # helpers

    @property
    def w(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    @property
    def upto(self):
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _with(self, df: DataFrame, **kw) -> EventSeq:
        return EventSeq(df, self.partition, kw.get("order", self.order), kw.get("value", self.value), self.ts, self.coalesces, kw.get("seed", self.seed), self.name)

    def _keep(self, condition: Column) -> EventSeq:
        return self._with(self.df.withColumn("__keep", condition).filter("__keep").drop("__keep"))

    def _place(self) -> Column:
        return F.row_number().over(self.w)

    @property
    def _v(self) -> Column:
        return F.col(self.value)

    # events one by one

    def map(self, value: Column) -> EventSeq:
        return self._with(self.df.withColumn(self.value, value))

    def filter(self, condition: Column) -> EventSeq:
        return self._with(self.df.filter(condition))

    def tap(self, observation, *metrics: Column) -> EventSeq:
        """The same events; observation gets the metrics once an action has run."""
        return self._with(self.df.observe(observation, *metrics))

    def try_map(self, ok: Column, failed: Column, error: Column, name: str = "result") -> EventSeq:
        """A struct of ok and err for each event, one of them set."""
        return self._with(self.df.withColumn(name, results.result(ok, failed, error)), value=name)

    def map_ok(self, f: Callable[[Column], Column]) -> EventSeq:
        return self.map(results.map_ok(self._v, f))

    def map_err(self, f: Callable[[Column], Column]) -> EventSeq:
        return self.map(results.map_err(self._v, f))

    def catch_error(self, f: Callable[[Column], Column]) -> EventSeq:
        """The plain value, or what f makes of the error. An ok of NULL stays NULL."""
        return self.map(results.unwrap_or_else(self._v, f))

    unwrap_or_else = catch_error

    def unwrap_or(self, default) -> EventSeq:
        return self.catch_error(lambda _: F.lit(default))

    def deduped(self) -> EventSeq:
        """Without events equal to the one before."""
        return self.distinct_until_changed_by(self._v)

    def distinct_until_changed_by(self, of: Column) -> EventSeq:
        """Without events whose ``of`` equals that of the event before (an equivalence; for others see changed_by)."""
        before = F.lag(F.struct(of.alias("x"))).over(self.w)
        return self._keep(before.isNull() | ~before["x"].eqNullSafe(of))

    def changed_by(self, same: Callable[[object, object], bool]) -> DataFrame:
        """Events that aren't ``same`` (current, last one given) as the last one that was given."""

        def pick(held, columns):
            chosen = []
            for i, v in enumerate(columns[0]):
                if held is None or not same(v, held[0]):
                    held = (v,)
                    chosen.append(i)
            return held, chosen

        return pick_sequence(self.df, self.partition, self.order, [self.value], pick)

    def distinct(self) -> EventSeq:
        """The first event of each value."""
        w = Window.partitionBy(*self.partition, self.value).orderBy(*self.order)
        return self._keep(F.row_number().over(w) == 1)

    def scan(self, aggregate: Column, name: str = "scan") -> EventSeq:
        """The running value of an aggregate; the seed counts."""
        return self._with(self.df.withColumn(name, aggregate.over(self.upto)), value=name)

    def pairwise(self) -> EventSeq:
        """Each event after the first with the value before it (``previous``)."""
        df = self.df.withColumn("previous", F.lag(self._v).over(self.w)).withColumn("__n", self._place())
        return self._with(df.filter("__n > 1").drop("__n"))

    def window(self, n: int, name: str = "window") -> EventSeq:
        """The last n values at each event, fewer at first."""
        if n < 1:
            raise ValueError("n must be positive")
        return self._with(self.df.withColumn(name, F.collect_list(self._v).over(self.w.rowsBetween(1 - n, 0))), value=name)

    def state_transition(self, transitions: dict[tuple[str, str], Column], guard: Column | None = None, name: str = "transition") -> EventSeq:
        """What the declared changes of state give; others, and those that the guard rejects, give nothing, but the state goes on. The seed is the initial state."""
        df = self.df.withColumn("__from", F.lag(self._v).over(self.w)).withColumn("__n", self._place())
        out = F.lit(None)
        for (a, b), value in transitions.items():
            out = F.when((F.col("__from") == a) & (self._v == b), value).otherwise(out)
        declared = F.lit(False)
        for a, b in transitions:
            declared = declared | ((F.col("__from") == a) & (self._v == b))
        df = df.filter((F.col("__n") > 1) & declared & (guard if guard is not None else F.lit(True)))
        return self._with(df.withColumn(name, out).drop("__n").withColumnRenamed("__from", "from_state"), value=name)

    def state_hooks(self, on: dict[tuple[str, str], Column], on_exit: dict[str, Column] | None = None, on_enter: dict[str, Column] | None = None, on_any: Column | None = None, guard: Column | None = None, name: str = "fired") -> EventSeq:
        """What a declared change of state sets off, as an array: on leaving a state, the change itself, on entering one, on any."""
        moved = self.state_transition(on, guard, "__own")
        a, b = F.col("from_state"), self._v
        pick = lambda of, hooks: F.coalesce(*[F.when(of == k, v) for k, v in (hooks or {}).items()], F.lit(None).cast("string"))
        fired = F.array_compact(F.array(pick(a, on_exit), F.col("__own"), pick(b, on_enter), F.lit(None).cast("string") if on_any is None else on_any))
        return moved._with(moved.df.withColumn(name, fired).drop("__own"), value=name)

    def invalid_transitions(self, declared: Sequence[tuple[str, str]]) -> EventSeq:
        """Changes of state that aren't declared."""
        df = self.df.withColumn("from_state", F.lag(self._v).over(self.w)).withColumn("__n", self._place()).filter("__n > 1").drop("__n")
        known = F.lit(False)
        for a, b in declared:
            known = known | ((F.col("from_state") == a) & (self._v == b))
        return self._with(df.filter(~known))

    def cold(self) -> EventSeq:
        """Without the seed."""
        return self.skip(self.seed)._with_seed(False)

    def _with_seed(self, seed: bool) -> EventSeq:
        return self._with(self.df, seed=seed)

    def finalize(self, callback: Callable[[], None], action: Callable[[DataFrame], object]):
        """Runs an action on the events, and then the callback once, whether it ended well or not."""
        try:
            return action(self.df)
        finally:
            callback()

    def with_name(self, name: str) -> EventSeq:
        """A name for the sequence's jobs and plans."""
        out = self._with(self.df.alias(name))
        out.name = name
        return out

    def describe(self) -> dict:
        """What this sequence depends on."""
        return {"name": self.name, "files": list(self.df.inputFiles()), "plan": self.df._jdf.queryExecution().optimizedPlan().toString()}

    def parallel(self) -> EventSeq:
        return self

    def share(self) -> EventSeq:
        return self._with(self.df.persist())

    # parts

    def take(self, n: int) -> EventSeq:
        return self._keep(self._place() <= n)

    def first(self) -> EventSeq:
        return self.take(1)

    def skip(self, n: int) -> EventSeq:
        return self._keep(self._place() > n)

    def _failed(self, condition: Column) -> Column:
        return F.max(F.when(condition, 0).otherwise(1)).over(self.upto)

    def take_while(self, condition: Column) -> EventSeq:
        return self._keep(self._failed(condition) == 0)

    def skip_while(self, condition: Column) -> EventSeq:
        return self._keep(self._failed(condition) == 1)

    def take_until(self, notifier: EventSeq) -> EventSeq:
        """Events before the notifier's first event after its seed; one's own seed is left out."""
        stop = notifier.cold().df.groupBy(*self.partition).agg(F.min(F.struct(*self.order)).alias("__stop"))
        df = self.cold().df.join(stop, self.partition, "left")
        return self._with(df.filter(F.col("__stop").isNull() | (F.struct(*self.order) < F.col("__stop"))).drop("__stop"))

    def last(self) -> EventSeq:
        """The last event after the seed."""
        w = Window.partitionBy(*self.partition).orderBy(*[F.col(c).desc() for c in self.order])
        df = self.df.withColumn("__n", F.row_number().over(w)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*self.partition)))
        return self._with(df.filter(f"__n = 1 and __m > {self.seed}").drop("__n", "__m"))

    def last_or(self, default) -> DataFrame:
        """For each partition its last value after the seed, or the default."""
        n = F.count(F.lit(1))
        last = F.max_by(self._v, F.struct(*self.order))
        return self.df.groupBy(*self.partition).agg(F.when(n > self.seed, last).otherwise(F.lit(default)).alias("last"))

    def buffer_count(self, n: int, name: str = "buffer") -> DataFrame:
        """(partition, chunk, buffer): n values at a time, without the seed; the rest at the end."""
        if n < 1:
            raise ValueError("n must be positive")
        df = self.df.withColumn("__n", self._place() - self.seed).filter("__n > 0").withColumn("chunk", F.floor((F.col("__n") - 1) / n))
        return self._chunks(df, ["chunk"], name)

    def _chunks(self, df: DataFrame, by: list[str], name: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(*self.order, self._v.alias("__v"))))
        return df.groupBy(*self.partition, *by).agg(items.alias("__x")).select(*self.partition, *by, F.transform("__x", lambda x: x["__v"]).alias(name))

    def buffer_time(self, every: timedelta, name: str = "buffer") -> DataFrame:
        """(partition, tick, buffer): the values of each stretch of time between a partition's first and last, empty ones too; without the seed."""
        size = _micros(every)
        us = F.expr(f"unix_micros(cast({self.ts} as timestamp))")
        df = self.cold().df.withColumn("tick", F.floor(us / size))
        kind = self.df.select(F.array(self._v).alias("x")).schema["x"].dataType
        ticks = df.groupBy(*self.partition).agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
        ticks = ticks.select(*self.partition, F.explode(F.sequence("a", "b")).alias("tick"))
        found = self._chunks(df, ["tick"], name)
        return ticks.join(found, [*self.partition, "tick"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))

    def drop_newest(self, capacity: int) -> EventSeq:
        """The first so many events after the seed."""
        n = self._place() - self.seed
        return self._keep((n > 0) & (n <= capacity))

    def drop_oldest(self, capacity: int) -> EventSeq:
        """All events: what is newest always has room."""
        if capacity < 1:
            raise ValueError("capacity must be positive")
        return self

    def sample_latest(self) -> EventSeq:
        return self

    # time

    def debounce(self, d: timedelta, name: str = "emit_ts") -> EventSeq:
        """Events that no other follows within d, at the time when that is known; without the seed."""
        df = self.cold().df
        after = F.lead(self.ts).over(self.w)
        gap = F.expr(f"unix_micros(cast(__next as timestamp)) - unix_micros(cast({self.ts} as timestamp))")
        df = df.withColumn("__next", after).filter(F.col("__next").isNull() | (gap > _micros(d))).drop("__next")
        return self._with(df.withColumn(name, F.col(self.ts) + _interval(d)))

    def delay(self, d: timedelta) -> EventSeq:
        """Each event so much later; the seed is left out."""
        out = self.cold()
        return out._with(out.df.withColumn(self.ts, F.col(self.ts) + _interval(d)))

    def timeout(self, d: timedelta) -> EventSeq:
        """Events as long as none is later than d after the one before; then one row with signal ``error``. Others: ``value``.

        The seed starts the clock, but isn't given.
        """
        us = F.expr(f"unix_micros(cast({self.ts} as timestamp))")
        df = self.df.withColumn("__gap", us - F.lag(us).over(self.w)).withColumn("__late", F.sum(F.when(F.col("__gap") > _micros(d), 1).otherwise(0)).over(self.upto))
        df = df.withColumn("__place", F.sum(F.when(F.col("__late") > 0, 1).otherwise(0)).over(self.upto)).withColumn("__n", self._place())
        df = df.filter(f"__place <= 1 and __n > {self.seed}")
        late = F.col("__late") > 0
        df = df.withColumn("signal", F.when(late, "error").otherwise("value")).withColumn(self.value, F.when(~late, self._v))
        at = F.timestamp_micros(us - F.col("__gap") + F.lit(_micros(d))).cast(self.df.schema[self.ts].dataType)
        df = df.withColumn(self.ts, F.when(late, at).otherwise(F.col(self.ts))).drop("__gap", "__late", "__place", "__n")
        return self._with(df, seed=False)

    def throttle(self, d: timedelta) -> DataFrame:
        """An event, then none for d; the seed counts."""
        size = _micros(d)

        def pick(last, columns):
            t, chosen = columns[0], []
            i = 0 if last is None else bisect_left(t, last + size)
            while i < len(t):
                chosen.append(i)
                last = t[i]
                i = bisect_left(t, last + size, i + 1)
            return last, chosen

        return pick_sequence(self.df, self.partition, self.order, [self.ts], pick)

    def audit(self, d: timedelta) -> DataFrame:
        """An event opens a stretch of d, at whose end the latest event is given; the seed is left out, and what was given isn't given again at the end."""
        size = _micros(d)
        df = self.cold().df
        df = df.withColumn("__after", F.lead(self.ts).over(self.w))

        def pick(opened, columns):
            t, after = columns
            chosen = []
            i = 0
            while i < len(t):
                if opened is None or t[i] >= opened + size:
                    opened = t[i]
                last = bisect_left(t, opened + size, i) - 1  # of those of the stretch that are here
                if after[last] is None or after[last] >= opened + size:
                    chosen.append(last)
                i = last + 1
            return opened, chosen

        return pick_sequence(df, self.partition, self.order, [self.ts, "__after"], pick).drop("__after")

    # several sequences

    def _beside(self, others: Sequence[EventSeq], names: Sequence[str]) -> DataFrame:
        """All events of these sequences in order, each value in a column of its own; ``src``: which sequence."""
        parts = []
        for i, s in enumerate([self, *others]):
            columns = [(s._v if i == j else F.lit(None)).cast(self.df.schema[self.value].dataType).alias(n) for j, n in enumerate(names)]
            parts.append(s.df.select(*self.partition, *self.order, F.lit(i).alias("src"), *columns))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def _latest(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*self.partition).orderBy(*self.order, "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = df.withColumns({n: F.last(F.when(F.col("src") == i, F.struct(n)), ignorenulls=True).over(w) for i, n in enumerate(names)})
        return held

    def join(self, *others: EventSeq, names: Sequence[str] = ("left", "right")) -> DataFrame:
        """Combine-latest: at each event of any of them the latest of all, once all have one."""
        df = self._latest(self._beside(others, names), names)
        for n in names:
            df = df.filter(F.col(n).isNotNull())
        return df.withColumns({n: F.col(n)[n] for n in names})

    def join_vec(self, *others: EventSeq, name: str = "values") -> DataFrame:
        names = [f"v{i}" for i in range(len(others) + 1)]
        return self.join(*others, names=names).withColumn(name, F.array(*names)).drop(*names)

    def with_latest_from(self, other: EventSeq, names: Sequence[str] = ("left", "right")) -> DataFrame:
        """One's own events with the other's latest value."""
        return self.join(other, names=names).filter("src = 0")

    def sample(self, notifier: EventSeq, names: Sequence[str] = ("left", "right")) -> DataFrame:
        """At each event of the notifier one's own latest value, if there is one."""
        df = self._latest(self._beside([notifier], names), names[:1])
        return df.filter((F.col("src") == 1) & F.col(names[0]).isNotNull()).withColumn(names[0], F.col(names[0])[names[0]]).drop(names[1])

    sample_on = sample

    def merge(self, right: EventSeq) -> DataFrame:
        """Both sequences' events; one's own seed is left out."""
        columns = [*self.partition, *self.order, self.value]
        return self.cold().df.select(*columns, F.lit(0).alias("src")).unionByName(right.df.select(*columns, F.lit(1).alias("src")))

    def concat(self, second: EventSeq) -> DataFrame:
        """One's own events, then those of the second after one's last; partitions without events of one's own have all of the second but its seed."""
        end = self.df.groupBy(*self.partition).agg(F.max(F.struct(*self.order)).alias("__end"))
        later = second.cold().df.join(end, self.partition, "left").filter(F.col("__end").isNull() | (F.struct(*self.order) > F.col("__end")))
        columns = [*self.partition, *self.order, self.value]
        return self.df.select(*columns, F.lit(0).alias("src")).unionByName(later.select(*columns, F.lit(1).alias("src")))

    def zip(self, other: EventSeq, names: Sequence[str] = ("left", "right")) -> DataFrame:
        """The i-th events after the seeds side by side."""
        a = self.df.select(*self.partition, (self._place() - self.seed).alias("place"), self._v.alias(names[0])).filter("place > 0")
        b = other.df.select(*self.partition, (other._place() - other.seed).alias("place"), other._v.alias(names[1])).filter("place > 0")
        return a.join(b, [*self.partition, "place"])

    def switch_map(self, inner: EventSeq, names: Sequence[str] = ("outer", "inner"), by: str | None = None) -> DataFrame:
        """The inner events under the newest outer event; at an outer event the current value of its inner sequence.

        by: the column of inner that says for which outer value an event is, so that each outer value has an inner sequence
        of its own; without it all share one.
        """
        if by is None:
            return self.join(inner, names=names)
        replay, opened = self._opened(inner, by, names[0])
        kind = self.df.schema[self.value].dataType
        outer = self.df.select(*self.partition, *self.order, F.lit(0).alias("src"), self._v.alias(names[0]), F.lit(None).alias("__e"))
        mine = inner.df.select(*self.partition, *self.order, F.lit(1).alias("src"), F.lit(None).cast(kind).alias(names[0]), F.struct(F.col(by).alias("by"), inner._v.alias("v")).alias("__e"))
        w = Window.partitionBy(*self.partition).orderBy(*self.order, "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        now = outer.unionByName(mine).withColumn("__now", F.last(F.when(F.col("src") == 0, F.struct(names[0])), ignorenulls=True).over(w))
        under = now.filter((F.col("src") == 1) & F.col("__now").isNotNull() & F.col("__e.by").eqNullSafe(F.col("__now")[names[0]]))
        under = under.select(*self.partition, *self.order, "src", F.col("__now")[names[0]].alias(names[0]), F.col("__e.v").alias(names[1]))
        first = replay.select(*self.partition, *[F.col(f"outer_{c}").alias(c) for c in self.order], F.lit(0).alias("src"), F.col(names[0]), F.col("__inner")[inner.value].alias(names[1]))
        return first.unionByName(under)

    def _opened(self, inner: EventSeq, by: str | None, name: str) -> tuple[DataFrame, DataFrame]:
        """Each outer event with the latest event of its inner sequence before it, as struct ``__inner``, where there is one; and all outer events."""
        outer = self.df.select(*self.partition, *[F.col(c).alias(f"outer_{c}") for c in self.order], self._v.alias(name))
        columns = [c for c in inner.df.columns if c not in self.partition]
        key = [] if by is None else ["__by"]
        a = self.df.select(*self.partition, *self.order, F.lit(0).alias("__src"), *([self._v.alias("__by")] if by else []), self._v.alias(name), F.lit(None).cast(inner.df.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("__inner"))
        b = inner.df.select(*self.partition, *self.order, F.lit(1).alias("__src"), *([F.col(by).alias("__by")] if by else []), F.lit(None).cast(self.df.schema[self.value].dataType).alias(name), F.struct(*columns).alias("__inner"))
        w = Window.partitionBy(*self.partition, *key).orderBy(*self.order, "__src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = a.unionByName(b).withColumn("__inner", F.last("__inner", ignorenulls=True).over(w)).filter("__src = 0 and __inner is not null")
        return held.select(*self.partition, *[F.col(c).alias(f"outer_{c}") for c in self.order], name, "__inner"), outer

    def merge_map(self, inner: EventSeq, name: str = "outer", by: str | None = None) -> DataFrame:
        """Each inner event once for each outer event up to then: all inner sequences stay open.

        An outer event opens its inner sequence, which gives its current value at once: that row has the outer event's
        order columns, and what else the inner event has. by: as in switch_map.
        """
        replay, outer = self._opened(inner, by, name)
        joined = inner.df.join(outer, self.partition)
        later = F.struct(*self.order) >= F.struct(*[F.col(f"outer_{c}") for c in self.order])
        joined = joined.filter(later if by is None else later & F.col(by).eqNullSafe(F.col(name)))
        columns = [F.col(f"outer_{c}").alias(c) if c in self.order else F.col(c) if c in self.partition else F.col("__inner")[c].alias(c) for c in inner.df.columns]
        return joined.unionByName(replay.select(*columns, *[f"outer_{c}" for c in self.order], name))

    def retry(self, n: int, failed: str, again: Callable[[object], bool] = lambda value: True) -> DataFrame:
        """Events of attempts, cut by failures: after n failures in a row, or one that ``again`` declines, the sequence ends with signal ``error``.

        failed: a boolean column. A value sets the count back. The seed is left out. ``signal``: value or error.
        """

        def pick(tries, columns):
            chosen, signals = [], []
            tries = tries or 0
            for i, (bad, v) in enumerate(zip(*columns, strict=True)):
                if tries < 0:  # over
                    break
                tries = tries + 1 if bad else 0
                if bad and tries < n and again(v):
                    continue
                chosen.append(i)
                signals.append("error" if bad else "value")
                if bad:
                    tries = -1
            return tries, chosen, signals

        return pick_sequence(self.cold().df, self.partition, self.order, [failed, self.value], pick, "signal")

    # batches

    def batch(self, tick: Column, key: Sequence[str], signal: str | None = None) -> DataFrame:
        """The last value of each key in each tick; all of them where the sequence keeps every event.

        signal: a column that is ``value`` (or null) for values; other rows end something (``error``, ``complete``), and
        each of those is given whatever else its tick holds.
        """
        df = self.df.withColumn("tick", tick)
        if not self.coalesces:
            return df
        last = F.max_by(self._v, F.struct(*self.order)).alias(self.value)
        if signal is None:
            return df.groupBy("tick", *key).agg(last)
        ends = F.coalesce(F.col(signal), F.lit("value")) != "value"
        own = F.when(ends, F.struct(*self.order)).alias("__own")  # a group of its own for each that ends something
        out = df.groupBy("tick", *key, own).agg(last, F.coalesce(F.max(signal), F.lit("value")).alias(signal))
        return out.drop("__own")

    def no_coalesce(self) -> EventSeq:
        return EventSeq(self.df, self.partition, self.order, self.value, self.ts, False, self.seed, self.name)

    def bounded(self, tick: str, capacity: int, policy: str = "block") -> EventSeq:
        """What a buffer of that capacity lets through in each tick: block all, drop_oldest the last, drop_newest the first; error fails an action."""
        if capacity < 1:
            raise ValueError("capacity must be positive")
        part = Window.partitionBy(*self.partition, tick)
        if policy == "block":
            return self
        if policy == "error":
            return self._keep(F.when(F.count(F.lit(1)).over(part) > capacity, F.raise_error(F.lit("the buffer is full")).cast("boolean")).otherwise(F.lit(True)))
        order = [F.col(c).desc() if policy == "drop_oldest" else F.col(c) for c in self.order]
        if policy not in ("drop_oldest", "drop_newest"):
            raise ValueError(f"no policy {policy}")
        return self._keep(F.row_number().over(part.orderBy(*order)) <= capacity)
