"""Sources that a program feeds: each flush is a Parquet file in a folder that a stream follows, so what was sent survives a restart."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

POLICIES = ("block", "drop_oldest", "drop_newest", "error")


class Source:
    """Values as events (seq, signal, value): signal is ``value``, and ``complete`` once at the end; there is no current value.

    Each emit is a batch of its own; within ``batched()`` all are one. What is emitted after the end is dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str, name: str = ""):
        self.spark, self.folder, self.name = spark, folder, name
        self.schema = f"seq long, signal string, value {kind}"
        self.seq, self.completed, self._held = 0, False, None

    def _put(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def _signal(self, signal: str, values: Iterable) -> None:
        rows = [(self.seq + i, signal, v) for i, v in enumerate(values)]
        self.seq += len(rows)
        if self._held is None:
            self._put(rows)
        else:
            self._held += rows

    def emit(self, *values) -> None:
        if not self.completed:
            self._signal("value", values)

    def complete(self) -> None:
        if not self.completed:
            self._signal("complete", [None])
            self.completed = True

    @contextmanager
    def batched(self):
        """What is emitted inside reaches readers as one batch."""
        outermost = self._held is None
        self._held = [] if outermost else self._held
        try:
            yield self
        finally:
            if outermost:
                rows, self._held = self._held, None
                self._put(rows)

    def events(self) -> DataFrame:
        """All that was sent so far."""
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def stream(self) -> DataFrame:
        """The same as a stream, a file to a batch."""
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


class BoundedInput:
    """A buffer of bounded size before a source. When it is full, push waits (block), makes room (drop_oldest), drops what comes (drop_newest), or ends the input (error)."""

    def __init__(self, source: Source, capacity: int, policy: str = "block"):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        if policy not in POLICIES:
            raise ValueError(f"no policy {policy}")
        self.source, self.capacity, self.policy = source, capacity, policy
        self.buffer: deque = deque()
        self.room = threading.Condition()
        self.closed = False
        self.total_pushed = self.dropped_count = self.backpressure_events = 0

    def push(self, value, timeout: float | None = None) -> bool:
        """Whether the value is in the buffer now; a full buffer's policy decides, and a closed input takes nothing."""
        with self.room:
            if self.closed:
                return False
            if len(self.buffer) >= self.capacity:
                self.backpressure_events += 1
                if self.policy == "drop_newest":
                    self.dropped_count += 1
                    return False
                if self.policy == "error":
                    self.closed = True
                    self.source._signal("error", [None])
                    self.source.completed = True
                    return False
                if self.policy == "drop_oldest":
                    self.buffer.popleft()
                    self.dropped_count += 1
                elif not self.room.wait_for(lambda: self.closed or len(self.buffer) < self.capacity, timeout) or self.closed:
                    return False
            self.buffer.append(value)
            self.total_pushed += 1
            return True

    def flush(self) -> int:
        """Sends what is in the buffer as one batch; the number of values."""
        with self.room:
            values = list(self.buffer)
            self.buffer.clear()
            self.room.notify_all()
        if values:
            self.source.emit(*values)
        return len(values)

    def push_flush(self, value, timeout: float | None = None) -> bool:
        done = self.push(value, timeout)
        self.flush()
        return done

    def close(self) -> None:
        """Sends what is left and ends the source."""
        with self.room:
            was, self.closed = self.closed, True
            self.room.notify_all()
        if not was:
            self.flush()
            self.source.complete()

    def metrics(self) -> dict[str, int]:
        return {"total_pushed": self.total_pushed, "dropped_count": self.dropped_count, "backpressure_events": self.backpressure_events}
