"""The coordinator of changes by path: debounced, merged, one dispatch in flight, by event time.

Changes and completions of dispatches come in one stream, in any order within the
watermark. A path's changes that follow one another within the quiet time are a burst; it
is dispatched when the quiet time has passed, with the kind that wins in it. While a
dispatch is in flight, later bursts are merged and wait for its completion. State is kept
by path with event-time timers, so what is dispatched, and when, follows from the events'
times alone, not from their arrival or from how they were dealt into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trovesift.operators.indexing import CHANGES

#: Changes, and completions of dispatches.
EVENTS = "path string, kind string, at timestamp"
DISPATCHES = "path string, generation int, kind string, due timestamp, changes int"
DONE = "done"
QUIET_MS = 500


class PathState:
    """One path: bursts that may still grow, completions not yet reached, and what is in flight.

    A burst is [first, last, rank of its kind, changes], in milliseconds; bursts are at
    least the quiet time apart, so there are few, however many changes came.
    """

    def __init__(self, quiet: int = QUIET_MS, saved: str | None = None) -> None:
        self.quiet = quiet
        self.bursts: list[list[int]] = []
        self.done: list[int] = []
        self.generation, self.flying, self.pending, self.last = 0, False, None, -1
        if saved:
            self.bursts, self.done, self.generation, self.flying, self.pending, self.last = json.loads(saved)

    def saved(self) -> str:
        return json.dumps([self.bursts, self.done, self.generation, self.flying, self.pending, self.last])

    def add(self, kind: str, at: int) -> None:
        if kind == DONE:
            self.done.append(at)
            return
        new = [at, at, CHANGES.index(kind) if kind in CHANGES else len(CHANGES) - 1, 1]
        apart = []
        for burst in self.bursts:
            if burst[0] - new[1] >= self.quiet or new[0] - burst[1] >= self.quiet:
                apart.append(burst)
            else:
                new = [min(new[0], burst[0]), max(new[1], burst[1]), min(new[2], burst[2]), new[3] + burst[3]]
        self.bursts = sorted([*apart, new])

    def next_due(self) -> int | None:
        """When something may happen next."""
        return min([b[1] + self.quiet for b in self.bursts[:1]] + [t + 1 for t in self.done], default=None)

    def advance(self, now: int) -> list[tuple[int, str, int, int]]:
        """(generation, kind, due, changes) of what is dispatched, given that all events before `now` are there. Of equal times a burst's end comes before a completion."""
        out = []
        self.done.sort()
        while True:
            end = self.bursts[0][1] + self.quiet if self.bursts else None
            done = self.done[0] if self.done else None
            if end is not None and end <= now and (done is None or end <= done):
                _, _, rank, n = self.bursts.pop(0)
                self.generation += 1
                self.last = rank
                if self.flying:
                    self.pending = [min(rank, self.pending[0]), n + self.pending[1]] if self.pending else [rank, n]
                else:
                    self.flying = True
                    out.append((self.generation, CHANGES[rank], end, n))
            elif done is not None and done < now and (end is None or done < end):
                self.done.pop(0)
                if self.flying and self.pending:
                    out.append((self.generation, CHANGES[self.pending[0]], done, self.pending[1]))
                    self.pending = None
                else:
                    self.flying = False
            else:
                return out

    def forgettable(self) -> bool:
        """Nothing waits, and the path is deleted."""
        return not (self.bursts or self.done or self.flying) and self.last == CHANGES.index("delete")


class Coordinator(StatefulProcessor):
    """The state of `PathState` in Spark's store; a timer for what is due next, and one that drops deleted paths."""

    def __init__(self, quiet: int, forget: int) -> None:
        self.quiet, self.forget = quiet, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", "saved string")

    def _load(self) -> PathState:
        saved = self.state.get() if self.state.exists() else None
        return PathState(self.quiet, saved[0] if saved else None)

    def _store(self, state: PathState, watermark: int) -> None:
        self.state.update((state.saved(),))
        due = state.next_due()
        if due is None and state.forgettable():
            due = watermark + self.forget
        if due is not None:
            self.handle.registerTimer(max(due, watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._load()
        for row in rows:
            state.add(row.kind, row.ms)
        self._store(state, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, now = self._load(), timerValues.getCurrentWatermarkInMs()
        found = state.advance(now)
        if not found and state.next_due() is None and state.forgettable() and expiredTimerInfo.getExpiryTimeInMs() <= now:
            self.state.clear()
        else:
            self._store(state, now)
        return iter([Row(path=key[0], generation=g, kind=kind, due_ms=due, changes=n) for g, kind, due, n in found])

    def close(self) -> None:
        pass


def _output(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("generation").cast("int").alias("generation"), "kind", F.timestamp_millis(F.col("due_ms")).alias("due"), F.col("changes").cast("int").alias("changes"))


def dispatches(events: DataFrame, late: str = "1 minute", quiet_ms: int = QUIET_MS, forget_ms: int = 86_400_000) -> DataFrame:
    """DISPATCHES of a stream of EVENTS: changes, and completions (kind `done`).

    Needs the state store of RocksDB. Events later than `late` are dropped; a deleted path
    is remembered for `forget_ms` after it came to rest, so that its generations go on.
    Null paths and times are left out.
    """
    rows = events.where("path is not null and kind is not null and at is not null").select("path", "kind", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    found = rows.groupBy("path").transformWithState(
        statefulProcessor=Coordinator(quiet_ms, forget_ms), outputStructType="path string, generation long, kind string, due_ms long, changes long", outputMode="Append", timeMode="EventTime"
    )
    return _output(found)


def replay(events: Iterable[Row | tuple], now: int, quiet_ms: int = QUIET_MS) -> list[tuple]:
    """(path, generation, kind, due in ms, changes) of events (path, kind, ms), all at once: what the stream gives once its watermark is `now`."""
    states: dict[str, PathState] = {}
    for path, kind, at in events:
        states.setdefault(path, PathState(quiet_ms)).add(kind, at)
    return sorted((path, *x) for path, state in states.items() for x in state.advance(now))
