"""Attribution of clicks to exposures as a stream: an interval by item, each exposure taken once.

Exposures and clicks come in one stream. A click takes the exposures of its item in the
interval around it that no earlier click took: those of the same context, else those of
the same digest and query, else those of the same query. A click that finds none becomes
a new positive of its own. A click is settled when the watermark has passed its interval,
in order of time, so the result follows from the events' times and not from their
arrival. State by item holds what the interval and the watermark allow, no more, in parts
by time: new events are added as parts, and a task holds those of an interval only.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trovesift.operators.learning import TIERS

#: Exposures and clicks: `side` is `exposure` or `click`; at is its time.
EVENTS = "side string, event_id long, item_id long, at timestamp, context string, digest string, query string"
POSITIVES = "item_id long, click_id long, exposure_id long, tier int, confidence double, at timestamp"


#: Milliseconds of a part of the state at least, and events of a batch that are held before they are put into it.
WIDTH_MS, HELD = 600_000, 1 << 16


def tier_of(click: list, exposure: list) -> int | None:
    """What ties them: 0 context, 1 digest and query, 2 query; empty values tie nothing."""
    (_, _, context, digest, query), (_, _, context_, digest_, query_) = click, exposure
    if context and context == context_:
        return 0
    if not query or query != query_:
        return None
    return 1 if digest and digest == digest_ else 2


def own_confidence(click: list) -> float:
    """Of a positive that no exposure backs: by what the click itself carries."""
    return TIERS[0] if click[2] else TIERS[1] if click[3] else TIERS[2]


class ItemState:
    """One item: exposures that no click took yet, and clicks not settled; each is [ms, id, context, digest, query]."""

    def __init__(self, before: int, after: int, saved: str | None = None) -> None:
        self.before, self.after = before, after
        self.exposures, self.clicks = json.loads(saved) if saved else ([], [])

    def saved(self) -> str:
        return json.dumps([self.exposures, self.clicks])

    def add(self, side: str, event: list) -> None:
        (self.clicks if side == "click" else self.exposures).append(event)

    def next_due(self) -> int | None:
        """When the first click can be settled, or else the last exposure be forgotten."""
        if self.clicks:
            return min(c[0] for c in self.clicks) + self.after + 1
        return max(e[0] for e in self.exposures) + self.before + 1 if self.exposures else None

    def advance(self, now: int) -> list[tuple]:
        """(click, exposure or None, tier, confidence, ms) of clicks settled, given that all events before `now` are there.

        Clicks come in order of time, so what a list of exposures with the same ties has is
        taken or too old once a click has looked at it: each is seen once a list.
        """
        out = []
        self.clicks.sort()
        self.exposures.sort()
        exposures, taken, read = self.exposures, bytearray(len(self.exposures)), 0
        lists: tuple[defaultdict, ...] = defaultdict(list), defaultdict(list), defaultdict(list)
        due = 0
        while due < len(self.clicks) and self.clicks[due][0] + self.after < now:
            ms, number, context, digest, query = click = self.clicks[due]
            due += 1
            while read < len(exposures) and exposures[read][0] <= ms + self.after:
                _, _, context_, digest_, query_ = exposures[read]
                if context_:
                    lists[0][context_].append(read)
                if query_:
                    lists[2][query_].append(read)
                    if digest_:
                        lists[1][digest_, query_].append(read)
                read += 1
            ties = (context or None, (digest, query) if digest and query else None, query or None)
            for tier, tie in enumerate(ties):
                free = [k for k in lists[tier].pop(tie, ()) if not taken[k] and exposures[k][0] >= ms - self.before] if tie is not None else []
                if free:
                    for k in free:
                        taken[k] = 1
                    out.extend((number, exposures[k][1], tier, TIERS[tier], ms) for k in free)
                    break
            else:
                out.append((number, None, None, own_confidence(click), ms))
        self.clicks = self.clicks[due:]
        oldest = min(now, self.clicks[0][0] if self.clicks else now) - self.before
        self.exposures = [e for e, gone in zip(exposures, taken, strict=True) if not gone and e[0] >= oldest]  # no click to come can reach others
        return out


class Attribution(StatefulProcessor):
    """State of an item: `parts`, events by time, and `marks`, no later than the first click that waits, the last exposure, and the number of the next part."""

    def __init__(self, before: int, after: int) -> None:
        self.before, self.after, self.width = before, after, max(WIDTH_MS, before + after + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "click long, exposure long, part long")
        self.parts = handle.getMapState("parts", "slot long, part long", "saved string")

    def _marked(self) -> list:
        return list(self.marks.get()) if self.marks.exists() else [None, None, 0]

    def _due(self, marks: list) -> int | None:
        """As `ItemState.next_due`."""
        click, exposure, _ = marks
        return click + self.after + 1 if click is not None else exposure + self.before + 1 if exposure is not None else None

    def _put(self, marks: list, events: Iterable[tuple[str, list]]) -> None:
        slots: defaultdict[int, ItemState] = defaultdict(lambda: ItemState(self.before, self.after))
        for side, event in events:
            slots[event[0] // self.width].add(side, event)
        for slot, state in slots.items():
            self.parts.updateValue((slot, marks[2]), (state.saved(),))
            if state.clicks:
                first = min(c[0] for c in state.clicks)
                marks[0] = first if marks[0] is None else min(marks[0], first)
            if state.exposures:
                last = max(e[0] for e in state.exposures)
                marks[1] = last if marks[1] is None else max(marks[1], last)
        marks[2] += 1

    def _wait(self, marks: list, watermark: int) -> None:
        due = self._due(marks)
        if due is None:
            self.marks.clear()
        else:
            self.marks.update(tuple(marks))
            self.handle.registerTimer(max(due, watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        marks, held = self._marked(), []
        for r in rows:
            side, number, context, digest, query, ms = r.side, r.event_id, r.context, r.digest, r.query, r.ms
            held.append((side, [ms, number, context, digest, query]))
            if len(held) >= HELD:
                self._put(marks, held)
                held = []
        if held:
            self._put(marks, held)
        self._wait(marks, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        marks, now = self._marked(), timerValues.getCurrentWatermarkInMs()
        due = self._due(marks)
        if due is None or due > now:  # another timer has done it
            return
        slots: defaultdict[int, list[tuple]] = defaultdict(list)
        later: list[int] = []
        for slot, part in list(self.parts.keys()):
            if slot * self.width < now:
                slots[slot].append((slot, part))
            else:
                later.append(slot)
        state, order = ItemState(self.before, self.after), sorted(slots)
        for slot, following in zip(order, [*order[1:], None], strict=True):
            for name in slots[slot]:
                exposures, clicks = json.loads(self.parts.getValue(name)[0])
                state.clicks += clicks
                state.exposures += exposures
                self.parts.removeKey(name)
            until = now if following is None else min(now, following * self.width)
            for c, e, t, p, ms in state.advance(until):
                yield Row(item_id=key[0], click_id=c, exposure_id=e, tier=t, confidence=p, ms=ms)
        left = [min(later) * self.width if later else None, None, marks[2]]  # a click of a later part is not before it
        self._put(left, [*(("click", c) for c in state.clicks), *(("exposure", e) for e in state.exposures)])
        self._wait(left, now)

    def close(self) -> None:
        pass


def attribute_stream(events: DataFrame, before_ms: int = 30_000, after_ms: int = 1_000, late: str = "1 minute") -> DataFrame:
    """POSITIVES of a stream of EVENTS: a row for each exposure that a click took, and one without exposure and tier for each click that took none.

    Needs the state store of RocksDB. Events later than `late` are dropped; events
    without an item, an id or a time are left out. An event that comes twice counts twice:
    `pipelines.dedupe` before it.
    """
    rows = events.where("item_id is not null and event_id is not null and at is not null and side in ('click', 'exposure')")
    rows = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    found = rows.groupBy("item_id").transformWithState(
        statefulProcessor=Attribution(before_ms, after_ms), outputStructType="item_id long, click_id long, exposure_id long, tier long, confidence double, ms long", outputMode="Append", timeMode="EventTime"
    )
    return found.select("item_id", "click_id", "exposure_id", F.col("tier").cast("int").alias("tier"), "confidence", F.timestamp_millis("ms").alias("at"))


def replay(events: Iterable[tuple], now: int, before_ms: int = 30_000, after_ms: int = 1_000) -> list[tuple]:
    """(item_id, click_id, exposure_id, tier, confidence, ms) of events (side, event_id, item_id, ms, context, digest, query), all at once."""
    states: dict[int, ItemState] = {}
    for side, event_id, item_id, ms, context, digest, query in events:
        states.setdefault(item_id, ItemState(before_ms, after_ms)).add(side, [ms, event_id, context, digest, query])
    return sorted(((item, *x) for item, state in states.items() for x in state.advance(now)), key=str)
