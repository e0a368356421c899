"""Keyed state with timers: rows of a key in the order of their event time, and freshness that needs no event to end."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSE = dt.datetime(2200, 1, 1)  # no event is as late


NEAR = 4096  # rows of a key that wait together; those of a key with more wait slot by slot


class InOrder(StatefulProcessor):
    """Runs ``step`` over the rows of each key in the order of (ts, id), however they are dealt to micro-batches.

    Arriving rows wait in the state store. When the watermark has passed the end of a slot of ``slot_ms`` event time nothing can come for it
    any more; its rows are sorted, stepped through and removed. A key has one timer, at the end of its earliest slot, which does all slots that the
    watermark has passed. Up to ``NEAR`` rows of a key wait in one value; the rows of a key with more are put into slots of their own, each read
    when it is due. So Python holds one Arrow batch of arriving rows, ``NEAR`` rows of one key or one slot of one key, never all rows of a key.

    ``step(state, ts_us, value)`` gives the new state and an output tuple or None. A key that has had no row for ``ttl_ms`` starts anew, and
    its state is freed.
    """

    def __init__(self, step: Callable, start: tuple, state_type: str, id_type: str, out_names: list[str], slot_ms: int, ttl_ms: int):
        self.step, self.start, self.state_type, self.id_type, self.out_names, self.slot_ms, self.ttl_ms = step, start, state_type, id_type, out_names, slot_ms, ttl_ms
        self.near = NEAR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = f"array<long>, id{{0}} array<{self.id_type}>, value{{0}} array<boolean>"
        self.held = handle.getMapState("held", "slot long", "ts " + rows.format(""))
        # The state of the steps, the last row, the two timers, whether the rows wait in ``held``, and else the rows.
        self.state = handle.getValueState("state", f"{self.state_type}, seen_ long, free_ long, timer_ long, apart_ boolean, ts_ " + rows.format("_"))

    def _get(self) -> tuple[tuple, list, list]:
        """(state of the steps, [seen, free, timer, apart], rows)"""
        got = self.state.get() or (*self.start, None, None, None, False, [], [], [])
        return tuple(got[:-7]), list(got[-7:-3]), [list(c) for c in got[-3:]]

    def _end(self, us: int) -> int:
        return (us // (1000 * self.slot_ms) + 1) * self.slot_ms

    def _put(self, rows: list) -> None:
        """Rows into their slots."""
        slots = {}
        for r in zip(*rows):
            slots.setdefault(r[0] // (1000 * self.slot_ms), []).append(r)
        for slot, new in slots.items():
            old = self.held.getValue((slot,)) or ([], [], [])
            self.held.updateValue((slot,), tuple([*o, *n] for o, n in zip(old, zip(*new))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, (seen, free, timer, apart), waiting = self._get()
        first = None
        for f in rows:
            new = f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), f["id"].tolist(), f["value"].tolist()
            if not new[0]:
                continue
            first = min(new[0]) if first is None else min(first, *new[0])
            waiting = [w + n for w, n in zip(waiting, new)]
            if apart or len(waiting[0]) > self.near:
                self._put(waiting)
                apart, waiting = True, [[], [], []]
        if first is not None:
            # A timer that has become too late still fires and finds what is due then.
            if timer is None or self._end(first) < timer:
                timer = self._end(first)
                self.handle.registerTimer(timer)
            self.state.update((*state, seen, free, timer, apart, *waiting))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state, (seen, free, timer, apart), waiting = self._get()
        if apart:
            ends = sorted((slot + 1) * self.slot_ms for slot, in self.held.keys())
        else:
            every = sorted(zip(*waiting), key=lambda r: r[:2])
            ends = sorted({self._end(r[0]) for r in every})
            due = [r for r in every if self._end(r[0]) <= upto]
            waiting = [list(c) for c in zip(*every[len(due):])] or [[], [], []]
        done = [end for end in ends if end <= upto]
        for end in done if apart else done[:1]:
            if apart:
                slot = (end // self.slot_ms - 1,)
                due = sorted(zip(*self.held.getValue(slot)), key=lambda r: r[:2])
                self.held.removeKey(slot)
            out = []
            for ts, i, value in due:
                if seen is not None and ts - seen > 1000 * self.ttl_ms:
                    state = self.start
                seen = ts
                state, got = self.step(state, ts, value)
                if got is not None:
                    out.append((key[0], i, pd.Timestamp(ts, unit="us"), *got))
            if out:
                yield pd.DataFrame(out, columns=self.out_names)
        left = ends[len(done):]
        if timer is not None and timer <= upto:
            timer = left[0] if left else None
            if timer is not None:
                self.handle.registerTimer(timer)
        # One timer for each key frees the state; it is put off while rows come.
        old = seen is None or self._end(seen + 1000 * self.ttl_ms) <= upto
        if old and not left:
            self.state.clear()
            return
        if not old and (free is None or free <= upto):
            free = self._end(seen + 1000 * self.ttl_ms)
            self.handle.registerTimer(free)
        self.state.update((*state, seen, free, timer, apart and bool(left), *waiting))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, value: str | None, step: Callable, start: tuple, state_type: str, out: str, late: str, slot_minutes: int, ttl_days: float, close: DataFrame | None = None) -> DataFrame:
    """``step`` over the rows (key, id, ts, value) of every key: key, id, ts and the columns of ``out``.

    The bound on rows held at once is the number of rows that one key has within ``slot_minutes``. Rows come out when the watermark has passed
    their slot. ``close`` is a stream of (ts): the time ``CLOSE`` ends the stream and lets out what still waits.
    """
    kind = dict(rows.dtypes)
    flag = F.lit(None).cast("boolean") if value is None else F.col(value)
    r = rows.select(F.col(key).alias("key_"), "id", "ts", flag.alias("value"))
    if close is not None:
        r = r.union(close.select(F.lit(None).cast(kind[key]), F.lit(None).cast(kind["id"]), "ts", F.lit(None).cast("boolean")))
    schema = f"key_ {kind[key]}, id {kind['id']}, ts timestamp, {out}"
    names = ["key_", "id", "ts", *(c.split()[0] for c in out.split(", "))]
    work = InOrder(step, start, state_type, kind["id"], names, slot_minutes * 60_000, int(ttl_days * 86_400_000))
    # The closing time moves the watermark and goes no further. A filter on the event time stays behind the watermark.
    r = r.withWatermark("ts", late).filter(F.col("ts") < F.lit(CLOSE - dt.timedelta(days=1)))
    got = r.groupBy("key_").transformWithStateInPandas(work, schema, "Append", "EventTime")
    return got.withColumnRenamed("key_", key)


class Freshness(StatefulProcessor):
    """Newest event of each stream; a processing-time timer turns it STALE when no event has come in time."""

    def __init__(self, replay_ms: int | None):
        self.replay_ms = replay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # newest event, allowed age, the timer that is set; all in ms.
        self.state = handle.getValueState("newest", "newest long, allowed long, timer long")

    def _row(self, key, newest: int | None, allowed: int, now: int) -> pd.DataFrame:
        state = "NO_DATA" if newest is None else "FRESH" if now - newest <= allowed else "STALE"
        return pd.DataFrame({"stream": [key[0]], "newest": [None if newest is None else pd.Timestamp(newest, unit="ms")], "state": [state], "max_age_ms": [allowed], "at": [pd.Timestamp(now, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.replay_ms if self.replay_ms is not None else timerValues.getCurrentProcessingTimeInMs()
        newest, allowed, timer = self.state.get() if self.state.exists() else (None, None, None)
        for f in rows:
            allowed = int(f["max_age_ms"].iloc[0])
            if f["ts"].notna().any():
                top = int(f["ts"].max().value // 1_000_000)
                newest = top if newest is None else max(newest, top)
        if self.replay_ms is None and newest is not None:
            due = newest + allowed + 1
            if timer is not None and timer != due:
                self.handle.deleteTimer(timer)
            timer = due if due > now else None
            if timer is not None:
                self.handle.registerTimer(timer)
        self.state.update((newest, allowed, timer))
        yield self._row(key, newest, allowed, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, allowed, _ = self.state.get()
        self.state.update((newest, allowed, None))
        yield self._row(key, newest, allowed, max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass
