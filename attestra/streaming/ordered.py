"""Keyed state that takes a key's rows in event order, whatever order they arrive in.

A stream's rows wait in the key's state until the watermark has passed them and are then applied from the earliest on.
What a processor does is two plain functions of a small state, so that its batch twin can be compared with it:
``apply(state, row)`` and ``idle(state, now)`` give the state after a row, or after a time, and the rows to put out.
Times are whole microseconds of the epoch inside; ``wake(state)`` is when ``idle`` is due without any further row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Rows that a task holds while it looks for the earliest ones of its keys.
HELD = 200_000
#: Parts that keys are dealt to where the keys of a part share one state; rows that are one of the state there.
PARTS, CALL = 1024, 10_000
#: Parts whose rows are made into an Arrow batch at a time.
PACKS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: datetime) -> int:
    return (ts.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def moment(at: int) -> datetime:
    return EPOCH + timedelta(microseconds=at)


class InOrder(StatefulProcessor):
    """Subclasses name the columns of a waiting row (without ``ts``; the first ones decide between equal times) and of the state."""

    ROW = "seq long"
    STATE = "n long"
    #: Rows that can still change a key at most, from the earliest on; later ones don't wait. None: all can.
    most: int | None = None

    def names(self, fields: str) -> list[str]:
        return [x.split()[0] for x in fields.split(",")]

    def apply(self, state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        raise NotImplementedError

    def idle(self, state: dict | None, now: int) -> tuple[dict | None, list[dict]]:
        return state, []

    def wake(self, state: dict | None) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = self.names(self.ROW)
        self.kept = self.names(self.STATE)
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getListState("waiting", f"at long, {self.ROW}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(micros(r.ts), *(r[f] for f in self.fields)) for r in rows]
        if self.most is None:
            self.waiting.appendList(new)
        else:  # a row with as many before it is never applied, whatever still arrives
            new = sorted([tuple(r) for r in self.waiting.get()] + new, key=self.order)[: self.most]
            self.waiting.put(new)
        self.due(new)
        return iter([])

    @staticmethod
    def order(row: tuple) -> tuple:
        return row[:3]

    def due(self, rows: list[tuple]) -> None:
        """One timer for the earliest of the rows; once it goes off, those still waiting get the next."""
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 - 1)  # a timer goes off only once the watermark is beyond it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # watermarks are whole milliseconds: all of the last one counts
        now = 1000 * timerValues.getCurrentWatermarkInMs() + 999
        rows = [tuple(r) for r in self.waiting.get()]
        due, rest = sorted((r for r in rows if r[0] <= now), key=self.order), [r for r in rows if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.due(rest)
        held = self.state.get()
        before = dict(zip(self.kept, held)) if held else None
        state, out = before, []
        for row in due:
            state, said = self.apply(state, {"at": row[0], **dict(zip(self.fields, row[1:]))})
            out += said
        state, said = self.idle(state, now)
        if state != before and state is not None:
            self.state.update(tuple(state[k] for k in self.kept))
            again = self.wake(state)
            if again is not None:
                self.handle.registerTimer(-(-again // 1000))
        for row in out + said:
            yield Row(**key.asDict() if isinstance(key, Row) else dict(zip(self.key, key)), **{k: moment(v) if k == "at" else v for k, v in row.items()})

    def close(self) -> None:
        pass


class ManyInOrder(InOrder):
    """The same for keys that are many and small: a part of all keys has one list of waiting rows, one of states and one timer.

    Each call to the state, and each row of it, takes longer than what is done with it. So rows come here packed, and both lists
    hold up to ``CALL`` of them as one JSON text. Changed states are added to their list, the last one of a key counting, and
    it is written anew once half of it is out of date. ``key`` are string columns. Spark drops a pack that is late as a whole;
    of another the rows are left out that are no later than the watermark up to which rows of their part were applied."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getListState("states", "rows string")
        self.waiting = handle.getListState("waiting", "rows string")
        self.applied = handle.getValueState("applied", "at long")

    def packed(self, rows: DataFrame) -> DataFrame:
        """part, ts (the last one), first (microseconds), n, rows: a task's rows of a part, ``HELD`` of all parts at a time. Stateless."""
        whole = F.struct(F.unix_micros("ts").alias("at"), *self.names(self.ROW), *self.key)
        rows = rows.select(F.pmod(F.xxhash64(*self.key), F.lit(PARTS)).alias("part"), "ts", F.unix_micros("ts").alias("at"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("row"))
        out = StructType([rows.schema["part"], rows.schema["ts"], *StructType.fromDDL("first long, n long, rows string")])

        def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table["part"]))
            part, at, texts = table["part"].to_numpy(), table["at"].to_numpy(), table["row"].to_pylist()
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            end = [*begin[1:], len(part)]
            for k in range(0, len(begin), PACKS):
                some = begin[k : k + PACKS]
                till = end[min(k + PACKS, len(begin)) - 1]
                low, high = np.minimum.reduceat(at[:till], some), np.maximum.reduceat(at[:till], some)
                columns = [pa.array(part[some], table.schema.field("part").type), pa.array(high).cast(table.schema.field("ts").type), pa.array(low), pa.array(np.diff([*some, till]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(texts[x:y]) for x, y in zip(some, [*some[1:], till])])], out.names)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= HELD:
                    yield from packs(held)
                    held, size = [], 0
            if size:
                yield from packs(held)

        return rows.mapInArrow(pack, out)

    def add(self, state, rows: list) -> None:
        for at in range(0, len(rows), CALL):
            state.appendValue((json.dumps(rows[at : at + CALL])[1:-1],))

    def anew(self, state, rows: list) -> None:
        state.clear()
        self.add(state, rows)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, held, n = [], [], 0
        for r in rows:
            first = [min([r.first, *first])]
            held.append(r.rows)
            n += r.n
            if n >= CALL:
                self.waiting.appendValue((",".join(held),))
                held, n = [], 0
        if held:
            self.waiting.appendValue((",".join(held),))
        self.due([(at,) for at in first])
        return iter([])

    def listed(self, state) -> list:
        return [r for (held,) in state.get() for r in json.loads(f"[{held}]")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = 1000 * timerValues.getCurrentWatermarkInMs() + 999
        rows, before = self.listed(self.waiting), self.applied.get()
        rest, due = [r for r in rows if r["at"] > now], {}
        for r in rows:
            if r["at"] <= now and (before is None or r["at"] > before[0]):
                due.setdefault(tuple(r[k] for k in self.key), []).append(r)
        if len(rest) < len(rows):
            self.anew(self.waiting, rest)
            self.due([(r["at"],) for r in rest])
            self.applied.update((now - 999,))
        listed = self.listed(self.states)
        states = {tuple(k): s for k, s in listed}
        woken = [k for k, s in states.items() if k not in due and (at := self.wake(s)) is not None and at <= now]
        first, second = self.names(self.ROW)[:2]
        changed, out = [], []
        for k in [*due, *woken]:
            state = before = states.get(k)
            said = []
            for r in sorted(due.get(k, ()), key=lambda r: (r["at"], r[first], r[second])):
                state, more = self.apply(state, r)
                said += more
            state, more = self.idle(state, now)
            if state != before and state is not None:
                states[k] = state
                changed.append((k, state))
            out += [{**dict(zip(self.key, k)), **r, "at": moment(r["at"])} for r in said + more]
        if len(listed) + len(changed) > 2 * len(states):
            self.anew(self.states, list(states.items()))
        else:
            self.add(self.states, changed)
        wakes = [at for s in states.values() if (at := self.wake(s)) is not None]
        if wakes:
            self.handle.registerTimer(-(-min(wakes) // 1000))
        for r in out:
            yield Row(**r)


def earliest(table: pa.Table, key: list[str], by: list[str], most: int) -> pa.Table:
    """The first ``most`` rows of each key."""
    table = table.take(pc.sort_indices(table, sort_keys=[(x, "ascending") for x in key + by]))
    at, new = np.arange(table.num_rows), np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        codes = pc.fill_null(pc.dictionary_encode(table[k].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return table.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < most))


def thinned(rows: DataFrame, key: list[str], by: list[str], most: int) -> DataFrame:
    """Rows without such as have ``most`` others of their key before them; some of those may stay, as a task holds few rows at a time.
    Stateless, in batches; the watermark's mark on the columns is kept."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                left = earliest(pa.Table.from_batches(held), key, by, most)
                held, size = left.to_batches(), left.num_rows
                if 2 * size > HELD:
                    yield from held
                    held, size = [], 0
        if held:
            yield from earliest(pa.Table.from_batches(held), key, by, most).to_batches()

    return rows.repartition(*key).mapInArrow(thin, rows.schema)


def in_order(rows: DataFrame, key: list[str], processor: InOrder, out: str) -> DataFrame:
    """``rows`` (key, ts with a watermark, the processor's columns) through the processor; append mode."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers and several states need it
    processor.key = key
    if processor.most is not None:
        rows = thinned(rows, key, ["ts", *processor.names(processor.ROW)[:2]], processor.most)
    if isinstance(processor, ManyInOrder):
        rows, key = processor.packed(rows), ["part"]
    return rows.groupBy(*key).transformWithState(processor, out, "append", "eventTime")
