"""Stateful processors of the streaming operators (``transformWithStateInPandas``).

State lies in the RocksDB store by key: a batch reads and writes the entries that it needs, never a
group's whole buffer.  Event-time timers end what would otherwise stay for ever, and what they end is
given out as rows, not dropped.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.transcript import FORCED_QUALITY, ITERATION_THRESHOLDS, MAX_REVISIONS


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class _Ordered(StatefulProcessor):
    """Items that are numbered from 1 in each group and come in any order.  ``place`` holds how far the
    group is read without a gap; ``wait`` holds items until they are used, those of BLOCK numbers as one
    entry, so a batch makes a few calls to the store for each group and not some for each item.

    A group has one timer at a time, for the time that was the end of its silence when it was set; if
    more has come since, it is set again."""
    BLOCK = 128

    #: columns of an item besides its number, and the store's types of the place
    item: tuple[str, ...]
    place_schema: str
    start: tuple

    def __init__(self, abandon_ms: int | None):
        self.abandon_ms = abandon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", self.place_schema + ", latest long")
        self.wait = handle.getMapState("wait", "block long", "items string")

    def read(self, key: tuple, place: tuple) -> tuple[tuple, list[tuple]]:
        """Use what follows without a gap: (the new place, output rows)."""
        raise NotImplementedError

    def unfinished(self, key: tuple, place: tuple) -> list[tuple]:
        raise NotImplementedError

    @staticmethod
    def _items(entry: tuple | None) -> dict[int, tuple]:
        return {seq: tuple(item) for seq, item in json.loads(entry[0])} if entry is not None else {}

    def block(self, seq: int) -> dict[int, tuple]:
        """The items of the block of ``seq``, read from the store once in a batch."""
        b = seq // self.BLOCK
        if b not in self.blocks:
            entry = self.wait.getValue((b,)) if self.known else None
            self.blocks[b] = self._items(entry)
            if entry is not None:
                self.in_store.add(b)
        return self.blocks[b]

    def look(self, seq: int) -> tuple | None:
        return self.block(seq).get(seq)

    def take(self, seq: int) -> tuple:
        self.changed.add(seq // self.BLOCK)
        return self.block(seq).pop(seq)

    def waiting(self) -> list[tuple[int, tuple]]:
        """All (number, item) of the store, in order."""
        return sorted((x for _, entry in self.wait.iterator() for x in self._items(entry).items()), key=lambda x: x[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A group's new rows of one micro-batch are held; the rest stays in the store."""
        before = self.place.get()
        *place, latest = before if before is not None else (*self.start, 0)
        newest = latest
        self.known, self.blocks, self.in_store, self.changed = before is not None, {}, set(), set()
        for pdf in rows:
            for seq, *values in zip(pdf["seq"], *(pdf[c] for c in self.item)):
                # an item before the place was used already and has come again
                if seq >= place[0]:
                    self.block(int(seq))[int(seq)] = self.stored(*values)
                    self.changed.add(int(seq) // self.BLOCK)
            if "ts" in pdf.columns and len(pdf):
                newest = max(newest, _millis(pdf["ts"].max()))
        place, out = self.read(key, tuple(place))
        for b in self.changed:
            if self.blocks[b]:
                self.wait.updateValue((b,), (json.dumps(sorted(self.blocks[b].items())),))
            elif b in self.in_store:
                self.wait.removeKey((b,))
        self.place.update((*place, newest))
        if self.abandon_ms is not None and newest and not latest:
            self.handle.registerTimer(newest + self.abandon_ms)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The group was silent for ``abandon_ms`` of event time: what waits is given out as unfinished
        and all state goes.  If the group goes on later, its numbers begin after a gap, so these rows
        come out as unfinished in their turn."""
        before = self.place.get()
        if before is None:
            return
        *place, latest = before
        if latest + self.abandon_ms > max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()):
            self.handle.registerTimer(latest + self.abandon_ms)
            return
        out = self.unfinished(key, tuple(place))
        self.wait.clear()
        self.place.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class ChunkAssembler(_Ordered):
    """ST2: chunks to messages.  place: first number of the message in work, its number, first number
    that is not here yet."""
    item, place_schema, start = ("content", "is_final"), "first long, msg long, at long", (1, 1, 1)
    columns = ["stream_id", "msg_no", "n_chunks", "content", "complete"]

    @staticmethod
    def stored(content, final) -> tuple:
        return (None if content is None or content != content else str(content), bool(final))

    def read(self, key, place):
        first, msg, at = place
        out = []
        while (chunk := self.look(at)) is not None:
            at += 1
            if chunk[1]:
                parts = [self.take(s)[0] or "" for s in range(first, at)]
                out.append((key[0], msg, len(parts), "".join(parts), True))
                first, msg = at, msg + 1
        return (first, msg, at), out

    def unfinished(self, key, place):
        chunks = [(seq, item[0] or "") for seq, item in self.waiting()]
        return [(key[0], place[1], len(chunks), "".join(c for _, c in chunks), False)] if chunks else []


class ReviewCounter(_Ordered):
    """ST6: reviews decided in the order of their thread.  place: next number, reviews so far."""
    item, place_schema, start = ("turn", "is_review", "quality"), "next long, seen long", (1, 0)
    columns = ["thread_id", "turn", "quality", "iteration", "threshold", "approved", "emitted_quality", "decided"]

    @staticmethod
    def stored(turn, review, quality) -> tuple:
        return (int(turn), bool(review), None if pd.isna(quality) else float(quality))

    def read(self, key, place):
        at, seen = place
        thresholds, out = dict(ITERATION_THRESHOLDS), []
        while self.look(at) is not None:
            turn, review, quality = self.take(at)
            at += 1
            if review:
                seen += 1
                t = thresholds.get(seen)
                forced = seen > MAX_REVISIONS
                passed = t is not None and quality is not None and quality >= t
                out.append((key[0], turn, quality, seen, t, bool(forced or passed), float(FORCED_QUALITY) if forced else quality, True))
        return (at, seen), out

    def unfinished(self, key, place):
        """Reviews behind a gap: which of the thread's they are is not known."""
        return [(key[0], turn, quality, None, None, None, None, False)
                for _, (turn, review, quality) in self.waiting() if review]


class WindowCounter(StatefulProcessor):
    """ST7: counts in event-time windows.  A window is given out once, when the watermark passes its
    end; rows that come after that are given out as late, by window, and are in no closed window."""
    columns = ["grp", "window_start", "window_end", "n", "late"]

    def __init__(self, size_ms: int, slide_ms: int | None = None, session: bool = False):
        self.size, self.slide, self.session = size_ms, slide_ms or size_ms, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("windows", "start long", "until long, n long")

    def _windows(self, ts: np.ndarray) -> dict[tuple[int, int], int]:
        """Windows (start, end) in microseconds of the times and how many fall in each."""
        size, slide = self.size * 1000, self.slide * 1000
        if self.session:
            return {(int(t), int(t) + size): int(n) for t, n in zip(*np.unique(ts, return_counts=True))}
        out: dict[tuple[int, int], int] = {}
        for back in range(-(-size // slide)):
            start = ts // slide * slide - back * slide
            for s, n in zip(*np.unique(start[start + size > ts], return_counts=True)):
                out[int(s), int(s) + size] = out.get((int(s), int(s) + size), 0) + int(n)
        return out

    @staticmethod
    def _timer(end: int) -> int:
        """Milliseconds at which a window's end is passed."""
        return -(-end // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ts = [pd.DatetimeIndex(pdf["at"]).as_unit("us").asi8 for pdf in rows]
        found = self._windows(np.concatenate(ts))
        late = [(key[0], s, e, n, True) for (s, e), n in found.items() if self._timer(e) <= watermark]
        found = {w: n for w, n in found.items() if self._timer(w[1]) > watermark}
        if self.session:
            self._merge(found)
        else:
            for (s, e), n in found.items():
                have = self.open.getValue((s,))
                self.open.updateValue((s,), (e, n + (have[1] if have else 0)))
                if have is None:
                    self.handle.registerTimer(self._timer(e))
        if late:
            yield self._rows(late)

    def _merge(self, found: dict) -> None:
        """Sessions whose times are less than the gap apart become one."""
        have = {(k[0], v[0]): v[1] for k, v in self.open.iterator()}
        merged: list[list[int]] = []
        for s, e, n in sorted((s, e, n) for d in (have, found) for (s, e), n in d.items()):
            if merged and s < merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], e), merged[-1][2] + n
            else:
                merged.append([s, e, n])
        now = {(s, e): n for s, e, n in merged}
        for s, e in have.keys() - now.keys():
            self.open.removeKey((s,))
        for (s, e), n in now.items():
            if have.get((s, e)) != n:
                self.open.updateValue((s,), (e, n))
                self.handle.registerTimer(self._timer(e))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = expiredTimerInfo.getExpiryTimeInMs()
        # a session that has grown since the timer was set ends at a later one
        done = [(k[0], v[0], v[1]) for k, v in self.open.iterator() if self._timer(v[0]) <= watermark]
        for s, _, _ in done:
            self.open.removeKey((s,))
        if done:
            yield self._rows([(key[0], s, e, n, False) for s, e, n in sorted(done)])

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        for c in ("window_start", "window_end"):
            out[c] = pd.to_datetime(out[c], unit="us", utc=True)
        return out

    def close(self) -> None:
        pass


class SessionCounter(WindowCounter):
    """ST7 sessions of many groups at a time: a key is a bucket of groups.  Open sessions lie in the
    store by the day in which they end, a day's as one entry of columns, so a batch makes a few calls
    to the store for each bucket and not some for each session."""
    _DAY = 86_400_000_000
    _COLUMNS = ("grp", "start", "until", "n")

    def __init__(self, gap_ms: int):
        super().__init__(gap_ms, session=True)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("sessions", "day long", "rows binary")

    def _load(self) -> dict[int, bytes]:
        return {k[0]: bytes(v[0]) for k, v in self.open.iterator()}

    def _frame(self, held: dict[int, bytes]) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(v).read_pandas() for v in held.values()]

    def _store(self, rows: pd.DataFrame, held: dict[int, bytes]) -> None:
        """``rows`` in place of ``held``, and a timer for the session that ends first."""
        now = {}
        for day, part in rows.groupby(rows["until"] // self._DAY):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_arrays([pa.array(part["grp"], pa.string()), *(pa.array(part[c].to_numpy(np.int64)) for c in self._COLUMNS[1:])],
                                         names=list(self._COLUMNS))
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            now[int(day)] = sink.getvalue().to_pybytes()
        for day in held.keys() - now.keys():
            self.open.removeKey((day,))
        for day, data in now.items():
            if held.get(day) != data:
                self.open.updateValue((day,), (data,))
        if len(rows):
            self.handle.registerTimer(self._timer(int(rows["until"].min())))

    @staticmethod
    def _joined(rows: pd.DataFrame) -> pd.DataFrame:
        """Sessions of a group whose times are less than the gap apart made one."""
        code = pd.factorize(rows["grp"], use_na_sentinel=False)[0]
        rows = rows.assign(_g=code).sort_values(["_g", "start", "until"], kind="stable")
        g, start = rows["_g"].to_numpy(), rows["start"].to_numpy()
        reach = rows.groupby("_g")["until"].cummax().to_numpy()
        new = np.ones(len(rows), bool)
        new[1:] = (g[1:] != g[:-1]) | (start[1:] >= reach[:-1])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(rows)) - 1
        return pd.DataFrame({"grp": rows["grp"].to_numpy()[first], "start": start[first], "until": reach[last],
                             "n": np.add.reduceat(rows["n"].to_numpy(), first)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        found = pd.concat([pd.DataFrame({"grp": pdf["grp"].astype(object), "start": pd.DatetimeIndex(pdf["at"]).as_unit("us").asi8}) for pdf in rows])
        if not len(found):
            return
        found = found.assign(n=1).groupby(["grp", "start"], dropna=False, as_index=False)["n"].sum()
        found["grp"] = found["grp"].astype(object).where(found["grp"].notna(), None)
        found["until"] = found["start"] + self.size * 1000
        is_late = -(-found["until"] // 1000) <= watermark
        late, found = found[is_late], found[~is_late]
        if len(found):
            held = self._load()
            self._store(self._joined(pd.concat([*self._frame(held), found[list(self._COLUMNS)]], ignore_index=True)), held)
        if len(late):
            yield self._given(late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self._load()
        # days that end after the watermark have nothing to give
        held = {d: v for d, v in held.items() if d * self._DAY <= (watermark + 1) * 1000}
        if not held:
            return
        rows = pd.concat(self._frame(held), ignore_index=True)
        ended = -(-rows["until"] // 1000) <= watermark
        self._store(rows[~ended], held)
        if ended.all():
            rest = [k[0] for k, _ in self.open.iterator()]
            if rest:
                self.handle.registerTimer(max(watermark + 1, min(rest) * self._DAY // 1000))
        if ended.any():
            yield self._given(rows[ended], False)

    def _given(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        groups = rows["grp"].astype(object).where(rows["grp"].notna(), None)
        return self._rows(list(zip(groups, rows["start"], rows["until"], rows["n"], [late] * len(rows))))
