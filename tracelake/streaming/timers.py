"""Streams that act when time passes, not only when a row comes: sweeps time out, fixes go stale and are evicted, sweeps are matched once no fix can be nearer.

Each operator is a state processor with typed state and timers, keyed by stream, source or clock domain. In event time
(the default) a timer fires when the watermark passes it, so a run over given data always ends alike; in
processing time it fires by the clock. A row that is later than a timer still to fire lets it fire first, so the order of
micro-batches does not matter. ``time`` of the rows is their instant, of which the caller sets the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

NS_PER_MS = 1_000_000
#: The store that timers and several states for a key need (fixed value).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Set the state store of the session to the one that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    rows = pd.concat(list(frames)).sort_values(by)
    return rows.itertuples(index=False)


class _Processor(StatefulProcessor):
    columns: list[str]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


class _Sweeps(_Processor):
    columns = ["stream", "sweep", "first_n", "started_ms", "ended_ms", "outcome"]

    def __init__(self, size: int, timeout_ms: int) -> None:
        self.size, self.timeout = size, timeout_ms

    def init(self, handle) -> None:
        self.handle, self.now = handle, handle.getValueState("sweep", "sweep long, first long, started long, want long")

    def end(self, key: tuple, now: tuple, at: int, outcome: str) -> tuple[tuple, tuple]:
        sweep, first, started, _ = now
        self.handle.deleteTimer(started + self.timeout)
        return (sweep, first, started, -1), (key[0], sweep, first, started, at, outcome)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now, out = tuple(self.now.get()) if self.now.exists() else (0, 0, 0, -1), []
        for r in _sorted(rows, ["n"]):
            n, at, point = int(r.n), int(r.at_ms), None if pd.isna(r.point) else int(r.point)
            if now[3] >= 0 and at >= now[2] + self.timeout:
                now, row = self.end(key, now, now[2] + self.timeout, "timeout")
                out.append(row)
            if point == 0:
                if now[3] >= 0:
                    self.handle.deleteTimer(now[2] + self.timeout)
                now = (now[0] + 1, n, at, 1)
                self.handle.registerTimer(at + self.timeout)
            elif point is not None and now[3] >= 0:
                if point == now[3]:
                    now = (*now[:3], now[3] + 1)
                else:
                    now = self.end(key, now, at, "broken")[0]
            if now[3] == self.size:
                now, row = self.end(key, now, at, "complete")
                out.append(row)
        self.now.update(now)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, at = tuple(self.now.get()), expiredTimerInfo.getExpiryTimeInMs()
        if now[3] >= 0 and now[2] + self.timeout <= at:
            now, row = self.end(key, now, now[2] + self.timeout, "timeout")
            self.now.update(now)
            yield self.frame([row])


class _Health(_Processor):
    columns = ["stream", "at_ms", "seq", "kind", "state"]

    def __init__(self, stale_ms: int) -> None:
        self.stale = stale_ms

    def init(self, handle) -> None:
        self.handle, self.now = handle, handle.getValueState("health", "link string, heard string, fix long, due long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        link, heard, fix, due = self.now.get() if self.now.exists() else ("", "", -1, -1)
        out = []

        def undue() -> None:
            nonlocal due
            if due >= 0:
                self.handle.deleteTimer(due)
            due = -1

        for r in _sorted(rows, ["at_ms", "seq"]):
            at, seq, kind = int(r.at_ms), int(r.seq), r.kind
            if 0 <= due <= at:
                out.append((key[0], due, None, "timer", "stale"))
                undue()
            if kind in ("connect", "disconnect"):
                undue()
                link, heard, fix = kind, "", -1
            elif kind in ("valid", "invalid", "sentence"):
                heard = kind
                if kind == "valid":
                    undue()
                    fix = at
                    if link == "connect":
                        due = at + self.stale + 1
                        self.handle.registerTimer(due)
            if link:
                fresh = "stale" if at - fix > self.stale else "valid"
                state = "disconnected" if link == "disconnect" else fresh if fix >= 0 else {"": "no_sentence", "invalid": "invalid"}.get(heard, "no_fix")
                out.append((key[0], at, seq, kind, state))
        self.now.update((link, heard, fix, due))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        link, heard, fix, due = self.now.get()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.now.update((link, heard, fix, -1))
            yield self.frame([(key[0], due, None, "timer", "stale")])


class _Cache(_Processor):
    columns = ["source", "fix_id", "reason", "at_ms"]

    def __init__(self, newest: int, age_ms: int) -> None:
        self.newest, self.age = newest, age_ms

    def init(self, handle) -> None:
        self.handle, self.fixes = handle, handle.getMapState("fixes", "fix_id long", "at long")

    def aged(self, key: tuple, have: dict[int, int], upto: int) -> list[tuple]:
        gone = sorted((at, i) for i, at in have.items() if at + self.age < upto)
        for at, i in gone:
            del have[i]
            self.fixes.removeKey((i,))
        return [(key[0], i, "age", at + self.age + 1) for at, i in gone]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        have, out = {k[0]: v[0] for k, v in self.fixes.iterator()}, []
        for r in _sorted(rows, ["at_ms", "fix_id"]):
            at, i = int(r.at_ms), int(r.fix_id)
            out += self.aged(key, have, at)
            have[i] = at
            self.fixes.updateValue((i,), (at,))
            self.handle.registerTimer(at + self.age + 1)
            if len(have) > self.newest:
                old = min((x, j) for j, x in have.items())
                del have[old[1]]
                self.fixes.removeKey((old[1],))
                out.append((key[0], old[1], "count", at))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        have = {k[0]: v[0] for k, v in self.fixes.iterator()}
        gone = sorted((at, i) for i, at in have.items() if at + self.age < expiredTimerInfo.getExpiryTimeInMs())
        for _, i in gone:
            self.fixes.removeKey((i,))
        yield self.frame([(key[0], i, "age", at + self.age + 1) for at, i in gone])


class _Nearest(_Processor):
    columns = ["domain", "sweep_id", "fix_id", "distance_ns", "reason"]

    def __init__(self, stale_ns: int, window_ns: int) -> None:
        self.stale, self.window = stale_ns, window_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.fixes = handle.getMapState("fixes", "at long, seq long", "fix_id long, valid boolean")
        self.sweeps = handle.getMapState("sweeps", "sweep_id long", "at long")

    def due(self, at: int) -> int:
        return -(-(at + self.window) // NS_PER_MS) + 1

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in _sorted(rows, ["at_ns"]):
            if r.kind == "fix":
                self.fixes.updateValue((int(r.at_ns), int(r.seq)), (int(r.id), bool(r.valid)))
            else:
                self.sweeps.updateValue((int(r.id),), (int(r.at_ns),))
                self.handle.registerTimer(self.due(int(r.at_ns)))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        sweeps = {k[0]: v[0] for k, v in self.sweeps.iterator()}
        fixes = sorted((tuple(k), tuple(v)) for k, v in self.fixes.iterator())
        out = []
        for sweep, at in sorted(sweeps.items()):
            if self.due(at) > now:
                continue
            self.sweeps.removeKey((sweep,))
            # the nearest; of equal distance the earlier one, of equal time the lowest seq
            best = min(((abs(t - at), t, seq, fix, valid) for (t, seq), (fix, valid) in fixes), default=None)
            reason = "no_fix" if best is None else "out_of_range" if best[0] > self.window else "invalid" if not best[4] else "stale" if best[0] > self.stale else None
            out.append((key[0], sweep, best and best[3], best and best[0], reason))
        # fixes that a sweep to come may still need: those within the window, and the last one before as evidence
        floor = min([now * NS_PER_MS - self.window, *(at for s, at in sweeps.items() if self.due(at) > now)]) - self.window
        old = [k for k, _ in fixes if k[0] < floor]
        for k in old:
            if k[0] != old[-1][0]:
                self.fixes.removeKey(k)
        yield self.frame(out)


def _run(rows: DataFrame, key: str, processor: _Processor, schema: str, mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", mode)


def timed_sweeps(points: DataFrame, size: int, timeout_ms: int, mode: str = "eventTime") -> DataFrame:
    """``points(stream, n, at_ms, point, time)`` to ``(stream, sweep, first_n, started_ms, ended_ms, outcome)``, complete or timeout.

    A sweep that is neither whole nor broken ``timeout_ms`` after its start ends then, whether or not a row comes.
    """
    return _run(points, "stream", _Sweeps(size, timeout_ms), "stream long, sweep long, first_n long, started_ms long, ended_ms long, outcome string", mode)


def timed_health(events: DataFrame, stale_ms: int, mode: str = "eventTime") -> DataFrame:
    """``events(stream, at_ms, seq, kind, time)`` to the state at each of them, and a row of kind ``timer`` when a fix goes stale."""
    return _run(events, "stream", _Health(stale_ms), "stream long, at_ms long, seq long, kind string, state string", mode)


def evictions(fixes: DataFrame, newest: int, age_ms: int, mode: str = "eventTime") -> DataFrame:
    """``fixes(source, fix_id, at_ms, time)`` to what leaves a cache of the ``newest`` fixes no older than ``age_ms``: ``(source, fix_id, reason, at_ms)``, count or age."""
    return _run(fixes, "source", _Cache(newest, age_ms), "source long, fix_id long, reason string, at_ms long", mode)


def nearest_fix_stream(rows: DataFrame, *, stale_after_s: float, window_s: float) -> DataFrame:
    """``rows(domain, at_ns, kind, id, seq, valid, time)``, sweeps and fixes, to ``(domain, sweep_id, fix_id, distance_ns, reason)``.

    A sweep is held until the watermark passes its window on the far side, and then matched once; what comes later
    changes nothing. Beyond the window only fixes before a sweep are evidence, as later ones aren't waited for. Kept are fixes of one window and the
    last before it.
    """
    if not 0 < stale_after_s <= window_s:
        raise ValueError("0 < stale_after_s <= window_s is needed")
    ns = 1_000_000_000
    return _run(rows, "domain", _Nearest(int(stale_after_s * ns), int(window_s * ns)), "domain long, sweep_id long, fix_id long, distance_ns long, reason string", "eventTime")


def with_time(rows: DataFrame, at_ms: str, delay: str = "0 seconds") -> DataFrame:
    """``rows`` with ``time`` of a column of milliseconds, and a watermark that far behind."""
    return rows.withColumn("time", F.timestamp_millis(at_ms)).withWatermark("time", delay)
