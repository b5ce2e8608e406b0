"""Closed sessions of many groups, against plain loops; calls to the store follow the buckets."""
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import operators as so
from tessera.streaming.runner import replay
from tessera.streaming.state import SessionCounter

T0 = datetime(2024, 1, 1)
GAP = timedelta(minutes=30)


def _sessions(times):
    out = []
    for t in sorted(times):
        if out and t < out[-1][1]:
            out[-1] = (out[-1][0], t + GAP, out[-1][2] + 1)
        else:
            out.append((t, t + GAP, 1))
    return out


def test_sessions_and_late_rows_are_all_rows(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 2, 3, None, 2 ** 62 + 1]), T0 + timedelta(minutes=r.randrange(0, 5 * 1440)), int(r.random() < 0.2)) for _ in range(500)]
    rows = [(g, t, tardy) for g, t, tardy in rows if t + GAP > T0] + [(1, T0 + timedelta(minutes=m), 0) for m in (0, 30, 59, 88)]
    df = spark.createDataFrame(rows, "grp long, ts timestamp, tardy int")
    out = replay(df, "t", lambda s: so.stream_trend_closed(s, "grp", size_ms=1_800_000, session=True, delay="2 hours"), n_steps=2, scatter=F.col("tardy"))
    got = Counter({(x.grp, x.window_start, x.window_end, x.late): x.n for x in out.collect()})
    first = max(t for _, t, tardy in rows if not tardy) - timedelta(hours=2)
    last = max(t for _, t, _ in rows) - timedelta(hours=2)
    want = Counter()
    for g in {g for g, _, _ in rows}:
        late = [t for h, t, tardy in rows if h == g and tardy and t + GAP <= first]
        kept = [t for h, t, tardy in rows if h == g and not (tardy and t + GAP <= first)]
        for t in late:
            want[g, t, t + GAP, True] += 1
        for s, e, n in _sessions(kept):
            if e <= last:
                want[g, s, e, False] = n
    assert got == want and any(k[3] for k in got)


class _Map(dict):
    calls = 0

    def iterator(self):
        type(self).calls += 1
        return iter(list(self.items()))

    def updateValue(self, k, v):
        type(self).calls += 1
        self[k] = v

    def removeKey(self, k):
        type(self).calls += 1
        del self[k]


class _Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *a):
        return _Map()

    def registerTimer(self, t):
        self.timers.append(t)


def test_a_batch_makes_few_calls():
    import pandas as pd
    p, h = SessionCounter(1_800_000), _Handle()
    p.init(h)
    rows = pd.DataFrame({"grp": [str(i % 50) for i in range(5000)], "at": [T0 + timedelta(minutes=7 * (i // 50)) for i in range(5000)]})
    rows["at"] = pd.to_datetime(rows["at"], utc=True)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0
    assert list(p.handleInputRows((1,), iter([rows]), Times())) == []
    assert _Map.calls <= 4 and len(h.timers) == 1 and len(p.open) == 1
