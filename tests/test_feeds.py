"""Feeds against plain loops: keyed tables, state over restarts, and domains whose time is cut."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sitelens.streaming import feeds

SCHEMA = "event_id long, ts timestamp, job_id long, domain string, status string, latency double, ok boolean, progress long"
START = dt.datetime(2026, 1, 1)


def made_events(rng, n, hot=0.0, hours=30):
    out = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rng.randint(0, int(3600 * hours)), microseconds=rng.choice([0, 0, 500_000, 123_456]))
        domain = "hot" if rng.random() < hot else f"site{rng.randint(0, 4)}"
        status = rng.choice(["running", "completed", "failed", "pending"])
        out.append((i, at, rng.randint(0, 9), domain, status, rng.choice([0.1, 0.3, 0.6, 2.5, 4.0]), rng.random() < 0.7, rng.randint(0, 100)))
    return sorted(out, key=lambda r: (r[1], r[0]))


class Feed:
    """A folder of files that a stream reads, and a folder that it keeps its state in."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{self.path}/in/part={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in/part=*")


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def halves(rows):
    return rows[: len(rows) // 2], rows[len(rows) // 2 :]


def test_job_state_in_update_mode(feed):
    first, second = halves(made_events(random.Random(1), 120))
    second = [r for r in second if r[2] < 4]
    table = None
    for rows in (first, second):
        feed.add(rows)
        table = feeds.upserted(feeds.job_state(feed.stream()), ["job_id"], base=f"{feed.path}/base")
    want = {}
    for r in [*first, *second]:
        want[r[2]] = (r[4], r[7], r[0], want.get(r[2], (0, 0, 0, 0))[3] + 1)
    latest = lambda: {r.job_id: (r.status, r.progress, r.event_id, r.n_events) for r in table.rows().collect()}
    assert latest() == want
    numbers = table._numbers("changes")
    assert {r.job_id for r in table.changed(numbers[-1]).collect()} == {r[2] for r in second}  # only changed keys were written
    again = feed.spark.createDataFrame(table.changed(numbers[-1]).collect(), table.schema)
    table.put(again, numbers[-1])  # a batch that runs again
    assert latest() == want
    table.every = 1
    table.put(again, numbers[-1])  # now with a base of all rows
    assert table._numbers("base") == [numbers[-1]] and latest() == want


def test_lifecycle_over_a_restart(feed):
    parts = halves(made_events(random.Random(2), 150))
    for rows in parts:
        feed.add(rows)
        got = feeds.drained(feeds.lifecycle_stream(feed.stream()), "append", base=f"{feed.path}/base")
    want, last = set(), {}
    for r in [*parts[0], *parts[1]]:
        before = last.get(r[2])
        want.add((r[2], r[0], r[4], before, before not in ("completed", "failed"), before == "failed"))
        last[r[2]] = r[4]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert {tuple(r) for r in feeds.lifecycle(feed.spark.createDataFrame([*parts[0], *parts[1]], SCHEMA)).collect()} == want


def test_adaptive_rates_over_a_restart(feed):
    parts = halves(made_events(random.Random(3), 200))
    want, held = [], {}
    for rows in parts:
        feed.add(rows)
        got = feeds.drained(feeds.adaptive_rate_stream(feed.stream()), "append", base=f"{feed.path}/base")
        for r in rows:
            rate, latencies, errors, good = held.get(r[3], (1.0, [], 0, 0))
            latencies = [*latencies, r[5]][-10:]
            errors, good = (0, good + 1) if r[6] else (errors + 1, good)
            mean = sum(latencies) / len(latencies)
            if len(latencies) >= 5 and errors >= 3:
                rate, errors = max(0.1, rate * 0.8), 0
            elif len(latencies) >= 5 and mean > 2.0:
                rate = max(0.1, rate * 0.8)
            elif len(latencies) >= 5 and mean < 0.5 and good >= 5:
                rate, good = min(5.0, rate * 1.2), 0
            held[r[3]] = (rate, latencies, errors, good)
        want += [(d, round(held[d][0], 6), held[d][2]) for d in {r[3] for r in rows}]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len({w[1] for w in want}) > 2


def test_hourly_dedupe_over_a_restart(feed):
    parts = halves(made_events(random.Random(4), 260))
    for rows in parts:
        feed.add(rows)
        got = feeds.drained(feeds.dedupe_hour_stream(feed.stream()), "append", base=f"{feed.path}/base")
    want, last = set(), {}
    for r in [*parts[0], *parts[1]]:
        key = (r[2], r[4])
        if key not in last or (r[1] - last[key]).total_seconds() >= 3600:
            last[key] = r[1]
            want.add(r[0])
    rows = [r.event_id for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) < 260
    assert {r.event_id for r in feeds.dedupe_hour(feed.spark.createDataFrame([*parts[0], *parts[1]], SCHEMA)).collect()} == want


@pytest.mark.parametrize("rows", [7, 40, 100_000])
def test_audit_of_a_hot_domain(spark, rows):
    """Nine of ten requests go to one domain; cutting its time changes nothing."""
    rng = random.Random(5)
    events = made_events(rng, 300, hot=0.9, hours=0.05) + [(1000 + i, START + dt.timedelta(hours=3, milliseconds=400 * i), 1, "site1", "running", 0.2, True, 0) for i in range(20)]
    df = spark.createDataFrame(events, SCHEMA)
    rates = spark.createDataFrame([("hot", 4.0)], "domain string, rate double")
    got = {r.event_id: (r.gap, r.delay, r.over_burst) for r in feeds.rate_audit(df, rates, rows=rows).collect()}
    want = {}
    for domain in {e[3] for e in events}:
        own = sorted((e for e in events if e[3] == domain), key=lambda e: (e[1], e[0]))
        for i, e in enumerate(own):
            gap = None if i == 0 else (e[1] - own[i - 1][1]).total_seconds()
            least = 0.25 if domain == "hot" else 1.0
            count = sum(0 <= (e[1] - x[1]).total_seconds() <= 1 for x in own)
            want[e[0]] = (gap, None if gap is None else max(least - gap, 0.0), count > 3)
    assert set(got) == set(want)
    for i, (gap, delay, over) in want.items():
        assert got[i][2] == over and (got[i][0] is None) == (gap is None)
        if gap is not None:
            assert abs(got[i][0] - gap) < 1e-6 and abs(got[i][1] - delay) < 1e-6
        else:
            assert got[i][1] in (0.0, None) or got[i][1] >= 0


@pytest.mark.parametrize("rows", [4, 50, 100_000])
def test_moving_latency_of_a_hot_domain(spark, rows):
    events = made_events(random.Random(6), 250, hot=0.9, hours=0.1)
    got = {r.event_id: r.average for r in feeds.moving_latency(spark.createDataFrame(events, SCHEMA), rows=rows).collect()}
    for domain in {e[3] for e in events}:
        own = sorted((e for e in events if e[3] == domain), key=lambda e: (e[1], e[0]))
        for i, e in enumerate(own):
            last = [x[5] for x in own[max(0, i - 9) : i + 1]]
            want = sum(last) / len(last) if len(last) >= 5 else None
            assert (got[e[0]] is None) == (want is None) and (want is None or abs(got[e[0]] - want) < 2e-6)


def test_a_hot_domain_is_spread(spark):
    events = made_events(random.Random(7), 400, hot=0.95, hours=1)
    per = feeds.sliced(spark.createDataFrame(events, SCHEMA), 20).filter("domain = 'hot'").groupBy("slice").agg(F.count("*").alias("n")).collect()
    assert len(per) >= 15 and max(r.n for r in per) < 60
    assert feeds.sliced(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hourly_dedupe_asks_for_state_by_bucket(feed, monkeypatch):
    """State is read and written for a bucket, not for each key, and the result doesn't depend on the buckets."""
    rows = made_events(random.Random(6), 300)
    feed.add(rows)
    stream = feed.stream()
    found = []
    for buckets in (1, 3, 2048):
        got = feeds.drained(feeds.dedupe_hour_stream(stream, buckets=buckets), "append", base=f"{feed.path}/base{buckets}")
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] == found[2] == sorted(map(tuple, feeds.dedupe_hour(feed.spark.createDataFrame(rows, SCHEMA)).collect()))


def test_hourly_dedupe_drops_what_refuses_nothing():
    class State:
        def __init__(self):
            self.value, self.calls, self.timers, self.now = None, 0, [], 0

        def getValueState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.value, self.calls = value, self.calls + 1

        def clear(self):
            self.value = None

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    state, hour = State(), 3600 * 10**6
    run = feeds.DedupeHour(3600)
    run.init(state)
    keys = [f"{i:030x}00" for i in range(50)]

    def batch(micros, first):
        rows = pd.DataFrame({"key": keys, "event_id": range(first, first + 50), "micros": micros})
        return [e for out in run.handleInputRows((0,), iter([rows]), state) for e in out["event_id"]]

    assert len(batch(0, 0)) == 50 and state.calls == 1 and state.timers == [hour // 1000]
    assert batch(hour - 1, 100) == [] and state.calls == 3
    state.now = hour // 1000 - 1
    assert len(batch(hour, 200)) == 50 and len(state.timers) == 1 and len(state.value[0]) == 24 * 50
    state.now = hour // 1000
    assert list(run.handleExpiredTimer((0,), state, None)) == [] and state.timers == [hour // 1000, 2 * hour // 1000]
    state.now = 2 * hour // 1000
    assert list(run.handleExpiredTimer((0,), state, None)) == [] and state.value is None
