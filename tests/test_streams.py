"""Keyed state with timers: order over micro-batches, bounded rows, freshness that ends by itself."""
import datetime as dt
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from tallywright.plans import q_streams
from tallywright.plans.registry import QUERIES
from tallywright.streaming import jobs, runner, stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, key string, flag boolean"


def files(spark, folder, parts, schema=SCHEMA):
    """One file, and so one micro-batch, for each part; an even modification time for each."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return runner.stream_files(spark, str(folder), "*.parquet", schema, 1)


def stepped(rows, step, start, ttl_us=None):
    state, seen, out = {}, {}, []
    for i, t, k, flag in sorted(rows, key=lambda r: (r[1], r[0])):
        us = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        if ttl_us and k in seen and us - seen[k] > ttl_us:
            state[k] = start
        seen[k] = us
        state[k], got = step(state.get(k, start), us, flag)
        if got is not None:
            out.append((k, i, *got))
    return sorted(out)


def test_rows_of_later_batches_with_earlier_times(spark, tmp_path):
    """Each batch overlaps the one before by an hour of event time; the result is that of all rows in order."""
    rng = random.Random(11)
    rows = [(n, T0 + dt.timedelta(minutes=n * 10 + rng.randrange(10)), rng.choice("abc"), rng.random() < 0.6) for n in range(240)]
    dealt = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(60)))
    stream = files(spark, tmp_path / "in", [dealt[60 * k:60 * k + 60] for k in range(4)]).withColumnRenamed("flag", "dark")
    got = runner.to_the_end(lambda close: jobs.dark_streak(stream, "key", late="2 hours", slot_minutes=30, close=close), spark, str(tmp_path / "w"))
    want = stepped(rows, jobs.streak_step(360 * 60_000_000, 2, 3), (0, 0, jobs.NEVER))
    assert sorted((r.key, r.id, r.streak, r.dispatch, r.escalate) for r in got.collect()) == want


def test_a_busy_key_is_held_slot_by_slot(spark, tmp_path, monkeypatch):
    """20,000 rows of one key in one batch: no sort of a slot sees more than the rows of a minute."""
    rows = [(n, T0 + dt.timedelta(seconds=n), "hot", None) for n in range(20_000)]
    random.Random(1).shuffle(rows)
    stream = files(spark, tmp_path / "in", [rows])

    def step(state, t, _):
        # Rows come in order, so a count that starts anew every minute is the number of rows of the slot so far.
        minute, n = state
        n = n + 1 if t // 60_000_000 == minute else 1
        return (t // 60_000_000, n), (n,)

    job = lambda close: stateful.in_order(stream, "key", None, step, (-1, 0), "minute long, n long", "n long", "1 minute", 1, 30, close)
    got = runner.to_the_end(job, spark, str(tmp_path / "w")).collect()
    assert len(got) == 20_000 and max(r.n for r in got) == 60
    assert [r.id for r in sorted(got, key=lambda r: r.ts)] == list(range(20_000))


def test_a_silent_key_starts_anew(spark, tmp_path):
    rows = [(1, T0, "a", None), (2, T0 + dt.timedelta(days=3), "a", None), (3, T0, "b", None), (4, T0 + dt.timedelta(days=1, hours=23), "b", None), (5, T0 + dt.timedelta(days=9), "c", None)]
    stream = files(spark, tmp_path / "in", [rows[:1] + rows[2:3], rows[1:2] + rows[3:]])
    got = runner.to_the_end(lambda close: jobs.restart_plan(stream, "key", ttl_days=2, late="10 days", close=close), spark, str(tmp_path / "w"))
    want = stepped(rows, jobs.restart_step(360 * 60_000_000, 3), (jobs.NEVER, 0, False), 2 * 86_400_000_000)
    assert sorted((r.key, r.id, r.plan, r.attempt) for r in got.collect()) == want
    assert [w for w in want if w[0] == "a"] == [("a", 1, "restart", 1), ("a", 2, "restart", 1)]


def test_a_stream_without_events_turns_stale(spark, tmp_path):
    """No event comes after the first batch; a timer ends the freshness of the first stream, the second stays fresh."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stream = files(spark, tmp_path / "in", [[(1, now, "short", None), (2, now, "long", None), (3, now - dt.timedelta(days=9), "old", None), (4, now, "undeclared", None)]])
    slo = spark.createDataFrame([("short", 12 / 3600), ("long", 24.0), ("old", 24.0), ("never", 1.0)], "key string, max_age_h double")
    folder = str(tmp_path / "w")
    states = jobs.freshness_stream(stream, "key", slo)

    def write(batch, no):
        batch.write.mode("append").parquet(f"{folder}/out")

    with runner.keyed_state(spark):
        q = states.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(processingTime="1 second").start()
    seen = set()
    try:
        for _ in range(90):
            time.sleep(1)
            try:
                seen = {(r.key, r.state) for r in spark.read.parquet(f"{folder}/out").collect()}
            except Exception:  # nothing is written yet, or a file is being moved
                continue
            if ("short", "STALE") in seen:
                break
    finally:
        q.stop()
    assert seen == {("short", "FRESH"), ("short", "STALE"), ("long", "FRESH"), ("old", "STALE")}
    from tallywright.functions.ordered import latest_by
    newest = latest_by(spark.read.parquet(f"{folder}/out"), ["key"], ["at"])
    table = jobs.freshness_table(newest, slo, "key", F.current_timestamp())
    assert {r.key: r.state for r in table.collect()} == {"short": "STALE", "long": "FRESH", "old": "STALE", "never": "NO_DATA"}


@pytest.mark.parametrize("parts", [0, 2])
def test_tables_of_one_file_or_of_part_files(spark, tmp_path, parts):
    """A table is a file or a folder of files; the later file of the folder has the earlier messages, far before those of the first."""
    talk = [(c, 0, "user", "I was injured.") for c in range(20_000, 20_004)], [(c, 0, "user", "I was injured.") for c in range(4)]
    docs = [(c, f"text {c}", "en", "s") for c in range(6)]
    for name, rows, schema in [("conversations", talk, "conv_id long, turn long, role string, text string"), ("documents", (docs[:3], docs[3:]), "doc_id long, text string, lang string, source string")]:
        made = [pa.Table.from_pylist([r.asDict() for r in spark.createDataFrame(x, schema).collect()]) for x in rows]
        at = tmp_path / f"{name}.parquet"
        if not parts:
            pq.write_table(pa.concat_tables(made), at)
            continue
        at.mkdir()
        for k, x in enumerate(made):
            pq.write_table(x, at / f"part-{k}.parquet")
            os.utime(at / f"part-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(q_streams, "FILES", 1)
        alerts = {r.conv_id for r in QUERIES["st08_safety_stream"](spark, str(tmp_path)).collect()}
        assert alerts == {c for x in talk for c, *_ in x}
        assert QUERIES["st09_incremental_index"](spark, str(tmp_path)).count() == 6
