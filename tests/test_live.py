"""Streams whose answer must not depend on how the rows are cut into triggers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline.config import DriftThresholds, Route, Snapshot
from meterline.streaming import jobs
from meterline.streaming.runs import drain, heartbeats

START = datetime(2024, 1, 1)
LOG = ("timestamp string, request_id string, task_id string, input_hash string, routing_decision string, "
       "status string, http_status int, latency_ms long")
NOTE = "timestamp string, request_id string, task_id string, rating string"
TRIGGERS = [1, 4, 16]


def stamp(minutes):
    return (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")


def stream(spark, folder, rows, schema, triggers):
    """The rows in order, in 16 files, read in so many triggers."""
    size = -(-len(rows) // 16)
    for i in range(16):
        part = rows[i * size:(i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    reader = spark.readStream.schema(spark.read.parquet(str(folder)).schema)
    return reader.option("maxFilesPerTrigger", -(-16 // triggers)).parquet(str(folder))


def traffic(n=640):
    """Requests in order of time, neighbours swapped now and then; some without a time or an input."""
    rows = [(stamp(7 * i + (40 if i % 9 == 0 else 0)), f"r{i}", f"task_{i % 3}",
             None if i % 50 == 0 else f"h{i % 7 + 7 * (i % 11 == 0)}", "student" if i % 4 else "teacher",
             "error" if i % 5 == 0 else "success", 200, 30 + 7 * (i % 90)) for i in range(n)]
    return rows + [("no time", "odd", "task_1", "h1", "student", "success", 200, 5)]


def instant(text):
    return datetime.fromisoformat(text.rstrip("Z"))


def brute_newest(rows, gap=timedelta(hours=6)):
    keyed = {}
    for r in rows:
        if r[0] != "no time":
            keyed.setdefault((r[2], r[3] or r[1]), []).append((instant(r[0]), r[0], r[1]))
    out = []
    for copies in keyed.values():
        run = []
        for c in sorted(copies):
            if run and c[0] - run[-1][0] >= gap:
                out.append((run[-1][2], len(run)))
                run = []
            run.append(c)
        out.append((run[-1][2], len(run)))
    return sorted(out)


@pytest.mark.parametrize("triggers", TRIGGERS)
def test_newest_copies(spark, tmp_path, triggers):
    rows = traffic()
    beats, send = heartbeats(spark)
    logs = stream(spark, tmp_path / "log", rows, LOG, triggers).unionByName(
        beats.drop("ts"), allowMissingColumns=True)
    got = drain(jobs.newest_copies(logs), "newest", closing=send)
    assert sorted((r.request_id, r.copies) for r in got.collect()) == brute_newest(rows)
    assert got.columns == [*spark.createDataFrame([], LOG).columns, "copies", "first_seen"]


def test_newest_copies_wait_for_the_watermark(spark, tmp_path):
    """Without a heartbeat only runs come out that the watermark has left behind."""
    rows = traffic()
    got = drain(jobs.newest_copies(stream(spark, tmp_path / "log", rows, LOG, 4)), "newest").collect()
    all_ = brute_newest(rows)
    assert 0 < len(got) < len(all_) and {(r.request_id, r.copies) for r in got} <= set(all_)


@pytest.mark.parametrize("triggers", TRIGGERS)
def test_unanswered_probes_come_out(spark, tmp_path, triggers):
    probes = [(f"p{i}", START + timedelta(minutes=i), f"ask {i}") for i in range(160)]
    answers = [(f"p{i}", START + timedelta(minutes=i + (9 if i % 8 == 1 else 2)), f"say {i}")
               for i in range(160) if i % 5]
    beats, send = heartbeats(spark)
    beats = beats.drop("timestamp")
    left = stream(spark, tmp_path / "p", probes, "request_id string, ts timestamp, asked string", triggers)
    right = stream(spark, tmp_path / "a", answers, "request_id string, ts timestamp, said string", triggers)
    pairs = jobs.pair_probe_streams(left.unionByName(beats, allowMissingColumns=True),
                                    right.unionByName(beats, allowMissingColumns=True), "20 minutes")
    got = {r.request_id: r.said for r in drain(pairs, "pairs", closing=send).collect()}
    assert got == {f"p{i}": f"say {i}" if i % 5 and i % 8 != 1 else None for i in range(160)}


ROUTES = Snapshot(1, "teacher_only", {
    "task_0": Route("teacher_only"), "task_1": Route("student_only", "s"), "task_2": Route("shadow", "s")})


def brute_rolling(rows, notes):
    logs = {r[1]: r for r in rows if r[0] != "no time"}
    hours = {}
    for r in logs.values():
        if r[4] == "student" and r[2] == "task_1":
            hours.setdefault(instant(r[0]).replace(minute=0, second=0), []).append(
                (r[7], r[5] == "error", None))
    for stamped, request, task, rating in notes:
        known = logs.get(request)
        known = known if known and known[2] in ("task_1", "task_2") else None
        if (known[2] if known and known[4] == "student" else None if known else task) == "task_1":
            hours.setdefault(instant(stamped).replace(minute=0, second=0), []).append(
                (None, None, rating == " Bad "))
    out = {}
    for hour, marks in hours.items():
        for k in range(24):
            out.setdefault(hour - timedelta(hours=k), []).extend(marks)
    return {w: (sum(b is not None for _, b, _ in m), sum(bool(b) for _, b, _ in m),
                sum(n is not None for *_, n in m), sum(bool(n) for *_, n in m),
                sorted(ms for ms, *_ in m if ms is not None)) for w, m in out.items()}


@pytest.mark.parametrize("triggers", TRIGGERS)
def test_rolling_drift(spark, tmp_path, triggers):
    rows = traffic()
    notes = [(stamp(7 * i + 60), f"r{i}" if i % 6 else None if i % 12 else f"lost{i}", "task_1",
              " Bad " if i % 3 else "good") for i in range(0, 640, 2)]
    beats, send = heartbeats(spark)
    beats = beats.drop("ts")
    logs = stream(spark, tmp_path / "l", rows, LOG, triggers).unionByName(beats, allowMissingColumns=True)
    feedback = stream(spark, tmp_path / "f", notes, NOTE, triggers).unionByName(beats, allowMissingColumns=True)
    limits = DriftThresholds(max_error_rate=0.9, max_negative_feedback_rate=0.2)
    got = drain(jobs.rolling_drift(logs, feedback, ROUTES.routes_df(spark), limits, lateness="3 hours"),
                "rolling", closing=send).filter("task_id = 'task_1'").collect()
    want = brute_rolling(rows, notes)
    assert {r.window_start: (r.student_requests, r.student_errors, r.feedback_total, r.feedback_negative)
            for r in got} == {w: v[:4] for w, v in want.items()}
    for r in got:
        ms = want[r.window_start][4]
        if ms:  # each bucket is within 1/64 of its values, so the percentile is as well
            at = 0.95 * (len(ms) - 1)
            exact = ms[int(at)] + (at - int(at)) * (ms[min(int(at) + 1, len(ms) - 1)] - ms[int(at)])
            assert abs(r.student_p95_latency_ms - exact) <= exact / 64 + 1
    assert any("negative_feedback_rate" in x for r in got for x in r.rollback_reasons)


def test_latency_marks(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 123_456, 2**40]
    frame = spark.createDataFrame([(v,) for v in values], "ms long").select(
        "ms", jobs.latency_mark(F.col("ms")).alias("mark"))
    for r in frame.collect():
        assert abs(r.mark - r.ms) <= r.ms / 64 and (r.ms >= 64 or r.mark == r.ms)
