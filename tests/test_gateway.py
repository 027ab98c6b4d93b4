"""Metadata, routes, quotas and log rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline import schemas
from meterline.config import Backend, Gateway, Limits, Route, Snapshot
from meterline.operators import enrich, ratelimit, routing
from meterline.streaming.limiter import STATE, limit_batch

GATEWAY = Gateway(Backend("teacher", 5.0, 15.0), (Backend("local_student", 0.05, 0.05),))


def raw_row(**fields):
    base = dict(
        timestamp="2024-01-01T00:00:00Z", request_id="r", client_id="crm_backend",
        task_id="email", cost_center=None, quality_mode="balanced", pii_level="low",
        no_train=False, request_summary="POST /v1/chat/completions", request_body="b",
        response_body="a", request_bytes=64, response_bytes=16, http_status=200,
        proxy_error=False, student_connect_error=False, latency_ms=10)
    return base | fields


def raw(spark, *rows):
    names = schemas.RAW_REQUEST.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.RAW_REQUEST)


def decide(spark, route=None, gateway=GATEWAY, **fields):
    snapshot = Snapshot(1, "teacher_only", {"email": route} if route else {})
    row = routing.decide_with_snapshot(raw(spark, raw_row(**fields)), snapshot, gateway).first()
    return row["routing_decision"], row["routing_reason"], row["shadow_model"]


def test_metadata(spark):
    headers = {"x-task-id": " email_classification_v1 ", "x-client-id": "crm_backend",
               "x-no-train": "TRUE", "x-cost-center": "  "}
    row = routing.extract_metadata(
        spark.createDataFrame([(headers,)], "headers map<string,string>")).first()
    assert row["task_id"] == "email_classification_v1" and row["client_id"] == "crm_backend"
    assert row["no_train"] is True and row["cost_center"] is None and len(row["request_id"]) == 36


@pytest.mark.parametrize("route, fields, expected", [
    (None, {}, ("teacher", "default_teacher_only", None)),
    (None, {"client_id": None}, ("reject", "missing_client_id", None)),
    (Route("student_only", "local_student"), {}, ("student", "student_only", None)),
    (Route("student_only", "local_student"), {"quality_mode": "strict"},
     ("teacher", "quality_mode_strict", None)),
    (Route("teacher_only"), {}, ("teacher", "teacher_only", None)),
    (Route("shadow", "local_student"), {}, ("teacher", "shadow_teacher", "local_student")),
    (Route("shadow"), {}, ("teacher", "shadow_student_unavailable_teacher_fallback", None)),
    (Route("shadow", "gone"), {}, ("teacher", "shadow_teacher", None)),
    (Route("bandit", "local_student", None, 0), {}, ("student", "bandit_student", None)),
    (Route("bandit", "local_student", None, 100), {}, ("teacher", "bandit_teacher_probe", None)),
    (Route("canary", "local_student", 100), {}, ("student", "canary_student", None)),
    (Route("canary", "local_student"), {}, ("teacher", "canary_teacher", None)),
    (Route("student_only"), {}, ("teacher", "student_unavailable_teacher_fallback", None)),
    (Route("student_only", "gone"), {},
     ("teacher", "student_backend_missing_teacher_fallback", None)),
    (Route("student_only", "local_student"), {"student_connect_error": True},
     ("teacher", "student_connect_error_teacher_fallback", None)),
])
def test_routes(spark, route, fields, expected):
    assert decide(spark, route, **fields) == expected


def test_missing_task(spark):
    assert decide(spark, task_id=" ")[:2] == ("teacher", "default_teacher_only")
    strict = Gateway(GATEWAY.teacher, GATEWAY.students, missing_task="reject")
    assert decide(spark, gateway=strict, task_id=None)[:2] == ("reject", "missing_task_id")


def enriched(spark, row, gateway=GATEWAY, limits=None):
    frame = raw(spark, row)
    if limits:
        frame = frame.withColumn("ts", F.to_timestamp("timestamp"))
    return enrich.enrich_requests(
        frame, Snapshot().routes_df(spark), "teacher_only", gateway, limits).first()


def test_log_row(spark):
    body = '{"email":"alice@example.com","password":"secret"}'
    row = enriched(spark, raw_row(request_body=body,
                                  response_body='{"result":"ok","token":"abc"}'))
    assert row["training_eligible"] and "[REDACTED_EMAIL]" in row["prompt_redacted"]
    assert "alice" not in row["prompt_redacted"] and '"secret"' not in row["prompt_redacted"]
    assert '"abc"' not in row["response_redacted"]
    assert (row["input_tokens"], row["output_tokens"]) == (16, 4)
    assert row["estimated_cost_usd"] == pytest.approx(16 / 1e6 * 5 + 4 / 1e6 * 15)
    assert row["estimated_savings_usd"] == 0.0 and row["status"] == "success"


def test_log_modes(spark):
    row = enriched(spark, raw_row(), Gateway(GATEWAY.teacher, log_mode="metadata_only"))
    assert row["input_hash"] is None and row["prompt_redacted"] is None
    assert row["response_redacted"] is None and row["training_eligible"] is False
    assert enriched(spark, raw_row(), Gateway(GATEWAY.teacher, log_mode="disabled")) is None
    capped = enriched(spark, raw_row(request_body="abcdef"),
                      Gateway(GATEWAY.teacher, max_capture_bytes=3))
    assert capped["prompt_redacted"] == "abc" and capped["input_tokens"] == 16


def test_binary_bodies(spark):
    frame = raw(spark, raw_row()).withColumn("request_body", F.unhex(F.lit("61FF62"))) \
        .withColumn("response_body", F.unhex(F.lit("")))
    row = enrich.enrich_requests(
        frame, Snapshot().routes_df(spark), "teacher_only", GATEWAY).first()
    assert row["prompt_redacted"] == "a�b" and row["response_redacted"] is None


def test_rejected_rows_cost_nothing(spark):
    row = enriched(spark, raw_row(client_id=None))
    assert (row["task_id"], row["http_status"], row["status"]) == ("unknown_task", 400, "error")
    assert row["error_code"] == "missing_client_id" and row["selected_model"] == "none"
    assert row["input_tokens"] == 0 and row["estimated_teacher_cost_usd"] == 0.0
    limited = enriched(spark, raw_row(), limits=Limits(default_per_window=0))
    assert (limited["task_id"], limited["http_status"]) == ("email", 429)
    assert limited["error_code"] == "rate_limited_client"


def test_error_codes(spark):
    assert enriched(spark, raw_row(proxy_error=True, http_status=0))["error_code"] == "proxy_error"
    row = enriched(spark, raw_row(http_status=500))
    assert row["error_code"] == "default_teacher_only" and row["training_eligible"] is False
    assert enriched(spark, raw_row(pii_level="high"))["training_eligible"] is False
    assert enriched(spark, raw_row(pii_level=None))["training_eligible"] is True


def test_feedback_intake(spark):
    posts = spark.createDataFrame([
        ("t", " c ", None, '{"request_id":" r ","rating":5,"correct_output":"alice@example.com",'
                           '"comment":"token sk-testSECRET123456"}'),
        ("t", "c", "k", "{broken")], "timestamp string, client_id string, task_id string, body string")
    good, bad = enrich.clean_feedback(posts)
    row = good.first()
    assert (row["request_id"], row["rating"], row["client_id"]) == ("r", None, "c")
    assert row["correct_output_redacted"] == "[REDACTED_EMAIL]"
    assert row["comment_redacted"] == "token sk-[REDACTED]"
    assert bad.count() == 1


# --- quotas ----------------------------------------------------------------------------------

def requests(n, seed, hot=0.4):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        client = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        task = rng.choice(["email", "chat", None])
        # Many requests share an instant.
        ts = start + timedelta(milliseconds=rng.randrange(0, 4000) // 7 * 7)
        rows.append((f"r{i:05d}", ts, client, task))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(
        rows, "request_id string, ts timestamp, client_id string, task_id string") \
        .repartition(5)


def two_stage(rows, limits, window_of):
    """Count requests one by one: the client stage over all, then the task stage."""
    outcome = {}
    for stage, pick in (("client", 2), ("task", 3)):
        counts = defaultdict(int)
        starts = {}
        for row in sorted(rows, key=lambda r: (r[1], r[0])):
            if outcome.get(row[0]) or row[2] is None or row[pick] is None:
                continue
            key = row[pick]
            quota = limits.clients.get(key, limits.default_per_window) if stage == "client" \
                else limits.tasks.get(key)
            if quota is None:
                continue
            window = window_of(key, row[1], starts)
            if counts[key, window] >= quota:
                outcome[row[0]] = f"rate_limited_{stage}"
            else:
                counts[key, window] += 1
    return {r[0]: outcome.get(r[0]) for r in rows}


LIMITS = Limits(window_ms=1000, default_per_window=40, clients={"a": 3, "hot": 150},
                tasks={"email": 30})


def test_aligned_quota_equals_counting(spark):
    rows = requests(1500, 1)
    epoch = datetime(1970, 1, 1)

    def aligned(key, ts, starts):
        return int((ts - epoch) / timedelta(milliseconds=1000))

    got = ratelimit.apply_limits(frame_of(spark, rows), LIMITS)
    assert {r["request_id"]: r["limit_reason"] for r in got.collect()} == \
        two_stage(rows, LIMITS, aligned)


def test_anchored_quota_over_batches_equals_counting(spark):
    rows = sorted(requests(1200, 2), key=lambda r: (r[1], r[0]))

    def anchored(key, ts, starts):
        if key not in starts or ts - starts[key] >= timedelta(milliseconds=1000):
            starts[key] = ts
        return starts[key]

    third = [rows[0][1] + timedelta(milliseconds=ms) for ms in (1337, 2604)]
    batches = [[r for r in rows if r[1] < third[0]],
               [r for r in rows if third[0] <= r[1] < third[1]],
               [r for r in rows if r[1] >= third[1]]]
    state, got = spark.createDataFrame([], STATE), {}
    for batch in batches:
        decided, state = limit_batch(frame_of(spark, batch), state, LIMITS)
        got |= {r["request_id"]: r["limit_reason"] for r in decided.collect()}
    assert got == two_stage(rows, LIMITS, anchored)


@pytest.mark.parametrize("limits, rows, expected", [
    (Limits(enabled=False, default_per_window=0), [("1", "crm", "email")], [None]),
    (Limits(default_per_window=1), [("1", "crm", "x"), ("2", "crm", "x")],
     [None, "rate_limited_client"]),
    (Limits(tasks={"email": 1}), [("1", "crm", "email"), ("2", "other", "email")],
     [None, "rate_limited_task"]),
    (Limits(default_per_window=0), [("1", None, "email")], [None]),
])
def test_quota_literals(spark, limits, rows, expected):
    ts = datetime(2024, 1, 1)
    frame = frame_of(spark, [(i, ts, c, t) for i, c, t in rows])
    got = ratelimit.apply_limits(frame, limits).orderBy("request_id").collect()
    assert [r["limit_reason"] for r in got] == expected
