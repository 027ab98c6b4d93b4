"""Reports, shadow, drift, promotion, retention, sources and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterline import schemas
from meterline.config import DriftThresholds, Gateway, Backend, Route, Snapshot
from meterline.lineage import work_folder
from meterline.operators import drift, finops, governance, retention, shadow
from meterline.sources import logs as log_files
from meterline.sources import tables
from meterline.streaming import jobs
from meterline.streaming.runs import drain, read_files
from tests.test_datasets import log

SHADOW_NAMES = ("timestamp string, request_id string, task_id string, student_model string, "
                "path string, teacher_response_body string, student_http_status int, "
                "student_response_body string, student_latency_ms long")


def test_reports_on_null_latency_and_empty_log(spark):
    rows = log(spark, dict(latency_ms=None), dict(latency_ms=10), dict(latency_ms=20))
    assert finops.summary(rows).first()["avg_latency_ms"] == 15.0
    assert finops.dashboard_summary(rows).first()["avg_latency_ms"] == 10.0
    empty = finops.summary(rows.filter("false")).first()
    assert empty["requests"] == 0 and empty["p95_latency_ms"] is None
    assert finops.distillation_candidates(rows, min_requests=4).count() == 0


def test_errors_keep_missing_code_apart(spark):
    rows = log(spark, dict(status="error", error_code=None), dict(status="error", error_code="none"))
    got = finops.errors_by_code(rows).collect()
    assert [(r["error_code"], r["requests"]) for r in got] == [("none", 1), ("none", 1)]


def test_daily_trend_keeps_oldest_or_newest(spark):
    rows = log(spark, *[dict(timestamp=f"2024-01-0{d}T00:00:00Z") for d in (1, 2, 3)],
               dict(timestamp="short"))
    assert [r["day"] for r in finops.daily_trend(rows, 2).collect()] == ["2024-01-01", "2024-01-02"]
    assert [r["day"] for r in finops.daily_trend(rows, 2, newest=True).collect()] == \
        ["2024-01-02", "2024-01-03"]


def test_counters(spark):
    shadow_rows = spark.createDataFrame([], schemas.SHADOW_LOG)
    feedback = spark.createDataFrame([], schemas.FEEDBACK)
    got = {r["counter"]: r["value"] for r in
           finops.traffic_counters(log(spark, {}), shadow_rows, feedback).collect()}
    assert got == dict(total=1, teacher=1, student=0, fallback=0, rejected=0, rate_limited=0,
                       upstream_errors=0, shadow=0, shadow_errors=0, feedback=0)


def test_shadow_rows(spark):
    mail = '{"m":"alice@example.com"}'
    pairs = spark.createDataFrame([
        ("t", "r1", "k", "s", "/v1", mail, 200, mail, 5),
        ("t", "r2", "k", "s", "/v1", mail, 503, "x", 5),
        ("t", "r3", "k", "s", "/v1", mail, None, None, 5)], SHADOW_NAMES)
    rows = {r["request_id"]: r for r in shadow.shadow_log(pairs).collect()}
    assert rows["r1"]["response_exact_match"] is True and rows["r1"]["status"] == "success"
    assert "alice" not in rows["r1"]["teacher_response_redacted"]
    assert (rows["r2"]["error_code"], rows["r2"]["response_exact_match"]) == \
        ("shadow_http_status", False)
    assert (rows["r3"]["error_code"], rows["r3"]["response_exact_match"]) == \
        ("shadow_request_failed", None)


def feedback(spark, *rows):
    return spark.createDataFrame(
        [("2024-01-02T00:00:00Z", r, "c", t, rating, None, None) for r, t, rating in rows],
        schemas.FEEDBACK)


SNAPSHOT = Snapshot(3, "teacher_only", {
    "t": Route("canary", "s", 10), "u": Route("shadow", "s"), "v": Route("teacher_only")})


def test_drift_attribution_and_reasons(spark):
    student = dict(routing_decision="student", timestamp="2024-01-02T00:00:00Z")
    rows = [dict(student, request_id=f"r{i}", latency_ms=100 + i,
                 status="error" if i < 6 else "success") for i in range(20)]
    # The later row of an id counts: r0 went to the teacher in the end.
    rows.append(dict(request_id="r0", timestamp="2024-01-02T01:00:00Z"))
    rows.append(dict(student, request_id="old", timestamp="2023-12-01T00:00:00Z"))
    notes = feedback(spark, ("r1", "v", " Bad "), ("r0", "t", "bad"), ("unknown", "t", "wrong"),
                     ("unknown", "t", "wrong"), (None, "t", "good"), ("r2", None, "thumbs_down"),
                     ("x", "u", "bad"), ("x", None, "bad"))
    routes = SNAPSHOT.routes_df(spark)
    limits = DriftThresholds(max_error_rate=0.29, max_p95_latency_ms=118, min_feedback=5,
                             max_negative_feedback_rate=0.79)
    report = drift.drift_report(log(spark, *rows), notes, routes, "2024-01-03T00:00:00Z", 24,
                                limits)
    got = {r["task_id"]: r for r in report.collect()}
    assert set(got) == {"t", "u"}
    t = got["t"]
    assert (t["student_requests"], t["student_errors"], t["student_error_rate"]) == (20, 6, 0.3)
    assert t["student_p95_latency_ms"] == 118
    assert (t["feedback_total"], t["feedback_negative"]) == (5, 4)
    assert t["rollback_reasons"] == ["student_error_rate 0.3000 > 0.2900",
                                     "negative_feedback_rate 0.8000 > 0.7900"]
    assert got["u"]["feedback_total"] == 0 and got["u"]["rollback_reasons"] == []
    after = {r["task_id"]: r for r in drift.rollback_routes(routes, report, 4).collect()}
    assert after["t"]["mode"] == "teacher_only" and after["t"]["student_model"] is None
    assert after["u"]["mode"] == "shadow" and after["u"]["snapshot_version"] == 4
    event = drift.rollback_event(report, "now", 4, 24).first()
    assert event["task_id"] == "t" and json.loads(event["payload"])["window_hours"] == 24


def test_gate_and_promotion(spark):
    models = spark.createDataFrame(
        [("m1", "t", "offline_eval", 0.9, 0.8), ("m2", "u", "retired", 0.9, 0.9),
         ("m3", "v", "shadow", 0.5, 0.9), ("m4", "w", "canary", 0.9, None), ("m5", "x", None, 1.0, 1.0)],
        "model_id string, task_id string, status string, accuracy double, macro_f1 double")
    gated = governance.promotion_gate(models, 0.8, 0.7)
    reasons = {r["model_id"]: r["gate_reason"] for r in gated.collect()}
    assert reasons == {
        "m1": None, "m2": "model status 'retired' is not promotable",
        "m3": "model accuracy 0.5 is below threshold 0.8",
        "m4": "model macro_f1 0.0 is below threshold 0.7",
        "m5": "model status None is not promotable"}
    changed = governance.promotion_routes(gated, "bandit", probe_percentage=5)
    routes = {r["task_id"]: r for r in governance.replace_routes(
        SNAPSHOT.routes_df(spark), changed, 4).collect()}
    assert routes["t"]["mode"] == "bandit" and routes["t"]["student_model"] == "m1"
    assert routes["t"]["student_traffic_percentage"] is None
    assert routes["t"]["teacher_probe_percentage"] == 5 and len(routes) == 3
    with pytest.raises(ValueError):
        governance.promotion_routes(gated, "canary", canary_percentage=101)
    assert governance.routing_event(changed, "now", 4).first()["event"] == "routing_updated"
    assert governance.find_model(models, "m3").count() == 1


def test_retention(spark):
    lines = ['{"timestamp":"2023-01-01T00:00:00Z"}', '{"timestamp":"2024-03-01T00:00:00"}',
             "{broken", "", '{"timestamp":"soon"}', "[1]"]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    as_of = "2024-04-01T00:00:00Z"
    marked = retention.classify_lines(frame, as_of, 90)
    row = retention.retention_report(marked, []).first()
    assert row.asDict() == dict(total_lines=6, removed_lines=1, kept_lines=5,
                                invalid_lines_kept=1, missing_timestamp_kept=2)
    assert retention.retained(frame, as_of, 90).count() == 5


# --- sources ---------------------------------------------------------------------------------

def test_log_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"request_id":"r1","latency_ms":5}\n\n')
    (folder / "b.jsonl").write_text('{"request_id":"r2","task_id":"t"}\n{bad\n[1]\n')
    rows = log_files.read_request_log(spark, f"{folder}/a*.jsonl").collect()
    assert rows[0]["latency_ms"] == 5 and rows[0]["task_id"] is None
    good, bad = log_files.read_tolerant(spark, f"{folder}/*.jsonl", schemas.REQUEST_LOG)
    assert {r["request_id"] for r in good.collect()} == {"r1", "r2"}
    assert [(r["value"], r["file"].rsplit("/", 1)[1]) for r in bad.collect()] == [("{bad", "b.jsonl")]
    assert log_files.read_shadow_log(spark, f"{folder}/none*.jsonl").count() == 0
    with pytest.raises(Exception):
        log_files.read_strict(spark, f"{folder}/b.jsonl", schemas.CALL).collect()
    out = str(tmp_path / "out")
    for _ in range(2):
        log_files.append_log(log(spark, dict(request_id="z")), out)
    log_files.append_log(log(spark, {}), out, "disabled")
    assert log_files.read_request_log(spark, f"{out}/date=2024-01-01").count() == 2


def test_csv_and_labels(spark, tmp_path):
    (tmp_path / "b.csv").write_text('text,category\n" hi, ""you"" ",card\n,none\n"two\nlines",top\n')
    rows = tables.read_text_categories(spark, str(tmp_path / "b.csv"), "train", "demo").collect()
    assert [(r["request_id"], r["text"]) for r in rows] == \
        [("demo_train_0", 'hi, "you"'), ("demo_train_2", "two\nlines")]
    (tmp_path / "c.csv").write_text(
        "Date received,Product,Sub-product,Issue,Consumer complaint narrative,"
        "Company response to consumer,Complaint ID\n"
        "d,Debt,s,i,a long story,closed,77\nd,Debt,s,i,short,closed,78\nd,,s,i,a long story,c,79\n"
        "d,Loan,,,another story,c,\n")
    got = tables.read_complaints(spark, str(tmp_path / "c.csv"), min_chars=8).collect()
    assert [r["request_id"] for r in got] == ["cfpb_77", "cfpb_3"]
    assert tables.read_complaints(spark, str(tmp_path / "c.csv"), 1, 8).count() == 1
    (tmp_path / "l.json").write_text('[" a ", "b", "a", ""]')
    (tmp_path / "m.json").write_text('{"0": "x", "1": "y"}')
    (tmp_path / "n.json").write_text('{"labels": ["p"]}')

    def names(file, how):
        return {r["label"] for r in tables.read_labels(spark, str(tmp_path / file), how).collect()}

    assert names("l.json", "values") == {"a", "b"} and names("m.json", "values") == {"x", "y"}
    assert names("m.json", "keys") == {"0", "1"} and names("n.json", "labels") == {"p"}


def test_datasets_and_manifests(spark, tmp_path):
    from meterline.operators import dataset
    data = dataset.build_dataset(log(spark, *[dict(request_id=f"r{i}") for i in range(40)]))
    root = str(tmp_path / "data")
    assert tables.read_dataset(spark, root).count() == 0
    tables.write_dataset(data, root)
    assert tables.read_dataset(spark, root, "t").exceptAll(data).count() == 0
    manifest = dataset.manifest_documents(dataset.dataset_manifest(data), F.lit("ds_1"),
                                          "2020-01-01T00:00:00Z", "logs", "openai_content")
    tables.write_manifest(manifest, f"{tmp_path}/cat/t/ds_1")
    (tmp_path / "cat" / "t" / "ds_2").mkdir()
    (tmp_path / "cat" / "t" / "ds_2" / "manifest.json").write_text("{broken")
    (tmp_path / "cat" / "t" / "ds_3").mkdir()
    (tmp_path / "cat" / "t" / "ds_3" / "manifest.json").write_text('{"dataset_id": "ds_3"}')
    catalogue = tables.read_dataset_manifests(spark, f"{tmp_path}/cat")
    expired = {r["path"].rsplit("/", 1)[1]: r["expired"] for r in retention.dataset_retention(
        catalogue, "2024-04-01T00:00:00Z").collect()}
    assert expired == {"ds_1": True, "ds_2": False, "ds_3": False}
    assert catalogue.filter("dataset_id = 'ds_1'").first()["splits"]["train"] > 0
    tables.write_sft(dataset.sft_rows(data, ["a"], "Pick", "prompt"), f"{tmp_path}/sft")
    assert spark.read.json(f"{tmp_path}/sft").count() == 40
    assert tables.read_models(spark, f"{tmp_path}/none").count() == 0


def test_route_versions(spark, tmp_path):
    root = str(tmp_path / "routes")
    version, default, rows = tables.read_routes(spark, root)
    assert (version, default, rows.count()) == (0, "teacher_only", 0)
    assert tables.publish_routes(spark, SNAPSHOT.routes_df(spark), "shadow", root) == 1
    version, default, rows = tables.read_routes(spark, root)
    assert (version, default) == (1, "shadow")
    assert {r["task_id"] for r in rows.collect()} == {"t", "u", "v"}
    assert tables.publish_routes(spark, rows.filter("false"), "teacher_only", root) == 2
    assert tables.read_routes(spark, root)[:2] == (2, "teacher_only")
    doc = tmp_path / "snap.json"
    doc.write_text(tables.snapshot_document(SNAPSHOT.routes_df(spark), "teacher_only", 3))
    version, default, rows = tables.read_snapshot_file(spark, str(doc))
    assert (version, default) == (3, "teacher_only")
    assert rows.filter("mode = 'canary'").first()["student_traffic_percentage"] == 10


# --- streams ---------------------------------------------------------------------------------

GATEWAY = Gateway(Backend("teacher", 5.0, 15.0), (Backend("s", 0.05, 0.05),))


def stream_of(spark, tmp_path, frame, parts=3):
    path = str(tmp_path / "in")
    frame.repartition(parts).write.parquet(path)
    return read_files(spark, path, frame.schema, per_trigger=1)


def test_stream_equals_batch(spark, tmp_path):
    from tests.test_gateway import raw, raw_row
    frame = raw(spark, *[raw_row(request_id=f"r{i}", task_id="t", client_id=None if i % 5 == 0 else "c")
                         for i in range(60)])
    routes = SNAPSHOT.routes_df(spark)
    stream = stream_of(spark, tmp_path, frame)
    live = drain(jobs.enrich_stream(stream, routes, "teacher_only", GATEWAY), "t")
    batch = jobs.enrich_requests(frame, routes, "teacher_only", GATEWAY)
    assert live.exceptAll(batch).count() == 0 and live.count() == 60
    counters = drain(jobs.running_counters(
        jobs.enrich_stream(stream, routes, "teacher_only", GATEWAY)), "c", "complete")
    got = {r["counter"]: r["value"] for r in counters.collect()}
    assert got["total"] == 60 and got["rejected"] == 12
    assert got["teacher"] + got.get("student", 0) == 48


def test_route_reload_keeps_last_good_table(spark, tmp_path):
    from tests.test_gateway import raw, raw_row
    root = str(tmp_path / "routes")
    tables.publish_routes(spark, Snapshot(1, "teacher_only", {
        "t": Route("student_only", "s")}).routes_df(spark), "teacher_only", root)
    out = []
    reads = iter([lambda: tables.read_routes(spark, root), lambda: 1 / 0])
    body = jobs.enrich_with_reload(lambda: next(reads)(), GATEWAY,
                                   lambda rows, n: out.append(rows.first()["routing_decision"]))
    for n in range(2):
        body(raw(spark, raw_row(task_id="t")), n)
    assert out == ["student", "student"]


def test_dedupe_stream(spark, tmp_path):
    frame = log(spark, *[dict(request_id=f"r{i}", input_hash=f"h{i % 4}") for i in range(40)])
    got = drain(jobs.drop_repeats(stream_of(spark, tmp_path, frame)), "d")
    assert sorted(r["input_hash"] for r in got.collect()) == ["h0", "h1", "h2", "h3"]


def test_probe_pairs_need_an_answer_in_time(spark, tmp_path):
    probes = spark.createDataFrame(
        [("r1", datetime(2024, 1, 1, 0, 0)), ("r2", datetime(2024, 1, 1, 0, 0))],
        "request_id string, ts timestamp")
    answers = spark.createDataFrame(
        [("r1", datetime(2024, 1, 1, 0, 4)), ("r2", datetime(2024, 1, 1, 0, 6))],
        "request_id string, ts timestamp")
    (tmp_path / "p").mkdir(), (tmp_path / "a").mkdir()
    joined = jobs.pair_probe_streams(stream_of(spark, tmp_path / "p", probes, 1),
                                     stream_of(spark, tmp_path / "a", answers, 1))
    assert [r["request_id"] for r in drain(joined, "p").collect()] == ["r1"]


def test_work_folder_is_in_the_named_folder(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
