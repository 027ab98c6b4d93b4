"""Datasets, augmentation, sampling, labels, scores, neighbours, students."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline import schemas
from meterline.operators import (
    dataset, evaluate, knn, labelling, ranking, sampling, students, synthetic)
from meterline.operators import governance
from meterline.operators.synthetic import TEMPLATES
from meterline.schemas import DATASET_COLUMNS

LOG_DEFAULTS = dict(
    timestamp="2024-01-01T00:00:00Z", request_id="r", client_id="c", task_id="t",
    cost_center=None, quality_mode=None, input_hash=None, prompt_redacted="p",
    response_redacted='{"choices":[{"message":{"content":"a"}}]}', teacher_model="teacher",
    selected_model="teacher", routing_decision="teacher", routing_reason="x", latency_ms=1,
    input_tokens=1, output_tokens=1, estimated_cost_usd=1.0, estimated_teacher_cost_usd=1.0,
    estimated_savings_usd=0.0, status="success", http_status=200, error_code=None,
    pii_level=None, training_eligible=True)


def log(spark, *rows):
    names = schemas.REQUEST_LOG.fieldNames()
    return spark.createDataFrame(
        [tuple((LOG_DEFAULTS | r)[n] for n in names) for r in rows], schemas.REQUEST_LOG)


def test_eligibility_and_newest_copy(spark):
    rows = [
        dict(request_id="old", input_hash="h"),
        dict(request_id="new", input_hash="h", timestamp="2024-01-02T00:00:00Z"),
        dict(request_id="err", input_hash="e", status="error"),
        dict(request_id="inel", input_hash="i", training_eligible=None),
        dict(request_id="nop", input_hash="n", prompt_redacted=None),
        dict(request_id="nohash"),
        # The newest copy has an empty answer: the key is gone, not served by the older copy.
        dict(request_id="e1", input_hash="k"),
        dict(request_id="e2", input_hash="k", timestamp="2024-01-03T00:00:00Z",
             response_redacted='{"choices":[{"message":{"content":""}}]}'),
        dict(request_id="other", input_hash="h", task_id="u"),
    ]
    got = dataset.build_dataset(log(spark, *rows))
    assert {r["request_id"] for r in got.collect()} == {"new", "nohash", "other"}
    assert {r["request_id"] for r in dataset.build_dataset(
        log(spark, *rows), min_samples=2).collect()} == {"new", "nohash"}
    raw = dataset.build_dataset(log(spark, *rows), "u", "response_redacted").first()
    assert raw["teacher_output"] == LOG_DEFAULTS["response_redacted"]
    assert got.columns == schemas.DATASET_COLUMNS


def test_split_shares_and_manifest(spark):
    rows = log(spark, *[dict(request_id=f"r{i}") for i in range(3000)])
    first = dataset.build_dataset(rows).persist()
    m = dataset.dataset_manifest(first).first()
    assert m["samples"] == 3000
    assert abs(m["train_samples"] / 3000 - 0.70) < 0.03
    assert abs(m["validation_samples"] / 3000 - 0.15) < 0.03
    again = dataset.build_dataset(rows.repartition(7))
    assert again.select("request_id", "split").exceptAll(
        first.select("request_id", "split")).count() == 0


def plain_augment(rows, multiplier, max_ratio):
    """Row by row, as stated by the operator."""
    target = min(len(rows) * multiplier, int(len(rows) * max_ratio / (1 - max_ratio)))
    seen = {r["input"] for r in rows}
    out = []
    for v in range(multiplier):
        before, after = TEMPLATES[v % len(TEMPLATES)]
        for r in sorted(rows, key=lambda r: (r["timestamp"], r["request_id"])):
            if len(out) >= target:
                return out
            squeezed = " ".join(r["input"].split())
            made = before + squeezed + after if squeezed else ""
            if made and made not in seen:
                seen.add(made)
                out.append((r["request_id"], v, made))
    return out


@pytest.mark.parametrize("multiplier, ratio", [(2, 0.8), (6, 0.79), (3, 0.5), (0, 0.5), (2, 0.0)])
def test_augmentation_equals_row_by_row(spark, multiplier, ratio):
    rng = random.Random(multiplier)
    inputs = [f"text  {rng.randrange(60)}" for _ in range(90)] + ["   ", TEMPLATES[0][0] + "text 1"]
    rows = [dict(request_id=f"r{i:03d}", prompt_redacted=t, input_hash=f"h{i}",
                 timestamp=f"2024-01-01T00:{rng.randrange(3):02d}:00Z")
            for i, t in enumerate(inputs)]
    data = dataset.build_dataset(log(spark, *rows)).withColumn("split", F.lit("train"))
    made = synthetic.synthetic_rows(data, "now", multiplier, ratio)
    got = {(r["synthetic_parent_request_id"], int(r["request_id"][-1]), r["input"])
           for r in made.collect()}
    expected = plain_augment([dict(r, input=r["prompt_redacted"]) for r in rows], multiplier, ratio)
    assert got == set(expected) and len(expected) == made.count()
    if multiplier == 2 and ratio:
        share = synthetic.synthetic_manifest(synthetic.augment(
            data, "now", multiplier=2, max_ratio=ratio)).first()
        assert share["synthetic_ratio"] <= ratio and share["real_samples"] == len(rows)
    assert synthetic.synthetic_rows(data, "now", min_confidence=1.1).count() == 0


def test_sft_records(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "hi"}]})
    data = dataset.build_dataset(log(spark, dict(prompt_redacted=body)))
    prompt = dataset.sft_rows(data, ["a", "b"], "Pick", "prompt").first()
    assert prompt["prompt"].endswith("- a\n- b\n\nText:\nhi\n\nLabel:")
    assert prompt["completion"] == "a"
    messages = dataset.sft_rows(data, ["a"], "Pick").first()["messages"]
    assert [m["role"] for m in messages] == ["user", "assistant"]


def plain_round_robin(rows, limit):
    if limit <= 0 or limit >= len(rows):
        return {r[0] for r in rows}
    queues = defaultdict(list)
    for r in sorted(rows):
        queues[r[1]].append(r[0])
    taken = []
    while len(taken) < limit:
        for label in sorted(queues):
            if queues[label] and len(taken) < limit:
                taken.append(queues[label].pop(0))
    return set(taken)


@pytest.mark.parametrize("limit", [0, 1, 4, 17, 60, 200, 399, 400])
def test_balanced_sample(spark, limit):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abcd"), f"r{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "position long, label string, request_id string")
    got = sampling.balanced_sample(frame, "label", "position", limit)
    assert {r["position"] for r in got.collect()} == plain_round_robin(rows, limit)


def test_train_and_eval_samples_are_disjoint(spark):
    frame = spark.range(60).select(
        F.col("id").alias("position"), F.concat(F.lit("l"), F.col("id") % 3).alias("label"),
        F.col("id").cast("string").alias("request_id"))
    train, evaluation = sampling.sample_train_and_eval(frame, "label", "position", 20, 10)
    a, b = ({r["request_id"] for r in f.collect()} for f in (train, evaluation))
    assert len(a) == 20 and len(b) == 10 and not a & b


def test_first_n_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", i // 10, f"r{i:05d}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, p long, id string") \
        .withColumn("quota", F.when(F.col("k") == "hot", 700))
    slices = ranking.quantile_slices(frame, F.col("p"))
    got = ranking.mark_first_n(frame, ["k"], ["p", "id"], slices, "quota", "in")
    kept = {r["id"] for r in got.filter("in and k = 'hot'").collect()}
    hot = sorted((p, i) for k, p, i in rows if k == "hot")
    assert kept == {i for _, i in hot[:700]}
    assert got.filter("in and k = 'cold'").count() == 1000


def test_unique_slugs(spark):
    names = ["A & B", "a and b", "A-and-B", "a and b 2", "x", "A & B"]
    got = {r["product"]: r["slug"] for r in labelling.unique_slugs(
        spark.createDataFrame([(n,) for n in names], "product string")).collect()}
    expected, used = {}, set()
    for name in sorted(set(names)):
        base = "x" if name == "x" else "a_and_b_2" if name.endswith("2") else "a_and_b"
        slug, n = base, 2
        while slug in used:
            slug, n = f"{base}_{n}", n + 1
        used.add(slug)
        expected[name] = slug
    assert got == expected


def test_label_table_form_equals_list_form(spark):
    from meterline.functions.labels import normalize_label
    outputs = spark.createDataFrame(
        [(1, "say get_virtual_card or wait"), (2, "wait"), (3, "zz"), (4, " 'wait' ")],
        "id int, out string")
    names = ["getting_virtual_card", "wait"]
    table = spark.createDataFrame([(n,) for n in names], "label string")
    joined = labelling.normalize_by_join(outputs, "id", "out", table).select("id", "label")
    listed = outputs.select("id", normalize_label(F.col("out"), names).alias("label"))
    assert sorted(joined.collect()) == sorted(listed.collect())


def test_three_thousand_labels(spark):
    """No operator over labels stops at a number of labels."""
    rows = spark.range(3000).selectExpr(
        "'t' as task_id", "concat('r', id) as request_id", "'train' as split", "concat('in ', id) as input",
        "concat('label_', id) as validated_output")
    prompts = dataset.sft_rows(rows, None, "Pick", "prompt", "raw")
    assert prompts.count() == 3000 and prompts.first()["prompt"].count("\n- label_") == 3000
    labels = labelling.distinct_labels(rows, "validated_output")
    budget = evaluate.token_budget(rows.selectExpr("input as text"), labels, 100).first()
    assert budget["labels"] == 3000
    outputs = rows.selectExpr("request_id", "validated_output as out")
    named = labelling.normalize_by_join(outputs, "request_id", "out", labels)
    assert named.filter("label = out").count() == 3000


def test_prompts_list_the_labels_of_their_task(spark):
    rows = spark.createDataFrame(
        [("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z")], "task_id string, request_id string, validated_output string"
    ).selectExpr("*", "'train' as split", "'text' as input")
    got = {r["request_id"]: r["prompt"] for r in dataset.sft_rows(rows, None, "Pick", "prompt").collect()}
    assert "- x\n- y\n" in got["1"] and "- z" not in got["1"] and "- z\n" in got["3"]


def test_newest_copy_is_by_instant(spark):
    """Digits of a second and offsets do not decide which copy is newer."""
    log = [("2024-01-01T00:00:00Z", "old"), ("2024-01-01T00:00:00.500Z", "new"),
           ("2024-01-02T00:30:00Z", "late"), ("2024-01-02T01:00:00+02:00", "early")]
    rows = [(t, n, "t", "success", True, f"h{i // 2}", "in", n, 0.0, 0.0) for i, (t, n) in enumerate(log)]
    frame = spark.createDataFrame(rows, "timestamp string, request_id string, task_id string, status string, "
        "training_eligible boolean, input_hash string, prompt_redacted string, response_redacted string, "
        "estimated_teacher_cost_usd double, estimated_savings_usd double")
    for c in DATASET_COLUMNS:
        if c not in frame.columns and c not in ("input", "teacher_output", "validated_output", "split"):
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    got = dataset.build_dataset(frame)
    assert sorted(r["teacher_output"] for r in got.collect()) == ["late", "new"]
    span = dataset.dataset_manifest(got).first()
    assert (span["min_timestamp"], span["max_timestamp"]) == ("2024-01-01T00:00:00.500Z", "2024-01-02T00:30:00Z")


def test_one_route_per_task(spark):
    models = spark.createDataFrame(
        [("t", "m1", 0.9, 0.5, "2024-01-01", True), ("t", "m2", 0.9, 0.6, "2024-01-01", True),
         ("t", "m3", 0.99, 0.6, "2024-01-01", False), ("u", "m4", None, None, None, True)],
        "task_id string, model_id string, accuracy double, macro_f1 double, created_at string, promotable boolean")
    routes = governance.promotion_routes(models, "canary", 10).collect()
    assert sorted((r["task_id"], r["student_model"]) for r in routes) == [("t", "m2"), ("u", "m4")]


def test_request_selection(spark):
    requests = spark.createDataFrame([(f"r{i}",) for i in range(5)], "request_id string")
    calls = spark.createDataFrame(
        [("r0", "success", 500), ("r1", "error", 200), ("r2", "error", 500), ("r3", None, None)],
        "request_id string, status string, http_status int")
    got = labelling.skip_existing(requests, calls, limit=2)
    assert [r["request_id"] for r in got.orderBy("request_id").collect()] == ["r2", "r3"]


def test_complaints(spark):
    rows = spark.createDataFrame(
        [("r1", "Debt", "long story", "issue", ""), ("r2", "Other", "x", "", "sub")],
        "request_id string, product string, narrative string, issue string, sub_product string")
    allowed = spark.createDataFrame([(" debt ",)], "label string")
    got = labelling.prepare_complaints(rows, allowed).collect()
    assert [(r["request_id"], r["expected_intent"]) for r in got] == [("r1", "debt")]
    labelled = labelling.label_outputs(
        spark.createDataFrame([("??", "my debt")], "o string, t string"), "o", "t",
        ["card", "debt"])
    assert labelled.first()["label"] == "debt"


def test_scores(spark):
    def body(content):
        return json.dumps({"choices": [{"message": {"content": content}}]})

    calls = spark.createDataFrame(
        [("a", body(" a ")), ("a", body("b")), ("b", body("")), ("b", "broken"), ("b", body("b"))],
        "expected_intent string, response_body string")
    row = evaluate.evaluate_calls(calls).first()
    assert (row["calls"], row["correct"], row["invalid"], row["accuracy"]) == (5, 2, 2, 0.4)
    assert evaluate.evaluate_calls(calls.filter("false")).first()["accuracy"] == 0.0
    scored = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "d")], "y string, p string")
    m = evaluate.classification_metrics(scored, "y", "p").first()
    assert m["accuracy"] == pytest.approx(0.4) and m["labels"] == 4
    # a: 2/(2+1+2), b: 2/(2+1), c: 0, d: 0
    assert m["macro_f1"] == pytest.approx((2 / 5 + 2 / 3) / 4)
    b = evaluate.token_budget(
        spark.createDataFrame([("abcd",), ("é" * 7,)], "text string"), spark.createDataFrame([("x",), ("yy",)], "label string"), 100).first()
    assert b["estimated_prompt_tokens"] == (11 + 2 * 8) // 4
    assert b["estimated_requests_for_budget"] == int(100 / (6 / 2))


def plain_knn(queries, refs, k):
    out = {}
    for qid, q in queries:
        scored = sorted(((-float(q @ v), rid, label) for rid, v, label in refs))[:k]
        votes, best = Counter(), defaultdict(float)
        for s, _, label in scored:
            votes[label] += 1
            best[label] = max(best[label], -s)
        out[qid] = min(votes, key=lambda x: (-votes[x], -best[x], x)), [r for _, r, _ in scored]
    return out


@pytest.mark.parametrize("clusters", [1, 6])
def test_neighbours_equal_all_pairs(spark, monkeypatch, clusters):
    """Small tiles, a cell with most references, many equal vectors."""
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "QUERY_PART_ROWS", 20)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 8)) * 3

    def unit(n):
        v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 8))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    vectors = unit(240)
    vectors[:80] = vectors[0]
    refs = [(i, v, f"l{i % 4}") for i, v in enumerate(vectors)]
    queries = [(i, v) for i, v in enumerate(unit(60))]
    ref_frame = spark.createDataFrame(
        [(i, v.tolist(), label) for i, v, label in refs],
        "ref_id long, ref_vector array<double>, ref_label string")
    query_frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in queries], "query_id long, query_vector array<double>")
    expected = plain_knn(queries, refs, 5)
    near = knn.nearest_references(query_frame, ref_frame, 5)
    got = defaultdict(list)
    for r in near.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["ref_id"])
    assert got == {q: ids for q, (_, ids) in expected.items()}
    labels = {r["query_id"]: r["label"] for r in knn.vote(near).collect()}
    assert labels == {q: label for q, (label, _) in expected.items()}


def words(spark, n):
    rng = random.Random(5)
    topics = {"card": "card plastic chip pin", "loan": "loan rate interest month",
              "debt": "collector owe notice call"}
    rows = []
    for i in range(n):
        label = rng.choice(list(topics))
        text = " ".join(rng.choices(topics[label].split() + ["please", "help"], k=8))
        vector = [float(label == t) + rng.gauss(0, 0.1) for t in topics]
        rows.append((text, vector, label))
    return spark.createDataFrame(rows, "text string, embedding array<double>, label string")


@pytest.mark.parametrize("spec", [
    students.StudentSpec("tfidf_logistic", max_iter=40),
    students.StudentSpec("tfidf_mlp", hidden=(8,), max_iter=40),
    students.StudentSpec("embedding_logistic", max_iter=40),
    students.StudentSpec("hybrid_mlp", hidden=(8,), max_iter=40),
])
def test_students_learn(spark, spec):
    train, evaluation = words(spark, 150), words(spark, 60)
    student, scored = students.train_and_score(train, evaluation, spec)
    m = evaluate.classification_metrics(scored, "label", "prediction").first()
    assert m["accuracy"] > 0.9
    low = scored.agg(F.min("confidence").alias("c")).first()["c"]
    assert 1 / 3 <= low <= 1.0


def test_baseline_when_one_label(spark):
    train = words(spark, 40).filter("label = 'card'")
    row = students.student_report(train, words(spark, 30)).first()
    assert row["student_kind"] == "most_frequent" and 0 < row["accuracy"] < 1


def test_fit_and_eval_rows(spark):
    rows = spark.createDataFrame([("test", 1), ("test", 2)], "split string, x int")
    train, evaluation = dataset.training_and_eval_rows(rows)
    assert train.count() == 2 and evaluation.count() == 2
