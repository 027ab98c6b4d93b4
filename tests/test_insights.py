"""Decisions over logs and datasets: literal cases, and brute force where there is a plain version."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from meterline.functions import text
from meterline.operators import answers, confidence, groups, insights, prompts, repeats, versions


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=lambda t: [(x is not None, x) for x in t])


# --- conflicts, splits, balance ----------------------------------------------------------------

def test_conflicts_know_null_labels_and_inputs(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "x"), (6, "c", None),
         (7, None, "x"), (8, None, "y"), (9, "d", None), (10, "d", None), (11, "", "x")], "i int, t string, l string")
    kept = insights.without_conflicts(rows, F.col("t"), "l")
    assert [i for i, in rows_of(kept, "i")] == [1, 2, 7, 8, 9, 10, 11] and kept.columns == rows.columns
    assert insights.without_conflicts(rows.limit(0), F.col("t"), "l").count() == 0


def test_group_split_falls_back_on_the_row(spark):
    rows = spark.createDataFrame([(f"r{i}", "g" if i < 50 else None) for i in range(400)] + [(None, None)],
                                 "i string, g string")
    got = rows.select("i", "g", insights.group_split(F.col("g"), F.col("i")).alias("s")).collect()
    assert len({r.s for r in got if r.g}) == 1
    alone = [r.s for r in got if r.g is None and r.i]
    assert set(alone) == {"train", "validation", "test"} and 0.6 < alone.count("train") / len(alone) < 0.8
    assert [r.s for r in got if r.i is None] == [None]


def test_label_balance(spark):
    rows = spark.createDataFrame([("t", "a")] * 9 + [("t", "b"), ("t", None), ("u", "a"), (None, "a")], "k string, l string")
    assert rows_of(insights.label_balance(rows.where("k is not null"), ["k"], "l", 0.2),
                   "k", "labelled", "labels", "balance_ratio", "balanced") == [
        ("t", 10, 2, 0.1, False), ("u", 1, 1, 1.0, True)]


def brute_components(rows):
    seen, out = {}, {}
    for i, *_ in rows:
        if i is None or i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            at = todo.pop()
            mine = [r for r in rows if r[0] == at]
            for j, *keys in rows:
                if j is not None and j not in seen and any(
                        a is not None and a == b for m in mine for a, b in zip(m[1:], keys)):
                    seen[j] = i
                    todo.append(j)
    for i, root in seen.items():
        out.setdefault(root, []).append(i)
    return {i: min(ids) for ids in out.values() for i in ids}


def test_leak_free_split(spark):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *[f"k{i}" for i in range(n)]])
    rows = [(f"r{i:03}", pick(200), pick(150), f"t{i % 170}" if i % 3 else None) for i in range(260)]
    rows += [(f"z{i:03}", f"chain{i}", f"chain{i + 1}", None) for i in range(60)]          # not linked: other keys
    rows += [(f"y{i:03}", f"c{i // 2}", f"d{(i + 1) // 2}", None) for i in range(60)]     # one long chain
    rows += [(rows[0][0], "k1", None, None), (None, "k1", "k1", "t1")]
    frame = spark.createDataFrame(rows, "id string, c string, v string, t string")
    got = groups.leak_free_split(frame, "id", [F.col(c) for c in "cvt"]).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and all(r.component == want.get(r.id) for r in got)
    assert all(len({r.split for r in got if r.component == c}) == 1 for c in want.values())
    assert [r.split for r in got if r.id is None] == [None]
    assert groups.linked_rows(frame.limit(0), "id", [F.col("c")]).count() == 0


# --- versions ----------------------------------------------------------------------------------

VERSION = "task_id string, id string, a string, b string"


def test_version_tells_rows_apart(spark):
    hashed = lambda *rows: rows_of(versions.dataset_version(
        spark.createDataFrame(rows, VERSION), ["id", "a", "b"]), "task_id", "rows", "content_hash")
    cases = [("t", "1", "a|b", "c"), ("t", "1", "a", "b|c"), ("t", "1", "a", None), ("t", "1", "a", ""),
             ("t", "1", None, "a"), ("t", "1", "-", "a"), ("t", "1", "2:a", "1:a"), ("t", None, "1", "a")]
    assert len({hashed(c)[0][2] for c in cases}) == len(cases)
    assert hashed(*cases) == hashed(*cases[::-1]) != hashed(*cases, cases[0])
    assert len(hashed(*cases, (None, "1", "a", "b"))) == 2
    assert versions.dataset_version(spark.createDataFrame([], VERSION), ["id"]).count() == 0


def test_version_changes(spark):
    rng = random.Random(4)
    old = [(f"t{i % 2}" if i % 40 else None, f"k{i}", rng.choice("xyz"), None) for i in range(400)]
    old += [("t0", "twice", "a", "b"), ("t0", "twice", "a", "b"), ("t1", None, "a", None), ("t1", "same", "", None)]
    new = [(t, k, "changed" if k == "k7" else a, b) for t, k, a, b in old if k not in ("k8", "twice")]
    new += [("t0", "twice", "a", "b"), ("t0", "fresh", "a", "b"), ("t9", "k7", None, None)]
    new[-4] = ("t1", "same", None, "")  # two fields that look alike when null is ''
    frames = [spark.createDataFrame(x, VERSION).repartition(3) for x in (old, new)]
    changes = versions.version_changes(*frames, ["id"], ["a", "b"])
    x, y = ({k: sorted(repr(r[2:]) for r in rows if r[:2] == k) for k in {r[:2] for r in rows}}
            for rows in (old, new))
    want = {(*k, "added" if k not in x else "removed" if k not in y else "changed")
            for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert {(r.task_id, r.id, r.change) for r in changes.collect()} == want
    tree = [versions.version_tree(f, ["id"], ["a", "b"]) for f in frames]
    assert versions.changed_buckets(*tree).count() < tree[0].where("level = 2").count() / 4
    assert versions.version_changes(frames[0], frames[0], ["id"], ["a", "b"]).count() == 0


# --- structured answers ------------------------------------------------------------------------

def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            plain = k.isidentifier() and k.isascii()
            yield from leaves(v, f"{path}.{k}" if plain else f'{path}."{k}"')
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else json.dumps(value)


def parsed(doc):
    try:
        return dict(leaves(json.loads(doc)))
    except (TypeError, ValueError):
        return None


def test_json_scores(spark):
    full = {"a": 1, "b": {"c": [1, {"d": "x"}], "e": None, "odd key": True}, "f": [], "g": {}}
    docs = [full, full | {"a": 1.0}, full | {"a": 2}, full | {"b": {}}, full | {"f": [[]]}, {}, [1, 2], "text", 5, None]
    texts = [json.dumps(d) for d in docs] + ['{"a": 1', "", None, '{"b":{"e":null,"odd key":true,"c":[1,{"d":"x"}]},"a":1,"g":{},"f":[]}']
    pairs = [(i, e, p) for i, (e, p) in enumerate(itertools.product([json.dumps(full), "[]", "broken", None], texts))]
    frame = spark.createDataFrame(pairs, "id int, e string, p string")
    want, exact, valid = {}, 0, 0
    for _, e, p in pairs:
        x, y = parsed(e) or {}, parsed(p) or {}
        valid += parsed(p) is not None
        exact += parsed(e) is not None and parsed(p) is not None and x == y
        for path in x.keys() | y.keys():
            n = want.setdefault(path, [0, 0, 0])
            n[0] += path in x
            n[1] += path in y
            n[2] += path in x and path in y and x[path] == y[path]
    got = answers.field_accuracy(frame, ["id"], "e", "p")
    assert {r.path: [r.expected, r.predicted, r.matches] for r in got.collect()} == want
    report = answers.json_report(frame, ["id"], "e", "p").first()
    assert (report.answers, report.valid_json, report.exact_matches) == (len(pairs), valid, exact)
    assert (report.fields, report.right_fields) == (sum(v[0] for v in want.values()), sum(v[2] for v in want.values()))
    assert answers.field_accuracy(frame.limit(0), ["id"], "e", "p").count() == 0


def test_regression_scores(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 5.0, 4.0), ("a", None, 1.0), ("a", 1.0, None),
                                  ("b", 2.0, 1.0), ("b", 2.0, 2.0), ("a", math.nan, 1.0)], "k string, y double, p double")
    got = {r.k: r for r in answers.regression_scores(rows, "y", "p", ["k"]).collect()}
    assert (got["a"].samples, got["a"].missing) == (3, 3) and got["a"].mae == pytest.approx(2 / 3)
    assert got["a"].rmse == pytest.approx(math.sqrt(2 / 3)) and got["a"].r2 == pytest.approx(1 - 2 / 8)
    assert got["b"].r2 is None


# --- confidence --------------------------------------------------------------------------------

def test_confidence_limits(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.random(), 2), None) for k in "abc" for _ in range(300)]
    rows = [(k, c, rng.random() < {"a": c, "b": 0.3, "c": 0.6 + c / 3}[k]) for k, c, _ in rows]
    rows += [("a", None, True), ("a", 1.5, True), ("a", math.nan, True), ("a", 1.0, None), ("one", 0.5, True)]
    frame = spark.createDataFrame(rows, "k string, c double, ok boolean")
    got = {r.k: r for r in confidence.confidence_limits(frame, ["k"], "c", F.col("ok"), 0.2, 100).collect()}
    for key in ("a", "b", "c", "one"):
        bins = {}
        for k, c, ok in rows:
            if k == key and c is not None and 0 <= c <= 1:
                n = bins.setdefault(math.floor(c * 100 + 1e-9), [0, 0])
                n[0], n[1] = n[0] + 1, n[1] + bool(ok)
        at = sorted(bins)
        mean = lambda i, j: sum(bins[b][1] for b in at[i:j + 1]) / sum(bins[b][0] for b in at[i:j + 1])
        fit = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
        risk = lambda k: sum(bins[b][0] * (1 - f) for b, f in zip(at[k:], fit[k:])) / sum(bins[b][0] for b in at[k:])
        good = [k for k in range(len(at)) if round(risk(k), 10) <= 0.2]
        assert got[key].answers == sum(n for n, _ in bins.values())
        assert got[key].min_confidence == (at[good[0]] / 100 if good else None)
        assert got[key].risk == (pytest.approx(risk(good[0]), abs=1e-9) if good else None)
    policy = spark.createDataFrame([("t", "a", None), ("t", "b", None), ("t", "c", "too slow"), ("t", "new", None)],
                                   "task_id string, selected_model string, reason string")
    limits = spark.createDataFrame([("t", r.k, r.min_confidence, r.coverage) for r in got.values()],
                                   "task_id string, selected_model string, min_confidence double, coverage double")
    routed = {r.selected_model: (r.reason, r.decision) for r in confidence.confident_routes(policy, limits).collect()}
    assert routed["a"] == (None, "student") and routed["c"] == ("too slow", "teacher_only")
    assert routed["b"] == routed["new"] == ("no safe confidence", "teacher_only")
    assert confidence.confidence_limits(frame.limit(0), ["k"], "c", F.col("ok"), 0.2).count() == 0


# --- prompts and repeats -----------------------------------------------------------------------

def test_prompt_drift(spark):
    rng = random.Random(8)
    words = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    one, two = ([f"{p}{i}" for i in range(40)] for p in "ab")
    rows = [(f"s{i}", "same", words(30, one), i % 5 < 2) for i in range(300)]
    rows += [(f"d{i}", "drift", words(30, one if i % 5 < 2 else one[:30] + two[:4]), i % 5 < 2) for i in range(300)]
    rows += [(f"o{i}", "one side", words(30, one), True) for i in range(30)]
    rows += [("n1", "same", None, True), (None, "same", "", True), ("n2", "same", "x", None), ("n3", None, "x y", True)]
    frame = spark.createDataFrame(rows, "id string, task string, text string, later boolean")
    got = {r.task: r for r in prompts.prompt_drift(frame.where("task is not null"), ["task"], "id", "text", F.col("later")).collect()}
    assert got["drift"].drifted and got["drift"].p_value == 0.01 and got["drift"].l1 > got["same"].l1
    assert not got["same"].drifted and got["same"].p_value > 0.05 and (got["same"].before, got["same"].after) == (180, 121)
    assert got["one side"].p_value is None and not got["one side"].drifted
    assert prompts.prompt_drift(frame.limit(0), ["task"], "id", "text", F.col("later")).count() == 0


def test_equal_splits_raise_no_alarm(spark):
    rng = random.Random(9)
    rows = [(f"{t}-{i}", f"t{t}", " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(20)), rng.random() < 0.3)
            for t in range(30) for i in range(60)]
    frame = spark.createDataFrame(rows, "id string, task string, text string, later boolean")
    p = sorted(r.p_value for r in prompts.prompt_drift(frame, ["task"], "id", "text", F.col("later")).collect())
    assert len(p) == 30 and sum(x <= 0.01 for x in p) <= 2 and 0.25 < sum(p) / 30 < 0.75


def near_by_brute(texts, similarity):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return {i for i, a in enumerate(sets) for j, b in enumerate(sets)
            if i != j and a and b and len(a & b) / len(a | b) >= similarity}


def test_near_repeats(spark):
    """Everything found is right, and at least nine in ten are found (here: all)."""
    rng = random.Random(10)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = [make(rng.randrange(1, 150)) for _ in range(120)]
    for base in texts[:60]:
        for edits in (1, 2, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(copy)
    hot = make(200)
    texts += [hot[:i % 150] + [f"e{i}"] + hot[i % 150 + 1:] for i in range(80)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "one two", "long " * 20_000]
    frame = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)] + [("u", "x", texts[0])],
                                  "task string, id string, text string")
    want = {str(i) for i in near_by_brute(texts, 0.8)}
    got = {r.id for r in repeats.near_repeats(frame, "task", "id", "text").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    assert repeats.near_repeats(frame.limit(0), "task", "id", "text").count() == 0


def test_near_repetitive_tasks(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [("t", "h1", long_), ("t", "h1", long_), ("t", "h2", long_ + " end"), ("t", "h3", "other words here"),
            ("t", None, long_), ("u", "h1", long_), ("u", "h4", None), (None, "h1", long_)]
    frame = spark.createDataFrame(rows, "task_id string, input_hash string, prompt_redacted string")
    got = {r.task_id: (r.requests, r.inputs, r.near_inputs, r.repeated_requests, r.repetitive)
           for r in repeats.near_repetitive_tasks(frame).collect()}
    assert got == {"t": (4, 3, 2, 3, True), "u": (2, 2, 0, 0, False), None: (1, 1, 0, 0, False)}


# --- teacher samples ---------------------------------------------------------------------------

def test_sampled_requests(spark):
    logs = [("t", f"2024-01-0{d}T01:00:00Z", f"r{d}-{i}") for d in range(1, 5) for i in range(200)]
    logs += [("u", "2024-01-01T00:00:00Z", f"u{i}") for i in range(4)] + [("t", "2024-01-01T00:00:00Z", None)]
    shadow = [("t", "2024-01-02T00:00:00Z", i % 4 > 0) for i in range(40)] + [("t", "2024-01-01T00:00:00Z", None)]
    log = spark.createDataFrame(logs, "task_id string, timestamp string, request_id string")
    compared = spark.createDataFrame(shadow, "task_id string, timestamp string, response_exact_match boolean")
    quotas = insights.sampling_quotas(log, compared, 0.1, 6, 30, 0.2)
    got = {(r.task_id, r.day): (r.divergence, r.raised, r.quota) for r in quotas.collect()}
    assert got == {("t", "2024-01-01"): (0.0, False, 21), ("t", "2024-01-02"): (0.0, False, 20),
                   ("t", "2024-01-03"): (0.25, True, 30), ("t", "2024-01-04"): (0.0, False, 20),
                   ("u", "2024-01-01"): (0.0, False, 4)}
    first = rows_of(insights.sampled_requests(log, quotas), "task_id", "day", "request_id")
    again = rows_of(insights.sampled_requests(log.repartition(7), quotas), "task_id", "day", "request_id")
    assert first == again and len(set(first)) == 21 + 20 + 30 + 20 + 4
    larger = insights.sampling_quotas(log, compared, 0.2, 6, 80, 0.2)
    assert set(first) <= set(rows_of(insights.sampled_requests(log, larger), "task_id", "day", "request_id"))


# --- chat input --------------------------------------------------------------------------------

def test_chat_input_skips_what_is_no_message(column):
    bodies = ['{"messages":["x",{"role":"user","content":"hi"}]}', '{"messages":[null,3,["y"],{"role":"system"}]}',
              '{"messages":["{\\"content\\":\\"inner\\"}",{"role":"user","content":"a"},{"content":"b"}]}',
              '{"messages":[]}', "no json", None]
    assert column(text.chat_input, bodies) == ["hi", "", "a\nb", "", "no json", None]
    assert column(lambda c: text.chat_input(c, True), bodies[:3]) == ["hi", "", "a"]
