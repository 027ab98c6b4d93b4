import json
import re
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.functions import cost, labels, text

PLAIN_RULES = [
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[REDACTED_EMAIL]"),
    (r'(?i)("?(?:api[_-]?key|password|secret|token|authorization)"?\s*:\s*")([^"]*)(")',
     r"\1[REDACTED]\3"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{12,}\b", "sk-[REDACTED]"),
]


def plain_redact(value):
    for pattern, replacement in PLAIN_RULES:
        value = re.sub(pattern, replacement, value, flags=re.ASCII)
    return value


def test_redact_literals(column):
    line = ('{"email":"alice@example.com","password":"p w","Api_Key" : "k","h":"Bearer abc.def"} '
            'sk-testSECRET123456')
    expected = ('{"email":"[REDACTED_EMAIL]","password":"[REDACTED]","Api_Key" : "[REDACTED]",'
                '"h":"Bearer [REDACTED]"} sk-[REDACTED]')
    assert column(text.redact, [line, "nothing here", "", None]) == \
        [expected, "nothing here", "", None]
    assert column(lambda c: text.redact(text.redact(c)), [line]) == [expected]


PIECES = st.sampled_from([
    "a@b.com", "@", "x", ".", "1", "_", " ", "Bearer ", "bearer\t", "sk-", "abcdefghijkl", "-",
    '"token":"', '"', "password: \"", "API-KEY", ":", "user.name+tag@host.example.org", "\n"])


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=20, max_size=60))
def test_redact_equals_plain_patterns(column, values):
    assert column(text.redact, values) == [plain_redact(v) for v in values]


def test_long_run_without_address(column):
    run = "a1" * 100_000
    assert column(text.redact, [run + "@" + run + " x@y.org"]) == \
        [run + "@" + run + " [REDACTED_EMAIL]"]


def test_strip_and_squeeze(column):
    values = ["  a\t b \n", " x y　", "", "\x1cq\x1f"]
    assert column(text.strip, values) == [v.strip() for v in values]
    assert column(text.squeeze, values) == [" ".join(v.split()) for v in values]


def test_slugs(column):
    assert column(text.slugify, ["Checking & Savings", "--A  b--", "&"]) == \
        ["checking_and_savings", "a_b", "and"]
    assert column(text.canonical, ["Checking & Savings"]) == ["checking_savings"]


def test_parse_timestamp(column):
    values = ["2024-01-01", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.123456789+02:00",
              "2024-01-01 10:00:00", "2024-01-01T10:00:00-0500", "x", "", None]
    got = column(lambda c: F.unix_micros(text.parse_timestamp(c)), values)

    def micros(*args):
        return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000

    assert got == [micros(2024, 1, 1), micros(2024, 1, 1, 10), micros(2024, 1, 1, 8) + 123456,
                   micros(2024, 1, 1, 10), micros(2024, 1, 1, 15), None, None, None]


TARGETS = [
    ('{"choices":[{"message":{"content":"x"}}]}', "x", "x"),
    ('{"choices":[{"message":{"content":null},"text":" t "}]}', " t ", "t"),
    ('{"choices":[{"message":{"content":{"a":1}}}]}', '{"a":1}', None),
    ('{"choices":[{"message":{"content":7},"text":"t"}]}', "7", "t"),
    ("not json", "not json", None),
    ('{"choices":[]}', '{"choices":[]}', None),
    ('"scalar"', '"scalar"', None),
    ('{"choices":[{"text":""}]}', "", ""),
    ("", "", None),
]


def test_completion_target_and_label(column):
    bodies = [b for b, _, _ in TARGETS]
    assert column(text.completion_target, bodies) == [t for _, t, _ in TARGETS]
    assert column(text.completion_label, bodies) == [label for _, _, label in TARGETS]


def test_chat_inputs(column):
    chat = json.dumps({"messages": [
        {"role": "system", "content": "s"}, {"role": "user", "content": "one"},
        {"role": "assistant", "content": "a"}, {"role": "user", "content": " two "}]})
    none = json.dumps({"messages": [{"role": "system", "content": "s"}]})
    bodies = [chat, none, "plain", '{"a":1}']
    assert column(text.user_content, bodies) == ["one\n two ", none, "plain", '{"a":1}']
    assert column(text.last_user_content, bodies) == ["two", None, None, None]
    assert column(text.last_user_content, ['{"prompt":" p ","messages":[]}']) == ["p"]
    assert column(lambda c: text.chat_input(c, True), bodies[:2]) == ["one\n two ", ""]
    assert column(text.chat_input, bodies[:1]) == ["s\none\na\n two "]
    assert column(text.infer_input, ['{"input":"","prompt":"p"}', '{"text":"t"}', '{"z":1}']) == \
        ["p", "t", '{"z":1}']
    assert column(text.completion_input, ['{"prompt":"p"}', '{"z":1}', "raw"]) == ["p", "", "raw"]
    assert column(lambda c: text.input_text(c, "raw", 3), ["abcdef"]) == ["abc"]


def test_prompts(column):
    got = column(lambda c: text.label_prompt(" Pick. ", ["a", "b"], c), ["hi"])
    assert got == ["Pick.\nReturn exactly one label from the allowed list. Do not explain.\n\n"
                   "Allowed labels:\n- a\n- b\n\nText:\nhi\n\nLabel:"]
    got = column(lambda c: text.complaint_text(c, F.lit("i"), F.lit("")), ["n"])
    assert got == ["Consumer complaint narrative:\nn\n\nReported issue: i"]
    got = column(lambda c: text.complaint_text(c, F.lit(None).cast("string"), F.lit("s")), ["n"])
    assert got == ["Consumer complaint narrative:\nn\nReported sub-product: s"]


def test_tokens_cost_rounding(spark):
    row = spark.range(1).select(
        *[cost.estimate_tokens(F.lit(n)).alias(f"t{n}") for n in (0, 1, 4, 5)],
        cost.cost_usd(F.lit(1000), F.lit(200), F.lit(5.0), F.lit(15.0)).alias("c"),
        cost.savings_usd(F.lit(1.0), F.lit(3.0)).alias("s"),
        cost.round_half_up(F.lit(1.005), 2).alias("r"),
        cost.round_half_up(F.lit(-2.5), 0).alias("neg"),
        cost.content_hash(F.lit(""), F.lit("POST /x"), "redacted").alias("h"),
        cost.content_hash(F.lit("b"), F.lit("POST /x"), "metadata_only").alias("none"),
    ).first()
    assert [row["t0"], row["t1"], row["t4"], row["t5"]] == [0, 1, 1, 2]
    assert row["c"] == pytest.approx(0.008) and row["s"] == 0.0
    assert row["r"] == 1.0 and row["neg"] == -3.0
    assert row["h"].startswith("sha256:") and len(row["h"]) == 71 and row["none"] is None


def test_hash_bucket_is_uniform(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("req_"), F.col("id").cast("string")).alias("r"))
    shares = ids.select((cost.hash_bucket(F.col("r"), "split:") < 70).cast("int").alias("t"),
                        (cost.hash_bucket(F.col("r"), "route:") < 25).cast("int").alias("c")) \
        .agg(F.avg("t").alias("t"), F.avg("c").alias("c"),
             F.avg(F.col("t") * F.col("c")).alias("both")).first()
    assert abs(shares["t"] - 0.70) < 0.02 and abs(shares["c"] - 0.25) < 0.02
    assert abs(shares["both"] - 0.175) < 0.02


INTENTS = ["card_arrival", "getting_virtual_card", "lost card?", "top-up", "wait_time"]


def test_normalize_label(column):
    outputs = ["card_arrival", ' "card_arrival" ', "I think get_virtual_card fits",
               "the wait_time then card_arrival", "none", "<think>card_arrival</think>wait_time"]
    assert column(lambda c: labels.normalize_label(c, INTENTS), outputs) == [
        "card_arrival", "card_arrival", "getting_virtual_card", "wait_time", None, "card_arrival"]
    assert column(lambda c: labels.normalize_label(c, INTENTS, True), outputs[5:]) == ["wait_time"]


def test_normalize_label_canonical(column):
    outputs = ["Card Arrival.", "it is TOP-UP!", "my lost-card case", "is it top_up or wait_time",
               "zzz", "<think>wait_time</think> lost card?"]
    assert column(lambda c: labels.normalize_label_canonical(c, INTENTS), outputs) == [
        "card_arrival", "top-up", "lost card?", "top-up", None, "lost card?"]


def test_best_label_by_words(column):
    names = ["credit_card", "debt collection", "mortgage", "student loan"]
    texts = ["they call about a debt", "my mortg payment", "collections and students", "nothing"]
    got = column(lambda c: labels.best_label_by_words(F.lit("?"), c, names), texts)
    assert got == ["debt collection", "mortgage", "debt collection", "credit_card"]


def test_secret_after_any_space(column):
    got = column(text.redact, ['{"password"\u00a0: "hunter2"}', '{"password" : "hunter2"}'])
    assert all("hunter2" not in x for x in got)


def test_odd_chat_elements(column):
    bodies = ['{"messages":["x",{"role":"user","content":"hi"}]}',
              '{"messages":[1,null,{"role":"user","content":"a"},{"role":"system","content":"s"},{"role":"user","content":"b"}]}']
    assert column(text.user_content, bodies) == ["hi", "a\nb"]
    last = ['{"prompt":5,"messages":[{"role":"user","content":"hi"}]}', '{"prompt":" p "}',
            '{"messages":[{"role":"user","content":"hi"},{"role":"user","content":{"a":1}}]}', '{"messages":["x"]}', "x"]
    assert column(text.last_user_content, last) == ["hi", "p", "hi", None, None]
