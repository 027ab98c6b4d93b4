"""Explicit schemas of the tables the engine reads and writes.

Log files are always read with these, never inferred: a column that no file holds
becomes a NULL column, and a scan only decodes the columns a query uses.
"""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


REQUEST_LOG = _struct(
    ("timestamp", S), ("request_id", S), ("client_id", S), ("task_id", S), ("cost_center", S),
    ("quality_mode", S), ("input_hash", S), ("prompt_redacted", S), ("response_redacted", S),
    ("teacher_model", S), ("selected_model", S), ("routing_decision", S), ("routing_reason", S),
    ("latency_ms", L), ("input_tokens", L), ("output_tokens", L), ("estimated_cost_usd", D),
    ("estimated_teacher_cost_usd", D), ("estimated_savings_usd", D), ("status", S),
    ("http_status", I), ("error_code", S), ("pii_level", S), ("training_eligible", B),
)

RAW_REQUEST = _struct(
    ("timestamp", S), ("request_id", S), ("client_id", S), ("task_id", S), ("cost_center", S),
    ("quality_mode", S), ("pii_level", S), ("no_train", B), ("request_summary", S),
    ("request_body", S), ("response_body", S), ("request_bytes", L), ("response_bytes", L),
    ("http_status", I), ("proxy_error", B), ("student_connect_error", B), ("latency_ms", L),
)

SHADOW_LOG = _struct(
    ("timestamp", S), ("request_id", S), ("task_id", S), ("student_model", S), ("path", S),
    ("latency_ms", L), ("http_status", I), ("status", S), ("error_code", S),
    ("teacher_response_redacted", S), ("student_response_redacted", S),
    ("response_exact_match", B),
)

FEEDBACK = _struct(
    ("timestamp", S), ("request_id", S), ("client_id", S), ("task_id", S), ("rating", S),
    ("correct_output_redacted", S), ("comment_redacted", S),
)

ROUTE = _struct(
    ("mode", S), ("student_model", S), ("student_traffic_percentage", I),
    ("teacher_probe_percentage", I),
)
ROUTE_ROW = _struct(("task_id", S), *[(f.name, f.dataType) for f in ROUTE.fields])
SNAPSHOT = _struct(("version", L), ("default_mode", S), ("tasks", T.MapType(S, ROUTE)))

BACKEND = _struct(
    ("name", S), ("is_teacher", B), ("input_cost_per_million_tokens_usd", D),
    ("output_cost_per_million_tokens_usd", D),
)

DATASET_COLUMNS = [
    "task_id", "input", "teacher_output", "validated_output", "split", "request_id", "client_id",
    "cost_center", "timestamp", "teacher_model", "selected_model", "routing_decision",
    "routing_reason", "input_hash", "input_tokens", "output_tokens", "estimated_cost_usd",
    "estimated_teacher_cost_usd", "estimated_savings_usd",
]
SYNTHETIC_COLUMNS = [
    "is_synthetic", "synthetic_parent_request_id", "synthetic_method", "synthetic_confidence",
]

LABELLED_REQUEST = _struct(
    ("request_id", S), ("split", S), ("text", S), ("expected_intent", S), ("complaint_id", S),
    ("product", S), ("issue", S), ("sub_product", S), ("date_received", S),
    ("company_response", S), ("narrative", S),
)
CALL = _struct(
    ("request_id", S), ("split", S), ("text", S), ("expected_intent", S), ("http_status", I),
    ("latency_ms", L), ("response_body", S), ("predicted_intent", S),
)
REFERENCE = _struct(("text", S), ("expected_intent", S), ("embedding", T.ArrayType(D)))

MODEL_MANIFEST = _struct(
    ("model_id", S), ("task_id", S), ("base_model", S), ("dataset_id", S), ("status", S),
    ("created_at", S), ("artifact", S), ("runtime", S),
    ("metrics", _struct(("accuracy", D), ("macro_f1", D))), ("input_format", S),
    ("max_input_chars", I), ("embedding_max_seq_length", I),
    ("training", _struct(("train_samples", L), ("eval_samples", L), ("unique_labels", L))),
)
DATASET_MANIFEST = _struct(
    ("dataset_id", S), ("task_id", S), ("created_at", S), ("source_logs", S), ("format", S),
    ("samples", L),
    ("splits", _struct(("train", L), ("validation", L), ("test", L))),
    ("time_range", _struct(("min_timestamp", S), ("max_timestamp", S))),
    ("teacher_cost_usd", D), ("estimated_savings_usd", D),
    ("filters", _struct(
        ("status", S), ("training_eligible", B), ("required_fields", T.ArrayType(S)),
        ("target_field", S), ("dedupe_key", S), ("split_strategy", S))),
)
REGISTRY_EVENT = _struct(
    ("timestamp", S), ("event", S), ("task_id", S), ("mode", S), ("snapshot_version", L),
    ("payload", S),
)
