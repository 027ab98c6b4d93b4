"""The registered queries in SQL, over the same tables.

Each text starts from the given tables; the shared parts state the derived log tables
(`plans/derive.py`) in SQL.
"""

from __future__ import annotations

import re

# Values that the SQL states on its own, so that a wrong one in the code under test shows.
STOP_TOKENS = {
    "and", "consumer", "credit", "loan", "other", "personal", "product", "reported", "reporting",
    "reports", "service", "services",
}
NEGATIVE_RATINGS = ("bad", "incorrect", "wrong", "negative", "thumbs_down", "0", "1")
TEMPLATES = (
    ("Message utilisateur:\n", ""),
    ("Demande reformulee sans changer l'intention:\n", ""),
    ("", "\n\nRepondre pour la meme intention."),
    ("Contexte: requete client.\n", ""),
)
TASK_DESCRIPTION = "Name the language of the text."
CODES = ("de", "en", "es", "fr")
SAMPLE_LIMIT = 150
BUDGET = 1_000_000
GATE_ACCURACY, GATE_MACRO_F1 = 0.74, 0.55
MAX_ERROR_RATE, MAX_NEGATIVE_RATE = 0.21, 0.306
CREATED_AT = "2024-02-01T00:00:00Z"


def canonical_text(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", value.lower()).strip("_")


STAMP = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def q(text: str) -> str:
    """SQL string literal; line breaks are spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def bucket(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || {key}), 1, 8))::BIGINT % 100)"


def redacted(x: str) -> str:
    mail = rf"regexp_replace({x}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}', " \
        "'[REDACTED_EMAIL]', 'g')"
    field = rf"""regexp_replace({mail}, '(?i)("?(?:api[_-]?key|password|secret|token|authorization)"?\s*:\s*")([^"]*)(")', '\1[REDACTED]\3', 'g')"""
    bearer = rf"regexp_replace({field}, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', " \
        "'Bearer [REDACTED]', 'g')"
    return rf"regexp_replace({bearer}, '\bsk-[A-Za-z0-9_-]{{12,}}\b', 'sk-[REDACTED]', 'g')"


RAW = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
raw AS (
  SELECT strftime(ts, {STAMP}) AS timestamp, ts, 'req_' || event_id AS request_id,
    CASE WHEN k <> 99 THEN 'client_' || (user_id % 20) END AS client_id,
    CASE WHEN k <> 98 THEN 'task_' || (user_id % 6) END AS task_id,
    CASE WHEN user_id % 4 <> 3 THEN 'cc_' || (user_id % 4) END AS cost_center,
    CASE WHEN k % 10 = 0 THEN 'strict' ELSE 'balanced' END AS quality_mode,
    CASE WHEN k % 13 = 0 THEN 'high' ELSE 'low' END AS pii_level,
    k % 11 = 0 AS no_train, 'POST /v1/chat/completions' AS request_summary,
    props AS request_body, event_type AS response_body,
    200 + 37 * k AS request_bytes, 40 + 11 * k AS response_bytes,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
    event_type = 'error' AND k % 4 = 0 AS proxy_error, k % 17 = 5 AS student_connect_error,
    CAST(floor(value * 10) AS BIGINT) AS latency_ms, k, event_type, value, event_id
  FROM ev)"""

ROUTES = """
routes(task_id, mode, student_model, canary_pct, probe_pct) AS (VALUES
  ('task_0', 'teacher_only', NULL, NULL, NULL),
  ('task_1', 'canary', 'local_student', 25, NULL),
  ('task_2', 'student_only', 'local_student', NULL, NULL),
  ('task_3', 'bandit', 'local_student', NULL, 10),
  ('task_4', 'shadow', 'local_student', NULL, NULL))"""


def routed_over(source: str) -> str:
    """Route outcome of the rows of `source`, which has a column limit_reason."""
    hit = bucket("r.request_id", "route:")
    return f"""
wanted AS (
  SELECT r.*, coalesce(t.mode, 'teacher_only') AS mode, t.mode IS NOT NULL AS has_route,
    t.student_model, coalesce(r.task_id, 'unknown_task') AS route_task,
    CASE WHEN t.mode = 'student_only' THEN 'student_only'
         WHEN t.mode = 'canary' AND {hit} < coalesce(t.canary_pct, 0) THEN 'canary_student'
         WHEN t.mode = 'bandit' AND {hit} >= coalesce(t.probe_pct, 2) THEN 'bandit_student'
    END AS wants
  FROM {source} r LEFT JOIN routes t ON t.task_id = coalesce(r.task_id, 'unknown_task')),
routed AS (
  SELECT *,
    CASE WHEN limit_reason IS NOT NULL THEN 429 WHEN client_id IS NULL THEN 400 END AS reject,
    CASE WHEN limit_reason IS NOT NULL THEN limit_reason
         WHEN client_id IS NULL THEN 'missing_client_id'
         WHEN quality_mode = 'strict' THEN 'quality_mode_strict'
         WHEN wants IS NOT NULL AND student_connect_error
           THEN 'student_connect_error_teacher_fallback'
         WHEN wants IS NOT NULL THEN wants
         WHEN mode = 'shadow' THEN 'shadow_teacher' WHEN mode = 'canary' THEN 'canary_teacher'
         WHEN mode = 'bandit' THEN 'bandit_teacher_probe'
         WHEN has_route THEN 'teacher_only' ELSE 'default_teacher_only' END AS routing_reason,
    CASE WHEN limit_reason IS NOT NULL OR client_id IS NULL THEN 'reject'
         WHEN quality_mode <> 'strict' AND wants IS NOT NULL AND NOT student_connect_error
           THEN 'student' ELSE 'teacher' END AS routing_decision,
    CASE WHEN limit_reason IS NOT NULL THEN coalesce(task_id, 'unknown_task')
         WHEN client_id IS NULL THEN 'unknown_task' ELSE route_task END AS log_task
  FROM wanted)"""


LOG = f"""
sized AS (
  SELECT *, coalesce(reject, http_status) AS status_code,
    CASE WHEN reject IS NULL THEN (request_bytes + 3) // 4 ELSE 0 END AS tin,
    CASE WHEN reject IS NULL THEN (response_bytes + 3) // 4 ELSE 0 END AS tout
  FROM routed),
request_log AS (
  SELECT timestamp, request_id, client_id, log_task AS task_id, cost_center, quality_mode,
    'sha256:' || sha256(CASE WHEN reject IS NULL AND request_body <> '' THEN request_body
                             ELSE request_summary END) AS input_hash,
    CASE WHEN reject IS NULL AND request_body <> '' THEN {redacted('request_body')} END
      AS prompt_redacted,
    CASE WHEN reject IS NULL AND response_body <> '' THEN {redacted('response_body')} END
      AS response_redacted,
    'teacher' AS teacher_model,
    CASE routing_decision WHEN 'reject' THEN 'none' WHEN 'student' THEN 'local_student'
      ELSE 'teacher' END AS selected_model,
    routing_decision, routing_reason, latency_ms, CAST(tin AS BIGINT) AS input_tokens,
    CAST(tout AS BIGINT) AS output_tokens,
    CASE WHEN routing_decision = 'student'
      THEN tin::DOUBLE / 1e6::DOUBLE * 0.05::DOUBLE + tout::DOUBLE / 1e6::DOUBLE * 0.05::DOUBLE
      ELSE tin::DOUBLE / 1e6::DOUBLE * 5::DOUBLE + tout::DOUBLE / 1e6::DOUBLE * 15::DOUBLE
      END AS estimated_cost_usd,
    tin::DOUBLE / 1e6::DOUBLE * 5::DOUBLE + tout::DOUBLE / 1e6::DOUBLE * 15::DOUBLE
      AS estimated_teacher_cost_usd,
    greatest(estimated_teacher_cost_usd - estimated_cost_usd, 0::DOUBLE) AS estimated_savings_usd,
    CASE WHEN NOT proxy_error AND status_code < 400 THEN 'success' ELSE 'error' END AS status,
    CAST(status_code AS INTEGER) AS http_status,
    CASE WHEN proxy_error THEN 'proxy_error' WHEN status_code >= 400 THEN routing_reason END
      AS error_code,
    pii_level, status_code < 400 AND NOT no_train AND pii_level IS DISTINCT FROM 'high'
      AS training_eligible
  FROM sized)"""

OPEN = "open_raw AS (SELECT *, NULL::VARCHAR AS limit_reason FROM raw)"
LIMITED = """
client_ranked AS (
  SELECT *, CASE client_id WHEN 'client_3' THEN 30 ELSE 12 END AS client_limit,
    row_number() OVER (PARTITION BY client_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS crn
  FROM raw),
client_checked AS (
  SELECT *, client_id IS NOT NULL AND crn > client_limit AS over_client FROM client_ranked),
task_ranked AS (
  SELECT *, row_number() OVER (
      PARTITION BY task_id, CAST(ts AS DATE), client_id IS NOT NULL AND NOT over_client
      ORDER BY ts, request_id) AS trn
  FROM client_checked),
limited AS (
  SELECT * EXCLUDE (client_limit, crn, over_client, trn),
    CASE WHEN over_client THEN 'rate_limited_client'
         WHEN client_id IS NOT NULL AND task_id = 'task_2' AND trn > 40 THEN 'rate_limited_task'
    END AS limit_reason
  FROM task_ranked)"""

ANCHORED = """
timed AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM raw),
client_starts AS (
  SELECT client_id, min(ms) AS started FROM timed WHERE client_id IS NOT NULL GROUP BY client_id
  UNION ALL
  SELECT t.client_id, min(t.ms) FROM client_starts s JOIN timed t
    ON t.client_id = s.client_id AND t.ms >= s.started + 86400000
  GROUP BY t.client_id, s.started),
client_ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.client_id, s.started ORDER BY ts, request_id)
    > CASE t.client_id WHEN 'client_3' THEN 30 ELSE 12 END AS over_client
  FROM timed t ASOF JOIN client_starts s ON t.client_id = s.client_id AND t.ms >= s.started),
task_asked AS (SELECT * FROM client_ranked WHERE NOT over_client AND task_id = 'task_2'),
task_starts AS (
  SELECT task_id, min(ms) AS started FROM task_asked GROUP BY task_id
  UNION ALL
  SELECT t.task_id, min(t.ms) FROM task_starts s JOIN task_asked t
    ON t.task_id = s.task_id AND t.ms >= s.started + 86400000
  GROUP BY t.task_id, s.started),
task_ranked AS (
  SELECT request_id, row_number() OVER (
    PARTITION BY t.task_id, s.started ORDER BY ts, request_id) > 40 AS over_task
  FROM task_asked t ASOF JOIN task_starts s ON t.task_id = s.task_id AND t.ms >= s.started)"""

SHADOW = f"""
probes AS (
  SELECT timestamp, request_id, log_task AS task_id, student_model,
    '/v1/chat/completions' AS path, response_body AS teacher_body, k, event_type, value
  FROM routed
  WHERE mode = 'shadow' AND reject IS NULL AND quality_mode <> 'strict' AND NOT proxy_error
    AND http_status < 500),
answered AS (
  SELECT *, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 5 = 0 THEN 503 ELSE 200 END AS code,
    CASE WHEN k % 7 = 0 THEN event_type || '?' ELSE event_type END AS student_body
  FROM probes),
shadow_log AS (
  SELECT timestamp, request_id, task_id, student_model, path,
    CAST(floor(value * 3) AS BIGINT) AS latency_ms, CAST(code AS INTEGER) AS http_status,
    CASE WHEN code < 400 THEN 'success' ELSE 'error' END AS status,
    CASE WHEN code IS NULL THEN 'shadow_request_failed'
         WHEN code >= 400 THEN 'shadow_http_status' END AS error_code,
    {redacted('teacher_body')} AS teacher_response_redacted,
    CASE WHEN code IS NOT NULL THEN {redacted('student_body')} END AS student_response_redacted,
    teacher_response_redacted = student_response_redacted AS response_exact_match
  FROM answered)"""

FEEDBACK = """
feedback AS (
  SELECT timestamp, CASE WHEN k = 14 THEN 'lost_' || request_id ELSE request_id END AS request_id,
    client_id, task_id,
    CASE WHEN http_status = 500 THEN ' Bad ' WHEN k % 9 = 0 THEN '0' ELSE 'good' END AS rating
  FROM raw)"""

ROUTED = f"{RAW},{ROUTES},{OPEN},{routed_over('open_raw')}"
REQUESTS = f"WITH {ROUTED},{LOG}"
SHADOWS = f"WITH {ROUTED},{SHADOW}"

TRACE = f"""
traces AS (
  SELECT strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), {STAMP}) AS timestamp,
    'doc_' || doc_id AS request_id, source AS client_id, source AS cost_center, doc_id,
    CAST(to_json({{'messages': [{{'role': 'user', 'content': text}}]}}) AS VARCHAR) AS body,
    CAST(to_json({{'choices': [{{'message': {{'content': lang}}}}]}}) AS VARCHAR) AS answer,
    text, lang, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tin,
    CAST((octet_length(encode(lang)) + 3) // 4 AS BIGINT) AS tout
  FROM documents),
ranked AS (
  SELECT *, 'sha256:' || sha256(body) AS input_hash,
    row_number() OVER (PARTITION BY body ORDER BY timestamp DESC, request_id DESC) AS rn
  FROM traces WHERE doc_id % 11 <> 0),
dataset AS (
  SELECT 'lang_id' AS task_id, {redacted('body')} AS input, lang AS teacher_output,
    lang AS validated_output,
    CASE WHEN {bucket('request_id', 'split:')} < 70 THEN 'train'
         WHEN {bucket('request_id', 'split:')} < 85 THEN 'validation' ELSE 'test' END AS split,
    request_id, client_id, cost_center, timestamp, 'teacher' AS teacher_model,
    'teacher' AS selected_model, 'teacher' AS routing_decision,
    'default_teacher_only' AS routing_reason, input_hash, tin AS input_tokens,
    tout AS output_tokens,
    tin::DOUBLE / 1e6::DOUBLE * 5::DOUBLE + tout::DOUBLE / 1e6::DOUBLE * 15::DOUBLE
      AS estimated_cost_usd,
    estimated_cost_usd AS estimated_teacher_cost_usd, 0::DOUBLE AS estimated_savings_usd,
    {redacted('body')} AS redacted_body
  FROM ranked WHERE rn = 1)"""
DATASET = f"WITH {TRACE}"
DATASET_COLUMNS = """task_id, input, teacher_output, validated_output, split, request_id, client_id,
  cost_center, timestamp, teacher_model, selected_model, routing_decision, routing_reason,
  input_hash, input_tokens, output_tokens, estimated_cost_usd, estimated_teacher_cost_usd,
  estimated_savings_usd"""

_SPACES = r"'[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {_SPACES}, ' ', 'g'), ' ')"


def templated(x: str, variant: str) -> str:
    branches = " ".join(
        f"WHEN {i} THEN {q(a)} || {x} || {q(b)}" for i, (a, b) in enumerate(TEMPLATES))
    return f"CASE {variant} {branches} END"


SYNTHETIC = f"""
real_rows AS (SELECT *, {squeezed('input')} AS squeezed FROM dataset WHERE split = 'train'),
pairs AS (
  SELECT r.*, v, {templated('squeezed', 'v')} AS made
  FROM real_rows r, (VALUES (0), (1)) variants(v) WHERE squeezed <> ''),
fresh AS (
  SELECT *, row_number() OVER (PARTITION BY made ORDER BY v, timestamp, request_id) AS copy
  FROM pairs WHERE made NOT IN (SELECT input FROM real_rows)),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY v, timestamp, request_id) AS nth FROM fresh WHERE copy = 1),
synthetic AS (
  SELECT * FROM numbered WHERE nth <= (
    SELECT least(count(*) * 2, floor(count(*) * 0.8::DOUBLE / (1 - 0.8)::DOUBLE)) FROM real_rows)),
augmented AS (
  SELECT split, false AS is_synthetic FROM dataset
  UNION ALL SELECT 'train', true FROM synthetic)"""

CALLS = """
calls AS (
  SELECT 'doc_' || doc_id AS request_id, doc_id AS position, text, lang AS expected_intent, source,
    n_chars,
    CASE WHEN n_chars % 10 = 0 THEN '' WHEN n_chars % 5 = 1 THEN 'en' ELSE lang END AS answer,
    CASE WHEN n_chars % 13 = 0 THEN 500 ELSE 200 END AS http_status,
    CASE WHEN n_chars % 13 = 0 THEN 'error' ELSE 'success' END AS status
  FROM documents)"""


def scores(source: str, truth: str, predicted: str, keys: str = "") -> str:
    """Common table expressions ending in `metrics`."""
    k, on = (f"{keys}, ", f"USING ({keys}, label)") if keys else ("", "USING (label)")
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
truths AS (SELECT {k}{truth} AS label, count(*) AS n FROM {source} GROUP BY ALL),
guesses AS (SELECT {k}{predicted} AS label, count(*) AS n FROM {source} GROUP BY ALL),
hits AS (SELECT {k}{truth} AS label, count(*) AS n FROM {source}
  WHERE {truth} = {predicted} GROUP BY ALL),
per_label AS (
  SELECT {k}label, coalesce(h.n, 0) AS tp, coalesce(t.n, 0) AS truth_n,
    coalesce(g.n, 0) AS guess_n
  FROM truths t FULL JOIN guesses g {on} LEFT JOIN hits h {on}),
metrics AS (
  SELECT {k}CAST(sum(truth_n) AS BIGINT) AS eval_samples, count(*) AS labels,
    sum(tp)::DOUBLE / sum(truth_n) AS accuracy,
    avg(2.0::DOUBLE * tp / (truth_n + guess_n)) AS macro_f1
  FROM per_label {by})"""


MODELS = f"""{CALLS},{scores('calls', 'expected_intent', 'answer', 'source')},
models AS (
  SELECT 'student_' || source AS model_id, CAST(substr(source, 4) AS INTEGER) AS num,
    'task_' || num AS task_id,
    CASE num % 4 WHEN 0 THEN 'offline_eval' WHEN 1 THEN 'shadow' WHEN 2 THEN 'canary'
      ELSE 'retired' END AS status,
    strftime(DATE '2023-01-01' + num, '%Y-%m-%d') AS created_at, accuracy, macro_f1
  FROM metrics),
gated AS (
  SELECT *, CASE WHEN status = 'retired' THEN 'model status ''retired'' is not promotable'
    WHEN accuracy < {GATE_ACCURACY}::DOUBLE THEN 'accuracy'
    WHEN macro_f1 < {GATE_MACRO_F1}::DOUBLE THEN 'macro_f1' END AS gate FROM models)"""

CATALOGUE = """
catalogue AS (
  SELECT 'ds_' || source || '_' || lang AS dataset_id, CAST(substr(source, 4) AS INTEGER) AS num,
    'task_' || num AS task_id,
    strftime(DATE '2022-10-01' + CAST(num * 30 + length(lang) AS INTEGER), '%Y-%m-%d')
      || 'T00:00:00Z' AS created_at, count(*) AS samples
  FROM documents GROUP BY source, lang)"""

def spelled(*columns: str) -> str:
    return " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)


JSON_ANSWERS = """
made AS (SELECT doc_id, lang, n_chars AS n,
    '{"lang":"' || lang || '","meta":{"source":"' || source || '","chars":' || n_chars || '},"tags":["'
      || lang || '","' || source || '"]}' AS expected,
    '{"lang":"' || CASE WHEN n_chars % 5 = 0 THEN 'xx' ELSE lang END || '","meta":{'
      || CASE WHEN n_chars % 9 = 0 THEN '' ELSE '"source":"' || source || '",' END || '"chars":'
      || CASE WHEN n_chars % 6 = 0 THEN n_chars + 1 ELSE n_chars END || '},"tags":'
      || CASE WHEN n_chars % 4 = 0 THEN '[]' ELSE '["' || lang || '","' || source || '"]' END || '}' AS whole
  FROM documents),
pairs AS (SELECT doc_id, lang, expected, CASE WHEN n % 29 = 0 THEN NULL WHEN n % 11 = 0
    THEN substr(whole, 1, 20) ELSE whole END AS answer, coalesce(json_valid(answer), false) AS valid FROM made),
leaves AS (SELECT doc_id, side, t.fullkey AS path, coalesce(t.atom::VARCHAR, t.value::VARCHAR) AS v
  FROM (SELECT doc_id, 'e' AS side, expected::JSON AS j FROM pairs
        UNION ALL SELECT doc_id, 'p', answer::JSON FROM pairs WHERE valid) x, json_tree(x.j) t
  WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{}', '[]')),
fields AS (SELECT doc_id, path, max(v) FILTER (side = 'e') AS e, max(v) FILTER (side = 'p') AS p
  FROM leaves GROUP BY ALL)"""

LINES = """
lines AS (SELECT timestamp, task_id, ts < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY AS old,
    CASE WHEN k % 31 = 3 THEN 'cut' WHEN k % 37 = 5 THEN 'blank' WHEN k % 41 = 7 THEN 'number'
      WHEN k % 23 = 9 THEN 'undated' ELSE 'whole' END AS kind FROM raw)"""

CONFIDENCE = f"""
sure AS (SELECT task_id, selected_model, status = 'success' AS ok,
    {bucket('request_id', 'sure:')} AS one, {bucket('request_id', 'unsure:')} AS two,
    CASE WHEN ok THEN greatest(one, two) ELSE least(one, two) END AS bin
  FROM request_log WHERE routing_decision = 'student'),
bins AS (SELECT task_id, selected_model, bin, count(*) AS n, count(*) FILTER (WHERE ok) AS hits
  FROM sure GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER w AS un, sum(hits) OVER w AS uh FROM bins
  WINDOW w AS (PARTITION BY task_id, selected_model ORDER BY bin)),
means AS (SELECT a.task_id, a.selected_model, a.bin AS lo, b.bin AS hi,
    (b.uh - a.uh + a.hits)::DOUBLE / (b.un - a.un + a.n) AS m
  FROM upto a JOIN upto b ON a.task_id = b.task_id AND a.selected_model = b.selected_model AND a.bin <= b.bin),
worst AS (SELECT k.task_id, k.selected_model, k.bin, m.lo, min(m.m) AS m FROM bins k JOIN means m
    ON m.task_id = k.task_id AND m.selected_model = k.selected_model AND m.lo <= k.bin AND m.hi >= k.bin
  GROUP BY ALL),
calibrated AS (SELECT task_id, selected_model, bin, max(m) AS c FROM worst GROUP BY ALL),
curve AS (SELECT *, sum(n) OVER w AS above, sum(n) OVER (PARTITION BY task_id, selected_model) AS total,
    round(sum(n * (1 - c)) OVER w / above, 10) AS risk
  FROM bins JOIN calibrated USING (task_id, selected_model, bin)
  WINDOW w AS (PARTITION BY task_id, selected_model ORDER BY bin DESC)),
limits AS (SELECT task_id, selected_model, sum(n)::BIGINT AS answers,
    min(bin) FILTER (WHERE risk <= 0.1) / 100::DOUBLE AS min_confidence,
    round(arg_min(above, bin) FILTER (WHERE risk <= 0.1)::DOUBLE / any_value(total), 10) AS coverage,
    arg_min(risk, bin) FILTER (WHERE risk <= 0.1) AS risk
  FROM curve GROUP BY ALL)"""

QUOTAS = """
compared AS (SELECT task_id, substr(timestamp, 1, 10) AS day, count(response_exact_match) AS c,
    count(*) FILTER (WHERE NOT response_exact_match) AS d FROM shadow_log GROUP BY ALL),
per_day AS (SELECT task_id, substr(timestamp, 1, 10) AS day, count(*) AS requests
  FROM request_log GROUP BY ALL),
rolling AS (SELECT a.*, coalesce(round(sum(d)::DOUBLE / nullif(sum(c), 0), 6), 0) AS divergence
  FROM per_day a LEFT JOIN compared b ON a.task_id = b.task_id AND b.day::DATE = a.day::DATE - 1 GROUP BY ALL),
quotas AS (SELECT *, divergence > 0.15::DOUBLE AS raised, least(greatest(ceil(requests
    * CASE WHEN raised THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END), 3), 40, requests)::BIGINT AS quota FROM rolling)"""

DRIFT = f"""
recent AS (SELECT * FROM request_log WHERE CAST(replace(timestamp, 'Z', '') AS TIMESTAMP)
  >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
stats AS (
  SELECT task_id, count(*) AS student_requests,
    count(*) FILTER (WHERE status = 'error' OR http_status >= 400) AS student_errors,
    CAST(round_even(quantile_cont(latency_ms, 0.95), 0) AS BIGINT) AS p95
  FROM recent WHERE routing_decision = 'student' GROUP BY task_id),
attributed AS (
  SELECT CASE WHEN r.request_id IS NULL THEN f.task_id
              WHEN r.routing_decision = 'student' THEN r.task_id END AS task_id,
    lower(trim(rating)) IN ({", ".join(f"'{r}'" for r in NEGATIVE_RATINGS)}) AS bad
  FROM feedback f LEFT JOIN (
    SELECT * FROM recent WHERE task_id IN ('task_1', 'task_2', 'task_3', 'task_4')) r
    ON r.request_id = f.request_id
  WHERE CAST(replace(f.timestamp, 'Z', '') AS TIMESTAMP)
    >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
notes AS (
  SELECT task_id, count(*) AS feedback_total, count(*) FILTER (WHERE bad) AS feedback_negative
  FROM attributed WHERE task_id IS NOT NULL GROUP BY task_id),
figures AS (
  SELECT t.task_id, t.mode AS route_mode, t.student_model,
    coalesce(student_requests, 0) AS student_requests, coalesce(student_errors, 0) AS student_errors,
    p95 AS student_p95_latency_ms,
    CASE WHEN t.mode <> 'shadow' THEN coalesce(feedback_total, 0) ELSE 0 END AS feedback_total,
    CASE WHEN t.mode <> 'shadow' THEN coalesce(feedback_negative, 0) ELSE 0 END
      AS feedback_negative,
    coalesce(student_errors::DOUBLE / nullif(student_requests, 0), 0) AS er,
    coalesce(feedback_negative::DOUBLE / nullif(feedback_total, 0), 0) AS nr
  FROM routes t LEFT JOIN stats USING (task_id) LEFT JOIN notes USING (task_id)
  WHERE t.mode <> 'teacher_only'),
drift AS (
  SELECT * EXCLUDE (er, nr), round(er, 6) AS student_error_rate,
    CASE WHEN route_mode = 'shadow' THEN 0 ELSE round(nr, 6) END AS negative_feedback_rate,
    CASE WHEN route_mode = 'shadow' THEN '' ELSE concat_ws('; ',
      CASE WHEN student_requests >= 20 AND er > {MAX_ERROR_RATE}::DOUBLE
        THEN 'student_error_rate ' || printf('%.4f', er)
          || ' > {MAX_ERROR_RATE:.4f}' END,
      CASE WHEN feedback_total >= 5 AND nr > {MAX_NEGATIVE_RATE}::DOUBLE
        THEN 'negative_feedback_rate ' || printf('%.4f', nr)
          || ' > {MAX_NEGATIVE_RATE:.4f}' END) END AS rollback_reasons
  FROM figures)"""

SUMS = """round(sum(estimated_cost_usd), 8) AS estimated_cost_usd,
  round(sum(estimated_savings_usd), 8) AS estimated_savings_usd"""
LATENCY = "round(avg(latency_ms), 2) AS avg_latency_ms"
P95 = "round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms"
TEACHER_SUM = "round(sum(estimated_teacher_cost_usd), 8) AS estimated_teacher_cost_usd"
ERRORS = "count(*) FILTER (WHERE status = 'error') AS errors"
TEACHERS = "count(*) FILTER (WHERE routing_decision = 'teacher') AS teacher_requests"
STUDENTS = "count(*) FILTER (WHERE routing_decision = 'student') AS student_requests"
FALLBACKS = "count(*) FILTER (WHERE routing_reason LIKE '%fallback%') AS fallback_requests"
ERROR_RATE = "round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 6) AS error_rate"
PROBES = """count(*) AS probes, count(*) FILTER (WHERE status = 'error') AS errors,
  round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 6) AS error_rate,
  count(*) FILTER (WHERE response_exact_match = false) AS divergences,
  round(count(*) FILTER (WHERE response_exact_match = false)::DOUBLE / count(*), 6)
    AS divergence_rate"""

_CODES_SQL = ", ".join(f"'{c}'" for c in CODES)


def _fallback_score(label: str) -> str:
    tokens = [t for t in canonical_text(label).split("_") if len(t) > 2 and t not in STOP_TOKENS]
    terms = [f"CASE WHEN contains('_' || hay || '_', '_{t}_') THEN 3 "
             f"WHEN contains(hay, '{t[:5]}') THEN 1 ELSE 0 END" for t in tokens]
    return " + ".join(terms) or "0"


def canonical_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def _candidates(x: str) -> str:
    return f"list_concat([{x}], regexp_extract_all({x}, '[a-zA-Z][a-zA-Z0-9_?]+'))"



def oracle_sql() -> dict[str, str]:
    from meterline.plans.registry import INTENT_LABELS
    fallback_order = sorted(INTENT_LABELS)
    fallback = ", ".join(
        f"{{'s': {_fallback_score(x)}, 'r': {-i}, 'l': {q(x)}}}"
        for i, x in enumerate(fallback_order))
    codes = f"[{_CODES_SQL}]"
    first_code = (
        f"list_filter({_candidates('trimmed')}, lambda c: list_contains({codes}, c))[1]")
    forms = {canonical_text(x): x for x in fallback_order}
    form_case = "CASE f " + " ".join(f"WHEN '{f}' THEN {q(x)}" for f, x in forms.items()) + " END"
    inside = ", ".join(
        f"CASE WHEN contains(canon, '{f}') THEN {q(x)} END" for f, x in forms.items())
    prompt_head = q(TASK_DESCRIPTION.strip()
                    + "\nReturn exactly one label from the allowed list. Do not explain.\n\n"
                    + "Allowed labels:\n")
    user_text = "json_extract_string(input, '$.messages[0].content')"
    prompt = (f"{prompt_head} || (SELECT string_agg('- ' || l, chr(10) ORDER BY l) FROM "
              f"(SELECT DISTINCT validated_output AS l FROM dataset)) || {q(chr(10) * 2)} || "
              f"{q('Text:' + chr(10))} || {user_text} || {q(chr(10) * 2 + 'Label:')}")
    sft_split = "CASE split WHEN 'validation' THEN 'valid' ELSE split END AS split"
    synthetic_columns = f"""
  task_id, {templated('squeezed', 'v')} AS input, validated_output AS teacher_output,
  validated_output, split, request_id || ':synthetic:' || v AS request_id, client_id, cost_center,
  '{CREATED_AT}' AS timestamp, teacher_model, selected_model,
  'synthetic' AS routing_decision, 'local_template_augmentation' AS routing_reason,
  sha256(made) AS input_hash, input_tokens, output_tokens, 0::DOUBLE AS estimated_cost_usd,
  0::DOUBLE AS estimated_teacher_cost_usd, 0::DOUBLE AS estimated_savings_usd,
  true AS is_synthetic, request_id AS synthetic_parent_request_id,
  'local_template_' || v AS synthetic_method, 1::DOUBLE AS synthetic_confidence"""
    dash = """, dash AS (
  SELECT timestamp, task_id, coalesce(client_id, 'unknown_client') AS client_id,
    coalesce(cost_center, 'unassigned') AS cost_center, routing_decision, routing_reason, status,
    coalesce(latency_ms, 0)::DOUBLE AS latency_ms, estimated_cost_usd,
    estimated_teacher_cost_usd, estimated_savings_usd
  FROM request_log)"""
    candidates = f"""
SELECT task_id, count(*) AS requests, {TEACHERS},
  round(sum(estimated_teacher_cost_usd), 8) AS teacher_cost_usd,
  round(sum(estimated_teacher_cost_usd) - sum(estimated_cost_usd), 8) AS current_savings_usd,
  {LATENCY}, {ERROR_RATE},
  round(sum(estimated_teacher_cost_usd) * CASE WHEN count(*) FILTER (
    WHERE routing_decision = 'student') = 0 THEN 0.70::DOUBLE ELSE 0.25::DOUBLE END, 8)
    AS estimated_remaining_savings_usd
FROM {{source}} GROUP BY task_id HAVING count(*) >= 20
ORDER BY estimated_remaining_savings_usd DESC, teacher_cost_usd DESC, task_id LIMIT {{limit}}"""
    gate_text = (
        f"CASE gate WHEN 'accuracy' THEN 'model accuracy is below threshold' "
        f"WHEN 'macro_f1' THEN 'model macro_f1 is below threshold' ELSE gate END")
    limited_log = f"WITH {RAW},{ROUTES},{LIMITED},{routed_over('limited')},{LOG}"

    sql = {
        "log_enrichment": f"{limited_log} SELECT * FROM request_log",
        "redact_documents":
            f"SELECT doc_id, {redacted('text')} AS redacted FROM documents",
        "content_hash":
            "SELECT doc_id, 'sha256:' || sha256(text) AS input_hash FROM documents",
        "token_cost": f"""{REQUESTS} SELECT request_id, input_tokens, output_tokens,
            round(estimated_cost_usd, 10) AS cost_usd,
            round(estimated_teacher_cost_usd, 10) AS teacher_cost_usd,
            round(estimated_savings_usd, 10) AS savings_usd FROM request_log""",
        "route_decision": f"""WITH {ROUTED} SELECT request_id, log_task AS task_id,
            routing_decision, routing_reason, CASE routing_decision WHEN 'reject' THEN 'none'
              WHEN 'student' THEN 'local_student' ELSE 'teacher' END AS selected_model
            FROM routed""",
        "percentage_bucket": f"""SELECT 'req_' || event_id AS request_id,
            {bucket("('req_' || event_id)", 'route:')} AS bucket FROM events""",
        "rate_limit_aligned": f"""WITH {RAW},{LIMITED} SELECT request_id,
            coalesce(limit_reason, 'allowed') AS outcome FROM limited""",
        "finops_summary": f"""{REQUESTS} SELECT count(*) AS requests, {TEACHERS}, {STUDENTS},
            {ERRORS}, {SUMS}, {TEACHER_SUM}, {LATENCY}, {P95} FROM request_log""",
        "finops_by_task": f"""{REQUESTS} SELECT task_id, count(*) AS requests, {STUDENTS}, {SUMS},
            {LATENCY}, {P95} FROM request_log GROUP BY task_id
            ORDER BY estimated_savings_usd DESC, requests DESC, task_id LIMIT 20""",
        "finops_by_model": f"""{REQUESTS} SELECT selected_model, routing_decision,
            count(*) AS requests, {SUMS}, {LATENCY} FROM request_log
            GROUP BY selected_model, routing_decision""",
        "finops_errors": f"""{REQUESTS} SELECT coalesce(error_code, 'none') AS error_code,
            count(*) AS requests FROM request_log WHERE status = 'error'
            GROUP BY request_log.error_code""",
        "distillation_candidates": f"""{REQUESTS}
            {candidates.format(source='request_log', limit=20)}""",
        "dash_candidates": f"""{REQUESTS}{dash} {candidates.format(source='dash', limit=25)}""",
        "dash_summary": f"""{REQUESTS}{dash} SELECT count(*) AS requests, {TEACHERS}, {STUDENTS},
            {FALLBACKS}, {ERRORS}, {SUMS}, {TEACHER_SUM}, {LATENCY}, {P95}, {ERROR_RATE}
            FROM dash""",
        "dash_by_task": f"""{REQUESTS}{dash} SELECT task_id, count(*) AS requests, {TEACHERS},
            {STUDENTS}, {FALLBACKS}, {ERRORS}, {SUMS}, {TEACHER_SUM}, {LATENCY}, {P95}
            FROM dash GROUP BY task_id
            ORDER BY estimated_teacher_cost_usd DESC, requests DESC, task_id LIMIT 50""",
        "dash_by_client": f"""{REQUESTS}{dash} SELECT client_id, count(*) AS requests, {SUMS},
            {TEACHER_SUM}, {LATENCY} FROM dash GROUP BY client_id
            ORDER BY estimated_cost_usd DESC, requests DESC, client_id LIMIT 25""",
        "dash_by_cost_center": f"""{REQUESTS}{dash} SELECT cost_center, count(*) AS requests,
            {SUMS} FROM dash GROUP BY cost_center
            ORDER BY estimated_cost_usd DESC, requests DESC, cost_center LIMIT 25""",
        "routing_mix": f"""{REQUESTS} SELECT routing_decision, count(*) AS requests,
            round(sum(estimated_cost_usd), 8) AS estimated_cost_usd FROM request_log
            GROUP BY routing_decision""",
        "daily_trend": f"""{REQUESTS} SELECT substr(timestamp, 1, 10) AS day,
            count(*) AS requests, {SUMS}, {LATENCY} FROM request_log
            WHERE length(timestamp) >= 10 GROUP BY day ORDER BY day LIMIT 120""",
        "shadow_log": f"{SHADOWS} SELECT * FROM shadow_log",
        "shadow_summary": f"{SHADOWS} SELECT {PROBES}, {LATENCY}, {P95} FROM shadow_log",
        "shadow_by_task": f"""{SHADOWS} SELECT task_id, student_model, {PROBES}, {LATENCY}, {P95}
            FROM shadow_log GROUP BY task_id, student_model""",
        "shadow_errors": f"""{SHADOWS} SELECT coalesce(error_code, 'none') AS error_code,
            count(*) AS probes FROM shadow_log WHERE status = 'error'
            GROUP BY shadow_log.error_code""",
        "task_log_summary": f"""{REQUESTS} SELECT task_id, count(*) AS requests, {ERRORS},
            round(sum(estimated_teacher_cost_usd), 8) AS teacher_cost_usd,
            round(sum(estimated_savings_usd), 8) AS estimated_savings_usd,
            max(timestamp) AS last_seen FROM request_log GROUP BY task_id""",
        "task_status": f"""{REQUESTS},{MODELS},{CATALOGUE},
            d AS (SELECT task_id, count(*) AS datasets,
              arg_max(dataset_id, created_at || dataset_id) AS latest_dataset_id
              FROM catalogue GROUP BY task_id),
            m AS (SELECT task_id, count(*) AS models, arg_max(model_id, created_at || model_id)
              AS latest_model_id FROM models GROUP BY task_id),
            s AS (SELECT task_id, count(*) AS requests, {ERRORS},
              sum(estimated_teacher_cost_usd) AS tc, sum(estimated_savings_usd) AS es,
              max(timestamp) AS last_seen FROM request_log GROUP BY task_id)
            SELECT task_id, coalesce(mode, 'teacher_only') AS mode, student_model,
              coalesce(datasets, 0) AS datasets, latest_dataset_id, coalesce(models, 0) AS models,
              latest_model_id, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors,
              round(coalesce(tc, 0), 8) AS teacher_cost_usd,
              round(coalesce(es, 0), 8) AS estimated_savings_usd, last_seen
            FROM routes FULL JOIN d USING (task_id) FULL JOIN m USING (task_id)
              FULL JOIN s USING (task_id)""",
        "traffic_counters": f"""{limited_log},{SHADOW},{FEEDBACK}
            SELECT 'total' AS counter, count(*) AS value FROM request_log
            UNION ALL SELECT 'teacher', count(*) FROM request_log
              WHERE routing_decision = 'teacher'
            UNION ALL SELECT 'student', count(*) FROM request_log
              WHERE routing_decision = 'student'
            UNION ALL SELECT 'fallback', count(*) FROM request_log
              WHERE routing_reason = 'student_connect_error_teacher_fallback'
            UNION ALL SELECT 'rejected', count(*) FROM request_log
              WHERE routing_decision = 'reject'
            UNION ALL SELECT 'rate_limited', count(*) FROM request_log
              WHERE routing_reason LIKE 'rate_limited%'
            UNION ALL SELECT 'upstream_errors', count(*) FROM request_log
              WHERE error_code = 'proxy_error'
            UNION ALL SELECT 'shadow', count(*) FROM shadow_log
            UNION ALL SELECT 'shadow_errors', count(*) FROM shadow_log
              WHERE error_code IS NOT NULL
            UNION ALL SELECT 'feedback', count(*) FROM feedback""",
        "drift_report": f"{REQUESTS},{FEEDBACK},{DRIFT} SELECT * FROM drift",
        "rollback_routes": f"""{REQUESTS},{FEEDBACK},{DRIFT}
            SELECT t.task_id,
              CASE WHEN b.task_id IS NULL THEN t.mode ELSE 'teacher_only' END AS mode,
              CASE WHEN b.task_id IS NULL THEN t.student_model END AS student_model,
              CASE WHEN b.task_id IS NULL THEN t.canary_pct END AS student_traffic_percentage,
              CASE WHEN b.task_id IS NULL THEN t.probe_pct END AS teacher_probe_percentage,
              CAST(2 AS BIGINT) AS snapshot_version
            FROM routes t LEFT JOIN (SELECT task_id FROM drift WHERE rollback_reasons <> '') b
              ON b.task_id = t.task_id""",
        "feedback_attribution": f"""{REQUESTS},{FEEDBACK},{DRIFT}
            SELECT task_id, feedback_total, feedback_negative FROM notes""",
        "promotion_gate": f"""WITH {MODELS} SELECT model_id, task_id, status,
            round(accuracy, 10) AS accuracy, round(macro_f1, 10) AS macro_f1,
            gate IS NULL AS promotable, {gate_text} AS gate_reason FROM gated""",
        "promoted_routes": f"""WITH {ROUTES},{MODELS},
            changed AS (SELECT task_id, 'canary' AS mode, model_id AS student_model,
              25 AS student_traffic_percentage, CAST(NULL AS INTEGER) AS teacher_probe_percentage
              FROM gated WHERE gate IS NULL)
            SELECT *, CAST(2 AS BIGINT) AS snapshot_version FROM (
              SELECT * FROM routes WHERE task_id NOT IN (SELECT task_id FROM changed)
              UNION ALL SELECT * FROM changed)
              t(task_id, mode, student_model, student_traffic_percentage,
                teacher_probe_percentage)""",
        "retention_logs": f"""WITH {RAW}
            SELECT task_id, count(*) AS total_lines,
              count(*) FILTER (WHERE ts < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY)
                AS removed_lines,
              count(*) FILTER (WHERE ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAY)
                AS kept_lines,
              CAST(0 AS BIGINT) AS invalid_lines_kept, CAST(0 AS BIGINT) AS missing_timestamp_kept
            FROM raw GROUP BY task_id""",
        "retention_datasets": f"""WITH {CATALOGUE} SELECT dataset_id, task_id, created_at,
            CAST(created_at AS TIMESTAMPTZ) < TIMESTAMPTZ '2024-04-15 00:00:00+00'
              - INTERVAL 365 DAY AS expired FROM catalogue""",
        "model_catalogue": f"""WITH {MODELS} SELECT task_id, count(*) AS entries,
            arg_max(model_id, created_at || model_id) AS latest_model_id
            FROM models GROUP BY task_id""",
        "dataset_eligible": f"{DATASET} SELECT {DATASET_COLUMNS} FROM dataset",
        "dataset_split": f"""{DATASET} SELECT split, count(*) AS samples FROM dataset
            GROUP BY split""",
        "dataset_manifest": f"""{DATASET} SELECT task_id, count(*) AS samples,
            count(*) FILTER (WHERE split = 'train') AS train_samples,
            count(*) FILTER (WHERE split = 'validation') AS validation_samples,
            count(*) FILTER (WHERE split = 'test') AS test_samples,
            min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
            round(sum(estimated_teacher_cost_usd), 8) AS teacher_cost_usd,
            round(sum(estimated_savings_usd), 8) AS estimated_savings_usd
            FROM dataset GROUP BY task_id""",
        "openai_target": """SELECT doc_id, text AS target FROM documents""",
        "user_content": """SELECT conv_id, turn,
            CASE WHEN role = 'user' OR before_role = 'user' THEN concat_ws(chr(10),
              CASE WHEN before_role = 'user' THEN before_text END,
              CASE WHEN role = 'user' THEN text END)
            WHEN before_role IS NULL THEN CAST(to_json(
              {'messages': [{'role': role, 'content': text}]}) AS VARCHAR)
            ELSE CAST(to_json({'messages': [{'role': before_role, 'content': before_text},
              {'role': role, 'content': text}]}) AS VARCHAR) END AS content
            FROM (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
        "synthetic_rows": f"""{DATASET},{SYNTHETIC} SELECT {synthetic_columns} FROM synthetic""",
        "synthetic_manifest": f"""{DATASET},{SYNTHETIC} SELECT 'lang_id' AS task_id,
            count(*) AS samples, count(*) FILTER (WHERE split = 'train') AS train_samples,
            count(*) FILTER (WHERE split = 'validation') AS validation_samples,
            count(*) FILTER (WHERE split = 'test') AS test_samples,
            count(*) FILTER (WHERE NOT is_synthetic) AS real_samples,
            count(*) FILTER (WHERE is_synthetic) AS synthetic_samples,
            round(count(*) FILTER (WHERE is_synthetic)::DOUBLE / count(*), 10) AS synthetic_ratio
            FROM augmented""",
        "sft_prompt": f"""{DATASET} SELECT request_id, {sft_split}, {prompt} AS prompt,
            validated_output AS completion FROM dataset""",
        "sft_messages": f"""{DATASET} SELECT request_id, {sft_split}, CAST(to_json({{'messages': [
            {{'role': 'user', 'content': {prompt}}},
            {{'role': 'assistant', 'content': validated_output}}]}}) AS VARCHAR) AS record
            FROM dataset""",
        "label_normalize": f"""SELECT doc_id, {first_code} AS label FROM (
            SELECT doc_id, trim({squeezed_ends('text')}, '`''" ') AS trimmed FROM documents)""",
        "label_canonical": f"""SELECT doc_id, coalesce({form_case}, {inside}) AS label FROM (
            SELECT *, list_filter(list_transform({_canonical_candidates()},
              lambda c: {canonical_sql("c")}),
              lambda c: list_contains([{", ".join(f"'{f}'" for f in forms)}], c))[1] AS f
            FROM (SELECT doc_id, text AS cleaned, {canonical_sql('text')} AS canon
              FROM documents))""",
        "label_fallback": f"""SELECT doc_id, list_max([{fallback}]).l AS label FROM (
            SELECT doc_id, {canonical_sql("lang || ' ' || text")} AS hay FROM documents)""",
        "slug_labels": """SELECT product, CASE nth WHEN 1 THEN base ELSE base || '_' || nth END
            AS slug FROM (SELECT product, base,
              row_number() OVER (PARTITION BY base ORDER BY product) AS nth FROM (
                SELECT DISTINCT product, trim(regexp_replace(replace(lower(product), '&', ' and '),
                  '[^a-z0-9]+', '_', 'g'), '_') AS base
                FROM (SELECT p_brand || ' & ' || p_type AS product FROM part
                  UNION ALL SELECT p_brand || ' and ' || p_type FROM part)))""",
        "balanced_sample": f"""SELECT request_id, position, expected_intent FROM (
            SELECT *, row_number() OVER (ORDER BY turn_no, expected_intent) AS nth FROM (
              SELECT 'doc_' || doc_id AS request_id, doc_id AS position, lang AS expected_intent,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn_no
              FROM documents)) WHERE nth <= {SAMPLE_LIMIT}""",
        "skip_existing": f"""WITH {CALLS} SELECT 'doc_' || doc_id AS request_id,
            lang AS expected_intent FROM documents WHERE 'doc_' || doc_id NOT IN (
              SELECT request_id FROM calls WHERE status = 'success' OR http_status < 400)""",
        "allowed_labels": """SELECT doc_id, source FROM documents WHERE source IN (
            SELECT 'src' || n_nationkey FROM nation)""",
        "evaluate_calls": f"""WITH {CALLS} SELECT count(*) AS calls,
            count(*) FILTER (WHERE answer <> '' AND answer = expected_intent) AS correct,
            count(*) FILTER (WHERE answer = '') AS invalid,
            round(count(*) FILTER (WHERE answer <> '' AND answer = expected_intent)::DOUBLE
              / count(*), 10) AS accuracy FROM calls""",
        "macro_f1": f"""WITH {CALLS},{scores('calls', 'expected_intent', 'answer')}
            SELECT eval_samples, labels, round(accuracy, 10) AS accuracy,
              round(macro_f1, 10) AS macro_f1 FROM metrics""",
        "token_budget": f"""WITH l AS (SELECT count(*) AS labels, sum(length(lang) + 3) - 1 AS chars
              FROM (SELECT DISTINCT lang FROM documents)),
            s AS (SELECT count(*) AS requests, any_value(labels) AS labels,
              CAST((sum(length(text)) + any_value(chars) * count(*)) // 4 AS BIGINT) AS tokens
              FROM documents, l)
            SELECT requests, labels, tokens AS estimated_prompt_tokens,
              round(tokens::DOUBLE / requests, 2) AS estimated_prompt_tokens_per_request,
              CAST({BUDGET} AS BIGINT) AS token_budget,
              CAST(floor({BUDGET}::DOUBLE / (tokens::DOUBLE / requests)) AS BIGINT)
                AS estimated_requests_for_budget FROM s""",
        "knn_labels": """WITH pairs AS (
              SELECT a.vec_id AS query_id, b.label, b.vec_id AS ref_id,
                list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
              FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
            top AS (SELECT * FROM pairs QUALIFY row_number() OVER (
              PARTITION BY query_id ORDER BY round(score, 12) DESC, ref_id) <= 5),
            votes AS (SELECT query_id, label, count(*) AS votes,
              greatest(max(score), 0::DOUBLE) AS confidence FROM top GROUP BY query_id, label)
            SELECT query_id, label, votes, round(confidence, 8) AS confidence FROM votes
            QUALIFY row_number() OVER (PARTITION BY query_id
              ORDER BY votes DESC, round(confidence, 12) DESC, label) = 1""",
        "majority_baseline": f"""{DATASET}, best AS (SELECT validated_output AS prediction
              FROM dataset WHERE split = 'train' GROUP BY 1
              ORDER BY count(*) DESC, 1 LIMIT 1)
            SELECT request_id, validated_output AS label, prediction, 1::DOUBLE AS confidence
            FROM dataset, best WHERE split = 'validation'""",
        "training_triggers": f"""{REQUESTS}, s AS (SELECT task_id, count(*) AS samples,
              count(DISTINCT client_id) AS clients,
              coalesce(sum(estimated_teacher_cost_usd), 0) AS cost,
              date_diff('day', min(substr(timestamp, 1, 10)::DATE), max(substr(timestamp, 1, 10)::DATE))
                AS age_days,
              count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*) AS rate
              FROM request_log GROUP BY task_id)
            SELECT task_id, samples, clients, round(cost, 6) AS teacher_cost_usd, age_days,
              round(rate, 6) AS error_rate, samples >= 100 AND clients >= 5 AND cost >= 0
              AND age_days >= 7 AND rate <= 0.5 AS triggered FROM s""",
        "latency_by_model": f"""{REQUESTS} SELECT selected_model, count(*) AS requests,
              round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms,
              round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms,
              round(quantile_cont(latency_ms, 0.99), 2) AS p99_latency_ms,
              round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 6) AS error_rate,
              round(count(*) FILTER (WHERE routing_reason LIKE '%fallback%')::DOUBLE / count(*), 6)
                AS fallback_rate FROM request_log GROUP BY selected_model""",
        "savings_trend": f"""{REQUESTS}, d AS (SELECT task_id, substr(timestamp, 1, 10) AS day,
              sum(coalesce(estimated_savings_usd, 0)) AS s FROM request_log GROUP BY ALL),
            c AS (SELECT *, sum(s) OVER (PARTITION BY task_id ORDER BY day) AS upto FROM d)
            SELECT task_id, day, round(s, 6) AS savings_usd, round(upto, 6) AS cumulative_savings_usd,
              round(greatest(0.25 - upto, 0), 6) AS unrecovered_usd,
              round((upto - 0.25) / 0.25, 6) AS roi FROM c""",
        "confusion_matrix": f"""WITH {CALLS} SELECT expected_intent AS expected, answer AS predicted,
              count(*) AS n FROM calls GROUP BY ALL""",
        "label_scores": f"""WITH {CALLS}, l AS (SELECT expected_intent AS label FROM calls
              UNION SELECT answer FROM calls),
            s AS (SELECT label, (SELECT count(*) FROM calls WHERE expected_intent = label) AS support,
              (SELECT count(*) FROM calls WHERE answer = label) AS predicted,
              (SELECT count(*) FROM calls WHERE answer = label AND expected_intent = label) AS hits
              FROM l)
            SELECT label, support, predicted, coalesce(round(hits::DOUBLE / nullif(predicted, 0), 10), 0) AS precision,
              coalesce(round(hits::DOUBLE / nullif(support, 0), 10), 0) AS recall,
              coalesce(round(2 * hits::DOUBLE / nullif(predicted + support, 0), 10), 0) AS f1 FROM s""",
        "group_split": f"""{REQUESTS}, b AS (SELECT client_id,
              {bucket("coalesce(client_id, request_id)", 'group:')} AS b FROM request_log)
            SELECT CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split,
              count(*) AS samples, count(DISTINCT client_id) AS clients FROM b GROUP BY 1""",
        "label_conflicts": """SELECT doc_id, source FROM documents WHERE text IN (SELECT text
              FROM documents GROUP BY text HAVING count(DISTINCT source) = 1)""",
        "distribution_drift": f"""{REQUESTS}, c AS (SELECT task_id, selected_model,
              count(*) FILTER (WHERE timestamp < '2024-01-15') AS a,
              count(*) FILTER (WHERE timestamp >= '2024-01-15') AS b FROM request_log GROUP BY ALL),
            p AS (SELECT task_id, coalesce(a::DOUBLE / nullif(sum(a) OVER w, 0), 0) AS p,
              coalesce(b::DOUBLE / nullif(sum(b) OVER w, 0), 0) AS q FROM c
              WINDOW w AS (PARTITION BY task_id))
            SELECT task_id, count(*) AS labels, round(sum(abs(p - q)), 8) AS l1,
              round(sum((greatest(q, 1e-6) - greatest(p, 1e-6))
                * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 8) AS psi FROM p GROUP BY task_id""",
        "repetitive_tasks": f"""{REQUESTS}, s AS (SELECT task_id, count(input_hash) AS requests,
              count(DISTINCT input_hash) AS inputs FROM request_log GROUP BY task_id)
            SELECT *, round((requests - inputs)::DOUBLE / nullif(requests, 0), 6) AS repeated_share,
              coalesce(round((requests - inputs)::DOUBLE / nullif(requests, 0), 6) >= 0.05, false)
                AS repetitive FROM s""",
        "dataset_version": f"""{DATASET}, d AS (SELECT task_id, md5({spelled('request_id', 'input',
              'validated_output', 'split')}) AS m FROM dataset)
            SELECT task_id, count(*) AS rows, concat_ws('-', {", ".join(
                f"sum(('0x' || substr(m, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(4))})
              AS content_hash FROM d GROUP BY task_id""",
        "dataset_changes": f"""{DATASET}, fresh AS (
              SELECT request_id, input, CASE WHEN {bucket('request_id', 'relabelled:')} < 4 THEN 'other'
                ELSE validated_output END AS validated_output, split
              FROM dataset WHERE {bucket('request_id', 'gone:')} >= 3
              UNION ALL SELECT request_id || '|new', input, validated_output, split
              FROM dataset WHERE {bucket('request_id', 'new:')} < 2)
            SELECT 'lang_id' AS task_id, coalesce(a.request_id, b.request_id) AS request_id,
              CASE WHEN a.request_id IS NULL THEN 'added' WHEN b.request_id IS NULL THEN 'removed'
                ELSE 'changed' END AS change
            FROM dataset a FULL JOIN fresh b USING (request_id)
            WHERE (a.input, a.validated_output, a.split) IS DISTINCT FROM
              (b.input, b.validated_output, b.split)""",
        "json_fields": f"""WITH {JSON_ANSWERS} SELECT path, count(e) AS expected, count(p) AS predicted,
              count(*) FILTER (WHERE e = p) AS matches,
              coalesce(round(matches::DOUBLE / nullif(count(e), 0), 10), 0) AS accuracy
            FROM fields GROUP BY path""",
        "json_report": f"""WITH {JSON_ANSWERS}, d AS (SELECT doc_id, count(e) AS fields,
              count(*) FILTER (WHERE e IS NOT DISTINCT FROM p) AS same, count(*) AS paths
              FROM fields GROUP BY doc_id),
            s AS (SELECT lang, count(*) AS answers, count(*) FILTER (WHERE valid) AS valid_json,
              count(*) FILTER (WHERE valid AND same = paths) AS exact_matches,
              sum(fields)::BIGINT AS fields, sum(same)::BIGINT AS right_fields
              FROM pairs JOIN d USING (doc_id) GROUP BY lang)
            SELECT *, round(valid_json::DOUBLE / answers, 10) AS valid_rate,
              round(exact_matches::DOUBLE / answers, 10) AS exact_rate,
              round(right_fields::DOUBLE / fields, 10) AS field_accuracy FROM s""",
        "regression_scores": """WITH g AS (SELECT lang, n_chars::DOUBLE AS y, CASE WHEN n_chars % 19 <> 0
              THEN (n_chars + n_chars % 17 - 8)::DOUBLE END AS p FROM documents)
            SELECT lang, count(p) AS samples, count(*) FILTER (WHERE p IS NULL) AS missing,
              round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
              round(1 - avg((p - y) * (p - y)) / var_pop(y) FILTER (WHERE p IS NOT NULL), 6) AS r2
            FROM g GROUP BY lang""",
        "confidence_limits": f"""{REQUESTS},{CONFIDENCE} SELECT * FROM limits""",
        "confident_routes": f"""{REQUESTS},{CONFIDENCE}, s AS (SELECT task_id, selected_model,
              count(*) AS requests, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms,
              round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 6) AS error_rate
              FROM request_log WHERE routing_decision = 'student' GROUP BY ALL),
            r AS (SELECT s.*, CASE WHEN requests < 5 THEN 'too few requests'
              WHEN p95_latency_ms > 900 THEN 'too slow' WHEN error_rate > 0.2 THEN 'too many errors'
              WHEN min_confidence IS NULL THEN 'no safe confidence' END AS reason,
              min_confidence, coverage FROM s LEFT JOIN limits USING (task_id, selected_model))
            SELECT *, CASE WHEN reason IS NULL THEN 'student' ELSE 'teacher_only' END AS decision FROM r""",
        "leak_free_split": f"""WITH RECURSIVE d AS (SELECT 'doc_' || doc_id AS id, 'c' || (doc_id // 3) AS c,
              CASE WHEN doc_id % 5 = 0 THEN 'v' || (doc_id // 7) END AS v, text FROM documents),
            l AS (SELECT DISTINCT a.id, b.id AS other FROM d a JOIN d b ON a.c = b.c
              UNION SELECT a.id, b.id FROM d a JOIN d b ON a.v = b.v
              UNION SELECT a.id, b.id FROM d a JOIN d b ON a.text = b.text),
            reach(id, seen) AS (SELECT id, id FROM d
              UNION SELECT r.id, l.other FROM reach r JOIN l ON l.id = r.seen),
            c AS (SELECT id, min(seen) AS component FROM reach GROUP BY id),
            b AS (SELECT *, {bucket('component', 'group:')} AS b FROM c)
            SELECT id AS request_id, component, CASE WHEN b < 70 THEN 'train' WHEN b < 85
              THEN 'validation' ELSE 'test' END AS split FROM b""",
        "prompt_drift": f"""WITH d AS (SELECT 'doc_' || doc_id AS request_id, 'task_' || doc_id % 6 AS task_id,
              list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws,
              CASE WHEN doc_id % 6 < 3 THEN lang IN ('de', 'fr')
                ELSE {bucket("'doc_' || doc_id", 'side:')} < 40 END AS later FROM documents),
            sizes AS (SELECT task_id, count(*) FILTER (WHERE NOT later) AS before,
              count(*) FILTER (WHERE later) AS after FROM d GROUP BY task_id),
            grams AS (SELECT task_id, request_id, later, unnest(list_concat(ws,
              list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM d),
            counts AS (SELECT task_id, {bucket('request_id', 'drift:')} % 25 AS g,
              ('0x' || substr(md5(gram), 1, 8))::BIGINT % 128 AS b,
              count(*) FILTER (WHERE NOT later) AS n0, count(*) FILTER (WHERE later) AS n1
              FROM grams GROUP BY ALL),
            draws AS (SELECT draw, g, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || ':' || g))
              AS place FROM range(99) a(draw), range(25) b(g)),
            null_counts AS (SELECT task_id, draw, b,
              sum(CASE WHEN place <= least(greatest(round(25.0::DOUBLE * after / (before + after)), 1), 24)
                THEN 0 ELSE n0 + n1 END) AS n0,
              sum(CASE WHEN place <= least(greatest(round(25.0::DOUBLE * after / (before + after)), 1), 24)
                THEN n0 + n1 ELSE 0 END) AS n1
              FROM counts JOIN sizes USING (task_id) JOIN draws USING (g)
              WHERE before > 0 AND after > 0 GROUP BY ALL),
            every AS (SELECT task_id, -1 AS draw, b, sum(n0) AS n0, sum(n1) AS n1 FROM counts GROUP BY ALL
              UNION ALL SELECT * FROM null_counts),
            shares AS (SELECT task_id, draw, coalesce(n0::DOUBLE / nullif(sum(n0) OVER w, 0), 0) AS p,
              coalesce(n1::DOUBLE / nullif(sum(n1) OVER w, 0), 0) AS q FROM every
              WINDOW w AS (PARTITION BY task_id, draw)),
            t AS (SELECT task_id, draw, round(sum(abs(p - q)), 8) AS l1,
              round(sum((greatest(q, 1e-6) - greatest(p, 1e-6))
                * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 8) AS psi FROM shares GROUP BY ALL),
            ranks AS (SELECT a.task_id, round((count(*) FILTER (WHERE b.l1 >= a.l1) + 1) / 100::DOUBLE, 6)
              AS p_value FROM t a JOIN t b USING (task_id) WHERE a.draw = -1 AND b.draw >= 0 GROUP BY ALL)
            SELECT task_id, before, after, l1, psi, p_value, coalesce(p_value <= 0.01, false) AS drifted
            FROM sizes LEFT JOIN (SELECT * FROM t WHERE draw = -1) USING (task_id)
              LEFT JOIN ranks USING (task_id)""",
        "label_drift": f"""{REQUESTS}, c AS (SELECT task_id, response_redacted,
              count(*) FILTER (WHERE timestamp < '2024-01-15') AS a,
              count(*) FILTER (WHERE timestamp >= '2024-01-15') AS b FROM request_log GROUP BY ALL),
            p AS (SELECT task_id, coalesce(a::DOUBLE / nullif(sum(a) OVER w, 0), 0) AS p,
              coalesce(b::DOUBLE / nullif(sum(b) OVER w, 0), 0) AS q FROM c
              WINDOW w AS (PARTITION BY task_id))
            SELECT task_id, count(*) AS labels, round(sum(abs(p - q)), 8) AS l1,
              round(sum((greatest(q, 1e-6) - greatest(p, 1e-6))
                * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 8) AS psi FROM p GROUP BY task_id""",
        "near_repetitive_tasks": r"""WITH i AS (SELECT lang AS task_id, sha256(text) AS h, count(*) AS n,
              list_filter(regexp_split_to_array(min(text), '[ \t\n\r\f\x0b]+'), lambda x: x <> '') AS ws
              FROM documents GROUP BY ALL),
            s AS (SELECT DISTINCT task_id, h, array_to_string(ws[k:k + 4], ' ') AS g FROM (
              SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
            z AS (SELECT task_id, h, count(*) AS n FROM s GROUP BY ALL),
            c AS (SELECT a.task_id, a.h, b.h AS o, count(*) AS common FROM s a
              JOIN s b ON a.task_id = b.task_id AND a.g = b.g AND a.h <> b.h GROUP BY ALL),
            near AS (SELECT DISTINCT c.task_id, c.h FROM c JOIN z x ON x.task_id = c.task_id AND x.h = c.h
              JOIN z y ON y.task_id = c.task_id AND y.h = c.o
              WHERE common::DOUBLE / (x.n + y.n - common) >= 0.8),
            t AS (SELECT i.task_id, sum(n)::BIGINT AS requests, count(*) AS inputs,
              count(near.h) AS near_inputs,
              coalesce(sum(n) FILTER (WHERE near.h IS NOT NULL OR n > 1), 0)::BIGINT AS repeated_requests
              FROM i LEFT JOIN near ON near.task_id = i.task_id AND near.h = i.h GROUP BY i.task_id)
            SELECT *, round(repeated_requests::DOUBLE / requests, 6) AS repeated_share,
              repeated_share >= 0.05 AS repetitive FROM t""",
        "label_balance": f"""{REQUESTS}, c AS (SELECT task_id, response_redacted, count(*) AS n
              FROM request_log WHERE response_redacted IS NOT NULL GROUP BY ALL)
            SELECT task_id, sum(n)::BIGINT AS labelled, count(*) AS labels,
              round(min(n)::DOUBLE / sum(n), 6) AS balance_ratio, balance_ratio >= 0.2 AS balanced
            FROM c GROUP BY task_id""",
        "sampling_quotas": f"""{REQUESTS},{SHADOW},{QUOTAS} SELECT * FROM quotas""",
        "sampled_requests": f"""{REQUESTS},{SHADOW},{QUOTAS} SELECT task_id, day, request_id FROM (
              SELECT l.task_id, day, request_id, quota, row_number() OVER (PARTITION BY l.task_id, day
                ORDER BY md5('probe:' || request_id), request_id) AS nth
              FROM (SELECT *, substr(timestamp, 1, 10) AS day FROM request_log) l
                JOIN quotas USING (task_id, day)) WHERE nth <= quota""",
        "dated_log": f"""{REQUESTS} SELECT substr(timestamp, 1, 10) AS date, count(*) AS requests,
              sum(input_tokens) AS input_tokens, count(DISTINCT request_id) AS ids
              FROM request_log GROUP BY 1""",
        "log_files": f"""{REQUESTS} SELECT task_id, count(*) AS requests,
              count(cost_center) FILTER (WHERE timestamp < '2024-01-15') AS with_center,
              count(input_hash) FILTER (WHERE timestamp < '2024-01-15') AS hashed,
              sum(output_tokens) AS output_tokens, sum(latency_ms) AS latency_ms
            FROM request_log GROUP BY task_id""",
        "log_quarantine": f"""WITH {RAW},{LINES} SELECT 'read' AS fate, task_id, count(*) AS lines
              FROM lines WHERE kind IN ('whole', 'undated') GROUP BY task_id
            UNION ALL SELECT 'set aside', NULL, count(*) FROM lines WHERE kind = 'cut'""",
        "retention_lines": f"""WITH {RAW},{LINES} SELECT substr(timestamp, 1, 10) AS day,
              count(*) AS total_lines,
              count(*) FILTER (WHERE kind = 'whole' AND old) AS removed_lines,
              count(*) FILTER (WHERE kind <> 'whole' OR NOT old) AS kept_lines,
              count(*) FILTER (WHERE kind = 'cut') AS invalid_lines_kept,
              count(*) FILTER (WHERE kind IN ('undated', 'number')) AS missing_timestamp_kept
            FROM lines GROUP BY 1""",
        "dataset_files": f"""{DATASET} SELECT split, count(*) AS samples, count(DISTINCT request_id) AS ids,
              0::BIGINT AS unsorted FROM dataset GROUP BY split""",
        "sft_files": f"""{DATASET} SELECT task_id, {sft_split}, validated_output AS completion,
              count(*) AS records, sum(length({prompt}))::BIGINT AS chars FROM dataset GROUP BY ALL""",
        "labelled_csv": f"""SELECT lang AS expected_intent, count(*) AS texts, count(*) AS ids,
              sum(length({squeezed_ends('text')}))::BIGINT AS chars
            FROM documents WHERE doc_id % 10 <> 0 AND length({squeezed_ends('text')}) > 0 GROUP BY lang""",
        "complaint_samples": f"""WITH c AS (SELECT doc_id, 'the_' || source AS label,
              {squeezed_ends('text')} AS body, lang FROM documents
              WHERE source IN (SELECT 'src' || n_nationkey FROM nation)),
            ok AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS turn FROM c
              WHERE length(body) >= 400),
            train AS (SELECT * FROM ok QUALIFY row_number() OVER (ORDER BY turn, label) <= 100),
            rest AS (SELECT doc_id, label, body, lang, row_number() OVER (PARTITION BY label ORDER BY doc_id)
              AS turn FROM ok WHERE doc_id NOT IN (SELECT doc_id FROM train)),
            evals AS (SELECT * FROM rest QUALIFY row_number() OVER (ORDER BY turn, label) <= 40),
            both_ AS (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'test' FROM evals)
            SELECT 'cfpb_' || doc_id AS request_id, label AS expected_intent, split,
              length('Consumer complaint narrative:' || chr(10) || body || chr(10) || chr(10)
                || 'Reported issue: ' || lang) AS chars FROM both_""",
        "route_policy": f"""{REQUESTS}, s AS (SELECT task_id, selected_model, count(*) AS requests,
              round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms,
              round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 6) AS error_rate
              FROM request_log WHERE routing_decision = 'student' GROUP BY ALL),
            r AS (SELECT *, CASE WHEN requests < 5 THEN 'too few requests'
              WHEN p95_latency_ms > 900 THEN 'too slow' WHEN error_rate > 0.2 THEN 'too many errors' END
              AS reason FROM s)
            SELECT *, CASE WHEN reason IS NULL THEN 'student' ELSE 'teacher_only' END AS decision FROM r""",
        "teacher_sampling": f"""{REQUESTS}, d AS (SELECT task_id, substr(timestamp, 1, 10) AS day,
              count(*) AS requests, count(*) FILTER (WHERE routing_decision = 'teacher')
              AS teacher_requests FROM request_log GROUP BY ALL),
            t AS (SELECT *, least(greatest(ceil(requests * 0.1::DOUBLE), 3), 40, requests)::BIGINT
              AS teacher_samples FROM d)
            SELECT *, greatest(teacher_samples - teacher_requests, 0) AS missing FROM t""",
        "evaluation_gate": f"""{REQUESTS}, s AS (SELECT selected_model, count(*) AS samples,
              round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms,
              round(sum(estimated_cost_usd) / nullif(sum(estimated_teacher_cost_usd), 0), 8) AS cost_ratio
              FROM request_log WHERE routing_decision = 'student' GROUP BY selected_model),
            g AS (SELECT *, CASE WHEN samples < 10 THEN 'too few samples'
              WHEN NOT coalesce(cost_ratio <= 0.5, false) THEN 'too expensive'
              WHEN NOT coalesce(p95_latency_ms <= 900, false) THEN 'too slow' END AS gate_reason FROM s)
            SELECT *, gate_reason IS NULL AS passed FROM g""",
        "label_normalize_join": None,
        "stream_enrichment": f"{REQUESTS} SELECT * FROM request_log",
        "stream_counters": f"""{REQUESTS},
            hits AS (SELECT unnest(['total', routing_decision,
              CASE WHEN routing_reason = 'student_connect_error_teacher_fallback'
                THEN 'fallback' END,
              CASE WHEN error_code = 'proxy_error' THEN 'upstream_errors' END]) AS c
              FROM request_log)
            SELECT CASE c WHEN 'reject' THEN 'rejected' ELSE c END AS counter,
              count(*) AS value FROM hits WHERE c IS NOT NULL GROUP BY c""",
        "stream_drift": f"""{REQUESTS},
            served AS (SELECT *, date_trunc('hour', CAST(replace(timestamp, 'Z', '') AS TIMESTAMP))
              AS hour FROM request_log WHERE routing_decision = 'student'),
            spread AS (SELECT s.*, hour - to_hours(h) AS window_start
              FROM served s, range(24) t(h)),
            windows AS (SELECT window_start, task_id, count(*) AS student_requests,
              count(*) FILTER (WHERE status = 'error' OR http_status >= 400) AS student_errors,
              student_errors::DOUBLE / student_requests AS er
              FROM spread WHERE task_id IN ('task_1', 'task_2', 'task_3')
              GROUP BY window_start, task_id)
            SELECT strftime(window_start, {STAMP}) AS window_start, task_id, student_requests,
              student_errors, round(er, 6) AS student_error_rate,
              CASE WHEN student_requests >= 20 AND er > {MAX_ERROR_RATE}::DOUBLE
                THEN 'student_error_rate ' || printf('%.4f', er)
                  || ' > {MAX_ERROR_RATE:.4f}' ELSE '' END AS rollback_reasons
            FROM windows""",
        "stream_shadow_join": f"""{SHADOWS} SELECT * REPLACE (
              CASE WHEN http_status IS NOT NULL THEN latency_ms END AS latency_ms) FROM shadow_log""",
        "stream_rolling_drift": f"""{REQUESTS},{FEEDBACK},
            timed AS (SELECT *, CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) AS ts FROM request_log),
            marked AS (SELECT task_id, date_trunc('hour', ts) AS hour,
                greatest(length(bin(latency_ms)) - 6, 0) AS s, latency_ms,
                status = 'error' OR http_status >= 400 AS bad
              FROM timed WHERE routing_decision = 'student' AND task_id IN ('task_1', 'task_2', 'task_3')),
            noted AS (SELECT date_trunc('hour', CAST(replace(f.timestamp, 'Z', '') AS TIMESTAMP)) AS hour,
                CASE WHEN r.request_id IS NULL THEN f.task_id
                  WHEN r.routing_decision = 'student' THEN r.task_id END AS task_id,
                lower(trim(rating)) IN ({", ".join(f"'{r}'" for r in NEGATIVE_RATINGS)}) AS negative
              FROM feedback f LEFT JOIN (SELECT * FROM timed
                WHERE task_id IN ('task_1', 'task_2', 'task_3', 'task_4')) r ON r.request_id = f.request_id),
            w AS (SELECT hour - to_hours(h) AS window_start, task_id, bad, NULL::BOOLEAN AS negative,
                CASE WHEN s = 0 THEN latency_ms ELSE ((latency_ms >> s) << s) + (1 << (s - 1)) END AS ms
              FROM marked, range(24) t(h)
              UNION ALL SELECT hour - to_hours(h), task_id, NULL, negative, NULL
              FROM noted, range(24) t(h) WHERE task_id IN ('task_1', 'task_2', 'task_3')),
            f AS (SELECT window_start, task_id, count(bad) AS n, count(*) FILTER (WHERE bad) AS e,
                CAST(round_even(quantile_cont(ms, 0.95), 0) AS BIGINT) AS p95,
                count(negative) AS t, count(*) FILTER (WHERE negative) AS g,
                coalesce(e::DOUBLE / nullif(n, 0), 0) AS er, coalesce(g::DOUBLE / nullif(t, 0), 0) AS nr
              FROM w GROUP BY window_start, task_id)
            SELECT strftime(window_start, {STAMP}) AS window_start, task_id, n AS student_requests,
              e AS student_errors, round(er, 6) AS student_error_rate, p95 AS student_p95_latency_ms,
              t AS feedback_total, g AS feedback_negative, round(nr, 6) AS negative_feedback_rate,
              concat_ws('; ',
                CASE WHEN n >= 20 AND er > {MAX_ERROR_RATE}::DOUBLE THEN 'student_error_rate '
                  || printf('%.4f', er) || ' > {MAX_ERROR_RATE:.4f}' END,
                CASE WHEN t >= 5 AND nr > {MAX_NEGATIVE_RATE}::DOUBLE THEN 'negative_feedback_rate '
                  || printf('%.4f', nr) || ' > {MAX_NEGATIVE_RATE:.4f}' END) AS rollback_reasons FROM f""",
        "stream_newest_copies": f"""{REQUESTS},
            t AS (SELECT *, CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) AS ts FROM request_log),
            s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
              FROM t WINDOW w AS (PARTITION BY task_id, coalesce(input_hash, request_id) ORDER BY ts)),
            r AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id, coalesce(input_hash, request_id)
              ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
            SELECT arg_max(request_id, (ts, timestamp, request_id)) AS request_id, task_id,
              any_value(input_hash) AS input_hash,
              arg_max(timestamp, (ts, timestamp, request_id)) AS timestamp, count(*) AS copies,
              strftime(min(ts), {STAMP}) AS first_seen
            FROM r GROUP BY task_id, coalesce(input_hash, request_id), run""",
        "stream_feedback": f"""WITH {RAW} SELECT timestamp, request_id,
            'client_' || (user_id % 20) AS client_id, task_id,
            CASE WHEN k % 9 <> 0 THEN 'bad' END AS rating,
            CAST(NULL AS VARCHAR) AS correct_output_redacted,
            CASE WHEN k % 7 = 0 THEN 'write to [REDACTED_EMAIL]' END AS comment_redacted
            FROM raw JOIN (SELECT event_id AS eid, user_id FROM events) ON eid = event_id
            WHERE k % 23 <> 0""",
        "stream_feedback_rejects": f"""WITH {RAW} SELECT timestamp,
            '{{"request_id":" ' || request_id
              || CASE WHEN k % 9 = 0 THEN ' ","rating":0' ELSE ' ","rating":" bad "' END
              || CASE WHEN k % 7 = 0 THEN ',"comment":"write to user@example.com"'
                 ELSE ',"comment":"  "' END AS body
            FROM raw WHERE k % 23 = 0""",
        "stream_dedupe": f"{REQUESTS} SELECT DISTINCT input_hash FROM request_log",
        "stream_rate_limit": f"""WITH RECURSIVE {RAW},{ANCHORED}
            SELECT r.request_id, CASE WHEN c.over_client THEN 'rate_limited_client'
              WHEN t.over_task THEN 'rate_limited_task' ELSE 'allowed' END AS outcome
            FROM raw r LEFT JOIN client_ranked c ON c.request_id = r.request_id
              LEFT JOIN task_ranked t ON t.request_id = r.request_id""",
        "complaint_text": f"""SELECT doc_id, {q('Consumer complaint narrative:' + chr(10))} || text
              || chr(10) || chr(10) || 'Reported issue: ' || lang
              || CASE WHEN source <> 'src0' THEN chr(10) || 'Reported sub-product: ' || source
                 ELSE '' END AS prompt_text FROM documents""",
    }
    sql["label_normalize_join"] = sql["label_normalize"]
    return sql


def squeezed_ends(x: str) -> str:
    ends = _SPACES[1:-1]
    return f"regexp_replace({x}, '^{ends}|{ends}$', '', 'g')"


def _canonical_candidates() -> str:
    return "list_concat([cleaned], regexp_extract_all(cleaned, '[A-Za-z][A-Za-z0-9_/-]+'))"
