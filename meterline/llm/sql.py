"""The same queries in DuckDB SQL, where SQL can say them.

Not said in SQL: op2 (crc32 and a model over it), op3 and op11 (tokenizers), op4 and op6 (searches
that SQL has no hash for), op5 and op10 (trained models), op7 (pseudorandom permutations), and the
pipeline.
These are compared with brute-force versions in tests/llm.
"""

from __future__ import annotations

_FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
_SPREAD = {"word_length": 100, "symbol_ratio": 500, "dup_line_ratio": 1500, "repeat_ratio": 1000}


def _quality() -> str:
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{f}' AS feature, {f} AS v FROM f WHERE NOT base_failed"
        for f in _FEATURES)
    fences = ", ".join(
        f"max(CASE WHEN feature = '{f}' THEN q3 + 3 * greatest(q3 - q1, {s}) END) AS {f}_high"
        for f, s in _SPREAD.items())
    inside = " AND ".join(f"f.{f} <= t.{f}_high" for f in _FEATURES)

    def quartiles(keys: str) -> str:
        by = keys + ", " if keys else ""
        return f"""
        SELECT {by}feature, max(total) AS n, min(CASE WHEN 4 * upto >= total THEN b END) AS q1,
          min(CASE WHEN 4 * upto >= 3 * total THEN b END) AS q3
        FROM (SELECT {by}feature, b, sum(n) OVER (PARTITION BY {by}feature ORDER BY b) AS upto,
                sum(n) OVER (PARTITION BY {by}feature) AS total
              FROM (SELECT {by}feature, b, sum(n) AS n FROM s GROUP BY {by}feature, b))
        GROUP BY {by}feature"""
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid
           FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS x
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win)
          WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k)
        GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 100 // n_words END AS word_length,
        CASE WHEN n_words = 0 THEN 0 ELSE n_symbols * 10000 // n_words END AS symbol_ratio,
        CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 10000 // n_lines END AS dup_line_ratio,
        CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 10000 // n_words END AS repeat_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM c),
s AS (SELECT lang, source, feature, CASE WHEN v < 64 THEN v
          ELSE v | ((1::BIGINT << (length(bin(v)) - 6)::BIGINT) - 1) END AS b, count(*) AS n
      FROM ({values}) GROUP BY ALL),
own AS ({quartiles("lang, source")}), by_lang AS ({quartiles("lang")}), every AS ({quartiles("")}),
q AS (SELECT own.lang, own.source, own.feature,
        CASE WHEN own.n >= 100 THEN own.q1 WHEN by_lang.n >= 100 THEN by_lang.q1 ELSE every.q1 END AS q1,
        CASE WHEN own.n >= 100 THEN own.q3 WHEN by_lang.n >= 100 THEN by_lang.q3 ELSE every.q3 END AS q3
      FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang
        AND own.feature = by_lang.feature JOIN every ON own.feature = every.feature),
t AS (SELECT lang, source, {fences}, max(CASE WHEN feature = 'word_length'
        THEN q1 - 3 * greatest(q3 - q1, 100) END) AS low FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  {", ".join(_FEATURES)}, base_failed,
  NOT base_failed AND {inside} AND f.word_length >= t.low AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source"""


_DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i:i + 12], ' ') AS x
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 11, least(len(ws), 1) + 1))) AS i
             FROM b)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS x
       FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
occ AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.x = bw.x),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit
        FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS k FROM occ) GROUP BY rid),
it AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""

#: Kind, pattern, group with a least length, least length.
_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?"""
     r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
)


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS place, '{kind}' AS kind, length(m[i]) AS size,
        list_sum(list_transform(g[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos,
        length(o[i]) >= {least} AS ok
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT rid, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m,
            regexp_extract_all(t, '{pattern}', {group}) AS o
          FROM d WHERE regexp_matches(t, '{pattern if kind != "hex" else "[0-9a-f]{16}"}')))"""
        for k, (kind, pattern, group, least) in enumerate(_SECRETS))
    spelled = "kind || ':' || pos::BIGINT || ':' || (pos + size)::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
m AS (SELECT * FROM ({found}) WHERE ok),
s AS (SELECT rid, string_agg({spelled}, ',' ORDER BY pos, place) AS spans,
        string_agg({spelled}, ',' ORDER BY pos, place) FILTER (place < 3) AS base,
        count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
        count(*) FILTER (place = 2) AS n_hex FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)"""


#: CRC-32 of the decimal digits of conv_id, bit by bit.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda state, b: list_reduce([xor(state, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit:
    xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

_TRIE = f"""
WITH t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS s
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, md5(length(s.r) || ':' || s.r || s.t)) AS own
      FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC32} % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS s
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
n AS (SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth) AS ends
      FROM p GROUP BY ALL),
up AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0
        ELSE (n_convs - 1) * length(k[depth].t) END AS saved FROM n LEFT JOIN up USING (k)),
above AS (SELECT k[1:d] AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN above USING (k) LEFT JOIN n q ON q.k = f.k[1:f.depth - 1] AND f.depth > 0"""

_NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e
                     FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.rid, b.rid AS other FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid
        AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(rid, seen) AS (SELECT rid, rid FROM v
                     UNION SELECT r.rid, l.other FROM reach r JOIN l ON l.rid = r.seen),
c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.seen GROUP BY 1),
n AS (SELECT rid, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality(), "op8_decontamination": _DECONTAMINATION,
            "op9_secrets": _secrets(), "op12_conversation_trie": _TRIE,
            "op13_embedding_dedup": _NEAR_VECTORS}
