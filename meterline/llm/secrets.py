"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's pattern gives a Boolean trigram query: a disjunction of sets of trigrams, one of which a
text must hold completely to match. The index holds, for every trigram that a query names, the texts
that hold it (lower-cased). Postings are intersected per set by counting, the texts found are
verified by the pattern itself; a rule without a mandatory trigram scans every text.

Positions come from the lengths of the matches and of the texts between them, so they are code
points. Matches are leftmost and do not overlap within a rule; a rule may ask that a group of it has
a least length, and matches that fail are dropped after the search, not searched past.

Null texts are empty. Repeated rows are separate rows. Extra columns are left alone: the input stays
together as struct `row`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.tables import small_table

MOST_STRINGS = 64
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules first, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


# --- trigram queries -------------------------------------------------------------------------

def _strings(node) -> set[str] | None:
    """All strings that a part of a pattern can match, lower-cased, or None if they are many."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        out = set()
        for k, a in arg:
            if k is op.LITERAL:
                out.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence(arg[-1])
    if kind is op.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if kind is op.MAX_REPEAT and arg[1] <= 4:
        inner = _sequence(arg[2])
        if inner is not None:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _either(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    """Both of two queries, smallest sets only."""
    both = {x | y for x in a for y in b}
    return {x for x in both if not any(y < x for y in both)}


def _query(nodes) -> set[frozenset]:
    found: set[frozenset] = {frozenset()}
    run = {""}

    def close() -> None:
        nonlocal found, run
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        found = _either(found, {x for x in sets if not any(y < x for y in sets)})
        run = {""}

    for kind, arg in nodes:
        strings = _strings((kind, arg))
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        close()
        if kind is op.SUBPATTERN:
            found = _either(found, _query(arg[-1]))
        elif kind is op.MAX_REPEAT and arg[0] > 0:
            found = _either(found, _query(arg[2]))
        elif kind is op.BRANCH:
            sets = set().union(*(_query(x) for x in arg[1]))
            found = _either(found, {x for x in sets if not any(y < x for y in sets)})
    close()
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, one of which every match holds in lower case; one empty set: no filter."""
    return sorted(_query(parser.parse(pattern)), key=sorted)


# --- the scan --------------------------------------------------------------------------------

def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(h1, h2, kinds): the texts that the index gives for rules with mandatory trigrams; `kinds` has
    a bit for each rule."""
    sets = [(1 << n, f"{n}-{i}", t, len(s)) for n, r in enumerate(rules)
            for i, s in enumerate(trigram_query(r.pattern)) if s for t in sorted(s)]
    wanted = sorted({t for _, _, t, _ in sets})
    queries = small_table(texts.sparkSession, sets, T.StructType.fromDDL(
        "kinds long, clause string, trigram string, size long"))
    postings = texts.select(*KEY, F.lower("text").alias("low")).select(*KEY, F.explode(F.filter(
        F.array(*[F.lit(t) for t in wanted]), lambda t: F.col("low").contains(t))).alias("trigram"))
    full = (postings.distinct().join(F.broadcast(queries), "trigram")  # a row per trigram of a rule
            .groupBy(*KEY, "kinds", "clause", "size").count().where("count = size"))
    return full.groupBy(*KEY).agg(F.bit_or("kinds").alias("kinds"))


def _matches(rule: Rule):
    """(kind, gaps, sizes, ok): code points between matches and in them, and which matches count."""
    pattern = F.lit(rule.pattern)
    sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    return F.struct(
        F.lit(rule.kind).alias("kind"),
        F.transform(F.split("text", rule.pattern, -1), F.length).alias("gaps"),
        sizes.alias("sizes"), F.transform(tested, lambda n: n >= rule.least).alias("ok"))


def _simplified(rule: Rule) -> Rule:
    """A run of one class with a least length needs no dropped matches: the pattern can ask for the
    length, as a shorter run holds no longer one."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


def spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(h1, h2, kind, start, end) of every match in rows (h1, h2, text)."""
    rules = tuple(_simplified(r) for r in rules)
    whole = [r for r in rules if not all(trigram_query(r.pattern))]
    by_index = tuple(r for r in rules if r not in whole)
    parts = [texts.where(F.col("text").rlike(r.pattern)).select(*KEY, _matches(r).alias("m"))
             for r in whole]
    if by_index:
        found = stored(candidates(texts, by_index), "candidates")
        each = F.array(*[F.when(F.col("kinds").bitwiseAND(1 << n) > 0, _matches(r))
                         for n, r in enumerate(by_index)])
        parts.append(texts.join(found, KEY).select(*KEY, F.explode(F.filter(
            each, lambda m: m.isNotNull() & (F.size(m["sizes"]) > 0))).alias("m")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = rows.select(*KEY, "m.*").dropDuplicates([*KEY, "kind"])  # repeated rows share a key
    rows = rows.select(*KEY, "kind", F.posexplode(F.expr(
        "arrays_zip(slice(gaps, 1, size(sizes)), sizes, ok)")).alias("i", "x"))
    rows = rows.selectExpr(*KEY, "kind", "i", "x.`0` as gap", "x.sizes as size", "x.ok as ok")
    return rows.selectExpr(
        *KEY, "kind", "ok", "size",
        "sum(gap + size) over (partition by h1, h2, kind order by i) as end"
    ).where("ok").selectExpr(*KEY, "kind", "end - size as start", "end")


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` as struct `row`, with `spans`: structs (start, place, kind, end) by start,
    then by the rule's place in the list. Rows are known by 96 bits of hashes of id and text."""
    value = F.coalesce(text, F.lit(""))
    texts = docs.select(F.struct("*").alias("row"), value.alias("text"),
                        F.xxhash64(id_column, value).alias("h1"), F.hash(value, id_column).alias("h2"))
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    lists = spans(texts.select(*KEY, "text"), rules).groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.struct("start", place.alias("place"), "kind", "end"))).alias("spans"))
    return (texts.select(*KEY, "row").join(lists, KEY, "left")
            .withColumn("spans", F.expr("coalesce(spans, array())")).drop(*KEY))


def spelled(kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, comma-joined."""
    chosen = F.col("spans")
    if kinds is not None:
        chosen = F.filter(chosen, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
