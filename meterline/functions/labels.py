"""Mapping raw model output to one of the allowed labels.

The label list is a vocabulary (tens to hundreds of classes) that becomes a literal of the
expression; `vocabulary` in operators/labelling.py checks its size. For a vocabulary beyond that
bound use `normalize_by_join` there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.functions.text import canonical, once, strip

# Spellings of labels that models are known to return.
ALIASES = {
    "get_virtual_card": "getting_virtual_card",
    "top_up_by_card": "topping_up_by_card",
}
# Words too common in label names to score.
STOP_TOKENS = {
    "and", "consumer", "credit", "loan", "other", "personal", "product", "reported", "reporting",
    "reports", "service", "services",
}
QUOTES = "`'\" "
PUNCTUATION = "`'\".,:; "
THINKING = r"(?s)<think>.*?</think>"


def canonical_text(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", value.lower()).strip("_")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def candidates(output: Column, drop_thinking: bool = False) -> Column:
    """The whole cleaned output, then each of its words, in order."""
    if drop_thinking:
        text = F.regexp_replace(F.btrim(strip(output), F.lit(QUOTES)), THINKING, " ")
        words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_?]+"), F.lit(0))
        listed = F.concat(F.array(text), words)
        return F.transform(listed, lambda c: F.btrim(strip(c), F.lit(PUNCTUATION)))
    text = F.btrim(strip(output), F.lit(QUOTES))
    words = F.regexp_extract_all(text, F.lit(r"[a-zA-Z][a-zA-Z0-9_?]+"), F.lit(0))
    return F.concat(F.array(text), words)


def normalize_label(output: Column, labels: list[str], drop_thinking: bool = False) -> Column:
    """First candidate that is a label or an alias of one; NULL if none is.

    `array_intersect` keeps the order of its first argument and hashes the second, so a long
    output costs one pass however many labels there are."""
    known = set(labels)
    aliases = {a: label for a, label in ALIASES.items() if label in known}
    accepted = sorted(known | set(aliases))
    if not accepted:
        return F.lit(None).cast("string")
    hits = F.array_intersect(candidates(output, drop_thinking), F.array(*map(F.lit, accepted)))
    first = F.try_element_at(hits, F.lit(1))
    return F.coalesce(_lookup(aliases, first), first)


def normalize_label_canonical(output: Column, labels: list[str]) -> Column:
    """As above, but a candidate also matches by its canonical form, and as a last resort the first
    label whose canonical form occurs in the canonical output."""
    ordered = sorted(set(labels))
    if not ordered:
        return F.lit(None).cast("string")
    by_form = {canonical_text(label): label for label in ordered}
    spellings = F.array(*map(F.lit, by_form))

    def plain(word: Column) -> Column:
        return ~(word.contains("_") | word.contains("-") | word.contains("/"))

    def by_words(words: Column) -> Column:
        # A word of letters and digits only is canonical once in lower case.
        forms = F.transform(words, lambda w: F.when(plain(w), F.lower(w)).otherwise(canonical(w)))
        return once(forms, lambda known: once(
            F.try_element_at(F.array_intersect(known, spellings), F.lit(1)),
            lambda hit: once(
                F.btrim(F.try_element_at(words, F.array_position(known, hit).cast("int")), F.lit(PUNCTUATION)),
                lambda spelled: F.when(hit.isNotNull() & spelled.isin(ordered), spelled)
                .otherwise(_lookup(by_form, hit)))))

    def by_whole(cleaned: Column, whole: Column) -> Column:
        named = F.btrim(strip(cleaned), F.lit(PUNCTUATION))
        words = F.regexp_extract_all(cleaned, F.lit(r"[A-Za-z][A-Za-z0-9_/-]+"), F.lit(0))
        inside = [F.when(whole.contains(form), F.lit(label)) for form, label in by_form.items() if form]
        return F.coalesce(
            once(named, lambda n: F.when(n.isin(ordered), n)),
            F.when(whole.isin(list(by_form)), _lookup(by_form, whole)), once(words, by_words), *inside)

    return once(F.regexp_replace(strip(output), THINKING, " "),
                lambda cleaned: once(canonical(cleaned), lambda whole: by_whole(cleaned, whole)))


def best_label_by_words(output: Column, text: Column, labels: list[str]) -> Column:
    """Label sharing most words with the output and the request: 3 points per word of the label
    found as a word, 1 if only its first five letters occur. First label wins a tie."""
    ordered = sorted(set(labels))
    hay = canonical(F.concat(output, F.lit(" "), text))
    words = F.concat(F.lit("_"), hay, F.lit("_"))

    def score(label: str) -> Column:
        tokens = [t for t in canonical_text(label).split("_")
                  if len(t) > 2 and t not in STOP_TOKENS]
        points = F.lit(0)
        for t in tokens:
            points = points + F.when(words.contains(f"_{t}_"), 3) \
                .when(hay.contains(t[:5]), 1).otherwise(0)
        return points

    scored = F.array(*[
        F.struct(score(label).alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))
        for i, label in enumerate(ordered)])
    return F.array_max(scored)["label"]
