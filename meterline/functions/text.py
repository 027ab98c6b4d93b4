"""Redaction, clean-up and extraction over text columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters removed at both ends of a cleaned text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What counts as an address, a secret field, a bearer token and an API key, and
# what each is replaced with. Applied in this order.
#
# The address pattern starts only where no address character precedes it (or right after the
# previous match), so that a long unbroken run such as an inlined hex blob is walked once and not
# once per character.
EMAIL = (
    r"(?i)(?:(?<![A-Z0-9._%+-])|\G)[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"
)
SECRET_FIELD = (
    r'(?i)(?U)("?(?:api[_-]?key|password|secret|token|authorization)"?\s*:\s*")([^"]*)(")'
)
BEARER = r"(?i)(?U)\bBearer\s+[A-Za-z0-9._~+/=-]+"
API_KEY = r"(?U)\bsk-[A-Za-z0-9_-]{12,}\b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value computed once per row however often `use` names it. A plain column is
    a formula that the optimizer copies to each place, and it is computed again in each branch."""
    return F.transform(F.array(value), use)[0]


def squeeze(text: Column) -> Column:
    """Trim and turn every run of white space into one space."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def redact(text: Column) -> Column:
    """Replace addresses, secret fields, bearer tokens and API keys.

    Each pattern runs only on texts that hold a word without which it cannot match; a plain
    substring search is many times faster than the pattern. The words are looked up in the original
    text, since no replacement brings one in."""
    low = F.lower(text)

    def replaced(x: Column, words: tuple[str, ...], pattern: str, replacement: str) -> Column:
        possible = reduce(or_, [(low if w != "sk-" else text).contains(w) for w in words])
        return F.when(possible, F.regexp_replace(x, pattern, replacement)).otherwise(x)

    x = replaced(text, ("@",), EMAIL, "[REDACTED_EMAIL]")
    x = replaced(x, ("key", "password", "secret", "token", "authorization"), SECRET_FIELD,
                 "$1[REDACTED]$3")
    x = replaced(x, ("bearer",), BEARER, "Bearer [REDACTED]")
    return replaced(x, ("sk-",), API_KEY, "sk-[REDACTED]")


def body_text(body: Column, is_binary: bool = False) -> Column:
    """Body as text; bytes that are not UTF-8 become the replacement character."""
    return F.make_valid_utf8(body.cast("string")) if is_binary else body


def redacted_body(body: Column, log_mode: str, is_binary: bool = False) -> Column:
    """Redacted body; NULL when the body is empty or the mode does not keep content."""
    if log_mode != "redacted":
        return F.lit(None).cast("string")
    return F.when(F.octet_length(body) > 0, redact(body_text(body, is_binary)))


def slugify(text: Column) -> Column:
    return canonical(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")))


def canonical(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one underscore, none at the
    ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def truncate(text: Column, max_chars: int) -> Column:
    return text if max_chars <= 0 else F.substring(text, 1, max_chars)


def day_of(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 10)


def parse_timestamp(timestamp: Column) -> Column:
    """RFC 3339 text as an instant; no zone means UTC, anything unreadable is NULL."""
    colon_zone = F.regexp_replace(timestamp, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    has_zone = timestamp.rlike(r"(?:Z|:\d{2}(?:\.\d+)?[+-]\d{2}:?\d{2})$")
    no_time = timestamp.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.try_to_timestamp(
        F.when(has_zone, colon_zone)
        .when(no_time, F.concat(timestamp, F.lit("T00:00:00Z")))
        .otherwise(F.concat(timestamp, F.lit("Z")))
    )


# --- JSON bodies -----------------------------------------------------------------------------

_CHOICES = "choices array<struct<message:struct<content:string>,text:string>>"
_MESSAGES = "messages array<string>"


def completion_target(response: Column) -> Column:
    """Answer text of a completion response; the response itself if it holds none."""
    return F.coalesce(
        F.get_json_object(response, "$.choices[0].message.content"),
        F.get_json_object(response, "$.choices[0].text"),
        response,
    )


def completion_label(response: Column) -> Column:
    """Answer text only where it is a JSON string, trimmed; NULL otherwise."""
    parsed = F.try_parse_json(response)
    return strip(F.coalesce(_string_at(parsed, "$.choices[0].message.content"),
                            _string_at(parsed, "$.choices[0].text")))


def _string_at(parsed: Column, path: str) -> Column:
    """The value at a path of a parsed document where it is a JSON string; NULL otherwise."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(parsed, path, "string"))


def messages_of(body: Column) -> Column:
    """Role and content of each message; an element that is no object has neither, and the others
    are still read."""
    return F.transform(F.from_json(body, _MESSAGES)["messages"],
                       lambda m: F.from_json(m, "role string, content string"))


def user_content(body: Column) -> Column:
    """All user turns of a chat body, one per line; the body itself if it has none."""
    turns = F.filter(
        messages_of(body), lambda m: (m["role"] == "user") & m["content"].isNotNull()
    )
    return F.when(
        F.size(turns) > 0, F.array_join(F.transform(turns, lambda m: m["content"]), "\n")
    ).otherwise(body)


def last_user_content(body: Column) -> Column:
    """`prompt` if it is a string, else the last user turn whose content is one, trimmed."""
    turns = F.transform(F.from_json(body, _MESSAGES)["messages"], F.try_parse_json)
    said = F.filter(
        F.transform(turns, lambda m: F.when(_string_at(m, "$.role") == "user",
                                            _string_at(m, "$.content"))),
        lambda content: content.isNotNull())
    return strip(F.coalesce(_string_at(F.try_parse_json(body), "$.prompt"),
                            F.try_element_at(said, F.lit(-1))))


def infer_input(body: Column) -> Column:
    """First non-empty of `input`, `prompt`, `text`; else the body."""
    fields = [F.nullif(F.get_json_object(body, f"$.{f}"), F.lit(""))
              for f in ("input", "prompt", "text")]
    return F.coalesce(*fields, body)


def chat_input(body: Column, user_only: bool = False) -> Column:
    """Contents of the messages that are objects, one per line; the body itself if it is no chat."""
    raw = F.try_variant_get(F.try_parse_json(body), "$.messages", "array<variant>")
    objects = F.transform(raw, lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    turns = F.filter(messages_of(body), lambda m, i: F.get(objects, i))
    if user_only:
        turns = F.filter(turns, lambda m: m["role"] == "user")
    joined = F.array_join(F.transform(turns, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return F.coalesce(joined, body)


def completion_input(body: Column) -> Column:
    is_object = body.rlike(r"^\s*\{")
    return F.when(is_object, F.coalesce(F.get_json_object(body, "$.prompt"), F.lit(""))) \
        .otherwise(body)


def input_text(body: Column, input_format: str, max_chars: int = 0) -> Column:
    if input_format not in ("raw", "openai_user_content"):
        raise ValueError(f"unknown input format: {input_format!r}")
    text = body if input_format == "raw" else user_content(body)
    return truncate(text, max_chars)


# --- prompts ---------------------------------------------------------------------------------

def label_prompt(task_description: str, labels: list[str] | Column, text: Column) -> Column:
    """`labels` is a list, or an array column. The lines around them are fixed values."""
    if not isinstance(labels, Column):
        labels = F.array(*[F.lit(label) for label in labels])
    lines = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    head = "\nReturn exactly one label from the allowed list. Do not explain.\n\nAllowed labels:\n"
    return F.concat(F.lit(task_description.strip() + head), lines, F.lit("\n\nText:\n"), text,
                    F.lit("\n\nLabel:"))


def complaint_text(narrative: Column, issue: Column, sub_product: Column) -> Column:
    def line(prefix: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(prefix), value)).otherwise("")

    return F.concat(
        F.lit("Consumer complaint narrative:\n"), narrative,
        line("\n\nReported issue: ", issue), line("\nReported sub-product: ", sub_product),
    )
