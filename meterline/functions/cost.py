"""Token, price, hash and bucket arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(n_bytes: Column) -> Column:
    """One token per started four bytes."""
    return F.ceil(n_bytes / F.lit(4)).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    million = F.lit(1_000_000.0)
    return (tokens_in / million) * price_in + (tokens_out / million) * price_out


def savings_usd(teacher_cost: Column, cost: Column) -> Column:
    return F.greatest(teacher_cost - cost, F.lit(0.0))


def content_hash(body: Column, fallback: Column, log_mode: str) -> Column:
    if log_mode in ("metadata_only", "disabled"):
        return F.lit(None).cast("string")
    content = F.when(F.octet_length(body) > 0, body.cast("binary")) \
        .otherwise(fallback.cast("binary"))
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def hash_bucket(key: Column, salt: str) -> Column:
    """Stable uniform bucket 0..99. Each use has a salt of its own, so that for instance the
    canary share and the training share of the requests do not coincide."""
    prefix = F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8)
    return F.conv(prefix, 16, 10).cast("long") % 100


def round_half_up(x: Column, digits: int) -> Column:
    """Round the binary value, not its decimal spelling: 1.005 is below 1.005 and goes to 1.0."""
    scale = F.lit(float(10 ** digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale


def ratio(part: Column, whole: Column, digits: int | None = 6) -> Column:
    r = F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
    return r if digits is None else round_half_up(r, digits)
