"""Stable hashes for bucketing: FNV-1a, experiment buckets, exploration draws, name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits, offset basis and prime as 32-bit halves
BASIS_HIGH, BASIS_LOW = 0xCBF29CE4, 0x84222325
PRIME_HIGH, PRIME_LOW = 0x100, 0x1B3
EXPLORE_RATE = 0.1


def fnv1a64(text: Column) -> Column:
    """Struct (high, low) of unsigned 32-bit halves: the full product would overflow a long, which ANSI mode refuses."""
    data = F.encode(text, "UTF-8")
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low"))

    def step(state: Column, at: Column) -> Column:
        low = state["low"].bitwiseXOR(F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long"))
        product = low * PRIME_LOW
        high = (state["high"] * PRIME_LOW + low * PRIME_HIGH + F.shiftright(product, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(high.alias("high"), product.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))

    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def bucket(salt: Column, subject: Column) -> Column:
    """0 to 99, of the salt, a zero byte and the subject."""
    h = fnv1a64(F.concat(salt, F.lit("\x00"), subject))
    return (((h["high"] % 100) * (2**32 % 100) + h["low"] % 100) % 100).cast("int")


def exploration_draw(seed: Column, pool: Column, rate: float = EXPLORE_RATE) -> Column:
    """Struct (fires, index): the low 14 bits decide, bits from the 20th on choose from the pool."""
    h = fnv1a64(seed)
    draw = h["low"].bitwiseAND(F.lit(0x3FFF)) / float(0x4000)
    above = h["high"] * 4096 + F.shiftright(h["low"], 20)  # 44 bits
    return F.struct(((draw < rate) & (pool > 0)).alias("fires"), F.when(pool > 0, above % F.greatest(pool, F.lit(1))).otherwise(F.lit(0)).cast("int").alias("index"))


def uuid_v5(namespace: str, name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def utc_day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def subject(user_id: Column, session_id: Column, nobody: str = "") -> Column:
    return F.coalesce(user_id.cast("string"), F.nullif(session_id, F.lit("")), F.lit(nobody))
