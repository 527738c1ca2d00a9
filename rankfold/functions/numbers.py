"""Hash-derived random numbers, sampled content hashes, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone, so on no partitioning; from MD5, which every engine has."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform_sql(key: str, seed: int) -> str:
    """The same in SQL."""
    return f"((CAST(CAST('0x' || substr(md5({key} || ':{seed}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)"


def race_key(score: Column, temperature: float, u: Column) -> Column:
    """Sort descending: draws without replacement, each in proportion to max(score, 1e-9) ** (1 / temperature)."""
    return F.ln(F.greatest(score, F.lit(1e-9))) / F.lit(float(temperature)) - F.ln(-F.ln(u))


def sampled_hash(content: Column, block: int = 1 << 20, samples: int = 5) -> Column:
    """MD5 of the whole content if it has few blocks, else of evenly spaced blocks and the size."""
    size = F.octet_length(content)
    step = F.floor((size - block) / (samples - 1))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substring(content, (F.when(k == samples - 1, size - block).otherwise(k * step) + 1).cast("int"), F.lit(block)))
    return F.when(size <= block * samples, F.md5(content)).otherwise(F.md5(F.concat_ws("|", F.array_join(blocks, "|"), size.cast("string"))))


def number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
