"""Scalar functions of the engine as column expressions, and their driver-side twins for manifest decisions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_HEADER_BYTES = 9  # operation byte and two 32-bit lengths
VREF_BYTES = 12  # a value reference in a leveled size estimate


def user_bytes(key: Column, value: Column) -> Column:
    """Bytes the caller wrote: key and value; a delete has an empty value."""
    return F.octet_length(key).cast("long") + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def log_bytes(key: Column, value: Column) -> Column:
    """Bytes of one log record."""
    return user_bytes(key, value) + F.lit(LOG_HEADER_BYTES)


def record_bytes(key: Column, value: Column, separated: Column) -> Column:
    """Estimated bytes of one run record: a separated value counts as its reference."""
    return F.octet_length(key).cast("long") + LOG_HEADER_BYTES + F.when(separated, F.lit(VREF_BYTES)).otherwise(F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def size_bucket(size: Column, ratio: float = 2.0) -> Column:
    """Logarithmic size class; ln/ln, because two-argument log rounds exact powers differently."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(float(ratio)))).cast("long")


def size_bucket_of(size: int, ratio: float = 2.0) -> int:
    return math.floor(math.log(float(max(size, 1))) / math.log(ratio))


def bloom_bits(n: Column, fpp: float = 0.01) -> Column:
    """Bits of an optimal Bloom filter for n entries, at least 1; an impossible rate counts as 1 %."""
    p = fpp if 0 < fpp < 1 else 0.01
    return F.greatest(F.lit(1), F.ceil(-n.cast("double") * F.log(F.lit(p)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))).cast("long")


def bloom_hashes(bits: Column, n: Column) -> Column:
    """Hash functions of an optimal Bloom filter, from 1 to 30."""
    return F.least(F.lit(30), F.greatest(F.lit(1), F.round(bits.cast("double") / F.greatest(n, F.lit(1)) * F.log(F.lit(2.0))))).cast("int")


def level_budget(level: Column, first: float, ratio: float = 2.0) -> Column:
    """Bytes a level may hold: `first` for level 1, times `ratio` for each further one."""
    return (F.lit(first) * F.pow(F.lit(float(ratio)), level - 1)).cast("long")


def level_budget_of(level: int, first: float, ratio: float = 2.0) -> float:
    return first * ratio ** (level - 1)


def padded_key(i: Column, prefix: str = "key", width: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), width, "0"))


def run_name(seq: int) -> str:
    return f"run-{seq:06d}"


def sequence_of(name: str) -> int | None:
    """The number in a run's or generation's name, or None."""
    m = re.search(r"(?:run|gen)[-=](\d+)", name)
    return int(m[1]) if m else None


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit."""
    kib, mib = 1024.0, 1024.0**2
    x = n.cast("double")
    return F.when(x < kib, F.format_string("%d B", n.cast("long"))).when(x < mib, F.format_string("%.1f KiB", x / kib)).otherwise(F.format_string("%.2f MiB", x / mib))
