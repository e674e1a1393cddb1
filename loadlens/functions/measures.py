"""Column expressions on sizes, times and rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIB = 1_048_576


def mib_per_s(size: Column, usec: Column) -> Column:
    """Rate in MiB/s of ``size`` bytes in ``usec`` microseconds; NULL at time 0."""
    return size / F.nullif(usec, F.lit(0)) * (1_000_000 / MIB)


def mbit_per_s(size: Column, usec: Column) -> Column:
    """Rate in Mbit/s; NULL at time 0."""
    return size * 8 / F.nullif(usec, F.lit(0))


def per_second(amount: Column, usec: Column) -> Column:
    """Amount per second over ``usec`` microseconds; NULL at time 0."""
    return amount * 1_000_000 / F.nullif(usec, F.lit(0))


def bucket_ms(start_us: Column, width_ms: int) -> Column:
    """Start, in epoch milliseconds, of the interval a time falls into."""
    width = F.lit(width_ms * 1000)
    return ((start_us - F.pmod(start_us, width)) / 1000).cast("bigint")


def size_class(size: Column) -> Column:
    """Largest power of two that is not above ``size`` (0 stays 0)."""
    whole = size.cast("bigint")
    bits = F.length(F.bin(whole)) - 1
    return F.when(whole > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)).otherwise(
        F.lit(0).cast("bigint")
    )
