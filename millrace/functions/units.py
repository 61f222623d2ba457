"""Sensor and memory units, and the rounding of log numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Splits a double into two halves whose products are exact.
_SPLITTER = float(2**27 + 1)


def celsius(milli_celsius: Column, tenth_kelvin: Column, kelvin: Column) -> Column:
    """Degrees Celsius from the first source that has a reading."""
    return F.coalesce(
        milli_celsius / 1000.0,
        tenth_kelvin / 10.0 - F.lit(273.15),
        kelvin - F.lit(273.15),
    )


def mebibytes(size: Column) -> Column:
    return size / (1024 * 1024)


def round_exact(value: Column, places: int) -> Column:
    """Round a double as Python's ``round`` does: by its binary value, ties to even.

    Spark rounds the shortest decimal text instead: 2.675 to 2.68, though its binary
    value lies below. Here ``value`` times the power of ten is worked out without
    loss, as a product and its error, and compared with the middle.
    """
    power = float(10**places)
    value = value.cast("double")
    high = value * _SPLITTER - (value * _SPLITTER - value)
    low = value - high
    power_high = power * _SPLITTER - (power * _SPLITTER - power)
    power_low = power - power_high
    product = value * power
    error = ((high * power_high - product) + high * power_low + low * power_high) + low * power_low
    below = F.floor(product).cast("double")
    over = (product - below - 0.5) + error
    odd = F.pmod(below, F.lit(2.0)) == 1
    return (below + F.when((over > 0) | ((over == 0) & odd), 1.0).otherwise(0.0)) / power
