"""Number tests and the storage type they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_integral(x: Column) -> Column:
    return x == F.rint(x)


def fits_float32(x: Column) -> Column:
    """True when the significand of ``x`` needs no more than 24 bits.

    The exponent's range is not tested: dividing by the power of two below ``x`` leaves a
    value near 1, so 2^200 passes although a float cannot hold it. Subnormals have no
    leading one, so they pass when they are multiples of 2^-1045.
    """
    magnitude = F.abs(x)
    exponent = F.least(F.floor(F.log2(magnitude)), F.lit(1023))
    mantissa = magnitude / F.pow(F.lit(2.0), exponent)
    tiny = magnitude * F.lit(2.0**60) * F.lit(2.0**985)
    return (
        F.when(x == 0, F.lit(True))
        .when(magnitude < 2.0**-1022, tiny == F.rint(tiny))
        .otherwise(mantissa.cast("float").cast("double") == mantissa)
    )


def storage_type(integral: Column, float32: Column, low: Column, high: Column) -> Column:
    """Smallest type for a numeric column, given its range. Both bounds are used."""
    signed = (
        F.when((low >= -(2.0**7)) & (high <= 2.0**7 - 1), "int8")
        .when((low >= -(2.0**15)) & (high <= 2.0**15 - 1), "int16")
        .when((low >= -(2.0**31)) & (high <= 2.0**31 - 1), "int32")
        .otherwise("int64")
    )
    unsigned = (
        F.when(high <= 2.0**8 - 1, "uint8")
        .when(high <= 2.0**16 - 1, "uint16")
        .when(high <= 2.0**32 - 1, "uint32")
        .otherwise("uint64")
    )
    return (
        F.when(integral & (low < 0), signed)
        .when(integral, unsigned)
        .when(float32, "float32")
        .when(~float32, "float64")
    )


def number_text(x: Column, integral: Column) -> Column:
    """Report form: no decimals for an integral field, six otherwise."""
    whole = x.cast("decimal(38,0)").cast("string")
    return F.when(integral & (F.abs(x) < 1e37), whole).otherwise(
        F.format_string("%.6f", x)
    )
