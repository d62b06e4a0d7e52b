"""Columns to bytes and back: big-endian integers of any width, and IEEE floats in native order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_int(value: Column, width: int = 8) -> Column:
    """The ``width`` low bytes, most significant first."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width))


def decode_int(data: Column, width: int = 8) -> Column:
    """The signed integer of ``width`` bytes."""
    digits = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    half, whole = F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)"), F.lit(str(1 << (8 * width))).cast("decimal(20,0)")
    return F.when(digits >= half, digits - whole).otherwise(digits).cast("bigint")


@F.pandas_udf(T.BinaryType())
def _to_bytes(values: pd.Series) -> pd.Series:
    data = values.to_numpy(np.float64, na_value=np.nan).tobytes()
    return pd.Series([data[i : i + 8] for i in range(0, len(data), 8)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _from_bytes(data: pd.Series) -> pd.Series:
    return pd.Series(np.frombuffer(b"".join(data), np.float64))


def encode_double(value: Column) -> Column:
    """The eight bytes of a double in the machine's order; null for null."""
    return F.when(value.isNotNull(), _to_bytes(F.coalesce(value.cast("double"), F.lit(0.0))))


def decode_double(data: Column) -> Column:
    """The double of eight bytes; null for null."""
    return F.when(data.isNotNull(), _from_bytes(F.coalesce(data, F.lit(b"\0" * 8))))
