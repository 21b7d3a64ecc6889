"""Codecs as column expressions: what they do to cells stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MetadataError
from ..model import ArrayFrame
from ..operators.levels import previous

#: Least and greatest of the integer types.
RANGES = {f"{s}int{b}": ((0, 2**b - 1) if s else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for s in ("", "u") for b in (8, 16, 32, 64)}


def transposed(a: ArrayFrame, order: Sequence[int]) -> ArrayFrame:
    """Axes in another order: names change, no cell moves."""
    if sorted(order) != list(range(a.spec.ndim)):
        raise MetadataError("an order lists each axis once")
    from ..grid import Grid

    cells = a.cells.select(*(F.col(a.dims[k]).alias(f"d{i}") for i, k in enumerate(order)), *a.values)
    return ArrayFrame(cells, type(a.spec)(Grid(tuple(a.spec.grid.axes[k] for k in order)), a.spec.dtype, a.spec.fill), a.values)


def scale_offset_encode(x: Column, scale: Any, offset: Any) -> Column:
    """(x - offset) * scale; overflow is an error."""
    return (x - F.lit(offset)) * F.lit(scale)


def scale_offset_decode(x: Column, scale: Any, offset: Any, integer: bool = False) -> Column:
    """x / scale + offset; integers must divide exactly."""
    if not integer:
        return x / F.lit(scale) + F.lit(offset)
    exact = F.when(x % F.lit(scale) != 0, F.raise_error(F.lit("the encoded value isn't a multiple of the scale")).cast("long")).otherwise(F.call_function("div", x, F.lit(scale).cast("long")))
    return exact + F.lit(offset)


def rounded(x: Column, mode: str) -> Column:
    if mode == "nearest-even":
        return F.bround(x, 0)
    if mode == "towards-zero":
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    if mode == "towards-positive":
        return F.ceil(x).cast("double")
    if mode == "towards-negative":
        return F.floor(x).cast("double")
    if mode == "nearest-away":
        return F.round(x, 0)
    raise MetadataError(f"no rounding {mode!r}")


def cast_value(x: Column, dtype: str, spark_type: str, rounding: str = "nearest-even", out_of_range: str | None = None, scalar_map: Sequence[tuple[Any, Any]] = (), floating: bool = True) -> Column:
    """A cast that rounds, and outside of the target's range raises, clamps or wraps; listed values go to listed values first.
    NaN raises, whatever the mode, unless it is listed."""
    low, high = RANGES[dtype]
    y = rounded(x, rounding) if floating else x
    if out_of_range == "clamp":
        y = F.greatest(F.lit(low), F.least(F.lit(high), y))
    elif out_of_range == "wrap":
        span = high - low + 1
        y = F.pmod(y - low, F.lit(span)) + low
    else:
        y = F.when((y < low) | (y > high), F.raise_error(F.lit(f"a value is out of the range of {dtype}")).cast("double")).otherwise(y)
    if floating:
        y = F.when(F.isnan(x), F.raise_error(F.lit(f"NaN has no value in {dtype}")).cast("double")).otherwise(y)
    out = y.cast(spark_type)
    for source, target in reversed(list(scalar_map)):
        hit = F.isnan(x) if isinstance(source, float) and source != source else x == F.lit(source)
        out = F.when(hit, F.lit(target).cast(spark_type)).otherwise(out)
    return out


def delta_encoded(df: DataFrame, value: str, position: str, chunk: Sequence[Column] = (), name: str = "delta") -> DataFrame:
    """Differences to the cell before, the first of each chunk kept; the window is of one chunk."""
    w = Window.partitionBy(*chunk).orderBy(position) if chunk else Window.orderBy(position)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_across(df: DataFrame, value: str, position: str, size: int, name: str = "delta") -> DataFrame:
    """Differences along a whole axis with no one-task sort: within chunks by window, across their borders by the last cell of
    the chunk before that has any."""
    c = F.call_function("div", F.col(position), F.lit(size).cast("long"))
    w = Window.partitionBy("__c").orderBy(position)
    df = df.withColumn("__c", c)
    lasts = previous(df.groupBy("__c").agg(F.max_by(value, position).alias("__own")), "__c", "__own", "__last").drop("__own")
    before = F.coalesce(F.lag(value).over(w), F.when(F.row_number().over(w) == 1, F.col("__last")), F.lit(0))
    return df.join(lasts, "__c", "left").withColumn(name, F.col(value) - before).drop("__c", "__last")


def delta_decoded(df: DataFrame, delta: str, position: str, chunk: Sequence[Column], name: str = "v") -> DataFrame:
    w = Window.partitionBy(*chunk).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(delta).over(w))


def fixed_scale_offset(x: Column, scale: Any, offset: Any, spark_type: str) -> Column:
    return F.bround((x - F.lit(offset)) * F.lit(scale), 0).cast(spark_type)


def fixed_scale_offset_decoded(x: Column, scale: Any, offset: Any) -> Column:
    return x / F.lit(scale) + F.lit(offset)


def quantized(x: Column, digits: int) -> Column:
    """Rounded to the power of two that keeps so many decimal digits."""
    import math

    bits = math.ceil(math.log2(10.0**digits))
    return F.bround(x * F.lit(2.0**bits), 0) / F.lit(2.0**bits)


def packed_bits(df: DataFrame, value: str, position: str) -> DataFrame:
    """Eight booleans to a byte, the first highest: (byte, bits)."""
    p = F.col(position)
    bit = F.call_function("shiftleft", F.col(value).cast("int"), (7 - p % 8).cast("int"))
    return df.groupBy(F.call_function("div", p, F.lit(8).cast("long")).alias("byte")).agg(F.sum(bit).cast("smallint").alias("bits"))
