"""What a server of stored arrays decides for a request, as column expressions: byte ranges and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import Grid, chunk_key_column

#: Fixed value: the largest position of a byte.
LAST = 2**63 - 1


def range_request(header: Column, size: Column) -> Column:
    """struct(status, start, stop) for a Range header and a value's size.

    One range of bytes that the value has some of is 206, with its end clamped; one that
    names nothing of it is 416, without bounds. Anything else is ignored: 200, all bytes.
    """
    form = r"^bytes=(\d*)-(\d*)$"
    number = lambda k: F.least(F.regexp_extract(header, form, k).try_cast("decimal(38,0)"), F.lit(LAST).cast("decimal(38,0)")).cast("long")
    digits = lambda k: F.length(F.regexp_extract(header, form, k)) > 0
    size, zero = size.cast("long"), F.lit(0).cast("long")
    first, last = number(1), number(2)
    # of more than 38 digits no decimal is left, and no value is that long
    first, last = (F.coalesce(x, F.lit(LAST)) for x in (first, last))
    suffix, offset = ~digits(1) & digits(2), digits(1) & ~digits(2)
    start = F.when(suffix, F.greatest(zero, size - last)).otherwise(first)
    stop = F.when(suffix | offset, size).otherwise(F.least(size, F.when(last == LAST, last).otherwise(last + 1)))
    named = F.coalesce(header.rlike(form) & (digits(1) | digits(2)), F.lit(False))
    held = F.when(suffix, (last > 0) & (size > 0)).otherwise((start < stop) & (start < size))
    answer = lambda status, a, b: F.struct(F.lit(status).alias("status"), a.cast("long").alias("start"), b.cast("long").alias("stop"))
    none = F.lit(None)
    return F.when(~named, answer(200, zero, size)).when(held, answer(206, start, stop)).otherwise(answer(416, none, none))


def is_chunk_key(key: Column, grid: Grid, style: str = "default", separator: str | None = None) -> Column:
    """True for keys of chunks that the grid has, spelled as they are stored: no sign, no leading zeros, no blanks."""
    counts: Sequence[int] = grid.chunk_counts
    if not counts:
        return key == ("c" if style == "default" else "0")
    parts = F.split(key, "[" + (separator or ("/" if style == "default" else ".")) + "]", -1)
    lead = 1 if style == "default" else 0
    coords = [F.get(parts, F.lit(k + lead)).try_cast("long") for k in range(len(counts))]
    inside = F.size(parts) == len(counts) + lead
    for c, n in zip(coords, counts, strict=True):
        inside = inside & (c >= 0) & (c < n)
    return F.coalesce(inside & (key == chunk_key_column(coords, style, separator)), F.lit(False))
