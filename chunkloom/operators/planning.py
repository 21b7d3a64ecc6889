"""Which chunks a selection touches, which parts of them, and whether it covers them whole."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import FixedAxis, Grid
from .levels import previous, running_sum
from .selection import expand_ellipsis, is_integer, normalized_index, slice_bounds


def axis_projection(spark: SparkSession, axis: FixedAxis, start: int, stop: int, step: int, k: int = 0) -> DataFrame:
    """A row for each chunk that a strided slice touches: c, sel_start, sel_stop (within the chunk), out_start, out_stop, is_complete."""
    c, size = f"c{k}", axis.size
    if stop <= start:
        first, last = 0, -1
    else:
        first, last = start // size, (start + (stop - 1 - start) // step * step) // size
    df = spark.range(first, last + 1).withColumnRenamed("id", c)
    base = F.col(c) * size
    ahead = F.greatest(F.lit(0).cast("long"), base - start)
    out_start = F.call_function("div", ahead + (step - 1), F.lit(step).cast("long"))
    df = df.withColumn(f"out_start{k}", out_start)
    sel_start = F.lit(start) + F.col(f"out_start{k}") * step - base
    data = F.least(F.lit(size).cast("long"), F.lit(axis.extent).cast("long") - base)
    sel_stop = F.least(data, F.lit(stop).cast("long") - base)
    df = df.withColumn(f"sel_start{k}", sel_start).withColumn(f"sel_stop{k}", sel_stop).filter(F.col(f"sel_start{k}") < F.col(f"sel_stop{k}"))
    n = F.call_function("div", F.col(f"sel_stop{k}") - F.col(f"sel_start{k}") + (step - 1), F.lit(step).cast("long"))
    complete = (F.col(f"sel_start{k}") == 0) & (F.col(f"sel_stop{k}") == data) & F.lit(step == 1)
    return df.withColumn(f"out_stop{k}", F.col(f"out_start{k}") + n).withColumn(f"is_complete{k}", complete)


def chunk_projections(spark: SparkSession, grid: Grid, selection: Any) -> DataFrame:
    """All chunks that a selection of slices and integers touches: the product of the axes' projections, each a few rows."""
    out: DataFrame | None = None
    for k, (axis, x) in enumerate(zip(grid.axes, expand_ellipsis(selection, len(grid.axes)), strict=True)):
        if not isinstance(axis, FixedAxis):
            raise TypeError("projections are of regular grids")
        if is_integer(x):
            i = normalized_index(x, axis.extent)
            own = axis_projection(spark, axis, i, i + 1, 1, k)
        else:
            own = axis_projection(spark, axis, *slice_bounds(x, axis.extent), k)
        out = own if out is None else out.join(own)
    complete = F.lit(True)
    for k in range(len(grid.axes)):
        complete = complete & F.col(f"is_complete{k}")
    return out.withColumn("is_complete", complete)


def coverage(cells: DataFrame, dim: str, size: int, extent: int, origin: int) -> DataFrame:
    """Coverage counted from the selected cells themselves: a chunk is complete if all its cells are there."""
    d, n = F.col(dim), F.lit(size).cast("long")
    c = F.call_function("div", d, n)
    return cells.groupBy(c.alias("c0")).agg(
        F.min(d % n).alias("sel_start"),
        (F.max(d % n) + 1).alias("sel_stop"),
        (F.min(d) - origin).alias("out_start"),
        (F.count(F.lit(1)) == F.least(n, F.lit(extent).cast("long") - F.first(c) * n)).alias("is_complete"),
    )


def coordinate_groups(points: DataFrame, dims: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """How many points fall into each chunk, and the running count: points are counted before anything is ordered, and
    chunks are ordered within cells of their flat numbers."""
    names = [f"c{k}" for k in range(len(dims))]
    chunk = [F.call_function("div", F.col(d), F.lit(n).cast("long")).alias(c) for d, n, c in zip(dims, sizes, names, strict=True)]
    counts = points.groupBy(*chunk).agg(F.count(F.lit(1)).alias("nitems"))
    last = counts.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names)).first()
    flat = F.lit(0).cast("long")
    for c in names:
        flat = flat * F.lit(last[c] + 1).cast("long") + F.col(c)
    return running_sum(counts.withColumn("__flat", flat), "__flat", "nitems", "cumsum").select(*names, "nitems", "cumsum")


def accessed_chunks(cells: DataFrame, dims: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    return cells.select(*(F.call_function("div", F.col(d), F.lit(n).cast("long")).alias(f"c{k}") for k, (d, n) in enumerate(zip(dims, sizes, strict=True)))).distinct()


def order_of(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row (direction): increasing, decreasing or unordered, as the values go in order of position; equal neighbours are both."""
    before = previous(df.select(F.col(position).alias("p"), F.col(value).alias("x")), "p", "x", "y").filter("y is not null")
    up, down = F.coalesce(F.bool_and(F.col("x") >= F.col("y")), F.lit(True)), F.coalesce(F.bool_and(F.col("x") <= F.col("y")), F.lit(True))
    return before.agg(F.when(up, "increasing").when(down, "decreasing").otherwise("unordered").alias("direction"))
