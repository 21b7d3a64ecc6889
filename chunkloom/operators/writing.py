"""Writes as plans: fill, assign, resize, append, re-chunk, and what storage then holds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArrayError, ChunkNotFoundError, SelectionError
from ..grid import Grid
from ..model import ArrayFrame
from .selection import block_slices, entries, expand_ellipsis, is_bool_array, is_int_array, is_integer, normalized_index, orthogonal, slice_bounds


def domain(a: ArrayFrame) -> DataFrame:
    """Every coordinate of the array, decoded from one range; nothing is stored for it."""
    df, left, cols = a.cells.sparkSession.range(a.spec.size), F.col("id"), []
    for k in range(a.spec.ndim - 1, -1, -1):
        n = F.lit(max(1, a.shape[k])).cast("long")
        cols.insert(0, (F.pmod(left, n) if k else left).alias(a.dims[k]))
        left = F.call_function("div", left, n)
    return df.select(*cols)


def filled(a: ArrayFrame) -> ArrayFrame:
    """All cells: those that are absent hold the fill value. Strict arrays raise if a whole chunk is absent."""
    if not a.spec.read_missing:
        present = a.with_chunks().select(*(f"c{k}" for k in range(a.spec.ndim))).distinct().count()
        if present < a.spec.grid.n_chunks:
            raise ChunkNotFoundError(f"{a.spec.grid.n_chunks - present} chunks are absent")
    df = domain(a).join(a.cells, list(a.dims), "left")
    return a.replaced(df.select(*a.dims, *(F.coalesce(F.col(v), F.lit(a.spec.fill).cast(dict(a.cells.dtypes)[v])).alias(v) for v in a.values)))


def is_fill(value: Column, fill: Any) -> Column:
    """Equality to the fill value that tells -0.0 from 0.0 and takes NaN as equal to NaN."""
    if isinstance(fill, float) and fill == 0 or isinstance(fill, int) and not isinstance(fill, bool) and fill == 0:
        # -0.0 prints with its sign
        return value.eqNullSafe(F.lit(fill)) & ~value.cast("string").startswith("-")
    return value.eqNullSafe(F.lit(fill))


def condition(a: ArrayFrame, selection: Any) -> Column:
    """True for the cells that a selection of integers, slices, lists and masks, one per axis, holds: their outer product."""
    out = F.lit(True)
    for d, n, x in zip(a.dims, a.shape, expand_ellipsis(selection, a.spec.ndim), strict=True):
        if is_integer(x):
            out = out & (F.col(d) == normalized_index(x, n))
        elif isinstance(x, slice):
            start, stop, step = slice_bounds(x, n)
            if (start, stop, step) != (0, n, 1):
                out = out & (F.col(d) >= start) & (F.col(d) < stop) & (((F.col(d) - start) % step) == 0)
        elif is_bool_array(x) or is_int_array(x):
            out = out & F.col(d).isin(listed(x, n))
        else:
            raise SelectionError(f"{x!r} selects nothing of an axis")
    return out


def listed(x: Any, n: int) -> list[int]:
    """The indices that a list or a mask names, in its order."""
    if is_bool_array(x):
        if len(x) != n:
            raise SelectionError(f"a mask of {len(x)} for an axis of {n}")
        return np.flatnonzero(np.asarray(x)).tolist()
    return [normalized_index(int(v), n) for v in np.asarray(x).reshape(-1)]


def assign(a: ArrayFrame, where: Any | Column, value: Any) -> ArrayFrame:
    """a[where] = value: a condition or a selection of integers, slices, lists and masks; the value a scalar, or an array of
    the selection's shape. Where a list names an index twice, the later value stays."""
    hit = where if isinstance(where, Column) else condition(a, where)
    name = a.values[0]
    kind = dict(a.cells.dtypes)[name]
    if not isinstance(value, ArrayFrame):
        return a.replaced(a.cells.withColumn(name, F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(name))))
    target = orthogonal(a, where)
    if target.shape != value.shape:
        raise ArrayError(f"a value of {value.shape} for a selection of {target.shape}")
    moved, axes, cells = [], iter(value.dims), value.cells
    for d, n, x in zip(a.dims, a.shape, expand_ellipsis(where, a.spec.ndim), strict=True):
        if is_integer(x):
            moved.append(F.lit(normalized_index(x, n)).cast("long").alias(d))
        elif not isinstance(x, slice):
            axis, last = next(axes), {v: i for i, v in enumerate(listed(x, n))}
            cells = cells.join(entries(a, [(i, v) for v, i in last.items()], f"{axis} long, __to_{d} long"), axis)
            moved.append(F.col(f"__to_{d}").alias(d))
        else:
            start, _, step = slice_bounds(x, n)
            moved.append((F.col(next(axes)) * step + start).alias(d))
    return overlaid(a, cells.select(*moved, F.col(value.values[0]).alias("__new")))


def assign_blocks(a: ArrayFrame, selection: Any, value: Any) -> ArrayFrame:
    """a.blocks[selection] = value, the selection in units of chunks."""
    return assign(a, block_slices(a.spec.grid, selection), value)


def assign_points(a: ArrayFrame, points: DataFrame, order: str = "ord", value: str = "nv") -> ArrayFrame:
    """Writes (coordinates, order, value) rows; of several for one cell the last by order wins."""
    last = points.groupBy(*a.dims).agg(F.max_by(value, order).alias("__new"))
    return overlaid(a, last)


def overlaid(a: ArrayFrame, new: DataFrame) -> ArrayFrame:
    """Cells with column __new laid over those of an array; cells that were absent appear."""
    name = a.values[0]
    kind = dict(a.cells.dtypes)[name]
    new = new.withColumn("__hit", F.lit(True))
    df = a.cells.join(new, list(a.dims), "full")
    others = [F.col(v) for v in a.values[1:]]
    return a.replaced(df.select(*a.dims, F.when(F.col("__hit"), F.col("__new").cast(kind)).otherwise(F.col(name)).alias(name), *others))


def resized(a: ArrayFrame, shape: Sequence[int], keep_outside: bool = False) -> ArrayFrame:
    """Another shape of the same rank. Cells outside go; ``keep_outside`` keeps those in chunks that still hold a cell inside."""
    if len(shape) != a.spec.ndim:
        raise ArrayError("a new shape has as many axes")
    grid, df = a.spec.grid.resized(shape), a.cells
    for d, axis, n in zip(a.dims, a.spec.grid.axes, shape, strict=True):
        stop = n if not keep_outside or n == 0 else axis.offset(axis.index_of(n - 1)) + axis.chunk_size(axis.index_of(n - 1)) if n <= axis.extent else None
        if stop is not None and stop < axis.extent:
            df = df.filter(F.col(d) < stop)
    return a.replaced(df, grid=grid)


def appended(a: ArrayFrame, b: ArrayFrame, axis: int = 0) -> ArrayFrame:
    """b after a along an axis; the other axes agree. New coordinates are the old ones, moved."""
    if len(a.shape) != len(b.shape) or any(x != y for k, (x, y) in enumerate(zip(a.shape, b.shape, strict=True)) if k != axis):
        raise ArrayError(f"{b.shape} can't follow {a.shape} along axis {axis}")
    kinds = dict(a.cells.dtypes)
    moved = [(F.col(d) + a.shape[axis] if k == axis else F.col(d)).alias(n) for k, (d, n) in enumerate(zip(b.dims, a.dims, strict=True))]
    values = [F.col(v).cast(kinds[n]).alias(n) for v, n in zip(b.values, a.values, strict=True)]
    shape = tuple(n + b.shape[axis] if k == axis else n for k, n in enumerate(a.shape))
    return a.replaced(a.cells.unionByName(b.cells.select(*moved, *values)), grid=a.spec.grid.resized(shape))


def rechunked(a: ArrayFrame, chunks: int | Sequence[int]) -> ArrayFrame:
    return a.replaced(a.cells, grid=Grid.of(a.shape, chunks))


def stored_chunks(a: ArrayFrame) -> DataFrame:
    """Chunks that storage would hold, with their numbers of cells: without those that hold the fill value alone, unless kept."""
    by = [f"c{k}" for k in range(a.spec.ndim)]
    empty = F.bool_and(is_fill(F.col(a.values[0]), a.spec.fill))
    df = a.with_chunks().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), empty.alias("is_empty"))
    return df.select(*by, "n") if a.spec.write_empty else df.filter("not is_empty").select(*by, "n")


def n_initialized(a: ArrayFrame) -> DataFrame:
    return stored_chunks(a).agg(F.count(F.lit(1)).alias("n"))


def without_empty_chunks(a: ArrayFrame) -> ArrayFrame:
    by = [f"c{k}" for k in range(a.spec.ndim)]
    return a.replaced(a.with_chunks().join(stored_chunks(a).select(*by), by, "left_semi").select(*a.dims, *a.values))


def save_cells(a: ArrayFrame, path: str, mode: str = "overwrite") -> None:
    """Cells in Parquet, a folder per chunk along the first axis; only folders with new cells are overwritten."""
    by = [f"c{k}" for k in range(min(1, a.spec.ndim))]
    df = a.with_chunks().repartition(*by) if by else a.cells
    df.sortWithinPartitions(*a.dims).write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode(mode).partitionBy(*by).parquet(path)


def load_cells(spark: Any, path: str, spec: Any, values: Sequence[str] = ("v",)) -> ArrayFrame:
    return ArrayFrame(spark.read.parquet(path), spec, tuple(values))


def describe(a: ArrayFrame) -> dict[str, Any]:
    """Facts that need no reading."""
    s = a.spec
    return {"shape": s.shape, "dtype": s.dtype, "chunks": s.grid.sizes(clipped=False) if not s.grid.regular else tuple(x.size for x in s.grid.axes), "order": s.order, "fill": s.fill, "nchunks": s.grid.n_chunks, "size": s.size, "nbytes": s.nbytes, "codecs": s.codecs}


def readable_size(n: int) -> str:
    for unit in ("", "K", "M", "G", "T"):
        if n < 1024:
            return f"{n:.1f}{unit}" if unit else str(n)
        n /= 1024
    return f"{n:.1f}P"
