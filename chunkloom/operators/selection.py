"""Selections as plans: integers, slices, outer and coordinate lists, masks, blocks, fields.

Every operator here returns a new ArrayFrame and runs nothing. Slices and integers are
filters on coordinates (ranges reach the Parquet scan), together with filters on the
chunk columns where the table is partitioned by them. Lists are joins with a selection
table that carries the place of each entry, so order and repeats survive; a table of a
few entries is a literal, a larger one a join that Spark plans by its size.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BoundsError, NegativeStepError, SelectionError
from ..grid import Grid
from ..model import ArrayFrame

#: Entries of a selection list that may be taken to every executor.
BROADCAST_ENTRIES = 100_000


# -- what a selector is ------------------------------------------------------------


def is_bool(x: Any) -> bool:
    return isinstance(x, (bool, np.bool_))


def is_integer(x: Any) -> bool:
    return isinstance(x, (int, np.integer)) and not is_bool(x)


def is_int_array(x: Any) -> bool:
    return isinstance(x, (list, tuple, np.ndarray)) and np.asarray(x).dtype.kind in "iu" or isinstance(x, list) and len(x) == 0


def is_bool_array(x: Any) -> bool:
    return isinstance(x, (list, np.ndarray)) and np.asarray(x).dtype.kind == "b"


def normalized_index(i: int, extent: int) -> int:
    i = operator.index(i)
    if i < -extent or i >= extent:
        raise BoundsError(f"index {i} is out of bounds for an axis of {extent}")
    return i + extent if i < 0 else i


def expand_ellipsis(selection: Any, ndim: int) -> tuple[Any, ...]:
    """One ... stands for as many whole axes as are missing; missing last axes are whole."""
    items = selection if isinstance(selection, tuple) else (selection,)
    dots = [i for i, x in enumerate(items) if x is Ellipsis]
    if len(dots) > 1:
        raise SelectionError("an index can have only one ellipsis")
    if dots:
        missing = ndim - (len(items) - 1)
        items = items[: dots[0]] + (slice(None),) * max(0, missing) + items[dots[0] + 1 :]
    if len(items) > ndim:
        raise SelectionError(f"too many indices: {len(items)} for {ndim} axes")
    return items + (slice(None),) * (ndim - len(items))


def is_coordinate_selection(items: tuple[Any, ...], ndim: int) -> bool:
    return len(items) == ndim > 0 and all(is_integer(x) or is_int_array(x) for x in items)


def pop_fields(selection: Any) -> tuple[list[str] | None, Any]:
    """(field names, selection without them)."""
    if isinstance(selection, str):
        return [selection], ()
    if isinstance(selection, list) and selection and all(isinstance(x, str) for x in selection):
        return selection, ()
    if not isinstance(selection, tuple):
        return None, selection
    fields = [x for x in selection if isinstance(x, str)]
    rest = tuple(x for x in selection if not isinstance(x, str))
    return (fields or None), (rest[0] if len(rest) == 1 and fields else rest)


# -- the dispatcher -------------------------------------------------------------------


def select(a: ArrayFrame, selection: Any) -> ArrayFrame:
    """a[selection]: coordinate lists on all axes select points, one list an outer axis, else slices and integers."""
    fields, selection = pop_fields(selection)
    if fields:
        a = select_fields(a, fields)
        if isinstance(selection, tuple) and selection == ():
            return a
    items = selection if isinstance(selection, tuple) else (selection,)
    arrays = [x for x in items if is_int_array(x) and not isinstance(x, tuple) or is_bool_array(x)]
    if len(items) == 1 and is_bool_array(items[0]) and np.asarray(items[0]).shape == a.shape:
        return mask(a, items[0])
    if arrays and is_coordinate_selection(items, a.spec.ndim) and (len(arrays) > 1 or a.spec.ndim == 1):
        return coordinates(a, items)
    return orthogonal(a, selection) if arrays else basic(a, selection)


def select_fields(a: ArrayFrame, fields: Sequence[str]) -> ArrayFrame:
    """Fields of a structured value, or some of several value columns; only those are read."""
    kind = dict(a.cells.dtypes)
    if all(f in a.values for f in fields):
        cols = [F.col(f) for f in fields]
    elif len(a.values) == 1 and kind[a.values[0]].startswith("struct"):
        inner = a.cells.schema[a.values[0]].dataType.names
        if missing := [f for f in fields if f not in inner]:
            raise SelectionError(f"no such fields: {missing}")
        cols = [F.col(f"{a.values[0]}.{f}").alias(f) for f in fields]
    else:
        raise SelectionError(f"no such fields: {list(fields)}")
    return ArrayFrame(a.cells.select(*a.dims, *cols), a.spec, tuple(fields))


# -- slices and integers ----------------------------------------------------------------


def slice_bounds(s: slice, extent: int) -> tuple[int, int, int]:
    start, stop, step = s.indices(extent)
    if step < 1:
        raise NegativeStepError("only steps of 1 and more are supported")
    return start, max(start, stop), step


def axis_filter(name: str, start: int, stop: int, step: int) -> Column:
    d = F.col(name)
    out = (d >= start) & (d < stop)
    return out & ((d - start) % step == 0) if step > 1 else out


def rebased(name: str, start: int, step: int) -> Column:
    moved = F.col(name) - start if start else F.col(name)
    return F.call_function("div", moved, F.lit(step).cast("long")) if step > 1 else moved.cast("long")


def result_frame(df: DataFrame, lengths: Sequence[int], a: ArrayFrame) -> ArrayFrame:
    """Cells with columns o0 and on, as an array of one chunk size per axis."""
    names = tuple(f"o{i}" for i in range(len(lengths)))
    spec = {"dtype": a.spec.dtype, "fill": a.spec.fill}
    return ArrayFrame.of(df, tuple(lengths), [max(1, n) for n in lengths], names, a.values, **spec)


def basic(a: ArrayFrame, selection: Any) -> ArrayFrame:
    """Integers drop their axis, slices keep it; coordinates restart at 0."""
    items = expand_ellipsis(selection, a.spec.ndim)
    df, cols, lengths = prune(a, items), [], []
    for name, n, x in zip(a.dims, a.shape, items, strict=True):
        if is_integer(x):
            df = df.filter(F.col(name) == normalized_index(x, n))
        elif isinstance(x, slice):
            start, stop, step = slice_bounds(x, n)
            if (start, stop, step) != (0, n, 1):
                df = df.filter(axis_filter(name, start, stop, step))
            cols.append(rebased(name, start, step).alias(f"o{len(lengths)}"))
            lengths.append(-(-(stop - start) // step))
        else:
            raise SelectionError(f"{x!r} is no integer or slice")
    return result_frame(df.select(*cols, *a.values), lengths, a)


def prune(a: ArrayFrame, items: Sequence[Any]) -> DataFrame:
    """Filters on chunk columns, where the cells have them: they select partitions before anything is read."""
    df = a.cells
    for i, (axis, n, x) in enumerate(zip(a.spec.grid.axes, a.shape, items, strict=True)):
        c = f"c{i}"
        if c not in df.columns or n == 0:
            continue
        if is_integer(x):
            df = df.filter(F.col(c) == axis.index_of(normalized_index(x, n)))
        elif isinstance(x, slice):
            start, stop, _ = slice_bounds(x, n)
            if stop > start and (start, stop) != (0, n):
                df = df.filter(F.col(c).between(axis.index_of(start), axis.index_of(stop - 1)))
        elif is_int_array(x) and len(x):
            chunks = sorted({axis.index_of(normalized_index(int(v), n)) for v in np.asarray(x).reshape(-1)})
            df = df.filter(F.col(c).isin(chunks) if len(chunks) <= 64 else F.col(c).between(chunks[0], chunks[-1]))
    return df


# -- lists -------------------------------------------------------------------------------


def entries(a: ArrayFrame, rows: list[tuple[int, ...]], schema: str) -> DataFrame:
    df = a.cells.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ENTRIES else df


def orthogonal(a: ArrayFrame, selection: Any) -> ArrayFrame:
    """The outer product of one selector per axis; lists keep their order and repeats, masks take what is true."""
    items = [np.asarray(x) if is_bool_array(x) or is_int_array(x) else x for x in expand_ellipsis(selection, a.spec.ndim)]
    df, cols, lengths = prune(a, [x if not isinstance(x, np.ndarray) or x.dtype.kind != "b" else slice(None) for x in items]), [], []
    for k, (name, n, x) in enumerate(zip(a.dims, a.shape, items, strict=True)):
        if isinstance(x, np.ndarray):
            if x.ndim != 1:
                raise SelectionError("a selector of one axis has one dimension")
            if x.dtype.kind == "b":
                if len(x) != n:
                    raise SelectionError(f"a mask of {len(x)} for an axis of {n}")
                x = np.flatnonzero(x)
            wanted = [normalized_index(int(v), n) for v in x]
            out = f"__o{k}"
            df = df.join(entries(a, list(enumerate(wanted)), f"{out} long, {name} long"), name)
            cols.append(F.col(out).alias(f"o{len(lengths)}"))
            lengths.append(len(wanted))
        elif is_integer(x):
            df = df.filter(F.col(name) == normalized_index(x, n))
        elif isinstance(x, slice):
            start, stop, step = slice_bounds(x, n)
            if (start, stop, step) != (0, n, 1):
                df = df.filter(axis_filter(name, start, stop, step))
            cols.append(rebased(name, start, step).alias(f"o{len(lengths)}"))
            lengths.append(-(-(stop - start) // step))
        else:
            raise SelectionError(f"{x!r} selects nothing of an axis")
    return result_frame(df.select(*cols, *a.values), lengths, a)


def coordinates(a: ArrayFrame, selection: Sequence[Any] | DataFrame) -> ArrayFrame | DataFrame:
    """Points by one list of coordinates per axis, broadcast together; the result has their shape.

    A DataFrame with column o and the axes' names selects too, of any size; it then is
    joined as Spark sees fit and the result is a DataFrame (o, values).
    """
    if isinstance(selection, DataFrame):
        return a.cells.join(selection, list(a.dims)).select("o", *a.values)
    if len(selection) != a.spec.ndim:
        raise SelectionError("a coordinate list is needed for each axis")
    lists = np.broadcast_arrays(*(np.asarray(x, dtype=np.int64) for x in selection))
    flat = [[normalized_index(int(v), n) for v in x.reshape(-1)] for x, n in zip(lists, a.shape, strict=True)]
    table = entries(a, list(zip(range(lists[0].size), *flat, strict=True)), ", ".join(["__o long", *(f"{d} long" for d in a.dims)]))
    return result_frame(prune(a, flat).join(table, list(a.dims)).select(*unraveled(F.col("__o"), lists[0].shape), *a.values), lists[0].shape, a)


def unraveled(flat: Column, shape: Sequence[int]) -> list[Column]:
    """The coordinates, last axis fastest, of a place in a flat order; as o0 and on."""
    cols: list[Column] = []
    for k in range(len(shape) - 1, -1, -1):
        n = F.lit(max(1, shape[k])).cast("long")
        cols.insert(0, (F.pmod(flat, n) if k else flat).alias(f"o{k}"))
        flat = F.call_function("div", flat, n)
    return cols


def mask(a: ArrayFrame, selected: Any | Column) -> ArrayFrame | DataFrame:
    """Cells where a mask is true, numbered in C order.

    The mask is a NumPy array of the array's shape, or a condition on the cells. The
    numbering counts per chunk of rows first and adds up those counts, so no task sorts
    everything; a condition gives a DataFrame (o0, values), whose length only running tells.
    """
    if isinstance(selected, Column):
        return ranked(a.cells.filter(selected), a.dims, a.shape).select("o0", *a.values)
    selected = np.asarray(selected)
    if selected.shape != a.shape or selected.dtype.kind != "b":
        raise SelectionError(f"a mask of {a.shape} is needed")
    places = np.nonzero(selected)
    return coordinates(a, [p.astype(np.int64) for p in places])


def ranked(df: DataFrame, dims: Sequence[str], shape: Sequence[int], name: str = "o0", groups: int = 4096) -> DataFrame:
    """Adds each row's place in C order of ``dims``: within groups of neighbours, plus the rows of all groups before."""
    flat = F.lit(0).cast("long")
    for d, n in zip(dims, shape, strict=True):
        flat = flat * F.lit(n).cast("long") + F.col(d)
    width = F.lit(max(1, -(-math.prod(shape) // groups))).cast("long")
    df = df.withColumn("__flat", flat).withColumn("__group", F.call_function("div", F.col("__flat"), width))
    counts = df.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    # at most ``groups`` rows, whatever the array's size
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__group").orderBy("__flat")) - 1
    return df.withColumn("__inner", inner).join(F.broadcast(counts), "__group").withColumn(name, F.col("__before") + F.col("__inner")).drop("__flat", "__group", "__before", "__inner")


# -- blocks ---------------------------------------------------------------------------------


def block_slices(grid: Grid, selection: Any) -> tuple[slice, ...]:
    """The cells' slices of a selection in units of chunks."""
    out = []
    for axis, x in zip(grid.axes, expand_ellipsis(selection, len(grid.axes)), strict=True):
        n = axis.n_chunks
        if is_integer(x):
            first, last = normalized_index(x, n), normalized_index(x, n) + 1
        elif isinstance(x, slice):
            first, last, step = slice_bounds(x, n)
            if step != 1:
                raise SelectionError("blocks are selected in steps of 1")
        else:
            raise SelectionError(f"{x!r} selects no blocks")
        begin = axis.offset(first) if first < n else axis.extent
        out.append(slice(begin, min(axis.extent, axis.offset(last - 1) + axis.chunk_size(last - 1)) if last > first else begin))
    return tuple(out)


def blocks(a: ArrayFrame, selection: Any) -> ArrayFrame:
    return basic(a, block_slices(a.spec.grid, selection))


def scalar(a: ArrayFrame) -> Any:
    """The value of an array without axes; its fill value if the cell is absent."""
    if a.spec.ndim:
        raise SelectionError("only an array without axes is a scalar")
    row = a.cells.select(*a.values).first()
    return a.spec.fill if row is None else row[0]
