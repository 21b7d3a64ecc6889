"""The array as Spark sees it: a DataFrame of cells and what describes it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MetadataError
from .grid import Grid

#: Names of element types and the Spark types that hold them.
SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double",
    "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>",
    "string": "string", "fixed_length_utf32": "string", "bytes": "binary", "null_terminated_bytes": "binary", "raw_bytes": "binary", "variable_length_bytes": "binary",
    "numpy.datetime64": "bigint", "numpy.timedelta64": "bigint",
}
#: NumPy types of the cells whose Spark type is wider than the element's.
HELD = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}
#: Bytes of an element.
ITEM_SIZES = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8, "complex64": 8, "complex128": 16, "numpy.datetime64": 8, "numpy.timedelta64": 8}


@dataclass(frozen=True)
class ArraySpec:
    """grid holds shape and chunks. order and dims are of the axes. write_empty: keep chunks that hold the fill value alone."""

    grid: Grid
    dtype: str = "float64"
    fill: Any = 0
    dims: tuple[str, ...] = ()
    attributes: dict[str, Any] = field(default_factory=dict)
    codecs: tuple[dict[str, Any], ...] = ()
    order: str = "C"
    write_empty: bool = False
    read_missing: bool = True

    def __post_init__(self) -> None:
        if not self.dims:
            object.__setattr__(self, "dims", tuple(f"d{i}" for i in range(len(self.grid.axes))))
        if len(self.dims) != len(self.grid.axes):
            raise MetadataError("as many dimension names as axes are needed")
        if self.order not in ("C", "F"):
            raise MetadataError("order is C or F")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.grid.shape

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=object)) if self.shape else 1

    @property
    def nbytes(self) -> int:
        return self.size * ITEM_SIZES.get(self.dtype, 0)


@dataclass(frozen=True)
class ArrayFrame:
    """Cells (one integer column per dimension, and value columns) with their spec. Absent cells hold the fill value."""

    cells: DataFrame
    spec: ArraySpec
    values: tuple[str, ...] = ("v",)

    @classmethod
    def of(cls, df: DataFrame, shape: Sequence[int], chunks: int | Sequence[int], dims: Sequence[str] = (), values: Sequence[str] = ("v",), **spec: Any) -> ArrayFrame:
        made = ArraySpec(Grid.of(tuple(shape), chunks), dims=tuple(dims), **spec)
        return cls(df.select(*made.dims, *values), made, tuple(values))

    @property
    def dims(self) -> tuple[str, ...]:
        return self.spec.dims

    def with_chunks(self) -> DataFrame:
        """Cells with their chunk's coordinates, c0 and on: what a table is partitioned by."""
        return self.cells.select(*self.spec.grid.chunk_columns(self.dims), "*")

    def replaced(self, cells: DataFrame, **spec: Any) -> ArrayFrame:
        return ArrayFrame(cells, replace(self.spec, **spec) if spec else self.spec, self.values)

    def to_numpy(self) -> np.ndarray:
        """The whole array on the driver: for arrays that fit there, in tests and at the end of a selection."""
        rows = self.cells.toPandas()
        first = rows[self.values[0]]
        out = np.full(self.shape, self.spec.fill, dtype=first.dtype if len(first) and first.dtype != object else self.spec.dtype if self.spec.dtype in ITEM_SIZES else object)
        if self.dims:
            out[tuple(rows[d].to_numpy() for d in self.dims)] = first.to_numpy()
        elif len(first):
            out[()] = first[0]
        return out

    @property
    def shape(self) -> tuple[int, ...]:
        return self.spec.shape


def from_vectors(df: DataFrame, key: str, vector: str, shape: Sequence[int], chunks: Sequence[int], name: str = "v") -> ArrayFrame:
    """A two-dimensional array from a table with a vector per row."""
    cells = df.select(F.col(key).cast("long").alias("d0"), F.posexplode(vector).alias("d1", name)).withColumn("d1", F.col("d1").cast("long"))
    return ArrayFrame.of(cells, shape, chunks, values=(name,))


def from_numpy(spark: SparkSession, a: np.ndarray, chunks: int | Sequence[int], **spec: Any) -> ArrayFrame:
    """An array of a NumPy array's cells, in C order."""
    kind = SPARK_TYPES.get(str(a.dtype), "double")
    values = a.reshape(-1)
    if a.dtype.kind in "biuf" and a.dtype != np.uint64:  # as Arrow columns, no object per cell
        flat = spark.createDataFrame(pa.table({"i": np.arange(values.size), "v": values.astype(HELD.get(str(a.dtype), a.dtype))}))
    else:
        whole = Decimal if a.dtype == np.uint64 else lambda x: x
        flat = spark.createDataFrame([(i, whole(x.item())) for i, x in enumerate(values)], f"i long, v {kind}")
    left, cols = F.col("i"), []
    for k in range(a.ndim - 1, -1, -1):
        cols.insert(0, F.pmod(left, F.lit(a.shape[k]).cast("long")).alias(f"d{k}"))
        left = F.call_function("div", left, F.lit(a.shape[k]).cast("long"))
    return ArrayFrame.of(flat.select(*cols, "v"), a.shape, chunks, dtype=str(a.dtype), **spec)
