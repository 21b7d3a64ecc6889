"""Stores of bytes by key: a table, a folder, a ZIP file; ranges, coalescing, and a cache."""

from __future__ import annotations

import os
import time
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.levels import CELLS, absorbed, celled

#: Bytes between two ranges that are read anyway, and of a merged range at most.
MAX_GAP, MAX_MERGED = 1 << 20, 16 << 20


def byte_range(value: Column, start: int | None = None, stop: int | None = None, suffix: int | None = None) -> Column:
    """[start, stop), from an offset on, or the last so many; of strings by characters, of binaries by bytes."""
    if suffix is not None:
        return F.substr(value, F.greatest(F.length(value) - suffix, F.lit(0)) + 1)
    return F.substring(value, start + 1, stop - start) if stop is not None else F.substr(value, F.lit(start + 1))


def coalesced(ranges: DataFrame, gap: int = MAX_GAP, start: str = "s", end: str = "e", cells: int = CELLS) -> DataFrame:
    """(start_, end_, n): ranges (start, end) merged where the gap to all before is at most ``gap``.

    Each cell of the number line merges its own ranges; of the merged ones, those that
    lie near the furthest end of all cells before join what stands there.
    """
    df = celled(ranges.select(F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).cast("long").alias("n")), "s", cells)
    order = Window.partitionBy("__cell").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.when(F.col("s") - before <= gap, 0).otherwise(1))
    df = df.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.groupBy("__cell", "group").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("group")
    reach = df.groupBy("__cell").agg(F.max("e").alias("far"))
    reach = reach.select("__cell", F.max("far").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    marked = df.join(F.broadcast(reach), "__cell")
    out = absorbed(marked, F.col("s") - F.col("far") <= gap, "n", top="e")
    return out.select(F.col("s").alias("start_"), F.col("e").alias("end_"), "n")


def coalesce_ranges(ranges: Sequence[tuple[int, int]], max_gap: int = MAX_GAP, max_merged: int = MAX_MERGED) -> list[list[int]]:
    """Groups of range numbers to be read at once: near enough, and not too large together. In order, on the driver."""
    out: list[list[int]] = []
    lo = hi = 0
    for i in sorted(range(len(ranges)), key=lambda i: ranges[i]):
        a, b = ranges[i]
        if out and a - hi <= max_gap and max(hi, b) - lo <= max_merged:
            out[-1].append(i)
            hi = max(hi, b)
        else:
            out.append([i])
            lo, hi = a, b
    return out


def runs(df: DataFrame, position: str, value: str, cells: int = CELLS) -> DataFrame:
    """(first_i, size, cnt): runs of equal values in order of position: within cells of positions, whose first runs then
    join the last ones of the cells before where values are equal."""
    df = celled(df.select(F.col(position).alias("s"), F.col(value).alias("v")), "s", cells)
    w = Window.partitionBy("__cell").orderBy("s")
    df = df.withColumn("new", F.when((F.row_number().over(w) > 1) & F.col("v").eqNullSafe(F.lag("v").over(w)), 0).otherwise(1))
    df = df.withColumn("group", F.sum("new").over(w))
    df = df.groupBy("__cell", "group").agg(F.min("s").alias("s"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    ends = df.groupBy("__cell").agg(F.max_by(F.struct("v"), "s").alias("end"))
    ends = ends.select("__cell", F.lag("end").over(Window.orderBy("__cell")).alias("end"))
    marked = df.join(F.broadcast(ends), "__cell").withColumn("first", F.col("group") == 1).drop("group")
    out = absorbed(marked, F.col("first") & F.col("end").isNotNull() & F.col("v").eqNullSafe(F.col("end.v")), "n")
    return out.select(F.col("s").alias("first_i"), F.col("v").alias("size"), F.col("n").alias("cnt"))


class TableStore:
    """A table (key, value) as a store; every change is a new table."""

    def __init__(self, df: DataFrame, read_only: bool = False) -> None:
        self.df, self.read_only = df.select("key", "value"), read_only

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    def get(self, key: str, **of: int) -> bytes | None:
        row = self.df.filter(F.col("key") == key).select(byte_range(F.col("value"), **of) if of else F.col("value")).first()
        return None if row is None else bytes(row[0])

    def get_many(self, wanted: DataFrame) -> DataFrame:
        """Values of (key, start, stop), joined: no key goes through the driver."""
        return wanted.join(self.df, "key").select("key", "start", "stop", F.substr("value", F.col("start") + 1, F.col("stop") - F.col("start")).alias("value"))

    def exists(self, key: str) -> bool:
        return not self.df.filter(F.col("key") == key).isEmpty()

    def list_prefix(self, prefix: str = "") -> DataFrame:
        return self.df.filter(F.col("key").startswith(prefix)).select("key")

    def list_dir(self, prefix: str = "") -> DataFrame:
        base = prefix.rstrip("/") + "/" if prefix else ""
        rest = F.substr("key", F.lit(len(base) + 1))
        return self.df.filter(F.col("key").startswith(base)).select(F.split(rest, "/")[0].alias("name")).distinct()

    def size_of_prefix(self, prefix: str = "") -> int:
        return self.df.filter(F.col("key").startswith(prefix)).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]

    def size_by_name(self) -> DataFrame:
        """(name, nbytes): bytes below each first part of the keys, in one pass."""
        return self.df.groupBy(F.split("key", "/")[0].alias("name")).agg(F.sum(F.octet_length("value")).cast("long").alias("nbytes"))

    def with_values(self, new: DataFrame, only_new: bool = False) -> TableStore:
        """new (key, value) laid over; with ``only_new`` keys that exist keep their value. A null value deletes."""
        self._writable()
        if only_new:
            return TableStore(self.df.unionByName(new.join(self.df.select("key"), "key", "left_anti")))
        kept = self.df.join(new.select("key"), "key", "left_anti")
        return TableStore(kept.unionByName(new.filter("value is not null").select("key", "value")))

    def without_prefix(self, prefix: str) -> TableStore:
        self._writable()
        return TableStore(self.df.filter(~F.col("key").startswith(prefix)))


class FolderStore:
    """Files below a folder; a value appears whole or not at all."""

    def __init__(self, root: str, read_only: bool = False) -> None:
        self.root, self.read_only = root, read_only

    def _path(self, key: str) -> str:
        root = os.path.abspath(self.root)
        path = os.path.abspath(os.path.join(root, key))
        if os.path.commonpath([root, path]) != root:
            raise ValueError(f"{key!r} leaves the store")
        return path

    def get(self, key: str, start: int | None = None, stop: int | None = None, suffix: int | None = None) -> bytes | None:
        try:
            with open(self._path(key), "rb") as f:
                if suffix is not None:
                    f.seek(max(0, os.fstat(f.fileno()).st_size - suffix))
                    return f.read()
                f.seek(start or 0)
                return f.read() if stop is None else f.read(stop - (start or 0))
        except FileNotFoundError:
            return None

    def set(self, key: str, value: bytes, only_new: bool = False) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(value)
        try:
            if only_new:
                os.link(draft, path)
            else:
                os.replace(draft, path)
        except FileExistsError:
            pass
        finally:
            if os.path.exists(draft):
                os.unlink(draft)

    def delete(self, key: str) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        if os.path.exists(self._path(key)):
            os.unlink(self._path(key))

    def list_prefix(self, prefix: str = "") -> Iterator[str]:
        for folder, _, names in os.walk(self.root):
            for name in names:
                key = os.path.relpath(os.path.join(folder, name), self.root)
                if key.startswith(prefix):
                    yield key

    def table(self, spark: SparkSession) -> TableStore:
        """All files as a table, read by the executors."""
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        base = os.path.abspath(self.root).rstrip("/") + "/"
        return TableStore(df.select(F.regexp_replace("path", f"^file:/*{base.lstrip('/')}", "").alias("key"), F.col("content").alias("value")))


class ZipFileStore:
    """Members of a ZIP file; it grows but deletes nothing."""

    def __init__(self, path: str, mode: str = "r") -> None:
        self.path, self.file = path, zipfile.ZipFile(path, mode, zipfile.ZIP_STORED, allowZip64=True)

    def get(self, key: str) -> bytes | None:
        try:
            return self.file.read(key)
        except KeyError:
            return None

    def set(self, key: str, value: bytes) -> None:
        self.file.writestr(key, value)

    def delete(self, key: str) -> None:
        if key in self.file.namelist():
            raise NotImplementedError("members of a ZIP file can't be deleted")

    def list_prefix(self, prefix: str = "") -> Iterator[str]:
        return (k for k in dict.fromkeys(self.file.namelist()) if k.startswith(prefix))

    def close(self) -> None:
        self.file.close()

    @staticmethod
    def table(spark: SparkSession, path: str) -> TableStore:
        """Members of ZIP files as a table; a task has one file."""

        def members(frames: Iterator) -> Iterator:
            import io

            import pandas as pd

            for frame in frames:
                for body in frame["content"]:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        yield pd.DataFrame([(n, z.read(n)) for n in z.namelist()], columns=["key", "value"])

        return TableStore(spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "key string, value binary"))


class CachedStore:
    """The values used last, up to a number of bytes and an age, before those of another store."""

    def __init__(self, base: FolderStore, max_bytes: int = 64 << 20, max_age: float | None = None) -> None:
        self.base, self.max_bytes, self.max_age = base, max_bytes, max_age
        self.held: OrderedDict[tuple, tuple[bytes, float]] = OrderedDict()
        self.size = self.hits = self.misses = self.evictions = 0

    def get(self, key: str, start: int | None = None, stop: int | None = None, suffix: int | None = None) -> bytes | None:
        at = (key, start, stop, suffix)
        if at in self.held:
            value, since = self.held[at]
            if self.max_age is None or time.monotonic() - since <= self.max_age:
                self.held.move_to_end(at)
                self.hits += 1
                return value
            self._drop(at)
        self.misses += 1
        value = self.base.get(key, start, stop, suffix)
        if value is not None and len(value) <= self.max_bytes:
            self.held[at] = value, time.monotonic()
            self.size += len(value)
            while self.size > self.max_bytes:
                self._drop(next(iter(self.held)))
                self.evictions += 1
        return value

    def _drop(self, at: tuple) -> None:
        self.size -= len(self.held.pop(at)[0])

    def set(self, key: str, value: bytes) -> None:
        for at in [x for x in self.held if x[0] == key]:
            self._drop(at)
        self.base.set(key, value)

    def stats(self) -> dict[str, float]:
        total = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "bytes": self.size, "hit_rate": self.hits / total if total else 0.0}
