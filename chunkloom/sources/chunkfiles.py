"""Arrays as files: a JSON document and one file per chunk or shard, byte for byte in the documented layout.

Folders are paths or URIs of any store that pyarrow reaches. Reading is a Python data
source, ``spark.read.format("chunkfiles").load(folder)``: the folder is listed once, files
are dealt to a bounded number of partitions, and filters on coordinates choose the files
before any is opened, and of a shard the inner chunks before any is read. Absent files
are absent cells. Writing sends each chunk's cells to one task.
"""

from __future__ import annotations

import itertools
import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..errors import ArrayNotFoundError, ContainsArrayError
from ..functions.bytecodecs import ABSENT, build_shard, decode_array, decode_bytes, encode_array, encode_bytes, encoded_type, pack_strings, reads_parts, shard_index, split_chain, unpack_strings
from ..grid import chunk_key, morton_coords, parse_chunk_key
from ..model import HELD, SPARK_TYPES, ArrayFrame, ArraySpec
from ..operators.metadata import DOCUMENT, OLD_DOCUMENTS, document_from_spec, migrated, spec_from_document
from .store import coalesce_ranges


#: Cells to a partition of a read: small chunks share one, as a task costs more than a small file.
PARTITION_CELLS = 1 << 20


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in folder:
        fs, path = pafs.FileSystem.from_uri(folder)
        return fs, path.rstrip("/")
    return pafs.LocalFileSystem(), folder.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: ``spark.checkpoint.dir``; a temporary folder where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="chunkloom-")


def read_bytes(folder: str, key: str) -> bytes:
    fs, path = store_of(folder)
    with fs.open_input_file(f"{path}/{key}") as f:
        return f.read()


def has_file(folder: str, key: str) -> bool:
    fs, path = store_of(folder)
    return fs.get_file_info(f"{path}/{key}").type == pafs.FileType.File


def put_file(folder: str, key: str, body: bytes) -> None:
    """A file appears whole or not at all: it is written under a name of its own and moved."""
    fs, path = store_of(folder)
    fs.create_dir(f"{path}/{key}".rsplit("/", 1)[0], recursive=True)
    draft = f"{path}/{key}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as f:
        f.write(body)
    fs.move(draft, f"{path}/{key}")


def remove_file(folder: str, key: str) -> None:
    fs, path = store_of(folder)
    if has_file(folder, key):
        fs.delete_file(f"{path}/{key}")


def read_document(folder: str) -> dict[str, Any]:
    """The array's document; one of the older format is read as what it is in the newer."""
    if has_file(folder, DOCUMENT):
        return json.loads(read_bytes(folder, DOCUMENT))
    if has_file(folder, OLD_DOCUMENTS[0]):
        attributes = json.loads(read_bytes(folder, OLD_DOCUMENTS[2])) if has_file(folder, OLD_DOCUMENTS[2]) else {}
        return migrated(json.loads(read_bytes(folder, OLD_DOCUMENTS[0])), attributes)
    raise ArrayNotFoundError(folder)


def key_of(doc: dict[str, Any], coords: Sequence[int]) -> str:
    enc = doc["chunk_key_encoding"]
    name, conf = (enc, {}) if isinstance(enc, str) else (enc["name"], enc.get("configuration", {}))
    return chunk_key(coords, name, conf.get("separator"))


def block_kind(dtype: str, serializer: dict[str, Any]) -> np.dtype:
    return np.dtype(dtype).newbyteorder(">" if serializer.get("configuration", {}).get("endian") == "big" else "<")


def encode_block(block: np.ndarray, codecs: Sequence[dict[str, Any]], fill: Any) -> bytes:
    """A chunk's bytes; a sharding codec cuts it into inner chunks, in Morton order, without those of the fill value alone."""
    arrays, serializer, chain = split_chain(codecs)
    for c in arrays:
        block = encode_array(block, c)
    if serializer["name"] == "sharding_indexed":
        conf = serializer["configuration"]
        inner = conf["chunk_shape"]
        counts = [n // c for n, c in zip(block.shape, inner, strict=True)]
        held: dict[int, bytes] = {}
        for at in morton_coords(counts):
            part = block[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, inner, strict=True))]
            if not np.array_equal(part, np.full(part.shape, fill, part.dtype), equal_nan=part.dtype.kind == "f"):
                held[int(np.ravel_multi_index(at, counts))] = encode_block(part, conf["codecs"], fill)
        body = build_shard(held, math.prod(counts), conf.get("index_location", "end"))
    elif serializer["name"].startswith("vlen-"):
        body = pack_strings(["" if x is None else x for x in block.reshape(-1).tolist()])
    else:
        body = np.ascontiguousarray(block).astype(block_kind(str(block.dtype), serializer)).tobytes()
    return encode_bytes(body, chain)


def array_steps(codecs: Sequence[dict[str, Any]], shape: Sequence[int], dtype: str) -> tuple[list[tuple[dict[str, Any], np.dtype]], list[int], np.dtype]:
    """(array codecs with the element type before each, shape and element type after the last)."""
    kind, shape, steps = np.dtype(dtype), list(shape), []
    for c in split_chain(codecs)[0]:
        steps.append((c, kind))
        kind = encoded_type(kind, c)
        if c["name"] == "transpose":
            shape = [shape[k] for k in c["configuration"]["order"]]
    return steps, shape, kind


def decode_block(body: bytes, shape: Sequence[int], dtype: str, codecs: Sequence[dict[str, Any]], fill: Any) -> np.ndarray:
    _, serializer, chain = split_chain(codecs)
    steps, shape, kind = array_steps(codecs, shape, dtype)
    body = decode_bytes(body, chain)
    if serializer["name"] == "sharding_indexed":
        block = decode_shard(lambda at, n: body[at : at + n], len(body), shape, str(kind), serializer["configuration"], fill)
    elif serializer["name"].startswith("vlen-"):
        block = np.array(unpack_strings(body, serializer["name"] == "vlen-utf8"), dtype=object).reshape(shape)
    else:
        block = np.frombuffer(body, block_kind(str(kind), serializer)).astype(kind).reshape(shape)
    for c, before in reversed(steps):
        block = decode_array(block, c, before)
    return block


def decode_shard(read: Callable[[int, int], bytes], size: int, shape: Sequence[int], dtype: str, conf: dict[str, Any], fill: Any, box: Sequence[tuple[int, int]] | None = None) -> np.ndarray:
    """A shard's block by range reads of its ``size`` bytes: the index, then the inner chunks that a box (lo, hi by axis) touches,
    neighbours together. What lies outside of these holds the fill value."""
    inner, at_start = conf["chunk_shape"], conf.get("index_location", "end") == "start"
    counts = [n // c for n, c in zip(shape, inner, strict=True)]
    n = math.prod(counts)
    raw = read(0 if at_start else size - (n * 16 + 4), n * 16 + 4)
    index = shard_index(raw, n).astype(object)
    box = box or [(0, n) for n in shape]
    touched = itertools.product(*(range(lo // c, -(-hi // c)) if lo < hi else () for (lo, hi), c in zip(box, inner, strict=True)))
    wanted = [(at, *index[int(np.ravel_multi_index(at, counts))]) for at in touched]
    wanted = [(at, int(a), int(a + m)) for at, a, m in wanted if a != ABSENT]
    block = np.full(shape, fill, dtype)
    for group in coalesce_ranges([(a, z) for _, a, z in wanted]):
        lo, hi = min(wanted[i][1] for i in group), max(wanted[i][2] for i in group)
        data = read(lo, hi - lo)
        for at, a, z in (wanted[i] for i in group):
            block[tuple(slice(x * c, (x + 1) * c) for x, c in zip(at, inner, strict=True))] = decode_block(data[a - lo : z - lo], inner, dtype, conf["codecs"], fill)
    return block


def write_files(a: ArrayFrame, folder: str, codecs: Sequence[dict[str, Any]] = (), overwrite: bool = False) -> None:
    """The document, then every chunk that has a cell other than the fill value; ``folder`` is one that all executors share."""
    if has_file(folder, DOCUMENT) and not overwrite:
        raise ContainsArrayError(folder)
    spec = replace(a.spec, codecs=tuple(codecs)) if codecs else a.spec
    doc = document_from_spec(spec)
    dims, grid, value = list(a.dims), spec.grid, a.values[0]

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        at = tuple(int(frame[f"c{k}"].iloc[0]) for k in range(len(dims)))
        block = np.full([x.chunk_size(c) for x, c in zip(grid.axes, at, strict=True)], spec.fill, spec.dtype)
        block[tuple((frame[d] - x.offset(c)).to_numpy() for d, x, c in zip(dims, grid.axes, at, strict=True))] = frame[value].to_numpy()
        key = key_of(doc, at)
        if not spec.write_empty and np.array_equal(block, np.full(block.shape, spec.fill, block.dtype), equal_nan=block.dtype.kind == "f"):
            remove_file(folder, key)
            return pd.DataFrame({"n": [0]})
        put_file(folder, key, encode_block(block, doc["codecs"], spec.fill))
        return pd.DataFrame({"n": [1]})

    put_file(folder, DOCUMENT, json.dumps(doc).encode())
    a.with_chunks().groupBy(*(f"c{k}" for k in range(len(dims)))).applyInPandas(write, "n long").agg({"n": "sum"}).collect()


def as_column(values: np.ndarray) -> pa.Array:
    """Values as the Arrow type of the Spark type that holds their element type."""
    if values.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.copy()), pa.array(values.imag.copy())], ["re", "im"])
    if values.dtype == np.uint64:
        return pa.array([int(x) for x in values.tolist()], pa.decimal128(20, 0))
    if values.dtype.kind in "Mm":
        return pa.array(values.view(np.int64))
    if values.dtype.kind in "SV":
        return pa.array(values.tolist(), pa.binary())
    return pa.array(values.astype(HELD[str(values.dtype)]) if str(values.dtype) in HELD else values)


class ChunkPartition(InputPartition):
    def __init__(self, chunks: list[tuple[int, ...]]) -> None:
        self.chunks = chunks


class ChunkReader(DataSourceReader):
    def __init__(self, folder: str, doc: dict[str, Any], spec: ArraySpec) -> None:
        self.folder, self.doc, self.spec = folder, doc, spec
        self.bounds = {d: (0, n) for d, n in zip(spec.dims, spec.shape, strict=True)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of coordinates choose the chunks; Spark still applies every filter to the cells."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in self.bounds and isinstance(getattr(f, "value", None), int):
                lo, hi = self.bounds[name]
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, f.value), min(hi, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    lo = max(lo, f.value)
                elif isinstance(f, GreaterThan):
                    lo = max(lo, f.value + 1)
                elif isinstance(f, LessThan):
                    hi = min(hi, f.value)
                elif isinstance(f, LessThanOrEqual):
                    hi = min(hi, f.value + 1)
                self.bounds[name] = lo, hi
            yield f

    def partitions(self) -> list[ChunkPartition]:
        spans = []
        for axis, d in zip(self.spec.grid.axes, self.spec.dims, strict=True):
            lo, hi = self.bounds[d]
            spans.append(range(axis.index_of(lo), axis.index_of(hi - 1) + 1) if lo < hi else range(0))
        fs, path = store_of(self.folder)
        files = {x.path.removeprefix(path + "/") for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File}
        stored = math.prod(map(len, spans)) <= len(files)
        if stored:
            chunks = [c for c in itertools.product(*spans) if key_of(self.doc, c) in files]
        else:
            found = (self.coords(x) for x in files)
            chunks = sorted(c for c in found if c is not None and all(x in s for x, s in zip(c, spans, strict=True)))
        size = max(1, PARTITION_CELLS // max(1, math.prod(a.chunk_size(0) if a.n_chunks else 1 for a in self.spec.grid.axes)))
        return [ChunkPartition(chunks[i : i + size]) for i in range(0, len(chunks), size)]

    def coords(self, key: str) -> tuple[int, ...] | None:
        """The chunk that a file holds; None for other files."""
        enc = self.doc["chunk_key_encoding"]
        name, conf = (enc, {}) if isinstance(enc, str) else (enc["name"], enc.get("configuration", {}))
        try:
            found = parse_chunk_key(key, name, conf.get("separator")) if self.spec.ndim else ()
        except ValueError:
            return None
        return found if len(found) == self.spec.ndim and key_of(self.doc, found) == key else None

    def read(self, partition: ChunkPartition) -> Iterator[pa.RecordBatch]:
        for chunk in partition.chunks:
            yield self.cells(chunk)

    def cells(self, chunk: tuple[int, ...]) -> pa.RecordBatch:
        axes, codecs = self.spec.grid.axes, self.doc["codecs"]
        sizes = [a.chunk_size(c) for a, c in zip(axes, chunk, strict=True)]
        box = [(max(0, lo - a.offset(c)), min(a.data_size(c), hi - a.offset(c))) for a, c, (lo, hi) in zip(axes, chunk, self.bounds.values(), strict=True)]
        fs, path = store_of(self.folder)
        with fs.open_input_file(f"{path}/{key_of(self.doc, chunk)}") as f:
            if reads_parts(codecs):
                block = decode_shard(lambda at, n: f.read_at(n, at), f.size(), sizes, self.spec.dtype, codecs[0]["configuration"], self.spec.fill, box)
            else:
                block = decode_block(f.read(), sizes, self.spec.dtype, codecs, self.spec.fill)
        block = block[tuple(slice(lo, max(lo, hi)) for lo, hi in box)]
        at = np.indices(block.shape).reshape(block.ndim, -1)
        cols = [pa.array(i.astype(np.int64) + a.offset(c) + lo) for i, a, c, (lo, _) in zip(at, axes, chunk, box, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, as_column(block.reshape(-1))], [*self.spec.dims, "v"])


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkfiles"

    def _spec(self) -> tuple[dict[str, Any], ArraySpec]:
        doc = read_document(self.options["path"])
        return doc, spec_from_document(doc)

    def schema(self) -> str:
        _, spec = self._spec()
        return ", ".join([*(f"{d} long" for d in spec.dims), f"v {SPARK_TYPES[spec.dtype]}"])

    def reader(self, schema: Any) -> ChunkReader:
        return ChunkReader(self.options["path"], *self._spec())


def read_files(spark: SparkSession, folder: str) -> ArrayFrame:
    """The array of a folder; its cells are read when a plan runs.

    A frame's scan keeps the filters that were pushed to it last until others are, so every
    plan on the cells is given one: the first coordinate isn't negative.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkFiles)
    spec = spec_from_document(read_document(folder))
    cells = spark.read.format("chunkfiles").load(folder)
    return ArrayFrame(cells.filter(F.col(spec.dims[0]) >= 0) if spec.dims else cells, spec)
