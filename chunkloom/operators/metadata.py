"""Metadata documents: reading, checking with all problems at once, and migration from the older format."""

from __future__ import annotations

import base64
import json
import math
import re
import struct
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MetadataError
from ..functions.bytecodecs import OLD_CODEC_PREFIX
from ..grid import FixedAxis, Grid, VaryingAxis, compress_runs, expand_runs
from ..model import ITEM_SIZES, SPARK_TYPES, ArraySpec

#: Fixed values of the stored format: the key of its version, names of its document files.
FORMAT_KEY = "zarr_format"
DOCUMENT, OLD_DOCUMENTS = "zarr.json", (".zarray", ".zgroup", ".zattrs")
#: Keys of array and group documents of the newer format and the older one.
ARRAY_KEYS = (FORMAT_KEY, "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs")
ARRAY_EXTRA = ("attributes", "storage_transformers", "dimension_names")
OLD_KEYS = (FORMAT_KEY, "shape", "chunks", "dtype", "compressor", "fill_value", "order", "filters")
#: Letters of the older format's element types.
OLD_KINDS = {"b": "bool", "i": "int", "u": "uint", "f": "float", "c": "complex", "S": "null_terminated_bytes", "U": "fixed_length_utf32", "V": "raw_bytes", "M": "numpy.datetime64", "m": "numpy.timedelta64", "O": "string"}


@dataclass(frozen=True)
class Problem:
    where: str
    message: str


def array_problems(doc: Any) -> list[Problem]:
    """Everything that is wrong with an array document of the newer format."""
    if not isinstance(doc, Mapping):
        return [Problem("", "a document is an object")]
    out = [Problem(k, "is missing") for k in ARRAY_KEYS if k not in doc]
    if doc.get(FORMAT_KEY, 3) != 3:
        out.append(Problem(FORMAT_KEY, "must be 3"))
    if doc.get("node_type", "array") != "array":
        out.append(Problem("node_type", "must be 'array'"))
    shape = doc.get("shape", [])
    if not isinstance(shape, list) or any(not isinstance(n, int) or isinstance(n, bool) or n < 0 for n in shape):
        out.append(Problem("shape", "must be a list of integers of 0 and more"))
        shape = []
    for key in ("chunk_grid", "chunk_key_encoding"):
        out += [Problem(f"{key}{p.where}", p.message) for p in named_problems(doc[key])] if key in doc else []
    codecs = doc.get("codecs", [{}])
    if not isinstance(codecs, list) or not codecs:
        out.append(Problem("codecs", "must be a list of one codec or more"))
    else:
        out += [Problem(f"codecs[{i}]{p.where}", p.message) for i, c in enumerate(codecs) for p in (named_problems(c) if "codecs" in doc else [])]
    names = doc.get("dimension_names")
    if names is not None and (not isinstance(names, list) or len(names) != len(shape) or any(n is not None and not isinstance(n, str) for n in names)):
        out.append(Problem("dimension_names", "must be a name or null for each axis"))
    if not isinstance(doc.get("attributes", {}), Mapping):
        out.append(Problem("attributes", "must be an object"))
    if doc.get("storage_transformers"):
        out.append(Problem("storage_transformers", "aren't supported"))
    for k, v in doc.items():
        if k not in ARRAY_KEYS + ARRAY_EXTRA and not (isinstance(v, Mapping) and v.get("must_understand") is False):
            out.append(Problem(k, "is unknown and isn't marked must_understand = false"))
    return out


def named_problems(value: Any) -> list[Problem]:
    if isinstance(value, str):
        return []
    if not isinstance(value, Mapping):
        return [Problem("", "must be a name or an object")]
    out = [] if isinstance(value.get("name"), str) else [Problem(".name", "must be a string")]
    if not isinstance(value.get("configuration", {}), Mapping):
        out.append(Problem(".configuration", "must be an object"))
    return out


def old_array_problems(doc: Any) -> list[Problem]:
    if not isinstance(doc, Mapping):
        return [Problem("", "a document is an object")]
    out = [Problem(k, "is missing") for k in OLD_KEYS if k not in doc]
    if doc.get(FORMAT_KEY, 2) != 2:
        out.append(Problem(FORMAT_KEY, "must be 2"))
    if doc.get("order", "C") not in ("C", "F"):
        out.append(Problem("order", "must be C or F"))
    shape, chunks = doc.get("shape", []), doc.get("chunks", [])
    if isinstance(shape, list) and isinstance(chunks, list) and len(shape) != len(chunks):
        out.append(Problem("chunks", "must have as many sizes as there are axes"))
    if doc.get("filters") is not None and not isinstance(doc.get("filters"), list):
        out.append(Problem("filters", "must be a list or null"))
    return out


def group_problems(doc: Any) -> list[Problem]:
    if not isinstance(doc, Mapping):
        return [Problem("", "a document is an object")]
    out = [] if doc.get(FORMAT_KEY) in (2, 3) else [Problem(FORMAT_KEY, "must be 2 or 3")]
    if doc.get(FORMAT_KEY) == 3 and doc.get("node_type") != "group":
        out.append(Problem("node_type", "must be 'group'"))
    if not isinstance(doc.get("attributes", {}), Mapping):
        out.append(Problem("attributes", "must be an object"))
    return out


def document_problems(docs: DataFrame, path: str = "path", meta: str = "meta") -> DataFrame:
    """(path, where, message) of a table of documents."""

    def check(frames: Any) -> Any:
        import pandas as pd

        for frame in frames:
            rows = []
            for p, text in zip(frame[path], frame[meta], strict=True):
                try:
                    doc = json.loads(text)
                except (TypeError, ValueError):
                    rows.append((p, "", "isn't JSON"))
                    continue
                find = group_problems if isinstance(doc, Mapping) and doc.get("node_type") == "group" else old_array_problems if isinstance(doc, Mapping) and doc.get(FORMAT_KEY) == 2 else array_problems
                rows += [(p, x.where, x.message) for x in find(doc)]
            yield pd.DataFrame(rows, columns=["path", "where", "message"])

    return docs.select(path, meta).mapInPandas(check, "path string, where string, message string")


# -- fill values -----------------------------------------------------------------------


def fill_from_json(value: Any, dtype: str) -> Any:
    """A fill value as JSON writes it: NaN and infinities as strings, floats' bits in hex, bytes in base 64, complex in pairs."""
    if dtype.startswith("float"):
        if isinstance(value, str):
            if value in ("NaN", "Infinity", "-Infinity"):
                return float(value.replace("Infinity", "inf"))
            if value.startswith("0x"):
                n = int(dtype[5:]) // 8
                return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[n], bytes.fromhex(value[2:].zfill(n * 2)))[0]
            raise MetadataError(f"{value!r} is no float")
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
    elif dtype.startswith("complex"):
        if isinstance(value, list) and len(value) == 2:
            part = "float32" if dtype == "complex64" else "float64"
            return complex(fill_from_json(value[0], part), fill_from_json(value[1], part))
    elif dtype == "bool":
        if isinstance(value, bool):
            return value
    elif "int" in dtype:
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        if isinstance(value, int) and not isinstance(value, bool):
            from ..functions.cellcodecs import RANGES

            low, high = RANGES[dtype]
            if low <= value <= high:
                return value
    elif dtype in ("string", "fixed_length_utf32"):
        if isinstance(value, str):
            return value
    elif dtype in SPARK_TYPES and SPARK_TYPES[dtype] == "binary":
        if isinstance(value, str):
            return base64.standard_b64decode(value)
    elif dtype.startswith("numpy."):
        return None if value == "NaT" else int(value)
    raise MetadataError(f"{value!r} is no fill value of {dtype}")


def fill_to_json(value: Any, dtype: str) -> Any:
    if isinstance(value, complex):
        part = "float32" if dtype == "complex64" else "float64"
        return [fill_to_json(value.real, part), fill_to_json(value.imag, part)]
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity") if math.isinf(value) else value
    if isinstance(value, bytes):
        return base64.standard_b64encode(value).decode()
    return "NaT" if value is None and dtype.startswith("numpy.") else value


# -- documents and specs ------------------------------------------------------------------


def spec_from_document(doc: Mapping[str, Any]) -> ArraySpec:
    problems = array_problems(doc)
    if problems:
        raise MetadataError("; ".join(f"{p.where} {p.message}" for p in problems))
    grid, shape = doc["chunk_grid"], doc["shape"]
    conf = grid.get("configuration", {})
    if grid["name"] == "regular":
        axes = tuple(FixedAxis(c, n) for c, n in zip(conf["chunk_shape"], shape, strict=True))
    else:
        axes = tuple(FixedAxis(c, n) if isinstance(c, int) else VaryingAxis(tuple(expand_runs(c)), n) for c, n in zip(conf["chunk_shapes"], shape, strict=True))
    kind = doc["data_type"] if isinstance(doc["data_type"], str) else doc["data_type"]["name"]
    names = doc.get("dimension_names") or []
    dims = tuple(n or f"d{i}" for i, n in enumerate(names))
    return ArraySpec(Grid(axes), kind, fill_from_json(doc["fill_value"], kind), dims, dict(doc.get("attributes", {})), tuple(doc["codecs"]))


def document_from_spec(spec: ArraySpec) -> dict[str, Any]:
    grid = {"name": "regular", "configuration": {"chunk_shape": [a.size for a in spec.grid.axes]}} if spec.grid.regular else {"name": "rectilinear", "configuration": {"kind": "inline", "chunk_shapes": [a.size if isinstance(a, FixedAxis) else compress_runs(a.edges) for a in spec.grid.axes]}}
    default = [{"name": "bytes", "configuration": {"endian": "little"}} if ITEM_SIZES.get(spec.dtype, 1) > 1 else {"name": "bytes"}, {"name": "zstd", "configuration": {"level": 0, "checksum": False}}]
    return {
        FORMAT_KEY: 3, "node_type": "array", "shape": list(spec.shape), "data_type": spec.dtype, "chunk_grid": grid,
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill_to_json(bool(spec.fill) if spec.dtype == "bool" else spec.fill, spec.dtype),
        "codecs": list(spec.codecs) or default, "attributes": dict(spec.attributes), "dimension_names": list(spec.dims),
    }


def old_type(dtype: str) -> tuple[str, str]:
    """(name, byte order) of an older element type such as <f8."""
    order, kind, size = dtype[0], dtype[1], dtype[2:].split("[")[0]
    name = OLD_KINDS[kind]
    if name in ("int", "uint", "float", "complex"):
        name += str(int(size) * 8)
    return name, {"<": "little", ">": "big", "|": "none"}[order]


def migrated(old: Mapping[str, Any], attributes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """An older array document as a newer one: order F is a transpose, filters and compressor are codecs. No chunk is touched."""
    problems = old_array_problems(old)
    if problems:
        raise MetadataError("; ".join(f"{p.where} {p.message}" for p in problems))
    kind, endian = old_type(old["dtype"])
    codecs: list[dict[str, Any]] = []
    if old["order"] == "F" and len(old["shape"]) > 1:
        codecs.append({"name": "transpose", "configuration": {"order": list(range(len(old["shape"])))[::-1]}})
    serializer = "vlen-utf8" if kind == "string" else "bytes"
    byte_filters = []
    for f in old["filters"] or []:
        conf = {k: v for k, v in f.items() if k != "id"}
        if f["id"] not in ("vlen-utf8", "vlen-bytes"):
            byte_filters.append({"name": OLD_CODEC_PREFIX + f["id"], "configuration": conf})
    codecs += byte_filters
    codecs.append({"name": serializer, "configuration": {"endian": endian}} if serializer == "bytes" and endian != "none" else {"name": serializer})
    if c := old["compressor"]:
        conf = {k: v for k, v in c.items() if k != "id"}
        codecs.append({"name": c["id"] if c["id"] in ("blosc", "zstd", "gzip") else OLD_CODEC_PREFIX + c["id"], "configuration": conf})
    fill = old["fill_value"]
    if fill is None:
        fill = {"bool": False, "string": ""}.get(kind, 0)
    return {
        FORMAT_KEY: 3, "node_type": "array", "shape": list(old["shape"]), "data_type": kind,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(old["chunks"])}},
        "chunk_key_encoding": {"name": "v2", "configuration": {"separator": old.get("dimension_separator", ".")}},
        "fill_value": fill, "codecs": codecs, "attributes": dict(attributes or {}),
    }


def migrated_catalog(nodes: DataFrame) -> DataFrame:
    """(path, meta) with older array documents as newer ones."""

    def move(frames: Any) -> Any:
        for frame in frames:
            docs = [json.loads(x) for x in frame["meta"]]
            frame["meta"] = [json.dumps(migrated(d, d.get("attributes")) if d.get(FORMAT_KEY) == 2 and "shape" in d else d) for d in docs]
            yield frame

    return nodes.select("path", "meta").mapInPandas(move, "path string, meta string")


def removable(files: DataFrame, version: int, force: bool = False) -> DataFrame:
    """Metadata files (key) of one format that may go: those with a counterpart in the other, or with force all."""
    pattern = lambda names: "^(.*/)?(?:" + "|".join(map(re.escape, names)) + ")$"
    old, new = pattern(OLD_DOCUMENTS), pattern([DOCUMENT])
    mine, other = (old, new) if version == 2 else (new, old)
    named = lambda pattern: files.filter(F.col("key").rlike(pattern)).withColumn("node", F.regexp_extract("key", pattern, 1))
    found = named(mine)
    return (found if force else found.join(named(other).select("node").distinct(), "node", "left_semi")).select("key")
