"""Arrays and groups of them in a folder: save, open and load by one name each."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..errors import ContainsArrayError, ContainsGroupError, GroupNotFoundError
from ..model import ArrayFrame
from ..operators.metadata import DOCUMENT, FORMAT_KEY
from .chunkfiles import has_file, put_file, read_bytes, read_files, store_of, write_files


def group_document(folder: str) -> dict[str, Any] | None:
    doc = json.loads(read_bytes(folder, DOCUMENT)) if has_file(folder, DOCUMENT) else None
    return doc if doc and doc["node_type"] == "group" else None


def save(folder: str, *arrays: ArrayFrame, codecs: Sequence[dict[str, Any]] = (), overwrite: bool = False, attributes: Mapping[str, Any] | None = None, **named: ArrayFrame) -> None:
    """One array as the folder itself; several, or named ones, as a group's, those without a name as arr_0 and on."""
    if not arrays and not named:
        raise ValueError("there is nothing to save")
    if has_file(folder, DOCUMENT) and not overwrite:
        raise (ContainsGroupError if group_document(folder) else ContainsArrayError)(folder)
    if len(arrays) == 1 and not named:
        write_files(arrays[0], folder, codecs, overwrite)
        return
    put_file(folder, DOCUMENT, json.dumps({FORMAT_KEY: 3, "node_type": "group", "attributes": dict(attributes or {})}).encode())
    for name, a in {**{f"arr_{i}": a for i, a in enumerate(arrays)}, **named}.items():
        write_files(a, f"{folder}/{name}", codecs, overwrite)


def open_any(spark: SparkSession, folder: str) -> ArrayFrame | dict[str, Any]:
    """The array of a folder, or a group's arrays and groups by name; nothing is read but documents."""
    if not group_document(folder):
        return read_files(spark, folder)
    fs, path = store_of(folder)
    children = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.Directory)
    return {name: open_any(spark, f"{folder}/{name}") for name in children if has_file(f"{folder}/{name}", DOCUMENT)}


def open_group(spark: SparkSession, folder: str) -> dict[str, Any]:
    found = group_document(folder)
    if found is None:
        raise GroupNotFoundError(folder)
    return open_any(spark, folder)


def load(spark: SparkSession, folder: str) -> np.ndarray | dict[str, Any]:
    """Everything below a folder in memory, on the driver: for what fits there."""
    fetch = lambda x: {k: fetch(v) for k, v in x.items()} if isinstance(x, dict) else x.to_numpy()
    return fetch(open_any(spark, folder))
