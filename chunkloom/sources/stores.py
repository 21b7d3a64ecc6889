"""Stores of any place that pyarrow reaches, wrappers of stores, and the store that a name stands for."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow.fs as pafs

from .store import FolderStore, ZipFileStore


class UriStore:
    """Files below a URI: local, HDFS, S3, GCS and what else pyarrow has a file system for."""

    def __init__(self, uri: str, read_only: bool = False) -> None:
        self.uri, self.read_only = uri, read_only
        self.fs, root = pafs.FileSystem.from_uri(uri)
        self.root = root.rstrip("/")

    def _path(self, key: str) -> str:
        if not key or any(p in ("", ".", "..") for p in key.split("/")):
            raise ValueError(f"{key!r} is no key")
        return f"{self.root}/{key}"

    def get(self, key: str, start: int | None = None, stop: int | None = None, suffix: int | None = None) -> bytes | None:
        if self.fs.get_file_info(self._path(key)).type != pafs.FileType.File:
            return None
        with self.fs.open_input_file(self._path(key)) as f:
            size = f.size()
            lo = max(0, size - suffix) if suffix is not None else min(start or 0, size)
            return f.read_at(max(0, min(size if stop is None else stop, size) - lo), lo)

    def set(self, key: str, value: bytes) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        self.fs.create_dir(self._path(key).rsplit("/", 1)[0], recursive=True)
        draft = f"{self._path(key)}.{time.time_ns():x}-{os.getpid():x}"
        with self.fs.open_output_stream(draft, compression=None) as f:
            f.write(value)
        self.fs.move(draft, self._path(key))

    def delete(self, key: str) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        if self.fs.get_file_info(self._path(key)).type == pafs.FileType.File:
            self.fs.delete_file(self._path(key))

    def list_prefix(self, prefix: str = "") -> Iterator[str]:
        for x in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            key = x.path.removeprefix(self.root + "/")
            if x.type == pafs.FileType.File and key.startswith(prefix):
                yield key


class MemoryStore:
    """A mapping of keys to bytes."""

    def __init__(self, held: Mapping[str, bytes] | None = None) -> None:
        self.held = dict(held or {})

    def get(self, key: str, start: int | None = None, stop: int | None = None, suffix: int | None = None) -> bytes | None:
        value = self.held.get(key)
        return value if value is None else value[max(0, len(value) - suffix) :] if suffix is not None else value[start or 0 : stop]

    def set(self, key: str, value: bytes) -> None:
        self.held[key] = bytes(value)

    def delete(self, key: str) -> None:
        self.held.pop(key, None)

    def list_prefix(self, prefix: str = "") -> Iterator[str]:
        return (k for k in sorted(self.held) if k.startswith(prefix))


class AroundStore:
    """Another store; every call passes through ``around``, which subclasses change."""

    def __init__(self, base: Any) -> None:
        self.base = base

    def around(self, name: str, call: Any, *args: Any, **named: Any) -> Any:
        return call(*args, **named)

    def __getattr__(self, name: str) -> Any:
        found = getattr(self.base, name)
        return (lambda *args, **named: self.around(name, found, *args, **named)) if callable(found) else found


class LoggedStore(AroundStore):
    """Logs each call with its seconds, and counts them."""

    def __init__(self, base: Any, logger: logging.Logger | None = None) -> None:
        super().__init__(base)
        self.logger, self.calls = logger or logging.getLogger("chunkloom.store"), {}

    def around(self, name: str, call: Any, *args: Any, **named: Any) -> Any:
        began = time.perf_counter()
        self.calls[name] = self.calls.get(name, 0) + 1
        try:
            return call(*args, **named)
        finally:
            self.logger.info("%s %s %.6f s", name, args[:1], time.perf_counter() - began)


class SlowStore(AroundStore):
    """Waits before each read and write, as a far store does."""

    def __init__(self, base: Any, get_seconds: float = 0.0, set_seconds: float = 0.0) -> None:
        super().__init__(base)
        self.waits = {"get": get_seconds, "set": set_seconds}

    def around(self, name: str, call: Any, *args: Any, **named: Any) -> Any:
        time.sleep(self.waits.get(name, 0.0))
        return call(*args, **named)


def resolved(like: Any, mode: str = "r") -> Any:
    """The store that a value stands for: a store, a mapping, a URI, a path of a ZIP file, or a folder."""
    if hasattr(like, "get") and hasattr(like, "list_prefix"):
        return like
    if like is None or isinstance(like, Mapping):
        return MemoryStore(like)
    path = os.fspath(like)
    if path.startswith("memory://"):
        return MemoryStore()
    if "://" in path:
        return UriStore(path, read_only=mode == "r")
    if path.endswith(".zip"):
        return ZipFileStore(path, "r" if mode == "r" else "a")
    return FolderStore(path, read_only=mode == "r")
