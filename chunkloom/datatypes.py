"""Element types by name and parameters: what NumPy and Spark hold them in, and their document form."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .errors import MetadataError
from .model import SPARK_TYPES

#: Units of points and spans of time.
UNITS = ("generic", "Y", "M", "W", "D", "h", "m", "s", "ms", "us", "ns", "ps", "fs", "as")
#: Fixed value: the tick that stands for no time.
NAT = -(2**63)


@dataclass(frozen=True)
class DataType:
    """name and configuration as in a document; numpy: the type in memory; spark: the column type; default: the fill value."""

    name: str
    configuration: Mapping[str, Any] = field(default_factory=dict)
    numpy: np.dtype = field(default_factory=lambda: np.dtype("f8"))
    spark: str = "double"
    default: Any = 0

    @property
    def item_size(self) -> int | None:
        return None if self.numpy == object else self.numpy.itemsize

    def document(self) -> str | dict[str, Any]:
        return {"name": self.name, "configuration": dict(self.configuration)} if self.configuration else self.name

    def cast(self, value: Any) -> Any:
        """A scalar of this type; what doesn't fit raises."""
        if self.numpy == object:
            return value
        try:
            out = np.asarray(value).astype(self.numpy, casting="unsafe")[()]
        except (ValueError, TypeError) as error:
            raise MetadataError(f"{value!r} is no {self.name}") from error
        if self.numpy.kind in "iu" and int(out) != int(value):
            raise MetadataError(f"{value!r} is out of the range of {self.name}")
        return out


def length_of(conf: Mapping[str, Any], name: str) -> int:
    n = conf.get("length_bytes")
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise MetadataError(f"{name} needs length_bytes")
    return n


def _fixed_text(conf: Mapping[str, Any]) -> DataType:
    n = length_of(conf, "fixed_length_utf32")
    if n % 4:
        raise MetadataError("length_bytes of code points is a multiple of 4")
    return DataType("fixed_length_utf32", conf, np.dtype(f"U{n // 4}"), "string", "")


def _time(name: str, letter: str) -> Callable[[Mapping[str, Any]], DataType]:
    def make(conf: Mapping[str, Any]) -> DataType:
        unit, scale = conf.get("unit", "generic"), conf.get("scale_factor", 1)
        if unit not in UNITS or not isinstance(scale, int) or not 1 <= scale < 2**31:
            raise MetadataError(f"{name} has no unit {unit!r} with factor {scale!r}")
        kind = letter if unit == "generic" else f"{letter}[{scale}{unit}]"
        return DataType(name, conf, np.dtype(kind), "bigint", NAT)

    return make


def _structured(conf: Mapping[str, Any]) -> DataType:
    fields = [(f[0], parse(f[1])) if isinstance(f, (list, tuple)) else (f["name"], parse(f["data_type"])) for f in conf.get("fields", [])]
    if not fields or len({n for n, _ in fields}) != len(fields):
        raise MetadataError("fields have names of their own")
    return DataType("structured", conf, np.dtype([(n, t.numpy) for n, t in fields]), "struct<" + ",".join(f"{n}:{t.spark}" for n, t in fields) + ">", tuple(t.default for _, t in fields))


def _plain(name: str) -> Callable[[Mapping[str, Any]], DataType]:
    kind = np.dtype(name)
    return lambda conf: DataType(name, {}, kind, SPARK_TYPES[name], kind.type(0).item())


REGISTRY: dict[str, Callable[[Mapping[str, Any]], DataType]] = {
    **{n: _plain(n) for n in ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128")},
    "string": lambda conf: DataType("string", {}, np.dtype(object), "string", ""),
    "variable_length_bytes": lambda conf: DataType("variable_length_bytes", {}, np.dtype(object), "binary", b""),
    "fixed_length_utf32": _fixed_text,
    "null_terminated_bytes": lambda conf: DataType("null_terminated_bytes", conf, np.dtype(f"S{length_of(conf, 'null_terminated_bytes')}"), "binary", b""),
    "raw_bytes": lambda conf: DataType("raw_bytes", conf, np.dtype(f"V{length_of(conf, 'raw_bytes')}"), "binary", b""),
    "numpy.datetime64": _time("numpy.datetime64", "M8"),
    "numpy.timedelta64": _time("numpy.timedelta64", "m8"),
    "structured": _structured,
}


def register(name: str, make: Callable[[Mapping[str, Any]], DataType]) -> None:
    """A type of one's own; a name that is taken is an error."""
    if name in REGISTRY:
        raise MetadataError(f"there is a type {name!r} already")
    REGISTRY[name] = make


def parse(spec: Any) -> DataType:
    """The type that a document's data_type names, a string or a name with a configuration."""
    name, conf = (spec, {}) if isinstance(spec, str) else (spec.get("name"), spec.get("configuration", {})) if isinstance(spec, Mapping) else (None, {})
    if name not in REGISTRY:
        raise MetadataError(f"no data type {spec!r}")
    return REGISTRY[name](conf)


def of_numpy(kind: np.dtype | str) -> DataType:
    """The type of a NumPy element type."""
    kind = np.dtype(kind)
    if kind.names:
        return parse({"name": "structured", "configuration": {"fields": [[n, of_numpy(kind[n]).document()] for n in kind.names]}})
    if kind.kind == "U":
        return parse({"name": "fixed_length_utf32", "configuration": {"length_bytes": kind.itemsize}})
    if kind.kind in "SV":
        return parse({"name": "null_terminated_bytes" if kind.kind == "S" else "raw_bytes", "configuration": {"length_bytes": kind.itemsize}})
    if kind.kind in "Mm":
        unit, scale = np.datetime_data(kind)
        return parse({"name": f"numpy.{'datetime' if kind.kind == 'M' else 'timedelta'}64", "configuration": {"unit": unit, "scale_factor": scale}})
    if kind == object:
        return parse("string")
    return parse(kind.name)
