"""Selection messages: JSON of kind point, box, slice, points or transform, each as one transform."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np

from .lazy import INT64, Affine, Constant, Domain, IndexTransform, Lookup, Map, literal_slice


class MessageError(ValueError):
    """A message that is no selection; ``reason`` is a short code."""

    def __init__(self, reason: str, text: str = "") -> None:
        super().__init__(f"{reason}: {text}" if text else reason)
        self.reason = reason


def whole(x: Any) -> int:
    if not isinstance(x, int) or isinstance(x, bool):
        raise MessageError("not_integer", repr(x))
    if not -INT64 <= x < INT64:
        raise MessageError("out_of_range", repr(x))
    return x


def listed(obj: Mapping[str, Any], key: str) -> list[int]:
    if not isinstance(obj.get(key), list):
        raise MessageError("missing_field" if key not in obj else "wrong_type", key)
    return [whole(x) for x in obj[key]]


def parse(obj: Any) -> IndexTransform:
    """The transform of a message."""
    if not isinstance(obj, Mapping):
        raise MessageError("not_object")
    kind = obj.get("kind")
    if kind == "point":
        return IndexTransform(Domain((), ()), tuple(Constant(x) for x in listed(obj, "coords")))
    if kind == "box":
        lo = listed(obj, "inclusive_min") if "inclusive_min" in obj else None
        hi = listed(obj, "exclusive_max") if "exclusive_max" in obj else None
        if hi is None and "shape" in obj:
            shape = listed(obj, "shape")
            lo = lo if lo is not None else [0] * len(shape)
            hi = [a + n for a, n in zip(lo, shape, strict=True)]
        if hi is None:
            raise MessageError("missing_field", "exclusive_max")
        lo = lo if lo is not None else [0] * len(hi)
        if len(lo) != len(hi):
            raise MessageError("rank_mismatch")
        if any(b < a for a, b in zip(lo, hi, strict=True)):
            raise MessageError("invalid_bounds")
        return IndexTransform.identity(Domain(tuple(lo), tuple(hi)))
    if kind == "slice":
        start, stop = listed(obj, "start"), listed(obj, "stop")
        step = listed(obj, "step") if "step" in obj else [1] * len(start)
        if not len(start) == len(stop) == len(step):
            raise MessageError("rank_mismatch")
        lo, hi, maps = [], [], []
        for k, (a, b, s) in enumerate(zip(start, stop, step, strict=True)):
            if s == 0:
                raise MessageError("zero_step")
            if (b - a) * s < 0:
                raise MessageError("invalid_bounds")
            _, n, _ = literal_slice(slice(a, b, s), min(a, b + 1), max(b, a + 1))
            origin = int(a / s)
            maps.append(Affine(k, a - origin * s, s))
            lo.append(origin)
            hi.append(origin + n)
        return IndexTransform(Domain(tuple(lo), tuple(hi)), tuple(maps))
    if kind == "points":
        rows = obj.get("coords")
        if not isinstance(rows, list) or any(not isinstance(r, list) for r in rows):
            raise MessageError("wrong_type", "coords")
        points = [[whole(x) for x in r] for r in rows]
        if len({len(r) for r in points}) > 1:
            raise MessageError("rank_mismatch")
        table = np.array(points, np.int64).reshape(len(points), -1)
        return IndexTransform(Domain((0,), (len(points),)), tuple(Lookup(table[:, k], (0,)) for k in range(table.shape[1])))
    if kind == "transform":
        return from_json(obj)
    raise MessageError("unknown_kind" if kind is not None else "missing_field", "kind")


def from_json(obj: Mapping[str, Any]) -> IndexTransform:
    lo, hi = listed(obj, "input_inclusive_min"), listed(obj, "input_exclusive_max")
    if len(lo) != len(hi):
        raise MessageError("rank_mismatch")
    maps: list[Map] = []
    for m in obj.get("output", []):
        offset, stride = whole(m.get("offset", 0)), whole(m.get("stride", 1))
        if "input_dimension" in m:
            axis = whole(m["input_dimension"])
            if not 0 <= axis < len(lo):
                raise MessageError("invalid_dimension")
            maps.append(Affine(axis, offset, stride))
        elif "index_array" in m:
            table = np.array(m["index_array"], np.int64)
            axes = tuple(k for k, n in enumerate(table.shape) if n != 1 or hi[k] - lo[k] == 1)
            maps.append(Lookup(table.reshape([table.shape[k] for k in axes]), axes, offset, stride))
        else:
            maps.append(Constant(offset))
    return IndexTransform(Domain(tuple(lo), tuple(hi), tuple(obj["input_labels"]) if obj.get("input_labels") else None), tuple(maps))


def to_json(t: IndexTransform) -> dict[str, Any]:
    out: list[dict[str, Any]] = []
    for m in t.maps:
        if isinstance(m, Constant):
            out.append({"offset": m.offset})
        elif isinstance(m, Affine):
            out.append({"offset": m.offset, "stride": m.stride, "input_dimension": m.axis})
        else:
            full = m.table.reshape([m.table.shape[m.axes.index(k)] if k in m.axes else 1 for k in range(t.domain.ndim)])
            out.append({"offset": m.offset, "stride": m.stride, "index_array": full.tolist()})
    made = {"kind": "transform", "input_inclusive_min": list(t.domain.lo), "input_exclusive_max": list(t.domain.hi), "output": out}
    return made | ({"input_labels": list(t.domain.labels)} if t.domain.labels else {})


def normalized(obj: Any) -> dict[str, Any]:
    return to_json(parse(obj))
