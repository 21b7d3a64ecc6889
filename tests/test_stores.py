"""Stores and their wrappers, data types, requests and checksums."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom import datatypes
from chunkloom.errors import MetadataError
from chunkloom.functions import bytecodecs, requests
from chunkloom.grid import FixedAxis, Grid, VaryingAxis
from chunkloom.sources import stores
from chunkloom.sources.store import FolderStore, ZipFileStore


@pytest.fixture(params=["uri", "memory", "folder", "logging", "latency"])
def store(request, tmp_path):
    return {
        "uri": lambda: stores.UriStore(f"file://{tmp_path}"),
        "memory": stores.MemoryStore,
        "folder": lambda: FolderStore(str(tmp_path)),
        "logging": lambda: stores.LoggedStore(stores.MemoryStore()),
        "latency": lambda: stores.SlowStore(stores.MemoryStore(), 0.001, 0.001),
    }[request.param]()


def test_every_store_keeps_values(store):
    assert store.get("a/b") is None and list(store.list_prefix()) == []
    store.set("a/b", b"0123456789")
    store.set("a/c", b"")
    store.set("d", b"x")
    assert store.get("a/b") == b"0123456789" and store.get("a/c") == b""
    assert store.get("a/b", 2, 5) == b"234" and store.get("a/b", 7) == b"789" and store.get("a/b", suffix=3) == b"789"
    assert store.get("a/b", suffix=30) == b"0123456789" and store.get("a/b", 8, 30) == b"89" and store.get("a/b", 30, 40) == b""
    assert sorted(store.list_prefix("a/")) == ["a/b", "a/c"]
    store.set("a/b", b"new")
    assert store.get("a/b") == b"new"
    store.delete("a/b")
    store.delete("a/b")
    assert store.get("a/b") is None


def test_logged_calls_are_counted(caplog):
    s = stores.LoggedStore(stores.MemoryStore({"k": b"v"}))
    with caplog.at_level(logging.INFO, "chunkloom.store"):
        s.get("k")
        s.get("l")
    assert s.calls == {"get": 2} and len(caplog.records) == 2


def test_names_stand_for_stores(tmp_path):
    assert isinstance(stores.resolved(None), stores.MemoryStore) and stores.resolved({"a": b"b"}).get("a") == b"b"
    assert isinstance(stores.resolved(str(tmp_path)), FolderStore) and isinstance(stores.resolved(tmp_path), FolderStore)
    assert isinstance(stores.resolved(f"file://{tmp_path}"), stores.UriStore)
    assert isinstance(stores.resolved(str(tmp_path / "x.zip"), "w"), ZipFileStore)
    own = stores.MemoryStore()
    assert stores.resolved(own) is own
    with pytest.raises(PermissionError):
        stores.resolved(f"file://{tmp_path}").set("a", b"")
    with pytest.raises(ValueError):
        stores.resolved(f"file://{tmp_path}", "w").set("../a", b"")


@pytest.mark.parametrize("kind", ["?", "i1", "<i2", ">i4", "i8", "u1", "u2", "u4", "u8", "f2", "f4", "f8", "c8", "c16", "U5", "S3", "V4", "M8[s]", "M8[10us]", "m8[D]", "M8", "O", [("a", "i4"), ("b", "f8")]])
def test_types_go_through_their_documents(kind):
    kind = np.dtype(kind)
    t = datatypes.of_numpy(kind)
    assert datatypes.parse(t.document()) == t and t.numpy == kind.newbyteorder("=")
    assert t.item_size == (None if kind == object else kind.itemsize)


def test_types_that_are_none():
    bad = ["int7", 3, {"name": "raw_bytes"}, {"name": "fixed_length_utf32", "configuration": {"length_bytes": 5}}, {"name": "numpy.datetime64", "configuration": {"unit": "x"}}, {"name": "numpy.datetime64", "configuration": {"unit": "s", "scale_factor": 0}}, {"name": "structured", "configuration": {"fields": []}}]
    for spec in bad:
        with pytest.raises(MetadataError):
            datatypes.parse(spec)
    with pytest.raises(MetadataError):
        datatypes.register("int8", lambda conf: None)
    with pytest.raises(MetadataError):
        datatypes.parse("uint8").cast(256)
    assert datatypes.parse("uint8").cast(255) == 255 and datatypes.parse({"name": "null_terminated_bytes", "configuration": {"length_bytes": 2}}).cast(b"abc") == b"ab"


@pytest.mark.parametrize(
    "header, size, answer",
    [
        ("bytes=0-99", 50, (206, 0, 50)), ("bytes=5-2", 50, (416, None, None)), ("bytes=50-", 50, (416, None, None)), ("bytes=49-", 50, (206, 49, 50)), ("bytes=-7", 50, (206, 43, 50)), ("bytes=-70", 50, (206, 0, 50)),
        ("bytes=-0", 50, (416, None, None)), ("bytes=-5", 0, (416, None, None)), ("bytes=0-", 0, (416, None, None)), ("bytes=-", 50, (200, 0, 50)), ("bytes=1-2,3-4", 50, (200, 0, 50)), ("lines=1-2", 50, (200, 0, 50)), ("bytes= 1-2", 50, (200, 0, 50)),
        (None, 50, (200, 0, 50)), ("bytes=3-99999999999999999999999", 50, (206, 3, 50)), ("bytes=99999999999999999999999-", 50, (416, None, None)), ("bytes=1-" + "9" * 60, 50, (206, 1, 50)),
    ],
)
def test_range_headers(spark, header, size, answer):
    df = spark.createDataFrame([(header, size)], "h string, n long")
    assert tuple(df.select(requests.range_request(F.col("h"), F.col("n")).alias("r")).first().r) == answer


def test_keys_of_chunks(spark):
    grid = Grid((FixedAxis(4, 10), VaryingAxis((3, 3, 4), 10)))
    good = ["c/0/0", "c/2/2", "c/1/0"]
    bad = ["c/3/0", "c/0/3", "c/00/0", "c/0/+1", "c/-1/0", "c/0", "c/0/0/0", "0/0", "c/ 0/0", "c/0/0/", "d/0/0", "", "c/a/0", "c/99999999999999999999/0"]
    df = spark.createDataFrame([(k,) for k in good + bad], "k string")
    assert {r.k for r in df.filter(requests.is_chunk_key(F.col("k"), grid)).collect()} == set(good)
    old = spark.createDataFrame([("0.0",), ("2.2",), ("c/0/0",), ("0.3",)], "k string")
    assert {r.k for r in old.filter(requests.is_chunk_key(F.col("k"), grid, "v2")).collect()} == {"0.0", "2.2"}


def test_hash_values():
    text = b"Four score and seven years ago"
    assert bytecodecs.lookup3(b"") == 0xDEADBEEF and bytecodecs.lookup3(b"", 0xDEADBEEF) == 0xBD5B7DDE
    assert bytecodecs.lookup3(text) == 0x17770551 and bytecodecs.lookup3(text, 1) == 0xCD628161


def test_sizes_and_parts():
    plain, crc = {"name": "bytes"}, {"name": "crc32c"}
    assert bytecodecs.encoded_size(10, plain) == 10 and bytecodecs.encoded_size(10, crc) == 14
    with pytest.raises(MetadataError):
        bytecodecs.encoded_size(10, {"name": "gzip"})
    shard = {"name": "sharding_indexed", "configuration": {}}
    assert bytecodecs.reads_parts([shard]) and not bytecodecs.reads_parts([shard, crc]) and not bytecodecs.reads_parts([plain])


def test_arrays_and_groups_are_saved_and_opened(spark, tmp_path):
    from chunkloom.errors import ContainsArrayError, ContainsGroupError, GroupNotFoundError
    from chunkloom.model import from_numpy
    from chunkloom.sources.opening import load, open_any, open_group, save

    a, b = np.arange(6).reshape(2, 3), np.array([1.5, 2.5])
    one, many = str(tmp_path / "one"), f"file://{tmp_path}/many"
    save(one, from_numpy(spark, a, 2))
    save(many, from_numpy(spark, a, 2), b=from_numpy(spark, b, 1))
    assert np.array_equal(load(spark, one), a) and np.array_equal(open_any(spark, one).to_numpy(), a)
    got = load(spark, many)
    assert set(got) == {"arr_0", "b"} and np.array_equal(got["arr_0"], a) and np.array_equal(got["b"], b)
    assert set(open_group(spark, many)) == {"arr_0", "b"}
    for folder, error in ((one, ContainsArrayError), (many, ContainsGroupError)):
        with pytest.raises(error):
            save(folder, from_numpy(spark, a, 2))
    with pytest.raises(GroupNotFoundError):
        open_group(spark, one)
    with pytest.raises(ValueError):
        save(one)


def test_chunks_of_transforms(spark):
    from collections import Counter

    from chunkloom.plans.lazy import IndexTransform

    grid = Grid((FixedAxis(4, 10), VaryingAxis((3, 3, 4), 10)))
    t = IndexTransform.identity([10, 10])
    for x in (t, t[2:9], t[::-1, 1:8:3], t[5, 2:6], t.oindex([[0, 9, 9, 4], slice(0, 6)]), t.vindex([[1, 9, 1], [0, 9, 0]]), t[3:3], t[2:10].oindex([[5, 2], [0, 1, 2]])):
        want, cells = Counter(), {}
        d = x.domain
        for p in np.ndindex(*d.shape):
            r = x.apply([a + i for a, i in zip(d.lo, p)])
            c = tuple(g.index_of(v) for g, v in zip(grid.axes, r))
            want[c] += 1
            cells.setdefault(c, Counter())[r] += 1
        full = {c: np.prod([g.data_size(k) for g, k in zip(grid.axes, c)]) for c in want}
        got = {(r.c0, r.c1): (r.n, r.whole) for r in x.chunks(spark, grid).collect()}
        assert got == {c: (n, len(cells[c]) == full[c] and max(cells[c].values()) == 1) for c, n in want.items()}


def test_transforms_within_a_box():
    from chunkloom.plans.lazy import IndexTransform

    t = IndexTransform.identity([10, 10])
    for x in (t, t[2:9, ::-1], t[1::3, 8:0:-2], t[5], t.oindex([[0, 9, 9, 4], slice(0, 6)]), t[0:0]):
        for box in ([(3, 7), (2, 9)], [(0, 10), (0, 10)], [(5, 6), (0, 1)], [(7, 7), (0, 3)]):
            part = x.within(box)
            points = lambda y: sorted(y.apply([a + i for a, i in zip(y.domain.lo, p)]) for p in np.ndindex(*y.domain.shape))
            assert points(part) == [r for r in points(x) if all(a <= v < b for v, (a, b) in zip(r, box))]
