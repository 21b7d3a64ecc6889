"""Two-level windows, and operators that once were wrong at their borders."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.functions import bytecodecs, cellcodecs
from chunkloom.functions.bytecodecs import split_chain
from chunkloom.grid import VaryingAxis, guess_chunks, shard_sizes
from chunkloom.model import ArrayFrame, from_numpy
from chunkloom.operators import hierarchy, levels, metadata, planning, writing
from chunkloom.sources import store


@pytest.mark.parametrize("seed", range(4))
def test_ranges_merge_as_in_one_task(spark, seed):
    r = random.Random(seed)
    ranges = [(s, s + r.choice([1, 3, 400])) for s in (r.randrange(6000) for _ in range(r.choice([0, 1, 60])))]
    df = spark.createDataFrame(ranges, "s long, e long")
    want, gap = [], 7
    for s, e in sorted(ranges):
        if want and s - want[-1][1] <= gap:
            want[-1] = [want[-1][0], max(want[-1][1], e), want[-1][2] + 1]
        else:
            want.append([s, e, 1])
    assert sorted([x.start_, x.end_, x.n] for x in store.coalesced(df, gap, cells=9).collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_runs_go_across_cells(spark, seed):
    r = random.Random(seed)
    values = [r.choice([None, 1, 1, 1, 2]) for _ in range(r.choice([0, 1, 80]))]
    where = sorted(r.sample(range(300), len(values)))
    df = spark.createDataFrame(list(zip(where, values)), "i long, v long")
    want = []
    for i, v in zip(where, values):
        if want and want[-1][1] == v:
            want[-1][2] += 1
        else:
            want.append([i, v, 1])
    assert sorted([x.first_i, x["size"], x.cnt] for x in store.runs(df, "i", "v", 7).collect()) == sorted(want)


def test_running_sums_and_rows_before(spark):
    rows = [(k, k % 5) for k in range(0, 9000, 7)]
    df = spark.createDataFrame(rows, "k long, v long")
    total, want = 0, {}
    for n, (k, v) in enumerate(rows):
        total += v
        want[k] = (total, rows[n - 1][1] if n else None)
    out = levels.previous(levels.running_sum(df, "k", "v", "total", 10), "k", "v", "before", 10)
    assert {r.k: (r.total, r.before) for r in out.collect()} == want
    points = spark.createDataFrame([(i % 30, i % 7) for i in range(200)], "x long, y long")
    got = sorted(tuple(r) for r in planning.coordinate_groups(points, ["x", "y"], [10, 4]).collect())
    assert [r[3] for r in got] == np.cumsum([r[2] for r in got]).tolist() and sum(r[2] for r in got) == 200


def test_delta_goes_over_absent_chunks(spark):
    df = spark.createDataFrame([(0, 5), (1, 7), (25, 9)], "p long, v long")
    got = cellcodecs.delta_across(df, "v", "p", 10).orderBy("p").collect()
    assert [r.delta for r in got] == [5, 2, 2]


def test_nan_has_no_integer(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    for mode in ("clamp", "wrap", None):
        with pytest.raises(PySparkException):
            df.select(cellcodecs.cast_value(F.col("x"), "uint8", "smallint", out_of_range=mode)).collect()
    got = df.select(cellcodecs.cast_value(F.col("x"), "uint8", "smallint", out_of_range="clamp", scalar_map=[(float("nan"), 7)]).alias("y")).collect()
    assert [r.y for r in got] == [1, 7]


def test_shards_share_one_factor():
    assert shard_sizes((64, 64, 64), (1, 1, 1), "auto", 1, 64) == (4, 4, 4)
    assert shard_sizes((1000, 10), (10, 10), "auto", 1, 1600) == (10, 10)
    assert shard_sizes((1000, 1000), (10, 10), "auto", 4, 100) == (10, 10)
    assert shard_sizes((1000, 1000), (10, 10), "auto", 4, 3600) == (30, 30)


def test_guessed_chunks():
    assert guess_chunks((100,), 8) == (100,) and guess_chunks((0, 5), 8) == (1, 5) and guess_chunks((3, 4), 0) == (3, 4)
    for shape in ((10_000_000,), (100_000, 3000), (17, 10_000, 999)):
        sizes = guess_chunks(shape, 4)
        assert all(c <= n for c, n in zip(sizes, shape)) and 64 * 1024 < np.prod(sizes) * 4 < 64 * 2**20
        halvings = [next(h for h in range(40) if -(-n >> h) == c) for c, n in zip(sizes, shape)]
        assert max(halvings) - min(halvings) <= 1


def test_edges_are_found_by_halving(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 64, 777):
        axis = VaryingAxis(tuple(r.randint(1, 9) for _ in range(n)), n)
        got = spark.range(axis.extent).select("id", axis.chunk_of(F.col("id")).alias("c")).collect()
        assert all(x.c == axis.index_of(x.id) for x in got)


def test_suffixes_of_bytes_and_strings(spark):
    df = spark.createDataFrame([("k", bytearray(b"abc\xc3\xa9")), ("l", bytearray(b"x"))], "key string, value binary")
    s = store.TableStore(df)
    assert s.get("k", suffix=3) == b"c\xc3\xa9" and s.get("l", suffix=3) == b"x" and s.get("k", suffix=0) == b""
    assert df.select(store.byte_range(F.lit("höhe"), suffix=3).alias("x")).first().x == "öhe"


def test_keys_stay_in_the_folder(tmp_path):
    s = store.FolderStore(str(tmp_path / "st"))
    for key in ("../st-evil/x", "../x", "a/../../x", "/etc/x"):
        with pytest.raises(ValueError):
            s.set(key, b"x")
    s.set("a/b", b"x")
    assert s.get("a/b") == b"x"


def test_migrated_documents_are_read_by_the_library():
    old = {"zarr_format": 2, "shape": [10], "chunks": [5], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": [{"id": "delta", "dtype": "<i4"}], "compressor": {"id": "zlib", "level": 1}}
    codecs = metadata.migrated(old)["codecs"]
    arrays, serializer, chain = split_chain(codecs)
    assert [len(arrays), serializer["name"], len(chain)] == [1, "bytes", 1]
    assert bytecodecs.decode_bytes(bytecodecs.encode_bytes(b"abc", chain), chain) == b"abc"


@pytest.mark.parametrize("data", [b"", b"123456789", bytes(32), b"\xff" * 32, bytes(range(32))])
def test_checksum_values(data):
    known = {b"": 0, b"123456789": 0xE3069283, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E}
    assert bytecodecs.crc32c(data) == known[data]


def test_checksums_of_all_lengths():
    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (bytecodecs.CASTAGNOLI if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    r = random.Random(1)
    for n in [*range(40), 255, 256, 257, 1000, 4099]:
        data = r.randbytes(n)
        assert bytecodecs.crc32c(data) == plain(data)


def test_parameters_are_checked():
    from chunkloom.errors import MetadataError

    with pytest.raises(MetadataError):
        bytecodecs.coder({"name": "gzip", "configuration": {"levle": 3}})
    for name in ("crc32", "crc32c", "adler32"):
        for location in ("start", "end"):
            enc, dec = bytecodecs.coder({"name": f"numcodecs.{name}", "configuration": {"location": location}})
            assert dec(enc(b"abc")) == b"abc" and (enc(b"abc")[4:] if location == "start" else enc(b"abc")[:3]) == b"abc"


def test_lists_masks_and_blocks_are_assigned(spark):
    a = np.arange(48, dtype=np.int64).reshape(6, 8)
    frame = from_numpy(spark, a, (2, 4))
    want = a.copy()
    want[np.ix_([5, 0], [1, 7, 2])] = -1
    assert np.array_equal(writing.assign(frame, ([5, 0], [1, 7, 2]), -1).to_numpy(), want)
    want = a.copy()
    want[np.ix_([4, 2], [0, 3])] = [[100, 101], [102, 103]]
    patch = from_numpy(spark, np.array([[100, 101], [102, 103]]), (2, 2))
    assert np.array_equal(writing.assign(frame, ([4, 2], [True, False, False, True] + [False] * 4), patch).to_numpy(), want)
    want = a.copy()
    want[2:4, 4:8] = 0
    assert np.array_equal(writing.assign_blocks(frame, (1, 1), 0).to_numpy(), want)


def test_overwritten_groups_lose_all_below(spark):
    paths = ["a", "a/b", "a/b/c", "ab", "x/y"]
    nodes = spark.createDataFrame([(p, "group", "{}") for p in paths], "path string, node_type string, meta string")
    out = hierarchy.Catalog.of(nodes, check=False).put("a", "array", {}, overwrite=True)
    assert {(r.path, r.node_type) for r in out.nodes.collect()} == {("", "group"), ("a", "array"), ("ab", "group"), ("x", "group"), ("x/y", "group")}


def test_numpy_arrays_become_cells(spark):
    for dtype in ("bool", "int8", "uint8", "uint16", "uint32", "int64", "float32", "float64"):
        a = np.arange(6).astype(dtype).reshape(2, 3)
        assert np.array_equal(from_numpy(spark, a, 2).to_numpy().astype(dtype), a)


def test_blocks_beyond_the_grid(spark):
    from chunkloom.errors import BoundsError
    from chunkloom.operators.selection import blocks

    a = ArrayFrame.of(spark.range(10).select(F.col("id").alias("d0"), F.col("id").alias("v")), [10], 4)
    assert blocks(a, slice(5, 7)).shape == (0,)
    with pytest.raises(BoundsError):
        blocks(a, 5)
