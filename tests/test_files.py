import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.errors import ArrayNotFoundError, ContainsArrayError
from chunkloom.model import ArrayFrame, from_numpy
from chunkloom.operators.selection import select
from chunkloom.sources import chunkfiles as cf

BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
CHAINS = {
    "plain": [BYTES],
    "gzip, big": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}],
    "transposed": [{"name": "transpose", "configuration": {"order": [1, 0]}}, BYTES, {"name": "crc32c"}],
    "array codecs": [{"name": "numcodecs.delta", "configuration": {"dtype": "<i4"}}, BYTES, {"name": "numcodecs.zlib", "configuration": {"level": 1}}],
    "astype": [{"name": "numcodecs.astype", "configuration": {"encode_dtype": "<i8", "decode_dtype": "<i4"}}, BYTES, {"name": "numcodecs.crc32"}],
    "shards": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 5], "codecs": [BYTES, {"name": "zstd"}], "index_codecs": [BYTES, {"name": "crc32c"}], "index_location": "end"}}],
}


@pytest.mark.parametrize("name", CHAINS)
def test_files_round_trip(spark, tmp_path, name):
    a = np.arange(120, dtype=np.int32).reshape(12, 10)
    a[:6, :5] = 0
    folder = str(tmp_path / "x")
    cf.write_files(from_numpy(spark, a, (6, 5)), folder, CHAINS[name])
    stored = {p.name for p in (tmp_path / "x" / "c" / "0").iterdir()}
    assert stored == {"1"}  # the chunk of zeros alone is left out
    back = cf.read_files(spark, folder)
    assert np.array_equal(back.to_numpy(), a)
    got = select(back, (slice(7, 12), slice(6, 9)))
    assert np.array_equal(got.to_numpy(), a[7:12, 6:9])
    with pytest.raises(ContainsArrayError):
        cf.write_files(from_numpy(spark, a, (6, 5)), folder)


def test_filters_choose_files(spark, tmp_path):
    folder = str(tmp_path / "x")
    cf.write_files(from_numpy(spark, np.arange(1, 101), 10), folder)
    reader = cf.ChunkReader(folder, cf.read_document(folder), cf.spec_from_document(cf.read_document(folder)))
    list(reader.pushFilters([cf.GreaterThanOrEqual(("d0",), 23), cf.LessThan(("d0",), 47)]))
    assert [c for p in reader.partitions() for c in p.chunks] == [(2,), (3,), (4,)]
    with pytest.raises(ArrayNotFoundError):
        cf.read_document(str(tmp_path / "none"))


def test_appended_stream(spark, tmp_path):
    from chunkloom.streaming.append import append_stream

    src, out = tmp_path / "src", str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(i, float(10 * k + i)) for i in range(4)], "i long, x double").coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema("i long, x double").option("maxFilesPerTrigger", 1).json(str(src))
    q = append_stream(stream, "i", "x", out, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out).orderBy("d0").collect()
    assert [r.d0 for r in rows] == list(range(12)) and sorted(r.v for r in rows) == sorted(10.0 * k + i for k in range(3) for i in range(4))


def test_a_slice_reads_parts_of_shards(spark, tmp_path, monkeypatch):
    a = np.arange(1, 1601, dtype=np.int32).reshape(40, 40)
    inner = [BYTES]
    chain = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [5, 5], "codecs": inner, "index_codecs": [BYTES, {"name": "crc32c"}], "index_location": "start"}}]
    folder = f"file://{tmp_path}/x"
    cf.write_files(from_numpy(spark, a, (20, 20)), folder, chain)
    doc = cf.read_document(folder)
    conf, body, read = doc["codecs"][0]["configuration"], cf.read_bytes(folder, "c/0/1"), []

    def ranged(at, n):
        read.append(n)
        return body[at : at + n]

    block = cf.decode_shard(ranged, len(body), [20, 20], "int32", conf, 0, [(5, 10), (0, 3)])
    assert np.array_equal(block[5:10, :5], a[5:10, 20:25]) and block[:5].sum() == 0 and sum(read) == 16 * 16 + 4 + 100
    assert np.array_equal(select(cf.read_files(spark, folder), (slice(7, 33), slice(18, 22))).to_numpy(), a[7:33, 18:22])


def test_selections_of_one_array_are_independent(spark, tmp_path):
    a = np.arange(1, 101)
    cf.write_files(from_numpy(spark, a, 10), str(tmp_path / "x"))
    back = cf.read_files(spark, str(tmp_path / "x"))
    for s in (slice(3, 4), slice(None), slice(0, 100, 30), slice(None), slice(95, 99), slice(None)):
        assert np.array_equal(select(back, s).to_numpy(), a[s])


def test_older_documents_are_read(spark, tmp_path):
    import json
    import zlib

    a = np.arange(12, dtype="<i4").reshape(3, 4)
    doc = {"zarr_format": 2, "shape": [3, 4], "chunks": [2, 4], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": [{"id": "delta", "dtype": "<i4"}], "compressor": {"id": "zlib", "level": 1}}
    (tmp_path / ".zarray").write_text(json.dumps(doc))
    for k in range(2):
        block = np.zeros((2, 4), "<i4")
        block[: len(a[2 * k : 2 * k + 2])] = a[2 * k : 2 * k + 2]
        (tmp_path / f"{k}.0").write_bytes(zlib.compress(np.diff(block.reshape(-1), prepend=0).astype("<i4").tobytes()))
    assert np.array_equal(cf.read_files(spark, str(tmp_path)).to_numpy(), a)


@pytest.mark.parametrize("dtype", ["bool", "int8", "uint8", "uint16", "uint32", "uint64", "int64", "float16", "float32", "float64"])
def test_element_types_round_trip(spark, tmp_path, dtype):
    a = (np.arange(12) % 7).astype(dtype)
    top = np.array([1], "bool") if dtype == "bool" else np.array([np.finfo(dtype).max if dtype.startswith("float") else np.iinfo(dtype).max], dtype)
    a[3] = top[0]
    folder = str(tmp_path / "x")
    cf.write_files(from_numpy(spark, a, 5), folder)
    assert [dtype == "bool" and bool(x) or x for x in (r.v for r in cf.read_files(spark, folder).cells.orderBy("d0").collect()) if x] == [x for x in a.tolist() if x]
