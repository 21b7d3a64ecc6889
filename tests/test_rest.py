import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.errors import ContainsArrayError, ContainsGroupError, MetadataError, UnknownCodecError
from chunkloom.functions import bytecodecs as b
from chunkloom.functions import cellcodecs as c
from chunkloom.model import from_numpy
from chunkloom.operators import metadata as m
from chunkloom.operators.hierarchy import Catalog
from chunkloom.plans import lazy, messages
from chunkloom.sources import store


# -- codecs


@pytest.mark.parametrize("name", sorted(b.CODECS))
@given(data=st.binary(max_size=300))
@settings(max_examples=20, deadline=None)
def test_byte_codecs_round_trip(name, data):
    chain = [{"name": name}]
    assert b.decode_bytes(b.encode_bytes(data, chain), chain) == data


def test_checksums():
    assert b.crc32c(b"123456789") == 0xE3069283
    spoiled = bytearray(b.encode_bytes(b"abcdef", [{"name": "crc32c"}]))
    spoiled[0] ^= 1
    with pytest.raises(ValueError):
        b.decode_bytes(bytes(spoiled), [{"name": "crc32c"}])
    with pytest.raises(UnknownCodecError):
        b.coder({"name": "nope"})


@pytest.mark.parametrize("at", ["start", "end"])
def test_shards(at):
    shard = b.build_shard({0: b"aa", 3: b"bbb"}, 5, at)
    assert b.read_shard(shard, 5, index_at=at) == {0: b"aa", 3: b"bbb"}
    assert b.read_shard(shard, 5, [3, 4], at) == {3: b"bbb"}


def test_strings_bits_and_rounding():
    assert b.unpack_strings(b.pack_strings(["a", "", "ñx"])) == ["a", "", "ñx"]
    bits = np.arange(11) % 3 == 0
    assert len(b.pack_bits(bits)) == 1 + math.ceil(11 / 8) and np.array_equal(b.unpack_bits(b.pack_bits(bits)), bits)
    x = np.linspace(-3, 3, 50, dtype=np.float32)
    assert np.abs(b.bit_rounded(x, 10) - x).max() <= 3 * 2**-10 and np.array_equal(b.bit_rounded(x, 23), x)


@pytest.mark.parametrize("codecs", [[{"name": "bytes"}], [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}], [{"name": "bytes"}, {"name": "shuffle"}, {"name": "zstd"}, {"name": "crc32c"}]])
def test_chunks_as_bytes(spark, codecs):
    a = np.arange(35, dtype=np.int32).reshape(7, 5)
    f = from_numpy(spark, a, (3, 2))
    coded = b.encode_chunks(f.with_chunks(), ["c0", "c1"], ["d0", "d1"], [3, 2], "v", "int32", codecs)
    assert coded.count() == 9
    back = b.decode_chunks(coded, ["c0", "c1"], ["d0", "d1"], [3, 2], [7, 5], "v", "int32", "int", codecs)
    assert np.array_equal(f.replaced(back).to_numpy(), a)


def test_chains_are_checked():
    with pytest.raises(MetadataError):
        b.split_chain([{"name": "gzip"}, {"name": "bytes"}])


def test_cell_codecs(spark):
    df = spark.createDataFrame([(-3.5,), (0.5,), (1.5,), (300.0,)], "x double")
    got = lambda col: [r[0] for r in df.select(col).collect()]
    assert got(c.cast_value(F.col("x"), "uint8", "smallint", out_of_range="clamp")) == [0, 0, 2, 255]
    assert got(c.cast_value(F.col("x"), "uint8", "smallint", out_of_range="wrap", rounding="towards-zero")) == [253, 0, 1, 44]
    assert got(c.cast_value(F.col("x"), "uint8", "smallint", out_of_range="clamp", scalar_map=[(300.0, 7)])) == [0, 0, 2, 7]
    with pytest.raises(Exception, match="out of the range"):
        got(c.cast_value(F.col("x"), "uint8", "smallint"))
    with pytest.raises(Exception, match="multiple of the scale"):
        spark.range(5).select(c.scale_offset_decode(F.col("id"), 3, 1, integer=True)).collect()


def test_delta_both_ways(spark):
    values = np.array([5, 7, 7, 2, 9, 0, 4])
    f = from_numpy(spark, values, 3)
    coded = c.delta_across(f.cells, "v", "d0", 3).orderBy("d0").collect()
    assert [r.delta for r in coded] == [5, 2, 0, -5, 7, -9, 4]
    chunk = F.floor(F.col("d0") / 3)
    inner = c.delta_encoded(f.cells, "v", "d0", [chunk])
    back = c.delta_decoded(inner, "delta", "d0", [chunk], "back").orderBy("d0").collect()
    assert [r.back for r in back] == values.tolist()
    bits = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "p long, v boolean")
    assert {r.byte: r.bits for r in c.packed_bits(bits, "v", "p").collect()} == {0: 0b10010010, 1: 0b01000000}


# -- hierarchies


def nodes(spark, *rows):
    return spark.createDataFrame([(p, k, "{}") for p, k in rows], "path string, node_type string, meta string")


def test_catalog(spark, tmp_path):
    cat = Catalog.of(nodes(spark, ("a/b/x", "array"), ("a/y", "array"), ("z", "group")))
    assert {r.path for r in cat.nodes.collect()} == {"", "a", "a/b", "a/b/x", "a/y", "z"}
    assert {r.path for r in cat.members("a").collect()} == {"a/b", "a/y"}
    assert {r.path for r in cat.members("", None, "array").collect()} == {"a/b/x", "a/y"}
    assert {r.path: r.nmembers for r in cat.n_members().collect()} == {"": 2, "a": 2, "a/b": 1}
    with pytest.raises(ContainsArrayError):
        cat.created(nodes(spark, ("a/y", "array")))
    with pytest.raises(ContainsGroupError):
        cat.created(nodes(spark, ("a", "group")))
    over = cat.created(nodes(spark, ("a", "array")), overwrite=True)
    assert {r.path for r in over.nodes.collect()} == {"", "a", "z"}
    assert {r.path for r in cat.deleted("a/b").nodes.collect()} == {"", "a", "a/y", "z"}
    with pytest.raises(KeyError):
        cat.deleted("nope")
    with_attributes = cat.with_attributes("a", {"k": 1}).with_attributes("a", {"l": 2})
    assert with_attributes.group("a")["meta"]["attributes"] == {"k": 1, "l": 2}
    assert cat.tree().splitlines()[0] == "/" and "x" in cat.tree() and cat.tree(max_nodes=2).endswith("...")
    cat.save(str(tmp_path / "cat"))
    assert "a/b/x" in Catalog.load(spark, str(tmp_path / "cat"))
    assert set(cat.consolidated().first().metadata) == {"a", "a/b", "a/b/x", "a/y", "z"}
    with pytest.raises(ContainsArrayError):
        Catalog.of(nodes(spark, ("p", "array"), ("p/q", "array")))


# -- metadata


def test_documents_round_trip():
    doc = {
        m.FORMAT_KEY: 3, "node_type": "array", "shape": [60, 30], "data_type": "int16", "fill_value": 3,
        "chunk_grid": {"name": "rectilinear", "configuration": {"kind": "inline", "chunk_shapes": [[[10, 5], 5, 5], 15]}},
        "chunk_key_encoding": "default", "codecs": [{"name": "bytes"}],
    }
    spec = m.spec_from_document(doc)
    assert spec.grid.chunk_counts == (7, 2) and m.spec_from_document(m.document_from_spec(spec)).grid == spec.grid
    assert {p.where for p in m.array_problems({m.FORMAT_KEY: 2, "shape": [-1], "odd": 1})} >= {m.FORMAT_KEY, "shape", "odd", "codecs", "data_type"}


@pytest.mark.parametrize("kind,text", [("float64", "NaN"), ("float64", "-Infinity"), ("float64", 1.5), ("complex64", [1.0, "NaN"]), ("bool", True), ("uint64", 2**63), ("string", "x"), ("raw_bytes", "YWI=")])
def test_fill_values(kind, text):
    assert m.fill_to_json(m.fill_from_json(text, kind), kind) == text


def test_fill_values_by_bits_and_bad_ones():
    assert math.isnan(m.fill_from_json("0x7ff8000000000000", "float64"))
    for kind, bad in [("uint8", 256), ("bool", 1), ("float32", "x"), ("int8", "3")]:
        with pytest.raises(MetadataError):
            m.fill_from_json(bad, kind)


def test_migration(spark):
    old = {m.FORMAT_KEY: 2, "shape": [4, 6], "chunks": [2, 3], "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "F", "filters": None}
    new = m.migrated(old, {"a": 1})
    assert [x["name"] for x in new["codecs"]] == ["transpose", "bytes", m.OLD_CODEC_PREFIX + "zlib"] and new["attributes"] == {"a": 1}
    df = spark.createDataFrame([("x", json.dumps(old))], "path string, meta string")
    assert json.loads(m.migrated_catalog(df).first().meta)[m.FORMAT_KEY] == 3
    found = m.document_problems(spark.createDataFrame([("bad", "{"), ("ok", json.dumps(new)), ("old", json.dumps({m.FORMAT_KEY: 2, "shape": [1]}))], "path string, meta string")).collect()
    assert {r.path for r in found} == {"bad", "old"}
    old = m.OLD_DOCUMENTS[0]
    files = spark.createDataFrame([("a/" + old,), ("a/" + m.DOCUMENT,), ("b/" + old,), ("a/0.0",)], "key string")
    assert {r.key for r in m.removable(files, 2).collect()} == {"a/" + old}
    assert {r.key for r in m.removable(files, 2, force=True).collect()} == {"a/" + old, "b/" + old}


# -- stores


def test_coalesced_ranges(spark):
    rows = [(0, 3), (4, 6), (9, 12), (10, 11), (30, 31)]
    df = spark.createDataFrame(rows, "s long, e long")
    assert sorted(map(tuple, store.coalesced(df, 2, cells=3).collect())) == [(0, 6, 2), (9, 12, 2), (30, 31, 1)]
    assert store.coalesce_ranges([(10, 20), (0, 5), (21, 40)], max_gap=5, max_merged=30) == [[1, 0], [2]]
    assert store.coalesced(df.limit(0), 2).count() == 0


@given(st.lists(st.integers(0, 3), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_runs(spark, values):
    import itertools

    df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
    got = [(r.size, r.cnt) for r in store.runs(df, "i", "v", cells=4).orderBy("first_i").collect()]
    assert got == [(k, len(list(g))) for k, g in itertools.groupby(values)]


def test_stores(spark, tmp_path):
    f = store.FolderStore(str(tmp_path / "s"))
    f.set("a/b", b"0123456789")
    f.set("a/c", b"xyz")
    f.set("a/c", b"new", only_new=True)
    assert f.get("a/b", 2, 5) == b"234" and f.get("a/b", suffix=3) == b"789" and f.get("a/c") == b"xyz" and f.get("no") is None
    cached = store.CachedStore(f, max_bytes=12)
    assert [cached.get("a/b"), cached.get("a/b"), cached.get("a/c")] == [b"0123456789"] * 2 + [b"xyz"]
    assert cached.stats()["hits"] == 1 and cached.stats()["evictions"] == 1
    table = f.table(spark)
    assert {r.key for r in table.list_prefix("a/").collect()} == {"a/b", "a/c"} and table.get("a/b", start=1, stop=3) == b"12" and table.size_of_prefix("a") == 13
    assert [r.name for r in table.list_dir().collect()] == ["a"]
    more = table.with_values(spark.createDataFrame([("a/c", None), ("d", bytearray(b"1"))], "key string, value binary"))
    assert {r.key for r in more.list_prefix().collect()} == {"a/b", "d"}
    z = store.ZipFileStore(str(tmp_path / "z.zip"), "w")
    z.set("k", b"v")
    with pytest.raises(NotImplementedError):
        z.delete("k")
    z.close()
    assert store.ZipFileStore.table(spark, str(tmp_path / "z.zip")).get("k") == b"v"


# -- lazy views


@pytest.mark.parametrize("steps", [
    [np.s_[10:50:2], np.s_[3:12]], [np.s_[::-1]], [np.s_[5:1:-1], np.s_[1:]], [np.s_[7]], [np.s_[-9:], np.s_[::4]],
])
def test_lazy_views(spark, steps):
    a = np.arange(60)
    want, view = a, lazy.LazyArray(from_numpy(spark, a, 7))
    for x in steps:
        want, view = want[x], view[x]
    assert view.shape == want.shape and np.array_equal(view.result().to_numpy(), want)


def test_lazy_lists(spark):
    a = np.arange(60).reshape(12, 5)
    base = lazy.LazyArray(from_numpy(spark, a, (5, 2)))
    assert np.array_equal(base.oindex(([3, 1, 1], slice(1, 4)))[::2].result().to_numpy(), a[[3, 1, 1]][:, 1:4][::2])
    assert np.array_equal(base.vindex([0, 11, 0], [4, -1, 4])[1:].result().to_numpy(), a[[11, 0], [4, 4]])
    assert base[2:6].oindex(([0, 0, 3], [1])).transform.hull() == [(2, 6), (1, 2)]
    assert not base.oindex(([1], [2])).is_box and base[1:3].is_box
    assert sum(p.transform.domain.size for p in base.parts([5, 2])) == 60


def test_transforms():
    t = lazy.IndexTransform.identity((20,))[5:11:2]
    assert t.domain == lazy.Domain((2,), (5,)) and [t.apply((i,)) for i in (2, 3, 4)] == [(5,), (7,), (9,)]
    r = lazy.IndexTransform.identity((6,))[::-1]
    back = r.inverted()
    assert all(back.apply(r.apply((i,))) == (i,) for i in range(*[x[0] for x in (r.domain.lo, r.domain.hi)]))
    with pytest.raises(Exception):
        lazy.IndexTransform.identity((5,))[3:9]
    with pytest.raises(Exception):
        lazy.IndexTransform.identity((5,))[-1]
    moved = t.translated([10])
    assert moved.apply((12,)) == (5,)


def test_messages():
    box = messages.parse({"kind": "box", "inclusive_min": [1, 2], "exclusive_max": [3, 5]})
    assert messages.parse(messages.to_json(box)) == box
    assert messages.parse({"kind": "point", "coords": [4, -1]}).apply(()) == (4, -1)
    s = messages.parse({"kind": "slice", "start": [5], "stop": [11], "step": [2]})
    assert s.domain == lazy.Domain((2,), (5,))
    p = messages.parse({"kind": "points", "coords": [[1, 2], [3, 4]]})
    assert [p.apply((i,)) for i in range(2)] == [(1, 2), (3, 4)] and messages.parse(messages.to_json(p)) == p
    for bad, reason in [([], "not_object"), ({"kind": "x"}, "unknown_kind"), ({"kind": "point", "coords": [1.5]}, "not_integer"), ({"kind": "point", "coords": [2**63]}, "out_of_range"), ({"kind": "slice", "start": [0], "stop": [1], "step": [0]}, "zero_step"), ({"kind": "box", "inclusive_min": [3], "exclusive_max": [1]}, "invalid_bounds")]:
        with pytest.raises(messages.MessageError) as e:
            messages.parse(bad)
        assert e.value.reason == reason


# -- the catalogue


def test_catalogue_against_sql(spark):
    """A sample of the catalogue; the driver runs all of it."""
    from chunkloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation events orders embeddings".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("idx_slice_strided_1d", "idx_oindex_int_2d", "idx_mask_2d", "plan_projection_coverage", "arr_resize_grow", "codec_delta", "hier_implicit_groups", "lazy_reverse", "idx_block_1d"):
        got = catalogue.QUERIES[name](spark, sf)
        want = con.sql(catalogue.ORACLES[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), name


def test_errors_of_any_value_keep_their_chunk(spark, tmp_path):
    """A chunk is empty if none of its events is an error, whatever the errors' values are."""
    from chunkloom.plans import catalogue

    rows = [(0, "error", 0.0), (1, "view", 0.0), (10, "view", 5.0), (11, None, 0.0), (20, "error", 0.0), (21, "error", 3.0), (30, None, 2.0), (40, "error", None)]
    rows += [(50, "error", -0.0), (60, "error", float("nan")), (70, "error", 0.0), (71, None, 1.0), (80, "error", 4.0), (80, "view", 0.0), (None, "error", 0.0), (-15, "error", 0.0)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    got = [r.c0 for r in catalogue.QUERIES["arr_empty_chunk_elision"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in con.sql(catalogue.ORACLES["arr_empty_chunk_elision"]).fetchall()]
    key = lambda c: (c is not None, c or 0)
    assert sorted(got, key=key) == sorted(want, key=key) == [None, -1, 0, 2, 4, 5, 6, 7, 8]
