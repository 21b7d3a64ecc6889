"""The catalogue: one query per operator over the driver's tables, each through the library's operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cellcodecs, requests
from ..grid import FixedAxis, Grid, VaryingAxis, chunk_key_column, morton_code, shard_sizes
from ..model import ArrayFrame, from_vectors
from ..operators import hierarchy, metadata, planning, selection, writing
from ..sources import chunkfiles, store
from ..sources.chunkfiles import shared_folder
from . import lazy
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, chunks: int = 700) -> ArrayFrame:
    """The events' values as a one-dimensional array; its length is the table's row count (from Parquet footers)."""
    df = table(spark, sf_dir, "events")
    return ArrayFrame.of(df.select(F.col("event_id").alias("d0"), "value"), [df.count()], chunks, values=["value"])


def orders(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    df = table(spark, sf_dir, "orders")
    return ArrayFrame.of(df.select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("v")), [df.count()], 1000)


def orders_cube(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    df = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    div = lambda x, n: F.call_function("div", x, F.lit(n).cast("long"))
    return ArrayFrame.of(df.select(div(k, 500).alias("d0"), (div(k, 25) % 20).alias("d1"), (k % 25).alias("d2"), F.col("o_totalprice").alias("v")), [-(-df.count() // 500), 20, 25], [7, 6, 10])


def vectors(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    df = table(spark, sf_dir, "embeddings")
    return from_vectors(df, "vec_id", "embedding", [df.count(), 64], [100, 16])


def errors_only(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """A sparse array: only events of type error have a cell."""
    df = table(spark, sf_dir, "events")
    return ArrayFrame.of(df.filter("event_type = 'error'").select(F.col("event_id").alias("d0"), F.col("value").alias("v")), [df.count()], 50, fill=0.0)


def as_values(a: ArrayFrame, *names: str) -> DataFrame:
    return a.cells.select(*names) if names else a.cells


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- selections -------------------------------------------------------------------------


@query
def idx_scalar_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    return selection.basic(a, 42).cells.select(F.lit(42).cast("long").alias("event_id"), "value")


@query
def idx_negative_wrap_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    return selection.basic(a, -3).cells.select(F.lit(a.shape[0] - 3).cast("long").alias("event_id"), "value")


@query
def idx_slice_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(events(spark, sf_dir), slice(200, 400)).cells


@query
def idx_slice_strided_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(events(spark, sf_dir), slice(200, 900, 7)).cells


@query
def idx_basic_2d_drop_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(vectors(spark, sf_dir), (7, slice(8, 40))).cells


@query
def idx_ellipsis_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(orders_cube(spark, sf_dir), (..., 24)).cells


@query
def idx_oindex_int_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.orthogonal(vectors(spark, sf_dir), ([90, 3, 3], [60, 0])).cells


@query
def idx_oindex_bool_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    a = ArrayFrame.of(df.select(F.col("event_id").alias("d0"), "value", "event_type"), [df.count()], 700, values=["value", "event_type"])
    return selection.mask(a, F.col("event_type") == "error").select("o0", "value")


@query
def idx_vindex_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coordinates(vectors(spark, sf_dir), ([5, 499, 5], [0, 63, 0])).cells


@query
def idx_mask_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.mask(vectors(spark, sf_dir), F.col("v") > 0.3)


@query
def idx_block_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.blocks(events(spark, sf_dir), slice(2, 3)).cells


@query
def idx_block_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.blocks(vectors(spark, sf_dir), (slice(1, 3), 1)).cells


@query
def idx_oindex_bool_axis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    return selection.orthogonal(a, (slice(0, 20), [d % 3 == 0 for d in range(a.shape[1])])).cells


@query
def idx_vindex_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from a table of any size: each line item looks its order's price up."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("o"), F.col("l_orderkey").alias("d0"))
    return selection.coordinates(orders(spark, sf_dir), points)


@query
def idx_zero_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "events").agg(F.max("value").alias("v"))
    return selection.basic(ArrayFrame.of(top, [], []), ()).cells


@query
def idx_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    cells = df.select(F.col("o_orderkey").alias("d0"), F.struct("o_orderstatus", "o_totalprice", "o_orderdate").alias("v"))
    a = ArrayFrame.of(cells, [df.count()], 1000)
    return selection.select(a, ("o_orderstatus", "o_totalprice", slice(0, 100))).cells.withColumnRenamed("o0", "d0")


# -- plans and grids -----------------------------------------------------------------------


@query
def plan_accessed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    return planning.chunk_projections(spark, Grid.of([n], 50), slice(200, 400, 100)).select("c0")


@query
def plan_projection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    df = planning.chunk_projections(spark, Grid.of([n], 700), slice(500, 3000))
    return df.select("c0", F.col("sel_start0").alias("sel_start"), F.col("sel_stop0").alias("sel_stop"), F.col("out_start0").alias("out_start"), "is_complete")


@query
def plan_coordinate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.coordinate_groups(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d0")), ["d0"], [700])


@query
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = orders(spark, sf_dir).cells.withColumn("back", -F.col("d0")).withColumn("price", F.col("v"))
    named = [planning.order_of(a, "d0", c).withColumn("of", F.lit(c)) for c in ("d0", "back", "price")]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def grid_regular_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Grid((FixedAxis(700, table(spark, sf_dir, "events").count()),)).frame(spark)
    return df.select("c0", F.col("offset0").alias("chunk_offset"), F.col("size0").cast("int").alias("chunk_size"), F.col("data0").alias("data_size"))


@query
def grid_rectilinear_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    n = df.count()
    axis = VaryingAxis((100, 200, n - 300), n)
    return df.groupBy(axis.chunk_of(F.col("event_id")).alias("c0")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query
def grid_chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir).spec.grid.frame(spark)
    c = [F.col("c0"), F.col("c1")]
    return grid.select(*c, chunk_key_column(c).alias("key_default"), chunk_key_column(c, "v2").alias("key_v2"))


@query
def grid_morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("x"), (F.col("s_nationkey") % 4).cast("long").alias("y")).distinct()
    return df.withColumn("z", morton_code([F.col("x"), F.col("y")], [4, 4]))


@query
def grid_iterate_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).spec.grid.frame(spark).select("c0", "c1", "offset0", "offset1", "data0", "data1")


@query
def grid_rectilinear_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    df = Grid((VaryingAxis((100, 200, n - 300), n),)).frame(spark)
    return df.select("c0", F.col("offset0").alias("start"), (F.col("offset0") + F.col("data0")).alias("stop"))


@query
def grid_shard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    shards = shard_sizes(a.shape, (25, 8), (100, 16))
    grid = Grid.of(a.shape, shards).frame(spark)
    return grid.select("c0", "c1", chunk_key_column([F.col("c0"), F.col("c1")]).alias("key"))


@query
def plan_projection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    return planning.chunk_projections(spark, a.spec.grid, (slice(50, 150), slice(8, 40))).select("c0", "c1", "is_complete")


@query
def util_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.runs(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey").select("first_i", F.col("size").cast("int").alias("size"), "cnt")


# -- writes -----------------------------------------------------------------------------------


@query
def arr_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = errors_only(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    return writing.filled(writing.resized(sparse, [n])).cells


@query
def arr_chunks_initialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.n_initialized(errors_only(spark, sf_dir))


@query
def arr_empty_chunk_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    # flags, not values: an error of value 0.0 would pass for the fill value
    df = table(spark, sf_dir, "events")
    flag = F.coalesce(F.col("event_type") == "error", F.lit(False))
    flags = ArrayFrame.of(df.select(F.col("event_id").alias("d0"), flag.alias("v")), [df.count()], 10, dtype="bool", fill=False)
    return writing.stored_chunks(flags).select("c0")


@query
def arr_setitem_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.assign(events(spark, sf_dir), slice(100, 200), -1.0).cells.select("d0", F.col("value").alias("v"))


@query
def arr_setitem_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.assign(events(spark, sf_dir), F.col("value") > 400, 0.0).cells.select("d0", F.col("value").alias("v"))


@query
def arr_setitem_coords_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.createDataFrame([(0, 5, 1.5), (1, 9, 2.5), (2, 5, 3.5)], "ord int, d0 long, nv double")
    return writing.assign_points(events(spark, sf_dir), points).cells.select("d0", F.col("value").alias("v"))


@query
def arr_setitem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.assign(events(spark, sf_dir), ([3, 99, 7],), -5.0).cells.select("d0", F.col("value").alias("v"))


@query
def arr_setitem_orthogonal_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    patch = selection.orthogonal(a, ([9, 8], slice(0, 4)))
    return writing.assign(a, ([1, 2], slice(10, 14)), patch).cells


@query
def arr_setitem_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.assign_blocks(events(spark, sf_dir), 0, 0.5).cells.select("d0", F.col("value").alias("v"))


@query
def arr_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = writing.describe(events(spark, sf_dir))
    return spark.createDataFrame([(facts["size"], facts["nbytes"], facts["nchunks"])], "size long, nbytes long, nchunks long")


@query
def arr_metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spec through its document and back."""
    spec = metadata.spec_from_document(metadata.document_from_spec(vectors(spark, sf_dir).spec))
    return spec.grid.frame(spark).select("c0", "c1", F.col("size0").alias("rows"), F.col("size1").alias("columns"))


def stored(spark: SparkSession, a: ArrayFrame, *codecs: dict) -> ArrayFrame:
    """The array written to files in a folder that all executors share, and opened there."""
    folder = f"{shared_folder(spark)}/array-{uuid.uuid4().hex}"
    chunkfiles.write_files(a, folder, codecs)
    return chunkfiles.read_files(spark, folder)


@query
def store_files_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stored(spark, events(spark, sf_dir), {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}, {"name": "crc32c"})
    return a.cells.select("d0", "v")


@query
def store_files_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 100 x 16 with inner chunks of 25 x 8; a slice reads some inner chunks of some shards."""
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]
    a = stored(spark, vectors(spark, sf_dir), {"name": "sharding_indexed", "configuration": {"chunk_shape": [25, 8], "codecs": inner, "index_codecs": [inner[0], {"name": "crc32c"}]}})
    return selection.select(a, (slice(30, 60), slice(5, 20))).cells


@query
def store_files_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array codecs before the serializer: differences, and their transpose."""
    a = vectors(spark, sf_dir)
    keys = a.cells.select("d0", "d1", (F.col("d0") * 64 + F.col("d1")).alias("v"))
    chain = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "numcodecs.delta", "configuration": {"dtype": "<i8"}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "numcodecs.zlib", "configuration": {"level": 1}}]
    return stored(spark, ArrayFrame.of(keys, a.shape, [100, 16], dtype="int64"), *chain).cells


@query
def arr_resize_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.resized(events(spark, sf_dir), [777]).cells.select("d0", F.col("value").alias("v"))


@query
def arr_resize_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    return writing.filled(writing.resized(a, [a.shape[0] + 100])).cells.select("d0", F.col("value").alias("v"))


@query
def arr_append_axis0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.appended(events(spark, sf_dir), orders(spark, sf_dir)).cells.select("d0", F.col("value").alias("v"))


@query
def arr_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = writing.rechunked(vectors(spark, sf_dir), [50, 32])
    return a.with_chunks().groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n"))


# -- codecs ---------------------------------------------------------------------------------------


@query
def codec_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellcodecs.transposed(vectors(spark, sf_dir), [1, 0]).cells


@query
def codec_scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"))
    df = df.withColumn("enc", cellcodecs.scale_offset_encode(F.col("d0"), 3, 10))
    return df.withColumn("dec", cellcodecs.scale_offset_decode(F.col("enc"), 3, 10, integer=True))


@query
def codec_cast_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("d0"), cellcodecs.cast_value(F.col("value"), "uint8", "smallint", out_of_range="clamp").alias("v"))


@query
def codec_cast_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_orderkey").alias("d0"), cellcodecs.cast_value(F.col("o_orderkey"), "uint8", "smallint", out_of_range="wrap", floating=False).alias("v"))


@query
def codec_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), "o_custkey")
    return cellcodecs.delta_across(df, "o_custkey", "d0", 1000).select("d0", F.col("delta").cast("long").alias("delta"))


@query
def codec_fixedscaleoffset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("d0"), cellcodecs.fixed_scale_offset(F.col("value"), 100, 10, "long").alias("enc"))


@query
def codec_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), cellcodecs.quantized(F.col("value"), 2).alias("v"))


@query
def codec_packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("bit"))
    return cellcodecs.packed_bits(df, "bit", "event_id")


@query
def codec_delta_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences along an axis of which most chunks hold no cell."""
    df = table(spark, sf_dir, "orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("d0"), "o_custkey")
    return cellcodecs.delta_across(df, "o_custkey", "d0", 10).select("d0", F.col("delta").cast("long").alias("delta"))


@query
def codec_fixedscaleoffset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_orderkey").alias("d0"), cellcodecs.fixed_scale_offset_decoded(F.col("o_orderkey"), 4.0, 10.0).alias("v"))


# -- hierarchies --------------------------------------------------------------------------------------


def nations(spark: SparkSession, sf_dir: str) -> hierarchy.Catalog:
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return hierarchy.Catalog.of(df.select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit("array").alias("node_type"), F.lit("{}").alias("meta")), check=False)


@query
def hier_implicit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).nodes.select("path", F.col("node_type").alias("kind"))


@query
def hier_nmembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).n_members().filter("path <> ''")


@query
def hier_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).members("ASIA", max_depth=0).select("path", "parent", F.col("depth").cast("long").alias("depth"))


@query
def hier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).groups().select("path")


@query
def hier_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).deleted("ASIA").members("", None, "array").select("path")


@query
def hier_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is replaced by an array of its name, and all below it goes."""
    return nations(spark, sf_dir).put("ASIA", "array", {}, overwrite=True).nodes.select("path", F.col("node_type").alias("kind"))


@query
def hier_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).consolidated("EUROPE").select(F.explode("metadata").alias("path", "meta"))


@query
def hier_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the older format as newer ones: shape, chunks, codecs."""
    doc = '{"zarr_format": 2, "shape": [%d], "chunks": [%d], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": [{"id": "delta", "dtype": "<i4"}], "compressor": {"id": "zlib", "level": 1}}'
    old = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.format_string(doc, F.col("n_nationkey") + 1, F.col("n_regionkey") + 1).alias("meta"))
    at = lambda path: F.get_json_object("meta", path)
    return metadata.migrated_catalog(old).select(
        "path", at("$.shape[0]").cast("long").alias("extent"), at("$.chunk_grid.configuration.chunk_shape[0]").cast("long").alias("chunk"),
        F.concat_ws(",", at("$.codecs[0].name"), at("$.codecs[1].name"), at("$.codecs[2].name")).alias("codecs"),
    )


# -- stores ---------------------------------------------------------------------------------------------


@query
def store_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.TableStore(table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.encode("html", "UTF-8").alias("value"))).list_prefix("http://t").select("key")


@query
def store_getsize_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("key"), F.encode("text", "UTF-8").alias("value"))
    return store.TableStore(df).size_by_name().withColumnRenamed("name", "prefix")


@query
def store_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of many values at once, keys and ranges from a table."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("value"))
    wanted = df.select("key", F.lit(2).cast("int").alias("start"), F.lit(9).cast("int").alias("stop"))
    return store.TableStore(df).get_many(wanted).select("key", F.hex("value").alias("bytes"))


@query
def store_valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many keys name a chunk of the vectors' grid: some are beyond it, some are spelled otherwise."""
    a = vectors(spark, sf_dir)
    row, col = F.call_function("div", F.col("vec_id"), F.lit(10).cast("long")), F.col("vec_id") % 6
    key = F.concat(F.when(F.col("vec_id") % 7 == 0, "c/0").otherwise("c/"), row.cast("string"), F.lit("/"), col.cast("string"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", key.alias("key"))
    return df.withColumn("valid", requests.is_chunk_key(F.col("key"), a.spec.grid))


@query
def http_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server answers to Range headers of six kinds."""
    k, c = F.col("o_orderkey"), lambda x: x.cast("string")
    forms = [F.concat(F.lit("bytes="), c(k % 50), F.lit("-"), c(k % 70)), F.concat(F.lit("bytes="), c(k % 300), F.lit("-")), F.concat(F.lit("bytes=-"), c(k % 5)), F.lit("items=1-2"), F.lit("bytes=1-2,4-5"), F.lit("bytes=x-3")]
    header = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    df = table(spark, sf_dir, "orders").select(k.alias("d0"), requests.range_request(header, F.col("o_custkey") % 200).alias("r"))
    return df.select("d0", F.col("r.status").cast("long").alias("status"), "r.start", "r.stop")


@query
def store_list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("key"), F.lit(None).cast("binary").alias("value"))
    return store.TableStore(df).list_dir()


@query
def store_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", store.byte_range(u, start=2, stop=7).alias("rng"), store.byte_range(u, start=8).alias("off"), store.byte_range(u, suffix=4).alias("suf"))


@query
def store_coalesce_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + 3).alias("e")).distinct()
    return store.coalesced(ranges, gap=2)


# -- lazy views ---------------------------------------------------------------------------------------------


@query
def lazy_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    view = lazy.LazyArray(a)[10:50:2][3:12]
    return view.result().cells


@query
def lazy_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    return lazy.LazyArray(a)[::-1].result().cells


@query
def lazy_literal_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    t = lazy.IndexTransform.identity(a.shape)[5:11:2]
    return t.applied(a, ["coord"])


@query
def lazy_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lazy.bounding_box(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("d0")), ["d0"])


@query
def lazy_oindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lazy.LazyArray(vectors(spark, sf_dir))[10:90].oindex(([4, 0, 4], slice(0, 64, 16))).result().cells


@query
def lazy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a strided view of a list of rows reads."""
    a = vectors(spark, sf_dir)
    t = lazy.IndexTransform.identity(a.shape)[0:100, 0:64:2].oindex(([5, 0, 99, 5], slice(0, 16)))
    return t.chunks(spark, a.spec.grid)


@query
def lazy_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    return lazy.IndexTransform.identity(a.shape)[::-1].within([(100, 900)]).applied(a, ["o0"])


@query
def lazy_vindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lazy.LazyArray(vectors(spark, sf_dir)).vindex([5, 99, 5], [0, 63, 0]).result().cells
