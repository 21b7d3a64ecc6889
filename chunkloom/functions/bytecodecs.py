"""Codecs of whole chunks as bytes, run over Arrow batches; and shards, bytes of many chunks with an index."""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MetadataError, UnknownCodecError

Coder = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]

#: Fixed value: what names of codecs taken over from the older format begin with.
OLD_CODEC_PREFIX = "numcodecs."
#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _after_zeros(crc: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        crc = _CRC[crc & 0xFF] ^ (crc >> 8)
    return crc


def crc32c(data: bytes) -> int:
    """The data as lanes of about the square root of its length, a byte of each at a time; lanes are then folded in pairs, as a
    checksum register moves over zeros by a linear map of its bits."""
    x = np.frombuffer(data, np.uint8)
    size = 1 << (len(x).bit_length() // 2)
    lanes = len(x) // size
    state = 0xFFFFFFFF
    for b in x[: len(x) - lanes * size].tolist():
        state = int(_CRC[(state ^ b) & 0xFF]) ^ (state >> 8)
    if not lanes:
        return state ^ 0xFFFFFFFF
    block, crc = x[len(x) - lanes * size :].reshape(lanes, size).T.copy(), np.zeros(lanes, np.uint32)
    crc[0] = state
    for row in block:
        crc = _CRC[(crc ^ row) & 0xFF] ^ (crc >> 8)
    bits = np.arange(32, dtype=np.uint32)
    move = lambda by, v: np.bitwise_xor.reduce(np.where(v[:, None] >> bits & 1, by, 0), axis=1).astype(np.uint32)
    by = _after_zeros(np.uint32(1) << bits, size)
    while len(crc) > 1:
        if len(crc) % 2:
            crc = np.append(np.uint32(0), crc)
        crc, by = move(by, crc[0::2]) ^ crc[1::2], move(by, by)
    return int(crc[0]) ^ 0xFFFFFFFF


def fletcher32(data: bytes) -> int:
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    a = int(words.sum() % 65535)
    b = int((words * np.arange(len(words), 0, -1, dtype=np.uint64)).sum() % 65535)
    return b << 16 | a


#: Rotations of the hash's mixing and final steps.
MIXING, FINAL, HASH_BASE = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24), 0xDEADBEEF


def lookup3(data: bytes, seed: int = 0) -> int:
    """Bob Jenkins' hash of bytes as little-endian words, twelve bytes at a time."""
    full = 0xFFFFFFFF
    turned = lambda x, k: (x << k | x >> (32 - k)) & full
    x = y = z = (HASH_BASE + len(data) + seed) & full
    n = -(-len(data) // 12)
    words = struct.unpack(f"<{3 * n}I", data.ljust(12 * n, b"\0"))
    for i in range(0, len(words), 3):
        x, y, z = (x + words[i]) & full, (y + words[i + 1]) & full, (z + words[i + 2]) & full
        for k in MIXING if i + 3 < len(words) else ():
            x, y, z = y, (z + y) & full, ((x - z) & full) ^ turned(z, k)
    if not data:
        return z
    for k in FINAL:
        y, z, x = ((z ^ y) - turned(y, k)) & full, x, y
    return y


def encoded_size(n: int, codec: dict[str, Any]) -> int:
    """Bytes that a codec makes of n bytes; codecs whose result hangs on the data have no size."""
    name = plain_name(codec)
    if name in ("bytes", "transpose", "shuffle", "scale_offset"):
        return n
    if name in ("crc32c", "crc32", "adler32", "fletcher32", "jenkins_lookup3"):
        return n + 4
    raise MetadataError(f"what {codec['name']} makes has no fixed size")


def reads_parts(codecs: Sequence[dict[str, Any]]) -> bool:
    """Whether parts of a chunk can be read alone: it is a shard, and no other codec is around it."""
    arrays, serializer, chain = split_chain(codecs)
    return serializer["name"] == "sharding_indexed" and not arrays and not chain


def with_checksum(of: Callable[[bytes], int], location: str = "end") -> Coder:
    """Four bytes before or after the data, checked and dropped on the way back."""
    if location not in ("start", "end"):
        raise MetadataError(f"a checksum stands at start or end, not {location!r}")

    def add(data: bytes) -> bytes:
        mark = struct.pack("<I", of(data) & 0xFFFFFFFF)
        return mark + data if location == "start" else data + mark

    def check(data: bytes) -> bytes:
        body, stored = (data[4:], data[:4]) if location == "start" else (data[:-4], data[-4:])
        if of(body) & 0xFFFFFFFF != struct.unpack("<I", stored)[0]:
            raise ValueError("the checksum doesn't match")
        return body

    return add, check


def shuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(-1, size).T.tobytes() + data[n:]


def unshuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def _arrow(name: str) -> Coder:
    """Arrow's codec, with the plain length in front, which it needs to decode."""
    codec = pa.Codec(name)
    return lambda x: struct.pack("<I", len(x)) + codec.compress(x, asbytes=True), lambda x: codec.decompress(x[4:], struct.unpack("<I", x[:4])[0], asbytes=True)


CODECS: dict[str, Callable[..., Coder]] = {
    "gzip": lambda level=5: (lambda x: gzip.compress(x, level, mtime=0), gzip.decompress),
    "zlib": lambda level=5: (lambda x: zlib.compress(x, level), zlib.decompress),
    "bz2": lambda level=9: (lambda x: bz2.compress(x, level), bz2.decompress),
    "lzma": lambda format=1, check=-1, preset=None, filters=None: (lzma.compress, lzma.decompress),
    "zstd": lambda level=0, checksum=False: (zstandard.ZstdCompressor(level=level, write_checksum=checksum).compress, lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)),
    "lz4": lambda acceleration=1: _arrow("lz4_raw"),
    "snappy": lambda: _arrow("snappy"),
    "crc32c": lambda location="end": with_checksum(crc32c, location),
    "crc32": lambda location="start": with_checksum(zlib.crc32, location),
    "adler32": lambda location="start": with_checksum(zlib.adler32, location),
    "fletcher32": lambda: with_checksum(fletcher32),
    "jenkins_lookup3": lambda initval=0, prefix=None: with_checksum(lambda x: lookup3((prefix or b"") + x, initval)),
    "shuffle": lambda elementsize=4: (lambda x: shuffled(x, elementsize), lambda x: unshuffled(x, elementsize)),
}


def register_codec(name: str, make: Callable[..., Coder]) -> None:
    CODECS[name] = make


def plain_name(codec: dict[str, Any]) -> str:
    """A codec goes by the same name whether it is taken over from the older format or not."""
    return codec["name"].removeprefix(OLD_CODEC_PREFIX)


def coder(codec: dict[str, Any]) -> Coder:
    name, conf = plain_name(codec), codec.get("configuration", {})
    if name not in CODECS:
        raise UnknownCodecError(codec["name"])
    try:
        return CODECS[name](**conf)
    except TypeError as error:
        raise MetadataError(f"{codec['name']}: {error}") from None


#: What each part of a chain turns into what: 0 array to array, 1 array to bytes; all others are bytes to bytes.
KINDS = {"transpose": 0, "cast_value": 0, "scale_offset": 0, "delta": 0, "fixedscaleoffset": 0, "quantize": 0, "bitround": 0, "astype": 0, "bytes": 1, "vlen-utf8": 1, "vlen-bytes": 1, "sharding_indexed": 1}


def split_chain(codecs: Sequence[dict[str, Any]]) -> tuple[list[dict], dict, list[dict]]:
    """(array to array, array to bytes, bytes to bytes) of a chain; any other order is an error."""
    ranks = [KINDS.get(plain_name(c), 2) for c in codecs]
    if ranks != sorted(ranks) or ranks.count(1) != 1:
        raise MetadataError("a chain has array codecs, then one serializer, then byte codecs")
    return [c for c, r in zip(codecs, ranks, strict=True) if r == 0], codecs[ranks.index(1)], [c for c, r in zip(codecs, ranks, strict=True) if r == 2]


# -- blocks to blocks --------------------------------------------------------------------


def encode_array(block: np.ndarray, codec: dict[str, Any]) -> np.ndarray:
    """What an array codec makes of a chunk's block."""
    name, conf = plain_name(codec), codec.get("configuration", {})
    if name == "transpose":
        return block.transpose(conf["order"])
    kind = encoded_type(block.dtype, codec)
    if name == "scale_offset":
        return ((block - block.dtype.type(conf.get("offset", 0))) * block.dtype.type(conf.get("scale", 1))).astype(kind)
    if name == "delta":
        return np.diff(block.reshape(-1), prepend=block.dtype.type(0)).astype(kind).reshape(block.shape)
    if name == "fixedscaleoffset":
        return np.around((block - conf["offset"]) * conf["scale"]).astype(kind)
    if name == "quantize":
        scale = 2.0 ** math.ceil(math.log2(10.0 ** conf["digits"]))
        return (np.around(block * scale) / scale).astype(kind)
    if name == "bitround":
        return bit_rounded(block, conf["keepbits"])
    if name == "astype":
        return block.astype(kind)
    raise NotImplementedError(f"{codec['name']} is a column expression here")


def decode_array(block: np.ndarray, codec: dict[str, Any], dtype: np.dtype) -> np.ndarray:
    """The block before an array codec, of the element type that it had."""
    name, conf = plain_name(codec), codec.get("configuration", {})
    if name == "transpose":
        return block.transpose(np.argsort(conf["order"]))
    if name == "scale_offset":
        back = block / conf.get("scale", 1) if dtype.kind == "f" else block // np.asarray(conf.get("scale", 1), block.dtype)
        return (back + conf.get("offset", 0)).astype(dtype)
    if name == "delta":
        return np.cumsum(block.reshape(-1), dtype=dtype).reshape(block.shape)
    if name == "fixedscaleoffset":
        return (block / conf["scale"] + conf["offset"]).astype(dtype)
    return block.astype(dtype)


def encoded_type(dtype: np.dtype, codec: dict[str, Any]) -> np.dtype:
    """The element type that an array codec stores."""
    name, conf = plain_name(codec), codec.get("configuration", {})
    if name == "astype":
        return np.dtype(conf["encode_dtype"])
    return np.dtype(conf["astype"]) if name in ("delta", "fixedscaleoffset", "quantize") and conf.get("astype") else dtype


def encode_bytes(data: bytes, codecs: Sequence[dict[str, Any]]) -> bytes:
    for c in codecs:
        data = coder(c)[0](data)
    return data


def decode_bytes(data: bytes, codecs: Sequence[dict[str, Any]]) -> bytes:
    for c in reversed(codecs):
        data = coder(c)[1](data)
    return data


def pack_strings(items: Sequence[str | bytes]) -> bytes:
    """A count, then each item with its length in front."""
    raw = [x.encode() if isinstance(x, str) else x for x in items]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(x)) + x for x in raw)


def unpack_strings(data: bytes, text: bool = True) -> list[str | bytes]:
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        item = data[at + 4 : at + 4 + size]
        out.append(item.decode() if text else item)
        at += 4 + size
    return out


def pack_bits(values: np.ndarray) -> bytes:
    """A byte with the number of padding bits, then eight booleans to a byte."""
    return bytes([-len(values) % 8]) + np.packbits(values).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data[1:], np.uint8))
    return bits[: len(bits) - data[0]].astype(bool)


def bit_rounded(values: np.ndarray, keep: int) -> np.ndarray:
    """Floats with the last mantissa bits rounded off, half to even."""
    width, mantissa, kind = (32, 23, np.uint32) if values.dtype == np.float32 else (64, 52, np.uint64)
    drop = mantissa - keep
    if drop <= 0:
        return values
    bits = values.view(kind)
    half = kind((1 << (drop - 1)) - 1)
    return ((bits + ((bits >> kind(drop)) & kind(1)) + half) & ~kind((1 << drop) - 1) & kind((1 << width) - 1)).view(values.dtype)


# -- shards ---------------------------------------------------------------------------

#: Fixed value: offset and length of a chunk that a shard doesn't hold.
ABSENT = 2**64 - 1


def build_shard(chunks: dict[int, bytes], n: int, index_at: str = "end") -> bytes:
    """Chunks by number, then an index of offsets and lengths with its checksum (or first the index)."""
    index = np.full((n, 2), ABSENT, np.uint64)
    size = n * 16 + 4
    at, parts = (size if index_at == "start" else 0), []
    for i in sorted(chunks):
        index[i] = at, len(chunks[i])
        parts.append(chunks[i])
        at += len(chunks[i])
    raw = index.astype("<u8").tobytes()
    raw += struct.pack("<I", crc32c(raw))
    return raw + b"".join(parts) if index_at == "start" else b"".join(parts) + raw


def shard_index(shard: bytes, n: int, index_at: str = "end") -> np.ndarray:
    size = n * 16 + 4
    raw = shard[:size] if index_at == "start" else shard[-size:]
    if crc32c(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("the shard index's checksum doesn't match")
    return np.frombuffer(raw[:-4], "<u8").reshape(n, 2)


def read_shard(shard: bytes, n: int, wanted: Sequence[int] | None = None, index_at: str = "end") -> dict[int, bytes]:
    index = shard_index(shard, n, index_at)
    return {i: shard[int(index[i, 0]) : int(index[i, 0] + index[i, 1])] for i in (range(n) if wanted is None else wanted) if index[i, 0] != ABSENT}


# -- on DataFrames -----------------------------------------------------------------------


def encode_chunks(cells: DataFrame, chunk: Sequence[str], dims: Sequence[str], sizes: Sequence[int], value: str, dtype: str, codecs: Sequence[dict[str, Any]], fill: Any = 0) -> DataFrame:
    """(chunk columns, payload, nbytes): each chunk's cells in C order as bytes, coded. A task holds one chunk at a time."""
    arrays, serializer, chain = split_chain(codecs)
    if arrays or serializer["name"] != "bytes":
        raise MetadataError("here a chain is bytes and byte codecs; array codecs are column expressions")
    endian = ">" if serializer.get("configuration", {}).get("endian") == "big" else "<"
    kind = np.dtype(dtype).newbyteorder(endian)
    schema = ", ".join([*(f"{c} long" for c in chunk), "payload binary", "nbytes long"])

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        block = np.full(sizes, fill, kind)
        block[tuple((frame[d] - frame[c] * n).to_numpy() for d, c, n in zip(dims, chunk, sizes, strict=True))] = frame[value].to_numpy()
        payload = encode_bytes(block.tobytes(), chain)
        return pd.DataFrame([[*(frame[c].iloc[0] for c in chunk), payload, len(payload)]], columns=[*chunk, "payload", "nbytes"])

    return cells.groupBy(*chunk).applyInPandas(encode, schema)


def decode_chunks(chunks: DataFrame, chunk: Sequence[str], dims: Sequence[str], sizes: Sequence[int], shape: Sequence[int], value: str, dtype: str, spark_type: str, codecs: Sequence[dict[str, Any]]) -> DataFrame:
    """The cells of coded chunks, those outside of the shape left out."""
    _, serializer, chain = split_chain(codecs)
    endian = ">" if serializer.get("configuration", {}).get("endian") == "big" else "<"
    kind = np.dtype(dtype).newbyteorder(endian)
    schema = ", ".join([*(f"{d} long" for d in dims), f"{value} {spark_type}"])

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = np.frombuffer(decode_bytes(bytes(row.payload), chain), kind).astype(dtype)
                at = np.unravel_index(np.arange(math.prod(sizes)), sizes)
                coords = [a + getattr(row, c) * n for a, c, n in zip(at, chunk, sizes, strict=True)]
                keep = np.logical_and.reduce([c < n for c, n in zip(coords, shape, strict=True)])
                yield pd.DataFrame({**{d: c[keep] for d, c in zip(dims, coords, strict=True)}, value: block[keep]})

    return chunks.select(*chunk, "payload").mapInPandas(decode, schema)


def checksum_column(payload: str) -> Any:
    """CRC-32 of the zlib polynomial, which is built in; the Castagnoli one is another."""
    return F.crc32(payload)
