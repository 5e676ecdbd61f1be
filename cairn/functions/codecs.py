"""Byte codecs: varints, zigzag, posting deltas, compression, checksums, encryption helpers."""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from cairn.functions.lists import sizes_of


def varint_size(value: Column) -> Column:
    """Bytes of a LEB128 varint of a non-negative long (10 for a negative one, as for its unsigned reading)."""
    size = F.lit(10)
    for n in range(9, 0, -1):
        size = F.when(value < (1 << (7 * n)) if 7 * n < 63 else value >= 0, n).otherwise(size)
    return F.when(value < 0, 10).otherwise(size)


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(1)))


def _varint_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of unsigned 64-bit numbers, one after another, and how many each number has."""
    rest = np.asarray(values).astype(np.uint64)
    sizes = np.ones(rest.shape, np.int64)
    for i in range(1, 10):
        sizes += (rest >> np.uint64(7 * i)) > 0
    widest = int(sizes.max(initial=1))
    groups = np.stack([(rest >> np.uint64(7 * i)).astype(np.uint8) & 127 for i in range(widest)], axis=-1)
    at = np.arange(widest)
    groups |= np.where(at < sizes[..., None] - 1, 128, 0).astype(np.uint8)
    return groups[at < sizes[..., None]], sizes


def _varint_values(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of varints one after another, and where each one ends. The last one must be whole."""
    ends = np.flatnonzero(x < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts + 1
    if sizes.max(initial=0) > 10:
        raise ValueError("varint of more than ten bytes")
    out = np.zeros(len(ends), np.uint64)
    for i in range(int(sizes.max(initial=0))):
        live = sizes > i
        out[live] |= (x[starts[live] + i] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
    return out, ends


def encode_varints(values: np.ndarray) -> bytes:
    """LEB128 of unsigned 64-bit numbers, one after another."""
    return _varint_bytes(values)[0].tobytes()


def decode_varints(raw: bytes) -> np.ndarray:
    """The numbers of a run of varints; a truncated or over-long last one raises ValueError."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) and x[-1] & 128:
        raise ValueError("truncated varint")
    return _varint_values(x)[0]


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


@F.arrow_udf(BinaryType())
def varint_udf(values: pa.Array) -> pa.Array:
    """An array of longs as varints, of their unsigned reading; all lists of a batch at once. Nulls stay, null numbers raise ValueError."""
    flat = values.flatten()
    if flat.null_count:
        raise ValueError("null number")
    raw, sizes = _varint_bytes(flat.to_numpy(zero_copy_only=False).view(np.uint64))
    cuts = _ends(sizes)[_ends(sizes_of(values))].astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
    return pc.if_else(values.is_valid(), made, pa.scalar(None, pa.binary())) if values.null_count else made


@F.arrow_udf(ArrayType(LongType()))
def unvarint_udf(raw: pa.Array) -> pa.Array:
    """The longs of varints, all values of a batch at once; nulls stay, truncated or over-long varints raise ValueError."""
    raw = raw.cast(pa.large_binary())
    cuts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    x = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    if (x[cuts[1:][np.diff(cuts) > 0] - 1] & 128).any():
        raise ValueError("truncated varint")
    values, ends = _varint_values(x)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, cuts), pa.int32()), pa.array(values.view(np.int64)), mask=raw.is_null() if raw.null_count else None)


ALGORITHMS = ("none", "lz4", "zlib", "zstd")


def _pack(data: bytes, algorithm: str) -> bytes:
    if algorithm == "none":
        return data
    if algorithm == "zlib":
        return zlib.compress(data, 6)
    return pa.compress(data, codec="lz4_raw" if algorithm == "lz4" else "zstd", asbytes=True)


def _unpack(data: bytes, size: int, algorithm: str) -> bytes:
    if algorithm == "none":
        return data
    if algorithm == "zlib":
        return zlib.decompress(data)
    return pa.decompress(data, decompressed_size=size, codec="lz4_raw" if algorithm == "lz4" else "zstd", asbytes=True)


def _cells(data: pa.Array) -> Iterator[pa.Buffer | None]:
    """The bytes of each value where they lie in the batch."""
    return (x.as_buffer() for x in data)


def compress(algorithm: str):
    """A function of a binary column; blocks are compressed whole, nulls stay."""
    if algorithm not in ALGORITHMS:
        raise ValueError(algorithm)

    @F.arrow_udf(BinaryType())
    def run(data: pa.Array) -> pa.Array:
        return data if algorithm == "none" else pa.array((None if b is None else _pack(b, algorithm) for b in _cells(data)), pa.binary())

    return run


def decompress(algorithm: str, strict: bool = True):
    """A function of (binary, original size). What can't be unpacked is the codec's error, or null if not strict."""
    if algorithm not in ALGORITHMS:
        raise ValueError(algorithm)

    def one(b: pa.Buffer | None, n: int | None) -> bytes | None:
        try:
            return None if b is None else _unpack(b, int(n), algorithm)
        except Exception:  # any codec's own error
            if strict:
                raise
            return None

    @F.arrow_udf(BinaryType())
    def run(data: pa.Array, size: pa.Array) -> pa.Array:
        return data if algorithm == "none" else pa.array((one(b, n.as_py()) for b, n in zip(_cells(data), size, strict=True)), pa.binary())

    return run


@F.pandas_udf(BinaryType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of bytes, big-endian: byte by byte over a whole batch, longest values last to leave. Nulls stay."""
    known = data.dropna()
    sizes = known.map(len).to_numpy(np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(known), np.uint8).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    h = np.full(len(known), 0xCBF29CE484222325, np.uint64)
    live = len(known)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        h[:live] = (h[:live] ^ flat[starts[:live] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(known), np.uint64)
    out[order] = h
    raw = out.astype(">u8").tobytes()
    made = pd.Series([raw[8 * i : 8 * i + 8] for i in range(len(known))], index=known.index, dtype=object).reindex(data.index)
    return made.where(made.notna(), None)


def varint(value: Column) -> Column:
    """The LEB128 bytes of a long's unsigned reading, as an expression."""
    parts = []
    for i in range(10):
        rest = F.shiftrightunsigned(value, 7 * i) if i else value
        more = F.shiftrightunsigned(value, 7 * (i + 1)) != 0 if i < 9 else F.lit(False)
        byte = rest.bitwiseAND(127) + F.when(more, 128).otherwise(0)
        one = F.unhex(F.lpad(F.hex(byte), 2, "0"))
        parts.append(one if i == 0 else F.when(rest != 0, one).otherwise(F.lit(b"")))
    return F.concat(*parts)


def unvarint(data: Column, at: Column | int = 0) -> Column:
    """(value, size) of the varint at a 0-based offset; null where it is cut short or has more than ten bytes."""
    start = F.lit(at) if isinstance(at, int) else at
    parts = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.conv(F.hex(F.substring(data, start + i, F.lit(1))), 16, 10).cast("long"))
    size = F.array_position(F.transform(parts, lambda b: b < 128), True).cast("int")
    bits = F.transform(F.slice(parts, F.lit(1), F.greatest(size, F.lit(0))), lambda b, i: F.call_function("shiftleft", b.bitwiseAND(127), i * 7))
    value = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(size > 0, F.struct(value.alias("value"), size.alias("size")))


def derive_key(password: str, salt: bytes, iterations: int = 100_000) -> bytes:
    """PBKDF2-HMAC-SHA256, 32 bytes; once for each query, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def new_key() -> bytes:
    return secrets.token_bytes(32)


def encrypt(data: Column, key: bytes, iv: Column | None = None) -> Column:
    """AES-256-GCM: 12 bytes of IV, ciphertext, 16 bytes of tag. Without an IV each row draws its own."""
    k = F.lit(key)
    return F.aes_encrypt(data, k, F.lit("GCM")) if iv is None else F.aes_encrypt(data, k, F.lit("GCM"), F.lit("DEFAULT"), iv)


def decrypt(data: Column, key: bytes) -> Column:
    """Null where key or tag are wrong."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"))
