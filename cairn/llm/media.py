"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide, in a tar shard that the
writing task owns; members are named by the payload's digest and are written once per
shard. Table rows carry digest, shard, offset and length only. Metadata columns are
filled by range reads of the 33 bytes of a PNG's header; payloads are read, when asked
for, by a range read of their own length.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm.common import scratch, stored, tidy

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def padded(data: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image with one sample per byte; the payload's length is a multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes of a PNG."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image made by `to_png`, every checksum tested."""
    width, height, _ = header(data[:HEADER_BYTES])
    at, parts = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of a PNG is damaged")
        parts += [body] if kind == b"IDAT" else []
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """A short description of the samples; equal payloads give equal text."""
    x = np.frombuffer(payload, np.uint8)
    used = np.bincount(x, minlength=256)
    return f"height={len(x) // WIDTH};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};zeros={int(used[0])};distinct={int((used > 0).sum())};high={int(used[128:].sum())}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Write every text to tar shards in the shared folder; returns the index, itself a written table.

    Index columns: id_col, n_bytes, digest, shard, offset, length, media_sha256. A text that
    occurs more than once in a task is stored once; tasks don't wait for each other, so a
    digest may be found in several shards, any of which serves. A repeated task writes
    a shard of another name, and only the one that succeeds is in the index.

    Null text counts as empty (one row of 64 zero samples). Null ids stay null; an empty
    table writes nothing; other columns are ignored.
    """
    root = scratch(df.sparkSession, "media")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, digest string, shard string, offset long, length long, media_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        known: dict[str, tuple] = {}
        out = name = None
        at = 0

        def close() -> None:
            if out is not None:
                out.write(bytes(1024))
                out.close()

        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if out is None or at > shard_bytes:
                        close()
                        known.clear()
                        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
                        out, at = fs.open_output_stream(f"{folder}/{name}"), 0
                    image = to_png(payload)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(image)
                    out.write(member.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512))
                    known[digest] = (f"{root}/{name}", at + 512, len(image), hashlib.sha256(image).hexdigest())
                    at += 512 + len(image) + -len(image) % 512
                rows.append((len(data), digest, *known[digest]))
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, "n_bytes", "digest", "shard", "offset", "length", "media_sha256"])
        close()

    return stored(df.select(id_col, text_col).mapInArrow(tidy(run), schema), "media-index")


class _Shards:
    """Range reads; the shard read last stays open."""

    def __init__(self) -> None:
        self.uri = self.file = None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise OSError(f"{uri} ends before {offset + length}")
        return data


def _map_members(index: DataFrame, added: str, make) -> DataFrame:
    """Add columns made from each row's (shards, shard, offset, length); equal places in a row of rows are made once."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in added.split(", ")), strict=True)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards()
        known: dict[tuple, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = []
                for uri, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if uri != shards.uri or len(known) > 2000:
                        known.clear()
                    if (uri, offset) not in known:
                        known[uri, offset] = make(shards, uri, offset, length)
                    rows.append(known[uri, offset])
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, types[k]) for c, k in zip(cols, kinds, strict=True))], [*part.schema.names, *names])

    return index.mapInArrow(tidy(run), f"{fields}, {added}")


def with_headers(index: DataFrame) -> DataFrame:
    """Add width, height and depth to index rows by header-only range reads."""
    return _map_members(index, "width int, height int, depth int", lambda s, uri, offset, _: header(s.read(uri, offset, HEADER_BYTES)))


def with_samples(index: DataFrame) -> DataFrame:
    """Add, from each stored payload read back whole, payload_bytes, payload_sha256, tail_crc32 and feature."""

    def make(shards: _Shards, uri: str, offset: int, length: int) -> tuple:
        payload = from_png(shards.read(uri, offset, length))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), features(payload)

    return _map_members(index, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", make)


def payloads(index: DataFrame) -> DataFrame:
    """Add `payload`, the stored bytes themselves, to index rows."""
    return _map_members(index, "payload binary", lambda s, uri, offset, length: (from_png(s.read(uri, offset, length)),))
