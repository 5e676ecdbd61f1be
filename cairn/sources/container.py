"""The archive container: reading and writing of single files, as a DataFrame source and sink.

Layout: a 158-byte little-endian header; entry payloads; metadata, directory, index and
chunk sections; journal. Section integers are LEB128 varints. The index has id, offset,
stored size and SHA-256 of each entry's original bytes; the directory tree has names and
ids. Since neither holds a codec, the writer notes it in the metadata under `codec`.
In sealed archives (header flag 1) each payload is compressed and then encrypted with
AES-256-GCM; digests are still those of the original bytes. Keys are used in the JVM only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import ALGORITHMS, _pack, decrypt, encrypt
from cairn.session import ship

#: Fixed values of the format: first bytes, version, header fields (magic, version, flags, 14 sizes and offsets, CRC, digest).
MAGIC, VERSION, SEALED = b"NBF\x01", (1, 0), 1
HEADER = struct.Struct("<4s3H14QI32s")
FIELDS = ("archive_size", "metadata_offset", "directory_offset", "index_offset", "chunk_offset", "blocks_offset", "journal_offset", "entry_count", "metadata_size", "directory_size", "index_size", "chunk_size", "blocks_size", "journal_size")
MAX_KEY, MAX_VALUE, MAX_CHUNKS, MAX_DEPTH = 4096, 1 << 20, 1 << 20, 255
ENTRY_SCHEMA = "archive string, entry_id long, path string, offset long, stored_size long, sha256 string, content binary, intact boolean, error string, warnings string"


class FormatError(ValueError):
    """Bytes that are not what the layout says."""


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class Cursor:
    """Bounds-checked reading of a section."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def number(self) -> int:
        n = 0
        for i in range(10):
            b = self.take(1)[0]
            n |= (b & 127) << 7 * i
            if b < 128:
                return n & (1 << 64) - 1
        raise FormatError("varint of more than ten bytes")

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise FormatError("section ends too early")
        self.at += n
        return self.data[self.at - n : self.at]


def write_header(fields: dict[str, int], flags: int = 0) -> bytes:
    """The header with its CRC-32, which is that of the header with the field zero."""
    values = [fields.get(f, 0) for f in FIELDS]
    raw = HEADER.pack(MAGIC, *VERSION, flags, *values, 0, bytes(32))
    return HEADER.pack(MAGIC, *VERSION, flags, *values, zlib.crc32(raw), bytes(32))


def read_header(data: bytes) -> dict[str, int]:
    """Fields by name, and flags. A stored CRC of 0 is not checked."""
    if len(data) < HEADER.size:
        raise FormatError("shorter than a header")
    magic, major, minor, flags, *rest = HEADER.unpack(data[: HEADER.size])
    if magic != MAGIC or major != VERSION[0] or minor > VERSION[1]:
        raise FormatError("wrong magic or version")
    *values, crc, digest = rest
    if crc and crc != zlib.crc32(HEADER.pack(magic, major, minor, flags, *values, 0, digest)):
        raise FormatError("header checksum differs")
    return dict(zip(FIELDS, values, strict=True)) | {"flags": flags}


def write_metadata(store: dict[str, bytes]) -> bytes:
    return b"".join(varint(len(k.encode())) + varint(len(v)) + k.encode() + v for k, v in store.items())


def read_metadata(data: bytes) -> dict[str, bytes]:
    """An error in the first pair raises; one in a later pair ends the store there."""
    c, out = Cursor(data), {}
    while c.left():
        try:
            k, v = c.number(), c.number()
            if k > MAX_KEY or v > MAX_VALUE:
                raise FormatError("metadata key or value too long")
            key = c.take(k).decode("utf-8", "replace")
            out[key] = c.take(v)
        except FormatError:
            if not out:
                raise
            break
    return out


def write_index(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    return varint(len(rows)) + b"".join(varint(i) + varint(o) + varint(s) + h for i, o, s, h in rows)


def read_index(data: bytes) -> list[tuple[int, int, int, bytes]]:
    c = Cursor(data)
    n = c.number()
    if n * 35 > len(data):
        raise FormatError("more index entries than bytes")
    return [(c.number(), c.number(), c.number(), c.take(32)) for _ in range(n)]


def write_chunks(rows: list[tuple[bytes, int, int, int, int, bool]]) -> bytes:
    """Chunk table of (hash, offset, stored size, original size, algorithm number, encrypted)."""
    return varint(len(rows)) + b"".join(h + varint(o) + varint(s) + varint(n) + bytes([a, bool(e)]) for h, o, s, n, a, e in rows)


def read_chunks(data: bytes) -> list[tuple[bytes, int, int, int, int, bool]]:
    c = Cursor(data)
    n = c.number()
    if n > MAX_CHUNKS or n * 37 > c.left():
        raise FormatError("more chunks than bytes")
    return [(c.take(32), c.number(), c.number(), c.number(), c.take(1)[0], c.take(1) != b"\0") for _ in range(n)]


def write_directory(paths: dict[str, int]) -> bytes:
    """A tree of nodes (name, id, parent id, file ids, children). Implicit directories get ids after all entries'."""
    tree: dict = {"name": "", "id": 0, "children": {}}
    new = max(paths.values(), default=0)
    count = 1
    for path, entry in sorted(paths.items()):
        node, parts = tree, [p for p in path.split("/") if p not in ("", ".", "..")]
        for k, part in enumerate(parts):
            if part not in node["children"]:
                new += 1
                count += 1
                node["children"][part] = {"name": part, "id": new, "children": {}}
            node = node["children"][part]
            if k == len(parts) - 1:
                node["id"] = entry

    def node_bytes(node: dict, parent: int) -> bytes:
        name, children = node["name"].encode(), node["children"].values()
        files = [c["id"] for c in children if not c["children"]]
        head = varint(len(name)) + name + varint(node["id"]) + varint(parent) + varint(len(files)) + b"".join(map(varint, files))
        return head + varint(len(children)) + b"".join(node_bytes(c, node["id"]) for c in children)

    return varint(count) + node_bytes(tree, 0)


def read_directory(data: bytes) -> dict[int, str]:
    """Entry id -> path; nesting beyond 255 levels is refused."""
    c, out = Cursor(data), {}
    c.number()

    def node(prefix: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise FormatError("directories nested too deeply")
        name = c.take(c.number()).decode("utf-8", "replace")
        entry, _ = c.number(), c.number()
        for _ in range(c.number()):
            c.number()
        path = f"{prefix}/{name}" if name else prefix
        if name:
            out[entry] = path
        for _ in range(c.number()):
            node(path, depth + 1)

    if c.left():
        node("", 0)
    return out


def packed(content: bytes, codec: str) -> bytes:
    """Content as it is stored; lz4 blocks don't know their size, so it goes before them."""
    if not content:
        return b""
    return (varint(len(content)) if codec == "lz4" else b"") + _pack(content, codec)


def build(rows: list[tuple[int, str, bytes]], codec: str = "zstd", metadata: dict[str, bytes] | None = None) -> bytes:
    """An archive of (id, path, content) rows."""
    if codec not in ALGORITHMS:
        raise ValueError(codec)
    return assemble([(i, p, packed(c, codec), hashlib.sha256(c).digest()) for i, p, c in rows], codec, metadata)


def assemble(rows: list[tuple[int, str, bytes, bytes]], codec: str, metadata: dict[str, bytes] | None = None, flags: int = 0) -> bytes:
    """An archive of (id, path, stored bytes, digest of the original bytes) rows."""
    parts, at, index = [bytes(HEADER.size)], HEADER.size, []
    for entry, _, stored, digest in rows:
        index.append((entry, at, len(stored), digest))
        parts.append(stored)
        at += len(stored)
    fields = {"entry_count": len(rows)}
    sections = (("metadata", write_metadata((metadata or {}) | {"codec": codec.encode()})), ("directory", write_directory({r[1]: r[0] for r in rows})), ("index", write_index(index)), ("chunk", write_chunks([])), ("blocks", b""), ("journal", varint(0) + varint(0)))
    for name, data in sections:
        fields |= {f"{name}_offset": at, f"{name}_size": len(data)}
        parts.append(data)
        at += len(data)
    fields["archive_size"] = at
    parts[0] = write_header(fields, flags)
    return b"".join(parts)


def unpack(stored: bytes, codec: str) -> bytes:
    if not stored or codec == "none":
        return stored
    if codec == "zlib":
        return zlib.decompress(stored)
    if codec == "lz4":
        c = Cursor(stored)
        size = c.number()
        return pa.decompress(stored[c.at :], decompressed_size=size, codec="lz4_raw", asbytes=True)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(stored)


def sections(data: bytes) -> tuple[dict[str, int], dict[str, object], list[str]]:
    """(header, parsed sections by name, warnings). A section that can't be read is empty and has a warning; only a wrong header raises."""
    head, out, warnings = read_header(data), {}, []
    for name, read, empty in (("metadata", read_metadata, {}), ("directory", read_directory, {}), ("index", read_index, []), ("chunk", read_chunks, [])):
        start, size = head[f"{name}_offset"], head[f"{name}_size"]
        out[name] = empty
        try:
            if start + size > len(data):
                raise FormatError("beyond the end of the file")
            if size:
                out[name] = read(data[start : start + size])
        except FormatError as e:
            warnings.append(f"{name}: {e}")
    for name in ("blocks", "journal"):
        if head[f"{name}_offset"] + head[f"{name}_size"] > len(data):
            warnings.append(f"{name}: beyond the end of the file")
    return head, out, warnings


def valid(data: bytes, quick: bool = False) -> bool:
    """Whether the header (`quick`), or the header and all sections, can be read."""
    try:
        return not sections(data)[2] if not quick else bool(read_header(data))
    except FormatError:
        return False


def parse(data: bytes, content: bool = True) -> Iterator[tuple]:
    """(entry_id, path, offset, stored_size, sha256, content, intact, error, warnings) of each entry; damage is reported, not raised, once the header is right.

    Warnings of sections, joined, are on every row. Without an index the directory's entries are still listed, not intact;
    without either there is one row of nulls. Payloads of sealed archives stay as they are, with `intact` null and error `Sealed`.
    """
    head, found, warnings = sections(data)
    said = "; ".join(warnings) or None
    codec = found["metadata"].get("codec", b"zstd").decode("utf-8", "replace")
    names, index = found["directory"], found["index"]
    if not index and any(w.startswith("index") for w in warnings):
        for entry, path in sorted(names.items()) or [(None, None)]:
            yield entry, path, None, None, None, None, False, "MissingIndex", said
        return
    for entry, offset, size, digest in index:
        body, intact, error = None, None, None
        if offset + size > len(data):
            intact, error = False, "InvalidOffset"
        elif content and head["flags"] & SEALED:
            body, error = data[offset : offset + size], f"Sealed {codec}"
        elif content:
            body, intact, error = opened(data[offset : offset + size], codec, digest)
        yield entry, names.get(entry), offset, size, digest.hex(), body, intact, error, said


def opened(stored: bytes, codec: str, digest: bytes) -> tuple[bytes | None, bool, str | None]:
    """(content, intact, error) of stored bytes that aren't encrypted."""
    try:
        body = unpack(stored, codec)
    except Exception as e:  # any codec's own error
        return None, False, type(e).__name__
    intact = hashlib.sha256(body).digest() == digest
    return body, intact, None if intact else "ChecksumMismatch"


def read_archives(spark: SparkSession, path: str, content: bool = True, key: bytes | None = None) -> DataFrame:
    """Entries of all archives at a path or glob, one task's work being a file: (archive, entry_id, path, offset, stored_size, sha256, content, intact, error, warnings).

    Without `content` payloads are neither unpacked nor checked. A file that is not an archive gives one row with its error.
    Entries of sealed archives come out with the right `key`; with none their error is `KeyNotSet`, with a wrong one
    `DecryptionFailed`, and content is null.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = [(name.as_py(), *r) for r in parse(data.as_py(), content)]
                except FormatError as e:
                    rows = [(name.as_py(), *[None] * 6, False, str(e), None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    @F.pandas_udf("content binary, intact boolean, error string")
    def unsealed(plain: pd.Series, error: pd.Series, digest: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if e is None else (None, False, "DecryptionFailed") if b is None else opened(bytes(b), e[7:], bytes.fromhex(d)) for b, e, d in zip(plain, error, digest, strict=True)]
        return pd.DataFrame(rows, columns=["content", "intact", "error"])

    rows = files.mapInArrow(run, ENTRY_SCHEMA)
    if not content:
        return rows
    sealed = F.coalesce(F.col("error").startswith("Sealed "), F.lit(False))
    if key is None:
        return rows.withColumns({"content": F.when(~sealed, F.col("content")), "intact": F.when(sealed, False).otherwise(F.col("intact")), "error": F.when(sealed, "KeyNotSet").otherwise(F.col("error"))})
    plain = F.when(F.col("stored_size") == 0, F.col("content")).when(sealed, decrypt(F.col("content"), key))
    was = rows.withColumn("_was", unsealed(plain, F.when(sealed, F.col("error")), F.col("sha256")))
    return was.withColumns({c: F.when(sealed, F.col(f"_was.{c}")).otherwise(F.col(c)) for c in ("content", "intact", "error")}).drop("_was")


def write_archives(entries: DataFrame, folder: str, codec: str = "zstd", metadata: dict[str, bytes] | None = None, key: bytes | None = None) -> DataFrame:
    """Write (entry_id, path, content) rows as one archive per partition; returns (archive, entries, bytes), a row per file.

    Each file is written whole to a name of its own attempt and then renamed, so a repeated task replaces its file.
    With a `key` of 32 bytes contents are compressed and then sealed, each under an IV of its own. Null contents and
    paths are empty ones.
    """
    if codec not in ALGORITHMS:
        raise ValueError(codec)
    ship(entries.sparkSession)
    flags = 0 if key is None else SEALED

    @F.pandas_udf("binary")
    def squeeze(data: pd.Series) -> pd.Series:
        return data.map(lambda b: packed(bytes(b), codec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
        if not rows:
            return
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, data = f"part-{task.partitionId():05d}.arc", assemble(rows, codec, metadata, flags)
        with fs.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}") as out:
            out.write(data)
        fs.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "entries": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    raw = entries.select("entry_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    stored = raw.select("entry_id", "path", squeeze("content").alias("stored"), F.unhex(F.sha2("content", 256)).alias("digest"))
    if key is not None:
        stored = stored.withColumn("stored", F.when(F.octet_length("stored") > 0, encrypt(F.col("stored"), key)).otherwise(F.col("stored")))
    done = stored.mapInArrow(run, "archive string, entries long, bytes long")
    return entries.sparkSession.createDataFrame(done.collect(), done.schema)  # a row per file
