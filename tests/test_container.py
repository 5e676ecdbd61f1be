"""The archive container: round trips, damage, and the DataFrame source and sink."""

import random

import pytest

from cairn.sources import container as A

ROWS = [(1, "/a/b.txt", b"x" * 10), (2, "/a/c/d.bin", bytes(i & 255 for i in range(100_000))), (3, "/e", b""), (4, "/ü/é.txt", "é".encode() * 99)]


@pytest.mark.parametrize("codec", ["none", "lz4", "zlib", "zstd"])
def test_round_trip(codec):
    data = A.build(ROWS, codec, {"author": b"me"})
    got = list(A.parse(data))
    assert [(r[0], r[1], r[5], r[6], r[7]) for r in got] == [(i, p, c, True, None) for i, p, c in ROWS]
    head = A.read_header(data)
    assert head["entry_count"] == 4 and head["archive_size"] == len(data) and A.HEADER.size == 158
    assert A.read_metadata(data[head["metadata_offset"] :][: head["metadata_size"]]) == {"author": b"me", "codec": codec.encode()}


def test_damage_is_reported():
    data = bytearray(A.build(ROWS, "none"))
    data[160] ^= 1
    assert [r[6] for r in A.parse(bytes(data))] == [False, True, True, True]
    for bad in (b"", bytes(158), bytes(data[:4]) + b"\x09" + bytes(data[5:]), bytes(data[:20]) + b"\x7f" + bytes(data[21:])):
        with pytest.raises(A.FormatError):
            list(A.parse(bad))
    short = A.build(ROWS, "none")[:200]
    assert all(r[6] is False for r in A.parse(short))


def test_any_bytes_end_in_rows_or_a_format_error():
    rng = random.Random(8)
    good = A.build(ROWS, "zstd")
    for _ in range(400):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data[122:126] = bytes(4)  # no header checksum, so that the sections are reached
        try:
            list(A.parse(bytes(data[: rng.randrange(len(data))])))
        except A.FormatError:
            pass


def test_metadata_pairs_end_at_the_first_damage():
    raw = A.write_metadata({"a": b"1", "b": b"22"})
    assert A.read_metadata(raw[:-1]) == {"a": b"1"}
    with pytest.raises(A.FormatError):
        A.read_metadata(raw[:2])


def test_source_and_sink(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "entry_id long, path string, content binary").repartition(2, "entry_id")
    written = A.write_archives(df, f"file://{tmp_path}/out", "zlib").collect()
    assert sum(r.entries for r in written) == 4
    (tmp_path / "out" / "other.arc").write_bytes(b"not an archive")
    back = A.read_archives(spark, f"file://{tmp_path}/out/*.arc").collect()
    assert sorted((r.entry_id, r.path, bytes(r.content)) for r in back if r.intact) == sorted(ROWS)
    assert [r.error for r in back if not r.intact] == ["shorter than a header"]
    listed = A.read_archives(spark, f"file://{tmp_path}/out/part*", content=False)
    assert listed.where("content is null and intact is null").count() == 4


def test_sealed_archives(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "entry_id long, path string, content binary").repartition(2, "entry_id")
    key = bytes(range(32))
    for codec in ("lz4", "zstd"):
        folder = f"file://{tmp_path}/{codec}"
        A.write_archives(df, folder, codec, key=key)
        back = A.read_archives(spark, f"{folder}/*.arc", key=key).collect()
        assert sorted((r.entry_id, r.path, bytes(r.content), r.intact, r.error) for r in back) == sorted((*r, True, None) for r in ROWS)
        assert {(r.content, r.intact, r.error) for r in A.read_archives(spark, f"{folder}/*.arc").collect()} == {(None, False, "KeyNotSet")}
        wrong = A.read_archives(spark, f"{folder}/*.arc", key=bytes(32)).collect()
        assert {(r.intact, r.error) for r in wrong if r.stored_size} == {(False, "DecryptionFailed")}
        raw = (tmp_path / codec / "part-00000.arc").read_bytes() + (tmp_path / codec / "part-00001.arc").read_bytes()
        assert b"x" * 10 not in raw
    for p in (tmp_path / "lz4").glob("*.arc"):
        assert A.read_header(p.read_bytes())["flags"] == A.SEALED


def test_one_damaged_section_is_a_warning():
    good = A.build(ROWS, "zlib")
    head = A.read_header(good)

    def broken(section):
        data = bytearray(good)
        start = head[f"{section}_offset"]
        data[start : start + head[f"{section}_size"]] = b"\xff" * head[f"{section}_size"]
        return bytes(data)

    assert A.valid(good) and A.valid(broken("chunk"), quick=True) and not A.valid(broken("chunk")) and not A.valid(good[:90], quick=True)
    rows = list(A.parse(broken("directory")))
    assert [r[0] for r in rows] == [1, 2, 3, 4] and all(r[1] is None and r[6] and r[8].startswith("directory") for r in rows)
    rows = list(A.parse(broken("chunk")))
    assert [(r[1], r[5]) for r in rows] == [(p, c) for _, p, c in ROWS] and rows[0][8] == "chunk: section ends too early"
    rows = list(A.parse(broken("index")))
    assert {(1, "/a/b.txt", "MissingIndex"), (3, "/e", "MissingIndex")} <= {(r[0], r[1], r[7]) for r in rows} and not any(r[6] for r in rows)


def test_chunk_tables():
    rows = [(bytes([i]) * 32, i * 1000, 7, 300 * i, i % 4, i % 2 == 1) for i in range(9)]
    raw = A.write_chunks(rows)
    assert A.read_chunks(raw) == rows and A.read_chunks(A.write_chunks([])) == []
    for bad in (raw[:-1], A.varint(1 << 21) + raw, b""):
        with pytest.raises(A.FormatError):
            A.read_chunks(bad)


def test_command_line(spark, tmp_path, capfd):
    from cairn.__main__ import main

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "sub" / "b.txt").write_text("world")
    archive, out = str(tmp_path / "arc"), tmp_path / "out"
    assert main(["create", "-a", archive, str(tmp_path / "in")]) == 0
    for command in ("list", "inspect", "verify"):
        assert main([command, "-a", archive]) == 0
    assert main(["extract", "-a", archive, "-o", str(out)]) == 0
    assert (out / str(tmp_path / "in" / "sub" / "b.txt").lstrip("/")).read_text() == "world"
    file = next((tmp_path / "arc").glob("part*"))
    raw = bytearray(file.read_bytes())
    raw[165] ^= 255
    file.write_bytes(bytes(raw))
    assert main(["verify", "-a", archive]) == 1
