"""Encoding, decoding and packing against the tokenizers library and by invariants."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe, packing
from cairn.session import ship

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "a" * 3000, "<|endoftext|>x<|endoftext|> y", " \n\n  x\t\x1c\x1d  ", "²³½ٱ日本語 漢字かな👍🏽 é   x", "aaa aaaa aaaaa", "don't I'LL 'll", "x" * 100 + " " * 300 + "\n" * 99, "_a__b 1_2"]


@pytest.mark.parametrize("text", ODD)
def test_ids_and_text_as_the_library(text):
    a = bpe.automaton(PATH)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert a.encode_text(text) == want
    assert a.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ct h'eésSñ日😀_1²\x85　 -.\n\t"), max_size=200))
def test_random_texts(text):
    assert bpe.automaton(PATH).encode_text(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert packing.encoder(PATH).encode(text, allowed_special="all") == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_are_cut_by_the_librarys_character_tables():
    rng = random.Random(3)
    common = [*map(chr, range(32, 127)), *"’“”—…日本ãé€\u2003\u00b2"]
    texts = ["".join(chr(rng.randrange(0x378, 0xD800)) if rng.random() < 0.3 else rng.choice(common) for _ in range(40)) for _ in range(1500)]
    texts += [f"'{chr(c)}a .{chr(c)} 1{chr(c)}1" for c in (0x558, 0x58B, 0x88F, 0xC5C, 0x1C89, 0xA7CB, 0x1E5D0, 0x10D40, 0x11BF0, 0x1CCF0)]
    for s, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert "".join(bpe.split_words(s)) == s
        assert bpe.automaton(PATH).encode_text(s) == e.ids == packing.encoder(PATH).encode_ordinary(s)


def test_merges_that_never_fire_are_dead():
    m = bpe.MergeAutomaton([b"a", b"b", b"c", b"ab", b"bc", b"abc"], [-1] * 6, [-1] * 6, [-1, -1, -1, -2, -2, -2], {})
    for k, (u, v, w) in enumerate([(0, 1, 3), (1, 2, 4), (0, 4, 5)]):
        m._gadget(k, u, v, w)
    m.__post_init__()
    assert m.encode(b"abc") == [3, 2] and m.encode(b"bc") == [4] and m.encode(b"aabcbc") == [0, 3, 2, 4]


def test_self_merge_goes_left_to_right():
    m = bpe.MergeAutomaton([b"a", b"aa"], [-1] * 2, [-1] * 2, [-1, -2], {})
    m._gadget(0, 0, 0, 1)
    m.__post_init__()
    assert [m.encode(b"a" * n) for n in range(1, 6)] == [[0], [1], [1, 0], [1, 1], [1, 1, 0]]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton.compile(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_decode_rows(spark):
    ship(spark)
    rows = [(1, "Hello there"), (2, None), (None, ""), (1, "Hello there"), (3, ODD[4] * 200)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_tokens string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in bpe.encode_decode(df, PATH).collect()}
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        said = ",".join(map(str, ids))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (i, len(ids), sha(said), sha(t or ""), said, t or "") in got
    assert bpe.encode_decode(df.where("false"), PATH).count() == 0


def packed(pieces, capacity):
    """Checks offsets and sizes; returns (per document its joined ids, padding)."""
    docs, windows = {}, {}
    for window, offset, (doc, start, ids, _) in pieces:
        docs.setdefault(doc, []).append((start, ids))
        windows.setdefault(window, []).append((offset, len(ids) // 4))
    padding = 0
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    return {d: b"".join(x for _, x in sorted(v)) for d, v in docs.items()}, padding


@pytest.mark.parametrize("capacity,most_open", [(2048, 4096), (64, 5), (16, 1), (8, 4096)])
def test_packer_loses_nothing(capacity, most_open):
    rng = np.random.default_rng(capacity)
    out = []
    p = packing.LevelPacker(capacity, lambda w, o, x: out.append((w, o, x)), most_open)
    source = {i: rng.integers(0, 9, int(rng.choice([1, 3, capacity // 2 + 1, capacity, 3 * capacity + 5, rng.integers(1, 2 * capacity)])), dtype=np.uint32).tobytes() for i in range(600)}
    for i, b in source.items():
        p.add(i, b)
        assert p.open <= most_open + 1
    p.finish()
    docs, padding = packed(out, capacity)
    assert docs == source and padding == 0


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(5)
    for _ in range(200):
        p = packing.LevelPacker(16, lambda *_: None)
        p.count[1:16] = [rng.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        s = rng.randrange(1, 17)

        def total(h, s=s, p=p):
            n = p.count.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            return int((n**2).sum())

        allowed = [h for h in range(17 - s) if h == 0 or p.count[h]]
        assert total(p.best_level(s)) == min(map(total, allowed))


def test_pack_rows(spark):
    ship(spark)
    rows = [(1, "some words " * 3000), (2, None), (None, "x"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, offset int")
    got = packing.pack(df, PATH).collect()
    assert sum(r.length for r in got) == sum(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    long = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start))
    want = np.array(LIBRARY.encode(rows[0][1], add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert long == want and zlib.crc32(long) == zlib.crc32(want)
    assert all(r.length + r.offset <= 2048 for r in got)
    assert packing.pack(df.where("false"), PATH).count() == 0
