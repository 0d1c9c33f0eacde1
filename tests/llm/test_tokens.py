"""Encoding, token files and their exact round trips."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bitplane, bpe, chunks
from tests.llm.conftest import ROWS

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def noise(n, seed):
    r = random.Random(seed)
    chars = "aaabcdeett  \n\t.,'!?-_0123ÄöñéÀ你😀 \x85　​|*#"
    return ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_white_space_is_what_the_pattern_means():
    import re
    own = re.compile(f"[{chunks.SPACE}]")
    assert all(bool(own.match(chr(i))) == bool(regex.match(r"\s", chr(i))) for i in range(0x3100))


def test_merge_replay_equals_word_by_word_encoding(reference):
    coder = bpe.Codec(RANKS, P.PATTERN)
    texts = noise(400, 1) + [t or "" for _, t in ROWS] + ["aaaaaaaaaaaaaaaaaaaaaaa" * 50, "abababab" * 99]
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [coder.decode(g.tolist()).decode() for g in got] == texts


def test_replay_waits_for_lower_ranks_inside_a_word():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"ab": 400, b"abcabc": 261}
    toy = tiktoken.Encoding("toy", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcabc" * k + tail for k in range(1, 5) for tail in ("", "a", "bc", "ab", "cab")] + ["bcbcabcab", "aabcbc"]
    assert bpe.MergeReplay(ranks).encode([w.encode() for w in words]) == [toy.encode_ordinary(w) for w in words]


def test_encode_and_decode(awkward, nothing, reference):
    got = sorted((tuple(r) for r in bpe.encode_and_decode(awkward, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_and_decode(nothing, RANKS, P.PATTERN).collect() == []


def test_memo_starts_anew(reference):
    coder = bpe.Codec(RANKS, P.PATTERN)
    coder._memo._limit = 5
    for texts in (noise(30, 3), noise(30, 4)):
        assert [g.tolist() for g in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_library_memo_equals_the_library(library):
    texts = noise(500, 2) + [t or "" for _, t in ROWS]
    got = bitplane.library_memo(P.path("byte_bpe_50k.json")).ids(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = bitplane.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert (bitplane.from_planes(planes, n) == ids).all()


def test_crc_join():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 700, len(data)):
        assert bitplane.crc_join(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), len(data) - cut) == zlib.crc32(data)


@pytest.mark.parametrize("kind,block", [("byte", 100), ("bit", 65_536)])
def test_token_files(spark, awkward, library, tmp_path, kind, block):
    bitplane.write_token_files(awkward, str(tmp_path), P.path("byte_bpe_50k.json"), kind, block)
    got = sorted((tuple(r) for r in bitplane.read_digests(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    index = spark.read.parquet(f"{tmp_path}/index").orderBy("first_id").collect()
    assert index[0]["first_id"] == 0 and index[-1]["first_id"] + index[-1]["n_ids"] == at
    assert all(a["first_id"] + a["n_ids"] == b["first_id"] for a, b in zip(index, index[1:]))


def test_token_files_of_nothing(spark, nothing, tmp_path):
    bitplane.write_token_files(nothing, str(tmp_path), P.path("byte_bpe_50k.json"))
    assert bitplane.read_digests(spark, str(tmp_path)).collect() == []


def test_bitplane_query_equals_the_library_as_loaded(spark, tmp_path):
    from quarry.llm.entries import QUERIES

    loaded = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"abc {end} def", f"a  {end}{end}  b", end, f"{end} \n x", f"don't{end}'t <|endoftext|", *(end.join(noise(3, k)) for k in range(40)), *noise(9, 99)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op2_bitplane_tokens"](spark, str(tmp_path)).collect())
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*loaded.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert loaded.token_to_id(end) in loaded.encode(texts[0], add_special_tokens=False).ids and got == want


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"single_word": True}])
def test_added_tokens_of_any_kind(tmp_path, flags):
    from tokenizers import AddedToken

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.add_tokens([AddedToken("<x>", normalized=False, **flags), AddedToken("<x>y", normalized=False)])
    t.save(str(tmp_path / "own.json"))
    texts = ["a <x>y b<x> <x>y<x>", "a  <x> ", "z", "", " <|endoftext|><x>"]
    assert [g.tolist() for g in bitplane.library_ids(str(tmp_path / "own.json"))(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
