"""Token ids equal those of the tokenizers library on whole texts; packing and files keep every id."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing, token_files
from tidewater.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "  a", "a  b", "a \n b", "\n\na b\n", "a.\nThe b\nc", "x  y  z", "<|endoftext|> a<|startoftext|>", "İstanbul ΣΑΣ Σ b's 'S I'LL", "日本語 テキスト", "a\x01b c\x01 \x01", "a\x00b \x00 c", "\x00", "é é e ́x", "1234 5 6,7 a1b2", "a\x1cb \x1c c", "tab\tx \ty", "a" * 100 + " b " + "語" * 80, "don't we've", "🙂 👍🏽 a", "\r\n a\r\nb", " \n", "a ", "\x85 b \x85c", "  b ", "Ñandú,\nÉl!! (x)_y Ġa Ċ b"]
FILES = [("byte_bpe_50k.json", False, "<u4"), ("word_bpe_49k.json", True, "<u2")]


def library(name, special_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = special_as_text
    return t


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize(("name", "drops", "dtype"), FILES)
def test_hard_texts(name, drops, dtype, special_as_text):
    mine, lib = WordTokenizer(public_tokenizers.path(name), drops, dtype, special_as_text), library(name, special_as_text)
    for t in HARD + HARD:
        assert np.frombuffer(mine.encode(t), dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("name", "drops", "dtype"), FILES)
def test_documents(spark, name, drops, dtype):
    mine, lib = WordTokenizer(public_tokenizers.path(name), drops, dtype), library(name)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(mine.encode(r.text), dtype).tolist() == lib.encode(r.text, add_special_tokens=False).ids


def test_special_tokens_have_their_ids():
    for name, drops, dtype in FILES:
        got = np.frombuffer(WordTokenizer(public_tokenizers.path(name), drops, dtype).encode("a <|endoftext|> b"), dtype).tolist()
        assert {"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}[name] in got


def expected(docs, name, end, shape):
    lib = library(name)
    return {i: shape(np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in docs}


def test_op8_on_documents(spark):
    """Every document's row against the library's plain call."""
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    want, start = {}, 0
    for i, (n, crc) in expected(docs, "word_bpe_49k.json", 1, lambda x: (len(x), zlib.crc32(x.tobytes()))).items():
        want[i] = (start, n, crc)
        start += n
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op8_token_files(spark, SF).collect()} == want


def plain_best_fit(lengths, capacity):
    """Number of sequences of best fit over single pieces, longest first."""
    room = Counter()
    for n in sorted(lengths, reverse=True):
        best = min((r for r, k in room.items() if k and r >= n), default=None)
        if best is not None:
            room[best] -= 1
        room[(capacity if best is None else best) - n] += 1
    return sum(room.values())


def test_op7_on_documents(spark):
    """Pieces against the library's plain call; sequences gapless, and no more of them than a plain best fit makes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, ids in expected(docs, "byte_bpe_50k.json", 2, lambda x: x).items():
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = packing.op7_packing(spark, SF).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()][:-1] and sum(n for _, n in parts) <= 1024
    assert len(by) == plain_best_fit([r.length for r in got], 1024)


def test_very_long_texts(spark):
    long = "word " * 400_000 + "x" * 300_000
    x = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    n = len(library("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids)
    got = packing.pack_documents(x, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == n + 1 and [r.length for r in got if r.doc_id == 2] == [1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_best_fit_places_all(histogram):
    used, seen = {}, {}
    for length, a, b, first, per, at in packing.best_fit(histogram, 40):
        for r in range(a, b):
            q, k = divmod(r - a, per)
            assert (length, r) not in seen
            seen[length, r] = True
            used.setdefault(first + q, []).append((at + k * length, length))
    assert len(seen) == sum(histogram.values())
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end = at + length
        assert end <= 40
    if used:
        assert sorted(used) == list(range(len(used)))


ODD = "doc_id long, text string, length string"
ROWS = [(1, None, "q"), (None, "", None), (3, "a b", ""), (4, "A  b", ""), (4, "A  b", ""), (None, "hello " * 2000, "")]


def test_pieces_and_ids(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 4 + 4 + 2002
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert sorted((r.piece, r.length) for r in got if r.length > 900) == [(0, 978), (1, 1024)]
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, ODD)
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(docs, f"file://{tmp_path}/a", path)
    got = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    lib = library("word_bpe_49k.json")
    assert [r.doc_id for r in got] == [None, None, 1, 3, 4, 4]
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and len(ids) == r.n_tokens and ids[-1] == 1 and zlib.crc32(r.ids) == r.ids_crc32
        start += r.n_tokens
    assert np.frombuffer(got[3].ids, "<u4").tolist() == [*lib.encode("a b", add_special_tokens=False).ids, 1]
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/b", path)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0
