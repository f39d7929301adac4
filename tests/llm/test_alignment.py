"""op12 against whole-text encoding and a plain evaluation of all links."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    """Byte-level letters, from the rule: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def plain(models, text):
    """Groups of one text as lists of ids, None if the bytes differ."""
    a, b = models
    back = letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    groups, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(ids_a) or j < len(ids_b):
        if x <= y and i < len(ids_a):
            left.append(ids_a[i])
            x += len(bytes_a[i])
            i += 1
        else:
            right.append(ids_b[j])
            y += len(bytes_b[j])
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return groups


def brute(models, texts):
    all_groups = [plain(models, t) if t else None for t in texts]
    links = [[(a, b) for left, right in g or [] for a in left for b in right] for g in all_groups]
    held = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for g, own in zip(all_groups, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        yield sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(own), sum(held[p] == most[p[0]] for p in own), sum(held[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if g else ""


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "\n", "a", "a", "word word", "two  spaces", " lead", "trail ", "line\nend", "line \n end\n", "tab\there", "a▁b", "<s> <|endoftext|> </s>", "<0x0A>", "naïve café ﬁn", "日本語のテキスト 混ぜ", "👩‍👩‍👧 x", "\x00", "a\x00b c", "don't I'll", "x" * 5000, "᠎ a", "a\x1cb \x85c", "é é é", "12345 67,89 $#@! --", "word " * 300, "  z", "\xa0a b\xa0"]


def test_odd_texts(spark, models):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", __import__("pyspark").sql.functions.lit(1))
    got, pairs = alignment.align(df, A, B)
    want = Counter((i, *w) for (i, _), w in zip(rows, brute(models, [t for _, t in rows])))
    assert Counter((r.doc_id, *(r[c] for c in COLS)) for r in got.collect()) == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.collect() if r.groups)
    held = Counter(p for _, t in rows if t for p in {(a, b) for x, y in plain(models, t) or [] for a in x for b in y})
    assert {(r.a, r.b): r.n for r in pairs.collect()} == held


def test_empty_table(spark):
    got, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 == pairs.count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "7", " ", " ", "\n", "\t", "'s", "é", "語", "\xa0", ".", "--", "ing", "▁", "\x85", "<s>", "　"]), min_size=1, max_size=12).map("".join))
def test_units(models, text):
    aligner = test_units.__dict__.setdefault("aligner", None) or alignment.Aligner(A, B)
    test_units.aligner = aligner
    own = alignment.units(text)
    assert "".join(map(alignment.spelled, own)) == " " + text
    found, whole = aligner.records(own), aligner.whole(text)
    if None not in found.values():
        assert ";".join(found[u][0] for u in own) == whole[0]
        assert [sum(found[u][i] for u in own) for i in range(1, 5)] == list(whole[1:5])
    elif whole is None:
        assert plain(models, text) is None


def test_documents(spark, models, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {(i, *w) for (i, _), w in zip(texts, brute(models, [t for _, t in texts]))}
    for size in (4096, 7):
        monkeypatch.setattr(alignment, "CHUNK_DOCS", size)
        got = alignment.op12_alignment(spark, "/root/testdata/sf0.001")
        assert {(r.doc_id, *(r[c] for c in COLS)) for r in got.collect()} == want


def test_counts_come_back_in_a_bare_process():
    """As in a worker that got Arrow streams and made no array itself: nothing else has loaded pyarrow.compute by chance."""
    import subprocess
    import sys
    from pathlib import Path

    import pyarrow as pa

    long, ints = pa.int64(), pa.list_(pa.int32())
    rows = pa.table({"chunk": pa.array([0, 0], long), "n_a": pa.array([1, None], long), "x": pa.array([[0], [0, 1]], ints), "y": pa.array([[2], [0]], ints), "z": pa.array([None, [1]], ints)})
    counts = pa.table({"code": pa.array([5], long), "n": pa.array([3], long), "best": [True]})
    sent = pa.BufferOutputStream()
    for t in (rows, counts):
        with pa.ipc.new_stream(sent, t.schema) as out:
            out.write_table(t)
    code = """
import sys
import pyarrow as pa
from tidewater.llm.alignment import _counted_back

rows, counts = (pa.ipc.open_stream(sys.stdin.buffer).read_all() for _ in range(2))
print(_counted_back(rows, counts).select(["n_best", "count_sum"]).to_pylist())
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], input=sent.getvalue().to_pybytes(), capture_output=True)
    assert ran.stdout.decode().strip() == "[{'n_best': 2, 'count_sum': 6}]", ran.stderr.decode()


def test_next_task_aligns_what_is_new(spark, monkeypatch):
    """Two tasks of one worker: the models are read once, and B gets each different unit once."""
    import pyarrow as pa
    import sentencepiece

    read, asked, model = [], [], sentencepiece.SentencePieceProcessor

    class Counted(model):
        def __init__(self, *args, **kwargs):
            read.append(1)
            super().__init__(*args, **kwargs)

        def encode(self, texts, *args, **kwargs):
            asked.extend(texts)
            return super().encode(texts, *args, **kwargs)

    if hasattr(alignment, "aligner"):
        alignment.aligner.cache_clear()
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Counted)
    monkeypatch.setattr(alignment, "arrow_map", lambda docs, run, schema: run)
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    task = alignment.aligned_rows(spark.createDataFrame([], "doc_id long, text string"), A, B, "doc_id", "text", False)
    said = []
    for texts in (["early words, then others", "early words"], ["words, then late others", "early late"]):
        rows = task(iter([pa.RecordBatch.from_pydict({"__id": pa.array([1, 2], pa.int64()), "__text": texts})]))
        said.append([h for b in rows for h in b.column("groups_sha256").to_pylist() if h is not None])
    assert len(read) == 1
    assert sorted(asked) == sorted({"early", "words", "then", "others", "late"})
    alignment.aligner.cache_clear()
    again = alignment.Aligner(A, B)
    assert said[1] == [hashlib.sha256(again.whole(t)[0].encode()).hexdigest() for t in ("words, then late others", "early late")]


def test_forgetting(monkeypatch):
    aligner, fresh = alignment.Aligner(A, B), alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    first, later = ["often", "naïve,", "\nline", "x" * 90, *(f"unit{i}" for i in range(60))], [*(f"other{i}." for i in range(30)), "late!"]
    aligner.records(first)
    aligner.uses.all[aligner.numbers(["often", "naïve,", "\nline", "x" * 90])] += 9
    aligner.forget()
    assert {"often", "naïve,", "\nline", "unit59"} <= aligner.index.keys() and not {"unit0", "x" * 90} & aligner.index.keys()
    assert aligner.nums.n == aligner.fixed + 20
    assert aligner.records(first + later) == fresh.records(first + later)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "é", "語", " ", "\n", "\t", ".", "\x85", "\x00"]), max_size=8).map("".join), max_size=6), st.integers(0, 3))
def test_parted(texts, before):
    import pyarrow as pa

    names, places, sizes = alignment.parted(pa.array(texts, pa.string())[before:])
    assert [names[i].as_py() for i in places.tolist()] == [u for t in texts[before:] if t for u in alignment.units(t)]
    assert sizes.tolist() == [len(alignment.units(t)) if t else 0 for t in texts[before:]]
