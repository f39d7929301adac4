"""op11 against scoring every document for every item, with small shards and blocks."""

import glob
import math
import os
import re
from collections import Counter

import duckdb
import pytest

from tidewater.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        q = Counter(words(text))
        scores = []
        for (doc, _), c, x in zip(docs, tf, n):
            s = sum(r * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * x * N // L))) for t, r in q.items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, i, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def run(spark, docs, items, k=10):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS score", "2 AS q"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, got.collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD_DOCS", 64), ("SHARD_ENTRIES", 600), ("BLOCK", 3), ("SMALL", 2), ("CELLS", 40), ("RARE", 2)):
        monkeypatch.setattr(lexical, name, value)


ODD = [(None, "a b c"), (1, None), (2, ""), (3, "   .,;"), (4, "A b B b"), (4, "a b b b"), (5, "É naïve ÉCOLE 日本語 x1y2"), (6, "naïve x1y2"), (7, "a\x00b_c-d{e}f"), (8, "word " * 5000), (9, "b"), (9, "b"), (None, "a b c")]


def test_odd_rows(spark, small):
    items = [(1, "a b"), (2, None), (3, ""), (4, "A a É naïve, 日本語"), (None, "word word B"), (1, "a b"), (5, "nowhere"), (6, "e f x1y2 E"), (6, "c")]
    assert run(spark, ODD, items) == brute(ODD, items)
    assert run(spark, ODD, items, 2) == brute(ODD, items, 2)
    assert not run(spark, [], items) and not run(spark, ODD, []) and not run(spark, [(1, None)], items)


def test_ties_and_copies(spark, small):
    """Hundreds of copies, and very frequent words, over many shards."""
    docs = [(i, f"the same text of many copies {'and one more' * (i % 3)}") for i in range(400, 0, -1)] + [(1000 + i, f"rare{i} the {'the ' * (i % 7)} tail{i % 40}") for i in range(300)]
    items = [(i, f"the many copies rare{i} tail{i} more and") for i in range(25)]
    assert run(spark, docs, items) == brute(docs, items)


def test_documents(spark, small):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter(map(tuple, lexical.op11_lexical(spark, "/root/testdata/sf0.001").collect())) == brute(docs, items)


def test_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    duck = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = lexical.op11_lexical(spark, sf)
    assert Counter(map(tuple, got.collect())) == Counter(duck.execute(f"SELECT {', '.join(got.columns)} FROM ({lexical.ORACLE})").fetchall())


def test_passes(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 20)
    items = [(i, t) for i, t in enumerate(["a b", "naïve word", "c d e", "x1y2 école", "b b a"])]
    assert run(spark, ODD, items) == brute(ODD, items)


def test_blocks_are_skipped(spark, small, monkeypatch):
    """Bounds do the work: with them far fewer documents are scored than the lists hold."""
    scored = {"n": 0}
    whole = lexical.Shard.scores

    def counted(self, docs, *rest):
        scored["n"] += len(docs)
        return whole(self, docs, *rest)

    monkeypatch.setattr(lexical.Shard, "scores", counted)
    import numpy as np
    import pyarrow as pa

    items = lexical.Items([b"topic7 word7 common"])
    texts = [f"topic{i % 40} word{i % 40} common common{i}".encode() for i in range(400)]
    counts = [Counter(lexical.terms(t)) for t in texts]
    own = [sorted(items.number[t] for t in c if t in items.number) for c in counts]
    rows = pa.table({"id": range(400), "n": [4] * 400, "terms": pa.array(own, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(o) for o in own], pa.list_(pa.int32()))})
    held = np.array([sum(t in c for c in counts) for t in items.number])
    shard = lexical.Shard(rows, np.array([lexical.weight(400, int(h)) for h in held]), 400, 1600)
    best = lexical.Best(1, 10, np.zeros(1, np.int64))
    lexical.first_look(shard, items, held, best, np.zeros(3, np.int64))
    scored["n"], best = 0, lexical.Best(1, 10, best.least)
    lexical.search_shard(shard, items, best, np.zeros(3, np.int64), np.full(3, -1))
    assert best.held[0].column("id").to_pylist() == list(range(7, 400, 40)) and scored["n"] <= 10
