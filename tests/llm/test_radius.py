"""Decontamination: how many pairs of similarity 0.8 the radius of fingerprints loses, what meets, and joins in parts."""

import math

import numpy as np

from tidewater.llm import common, decontaminate

SF = "/root/testdata/sf0.001"


def fingerprint(h):
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1)
    return bits.sum(axis=0) * 2 > len(h)


def test_radius_keeps_pairs_of_the_threshold():
    """Windows and items of equal size with just 0.8 of their shingles in common: differing bits of random hashes."""
    rng, lost, far = np.random.default_rng(1), 0, []
    for k in range(5000):
        n = 5 + k % 80
        common_ = math.ceil(2 * n * 0.8 / 1.8 - 1e-9)
        h = rng.integers(0, 1 << 63, 2 * n - common_, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - common_, dtype=np.uint64)
        far.append(int((fingerprint(h[:n]) ^ fingerprint(h[n - common_ :])).sum()))
        lost += far[-1] > decontaminate.RADIUS
    assert lost / 5000 <= 0.001 and 7 < np.mean(far) < 12


def test_blocks_lose_nothing_within_the_radius(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(63, k % 21, replace=False))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    assert df.where(decontaminate.meet(F.col("a"), F.col("b"))).count() == 400


def test_joins_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted(map(str, decontaminate.find_leaks(docs, items).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST", 0)
    assert want and rows() == want


def test_items_that_share_an_id_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    x = spark.createDataFrame([(1, f"x {a} y", 1, "q"), (2, b, 2, "q"), (3, "zz " * 50, 3, None), (None, a, 4, "q"), (1, f"x {a} y", 1, "q")], "doc_id long, text string, item_id int, row string")
    items = spark.createDataFrame([(7, a, 0), (7, b, 0), (7, a, 0)], "item_id long, text string, n int")
    got = decontaminate.find_leaks(x, items).collect()
    assert len(got) == 3 and all(r.item_id == 7 and r.words == 30 and r.similarity == 1 for r in got)
    kept = decontaminate.drop_leaks(x, items)
    assert kept.columns == x.columns and [r.doc_id for r in kept.collect()] == [3]
