"""The pipeline's near-dedup against the exact Jaccard similarity of five-word shingles, over all pairs."""

from collections import defaultdict

SF = "/root/testdata/sf0.01"


def kept(rows):
    """Brute force: the smallest id of each component of similarity >= 0.8."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, by = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = s = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        near = {j for x in s or [None] for j in by[x]}
        for x in s or [None]:
            by[x].append(i)
        for j in near:
            if 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i, _ in rows}


def test_stage_against_exact_similarity(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.select("doc_id").collect()} == kept(docs.select("doc_id", "text").collect())


def test_near_copies_with_a_common_passage(spark):
    import numpy as np
    from tidewater.llm import jaccard, simhash

    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    passage, base, rows = word(30), word(120), []
    for i in range(120):
        text = list(base) if i % 3 else [*passage, *word(int(rng.integers(1, 40)))]
        for k in rng.integers(0, len(text), int(rng.integers(0, 6))):
            text[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(x, groups=jaccard.near_duplicates).collect()} == kept(rows)
    assert simhash.keep_one(x.limit(0), groups=jaccard.near_duplicates).count() == 0


def test_the_simhash_grid_alone_links_close_copies(spark, monkeypatch):
    """The first round is op1's grid over the fingerprints' segment counts, large cells by pairs of parts; without any shingle lists it links
    copies that differ in a word."""
    import numpy as np
    from tidewater.llm import jaccard, simhash

    rng = np.random.default_rng(8)
    rows, base = [], [f"w{k}" for k in rng.integers(0, 5000, 300)]
    for i in range(40):
        text = list(base) if i < 20 else [f"w{k}" for k in rng.integers(0, 5000, 300)]
        text[10 * (i % 20)] = f"x{i}"
        rows.append((i, " ".join(text)))
    x = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "ROUNDS", ())
    for cell in (simhash.CELL, 4):
        monkeypatch.setattr(simhash, "CELL", cell)
        assert {r.doc_id for r in simhash.keep_one(x, groups=jaccard.near_duplicates).collect()} == kept(rows) == {0, *range(20, 40)}


def test_similar_sets_with_distant_fingerprints_are_joined(spark):
    """Eight words and the same with a ninth share four of five shingles; of some such pairs the fingerprints differ in more than RADIUS bits."""
    import numpy as np
    from tidewater.llm import jaccard, simhash

    rng, rows = np.random.default_rng(3), []
    while len(rows) < 6:
        words = [f"w{k}" for k in rng.integers(0, 10**6, 9)]
        a, b = (jaccard.fingerprint(jaccard.shingles(" ".join(w).encode())) for w in (words[:8], words))
        if sum((x ^ y).bit_count() for x, y in zip(a, b)) > jaccard.RADIUS:
            rows += [(len(rows), " ".join(words[:8])), (len(rows) + 1, " ".join(words))]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(x, groups=jaccard.near_duplicates).collect()} == kept(rows) == {0, 2, 4}


def test_wide_maps_drop_no_similar_pair_of_large_sets(spark):
    import numpy as np
    from tidewater.llm import jaccard

    rng = np.random.default_rng(4)
    for n in (600, 1500, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([s[: -(n // 9)], rng.integers(0, 2**63, n // 9 - 2).astype(np.uint64)]))
        far = jaccard.differing(jaccard.parity(s), jaccard.parity(other))
        assert far <= len(np.setxor1d(s, other)) and 9 * far <= len(s) + len(other) + 9 * 4
        unlike = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert 9 * jaccard.differing(jaccard.parity(s), jaccard.parity(unlike)) > 2 * n
