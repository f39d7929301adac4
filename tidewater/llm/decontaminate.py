"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import row_key, salted_join, staged

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of windows and items are within the radius if at most so many of 64 bits differ: at similarity 0.8 they differ in 10
#: on average, in more than 20 of 5,000 pairs in none (tests/llm/test_radius.py).
RADIUS = 20
#: Bits a shingle in the filter that finds documents with any shingle of an item, and its greatest size (2 MB).
FILTER_BITS, FILTER_WORDS = 32, 1 << 18


def shingles(words: Column, positions: Column) -> Column:
    """Hashes of the SHINGLE words that start at each position (from 1)."""
    return F.transform(positions, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(SHINGLE)]))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the optimizer would else repeat it inside of ``use``'s lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    empty = lambda r, i: (F.get(r, i) == "").cast("int")
    inner = lambda r: F.slice(r, empty(r, F.lit(0)) + 1, F.greatest(F.lit(0), F.size(r) - empty(r, F.lit(0)) - empty(r, F.size(r) - 1)))
    return let(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), inner)


def all_positions(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))


def simhash(hashes: Column) -> Column:
    """Fingerprint of an array of hashes, repeats counted: a bit is set if in over half of them."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ones = lambda hs, b: F.size(F.filter(hs, lambda h: F.getbit(h, b) == 1))
    bits = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(ones(hs, b) * 2 > F.size(hs), F.call_function("shiftleft", one, b)).otherwise(none))
    return F.aggregate(let(hashes, bits), none, lambda all_, x: all_.bitwiseOR(x))


def _mask(h: Column) -> Column:
    """Four bits of a hash within one 64-bit word of the filter."""
    mask = None
    for k in (0, 6, 12, 18):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
        mask = one if mask is None else mask.bitwiseOR(one)
    return mask


def _filter(hashes: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of the column ``__h``: at most FILTER_WORDS words, which is what reaches the driver."""
    n = hashes.count()
    size = 1 << max(4, min(int(math.log2(FILTER_WORDS)), math.ceil(math.log2(max(1, n * FILTER_BITS / 64)))))
    word = F.expr(f"cast(shiftrightunsigned(__h, 24) & {size - 1} as int)").alias("w")
    out = np.zeros(size, dtype=np.int64)
    for r in hashes.groupBy(word).agg(F.bit_or(_mask(F.col("__h"))).alias("b")).collect():
        out[r.w] = r.b
    return out


def _passes(bits: np.ndarray, h: Column) -> Column:
    held = F.get(F.lit(bits), F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(len(bits) - 1)).cast("int"))
    return held.bitwiseAND(_mask(h)) == _mask(h)


def meet(a: Column, b: Column) -> Column:
    """Whether one of RADIUS + 1 blocks of two fingerprints is equal."""
    edges = [round(64 * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    masks = [(1 << y) - (1 << x) for x, y in pairwise(edges)]
    return let(a.bitwiseXOR(b), lambda x: F.exists(F.lit(np.array([m - (1 << 64) if m >> 63 else m for m in masks])), lambda m: x.bitwiseAND(m) == 0))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(row, item_id, start, words, similarity)``: for each different row_key() of the documents, each item of which some
    window reaches ``similarity``: the best window, its first word (from 0) and length.

    A window has as many words as the item (or the whole text, if that is shorter). Similarity is the weighted Jaccard of the
    five-word shingles, a shingle's weight being how often it stands there; texts are lower-cased and
    parted at all but letters and digits. Texts or items of fewer than five words hold no shingle and match nothing; null and
    empty ones neither. Repeated items count once each.

    1. Two texts of similarity 0.8 share at least four ninths of their shingles' sum, so the window has a run of at least five
       shared shingles (all, if fewer): looking at every fifth position of a document, it can't be missed. A Bloom
       filter of the items' shingles passes documents with any such position; only these go on.
    2. Windows are placed where enough of an item's shingles stand close together. Each starts at a shared
       shingle: moving a window to its first shared one loses none. So a window is compared with items of its size with
       which it shares that much, and not with all.
    3. Window and item meet if one of RADIUS + 1 blocks of their SimHash fingerprints is equal, as it is for all pairs within RADIUS
       bits; then all 64 bits are compared.
    4. The exact weighted similarity verifies them.

    Shingles and items that stand in very many documents are joined in salted parts."""
    hashed = lambda text: let(words_of(text), lambda w: F.struct(F.size(w).alias("m"), shingles(w, all_positions(w)).alias("h")))
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), hashed(F.col(item_text)).alias("w"))
    items = items.where(F.size("w.h") > 0).select("item", F.col("w.m").alias("m"), F.col("w.h").alias("ih"), F.size("w.h").alias("n"))
    items = staged(items.distinct().withColumn("ik", F.xxhash64("item", "ih")).withColumn("ifp", simhash(F.col("ih"))))
    least = items.agg(F.min("n")).first()[0]
    docs = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("__t"))
    if least is None:
        return docs.where("false").select("row", F.lit(0).alias(item_col), F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit(0.0).alias("similarity"))
    share = similarity / (1 + similarity)
    stride = min(SHINGLE, least, *(max(1, math.ceil(math.ceil(2 * share * n - 1e-9) / (n - math.ceil(2 * share * n - 1e-9) + 1))) for n in range(least, least + 200)))
    known = staged(items.select("ik", "n", F.explode("ih").alias("__h")).distinct())
    bits = _filter(known.select("__h").distinct())

    some = lambda w: F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1), F.lit(stride))
    passes = let(words_of(F.col("__t")), lambda w: F.when(F.size(w) >= SHINGLE, F.exists(shingles(w, some(w)), lambda h: _passes(bits, h))))
    cand = docs.where(passes).select("row", hashed(F.col("__t")).alias("w"))
    cand = staged(cand.select("row", F.col("w.m").alias("dm"), F.col("w.h").alias("dh")).dropDuplicates(["row"]))

    seen = F.filter(F.transform("dh", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))), lambda s: _passes(bits, s["h"]))
    hits = cand.select("row", F.size("dh").alias("dn"), F.explode(seen).alias("s")).select("row", "dn", F.col("s.h").alias("__h"), F.col("s.p").alias("p"))
    hits = salted_join(hits, known, "__h", F.struct("row", "p")).select("row", "dn", "ik", "n", "p")
    size = F.least("n", "dn")
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * (F.col("n") + size) - 1e-9)).cast("int")
    hits = hits.withColumn("size", size).withColumn("need", need)
    place = hits.groupBy("row", "ik", "n", "dn", "size", "need").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    enough = let(F.col("ps"), lambda ps: F.filter(F.transform(ps, lambda p, i: F.struct(p.alias("p"), F.get(ps, i + F.col("need") - 1).alias("q"))), lambda s: s["q"] <= s["p"] + F.col("size") - 1))
    place = place.select("row", "ik", "size", F.explode(F.array_distinct(F.transform(enough, lambda s: F.least(s["p"], F.col("dn") - F.col("size") + 1)))).alias("start"))

    windows = place.join(cand.select("row", "dm", "dh"), "row").select("row", "ik", "start", "dm", F.slice("dh", F.col("start"), F.col("size")).alias("wh"))
    windows = windows.select("*", simhash(F.col("wh")).alias("wfp"))
    near = salted_join(windows, items.select("ik", "item", "m", "ih", "ifp"), "ik", F.struct("row", "start"), "inner", 8 * F.size("ih"))
    near = near.where(meet(F.col("wfp"), F.col("ifp")))
    near = staged(near.where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("row", "ik", "item", "start", F.least("m", "dm").alias("words"), "wh", "ih"))

    pair = ["row", "ik", "item", "start", "words"]
    side = lambda c, sign: near.select(*pair, F.explode(c).alias("h"), F.lit(sign).alias("d"))
    counts = side("wh", 1).unionByName(side("ih", -1)).groupBy(*pair, "h").agg(F.count_if(F.col("d") > 0).alias("a"), F.count_if(F.col("d") < 0).alias("b"))
    both = counts.groupBy(*pair).agg(F.sum(F.least("a", "b")).alias("s"), F.sum(F.greatest("a", "b")).alias("u"))
    both = both.withColumn("similarity", F.col("s") / F.col("u")).where(F.col("similarity") >= similarity - 1e-12)
    best = both.groupBy("row", "item").agg(F.max_by(F.struct("similarity", "start", "words"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("row", F.col("item").alias(item_col), (F.col("b.start") - 1).alias("start"), "b.words", F.col("b.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item, with their own columns."""
    leaks = staged(find_leaks(docs, items).select(F.col("row").alias("__row")).distinct())
    return docs.withColumn("__row", row_key()).join(leaks, "__row", "left_anti").select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = staged(find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return docs.select("doc_id", row_key().alias("row")).join(leaks, "row").select("doc_id", "item_id", "start", "words", "similarity")
