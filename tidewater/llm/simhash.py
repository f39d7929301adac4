"""SimHash near-duplicates over a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, cut, row_key, salted_join, staged
from tidewater.operators.graph import weak_components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: The grid: 32 segments of two bits in six blocks. A cell fixes the counts of two whole blocks.
BLOCKS = (0, 12, 24, 34, 44, 54, 64)
#: A cell with more members is dealt over parts of half as many, and each pair of parts is searched by itself.
CELL = 32_768
#: Groups up to this size are searched together, larger ones each by itself.
SMALL = 128


def fingerprint(text: bytes | None) -> int:
    """Unsigned SimHash of a text's word shingles; 0 if it has no word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    return folded(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n))


def folded(h: np.ndarray) -> int:
    """The SimHash of hashes: a bit is set if it is in over half of them."""
    n = len(h)
    bits, total = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little"), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # sums of up to 255 bits fit a byte
        total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``fp long`` (the fingerprint's 64 bits) in the text's place."""
    keep = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(text_col).cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return arrow_map(rows, run, rows.drop(text_col).schema.add("fp", "long"))


def counts(fp: Column) -> Column:
    """The two-bit segments' bit counts 0, 1, 2 in unary: 00, 01, 11. Differing bits of two such words are the Manhattan
    distance of their counts, which is never more than the differing bits of the fingerprints."""
    low, up = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _counts(f: np.ndarray) -> np.ndarray:
    low, up = np.uint64(0x5555555555555555), f >> np.uint64(1)
    return ((f | up) & low) | (((f & up) & low) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, radius: int) -> np.ndarray:
    """Positions where a and b link: first the Manhattan distance of counts as a lower bound, then the bits themselves."""
    at = np.flatnonzero(np.bitwise_count(ca ^ cb) <= radius)
    x, y = a[at] if a.ndim else a, b[at] if b.ndim else b
    return at[np.bitwise_count(x ^ y) <= radius]


def _forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that join what links within each run of equal ``group``: one at most a row."""
    c, n = _counts(fp), len(fp)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    root = np.arange(n)
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for off in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        i = np.flatnonzero((group[off:] == group[:-off]) & small[off:])
        if len(i):
            i = i[_near(fp[i], fp[i + off], c[i], c[i + off], radius)]
            left.append(i)
            right.append(i + off)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:  # smallest position of each component
            low, new = np.minimum(root[a], root[b]), root.copy()
            for at in (a, b, root[a], root[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rest = np.arange(s, s + size)
        while len(rest):
            first, rest, queue = rest[0], rest[1:], [rest[0]]
            while queue and len(rest):
                q = queue.pop()
                hit = _near(fp[q], fp[rest], c[q], c[rest], radius)
                if len(hit):
                    queue.extend(rest[hit])
                    root[rest[hit]] = first
                    rest = np.delete(rest, hit)
    at = np.flatnonzero(root != np.arange(n))
    return fp[at], fp[root[at]]


def grid(rows: DataFrame, fp: str = "fp") -> DataFrame:
    """The rows with ``cell``, once for each cell of the 15 grids that their distinct fingerprints lie in. A cell fixes the counts of two
    of six blocks of segments; one of more than CELL rows is dealt over parts, and each pair of parts is a cell of its own."""
    cols = rows.columns
    c = counts(F.col(fp))
    masks = [sum(((1 << BLOCKS[k + 1]) - (1 << BLOCKS[k])) for k in pair) for pair in combinations(range(6), len(BLOCKS) - 1 - RADIUS)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = rows.select(*cols, F.explode(F.array(*[F.xxhash64(F.lit(i), c.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("cell"))
    large = staged(rows.groupBy("cell").agg(F.count("*").alias("__n")).where(F.col("__n") > CELL))
    parts = F.ceil(F.col("__n") / (CELL // 2)).cast("int")
    rows = rows.join(large, "cell", "left")
    own = F.pmod(F.xxhash64(fp), parts)
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("cell", F.least(j, own), F.greatest(j, own)))
    return rows.select(*cols, F.explode(F.when(F.col("__n").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints ``(fp)`` whose components are those of all links of at most
    ``radius`` = 4 bits. Range join on grids over the segments' bit counts: a Manhattan distance of four can touch four of six
    blocks of segments at most, so in at least one of the 15 grids that are spanned by two blocks both fingerprints lie in the same
    cell of width one, and neighbouring cells need not be looked at. Cells are searched whole, by the distance of the counts
    first, then by the bits; very large ones by pairs of parts. Within a cell a spanning forest is given, not all pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        def out(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            src, dst = _forest(cell, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])
        for b in batches:
            if not b.num_rows:
                continue
            kept.append((b.column("cell").to_numpy(), b.column("fp").to_numpy()))
            cell, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield out(cell[:whole], fp[:whole])
            kept = [(cell[whole:], fp[whole:])]
        if kept:
            yield out(*kept[0])

    return grid(distinct.select("fp")).repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row: ``(id, row, fp, component_id)``, ``row`` being row_key(), ``component_id`` the smallest id
    reachable over links of at most four differing bits (null if no row of the component has an id).

    A null or empty text has fingerprint zero and links like any other. Equal fingerprints are one node, so that a group of
    copies of any size is one row in all later steps. Repeated rows give repeated results; an empty table gives none."""
    rows = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(rows))
    nodes = cut(prints.groupBy("fp").agg(F.min("__id").alias("low")))
    roots = staged(weak_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp"))
    nodes = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = staged(nodes.groupBy("root").agg(F.min("low").alias("component_id")))
    nodes = staged(salted_join(nodes, lowest, "root", F.col("fp")).select("fp", "root", "component_id"))
    return salted_join(prints, nodes, "fp", F.struct("__id", "row")).withColumnRenamed("__id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The documents with one row of each group that ``groups`` finds: the smallest id (rows without id last), of equal ids
    the one with the smallest row key, of wholly repeated rows any one. All columns stay."""
    found = groups(docs, id_col, text_col)
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), "row")
    best = found.groupBy("root").agg(F.min(first).getField("row").alias("__row")).select("__row")
    kept = docs.withColumn("__row", row_key(id_col, text_col)).join(best, "__row", "left_semi")
    many = found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("__row"))
    many = staged(many.join(best, "__row", "left_semi"))
    once = kept.join(many, "__row", "left_anti")
    again = kept.join(many, "__row", "left_semi")
    cols = docs.columns
    again = again.groupBy("__row").agg(F.first(F.struct(*cols)).alias("__d")).select(*[F.col("__d").getField(c).alias(c) for c in cols])
    return once.select(*cols).unionByName(again)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
