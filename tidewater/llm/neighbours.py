"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window as W

from tidewater.llm.common import staged

#: The tree is fitted on a sample of at most so many vectors and bytes, of least id hash. Nodes are split in BRANCH until a leaf
#: stands for LEAF_ROWS rows of the table, or holds LEAF_SAMPLE vectors of the sample: so there are 4,096 leaves at most.
SAMPLE, SAMPLE_BYTES, BRANCH, LEAF_ROWS, LEAF_SAMPLE = 65_536, 64 << 20, 8, 128, 16
#: Queries on which the number of leaf visits is calibrated, and the recall they must reach there.
CALIBRATION, TARGET = 256, 0.97
#: A cell is searched by one task: neighbouring leaves of so many vectors together (or a part of one leaf that has more) against so
#: many of the queries that visit one of them.
CELL_ROWS, CELL_QUERIES = 16_384, 4_096


class Tree:
    """Centres by node; node 0 is the root, children of a node are listed, leaves have none."""

    def __init__(self, x: np.ndarray, small: int, rng: np.random.Generator) -> None:
        centre, self.child, todo = [x.mean(axis=0)], [[]], [(0, x)]
        while todo:
            node, own = todo.pop()
            if len(own) <= max(small, BRANCH):
                continue
            c = own[rng.choice(len(own), BRANCH, replace=False)]
            for _ in range(10):
                near = self._nearest(own, c)
                c = np.array([own[near == k].mean(axis=0) if (near == k).any() else own[rng.integers(len(own))] for k in range(BRANCH)])
            near = self._nearest(own, c)
            if (near == near[0]).all():  # vectors that can't be told apart
                continue
            for k in range(BRANCH):
                if (near == k).any():
                    centre.append(c[k])
                    self.child.append([])
                    self.child[node].append(len(centre) - 1)
                    todo.append((len(centre) - 1, own[near == k]))
        self.centre = np.array(centre)
        self.leaves = [k for k, c in enumerate(self.child) if not c]
        self.leaf_of = {k: i for i, k in enumerate(self.leaves)}

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest centre, level by level."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not self.child[node]:
                out[at] = self.leaf_of[node]
                continue
            own = self._nearest(x[at], self.centre[self.child[node]])
            todo += [(k, at[own == j]) for j, k in enumerate(self.child[node]) if (own == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> Iterator[list[int]]:
        """For each query the first ``most`` leaves, and further ones until they hold ``least`` rows by ``sizes``, best bin first: a
        priority queue of nodes by their centre's inner product with the query."""
        for scores in q @ self.centre.T:
            queue, out, held = [(0.0, 0)], [], 0
            while queue and (len(out) < most or held < least):
                _, node = heapq.heappop(queue)
                if not self.child[node]:
                    out.append(self.leaf_of[node])
                    held += 0 if sizes is None else sizes[out[-1]]
                for k in self.child[node]:
                    heapq.heappush(queue, (-scores[k], k))
            yield out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _stored(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim).astype(np.float64)


def _best(scores: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, of equal ones those of the smallest ids ``low``."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((low[at], -scores[at]))][:k]


def _near(q: np.ndarray, x: np.ndarray, low: np.ndarray, k: int, rough: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query ``_best`` of all x and their scores: a matrix product (``rough(from, to)``: -inf where x isn't to be looked at)
    finds what may be among them up to its rounding, which is then scored one by one, so that equal vectors have equal scores
    wherever they stand."""
    for i in range(0, len(q), 256):
        own = q[i : i + 256]
        r = own @ x.T if rough is None else rough(i, i + len(own))
        kth = np.partition(r, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(own), -np.inf)
        top = np.where(np.isfinite(r), np.abs(r), 0).max(axis=1) if len(x) else kth
        for one, row, least, size in zip(own, r, kth, top, strict=True):
            at = np.flatnonzero((row >= least - 1e-9 * size) & (row > -np.inf))
            score = (x[at] * one).sum(axis=1)
            some = _best(score, low[at], k)
            yield at[some], score[some]


def nearest(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The k nearest found for each query: ``(query_id, rank, vec_id, score)``. Queries are rows whose id is divisible by
    ``every``, candidates all rows with another id; nearness is the inner product of the vectors as they are stored (32 or 64 bits) in
    double precision, ties go to the smaller id.

    Rows without id, and vectors that are null, zero, of another length than most, or hold null or non-finite components take
    no part. Rows that share an id count as one, by the best of their scores. Equal vectors are one entry of the index with
    their k + 1 smallest ids (no list can show more), so a vector that very many rows share is one entry. The tree is fitted on
    a bounded sample and has more leaves for more rows, then every row is indexed. Leaf visits are widened, 1, 2, 3, .., until
    up to CALIBRATION queries, compared with a search of all rows, find ``target`` of their true neighbours; a query goes
    on while its leaves hold fewer than k + 1 rows. Queries are sent to the cells (neighbouring leaves) that hold leaves that they
    visit, and compared with these leaves only; leaves with many rows and cells with many queries are dealt over further cells. Other columns are ignored; an empty table gives an empty result."""
    spark = rows.sparkSession
    kind = rows.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    dtype, width = ("<f4", "float") if single else ("<f8", "double")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{width}>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    out_schema = "query_id long, rank int, vec_id long, score double"
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out_schema)
    dim, n = sizes[0].d, sizes[0]["count"]
    good = good.where(F.size("v") == dim)
    most = max(LEAF_SAMPLE, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = good.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(most).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks(), dim)
    tree = spark.sparkContext.broadcast(Tree(x, max(LEAF_SAMPLE, len(x) * LEAF_ROWS // n), np.random.default_rng(7)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype) + np.dtype(dtype).type(0)  # -0 is 0
                ids = b.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                raw, ids = np.ascontiguousarray(raw[order]), ids[order]
                keys, inverse = np.unique(raw.view(np.dtype((np.void, raw.itemsize * dim))).ravel(), return_inverse=True)
                by = np.argsort(inverse, kind="stable")
                groups = np.split(ids[by], np.flatnonzero(np.diff(inverse[by])) + 1)
                leaf = tree.value.assign(keys.view(dtype).reshape(-1, dim).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([g[: k + 1] for g in groups], pa.list_(pa.int64()))], ["leaf", "vec", "ids"])

    entries = good.mapInArrow(index, "leaf long, vec binary, ids array<long>")
    entries = entries.groupBy("leaf", "vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = staged(entries)
    queries = staged(good.where(F.col("id") % every == 0).distinct())
    visits = _calibrate(entries, queries, tree.value, dim, dtype, k, target)
    counts = {r.leaf: (r.n, r.ids) for r in entries.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row a leaf
    held = np.array([counts.get(i, (0, 0))[1] for i in range(len(tree.value.leaves))])

    # cells of neighbouring leaves; a leaf of many vectors has cells of its own
    cell_of, parts, size = np.zeros(len(tree.value.leaves), dtype=np.int64), [1], 0
    for i in range(len(cell_of)):
        n = counts.get(i, (0, 0))[0]
        if size and size + n > CELL_ROWS:
            parts.append(1)
            size = 0
        size += n
        cell_of[i], parts[-1] = len(parts) - 1, max(1, -(-size // CELL_ROWS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cell, leaves = [], [], []
            for i, own in enumerate(tree.value.visits(_matrix(b.column("v"), dim), visits, held, k + 1) if b.num_rows else ()):
                own = np.sort(np.array(own))
                which, first = np.unique(cell_of[own], return_index=True)
                at += [i] * len(which)
                cell += which.tolist()
                leaves += np.split(own, first[1:])
            if at:
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("id", "v")), pa.array(cell, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "cell", "leaves"])

    asked = staged(queries.mapInArrow(walk, f"id long, v array<{width}>, cell long, leaves array<long>"))
    many = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    cells = [(i, p, max(1, -(-many.get(i, 0) // CELL_QUERIES))) for i, p in enumerate(parts)]
    cells = F.broadcast(spark.createDataFrame(pa.table({"cell": pa.array([c[0] for c in cells], pa.int64()), "parts": pa.array([c[1] for c in cells], pa.int32()), "blocks": pa.array([c[2] for c in cells], pa.int32())})))  # fewer rows than leaves
    asked = asked.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows_ = entries.withColumn("cell", F.get(F.lit(cell_of), F.col("leaf").cast("int"))).join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("vec"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["cell", "part", "block"]

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not q.num_rows or not x.num_rows:
            return kinds.empty_table()
        x = x.sort_by("leaf")
        leaf, ids = x.column("leaf").to_numpy(), x.column("ids").combine_chunks()
        qv, xv = _matrix(q.column("v").combine_chunks(), dim), _stored(x.column("vec"), dtype, dim)
        low = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]  # the smallest id of each
        wanted: dict[int, list[int]] = {}
        for i, own in enumerate(q.column("leaves").to_pylist()):
            for n in own:
                wanted.setdefault(n, []).append(i)
        where = {n: (np.searchsorted(leaf, n), np.searchsorted(leaf, n, "right"), np.array(who)) for n, who in wanted.items()}

        def rough(lo: int, hi: int) -> np.ndarray:
            out = np.full((hi - lo, len(xv)), -np.inf)
            for s, e, who in where.values():
                own = who[np.searchsorted(who, lo) : np.searchsorted(who, hi)]
                if s < e and len(own):
                    out[own - lo, s:e] = qv[own] @ xv[s:e].T
            return out

        at, score = zip(*_near(qv, xv, low, k + 1, rough))
        own = np.repeat(q.column("id").to_numpy(), [len(a) for a in at])
        return pa.Table.from_arrays([pa.array(own), pa.array(np.concatenate(score)), ids.take(pa.array(np.concatenate(at)))], schema=kinds)

    hits = asked.select("id", "v", "leaves", *key).groupBy(*key).cogroup(rows_.select("leaf", "vec", "ids", *key).groupBy(*key)).applyInArrow(search, "query_id long, score double, ids array<long>")
    hits = hits.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(entries: DataFrame, queries: DataFrame, tree: Tree, dim: int, dtype: str, k: int, target: float) -> int:
    """Leaf visits with which the calibration queries find ``target`` of their true neighbours: the k best rows of other ids."""
    some = queries.orderBy(F.xxhash64("id"), "v").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return len(tree.leaves)
    q, own = _matrix(some.column("v").combine_chunks(), dim), some.column("id").to_pylist()

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a whole task k + 1 entries a query."""
        best: list[list[tuple]] = [[] for _ in own]
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column("ids").to_pylist(), b.column("leaf").to_numpy()
                low = np.array([i[0] for i in ids])
                for i, (at, score) in enumerate(_near(q, _stored(b.column("vec"), dtype, dim), low, k + 1)):
                    new = [(-s, ids[j][0], int(leaf[j]), ids[j]) for j, s in zip(at.tolist(), score.tolist(), strict=True)]
                    best[i] = sorted(best[i] + new)[: k + 1]
        out = [(i, -s, leaf, ids) for i, hits in enumerate(best) for s, _, leaf, ids in hits]
        if out:
            which, score, leaf, ids = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(score, pa.float64()), pa.array(leaf, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["q", "s", "leaf", "ids"])

    true = entries.mapInArrow(top, "q long, s double, leaf long, ids array<long>").select("q", "s", "leaf", F.explode("ids").alias("id"))
    mine = F.get(F.lit(np.array(own, dtype=np.int64)), F.col("q").cast("int"))
    order = W.partitionBy("q").orderBy(F.desc("s"), "id")
    true = true.where(F.col("id") != mine).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").collect()
    places = [{n: i for i, n in enumerate(own)} for own in tree.visits(q, len(tree.leaves))]
    needed = np.array([places[r.q][r.leaf] for r in true])
    visits = 1
    while visits < len(tree.leaves) and len(needed) and (needed < visits).mean() < target:
        visits += max(1, visits // 8)
    return min(visits, len(tree.leaves))


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
