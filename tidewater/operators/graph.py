"""Frontier-based iteration over edge tables. Edges are never collected; only counts reach the driver. The loops end when nothing
changes and have no other bound."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import bucketed, counted, cut, tidy, unstage


def compacted(tables: list[DataFrame], most: int = 16) -> list[DataFrame]:
    """The tables of earlier rounds as one, if there are many; the last one stays by itself."""
    if len(tables) <= most:
        return tables
    whole = cut(reduce(DataFrame.unionByName, tables[:-1]))
    unstage(*tables[:-1])
    return [whole, tables[-1]]


#: A target with more edges is dealt over parts, so that no bucket grows with one hub.
HUB = 1 << 22
#: Labels of the last rounds that are grouped anew each round, at most.
FEW = 1 << 18


def _max(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.groupBy("node").agg(*[F.max(p).alias(p) for p in parts])


#: Cells of targets that are counted to find hubs; rows of a bucket that a join may hold as a hash table.
CELLS, HASHED = 1 << 16, 1 << 18


@dataclass
class Dealt:
    """Edges ``(src, dst, ...)`` in buckets of their targets. If there are hubs, ``(node, __parts)`` says in how many parts each is dealt,
    and the buckets are those of ``__key``, a hash of target and part."""

    table: DataFrame
    hubs: DataFrame | None

    def meet(self, nodes: DataFrame, how: str = "inner") -> DataFrame:
        """The edges with the rows of ``nodes(node, ...)`` (one a node, a counted table) for their targets; edges aren't shuffled."""
        few = nodes.staged_rows <= HASHED * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if self.hubs is None:
            sent = nodes.withColumnRenamed("node", "dst")
            return self.table.join(sent.hint("shuffle_hash") if few else sent, "dst", how)
        sent = nodes.join(F.broadcast(self.hubs), "node", "left").withColumnRenamed("node", "dst")
        sent = sent.withColumn("__key", F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1), lambda i: F.xxhash64("dst", i)))).drop("__parts")
        return self.table.join(sent.hint("shuffle_hash") if few else sent, ["__key", "dst"], how)


def dealt(edges: DataFrame) -> Dealt:
    """Edges are shuffled and written once. Repeated ones may stay: what is read from them are sets and maxima. Hubs are found before,
    by exact counts in those cells of targets that hold as many rows."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    cell = F.pmod(F.xxhash64("dst"), F.lit(CELLS))
    cells = counted(edges.groupBy(cell.alias("__cell")).agg(F.count("*").alias("n")).where(F.col("n") > HUB))  # less than one in HUB edges
    if cells.staged_rows:
        some = edges.select("dst", cell.alias("__cell")).join(F.broadcast(cells), "__cell", "left_semi")
        hubs = counted(some.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("node", F.ceil(F.col("n") / HUB).cast("int").alias("__parts")))
        if hubs.staged_rows:
            parts = edges.join(F.broadcast(hubs.withColumnRenamed("node", "dst")), "dst", "left")
            part = F.coalesce(F.pmod(F.xxhash64("src"), "__parts").cast("int"), F.lit(0))
            return Dealt(bucketed(parts.select(*edges.columns, F.xxhash64("dst", part).alias("__key")), "__key"), hubs)
    return Dealt(bucketed(edges, "dst"), None)


@tidy
def highest(edges: DataFrame | Dealt, seeds: DataFrame) -> DataFrame:
    """``(node, *parts)``: for each part of the label the greatest value that a node reaches. ``edges(src, dst)`` means src depends on
    dst; ``seeds(node, *parts)`` have one or more ordered values; a null is less than all. Nodes that reach no seed are left out.

    All parts travel in one loop (a product of lattices): a round sends the labels that rose in the round before over the edges
    and keeps what beats the nodes' labels so far. Edges are written once, in buckets of their targets, so no round shuffles them.
    Labels so far are one table in buckets of the nodes and those of the few rounds since it was written; it is written anew when these
    have grown to half its rows, so a node is written a logarithmic number of times. A round is one write, whose row count ends
    the loop.
    Null nodes are ignored, duplicates collapse, empty inputs give the seeds."""
    parts = [c for c in seeds.columns if c != "node"]
    by_target = edges if isinstance(edges, Dealt) else dealt(edges.select("src", "dst"))
    frontier = counted(_max(seeds.where("node IS NOT NULL"), parts))
    state, recent = None, [frontier]
    while frontier.staged_rows:
        known = _max(by_target.meet(frontier).select(F.col("src").alias("node"), *parts), parts)
        held = [state] if state is not None else []
        for i, df in enumerate([*held, _max(reduce(DataFrame.unionByName, recent), parts) if len(recent) > 1 else recent[0]]):
            known = known.join(df.select("node", *[F.col(p).alias(f"__{i}_{p}") for p in parts]), "node", "left")
        had = {p: F.greatest(*[F.col(f"__{i}_{p}") for i in (0, 1)]) if held else F.col(f"__0_{p}") for p in parts}
        rose = [F.col(p).isNotNull() & (had[p].isNull() | (F.col(p) > had[p])) for p in parts]
        frontier = counted(known.where(reduce(Column.__or__, rose)).select("node", *[F.coalesce(F.greatest(F.col(p), had[p]), F.col(p), had[p]).alias(p) for p in parts]))
        recent = [*recent, frontier]
        if sum(t.staged_rows for t in recent) > max(FEW, state.staged_rows // 2 if held else 0) or len(recent) > 16:
            new = bucketed(_max(reduce(DataFrame.unionByName, [*held, *recent]), parts), "node")
            unstage(*held, *recent[:-1])
            state, recent = new, [frontier]
    return bucketed(_max(reduce(DataFrame.unionByName, [*([state] if state is not None else []), *recent]), parts), "node")


def reach(edges: DataFrame | Dealt, seeds: DataFrame) -> DataFrame:
    """Nodes ``(node)`` that reach a seed ``(node)``, the seeds among them. Each node enters one frontier."""
    return highest(edges, seeds.select("node", F.lit(1).alias("label"))).select("node")


def weak_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node on an edge, root = the smallest node of its weakly connected component.

    Alternates large-star and small-star contraction, so rounds grow with the logarithm of the size, not with the
    diameter. A hub's neighbours are never gathered: its minimum is an aggregate with partial sums on the map side, and
    the join back is one that adaptive execution may split. Self edges and null ends are ignored."""
    pair = lambda a, b: (F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
    now, n = cut(edges.select("src", "dst").dropna().where("src <> dst").select(*pair("src", "dst")).distinct()), -1
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        new = cut(small.unionByName(low.withColumnRenamed("low", "dst")).where("src <> dst").select(*pair("src", "dst")).distinct())
        n, before = new.count(), n
        if n == before and new.join(now, ["src", "dst"], "left_anti").isEmpty():  # equal sets
            break
        unstage(now)
        now = new
    roots = now.groupBy("src").agg(F.min("dst").alias("root")).withColumnRenamed("src", "node")
    return roots.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct().join(roots, "node", "left_anti"))
