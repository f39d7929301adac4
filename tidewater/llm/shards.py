"""Sharding by the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, ranked

#: Hexadecimal digits of a group's key that each look takes, and that each closer look adds.
FIRST, MORE = 3, 2


def _cuts(total: np.ndarray, atom: np.ndarray, shards: int, capacity: int, fluid: bool) -> np.ndarray | None:
    """Greedy check: ends of the shards (prefix sums) if ``capacity`` is enough, else None. ``fluid`` lets a segment
    that isn't one atom be cut anywhere, else no segment may be cut."""
    ends, at, last = np.cumsum(total), 0, int(total.sum())
    found = []
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, side="right"))
        if k == len(ends):
            at = last
        elif fluid and not atom[k]:
            at = at + capacity
        else:
            at = int(ends[k - 1]) if k else 0
        found.append(at)
        if at == last:
            return np.array(found)
    return None


def _least(total: np.ndarray, atom: np.ndarray, shards: int, low: int, high: int, fluid: bool) -> int:
    """Binary search for the smallest feasible capacity in low..high; ``high`` is feasible."""
    while low < high:
        mid = (low + high) // 2
        if _cuts(total, atom, shards, mid, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def plan_shards(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity with which greedy filling in key order needs at most ``shards`` shards, and the first key of
    each further shard. ``groups(key, bytes)``: hexadecimal keys, one row a group.

    The binary search runs over segments: all groups whose keys share a prefix. A segment of several groups is taken
    once as one block (gives a feasible capacity) and once as a fluid (gives a bound from below). Only segments where a
    cut can fall between the two bounds are looked at more closely, by more digits, until the bounds meet. So the result
    is exact, while the driver sees some thousand segment sums, whatever the number of groups."""
    def look(df: DataFrame, digits: int) -> list:
        return df.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").cast("long").alias("b"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()

    segments = {r.p: (r.b, r.m, r.n) for r in look(groups, FIRST)}
    if not segments:
        return 0, []
    for _ in range(64):
        names = sorted(segments)
        total = np.array([segments[p][0] for p in names], dtype=np.int64)
        atom = np.array([segments[p][2] == 1 for p in names])
        floor = max(max(v[1] for v in segments.values()), -(-int(total.sum()) // shards))
        high = _least(total, atom, shards, max(floor, int(total.max())), int(total.sum()), False)
        low = _least(total, atom, shards, floor, high, True)
        if low == high or atom.all():
            break
        ends = np.cumsum(total)
        a, b = _cuts(total, atom, shards, low, True), _cuts(total, atom, shards, high, True)
        b = np.concatenate([b, np.full(len(a) - len(b), ends[-1])])
        near = {k for x, y in zip(a, b, strict=True) for k in range(int(np.searchsorted(ends, x - total.max())), min(len(ends), int(np.searchsorted(ends, y + total.max())) + 1)) if not atom[k]}
        closer: dict[int, list[str]] = {}
        for k in near:
            closer.setdefault(len(names[k]), []).append(names[k])
        if not closer:
            break
        for digits, prefixes in closer.items():
            rows = look(groups.where(F.substring("key", 1, digits).isin(prefixes)), digits + MORE)
            for p in prefixes:
                del segments[p]
            segments |= {r.p: (r.b, r.m, r.n) for r in rows}
    ends = np.cumsum(total)
    cuts = _cuts(total, atom, shards, high, False)
    return high, [names[int(np.searchsorted(ends, x, side="right"))] for x in cuts if x < ends[-1]]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes: ``(id, size, text_crc32, law, shard, slot, grown_shard)``.

    Equal texts form an atomic group; groups are ordered by the MD5 of the text, cut by plan_shards(). A size is the
    text's UTF-8 bytes plus 8 (null text: 8, grouped by itself; its CRC is null). Slots are gapless from 0 in each shard; rows
    that are equal in id and text may swap theirs. An empty table gives no rows. Other columns are ignored. A group
    larger than a shard's share sets the capacity: copies stay together."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"))
    rows = cut(rows)
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    _, firsts = plan_shards(groups, shards)
    shard = sum((F.when(F.col("key") >= k, 1).otherwise(0) for k in firsts), F.lit(0)).cast("int")
    out = ranked(rows.withColumn("shard", shard), ["shard"], ["__id", "key"], "slot")
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
