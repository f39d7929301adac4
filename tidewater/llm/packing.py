"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, ranked, staged
from tidewater.llm.tokens import WordTokenizer


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", ids_type: str | None = "<u4") -> DataFrame:
    """``(id, piece int, start long, length long, ids_crc32 long[, ids binary])``: each document's ids and the end id, cut. The checksum
    is that of little-endian unsigned 32-bit ids; ``ids_type`` is how the ids themselves are given (None: not at all).
    Only documents of more than ``limit`` ids are cut; all pieces but the first have ``limit`` ids. A null or empty text is the
    end id alone."""
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = WordTokenizer(tokenizer, drops_space=False), np.array([end_id], "<u4").tobytes()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [id_col, "piece", "start", "length", "ids_crc32", "ids"][: 6 if ids_type else 5]
        for b in batches:
            own: list[int] = []
            cols: list[list] = [[] for _ in names[1:]]

            def out() -> pa.RecordBatch:
                batch = pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(own)), *map(pa.array, cols, kinds)], names)  # noqa: B023
                own.clear()  # noqa: B023
                for c in cols:  # noqa: B023
                    c.clear()
                return batch

            for k, text in enumerate(b.column("__text")):
                all_ids = model.encode(text.as_py()) + end
                n = len(all_ids) // 4
                cuts = [0, *range((n - 1) % limit + 1, n + 1, limit)]
                for j, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    ids = all_ids[4 * x : 4 * y]
                    own.append(k)
                    for c, v in zip(cols, (j, x, y - x, zlib.crc32(ids), ids if ids_type == "<u4" else ids_type and np.frombuffer(ids, "<u4").astype(ids_type).tobytes())):
                        c.append(v)
                    if len(own) > 2000:
                        yield out()
            if own:
                yield out()

    id_type = docs.schema["__id"].dataType.simpleString()
    return arrow_map(docs, run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(ids_type))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan for ``{length: count}``, longest first, each piece into the fullest sequence that still holds it:
    ``(length, rank from, rank to, first sequence, pieces a sequence, offset of the first)``.

    Sequences in the same state are handled as one run of numbers with a count, so the work follows the number of
    lengths, not of pieces."""
    open_: dict[int, list[tuple[int, int]]] = {}
    plan, used = [], 0
    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            room = min((r for r, runs in open_.items() if r >= length and runs), default=capacity)
            per = room // length
            if open_.get(room):
                first, count = open_[room].pop()
            else:
                first, count = used, -(-left // per)
                used += count
            whole = min(count, left // per)
            for n, each in ((whole, per), (1, left - whole * per)):
                if n and each and count and (each == per or whole < count):
                    plan.append((length, at, at + n * each, first, each, capacity - room))
                    if room > each * length:
                        open_.setdefault(room - each * length, []).append((first, n))
                    at, left, first, count = at + n * each, left - n * each, first + n, count - n
                if each == per and left >= per:
                    break
            if count:
                open_.setdefault(room, []).append((first, count))
    return plan


def pack(rows: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id long`` and ``offset long``: sequences of at most ``capacity``, gapless from offset 0. All other
    columns stay. Lengths run from 1 to ``capacity``, so histogram and plan are bounded by it, whatever the number of rows;
    rows take the planned slots by joining on their rank within their length. ``order`` makes the ranks; rows equal
    in it may swap slots. A length that very many rows share is ranked in 1024 cells."""
    spark = rows.sparkSession
    rows = rows.withColumn("__l", F.col(length_col).cast("long"))
    counts = {int(r["__l"]): int(r["n"]) for r in rows.groupBy("__l").agg(F.count("*").alias("n")).collect()}
    names, plan = ["__l", "__from", "__to", "__first", "__per", "__at"], best_fit(counts, capacity)
    plan = spark.createDataFrame(pa.table({n: pa.array([p[k] for p in plan], pa.int64()) for k, n in enumerate(names)}))
    rows = ranked(rows, ["__l"], order, "__rank", 1024)
    rows = rows.join(F.broadcast(plan), (rows["__l"] == plan["__l"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).drop(plan["__l"])
    slot = F.col("__rank") - F.col("__from")
    out = rows.withColumn("sequence_id", F.col("__first") + F.expr("(__rank - __from) div __per")).withColumn("offset", F.col("__at") + slot % F.col("__per") * F.col("__l"))
    return out.drop("__l", "__rank", "__from", "__to", "__first", "__per", "__at")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, with_ids: bool = True, ids_type: str = "<u4") -> DataFrame:
    """Pieces of all documents with their sequence and offset; with ``with_ids`` the ids themselves, too, as ``ids_type``.

    Columns: doc_id, piece, start, length, ids_crc32 (of the little-endian 32-bit ids)[, ids], sequence_id, offset.
    Repeated rows are packed as often as they stand; null and empty texts are the end id alone; texts may be of any length; an
    empty table gives none. Other columns are ignored."""
    found = staged(pieces(docs, tokenizer, limit, end_id, ids_type=ids_type if with_ids else None))
    return pack(found, limit, ["doc_id", "piece", "start", "ids_crc32"])


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
