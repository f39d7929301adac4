"""Flat files of token ids with 64-bit document offsets, memory-mapped by readers."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, scratch_dir
from tidewater.llm.tokens import WordTokenizer


def _local(path: str) -> str:
    """A folder that driver and executors mount; memory maps need one."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: token files need a mounted folder (file://...)")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents in ascending id order (null ids first), the end id after each.

    Each range of ids makes one part: ``part-NNNNN.ids`` (flat unsigned integers), ``.offsets`` (n + 1 64-bit offsets
    within the part) and ``.docs`` (64-bit document ids). A part is written under another name and renamed when whole, so
    that a task may run twice. ``manifest.json``, written last, holds each part's documents, ids and base: the prefix sum of
    the ids before it. A null text is the end id alone; repeated ids stay next to each other."""
    target = _local(folder)
    os.makedirs(target, exist_ok=True)
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = f"{target}/part-{task.partitionId():05d}"
        names, own = ("ids", "offsets", "docs"), f".{task.taskAttemptId()}-{uuid.uuid4().hex}"
        model, end = WordTokenizer(tokenizer, drops_space=True, dtype=dtype), np.array([end_id], dtype).tobytes()
        at, count, nulls = 0, 0, 0
        ids, offsets, own_docs = (open(f"{part}.{n}{own}", "wb") for n in names)
        offsets.write(np.array([0], "<i8").tobytes())
        for b in batches:
            sizes = []
            for text in b.column("__text"):
                got = model.encode(text.as_py()) + end
                ids.write(got)
                sizes.append(len(got) // len(end))
            ends = at + np.cumsum(np.array(sizes, "<i8"))
            if len(sizes):
                at = int(ends[-1])
            offsets.write(ends.astype("<i8").tobytes())
            own_docs.write(b.column("__id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            count, nulls = count + b.num_rows, nulls + b.column("__id").null_count
        for n, f in zip(names, (ids, offsets, own_docs), strict=True):
            f.close()
            os.replace(f"{part}.{n}{own}", f"{part}.{n}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "docs": [count], "ids": [at], "nulls": [nulls]})

    ordered = docs.repartitionByRange(F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first())
    parts = sorted(arrow_map(ordered, run, "part long, docs long, ids long, nulls long").collect())  # a row a file
    bases = np.cumsum([0, *(r.ids for r in parts)]).tolist()
    manifest = {"dtype": dtype, "parts": [r.asDict() | {"base": b} for r, b in zip(parts, bases)]}
    with open(f"{target}/manifest.json.new", "w") as f:
        json.dump(manifest, f)
    os.replace(f"{target}/manifest.json.new", f"{target}/manifest.json")


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents from the files: id, start (ids before it in all files), n_tokens, ids_crc32 (as 32-bit ids)[, ids]."""
    target = _local(folder)
    with open(f"{target}/manifest.json") as f:
        manifest = json.load(f)
    dtype, parts = manifest["dtype"], [p for p in manifest["parts"] if p["docs"]]
    rows = spark.createDataFrame(pa.table({k: pa.array([p[k] for p in parts], pa.int64()) for k in ("part", "base", "nulls")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                path = f"{target}/part-{p['part']:05d}"
                ids = np.memmap(f"{path}.ids", dtype, "r")
                offsets, own = np.memmap(f"{path}.offsets", "<i8", "r"), np.memmap(f"{path}.docs", "<i8", "r")
                for i in range(0, len(own), 5000):
                    k = range(i, min(i + 5000, len(own)))
                    wide = [ids[offsets[j] : offsets[j + 1]].astype("<u4").tobytes() for j in k]
                    cols = {id_col: pa.array(own[i : k.stop], mask=np.arange(i, k.stop) < p["nulls"]), "start": pa.array(p["base"] + offsets[i : k.stop]), "n_tokens": pa.array(np.diff(offsets[i : k.stop + 1])), "ids_crc32": pa.array([zlib.crc32(x) for x in wide], pa.int64())}
                    yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(wide, pa.binary())} if with_ids else {}))

    rows = rows.repartitionByRange(max(1, len(parts)), "part")
    return arrow_map(rows, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, with_ids=False)
