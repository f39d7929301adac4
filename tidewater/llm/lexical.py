"""Ranked lexical search: every posting list is cut into blocks of similar documents, whose coordinatewise maxima bound what an item
can score in them; only blocks whose bound reaches the item's tenth best score are opened."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.common import arrow_map, salted_join, staged, unstage

TOP = 10
#: Bytes of different item texts (about) that are searched in one pass over the documents, and whose terms each worker knows.
ITEM_BYTES = 4 << 20
#: A shard of the index: consecutive documents, in the order of their similarity, that one task holds at once.
SHARD_DOCS, SHARD_ENTRIES = 8192, 1 << 20
#: Documents of a block, about, and the length up to which each document of a shard's posting list is a block of its own.
BLOCK, SMALL = 32, 16
#: Cells of a list's dense matrix (documents by coordinates); longer lists are clustered in parts.
CELLS = 1 << 21
#: An item's rarest terms, whose lists give it its first ten scores.
RARE = 6
#: Bounds are sums of whole numbers in doubles, raised by more than their rounding.
ROUNDING = 1 + 1e-9
#: Terms are runs of ASCII letters and digits and of all that isn't ASCII; in UTF-8 these are bytes.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased."""
    return (text or b"").translate(LETTERS).split()


def weight(documents: int, held: int) -> int:
    """A term's weight by the documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def vectors(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """``(id, row long, n long, near long, terms array<int>, tfs array<int>)``: each document's number of terms and, of the terms that
    the broadcast dictionary ``known`` numbers, how often each occurs. ``near`` is the same for documents of like terms (MinHash)."""
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, numbers = known.value, count(TaskContext.get().partitionId() << 33)
        for b in batches:
            ns, sizes, ids, tfs = [], [], [], []
            for text in b.column("__text").cast(pa.binary()):
                words = terms(text.as_py())
                often = Counter(words)
                own = number.keys() & often.keys()
                ns.append(len(words))
                sizes.append(len(own))
                ids.extend(map(number.__getitem__, own))
                tfs.extend(map(often.__getitem__, own))
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            doc, ids, tfs = np.repeat(np.arange(len(ns)), sizes), np.array(ids, np.int64), np.array(tfs, np.int64)
            mixed = (ids + 1) * 0x9E3779B1 % (1 << 32)
            near = np.full(len(ns), -1, np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                near[some] = np.minimum.reduceat(mixed, offsets[some])
            order = np.lexsort((ids, doc))
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x[order].astype(np.int32))) for x in (ids, tfs)]
            row = pa.array([next(numbers) for _ in ns], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__id"), row, pa.array(ns, pa.int64()), pa.array(near), *lists], ["id", "row", "n", "near", "terms", "tfs"])

    return arrow_map(docs, run, f"id {docs.schema['__id'].dataType.simpleString()}, row long, n long, near long, terms array<int>, tfs array<int>")


class Items:
    """The items of one pass: of item q the numbers of its terms and how often it holds them."""

    def __init__(self, texts: list[bytes]) -> None:
        counts = [Counter(terms(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        self.terms = [np.array([self.number[t] for t in c], np.int64) for c in counts]
        self.times = [np.array(list(c.values()), np.int64) for c in counts]


class Shard:
    """Documents of one shard with their impacts: of document d and term t weight * (10^9 tf div (1000 tf + 8 m))."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, documents: int, length: int) -> None:
        self.ids = rows.column("id")
        sizes = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
        term, tf = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        n = rows.column("n").to_numpy()
        m = 100 - 75 + (75 * n * documents) // length
        doc = np.repeat(np.arange(len(sizes)), sizes)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        self.doc, self.term, self.impact = doc[some], term[some], impact[some]
        self.start = np.searchsorted(self.doc, np.arange(len(sizes) + 1))
        order = np.argsort(self.term, kind="stable")
        by_term = self.term[order]
        self.listed, first = np.unique(by_term, return_index=True)
        self.list_start = np.append(first, len(by_term))
        self.list_docs, self.list_impacts = self.doc[order], self.impact[order]
        self.most = np.maximum.reduceat(self.list_impacts, first) if len(first) else np.empty(0, np.int64)

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms have a list here, and the lists' places."""
        at = np.minimum(np.searchsorted(self.listed, wanted), max(0, len(self.listed) - 1))
        here = np.flatnonzero(self.listed[at] == wanted) if len(self.listed) else np.empty(0, np.int64)
        return here, at[here]

    def listing(self, place: int) -> slice:
        return slice(self.list_start[place], self.list_start[place + 1])

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the documents' entries, and of which of ``docs`` each is."""
        sizes = self.start[docs + 1] - self.start[docs]
        row = np.repeat(np.arange(len(docs)), sizes)
        return np.repeat(self.start[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row)), row

    def scores(self, docs: np.ndarray, own: np.ndarray, times: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Exact scores of an item; ``scratch`` is zero for every term before and after."""
        scratch[own] = times
        out = np.zeros(len(docs), np.int64)
        for i in range(0, len(docs), 4096):
            at, row = self.entries(docs[i : i + 4096])
            np.add.at(out[i : i + 4096], row, self.impact[at] * scratch[self.term[at]])
        scratch[own] = 0
        return out

    def blocks(self, docs: np.ndarray, dims: np.ndarray, column: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(documents, starts, summaries)``: a posting list clustered by the similarity of its documents (each goes to the
        nearest of evenly spread ones), clusters cut into blocks, and each block's greatest impact in every coordinate of
        ``dims``. ``column`` is scratch space, -1 for every term before and after."""
        step = max(BLOCK, CELLS // max(1, len(dims)))
        column[dims] = np.arange(len(dims))
        for i in range(0, len(docs), step):
            part = docs[i : i + step]
            at, row = self.entries(part)
            col = column[self.term[at]]
            inside = col >= 0
            dense = np.zeros((len(part), len(dims)))
            dense[row[inside], col[inside]] = self.impact[at[inside]]
            centres = dense[:: 2 * BLOCK] if len(part) > 2 * BLOCK else dense[:1]
            centres = centres / np.maximum(1, np.linalg.norm(centres, axis=1, keepdims=True))
            nearest = np.argmax(dense @ centres.T, axis=1)
            order = np.argsort(nearest, kind="stable")
            group = nearest[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(rank % BLOCK == 0)
            yield part[order], starts, np.maximum.reduceat(dense[order], starts, axis=0)
        column[dims] = -1


class Best:
    """Each item's best documents so far, and the score that a document must reach."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.held: list[pa.Table | None] = [None] * items

    def add(self, q: int, ids: pa.Array, scores: np.ndarray) -> None:
        new = pa.table({"id": ids, "score": pa.array(scores)})
        new = new if self.held[q] is None else pa.concat_tables([self.held[q], new])
        self.held[q] = new.take(pc.sort_indices(new, sort_keys=[("score", "descending"), ("id", "ascending")])[: self.k]).combine_chunks()
        if self.held[q].num_rows == self.k:
            self.least[q] = max(self.least[q], self.held[q].column("score")[-1].as_py())

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, t in enumerate(self.held):
            for b in t.to_batches() if t is not None else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, q, np.int32)), b.column("id"), b.column("score")], ["q", "id", "score"])


def first_look(shard: Shard, items: Items, held: np.ndarray, best: Best, scratch: np.ndarray) -> None:
    """Some good documents of every item: the best by its rarest terms alone, with their whole scores."""
    for q, (own, times) in enumerate(zip(items.terms, items.times)):
        here, at = shard.places(own)
        rare = np.argsort(held[own[here]], kind="stable")[:RARE]
        if not len(rare):
            continue
        cuts = [shard.listing(p) for p in at[rare]]
        docs, place = np.unique(np.concatenate([shard.list_docs[c] for c in cuts]), return_inverse=True)
        partly = np.zeros(len(docs), np.int64)
        np.add.at(partly, place, np.concatenate([shard.list_impacts[c] * t for c, t in zip(cuts, times[here[rare]])]))
        if len(docs) > best.k:
            docs = docs[np.argpartition(-partly, best.k)[: best.k]]
        scores = shard.scores(docs, own, times, scratch)
        good = scores >= max(1, best.least[q])
        if good.any():
            best.add(q, shard.ids.take(pa.array(docs[good])), scores[good])


def search_shard(shard: Shard, items: Items, best: Best, scratch: np.ndarray, column: np.ndarray) -> None:
    """All documents of the shard that are among an item's best. Lists whose greatest impacts together stay below the score to
    reach can't bring a document in alone and aren't opened; of the others, the blocks whose bound reaches it."""
    wanted: dict[int, list[int]] = defaultdict(list)  # by list: the items that have to look into it
    found: list[list[np.ndarray]] = [[] for _ in items.terms]
    for q, (own, times) in enumerate(zip(items.terms, items.times)):
        here, at = shard.places(own)
        most = times[here] * shard.most[at]
        if not len(here) or most.sum() < best.least[q]:
            continue
        order = np.argsort(shard.list_start[at] - shard.list_start[at + 1], kind="stable")  # longest first
        for p in at[order[np.cumsum(most[order]) >= max(1, best.least[q])]]:
            wanted[int(p)].append(q)
    for place, asking in wanted.items():
        docs = shard.list_docs[shard.listing(place)]
        if len(docs) <= SMALL:
            for q in asking:
                found[q].append(docs)
            continue
        dims = np.unique(np.concatenate([items.terms[q] for q in asking]))
        dims = dims[shard.places(dims)[0]]
        times = np.zeros((len(dims), len(asking)))
        for j, q in enumerate(asking):
            at = np.searchsorted(dims, items.terms[q])
            inside = np.flatnonzero(dims[np.minimum(at, len(dims) - 1)] == items.terms[q])
            times[at[inside], j] = items.times[q][inside]
        for part, starts, summaries in shard.blocks(docs, dims, column):
            reached = summaries @ times * ROUNDING >= np.maximum(1, best.least[asking])
            sizes = np.diff(np.append(starts, len(part)))
            for j in np.flatnonzero(reached.any(axis=0)):
                found[asking[j]].append(part[np.repeat(reached[:, j], sizes)])
    for q, docs in enumerate(found):
        if docs:
            docs = np.unique(np.concatenate(docs))
            scores = shard.scores(docs, items.terms[q], items.times[q], scratch)
            good = scores >= max(1, best.least[q])
            if good.any():
                best.add(q, shard.ids.take(pa.array(docs[good])), scores[good])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, docs, entries = [], 0, 0
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            kept.append(part)
            docs, entries = docs + part.num_rows, entries + (pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0)
            if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                yield pa.Table.from_batches(kept)
                kept, docs, entries = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def _pass(index: DataFrame, shared, least: np.ndarray | None, k: int) -> DataFrame:
    """``(q, id, score)``: the k best of each item in each task; with ``least`` all that reach it, else some to start with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, weights, documents, length = shared.value
        scratch, column = np.zeros(len(held), np.int64), np.full(len(held), -1, np.int64)
        best = Best(len(items.terms), k, np.zeros(len(items.terms), np.int64) if least is None else least)
        for rows in _shards(batches):
            shard = Shard(rows, weights, documents, length)
            if least is None:
                first_look(shard, items, held, best, scratch)
            else:
                search_shard(shard, items, best, scratch, column)
        yield from best.rows()

    return index.select("id", "n", "terms", "tfs").mapInArrow(run, f"q int, id {index.schema['id'].dataType.simpleString()}, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(docs: DataFrame, texts: list[str], k: int, id_col: str, text_col: str) -> DataFrame:
    """``(q, rank, id, score)`` for the items of one pass."""
    context = docs.sparkSession.sparkContext
    items = Items([t.encode() for t in texts])
    raw = staged(vectors(docs, context.broadcast(items.number), id_col, text_col))
    documents, length, rows = raw.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    counts = raw.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()  # a row a term of the items
    held = np.zeros(len(items.number), np.int64)
    held[counts.column("t").to_numpy()] = counts.column("n").to_numpy()
    weights = np.array([weight(documents, int(n)) for n in held], np.int64)
    shared = context.broadcast((items, held, weights, documents, length))
    index = raw.where(F.size("terms") > 0).repartitionByRange(max(1, -(-rows // SHARD_DOCS)), "near", "row").sortWithinPartitions("near", "row")
    index = staged(index)
    unstage(raw)
    least = np.zeros(len(texts), np.int64)
    for r in _best(_pass(index, shared, None, k), k).where(F.col("rank") == k).select("q", "score").collect():  # a row an item
        least[r.q] = r.score
    out = staged(_best(_pass(index, shared, least, k), k))
    unstage(index)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item id, rank int, id, score long)``: the k documents of the highest score above 0 for every row of ``items``; equal scores
    by ascending id, rows without id last; repeated rows of documents are documents of their own.

    The documents' vectors over the items' terms are the index: sorted by MinHash and cut into shards, in which each posting list
    is clustered into blocks. Every document is in it, and no result is lost: what is skipped has a bound below the tenth
    best score that is already known. Equal item texts are searched once. Items go to the workers in passes of about
    ITEM_BYTES of text. Null and empty items and documents have no terms and no results; texts may be of any length; empty tables
    give none; other columns are ignored."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("__item"), F.coalesce(F.col(item_text), F.lit("")).alias("__text")).withColumn("__key", F.sha2("__text", 256))
    different = items.groupBy("__key").agg(F.first("__text").alias("__text"))
    size = different.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    found = []
    for i in range(passes):
        own = different.where(F.pmod(F.xxhash64("__key"), F.lit(passes)) == i).orderBy("__key").toArrow()  # about ITEM_BYTES
        keys = spark.createDataFrame(pa.table({"q": pa.array(range(own.num_rows), pa.int32()), "__key": own.column("__key").cast(pa.string())}))
        found.append(_search(docs, own.column("__text").to_pylist(), k, id_col, text_col).join(F.broadcast(keys), "q"))  # a row a text of the pass
    results = staged(reduce(DataFrame.unionByName, found).select("__key", "rank", F.col("id").alias("__doc"), "score"))
    out = salted_join(items.select("__item", "__key"), results, "__key", F.col("__item"))
    return out.select(F.col("__item").alias(item_id), "rank", F.col("__doc").alias(id_col), "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The definition, every document against every item.
ORACLE = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))) AS impact
  FROM tf JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores
QUALIFY rank <= 10
"""
