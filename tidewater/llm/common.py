"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.runtime import cut, scratch_dir, staged, unstage

__all__ = ["arrow_map", "cut", "hot_keys", "passing", "ranked", "row_key", "salted_join", "scratch_dir", "staged", "texts_of", "unstage"]

#: Bytes of an Arrow batch that goes to a worker (a row of more goes alone).
BATCH_BYTES = 2 << 20
#: Rows that a Parquet reader decodes at once (Spark's own 4,096 whole texts take tens of MB a task).
READER_ROWS = 512
#: A key is hot that holds more than one in HOT rows, and in large tables more than HOT_ROWS rows, which bounds what a task gets; a
#: key of one in MOST rows or fewer never is, so there are fewer hot keys than MOST, which bounds their broadcast.
HOT, HOT_ROWS, MOST = 256, 1 << 17, 1 << 16
#: A side of at most so many bytes, as measured, is broadcast.
BROADCAST = 4 << 20
#: Bytes of a row (node, row) in memory, at most, and 64-bit words of the filter that texts pass before they are shuffled.
ROW_BYTES, FILTER = 128, 1 << 16


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow for rows with whole texts. The session's batches are bounded in bytes, as Spark's own bound of 64 MB is held
    several times at once in the JVM and in each worker, and so are the rows that a Parquet reader holds at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    return df.mapInArrow(run, schema)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Identity of a row by what it holds (an id may be null or repeated): 64 + 32 bits and the length of the text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(F.xxhash64(doc_id, t).alias("a"), F.crc32(t.cast("binary")).alias("b"), F.octet_length(t).alias("c"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, cells: int = 256) -> DataFrame:
    """Adds ``out``: a gapless number from 0 within ``keys``.

    A key may hold a third of all rows, so its rows are dealt over ``cells`` cells by a hash of ``order``; each cell is
    numbered by itself and starts where the cells before it end. Rows equal in ``order`` may swap numbers."""
    df = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    w = W.partitionBy(*keys).orderBy("__cell")
    bases = df.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    bases = bases.select(*keys, "__cell", (F.sum("__n").over(w) - F.col("__n")).alias("__base"))
    own = W.partitionBy(*keys, "__cell").orderBy(*order)
    df = df.withColumn("__own", F.row_number().over(own) - 1)
    return df.join(bases, [*keys, "__cell"]).withColumn(out, (F.col("__own") + F.col("__base")).cast("long")).drop("__cell", "__own", "__base")


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, __parts int)``: keys of more than total / HOT rows, or HOT_ROWS if that is less, but at least total / MOST, and in how many
    parts of that size to deal them. Fewer than MOST rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    bound = df.agg(F.least(F.count("*") / HOT, F.greatest(F.lit(float(HOT_ROWS)), F.count("*") / MOST)).alias("__bound"))
    found = counts.join(F.broadcast(bound)).where(F.col("__n") > F.col("__bound"))  # one row on the right side
    return staged(found.select(key, F.ceil(F.col("__n") / F.col("__bound")).cast("int").alias("__parts")))


def salted_join(many: DataFrame, few: DataFrame, key: str, salt: Column, how: str = "inner", weight: Column | None = None) -> DataFrame:
    """``many`` with ``few`` (a staged table) by ``key``. ``how`` is inner, left or left_semi.

    ``few`` is broadcast if its rows, of ``weight`` bytes each, are measured to be BROADCAST bytes at most. Otherwise both are shuffled:
    rows of a hot key are dealt over its parts by a hash of ``salt`` (which has to differ among them), and the other
    side's rows of that key are repeated once a part."""
    size = few.agg(F.sum((F.lit(0) if weight is None else weight) + F.lit(100))).first()[0] or 0
    if size <= BROADCAST:
        return many.join(F.broadcast(few), key, how)
    hot = F.broadcast(hot_keys(many.select(key), key))
    many = many.withColumn("__salt", F.xxhash64(salt)).join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod("__salt", "__parts"), F.lit(0)).cast("int"))
    few = few.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return many.drop("__salt", "__parts").join(few.drop("__parts"), [key, "__part"], how).drop("__part")


def passing(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts whose rows are asked for, and few others: they meet a bitmap of the rows asked for, of FILTER words."""
    word = F.pmod("row.a", F.lit(FILTER))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(row.a div {FILTER}, 64) AS INT))")
    held = asked.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__held"))  # FILTER rows at most
    return texts.withColumn("__word", word).join(F.broadcast(held), "__word").where(F.col("__held").bitwiseAND(bit) != 0).select(*texts.columns)


def texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``texts(row, ...)`` with the columns of ``asked(row, ...)`` (a staged table), ``row`` being row_key(). Texts that aren't asked for
    are not shuffled: ``asked`` is broadcast if it is small, else they are passed by a bitmap, and the join drops what it lets by."""
    if asked.count() * ROW_BYTES <= BROADCAST:
        return texts.join(F.broadcast(asked), "row")
    return passing(texts, asked).join(asked, "row")
