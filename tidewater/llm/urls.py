"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import salted_join, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One filter block is a 64-bit word; this many rows of (block, word) at most, 32 MB, are ever broadcast.
MAX_BLOCKS = 1 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _spots(key: Column, blocks: int) -> tuple[Column, Column]:
    """A key's block and its four bits in that block's word."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__g, {6 * i}) & 63 as int))") for i in range(4)]
    word = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    return F.pmod(h, F.lit(blocks)).cast("int").alias("__block"), g.alias("__g"), word


def bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter as a table ``(__block int, __bits long)`` with at most ``blocks`` rows."""
    block, g, word = _spots(F.col(column), blocks)
    return keys.where(F.col(column).isNotNull()).select(block, g).groupBy("__block").agg(F.bit_or(word).alias("__bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every URL: ``(id, host, path, rule, verdict)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path starts with the rule's
    path; the longest rule wins, on a tie the one with the longer host, then ``allow``. URLs that no rule fits get
    ``default``: what is not listed is not blocked. Canonical keys are ``host + path``. Each different (host, path) has one key for each
    pair of a host suffix and a listed path length that its path reaches; the keys go through the Bloom filter, a
    broadcast of at most MAX_BLOCKS rows, and those that pass are joined with the rules by hash, so that false
    positives go. Rules that fit very many URLs and URLs that very many pages share are joined in salted parts. Null URLs, or
    such without ``://``, have empty host and path and no rule. Repeated pages give repeated rows; URLs may be of any length.
    Empty rules give ``default`` throughout. Other columns of the input are ignored."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("__rh"), F.coalesce("path", F.lit("")).alias("__rp"), F.col("verdict").alias("__rv")).where("__rh <> ''")
    rules = staged(rules.groupBy("__rh", "__rp").agg(F.min("__rv").alias("__rv")).select(F.concat("__rh", "__rp").alias("__key"), "__rh", "__rp", "__rv"))
    blocks = min(MAX_BLOCKS, max(16, rules.count() // 4))  # 16 bits a key
    # k different lengths take k * k / 2 characters of rules: a table of 1 TB has 1.5 million at most
    lengths = sorted(r[0] for r in rules.select(F.length("__rp")).distinct().collect())
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    host, path = host_path(F.col("__url"))
    base = base.select("__id", host.alias("__host"), path.alias("__path"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.lit(np.array(lengths, dtype=np.int32)), lambda k: k <= F.length("__path"))
    keys = base.where("__host <> ''").select("__host", "__path").distinct().select("__host", "__path", F.explode(suffixes).alias("__h"))
    keys = keys.select("__host", "__path", "__h", F.explode(prefixes).alias("__k")).select("__host", "__path", "__h", F.expr("substring(__path, 1, __k)").alias("__p"))
    keys = keys.withColumn("__key", F.concat("__h", "__p"))
    block, g, word = _spots(F.col("__key"), blocks)
    keys = keys.select("*", block, g).join(F.broadcast(bloom(rules, "__key", blocks)), "__block")
    possible = keys.where(F.col("__bits").bitwiseAND(word) == word).drop("__block", "__g", "__bits")
    size = 2 * F.octet_length("__key") + F.octet_length("__rv")
    hits = salted_join(possible, rules, "__key", F.struct("__host", "__path"), "inner", size).where("__h = __rh AND __p = __rp")
    longest = F.struct(F.length("__key"), F.length("__rh"))
    best = hits.groupBy("__host", "__path").agg(F.max_by(F.struct(F.col("__key").alias("r"), F.col("__rv").alias("v")), longest).alias("__best"))
    best = staged(best.select(F.struct("__host", "__path").alias("__url"), "__best"))
    size = F.octet_length("__url.__host") + F.octet_length("__url.__path") + F.octet_length("__best.r")
    out = salted_join(base.withColumn("__url", F.struct("__host", "__path")), best, "__url", F.col("__id"), "left", size)
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.r").alias("rule"), F.coalesce("__best.v", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM p),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    listed = ", ".join(map(str, RULES))
    rules = spark.sql(f"SELECT * FROM VALUES {listed} AS rules(host, path, verdict)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
