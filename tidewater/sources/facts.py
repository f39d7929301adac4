"""Rule text, fact tables, annotated lines and files as sources (family A and clean-up I5, I7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import levels as L


def parse_rules(lines: DataFrame) -> DataFrame:
    """A1, F2: rules from ``(file_rank, line_no, value)``: ``module,name,arity  [>= ]level [deps]``; two fields are a
    primitive operation. Comments and lines without a level are dropped; the first rule for a key wins."""
    rx = r"^\s*([^#,\s][^,]*),(?:(.*[^,\s]|'.*'),)?\s*(\d+)\s+(>= )?([peds])(?:\s+\[(.*)\])?\s*$"
    part = lambda k: F.regexp_extract("value", rx, k)
    bare = lambda c: F.regexp_replace(c, "^'(.*)'$", "$1")
    df = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(rx))
    df = df.select("file_rank", "line_no", bare(part(1)).alias("m"), bare(part(2)).alias("f"), part(3).cast("int").alias("arity"), (part(4) != "").alias("at_least"), L.level_number(part(5)).alias("level"), part(6).alias("dep_text"))
    two = F.col("f") == ""
    df = df.select("*", F.when(two, "primop").otherwise("mfa").alias("kind"), F.when(two, F.lit(None)).otherwise(F.col("m")).alias("module"), F.when(two, F.col("m")).otherwise(F.col("f")).alias("name"))
    arg = F.transform(F.expr(r"regexp_extract_all(dep_text, '\\{arg, *(\\d+)\\}', 1)"), lambda n: F.struct(F.lit("arg").alias("dep_kind"), F.lit(None).cast("string").alias("target_id"), n.cast("int").alias("arg_pos")))
    remote = F.transform(F.expr(r"regexp_extract_all(dep_text, '\\{remote, *\\{([^}]*)\\}', 1)"), lambda t: F.struct(F.lit("remote").alias("dep_kind"), F.regexp_replace(t, r"^\s*'?([^,']*)'?,\s*'?([^,']*)'?,\s*(\d+)\s*$", "$1:$2/$3").alias("target_id"), F.lit(None).cast("int").alias("arg_pos")))
    df = df.withColumn("deps", F.concat(arg, remote)).withColumn("fn_id", L.fmt_key())
    first = F.row_number().over(W.partitionBy("fn_id").orderBy("file_rank", "line_no"))
    return df.withColumn("__k", first).where("__k = 1").select("fn_id", "kind", "module", "name", "arity", "level", "at_least", "deps")


def load_rules(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A1: rule files; those named earlier win."""
    parts = []
    for rank, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
        parts.append(text.withColumn("file_rank", F.lit(rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return parse_rules(out)


def load_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A2: functions, deps and dep_args, with their fixed schemas."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return read("functions", L.FUNCTIONS), read("deps", L.DEPS), read("dep_args", L.DEP_ARGS)


def merge_modules(facts: DataFrame, order_col: str, module_col: str = "module") -> DataFrame:
    """A3: of a module that stands in several files all rows of the last file."""
    last = facts.groupBy(module_col).agg(F.max(order_col).alias("__last"))
    return facts.join(last, module_col).where(F.col(order_col).eqNullSafe(F.col("__last"))).drop("__last")


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A4: files under a path with module name and checksum; contents are not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", module_name("path").alias("module"), F.md5("content").alias("md5"))


def module_name(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extract_golden(lines: DataFrame) -> DataFrame:
    """A10: expected results from annotated lines ``(path, line_no, value)``: ``%< [opts] f/a value``. The option sets a file
    names in one ``%< global`` line each get the default set's rows where they name no own."""
    found = lines.where(F.col("value").rlike(r"^\s*%<\s")).select("path", F.trim(F.regexp_replace("value", r"^\s*%<\s*", "")).alias("v"))
    is_global = F.col("v").startswith("global")
    sets = found.where(is_global).select("path", F.explode(F.expr(r"regexp_extract_all(v, '\\[[^\\]]*\\]', 0)")).alias("options"))
    rx = r"^(\[[^\]]*\])?\s*(\S+/\d+)\s+(.*)$"
    rows = found.where(~is_global & F.col("v").rlike(rx)).select("path", F.coalesce(F.nullif(F.regexp_extract("v", rx, 1), F.lit("")), F.lit("[]")).alias("options"), F.concat(module_name("path"), F.lit(":"), F.regexp_extract("v", rx, 2)).alias("fn_id"), F.regexp_extract("v", rx, 3).alias("expected"))
    own = rows.where("options <> '[]'")
    sets = sets.unionByName(own.select("path", "options")).distinct()
    filled = rows.where("options = '[]'").drop("options").join(sets, "path").join(own.select("path", "options", "fn_id"), ["path", "options", "fn_id"], "left_anti")
    return rows.unionByName(filled)


def clean(results: DataFrame, module: str | None = None) -> DataFrame:
    """What tests compare: one module, without nested functions, deps as sorted labels."""
    df = results.where(~F.coalesce(F.col("name").rlike(r"_[0-9]+-[0-9]+$"), F.lit(False)))
    df = df.where(F.col("module") == module) if module else df
    return df.withColumn("deps", F.array_sort(F.array_distinct(F.transform("deps", L.dep_label))))


def separate(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a checksum, and broken ones."""
    return files.where("md5 IS NOT NULL"), files.where("md5 IS NULL")
