"""Filters, joins, set operations and reports over the fact tables (families B, C, E to H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import levels as L
from tidewater.runtime import counted, staged

CALLS = ("remote", "local", "primop", "erl")


def dependencies(deps: DataFrame, dep_args: DataFrame | None = None, where: Column | None = None, higher: bool = False) -> DataFrame:
    """B2: distinct ``(fn_id, target_id)``; with ``higher`` also functions passed as arguments."""
    out = deps.where(F.col("dep_kind").isin(*CALLS) & F.col("target_id").isNotNull())
    out = (out if where is None else out.where(where)).select("fn_id", "target_id")
    if higher:
        out = out.unionByName(dep_args.where("kind = 'fn' AND passed_id IS NOT NULL").select("fn_id", F.col("passed_id").alias("target_id")))
    return out.distinct()


def drop_internal(df: DataFrame) -> DataFrame:
    """B3."""
    return df.where(~F.coalesce(L.internal(), F.lit(False)))


def delete_modules(df: DataFrame, modules: DataFrame) -> DataFrame:
    """Without the functions of the modules; keys that aren't functions stay."""
    gone = modules.select(F.col("module").alias("__m")).distinct()
    return df.join(gone, (df["module"] == F.col("__m")) & (df["kind"] == "mfa"), "left_anti")


def only_modules(df: DataFrame, modules: DataFrame) -> DataFrame:
    """B5."""
    return df.join(modules.select("module").distinct(), "module", "left_semi")


def leaves(functions: DataFrame, deps: DataFrame) -> DataFrame:
    """Rows without dependencies."""
    return functions.join(deps.select("fn_id").distinct(), "fn_id", "left_anti")


def higher_order(deps: DataFrame) -> DataFrame:
    """Higher-order functions and their argument positions."""
    return deps.where("dep_kind = 'arg'").groupBy("fn_id").agg(F.array_sort(F.collect_set("arg_pos")).alias("positions"))


def known_builtins(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """B1: keys that have a rule."""
    return keys.join(rules.select("fn_id"), "fn_id", "left_semi")


def is_pure(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Exactly level p, no bound, nothing left; absent keys are not."""
    ok = (F.col("level") == 0) & ~F.col("at_least") & (F.size("deps") == 0)
    return keys.join(results.select("fn_id", ok.alias("pure")), "fn_id", "left").select("fn_id", F.coalesce("pure", F.lit(False)).alias("pure"))


def bounded_level_of(results: DataFrame) -> DataFrame:
    """What keeps dependencies is read as a lower bound."""
    return results.withColumn("at_least", F.col("at_least") | (F.size("deps") > 0))


def initialise(functions: DataFrame) -> DataFrame:
    """B10."""
    return functions.withColumn("level", F.coalesce("level", F.lit(0)).cast("tinyint")).withColumn("at_least", F.coalesce("at_least", F.lit(False)))


def rectify(rules: DataFrame) -> DataFrame:
    """Rules as termination sees them."""
    return rules.withColumn("level", F.lit(0).cast("tinyint"))


def predefined(spark, mode: str = "effects") -> DataFrame:
    """Levels of expressions."""
    catch, finite, infinite = (2, 3, 3) if mode == "effects" else (0, 0, 3)
    rows = [("erl:catch", "catch", catch), ("erl:receive:finite", "receive:finite", finite), ("erl:receive:infinite", "receive:infinite", infinite)]
    return spark.createDataFrame([(k, "erl", "erl", n, 0, v, False) for k, n, v in rows], L.FUNCTIONS)


def targets(deps: DataFrame) -> DataFrame:
    """``(fn_id, target_id, dep_kind)`` of every row; a target with variable parts is ``undefined``."""
    return deps.where("dep_kind <> 'arg'").select("fn_id", F.coalesce(F.when(F.col("dep_kind").isin(*CALLS), F.col("target_id")), F.lit("undefined")).alias("target_id"), "dep_kind")


def collect_targets(deps: DataFrame) -> DataFrame:
    """Distinct targets; what has variable parts is ``undefined``."""
    return targets(deps).select("fn_id", "target_id").distinct()


def strip_arg_deps(deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies without those on itself, and the argument positions set aside."""
    return deps.where("dep_kind <> 'arg' AND (target_id IS NULL OR target_id <> fn_id)"), deps.where("dep_kind = 'arg'").select("fn_id", "arg_pos").distinct()


def add_builtins(functions: DataFrame, deps: DataFrame, dep_args: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The functions with the rules of all they use (a rule wins over a row), and the deps with the rules' own. Rules'
    own targets are followed, as a rule may name another."""
    called = deps.where(F.col("dep_kind").isin(*CALLS)).select(F.col("target_id").alias("fn_id"))
    used = called.unionByName(dep_args.where("kind = 'fn'").select(F.col("passed_id").alias("fn_id"))).distinct()
    via = staged(rules.join(used, "fn_id", "left_semi").select("fn_id", F.explode_outer("deps").alias("d")).select("fn_id", F.explode(F.array("fn_id", "d.target_id")).alias("used")))
    got = staged(rules.join(via.select(F.col("used").alias("fn_id")).distinct(), "fn_id", "left_semi"))
    col = lambda c: F.col(c) if c in rules.columns else F.lit(None)
    rows = got.select("fn_id", "kind", col("module").cast("string").alias("module"), col("name").cast("string").alias("name"), col("arity").cast("int").alias("arity"), "level", "at_least")
    own = got.select("fn_id", F.explode("deps").alias("d")).select("fn_id", F.lit(0).cast("bigint").alias("call_id"), "d.dep_kind", "d.target_id", "d.arg_pos", F.lit(None).cast("string").alias("var"))
    had = functions.select("fn_id").unionByName(deps.select("fn_id")).distinct()  # ids alone are shuffled, as rules mostly replace nothing
    lost = counted(rows.select("fn_id").join(had, "fn_id", "left_semi"))
    keep, deps = functions.select(*rows.columns), deps.select(*own.columns)
    if lost.staged_rows:
        keep, deps = keep.join(lost, "fn_id", "left_anti"), deps.join(lost, "fn_id", "left_anti")
    return keep.unionByName(rows), deps.unionByName(own)


def function_rmap(deps: DataFrame, dep_args: DataFrame) -> DataFrame:
    """Each dependency with its sorted distinct dependents."""
    return dependencies(deps, dep_args, higher=True).groupBy("target_id").agg(F.array_sort(F.collect_set("fn_id")).alias("dependents"))


def module_rmap(functions: DataFrame, deps: DataFrame, dep_args: DataFrame) -> DataFrame:
    """``(module, dependent)``: modules that depend on a module, also by passing its functions; not on itself."""
    called = deps.where(F.col("dep_kind").isin(*CALLS) & F.col("target_id").isNotNull()).select("fn_id", "target_id")
    passed = dep_args.where("kind = 'fn' AND passed_id IS NOT NULL").select("fn_id", F.col("passed_id").alias("target_id"))
    own = functions.select("fn_id", "module")
    target = functions.select(F.col("fn_id").alias("target_id"), F.col("module").alias("__t"))
    pairs = staged(called.unionByName(passed).join(own, "fn_id").select("module", "target_id").distinct())  # edges are shuffled once
    out = pairs.join(target, "target_id").where(F.col("module") != F.col("__t"))
    return out.select(F.col("__t").alias("module"), F.col("module").alias("dependent")).distinct()


def find_missing(functions: DataFrame, deps: DataFrame, dep_args: DataFrame) -> DataFrame:
    """C4: what is referenced but has no row: ``(fn_id, kind)``."""
    kind = F.when(F.col("target_id").rlike(":/\\d+$"), "primop").otherwise("mfa")
    used = dependencies(deps, dep_args, F.col("dep_kind") != "erl", higher=True).select(F.col("target_id").alias("fn_id"), kind.alias("kind")).distinct()
    return used.join(functions.select("fn_id"), "fn_id", "left_anti")


def missing_modules(missing: DataFrame) -> DataFrame:
    """C5."""
    return missing.where("kind = 'mfa'").select(F.regexp_extract("fn_id", "^(.*?):", 1).alias("module")).distinct().orderBy("module")


def missing_counts(missing: DataFrame) -> DataFrame:
    """E6."""
    return missing.groupBy("kind").agg(F.count("*").alias("n"))


def restore_arg_deps(results: DataFrame, aside: DataFrame) -> DataFrame:
    """Argument positions return to all that isn't s."""
    arg = F.struct(F.lit("arg").alias("dep_kind"), F.lit(None).cast("string").alias("target_id"), F.col("arg_pos").cast("int").alias("arg_pos"))
    back = aside.groupBy("fn_id").agg(F.collect_set(arg).alias("__a"))
    out = results.join(back, "fn_id", "left")
    both = F.when((F.col("level") < 3) & F.col("__a").isNotNull(), F.array_sort(F.array_union("deps", "__a"))).otherwise(F.col("deps"))
    return out.withColumn("deps", both).drop("__a")


def unite(effects: DataFrame, termination: DataFrame) -> DataFrame:
    """Greater level, bound if either is one, dependencies of both; s has none."""
    t = termination.select("fn_id", F.col("level").alias("__l"), F.col("at_least").alias("__a"), F.col("deps").alias("__d"))
    cols = [c for c in effects.columns if c not in ("fn_id", "level", "at_least", "deps")]
    out = effects.join(t, "fn_id", "full").withColumn("level", F.greatest("level", "__l"))
    s = F.col("level") == 3
    none = F.array().cast(effects.schema["deps"].dataType)
    return out.select("fn_id", *cols, "level", (~s & (F.coalesce("at_least", F.lit(False)) | F.coalesce("__a", F.lit(False)))).alias("at_least"), F.when(s, none).otherwise(F.array_sort(F.array_union(F.coalesce("deps", none), F.coalesce("__d", none)))).alias("deps"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """H1: distinct rows of both."""
    return a.unionByName(b).distinct()


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """H2, H5: the rows of a, repeats and all columns kept, whose keys don't stand in b; a null key stands for itself."""
    return _by_keys(a, b, keys, "left_anti")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """H3: the rows of a whose keys stand in b as well."""
    return _by_keys(a, b, keys, "left_semi")


def _by_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return a.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


def in_all(sets: DataFrame, group: list[str], each: str, member: str) -> DataFrame:
    """H3 over many sets: ``(*group, member)``: members that stand in all sets ``each`` of their group."""
    n = sets.groupBy(*group).agg(F.countDistinct(each).alias("__n"))
    held = sets.groupBy(*group, member).agg(F.countDistinct(each).alias("__k"))
    return held.join(n, group).where("__k = __n").select(*group, member)


def upsert(old: DataFrame, new: DataFrame, key: str = "fn_id") -> DataFrame:
    """H4: the new row wins."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    """All functions of new's modules go, then new's rows come."""
    return upsert(delete_modules(old, new.where("kind = 'mfa'").select("module")), new)


def add_dependencies(new_deps: DataFrame, new_args: DataFrame, cached: DataFrame) -> DataFrame:
    """C11: cached results that new code needs."""
    wanted = dependencies(new_deps, new_args, higher=True).select(F.col("target_id").alias("fn_id")).distinct()
    return cached.join(wanted, "fn_id", "left_semi")


def add_unresolved(needed: DataFrame, cached: DataFrame, dep_args: DataFrame) -> DataFrame:
    """And cached rows that are still unresolved, with what they pass."""
    still = cached.where(F.size("deps") > 0)
    passed = dep_args.where("kind = 'fn'").join(still.select("fn_id"), "fn_id", "left_semi").select(F.col("passed_id").alias("fn_id")).distinct()
    return needed.unionByName(still).unionByName(cached.join(passed, "fn_id", "left_semi")).dropDuplicates(["fn_id"])


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """F1."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def enumerate_from_one(df: DataFrame, array_col: str) -> DataFrame:
    """F3."""
    keep = [c for c in df.columns if c != array_col]
    return df.select(*keep, F.posexplode(array_col).alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def name_nested(nested: DataFrame, reserved: DataFrame) -> DataFrame:
    """names ``f_a-n`` for ``nested(module, parent, arity, seq)``, n counting per parent and skipping
    ``reserved(module, name)``.

    Gaps and islands: of a parent's reserved numbers r the j-th lies behind r - j free ones, so the k-th free number is k and as many
    as there are reserved ones with r - j < k. Children and reserved numbers meet in one order; a parent's rows are its
    children and the reserved names of just this parent."""
    group = ["module", "parent", "arity"]
    own = nested.withColumn("__at", F.row_number().over(W.partitionBy(*group).orderBy("seq")).cast("long")).withColumn("__taken", F.lit(0))
    part = lambda k: F.regexp_extract("name", r"^(.*)_(0|[1-9][0-9]*)-([1-9][0-9]*)$", k)
    taken = reserved.where(part(3) != "").select("module", part(1).alias("parent"), part(2).alias("__arity"), part(3).cast("decimal(38,0)").alias("__r")).distinct()
    parents = nested.select(*group, F.col("arity").cast("string").alias("__arity")).distinct()
    taken = taken.join(parents, ["module", "parent", "__arity"])
    free = F.col("__r") - F.row_number().over(W.partitionBy(*group).orderBy("__r"))
    taken = taken.select(*group, free.alias("__at"), F.lit(1).alias("__taken"))
    both = own.withColumn("__at", F.col("__at").cast("decimal(38,0)")).unionByName(taken.withColumn("__at", F.col("__at").cast("decimal(38,0)")), allowMissingColumns=True)
    before = F.sum("__taken").over(W.partitionBy(*group).orderBy("__at", "__taken").rowsBetween(W.unboundedPreceding, -1))
    number = (F.col("__at") + F.coalesce(before, F.lit(0))).cast("long")
    out = both.withColumn("n", number).where("__taken = 0")
    name = F.concat("parent", F.lit("_"), F.col("arity").cast("string"), F.lit("-"), F.col("n").cast("string"))
    return out.withColumn("name", name).select(*nested.columns, "name")


def diff_results(expected: DataFrame, actual: DataFrame, cols: list[str]) -> DataFrame:
    """C17: rows of one side only, repeats counted, with ``side``."""
    a, b = expected.select(*cols), actual.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("actual")))


def classes() -> Column:
    """Limited (bound, nothing left), hofs (an argument left), undefined (other things left), else the level."""
    has_arg = F.exists("deps", lambda d: d["dep_kind"] == "arg")
    return F.when(F.col("at_least") & (F.size("deps") == 0), "limited").when(has_arg, "hofs").when(F.size("deps") > 0, "undefined").otherwise(L.level_name())


def stats(results: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Counts by class for each module and the share that is pure, worst first."""
    df = drop_internal(results)
    df = (only_modules(df, modules) if modules is not None else df).withColumn("class", classes())
    names = ("p", "e", "d", "s", "hofs", "limited", "undefined")
    out = df.groupBy("module").agg(*[F.count_if(F.col("class") == n).alias(n) for n in names], F.count("*").alias("total"))
    return out.withColumn("pct_pure", F.when(F.col("total") > 0, 100.0 * F.col("p") / F.col("total")).otherwise(0.0)).orderBy("pct_pure", "module")


def stats_total(table: DataFrame) -> DataFrame:
    """One row of sums and shares."""
    names = ("p", "e", "d", "s", "hofs", "limited", "undefined")
    out = table.agg(F.count("*").alias("modules"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*names, "total")])
    return out.select("*", *[F.when(F.col("total") > 0, 100.0 * F.col(n) / F.col("total")).otherwise(0.0).alias(f"pct_{n}") for n in names])


def all_modules(df: DataFrame) -> DataFrame:
    """E5."""
    return df.select("module").distinct()


def to_wide(deps: DataFrame) -> DataFrame:
    """Sorted distinct dependencies of each function."""
    return deps.groupBy("fn_id").agg(F.array_sort(F.collect_set(F.struct("dep_kind", "target_id", "arg_pos"))).alias("deps"))


def in_order(df: DataFrame, out: str = "rank") -> DataFrame:
    """A sorted table with the rows' numbers from 1: counted within its partitions, which start where those before them end."""
    df = staged(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = df.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))  # a row a partition
    bases = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__base"))
    return df.withColumn("__p", part).join(F.broadcast(bases), "__p").withColumn(out, F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__base", "__id")


def write_lines(df: DataFrame, order: list[str], path: str) -> None:
    """Text files whose parts, one after the other in the order of their names, hold ``value`` in ``order``."""
    df.orderBy(*order).select("value").write.text(path)


def read_lines(spark, path: str) -> DataFrame:
    """``(rank, value)``: the lines that write_lines() wrote, numbered over all parts. A part is read whole by one task."""
    from pyspark.sql.types import StringType, StructType

    lines = spark.read.schema(StructType().add("value", StringType())).text(path, wholetext=True)
    lines = lines.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "value"), F.length("value").alias("__n")).where("__n > 0")
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))  # a row a part
    bases = sizes.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("__base"))
    return lines.join(F.broadcast(bases), "file").select((F.col("__base") + F.col("at") + 1).alias("rank"), "value")


def listing(results: DataFrame) -> DataFrame:
    """One line ``key result.`` a row, by module, name and arity."""
    return results.orderBy("module", "name", "arity", "fn_id").select(F.concat("fn_id", F.lit(" "), L.fmt_result(), F.lit(".")).alias("value"))


def write_listing(results: DataFrame, path: str) -> None:
    """The listing as text files in order."""
    write_lines(results.withColumn("value", F.concat("fn_id", F.lit(" "), L.fmt_result(), F.lit("."))), ["module", "name", "arity", "fn_id"], path)


def stats_report(table: DataFrame) -> DataFrame:
    """The rows of modules, worst first, and last a row of totals."""
    return _report(table).orderBy("__last", "pct_pure", "module").drop("__last")


def _report(table: DataFrame) -> DataFrame:
    total = stats_total(table).select(F.format_string("%d modules", "modules").alias("module"), *[F.col(c) for c in table.columns if c not in ("module", "pct_pure")], F.col("pct_p").alias("pct_pure"))
    return table.withColumn("__last", F.lit(0)).unionByName(total.withColumn("__last", F.lit(1)))


def write_stats(table: DataFrame, path: str) -> None:
    """Text files in order: one header, a line of comma-separated values for each module, worst first, and one line of totals."""
    lines = _report(table).select("__last", "pct_pure", "module", F.to_csv(F.struct(*table.columns)).alias("value"))
    head = table.sparkSession.createDataFrame([(-1, 0.0, "", ",".join(table.columns))], lines.schema)
    write_lines(lines.unionByName(head), ["__last", "pct_pure", "module"], path)
