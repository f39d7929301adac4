"""Propagation of levels through the dependency graph (family D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import tables as T
from tidewater.operators.components import cyclic
from tidewater.operators.graph import Dealt, compacted, dealt, highest, reach
from tidewater.runtime import bucketed, counted, cut, tidy

NODEPS = "array<struct<dep_kind:string,target_id:string,arg_pos:int>>"


def concrete_calls(positions: DataFrame, deps: DataFrame, dep_args: DataFrame, higher: DataFrame | None = None) -> DataFrame:
    """Every call ``(fn_id, call_id, target_id, need, concrete)`` of a higher-order function: concrete if as many
    functions that aren't higher-order (or are the callee) are passed at its positions as it has. ``higher`` has the positions
    of all functions, if ``positions`` are those of some callees only."""
    need = positions.groupBy(F.col("fn_id").alias("target_id")).agg(F.count("*").alias("need"))
    calls = deps.where(F.col("dep_kind").isin("remote", "local")).select("fn_id", "call_id", "target_id").distinct().join(need, "target_id")
    at = positions.select(F.col("fn_id").alias("target_id"), F.col("arg_pos").alias("pos"))
    passed = dep_args.where("kind = 'fn'").join(at, ["target_id", "pos"]).select("fn_id", "call_id", "target_id", "pos", "passed_id")
    hof = (positions if higher is None else higher).select(F.col("fn_id").alias("passed_id")).distinct().withColumn("h", F.lit(True))
    good = passed.join(hof, "passed_id", "left").where(F.col("h").isNull() | (F.col("passed_id") == F.col("target_id")))
    good = good.groupBy("fn_id", "call_id", "target_id").agg(F.count("*").alias("n"))
    out = calls.join(good, ["fn_id", "call_id", "target_id"], "left")
    return out.select("fn_id", "call_id", "target_id", "need", (F.coalesce("n", F.lit(0)) == F.col("need")).alias("concrete"))


def indirect_args(positions: DataFrame, deps: DataFrame, dep_args: DataFrame, higher: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Over calls that aren't concrete, the caller's own positions ``(fn_id, arg_pos)`` that flow to the callee's, and
    the callers ``(fn_id)`` with a call whose positions aren't all covered so."""
    calls = concrete_calls(positions, deps, dep_args, higher).where("NOT concrete")
    at = positions.select(F.col("fn_id").alias("target_id"), F.col("arg_pos").alias("pos"))
    flows = dep_args.where("kind = 'arg'").join(at, ["target_id", "pos"]).join(calls.select("fn_id", "call_id", "target_id"), ["fn_id", "call_id", "target_id"], "left_semi")
    covered = flows.groupBy("fn_id", "call_id", "target_id").agg(F.countDistinct("pos").alias("n"))
    unknown = calls.join(covered, ["fn_id", "call_id", "target_id"], "left").where(F.coalesce("n", F.lit(0)) < F.col("need"))
    return flows.select("fn_id", F.col("from_pos").alias("arg_pos")).distinct(), unknown.select("fn_id").distinct()


def unfold_hofs(deps: DataFrame, dep_args: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(deps, unknown)``: higher-order calls unfolded to the fixpoint. Functions passed at a higher-order position become
    dependencies of the caller; arguments handed on make the caller higher-order itself. Both tests are read at the
    fixpoint, so the order of calls doesn't matter; positions only grow, so the loop ends.

    Semi-naive: a round looks only at the calls that new positions touch (those of functions that got a position, and
    those that pass a function that became higher-order); only these are tested again, and only their flows are new."""
    own = counted(deps.where("dep_kind = 'arg'").select("fn_id", "arg_pos").distinct())
    if not own.staged_rows:  # nothing is higher-order
        return deps, deps.select("fn_id").limit(0)
    calls = bucketed(deps.where("dep_kind IN ('remote', 'local') AND target_id IS NOT NULL").select("fn_id", "call_id", "target_id", "dep_kind").distinct(), "target_id")
    given = bucketed(dep_args.where("kind IN ('fn', 'arg')"), "target_id")
    handed = bucketed(dep_args.where("kind = 'fn'").select("fn_id", "call_id", "target_id", "passed_id").distinct(), "passed_id")
    new, known = own, [own]
    while new.staged_rows:
        positions = reduce(DataFrame.unionByName, known)
        by_target = calls.join(new.select(F.col("fn_id").alias("target_id")).distinct(), "target_id", "left_semi").select("fn_id", "call_id", "target_id")
        by_passed = handed.join(new.select(F.col("fn_id").alias("passed_id")).distinct(), "passed_id", "left_semi").select("fn_id", "call_id", "target_id")
        touched = by_target.unionByName(by_passed).distinct()
        key = ["fn_id", "call_id", "target_id"]
        asked = positions.join(touched.select(F.col("target_id").alias("fn_id")).distinct(), "fn_id", "left_semi")
        flows, _ = indirect_args(asked, calls.join(touched, key, "left_semi"), given.join(touched, key, "left_semi"), positions)
        new = counted(flows.join(positions, ["fn_id", "arg_pos"], "left_anti"))
        known = compacted([*known, new])
    positions = reduce(DataFrame.unionByName, known)
    _, unknown = indirect_args(positions, calls, given)
    at = positions.select(F.col("fn_id").alias("target_id"), F.col("arg_pos").alias("pos"))
    passed = given.where("kind = 'fn'").join(at, ["target_id", "pos"], "left_semi").select("fn_id", F.col("passed_id").alias("target_id")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    more = passed.select("fn_id", F.lit(-1).cast("bigint").alias("call_id"), F.lit("remote").alias("dep_kind"), "target_id", none("int").alias("arg_pos"), none("string").alias("var"))
    args = positions.join(own, ["fn_id", "arg_pos"], "left_anti").select("fn_id", F.lit(-1).cast("bigint").alias("call_id"), F.lit("arg").alias("dep_kind"), none("string").alias("target_id"), "arg_pos", none("string").alias("var"))
    return deps.unionByName(more).unionByName(args), unknown


def mark_recursive(deps: DataFrame, dep_args: DataFrame) -> DataFrame:
    """Functions that call themselves without one argument position that shrinks in every such call."""
    calls = deps.where("target_id = fn_id").groupBy("fn_id").agg(F.countDistinct("call_id").alias("calls"))
    less = dep_args.where("kind = 'sub' AND target_id = fn_id").groupBy("fn_id", "pos").agg(F.countDistinct("call_id").alias("n"))
    fine = calls.join(less, "fn_id").where("n = calls").select("fn_id").distinct()
    return calls.select("fn_id").join(fine, "fn_id", "left_anti")


def _labels(nodes: DataFrame, edges: Dealt, start: DataFrame | None, unknown: DataFrame | None) -> DataFrame:
    """``(node, own, label, low)`` of every row of ``nodes``, a bucketed table: its own label and the greatest that it reaches (4 is s, 3 is
    open: it reaches a missing target, then d and e), and whether it reaches a lower bound. One loop finds both.

    Labels and bounds of targets without dependencies, and label 3 of targets without a row, go into those that depend on them
    before: hubs such as common built-ins never enter the loop."""
    low = F.col("at_least").cast("int") if "at_least" in nodes.columns else F.lit(0)
    no = lambda kind: F.lit(None).cast(kind)
    about = [nodes.select(F.col("fn_id").alias("node"), F.when(F.col("level") == 3, 4).otherwise(F.col("level")).cast("int").alias("label"), F.coalesce(low, F.lit(0)).alias("low"), F.lit(True).alias("row"), no("boolean").alias("goes_on"))]
    about += [df.select(F.col("fn_id").alias("node"), F.lit(a).cast("int").alias("label"), F.lit(b).cast("int").alias("low"), no("boolean").alias("row"), no("boolean").alias("goes_on")) for df, a, b in ((start, 4, None), (unknown, None, 1)) if df is not None]
    about.append(edges.table.select(F.col("src").alias("node"), no("int").alias("label"), no("int").alias("low"), no("boolean").alias("row"), F.lit(True).alias("goes_on")).distinct())
    about = bucketed(reduce(DataFrame.unionByName, about).groupBy("node").agg(*[F.max(c).alias(c) for c in ("label", "low", "row", "goes_on")]), "node")
    met = edges.meet(about, "left").where("label IS NULL OR goes_on IS NULL")
    up = met.select(F.col("src").alias("node"), F.coalesce("label", F.lit(3)).alias("label"), F.coalesce("low", F.lit(0)).alias("low"))
    own = about.where("goes_on").select("node", "label", "low")
    found = highest(edges, own.unionByName(up).where("label > 0 OR low > 0"))
    both = about.where("row").select("node", F.col("label").alias("own"), F.col("low").alias("__low")).join(found, "node", "left")
    return bucketed(both.select("node", F.coalesce("own", F.lit(0)).alias("own"), F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("label", F.lit(0))).alias("label"), (F.greatest("__low", "low") > 0).alias("low")), "node")


def _resolved(nodes: DataFrame, edges: Dealt, start: DataFrame | None, unknown: DataFrame | None) -> DataFrame:
    """``(fn_id, level, left array<struct<dep_kind, target_id>>, at_least)``, what resolve() says; ``edges(src, dst, dep_kind)``."""
    label = _labels(nodes, edges, start, unknown)
    # of targets only those count that are left, missing or open, and those above p; what depends on an s is one
    known = edges.meet(label, "left").where("label IS NULL OR label BETWEEN 1 AND 3")
    open_ = F.col("label").isNull() | (F.col("label") == 3)
    known = known.select(F.col("src").alias("node"), F.when(~open_, F.col("label")).alias("__l"), F.when(open_, F.struct(F.col("dst").alias("target_id"), "dep_kind")).alias("__t"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    direct = known.repartition(n, "node").groupBy("node").agg(F.max("__l").alias("__l"), F.array_sort(F.collect_set("__t")).alias("left"))
    first = F.filter("left", lambda x, i: (i == 0) | (F.get("left", i - 1)["target_id"] != x["target_id"]))  # a target's least kind
    waits = F.col("label") == 3
    level = F.when(waits, F.greatest("own", F.coalesce("__l", F.lit(0)))).otherwise(F.least("label", F.lit(3))).cast("tinyint")
    left = F.when(waits & F.col("left").isNotNull(), F.transform(first, lambda x: F.struct(x["dep_kind"].alias("dep_kind"), x["target_id"].alias("target_id")))).otherwise(F.array().cast("array<struct<dep_kind:string,target_id:string>>"))
    return label.join(direct, "node", "left").select(F.col("node").alias("fn_id"), level.alias("level"), left.alias("left"), (F.col("low") & (F.col("label") != 4)).alias("at_least"))


def resolve(nodes: DataFrame, edges: DataFrame | Dealt, start: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """Final levels ``(fn_id, level, left array<string>, at_least)`` of ``nodes(fn_id, level[, at_least])`` over ``edges(src, dst)``:

    s for all that reach an s; what else reaches a target without a row is unresolved, with the level of itself and its direct
    resolved targets, and keeps missing and unresolved targets; the rest has the greatest level that it reaches. Lower bounds are
    those of ``nodes``, the functions ``unknown`` and all that reach one, unless s. ``start``: further functions that are s, for
    termination."""
    edges = edges if isinstance(edges, Dealt) else dealt(edges.select("src", "dst", F.lit("remote").alias("dep_kind")))
    return _resolved(nodes, edges, start, unknown).withColumn("left", F.transform("left", lambda x: x["target_id"]))


def mark_unknown(results: DataFrame, edges: DataFrame | Dealt, seeds: DataFrame) -> DataFrame:
    """The seeds and all that depend on them are lower bounds, unless s."""
    edges = edges if isinstance(edges, Dealt) else edges.select("src", "dst")
    hit = reach(edges, seeds.select(F.col("fn_id").alias("node"))).select(F.col("node").alias("fn_id"), F.lit(True).alias("__u"))
    out = results.drop("at_least").join(hit, "fn_id", "left")
    return out.withColumn("at_least", F.coalesce("__u", F.lit(False)) & (F.col("level") < 3)).drop("__u")


def _finish(functions: DataFrame, levels: DataFrame, aside: DataFrame) -> DataFrame:
    left = F.transform("left", lambda x: F.struct(x["dep_kind"].alias("dep_kind"), x["target_id"].alias("target_id"), F.lit(None).cast("int").alias("arg_pos")))
    out = functions.drop("level", "at_least").join(levels.select("fn_id", "level", "at_least", F.array_sort(left).cast(NODEPS).alias("deps")), "fn_id")
    return T.restore_arg_deps(out, aside).select("fn_id", "kind", "module", "name", "arity", "level", "at_least", "deps")


def _prepare(functions: DataFrame, deps: DataFrame, dep_args: DataFrame, rules: DataFrame, mode: str):
    spark = functions.sparkSession
    rules = rules if mode == "effects" else T.rectify(rules)
    functions = T.initialise(functions)
    functions, deps = T.add_builtins(functions, deps, dep_args, rules)
    pre = T.predefined(spark, mode)
    functions = bucketed(T.upsert(functions, pre.select(*functions.columns)), "fn_id")
    unfolded, unknown = unfold_hofs(deps, dep_args)
    deps = deps if unfolded is deps else cut(unfolded)
    own, aside = T.strip_arg_deps(deps)
    edges = dealt(T.targets(own).select(F.col("fn_id").alias("src"), F.col("target_id").alias("dst"), "dep_kind"))
    return functions, cut(unknown), aside, edges


@tidy
def propagate_effects(functions: DataFrame, deps: DataFrame, dep_args: DataFrame, rules: DataFrame) -> DataFrame:
    """``results``: every function's level, whether it is a lower bound, and the dependencies that remain."""
    functions, unknown, aside, edges = _prepare(functions, deps, dep_args, rules, "effects")
    return _finish(functions, _resolved(functions, edges, None, unknown), aside)


@tidy
def propagate_termination(functions: DataFrame, deps: DataFrame, dep_args: DataFrame, rules: DataFrame) -> DataFrame:
    """S for what may run forever: it reaches an infinite receive, a self-call that doesn't shrink, or a cycle."""
    calls = deps
    functions, unknown, aside, edges = _prepare(functions.withColumn("level", F.lit(0).cast("tinyint")), deps, dep_args, rules, "termination")
    start = mark_recursive(calls, dep_args).unionByName(cyclic(edges.table.select("src", "dst").distinct()).select(F.col("node").alias("fn_id")))
    return _finish(functions, _resolved(functions, edges, start.distinct(), unknown), aside)


def propagate(functions: DataFrame, deps: DataFrame, dep_args: DataFrame, rules: DataFrame, mode: str = "effects") -> DataFrame:
    """D3: effects, termination, or both united."""
    if mode == "both":
        return T.unite(propagate_effects(functions, deps, dep_args, rules), propagate_termination(functions, deps, dep_args, rules))
    return {"effects": propagate_effects, "termination": propagate_termination}[mode](functions, deps, dep_args, rules)
