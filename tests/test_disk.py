"""What propagation leaves on disk and how often it shuffles its edges."""

import time

from pyspark.sql import functions as F

from tidewater.functions import levels as L
from tidewater.operators import graph
from tidewater.operators import propagate as P
from tidewater.runtime import bucketed, counted, staged


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).agg(F.count("*").alias("n"))
    made = staged(df), counted(df), bucketed(df, "k")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [t.count() for t in made] == [999] * 3


def test_targets_labels_meet_edges_without_a_shuffle_of_edges(spark):
    edges = graph.dealt(spark.range(1000).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), F.col("id") % 100).alias("dst")))
    nodes = counted(spark.range(100).select(F.concat(F.lit("b"), "id").alias("node"), "id"))
    met = edges.meet(nodes)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 1000
    assert plan.count("Exchange") == 1, plan


def test_hubs_in_parts_give_the_same_results(spark, monkeypatch):
    names = [f"m:f{i}/0" for i in range(60)]
    f = spark.createDataFrame([(n, "mfa", "m", n, 0, i % 4 if i > 50 else 0, i == 40) for i, n in enumerate(names)], L.FUNCTIONS)
    calls = [(n, 0, "remote" if i % 2 else "local", names[j], None, None) for i, n in enumerate(names) for j in {45, 51, (i * 7 + 3) % 60} if j != i and (i % 3 or j < 46)]
    deps = spark.createDataFrame([*calls, *calls, (names[9], 0, "remote", "m:gone/0", None, None)], L.DEPS)
    none, rules = spark.createDataFrame([], L.DEP_ARGS), spark.createDataFrame([], L.RULES)
    want = sorted(P.propagate_effects(f, deps, none, rules).collect())
    assert len(want) == 63
    monkeypatch.setattr(graph, "HUB", 4)
    assert sorted(P.propagate_effects(f, deps, none, rules).collect()) == want


def test_a_saved_store_leaves_no_shuffle_files(spark, tmp_path):
    from tidewater.sources.store import PersistedTables

    functions = spark.range(500).select(F.concat(F.lit("m:f"), "id").alias("fn_id"), F.lit("mfa").alias("kind"), F.concat(F.lit("m"), F.col("id") % 9).alias("module"), F.lit("f").alias("name"), F.lit(0).alias("arity"), F.lit(0).cast("tinyint").alias("level"), F.lit(False).alias("at_least"))
    deps = functions.select("fn_id", F.lit(0).cast("long").alias("call_id"), F.lit("remote").alias("dep_kind"), F.lit("m:f1").alias("target_id"), F.lit(None).cast("int").alias("arg_pos"), F.lit(None).cast("string").alias("var"))
    sums = functions.select("module").distinct().select(F.col("module").alias("path"), "module", F.lit("x").alias("md5"))
    results = functions.withColumn("deps", F.array().cast(P.NODEPS)).withColumn("option_key", F.lit("effects"))
    before = shuffle_files(spark)
    PersistedTables(staged(sums), functions, deps, spark.createDataFrame([], L.DEP_ARGS), results).save(f"file://{tmp_path}/store")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    loaded = PersistedTables.load(spark, f"file://{tmp_path}/store")
    assert [loaded.functions.count(), loaded.deps.count(), loaded.dep_args.count(), loaded.results.count(), loaded.checksums.count()] == [500, 500, 0, 500, 9]


def test_modules_dependents_shuffle_edges_once(spark):
    from tidewater.operators import tables as T

    functions = spark.range(90).select(F.concat(F.lit("f"), "id").alias("fn_id"), F.concat(F.lit("m"), F.col("id") % 3).alias("module"))
    deps = spark.range(90).select(F.concat(F.lit("f"), "id").alias("fn_id"), F.lit("remote").alias("dep_kind"), F.concat(F.lit("f"), (F.col("id") * 7 + 1) % 90).alias("target_id"))
    none = spark.createDataFrame([], L.DEP_ARGS)
    out = T.module_rmap(functions, deps, none)
    want = {(f"m{(i * 7 + 1) % 90 % 3}", f"m{i % 3}") for i in range(90) if (i * 7 + 1) % 90 % 3 != i % 3}
    assert {tuple(r) for r in out.collect()} == want
    assert "passed_id" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "dep_kind" not in plan, plan  # edges were read before
