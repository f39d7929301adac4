"""The persisted store: round trip, incremental analysis equal to a whole one, exports, listing and report."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewater.functions import levels as L
from tidewater.operators import tables as T
from tidewater.sources import facts, store

NODEPS = "array<struct<dep_kind:string,target_id:string,arg_pos:int>>"
#: Built-ins: level and whether it is a lower bound.
RULES = {"sys:add/2": (1, False), "sys:put/2": (3, False), "sys:get/1": (2, False), "sys:unsure/0": (0, True)}


def world(spark, version=0):
    """Four modules. a holds higher-order functions, b uses them, c is apart but for a missing function, d depends on b and c.
    Version 1 changes a: one of its functions gets an effect, and it now has the function that c and d miss."""
    deps, args = [], []

    def call(fn, target, *passed):
        k = sum(d[0] == fn for d in deps)
        deps.append((fn, k, "remote", target, None, None))
        args.extend((fn, k, target, *p) for p in passed)

    fns = ["a:map/2", "a:id/1", "a:twice/2", "b:inc/1", "b:all/1", "b:loop/1", "b:own/1", "c:far/0", "c:pure/0", "d:top/0", "d:calm/0", "d:holds/0"]
    deps.append(("a:map/2", 0, "arg", None, 1, None))
    call("a:map/2", "a:map/2", ("arg", 1, 1, None, None), ("sub", 2, None, None, None))
    call("a:twice/2", "a:map/2", ("arg", 1, 1, None, None))
    call("a:id/1", "sys:add/2")
    call("b:inc/1", "sys:put/2" if version == 2 else "sys:get/1")
    call("b:all/1", "a:map/2", ("fn", 1, None, "b:inc/1", None))
    call("b:loop/1", "b:loop/1")
    call("b:own/1", "a:twice/2", ("arg", 1, 1, None, None))
    call("c:far/0", "a:later/0")
    call("d:top/0", "b:all/1")
    call("d:top/0", "c:far/0")
    call("d:calm/0", "c:pure/0")
    call("d:calm/0", "sys:unsure/0")
    call("d:holds/0", "b:own/1", ("fn", 1, None, "a:id/1", None))
    call("d:holds/0", "b:loop/1")
    if version == 1:
        fns.append("a:later/0")
        call("a:later/0", "sys:add/2")
        call("a:id/1", "sys:put/2")
    f = [(x, "mfa", x.split(":")[0], x.split(":")[1].split("/")[0], int(x[-1]), None, None) for x in fns]
    return spark.createDataFrame(f, L.FUNCTIONS), spark.createDataFrame(deps, L.DEPS), spark.createDataFrame(args, L.DEP_ARGS)


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(k, "mfa", k.split(":")[0], k.split(":")[1][:-2], int(k[-1]), n, low) for k, (n, low) in RULES.items()]
    return spark.createDataFrame(rows, L.FUNCTIONS).withColumn("deps", F.array().cast(NODEPS))


def stored(spark, rules, version=0):
    functions, deps, args = world(spark, version)
    sums = spark.createDataFrame([(f"src/{m}", m, f"{m}0") for m in "abcd"], "path string, module string, md5 string")
    plain = store.PersistedTables(sums, functions, deps, args, spark.createDataFrame([], "option_key string"))
    results = [store.analyse(plain, rules, m).withColumn("option_key", F.lit(m)) for m in ("effects", "termination")]
    plain.results = results[0].unionByName(results[1])
    return plain


def text(results):
    return dict(results.select("fn_id", L.fmt_result()).collect())


@pytest.mark.parametrize(("version", "module"), [(1, "a"), (2, "b")])
def test_warm_equals_cold(spark, rules, version, module):
    old = stored(spark, rules)
    functions, deps, args = world(spark, version)
    own = functions.where(F.col("module") == module)
    part = lambda df: df.join(own.select("fn_id"), "fn_id", "left_semi")
    changed, none = spark.createDataFrame([(module,)], "module string"), spark.createDataFrame([], "module string")
    new, again = store.analyse_changed(old, changed, none, own, part(deps), part(args))
    assert {r.module for r in again.collect()} == {"a": {"a", "b", "d"}, "b": {"b", "d"}}[module]
    for mode in ("effects", "termination", "both"):
        cold = text(store.analyse(store.PersistedTables(None, functions, deps, args, None), rules, mode))
        warm = text(store.analyse(new, rules, mode, again))
        assert {k: v for k, v in warm.items() if k in cold} == cold and all(k.startswith("sys:") for k in warm.keys() - cold.keys()), mode
    assert cold["d:calm/0"] == ">= p" and cold["b:loop/1"] == "s"


def test_errors_take_modules_out(spark, rules):
    old = stored(spark, rules)
    functions, deps, args = world(spark)
    errors, none = spark.createDataFrame([("c",)], "module string"), spark.createDataFrame([], "module string")
    new, again = store.analyse_changed(old, none, errors, functions.limit(0), deps.limit(0), args.limit(0))
    assert {r.module for r in again.collect()} == {"d"}
    assert {r.module for r in new.functions.collect()} == {"a", "b", "d"} and "c" not in {r.module for r in new.checksums.collect()}
    assert not {r.module for r in new.results.collect()} & {"c", "d"}


def test_round_trip_and_manifests(spark, rules, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.PersistedTables.load(spark, path)
    first = stored(spark, rules)
    first.save(path)
    back = store.PersistedTables.load(spark, path)
    for name in first.TABLES:
        cols = getattr(first, name).columns
        assert sorted(map(str, getattr(back, name).select(*cols).collect())) == sorted(map(str, getattr(first, name).collect())), name
    back.functions = back.functions.where("module <> 'd'")
    back.save(path)
    assert {r.module for r in store.PersistedTables.load(spark, path).functions.collect()} == {"a", "b", "c"}
    newest = sorted(tmp_path.glob("store/manifest-*"))[-1]
    rows = spark.read.schema(store.MANIFEST).json(str(newest))
    rows.withColumn("version", F.lit(99)).coalesce(1).write.json(str(newest.with_name(newest.name.replace("manifest-", "manifest-9"))))
    with pytest.raises(ValueError, match="version"):
        store.PersistedTables.load(spark, path)


def simple(spark, functions, sums, options=("effects",), low=()):
    """A store of functions ``module:name/0`` without deps; termination lacks ``low``."""
    f = spark.createDataFrame([(x, "mfa", x.split(":")[0], x.split(":")[1][:-2], 0, 0, False) for x in functions], L.FUNCTIONS)
    r = f.withColumn("deps", F.array().cast(NODEPS)).withColumn("option_key", F.explode(F.array(*map(F.lit, options)))).where(~(F.col("option_key").eqNullSafe("termination") & F.col("fn_id").isin(*low, "")))
    deps = f.select("fn_id", F.lit(0).cast("long").alias("call_id"), F.lit("remote").alias("dep_kind"), F.concat("fn_id", F.lit("+")).alias("target_id"), F.lit(None).cast("int").alias("arg_pos"), F.lit(None).cast("string").alias("var"))
    return store.PersistedTables(spark.createDataFrame(sums, "path string, module string, md5 string"), f, deps, spark.createDataFrame([], L.DEP_ARGS), r)


def test_update_removes_what_is_gone(spark):
    """m loses b, n's file is broken, p stays; new results that lack a function are refused."""
    old = simple(spark, ["m:a/0", "m:b/0", "n:x/0", "p:y/0"], [("m", "m", "1"), ("n", "n", "1"), ("p", "p", "1")], ("effects", "termination", "both"), ["p:y/0"])
    new = simple(spark, ["m:a/0"], [("m", "m", "2"), ("n", "n", None)])
    got = store.update(old, new.checksums, new.functions, new.deps, new.dep_args, new.results)
    ids = lambda df: sorted(r.fn_id for r in df.collect())
    assert ids(got.functions) == ids(got.deps) == ["m:a/0", "p:y/0"]
    assert ids(got.results.where("option_key = 'effects'")) == ["m:a/0", "p:y/0"]
    assert ids(got.results.where("option_key = 'both'")) == ["m:a/0", "m:b/0", "p:y/0"] and not ids(got.results.where("option_key = 'termination'"))
    assert {tuple(r) for r in got.checksums.select("path", "md5").collect()} == {("m", "2"), ("n", "1"), ("p", "1")}
    with pytest.raises(store.InconsistentTables):
        store.update(old, new.checksums, new.functions, new.deps, new.dep_args, new.results.limit(0))


def test_update_writes_the_changed_part_only(spark, tmp_path):
    path = str(tmp_path / "store")
    names = [f"m{i}:f{k}/0" for i in range(12) for k in range(3)]
    simple(spark, names, [(f"m{i}", f"m{i}", "1") for i in range(12)], ("effects", "both")).save(path)
    before = {(r.table, r.option, r.part): r.folder for r in store.manifest(spark, path) if r.folder}
    new = simple(spark, ["m3:f0/0"], [("m3", "m3", "2")])
    store.update_saved(spark, path, new.checksums, new.functions, new.deps, new.dep_args, new.results)
    after = {(r.table, r.option, r.part): r.folder for r in store.manifest(spark, path) if r.folder}
    own = spark.range(1).select(store._part(F.lit("m3"))).first()[0]
    assert before.keys() == after.keys() and {k[2] for k in before if before[k] != after[k]} == {own}
    got = store.PersistedTables.load(spark, path)
    assert sorted(r.fn_id for r in got.functions.collect()) == sorted(n for n in names if not n.startswith("m3:") or n == "m3:f0/0")
    assert got.results.where("option_key = 'both'").count() == 36 and got.results.where("option_key = 'effects'").count() == 34


def test_update_keeps_whole_results_only(spark, rules):
    old = stored(spark, rules)
    functions, deps, args = world(spark, 1)
    own = functions.where("module = 'a'")
    part = lambda df: df.join(own.select("fn_id"), "fn_id", "left_semi")
    fresh = store.analyse(store.PersistedTables(None, functions, deps, args, None), rules).withColumn("option_key", F.lit("effects"))
    files = spark.createDataFrame([("src/a", "a", "a1"), ("src/x", "x", None)], "path string, module string, md5 string")
    new = store.update(old, files, own, part(deps), part(args), fresh)
    assert {r.option_key for r in new.results.select("option_key").distinct().collect()} == {"effects"}  # termination lacks a:later/0
    assert text(new.results) == text(fresh)
    assert dict(new.checksums.select("path", "md5").collect()) == {"src/a": "a1", "src/b": "b0", "src/c": "c0", "src/d": "d0"}
    assert "a:later/0" in {r.fn_id for r in new.functions.collect()} and new.deps.where("fn_id = 'a:id/1'").count() == 2


def test_export_listing_and_report(spark, rules, tmp_path):
    s = stored(spark, rules)
    lines = [(r.section, r.value) for r in store.export_text(s).collect()]
    assert lines[0] == (0, "version 2") and lines[1][1] == "src/a a0" and [x[0] for x in lines] == sorted(x[0] for x in lines)
    table = [v for k, v in lines if k == 2]
    assert len(table) == 12 and table == sorted(table) and table[0] == "a:id/1 sys:add/2"
    effects = s.results.where("option_key = 'effects' AND kind = 'mfa'")
    rows = sorted(effects.collect(), key=lambda r: (r.module, r.name, r.arity))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several parts
    try:
        T.write_listing(effects, str(tmp_path / "list"))
        T.write_stats(T.stats(effects), str(tmp_path / "stats"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = lambda name: "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))).splitlines()
    assert len(list((tmp_path / "list").glob("part-*"))) > 3 and len(list((tmp_path / "stats").glob("part-*"))) > 3
    got = whole("list")
    assert [x.split(" ")[0] for x in got] == [r.fn_id for r in rows] and "a:map/2 p [1]." in got and all(x.endswith(".") for x in got)
    assert [(r["rank"], r["value"]) for r in T.read_lines(spark, str(tmp_path / "list")).orderBy("rank").collect()] == list(enumerate(got, 1))
    got = whole("stats")
    assert got[0] == "module,p,e,d,s,hofs,limited,undefined,total,pct_pure" and got[-1].startswith("5 modules,") and sum("modules" in x or x.startswith("module,") for x in got) == 2
    assert len(got) == 7 and [float(x.split(",")[-1]) for x in got[1:-1]] == sorted(float(x.split(",")[-1]) for x in got[1:-1])
    assert [(r["rank"], r["value"]) for r in T.in_order(T.listing(effects)).orderBy("rank").collect()] == list(enumerate(whole("list"), 1))


def test_names_in_gaps(spark):
    """Each child gets the next number that isn't reserved for its own parent; foreign and odd names don't count."""
    nested = [("m", p, a, i) for p, a, n in (("f", 0, 6), ("f", 1, 3), ("g_2-1", 2, 4)) for i in range(n)] + [("other", "f", 0, 1)]
    taken = [("m", x) for x in ("f_0-1", "f_0-3", "f_0-4", "f_0-9", "f_0-03", "f_1-2", "f_00-1", "g_2-1_2-1", "f_0-", "f_0-1x", "f_0-99999999999999999999999")] + [("other", "f_1-1"), (None, "f_0-1")]
    got = T.name_nested(spark.createDataFrame(nested, "module string, parent string, arity int, seq int"), spark.createDataFrame([*taken, taken[0]], "module string, name string"))
    used, want = set(taken), set()
    for m, p, a in dict.fromkeys(x[:3] for x in nested):
        free = (n for n in range(1, 99) if (m, f"{p}_{a}-{n}") not in used)
        want |= {(m, p, a, i, f"{p}_{a}-{next(free)}") for i in sorted(x[3] for x in nested if x[:3] == (m, p, a))}
    assert {tuple(r) for r in got.collect()} == want


def test_facts_and_files(spark, tmp_path):
    functions, deps, args = world(spark)
    for name, df in (("functions", functions), ("deps", deps), ("dep_args", args)):
        df.write.parquet(str(tmp_path / "facts" / name))
    back = facts.load_facts(spark, str(tmp_path / "facts"))
    assert [df.count() for df in back] == [functions.count(), deps.count(), args.count()] and back[0].columns == functions.columns
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "one.src").write_text("one")
    (tmp_path / "src" / "deep" / "two.src").write_text("two")
    (tmp_path / "src" / "no.txt").write_text("no")
    got = {r.module: r.md5 for r in facts.discover(spark, str(tmp_path / "src"), "*.src").collect()}
    assert got == {k: hashlib.md5(k.encode()).hexdigest() for k in ("one", "two")}
    good, broken = facts.separate(spark.createDataFrame([("a", "x"), ("b", None)], "path string, md5 string"))
    assert good.first().path == "a" and broken.first().path == "b"


def test_set_operators(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(None, "q"), (3, "q"), (3, "r")], "k int, v string")
    assert [r.k for r in T.subtract(a, b, ["k"]).collect()] == [1, 1]
    assert sorted(str(r.k) for r in T.intersect(a, b, ["k"]).collect()) == ["3", "None"]
    assert T.union(a, a).count() == 3
    sets = spark.createDataFrame([("f", 1, 1), ("f", 1, 2), ("f", 2, 2), ("g", 1, 7)], "fn string, call int, pos int")
    assert sorted(map(tuple, T.in_all(sets, ["fn"], "call", "pos").collect())) == [("f", 2), ("g", 7)]
