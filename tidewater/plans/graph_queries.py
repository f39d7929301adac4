"""Queries over the driver tables: supply graph (customer, order, part, supplier), part graph (cyclic), calls with passed
parts, and documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions import levels as L
from tidewater.operators import calls as J
from tidewater.operators import components as C
from tidewater.operators import propagate as P
from tidewater.operators import tables as T
from tidewater.operators.graph import dealt, reach, weak_components
from tidewater.sources import facts, store
from tidewater.runtime import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _fn(df: DataFrame, prefix: str, key: str, module, level=None, at_least=None) -> DataFrame:
    own = F.concat(F.lit(prefix), F.col(key).cast("string"))
    return df.select(own.alias("fn_id"), F.lit("mfa").alias("kind"), F.col(module).cast("string").alias("module") if isinstance(module, str) else module.alias("module"), own.alias("name"), F.lit(0).alias("arity"), (F.lit(0) if level is None else level).cast("tinyint").alias("level"), (F.lit(False) if at_least is None else at_least).alias("at_least"))


def supply(spark, d: str):
    """functions, deps (one for each line, repeats as well), dep_args (none), rules (suppliers; one in fifty is missing)."""
    part_level = F.when((F.col("p_size") == 1) & (F.col("p_type") == "PROMO"), 3).when(F.col("p_size").isin(2, 3), 2).when(F.col("p_size").between(4, 9), 1).otherwise(0)
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    f = _fn(_t(spark, d, "customer"), "c:", "c_custkey", "c_mktsegment").unionByName(_fn(_t(spark, d, "orders"), "o:", "o_orderkey", "o_orderpriority")).unionByName(_fn(_t(spark, d, "part"), "p:", "p_partkey", "p_brand", part_level))
    rules = _fn(_t(spark, d, "supplier").where("s_suppkey % 50 <> 7"), "s:", "s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), None, F.col("s_suppkey") % 20 == 3).withColumn("deps", F.array().cast(P.NODEPS))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = _t(spark, d, "orders").select(key("c:", "o_custkey").alias("fn_id"), key("o:", "o_orderkey").alias("target_id"))
    e = e.unionByName(lines.select(key("o:", "l_orderkey").alias("fn_id"), key("p:", "l_partkey").alias("target_id")))
    e = e.unionByName(lines.select(key("p:", "l_partkey").alias("fn_id"), key("s:", "l_suppkey").alias("target_id")))
    deps = e.select("fn_id", F.lit(0).cast("bigint").alias("call_id"), F.lit("remote").alias("dep_kind"), "target_id", F.lit(None).cast("int").alias("arg_pos"), F.lit(None).cast("string").alias("var"))
    return f, deps, spark.createDataFrame([], L.DEP_ARGS), rules


def labels(column: str = "deps"):
    return F.array_join(F.array_sort(F.transform(column, L.dep_label)), ",")


def supply_results(spark, d: str) -> DataFrame:
    return P.propagate_effects(*supply(spark, d)).where("kind = 'mfa'")


def all_edges(spark, d: str) -> DataFrame:
    """Cyclic: from each part of an order's lines to the next one."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    e = _t(spark, d, "lineitem").select("l_partkey", F.lead("l_partkey").over(w).alias("next"))
    return e.where("l_partkey <> next").select(F.col("l_partkey").alias("src"), F.col("next").alias("dst")).distinct()


def part_edges(spark, d: str) -> DataFrame:
    """Those within a brand (calls inside of a module): many small components, some of which nothing leaves."""
    brand = _t(spark, d, "part").select("p_partkey", "p_brand")
    e = all_edges(spark, d).join(brand.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("a")), "src")
    return e.join(brand.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("b")), "dst").where("a = b").select("src", "dst")


def call_facts(spark, d: str):
    """Suppliers take functions at positions 1 (and 2, if even); orders call them and pass parts, or hand on own arguments."""
    hof = _t(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("fn_id"), F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("arg_pos"))
    lines = _t(spark, d, "lineitem")
    base = lines.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("fn_id"), F.col("l_suppkey").alias("call_id"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("target_id"), ((F.col("l_linenumber") - 1) % 2 + 1).cast("int").alias("pos"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("part"), "l_quantity", (F.col("l_linenumber") % 3 + 1).cast("int").alias("own"))
    fn = F.col("l_quantity") < 40
    args = base.select("fn_id", "call_id", "target_id", F.when(fn, "fn").otherwise("arg").alias("kind"), "pos", F.when(~fn, F.col("own")).alias("from_pos"), F.when(fn, F.col("part")).alias("passed_id"), F.lit(None).cast("string").alias("var")).distinct()
    none = lambda k: F.lit(None).cast(k)
    deps = base.select("fn_id", "call_id", F.lit("remote").alias("dep_kind"), "target_id", none("int").alias("arg_pos"), none("string").alias("var")).distinct()
    deps = deps.unionByName(hof.select("fn_id", F.lit(0).cast("bigint").alias("call_id"), F.lit("arg").alias("dep_kind"), none("string").alias("target_id"), "arg_pos", none("string").alias("var")))
    return deps, args


#: The same projections in SQL.
SUPPLY = """
f0 AS (SELECT 'c:' || c_custkey AS fn_id, c_mktsegment AS module, 0 AS level, FALSE AS bound FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, o_orderpriority, 0, FALSE FROM orders
  UNION ALL SELECT 'p:' || p_partkey, p_brand, CASE WHEN p_size = 1 AND p_type = 'PROMO' THEN 3 WHEN p_size IN (2, 3) THEN 2 WHEN p_size BETWEEN 4 AND 9 THEN 1 ELSE 0 END, FALSE FROM part),
e AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders
  UNION SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem),
f AS (SELECT * FROM f0 UNION ALL SELECT 's:' || s_suppkey, 'n' || s_nationkey, 0, s_suppkey % 20 = 3 FROM supplier WHERE s_suppkey % 50 <> 7 AND 's:' || s_suppkey IN (SELECT dst FROM e))
"""
REACHED = SUPPLY + """,
rs(n) AS (SELECT fn_id FROM f WHERE level = 3 UNION SELECT src FROM e JOIN rs ON dst = n),
ru(n) AS (SELECT src FROM e WHERE dst NOT IN (SELECT fn_id FROM f) UNION SELECT src FROM e JOIN ru ON dst = n),
r2(n) AS (SELECT fn_id FROM f WHERE level = 2 UNION SELECT src FROM e JOIN r2 ON dst = n),
r1(n) AS (SELECT fn_id FROM f WHERE level = 1 UNION SELECT src FROM e JOIN r1 ON dst = n),
ra(n) AS (SELECT fn_id FROM f WHERE bound UNION SELECT src FROM e JOIN ra ON dst = n),
k AS (SELECT fn_id, module, level, fn_id IN (SELECT n FROM rs) AS s, fn_id IN (SELECT n FROM ru) AND fn_id NOT IN (SELECT n FROM rs) AS open,
      CASE WHEN fn_id IN (SELECT n FROM rs) THEN 3 WHEN fn_id IN (SELECT n FROM r2) THEN 2 WHEN fn_id IN (SELECT n FROM r1) THEN 1 ELSE 0 END AS high, fn_id IN (SELECT n FROM ra) AS low FROM f),
u AS (SELECT src, max(CASE WHEN NOT t.open THEN t.high END) AS up, string_agg(CASE WHEN t.fn_id IS NULL OR t.open THEN dst END, ',' ORDER BY dst) AS deps
      FROM e LEFT JOIN k t ON dst = t.fn_id GROUP BY src),
r AS (SELECT fn_id, module, CAST(CASE WHEN open THEN greatest(level, coalesce(up, 0)) ELSE high END AS TINYINT) AS level, low AND NOT s AS at_least,
      CASE WHEN open THEN coalesce(deps, '') ELSE '' END AS deps FROM k LEFT JOIN u ON fn_id = src)
"""
PART = """
l AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem),
e AS (SELECT DISTINCT a, b FROM l JOIN part p ON a = p.p_partkey JOIN part q ON b = q.p_partkey WHERE a <> b AND p.p_brand = q.p_brand), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
"""
LOCAL = " JOIN part p ON a = p.p_partkey JOIN part q ON b = q.p_partkey WHERE a <> b AND p.p_brand = q.p_brand"
PARTCOMP = PART + ", comp AS (SELECT x AS node, least(x, coalesce(m, x)) AS component FROM n LEFT JOIN (SELECT p.a AS x, min(p.b) AS m FROM c p JOIN c q ON p.a = q.b AND p.b = q.a GROUP BY 1) USING (x))"
WR = "WITH RECURSIVE " + REACHED
WS = "WITH " + SUPPLY
DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS path, source AS module, md5(text) AS md5 FROM documents)"


@query("d1_effects", WR + "SELECT fn_id, level, at_least, deps FROM r")
def d1(spark, d):
    return supply_results(spark, d).select("fn_id", "level", "at_least", labels().alias("deps"))


@query("e2_stats", WR + """, c AS (SELECT module, CASE WHEN at_least AND deps = '' THEN 'limited' WHEN deps <> '' THEN 'undefined' ELSE ['p', 'e', 'd', 's'][level + 1] END AS class FROM r)
SELECT module, count(*) FILTER (class = 'p') AS p, count(*) FILTER (class = 'e') AS e, count(*) FILTER (class = 'd') AS d, count(*) FILTER (class = 's') AS s, 0::BIGINT AS hofs,
count(*) FILTER (class = 'limited') AS limited, count(*) FILTER (class = 'undefined') AS undefined, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (class = 'p') / count(*) AS pct_pure FROM c GROUP BY module""")
def e2(spark, d):
    return T.stats(supply_results(spark, d))


@query("e3_stats_total", WR + """, c AS (SELECT module, CASE WHEN at_least AND deps = '' THEN 'limited' WHEN deps <> '' THEN 'undefined' ELSE ['p', 'e', 'd', 's'][level + 1] END AS class FROM r)
SELECT count(DISTINCT module) AS modules, count(*) FILTER (class = 'p') AS p, count(*) FILTER (class = 's') AS s, count(*) FILTER (class = 'undefined') AS undefined, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (class = 'p') / count(*) AS pct_p FROM c""")
def e3(spark, d):
    return T.stats_total(T.stats(supply_results(spark, d))).select("modules", "p", "s", "undefined", "total", "pct_p")


@query("i2_result_text", WR + "SELECT fn_id, (CASE WHEN at_least THEN '>= ' ELSE '' END) || ['p', 'e', 'd', 's'][level + 1] || (CASE WHEN deps = '' THEN '' ELSE ' [' || replace(deps, ',', ', ') || ']' END) AS result FROM r")
def i2(spark, d):
    return supply_results(spark, d).select("fn_id", L.fmt_result().alias("result"))


@query("b13_map_to_level", WR + "SELECT fn_id, level < 3 AS clean1, level < 2 AS clean2, level < 1 AS clean3, at_least OR deps <> '' AS bound FROM r")
def b13(spark, d):
    return T.bounded_level_of(supply_results(spark, d)).select("fn_id", *[L.map_to_level("level", n).alias(f"clean{n}") for n in (1, 2, 3)], F.col("at_least").alias("bound"))


@query("b8_is_pure", WR + "SELECT 's:' || s_suppkey AS fn_id, coalesce(level = 0 AND NOT at_least AND deps = '', FALSE) AS pure FROM supplier LEFT JOIN r ON fn_id = 's:' || s_suppkey")
def b8(spark, d):
    return T.is_pure(supply_results(spark, d), _t(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("fn_id")))


@query("d9_mark_unknown", WR + "SELECT fn_id, level, at_least FROM r")
def d9(spark, d):
    f, deps, args, rules = supply(spark, d)
    f, deps = T.add_builtins(f, deps, args, rules)
    edges = dealt(deps.where(F.col("dep_kind").isin(*T.CALLS)).select(F.col("fn_id").alias("src"), F.col("target_id").alias("dst"), "dep_kind"))
    levels = P.resolve(f, edges)
    return P.mark_unknown(levels, edges, f.where("at_least").select("fn_id")).select("fn_id", "level", "at_least")


@query("b6_leaves", WS + "SELECT fn_id FROM f0 WHERE fn_id NOT IN (SELECT src FROM e)")
def b6(spark, d):
    f, deps, _, _ = supply(spark, d)
    return T.leaves(f, deps).select("fn_id")


@query("c1_add_builtins", WS + "SELECT fn_id, module, CAST(level AS TINYINT) AS level, bound AS at_least FROM f")
def c1(spark, d):
    return T.add_builtins(*supply(spark, d))[0].select("fn_id", "module", "level", "at_least")


@query("c2_function_rmap", WS + "SELECT dst AS target_id, string_agg(src, ',' ORDER BY src) AS dependents FROM e GROUP BY dst")
def c2(spark, d):
    _, deps, args, _ = supply(spark, d)
    return T.function_rmap(deps, args).withColumn("dependents", F.array_join("dependents", ","))


@query("c3_module_rmap", WS + "SELECT DISTINCT b.module, a.module AS dependent FROM e JOIN f a ON src = a.fn_id JOIN f b ON dst = b.fn_id WHERE a.module <> b.module")
def c3(spark, d):
    f, deps, args, rules = supply(spark, d)
    return T.module_rmap(T.add_builtins(f, deps, args, rules)[0], deps, args)


@query("c4_missing", WS + "SELECT DISTINCT dst AS fn_id, 'mfa' AS kind FROM e WHERE dst NOT IN (SELECT fn_id FROM f)")
def c4(spark, d):
    f, deps, args, rules = supply(spark, d)
    return T.find_missing(T.add_builtins(f, deps, args, rules)[0], deps, args)


@query("c5_missing_modules", WS + "SELECT DISTINCT split_part(dst, ':', 1) AS module FROM e WHERE dst NOT IN (SELECT fn_id FROM f)")
def c5(spark, d):
    return T.missing_modules(c4(spark, d))


@query("e6_missing_counts", WS + "SELECT 'mfa' AS kind, count(DISTINCT dst) AS n FROM e WHERE dst NOT IN (SELECT fn_id FROM f) HAVING count(*) > 0")
def e6(spark, d):
    return T.missing_counts(c4(spark, d))


@query("b4_delete_modules", WS + "SELECT fn_id, module FROM f0 WHERE module NOT IN (SELECT r_name FROM region UNION SELECT 'BUILDING' UNION SELECT 'Brand#11')")
def b4(spark, d):
    gone = _t(spark, d, "region").select(F.col("r_name").alias("module")).unionByName(spark.createDataFrame([("BUILDING",), ("Brand#11",)], "module string"))
    return T.delete_modules(supply(spark, d)[0], gone).select("fn_id", "module")


@query("b5_only_modules", WS + "SELECT fn_id, module FROM f0 WHERE module IN (SELECT DISTINCT p_brand FROM part WHERE p_size < 4)")
def b5(spark, d):
    return T.only_modules(supply(spark, d)[0], _t(spark, d, "part").where("p_size < 4").select(F.col("p_brand").alias("module"))).select("fn_id", "module")


@query("e5_all_modules", WS + "SELECT DISTINCT module FROM f0")
def e5(spark, d):
    return T.all_modules(supply(spark, d)[0])


@query("e7_to_wide", WS + "SELECT src AS fn_id, string_agg(dst, ',' ORDER BY dst) AS deps FROM e GROUP BY src")
def e7(spark, d):
    return T.to_wide(supply(spark, d)[1]).select("fn_id", labels().alias("deps"))


@query("c11_add_dependencies", WR + "SELECT fn_id, level FROM r WHERE fn_id IN (SELECT dst FROM e JOIN f0 ON src = fn_id WHERE module = 'BUILDING')")
def c11(spark, d):
    f, deps, args, _ = supply(spark, d)
    own = deps.join(f.where("module = 'BUILDING'").select("fn_id"), "fn_id", "left_semi")
    return T.add_dependencies(own, args, supply_results(spark, d)).select("fn_id", "level")


@query("c12_add_unresolved", WR + "SELECT fn_id FROM r WHERE deps <> '' OR fn_id IN (SELECT dst FROM e JOIN f0 ON src = fn_id WHERE module = 'BUILDING')")
def c12(spark, d):
    f, deps, args, _ = supply(spark, d)
    results = cut(supply_results(spark, d))
    own = deps.join(f.where("module = 'BUILDING'").select("fn_id"), "fn_id", "left_semi")
    return T.add_unresolved(T.add_dependencies(own, args, results), results, args).select("fn_id")


@query("d10_dependent_modules", "WITH RECURSIVE " + SUPPLY + ", m AS (SELECT DISTINCT b.module AS a, a.module AS b FROM e JOIN f a ON src = a.fn_id JOIN f b ON dst = b.fn_id WHERE a.module <> b.module), t(module) AS (SELECT 'Brand#11' UNION SELECT b FROM m JOIN t ON a = module) SELECT module FROM t")
def d10(spark, d):
    return store.dependent_modules(c3(spark, d), spark.createDataFrame([("Brand#11",)], "module string"))


@query("d3_reach_level2", "WITH RECURSIVE " + SUPPLY + ", t(n) AS (SELECT fn_id FROM f0 WHERE level = 2 UNION SELECT src FROM e JOIN t ON dst = n) SELECT n AS node FROM t")
def d3r(spark, d):
    f, deps, _, _ = supply(spark, d)
    return reach(deps.select(F.col("fn_id").alias("src"), F.col("target_id").alias("dst")), f.where("level = 2").select(F.col("fn_id").alias("node")))


@query("d4_components", "WITH RECURSIVE " + PARTCOMP + " SELECT node, component FROM comp")
def d4(spark, d):
    return C.components(part_edges(spark, d))


@query("d5_independent", "WITH RECURSIVE " + PARTCOMP + """ SELECT node, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1)
AND component NOT IN (SELECT x.component FROM e JOIN comp x ON a = x.node JOIN comp y ON b = y.node WHERE x.component <> y.component)""")
def d5(spark, d):
    return C.independent_components(part_edges(spark, d))


@query("d6_mutual_level", "WITH RECURSIVE " + PARTCOMP + """, v AS (SELECT node, component, p_size % 4 AS level FROM comp JOIN part ON node = p_partkey)
SELECT 'p:' || node AS fn_id, CAST(CASE WHEN count(*) OVER w > 1 THEN max(level) OVER w ELSE level END AS TINYINT) AS level FROM v WINDOW w AS (PARTITION BY component)""")
def d6(spark, d, edges=part_edges):
    comp = cut(C.components(edges(spark, d)))
    large = comp.groupBy("component").count().where("count > 1").select("component")
    r = comp.join(_t(spark, d, "part"), comp.node == F.col("p_partkey")).select(F.concat(F.lit("p:"), F.col("node").cast("string")).alias("fn_id"), (F.col("p_size") % 4).cast("tinyint").alias("level"), F.array().cast(P.NODEPS).alias("deps"))
    named = comp.join(large, "component", "left_semi").select(F.concat(F.lit("p:"), F.col("node").cast("string")).alias("node"), "component")
    return T_level(r, named)


def T_level(results: DataFrame, comps: DataFrame) -> DataFrame:
    return C.set_mutual_level(results, comps).select("fn_id", "level")


@query("d7_cyclic", "WITH RECURSIVE " + PART + "SELECT a AS node FROM c WHERE a = b")
def d7(spark, d):
    return C.cyclic(part_edges(spark, d))


@query("d2_termination", "WITH RECURSIVE " + PART + "SELECT 'p:' || x AS fn_id, CAST(CASE WHEN x IN (SELECT c.a FROM c JOIN c z ON c.b = z.a AND z.a = z.b) THEN 3 ELSE 0 END AS TINYINT) AS level FROM n")
def d2(spark, d, edges=part_edges):
    key = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    e = edges(spark, d)
    nodes = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct()
    deps = e.select(key("src").alias("fn_id"), F.lit(0).cast("bigint").alias("call_id"), F.lit("remote").alias("dep_kind"), key("dst").alias("target_id"), F.lit(None).cast("int").alias("arg_pos"), F.lit(None).cast("string").alias("var"))
    rules = supply(spark, d)[3].limit(0)
    out = P.propagate_termination(_fn(nodes, "p:", "src", F.lit("part")), deps, spark.createDataFrame([], L.DEP_ARGS), rules)
    return out.where("kind = 'mfa'").select("fn_id", "level")


@query("d4_weak_components", "WITH RECURSIVE " + PART.replace("SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a", "SELECT a, b FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) UNION SELECT c.a, y.b FROM c JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) y ON c.b = y.a") + "SELECT x AS node, (SELECT min(b) FROM c WHERE a = x) AS root FROM n")
def d4w(spark, d):
    return weak_components(part_edges(spark, d))


QUERIES["d2_termination_all"] = lambda spark, d: d2(spark, d, all_edges)
QUERIES["d4_components_all"] = lambda spark, d: C.components(all_edges(spark, d))
QUERIES["d4_weak_components_all"] = lambda spark, d: weak_components(all_edges(spark, d))
QUERIES["d5_independent_all"] = lambda spark, d: C.independent_components(all_edges(spark, d))
QUERIES["d6_mutual_level_all"] = lambda spark, d: d6(spark, d, all_edges)
QUERIES["d7_cyclic_all"] = lambda spark, d: C.cyclic(all_edges(spark, d))
for _name in ("d2_termination", "d4_components", "d4_weak_components", "d5_independent", "d6_mutual_level", "d7_cyclic"):
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(LOCAL, " WHERE a <> b")


CALLS = """h AS (SELECT 's:' || s_suppkey AS fn_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS pos FROM supplier),
x AS (SELECT DISTINCT 'o:' || l_orderkey AS fn_id, l_suppkey AS call_id, 's:' || l_suppkey AS target_id, (l_linenumber - 1) % 2 + 1 AS pos, CASE WHEN l_quantity < 40 THEN 'p:' || l_partkey END AS passed, CASE WHEN l_quantity >= 40 THEN l_linenumber % 3 + 1 END AS own FROM lineitem),
need AS (SELECT fn_id AS target_id, count(*) AS need FROM h GROUP BY 1),
k AS (SELECT x.fn_id, call_id, x.target_id, need, count(h.pos) FILTER (passed IS NOT NULL) = need AS concrete, count(DISTINCT h.pos) FILTER (own IS NOT NULL) AS covered FROM x JOIN need USING (target_id) LEFT JOIN h ON h.fn_id = x.target_id AND h.pos = x.pos GROUP BY x.fn_id, call_id, x.target_id, need)
"""


@query("b7_higher_order", "WITH " + CALLS + "SELECT fn_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM h GROUP BY fn_id")
def b7(spark, d):
    return T.higher_order(call_facts(spark, d)[0]).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


def _positions(deps: DataFrame) -> DataFrame:
    return deps.where("dep_kind = 'arg'").select("fn_id", "arg_pos").distinct()


@query("c6_concrete_calls", "WITH " + CALLS + "SELECT fn_id, call_id, target_id, concrete FROM k")
def c6(spark, d):
    deps, args = call_facts(spark, d)
    return P.concrete_calls(_positions(deps), deps, args).select("fn_id", "call_id", "target_id", "concrete")


@query("c7_indirect_args", "WITH " + CALLS + "SELECT DISTINCT x.fn_id, CAST(own AS INT) AS arg_pos FROM x JOIN k ON x.fn_id = k.fn_id AND x.call_id = k.call_id JOIN h ON h.fn_id = x.target_id AND h.pos = x.pos WHERE own IS NOT NULL AND NOT concrete")
def c7(spark, d):
    deps, args = call_facts(spark, d)
    return P.indirect_args(_positions(deps), deps, args)[0]


@query("d8_unknown", "WITH " + CALLS + "SELECT DISTINCT fn_id FROM k WHERE NOT concrete AND covered < need")
def d8u(spark, d):
    return P.unfold_hofs(*call_facts(spark, d))[1]


@query("d8_unfold_hofs", "WITH " + CALLS + """SELECT fn_id, 'arg' AS dep_kind, pos::VARCHAR AS dep FROM h UNION SELECT DISTINCT x.fn_id, 'arg', own::VARCHAR FROM x JOIN k ON x.fn_id = k.fn_id AND x.call_id = k.call_id JOIN h ON h.fn_id = x.target_id AND h.pos = x.pos WHERE own IS NOT NULL AND NOT concrete
UNION SELECT fn_id, 'remote', target_id FROM x UNION SELECT x.fn_id, 'remote', passed FROM x JOIN h ON h.fn_id = x.target_id AND h.pos = x.pos WHERE passed IS NOT NULL""")
def d8(spark, d):
    deps, _ = P.unfold_hofs(*call_facts(spark, d))
    return deps.select("fn_id", "dep_kind", F.coalesce("target_id", F.col("arg_pos").cast("string")).alias("dep")).distinct()


@query("d13_mark_recursive", """WITH c AS (SELECT 'o:' || l_orderkey AS fn_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT 'o:' || l_orderkey AS fn_id, l_linenumber % 2 AS pos, count(DISTINCT l_suppkey) AS k FROM lineitem WHERE l_quantity < 45 GROUP BY 1, 2)
SELECT fn_id FROM c WHERE fn_id NOT IN (SELECT fn_id FROM c JOIN s USING (fn_id) WHERE k = n)""")
def d13(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("fn_id", F.concat(F.lit("o:"), F.col("l_orderkey").cast("string"))).withColumn("target_id", F.col("fn_id")).withColumn("call_id", F.col("l_suppkey"))
    args = lines.where("l_quantity < 45").select("fn_id", "call_id", "target_id", F.lit("sub").alias("kind"), (F.col("l_linenumber") % 2).alias("pos"))
    return P.mark_recursive(lines, args)


@query("c9_unite", """WITH p AS (SELECT 'c:' || c_custkey AS fn_id, c_nationkey % 4 AS level, c_custkey % 3 = 0 AS low FROM customer WHERE c_custkey % 5 <> 0), t AS (SELECT 'c:' || o_custkey AS fn_id, CASE WHEN max(o_totalprice) > 400000 THEN 3 ELSE 0 END AS level, FALSE AS low FROM orders GROUP BY 1)
SELECT fn_id, CAST(greatest(p.level, t.level) AS TINYINT) AS level, coalesce(p.low, FALSE) AND greatest(p.level, t.level) < 3 AS at_least FROM p FULL JOIN t USING (fn_id)""")
def c9(spark, d):
    none = F.array().cast(P.NODEPS).alias("deps")
    p = _t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("fn_id"), (F.col("c_nationkey") % 4).cast("tinyint").alias("level"), (F.col("c_custkey") % 3 == 0).alias("at_least"), none)
    t = _t(spark, d, "orders").groupBy(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("fn_id")).agg(F.when(F.max("o_totalprice") > 400000, 3).otherwise(0).cast("tinyint").alias("level")).select("fn_id", "level", F.lit(False).alias("at_least"), none)
    return T.unite(p, t).select("fn_id", "level", "at_least")


@query("h4_upsert", "SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def h4(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    return T.upsert(old, _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")), "k")


@query("h1_set_operations", """SELECT 'union' AS op, x FROM (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_quantity < 3 UNION SELECT p_partkey FROM part WHERE p_size < 5)
UNION ALL SELECT 'subtract', x FROM (SELECT l_partkey AS x FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT p_partkey FROM part WHERE p_size < 5) UNION ALL SELECT 'intersect', x FROM (SELECT l_partkey AS x FROM lineitem WHERE l_quantity < 3 INTERSECT SELECT p_partkey FROM part WHERE p_size < 5)""")
def h1(spark, d):
    a = _t(spark, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("x")).distinct()
    b = _t(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("x"))
    rows = [("union", T.union(a, b)), ("subtract", T.subtract(a, b, ["x"])), ("intersect", T.intersect(a, b, ["x"]))]
    out = [df.select(F.lit(n).alias("op"), "x") for n, df in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f1_last_wins", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def f1(spark, d):
    return T.last_wins(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("a3_merge_modules", "SELECT p_partkey, p_brand FROM part JOIN (SELECT p_brand, max(p_size) AS m FROM part GROUP BY 1) USING (p_brand) WHERE p_size = m")
def a3(spark, d):
    return facts.merge_modules(_t(spark, d, "part"), "p_size", "p_brand").select("p_partkey", "p_brand")


@query("f3_enumerate", "SELECT doc_id, generate_subscripts(w, 1)::INT AS pos, unnest(w) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)")
def f3(spark, d):
    return T.enumerate_from_one(_t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("w")), "w")


@query("f4_name_nested", """WITH n AS (SELECT p_brand AS module, 'f' || p_size AS parent, p_size % 3 AS arity, p_partkey AS seq FROM part), s AS (SELECT DISTINCT p_brand AS module, 'f' || p_size || '_' || p_size % 3 || '-' || 1 + p_partkey % 4 AS name FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT module, parent, arity, i, row_number() OVER (PARTITION BY module, parent, arity ORDER BY i) AS k FROM (SELECT DISTINCT module, parent, arity FROM n), range(1, 200000) r(i)
 WHERE i <= 4 + (SELECT max(c) FROM (SELECT count(*) AS c FROM n GROUP BY module, parent, arity)) AND (module, parent || '_' || arity || '-' || i) NOT IN (SELECT (module, name) FROM s))
SELECT n.module, n.parent, seq, n.parent || '_' || n.arity || '-' || i AS name FROM (SELECT *, row_number() OVER (PARTITION BY module, parent, arity ORDER BY seq) AS k FROM n) n JOIN g USING (module, parent, arity, k)""")
def f4(spark, d):
    p = _t(spark, d, "part")
    parent = F.concat(F.lit("f"), F.col("p_size").cast("string"))
    nested = p.select(F.col("p_brand").alias("module"), parent.alias("parent"), (F.col("p_size") % 3).alias("arity"), F.col("p_partkey").alias("seq"))
    taken = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("module"), F.concat(parent, F.lit("_"), (F.col("p_size") % 3).cast("string"), F.lit("-"), (1 + F.col("p_partkey") % 4).cast("string")).alias("name")).distinct()
    return T.name_nested(nested, taken).select("module", "parent", "seq", "name")


def files(spark, d: str, version: int = 0) -> DataFrame:
    """Documents as files; in version 1 every seventh is changed, every eleventh gone, every thirteenth unreadable."""
    df = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("module"), L.checksum("text").alias("md5"), "doc_id")
    if version:
        df = df.where("doc_id % 11 <> 0").withColumn("md5", F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, L.checksum(F.col("md5"))).otherwise(F.col("md5")))
    return df.drop("doc_id")


@query("i4_checksum", "WITH " + DOCS + " SELECT path, module, md5 FROM d")
def i4(spark, d):
    return files(spark, d)


@query("c13_verify", "SELECT CAST(doc_id AS VARCHAR) AS path, source AS module, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'ok' END AS state FROM documents")
def c13(spark, d):
    return store.verify(files(spark, d), files(spark, d, 1))


@query("c14_update_table", "SELECT CAST(doc_id AS VARCHAR) AS fn_id, source AS module, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS state FROM documents WHERE source <> 'src3'")
def c14(spark, d):
    row = lambda df, s: df.select(F.col("doc_id").cast("string").alias("fn_id"), F.lit("mfa").alias("kind"), F.col("source").alias("module"), F.lit(s).alias("state"))
    docs = _t(spark, d, "documents")
    mods = lambda *m: spark.createDataFrame([(x,) for x in m], "module string")
    return store.update_table(row(docs, "old"), row(docs.where("source IN ('src1', 'src2')"), "new"), mods("src1", "src2"), mods("src3")).drop("kind")


@query("c10_replace_modules", "SELECT CAST(doc_id AS VARCHAR) AS fn_id, source AS module FROM documents WHERE source NOT IN ('src1') OR doc_id % 3 = 0")
def c10(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fn_id"), F.lit("mfa").alias("kind"), F.col("source").alias("module"), "doc_id")
    return T.replace_modules(rows, rows.where("source = 'src1' AND doc_id % 3 = 0")).select("fn_id", "module")


@query("c16_inconsistent", "SELECT CAST(doc_id AS VARCHAR) AS fn_id, o AS option_key FROM documents, (VALUES ('effects'), ('termination')) v(o) WHERE (o = 'termination' AND doc_id % 3 = 0)")
def c16(spark, d):
    f = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fn_id"), "doc_id")
    r = f.withColumn("option_key", F.explode(F.array(F.lit("effects"), F.lit("termination")))).where("option_key = 'effects' OR doc_id % 3 <> 0")
    return store.inconsistent(f, r)


@query("c17_diff_results", "SELECT doc_id, quality, 'expected' AS side FROM (SELECT doc_id, quality FROM labels EXCEPT ALL SELECT doc_id, 1 - toxic FROM labels) UNION ALL SELECT doc_id, q, 'actual' FROM (SELECT doc_id, 1 - toxic AS q FROM labels EXCEPT ALL SELECT doc_id, quality FROM labels)")
def c17(spark, d):
    labels_ = _t(spark, d, "labels")
    return T.diff_results(labels_.select("doc_id", "quality"), labels_.select("doc_id", (1 - F.col("toxic")).alias("quality")), ["doc_id", "quality"])


@query("i6_option_key", """SELECT event_type, string_agg(o, ',' ORDER BY o) AS option_key FROM (SELECT DISTINCT event_type, 'u' || user_id % 5 AS o FROM events WHERE user_id % 5 < 3) GROUP BY 1""")
def i6(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.collect_set(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("o"))
    return e.select("event_type", L.option_key(F.col("o"), ["u0", "u1", "u2"]).alias("option_key"))


@query("j2_j10_targets", "SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ':' || o_orderstatus || '/' || o_custkey % 4 END AS target_id, o_orderstatus || ':/' || o_custkey % 4 AS primop_id FROM orders")
def j2(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("module_lit"), F.col("o_orderstatus").alias("name_lit"), (F.col("o_custkey") % 4).alias("arity"), F.lit("f").alias("fn_id"), F.lit("primop").alias("op_kind"))
    prim = J.primop_deps(o).select("call_id", F.col("target_id").alias("primop_id"))
    return o.select("call_id", J.call_target().alias("target_id")).join(prim, "call_id")


@query("j1_receive", "SELECT 'o:' || o_orderkey AS fn_id, CASE WHEN o_custkey % 3 = 0 THEN 'erl:receive:infinite' WHEN o_custkey % 3 = 1 THEN 'erl:receive:infinite' ELSE 'erl:receive:finite' END AS target_id FROM orders UNION ALL SELECT 'c:' || c_custkey, 'erl:catch' FROM customer")
def j1(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("fn_id"), F.col("o_orderkey").alias("call_id"), F.when(F.col("o_custkey") % 3 == 1, "infinity").when(F.col("o_custkey") % 3 == 2, "5000").alias("timeout"))
    c = _t(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("fn_id"), F.col("c_custkey").alias("call_id"))
    return J.receive_deps(o, c).select("fn_id", "target_id")


@query("j5_reverse_aliases", "SELECT l_orderkey AS fn_id, l_suppkey AS alias, min(l_partkey) AS var FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) = 1")
def j5(spark, d):
    return J.reverse_aliases(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn_id"), F.col("l_suppkey").alias("alias"), F.col("l_partkey").alias("var")))
