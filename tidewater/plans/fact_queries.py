"""Queries over facts that Spark derives from the driver tables: rule text, annotated lines, call facts of the front end, the
persisted store and incremental analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import levels as L
from tidewater.operators import calls as J
from tidewater.operators import propagate as P
from tidewater.operators import tables as T
from tidewater.plans import graph_queries as G
from tidewater.runtime import cut, scratch_dir
from tidewater.sources import facts, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f
    return add


_t = G._t
key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
mod = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))


# Rule text from parts: two files, repeated keys, comments, lines without a level, bounds and dependencies.
@query("a1_parse_rules", """
WITH p AS (SELECT p_partkey AS k, p_size AS z, 'm' || p_size % 10 AS m, 'f' || p_partkey % 37 AS f, p_partkey % 3 AS a, ['p', 'e', 'd', 's'][p_size % 4 + 1] AS v FROM part),
r AS (SELECT CASE WHEN k % 9 = 0 THEN f || ':/' || a ELSE m || ':' || f || '/' || a END AS fn_id, CASE WHEN k % 9 = 0 THEN 'primop' ELSE 'mfa' END AS kind, CAST(z % 4 AS TINYINT) AS level, k % 5 = 0 AS at_least,
CASE WHEN k % 4 = 1 THEN '1' WHEN k % 4 = 2 THEN 'lib:g' || z || '/2' ELSE '' END AS deps, row_number() OVER (PARTITION BY CASE WHEN k % 9 = 0 THEN f || ':/' || a ELSE m || ':' || f || '/' || a END ORDER BY k % 2, k) AS n FROM p WHERE k % 11 <> 0 AND k % 13 <> 0)
SELECT fn_id, kind, level, at_least, deps FROM r WHERE n = 1""")
def a1(spark, d):
    k = F.col("p_partkey")
    two = F.concat(mod("f", "p_partkey", 37), F.lit(","), (k % 3).cast("string"))
    head = F.when(k % 9 == 0, two).otherwise(F.concat(mod("m", "p_size", 10), F.lit(",'"), mod("f", "p_partkey", 37), F.lit("',"), (k % 3).cast("string")))
    level = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("\t\t"), F.when(k % 5 == 0, ">= ").otherwise(""), L.level_name((F.col("p_size") % 4).cast("int"))))
    deps = F.when(k % 4 == 1, " [{arg,1}]").when(k % 4 == 2, F.concat(F.lit(" [{remote,{lib,g"), F.col("p_size").cast("string"), F.lit(",2},[]}]"))).otherwise("")
    lines = _t(spark, d, "part").select((k % 2).cast("int").alias("file_rank"), k.alias("line_no"), F.concat(F.when(k % 11 == 0, "#").otherwise(""), head, level, deps).alias("value"))
    return facts.parse_rules(lines).select("fn_id", "kind", "level", "at_least", G.labels().alias("deps"))


# Annotated lines from orders: sets by option, one global line in some files, noise.
@query("a10_extract_golden", """
WITH o AS (SELECT o_orderkey AS k, 't' || o_custkey % 20 AS m, o_custkey % 20 AS c FROM orders),
r AS (SELECT m, CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[x]' ELSE '[y]' END AS options, 'f' || (k - k % 2) || '/1' AS f, CASE k % 4 WHEN 0 THEN 'e [1]' WHEN 1 THEN '>= p' ELSE 's' END AS expected FROM o WHERE k % 4 < 3),
s AS (SELECT DISTINCT m, options FROM r WHERE options <> '[]' UNION SELECT DISTINCT m, '[z]' FROM o WHERE c < 5)
SELECT options, m || ':' || f AS fn_id, expected FROM r
UNION ALL SELECT s.options, r.m || ':' || f, expected FROM r JOIN s USING (m) WHERE r.options = '[]' AND NOT EXISTS (SELECT 1 FROM r q WHERE q.m = r.m AND q.f = r.f AND q.options = s.options)""")
def a10(spark, d):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("dir/"), mod("t", "o_custkey", 20), F.lit(".src"))
    fn = F.concat(F.lit("f"), (k - k % 2).cast("string"), F.lit("/1 "))
    value = F.when(k % 4 == 0, F.concat(F.lit("%< "), fn, F.lit("e [1]"))).when(k % 4 == 1, F.concat(F.lit("  %< [x] "), fn, F.lit(">= p"))).when(k % 4 == 2, F.concat(F.lit("%< [y] "), fn, F.lit("s"))).otherwise("f(X) -> X. %< no")
    o = _t(spark, d, "orders")
    lines = o.select(path.alias("path"), k.alias("line_no"), value.alias("value"))
    top = o.where("o_custkey % 20 < 5").select(path.alias("path")).distinct().select("path", F.lit(0).cast("long").alias("line_no"), F.lit("%< global [z]").alias("value"))
    return facts.extract_golden(lines.unionByName(top)).select("options", "fn_id", "expected")


@query("i8_parse_expected", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 END::TINYINT AS level, o_orderkey % 5 IN (1, 3) AS at_least, CASE o_orderkey % 5 WHEN 2 THEN '[' || o_custkey || ']' ELSE '[]' END AS deps FROM orders""")
def i8(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, "p").when(k % 5 == 1, " >= e").when(k % 5 == 2, F.concat(F.lit("s ["), F.col("o_custkey").cast("string"), F.lit("]."))).when(k % 5 == 3, ">= d .").otherwise("pure")
    return _t(spark, d, "orders").select("o_orderkey", L.parse_expected(value).alias("x")).select("o_orderkey", "x.*")


@query("i7_clean", """
SELECT 'p:' || p_partkey AS fn_id, CASE WHEN p_partkey % 4 = 0 THEN '1' WHEN p_partkey % 4 = 1 THEN '1,s:' || p_size ELSE '' END AS deps FROM part WHERE p_size % 3 <> 0 AND p_brand = 'Brand#11'""")
def i7(spark, d):
    k = F.col("p_partkey")
    dep = lambda kind, target, pos: F.struct(F.lit(kind).alias("dep_kind"), target.cast("string").alias("target_id"), F.lit(pos).cast("int").alias("arg_pos"))
    arg, other = dep("arg", F.lit(None), 1), dep("remote", key("s:", "p_size"), None)
    deps = F.when(k % 4 == 0, F.array(arg, arg)).when(k % 4 == 1, F.array(other, arg, other)).otherwise(F.array().cast(P.NODEPS))
    r = _t(spark, d, "part").select(key("p:", "p_partkey").alias("fn_id"), F.col("p_brand").alias("module"), F.when(F.col("p_size") % 3 == 0, "f_1-2").otherwise("f").alias("name"), deps.alias("deps"))
    return facts.clean(r, "Brand#11").select("fn_id", F.array_join("deps", ",").alias("deps"))


@query("i5_separate", "WITH " + G.DOCS + ", v AS (SELECT * FROM d WHERE CAST(path AS BIGINT) % 11 <> 0) SELECT path, CAST(path AS BIGINT) % 13 <> 0 AS good FROM v")
def i5(spark, d):
    good, broken = facts.separate(G.files(spark, d, 1))
    return good.select("path", F.lit(True).alias("good")).unionByName(broken.select("path", F.lit(False).alias("good")))


@query("h5_difference", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def h5(spark, d):
    return T.subtract(_t(spark, d, "documents"), _t(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


@query("h3_in_all", """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS g, l_linenumber % 3 AS pos FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT g) AS n FROM s GROUP BY 1)
SELECT l_orderkey, pos FROM (SELECT l_orderkey, pos, count(*) AS k FROM s GROUP BY 1, 2) JOIN n USING (l_orderkey) WHERE k = n""")
def h3(spark, d):
    s = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("g"), (F.col("l_linenumber") % 3).alias("pos"))
    return T.in_all(s, ["l_orderkey"], "g", "pos")


# Front-end facts: customers are functions, their orders make, use and alias variables.
MADE = "made AS (SELECT 'c:' || o_custkey AS fn_id, 'v' || o_orderkey % 7 AS var, o_orderkey AS seq, o_orderpriority || ':' || o_orderstatus || '/' || o_custkey % 4 AS bound_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0)"


def made(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = _t(spark, d, "orders").select(key("c:", "o_custkey").alias("fn_id"), mod("v", "o_orderkey", 7).alias("var"), k.alias("seq"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("module_lit"), F.col("o_orderstatus").alias("name_lit"), F.when(k % 11 != 0, F.col("o_custkey") % 4).alias("arity"))
    return J.made_functions(m)


@query("j4_made_functions", f"WITH {MADE} SELECT * FROM made")
def j4(spark, d):
    return made(spark, d)


@query("j3_resolve_variables", f"""WITH {MADE}, newest AS (SELECT fn_id, var, arg_max(bound_id, seq) AS b FROM made GROUP BY 1, 2),
al AS (SELECT 'c:' || o_custkey AS fn_id, 'v' || o_orderkey % 9 AS alias, min('v' || o_orderkey % 7) AS v FROM orders WHERE o_orderkey % 9 <> o_orderkey % 7 GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey % 7) = 1),
own AS (SELECT DISTINCT 'm' || p_partkey % 5 || ':v' || p_size % 9 || '/' || p_size % 4 AS l FROM part),
u AS (SELECT o_orderkey AS use_id, 'c:' || o_custkey AS fn_id, 'm' || o_custkey % 5 AS module, 'v' || o_orderkey % 9 AS var, o_orderkey % 4 AS arity FROM orders)
SELECT use_id, coalesce(n.b, x.b, l) AS bound_id FROM u LEFT JOIN newest n ON n.fn_id = u.fn_id AND n.var = u.var LEFT JOIN al ON al.fn_id = u.fn_id AND alias = u.var LEFT JOIN newest x ON x.fn_id = u.fn_id AND x.var = al.v LEFT JOIN own ON l = module || ':' || u.var || '/' || arity""")
def j3(spark, d):
    o, p = _t(spark, d, "orders"), _t(spark, d, "part")
    uses = o.select(F.col("o_orderkey").alias("use_id"), key("c:", "o_custkey").alias("fn_id"), mod("m", "o_custkey", 5).alias("module"), mod("v", "o_orderkey", 9).alias("var"), (F.col("o_orderkey") % 4).alias("arity"))
    aliases = J.reverse_aliases(o.select(key("c:", "o_custkey").alias("fn_id"), mod("v", "o_orderkey", 9).alias("alias"), mod("v", "o_orderkey", 7).alias("var")))
    own = p.select(F.concat(mod("m", "p_partkey", 5), F.lit(":"), mod("v", "p_size", 9), F.lit("/"), (F.col("p_size") % 4).cast("string")).alias("fn_id"))
    return J.resolve_variables(uses, made(spark, d), aliases, own).select("use_id", "bound_id")


LINES = "x AS (SELECT 'o:' || l_orderkey AS fn_id, l_linenumber AS call_id, 's:' || l_suppkey AS target_id, l_linenumber AS pos, 'v' || l_partkey % 6 AS var FROM lineitem), fr AS (SELECT 'o:' || o_orderkey AS fn_id, 'v' || o_custkey % 6 AS var FROM orders), pa AS (SELECT 'o:' || o_orderkey AS fn_id, 'v' || o_orderkey % 6 AS var, CAST(o_orderkey % 3 + 1 AS INT) AS pos FROM orders)"


def line_facts(spark, d: str):
    o = _t(spark, d, "orders")
    lines = _t(spark, d, "lineitem").select(key("o:", "l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("call_id"), key("s:", "l_suppkey").alias("target_id"), F.col("l_linenumber").alias("pos"), mod("v", "l_partkey", 6).alias("var"))
    free = o.select(key("o:", "o_orderkey").alias("fn_id"), mod("v", "o_custkey", 6).alias("var"))
    params = o.select(key("o:", "o_orderkey").alias("fn_id"), mod("v", "o_orderkey", 6).alias("var"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("pos"))
    return lines, free, params


@query("j6_local_deps", f"""WITH {LINES} SELECT DISTINCT x.fn_id, call_id, CASE WHEN fr.var IS NOT NULL THEN 'free' WHEN pa.pos IS NOT NULL THEN 'arg' ELSE 'local' END AS dep_kind,
CASE WHEN fr.var IS NULL THEN pa.pos END AS arg_pos, CASE WHEN fr.var IS NOT NULL OR pa.pos IS NULL THEN x.var END AS var FROM x LEFT JOIN fr ON fr.fn_id = x.fn_id AND fr.var = x.var LEFT JOIN pa ON pa.fn_id = x.fn_id AND pa.var = x.var""")
def j6(spark, d):
    return J.local_deps(*line_facts(spark, d))


@query("j7_classify_args", f"""WITH {LINES}, b AS (SELECT 'o:' || o_orderkey AS fn_id, 'v' || (o_orderkey + 1) % 6 AS var, 'p:' || o_custkey AS passed FROM orders)
SELECT x.fn_id, call_id, target_id, CASE WHEN passed IS NOT NULL THEN 'fn' WHEN pa.pos IS NOT NULL THEN 'arg' ELSE 'free' END AS kind, x.pos, CASE WHEN passed IS NULL THEN pa.pos END AS from_pos, passed AS passed_id, CASE WHEN passed IS NULL AND pa.pos IS NULL THEN x.var END AS var
FROM x LEFT JOIN b ON b.fn_id = x.fn_id AND b.var = x.var LEFT JOIN pa ON pa.fn_id = x.fn_id AND pa.var = x.var LEFT JOIN fr ON fr.fn_id = x.fn_id AND fr.var = x.var WHERE passed IS NOT NULL OR pa.pos IS NOT NULL OR fr.var IS NOT NULL""")
def j7(spark, d):
    lines, free, params = line_facts(spark, d)
    bound = _t(spark, d, "orders").select(key("o:", "o_orderkey").alias("fn_id"), F.concat(F.lit("v"), ((F.col("o_orderkey") + 1) % 6).cast("string")).alias("var"), F.lit(1).alias("seq"), key("p:", "o_custkey").alias("bound_id"))
    return J.classify_args(lines, bound, free, params)


@query("j8_reduced_args", """WITH RECURSIVE x AS (SELECT DISTINCT 'o:' || l_orderkey AS fn_id, l_linenumber AS n, 'v' || l_linenumber AS var, CAST(1 + l_partkey % 2 AS INT) AS pos FROM lineitem),
pt AS (SELECT 'o:' || l_orderkey AS fn_id, 'v' || l_linenumber AS var, 'v' || l_linenumber - 1 AS of_var FROM lineitem WHERE l_returnflag <> 'N'),
pa AS (SELECT DISTINCT fn_id, var, CAST(n AS INT) AS pos FROM x WHERE n <= 2),
seen(fn_id, var, pos) AS (SELECT pt.fn_id, pt.var, pos FROM pt JOIN pa ON pa.fn_id = pt.fn_id AND pa.var = of_var UNION SELECT pt.fn_id, pt.var, pos FROM pt JOIN seen s ON s.fn_id = pt.fn_id AND s.var = of_var)
SELECT DISTINCT x.fn_id, x.n AS call_id, 'sub' AS kind, x.pos FROM x JOIN seen USING (fn_id, var, pos)""")
def j8(spark, d):
    x = _t(spark, d, "lineitem").select(key("o:", "l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("call_id"), key("v", "l_linenumber").alias("var"), (1 + F.col("l_partkey") % 2).cast("int").alias("pos"), F.concat(F.lit("v"), (F.col("l_linenumber") - 1).cast("string")).alias("of_var"), "l_returnflag")
    params = x.where("call_id <= 2").select("fn_id", "var", F.col("call_id").cast("int").alias("pos")).distinct()
    return J.reduced_args(x.select("fn_id", "call_id", "var", "pos"), x.where("l_returnflag <> 'N'").select("fn_id", "var", "of_var"), params)


# Nested functions: an order's odd lines lie in the order, even ones in the line before (or in the order, if there is none).
@query("j9_promote_nested", """WITH li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), r AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
ne AS (SELECT 'l:' || o || '-' || n AS child, CASE WHEN n % 2 = 0 AND (o, n - 1) IN (SELECT (o, n) FROM li) THEN 'l:' || o || '-' || n - 1 ELSE 'o:' || o END AS parent, CASE WHEN n % 2 = 0 AND (o, n - 1) IN (SELECT (o, n) FROM li) THEN 2 ELSE 1 END AS depth, p, n FROM r),
d0 AS (SELECT parent AS fn, 'local' AS k, child AS t, NULL::INT AS a, NULL AS v FROM ne UNION SELECT child, 'remote', 'p:' || p, NULL, NULL FROM ne UNION SELECT child, 'free', NULL, NULL, 'v' || n FROM ne WHERE p % 3 = 0),
en AS (SELECT child, 'v' || n AS v, CASE WHEN p % 2 = 0 THEN CAST(n AS INT) END AS a, CASE WHEN p % 2 = 1 AND p % 5 <> 0 THEN 'v' || (n - 1) END AS u FROM ne),
w2 AS (SELECT d0.*, child, parent, en.a AS ea, u FROM d0 JOIN ne ON fn = ne.child AND depth = 2 LEFT JOIN en USING (child, v) WHERE t IS NULL OR t <> parent),
g2 AS (SELECT child, parent FROM ne WHERE depth = 2 AND child NOT IN (SELECT child FROM w2 WHERE k = 'free' AND ea IS NULL AND u IS NULL)),
d1 AS (SELECT * FROM d0 WHERE (fn, t) NOT IN (SELECT (parent, child) FROM g2) OR t IS NULL UNION SELECT parent, CASE WHEN k = 'free' AND ea IS NOT NULL THEN 'arg' ELSE k END, t, CASE WHEN k = 'free' THEN ea ELSE a END, CASE WHEN k = 'free' THEN CASE WHEN ea IS NULL THEN u END ELSE v END FROM w2 JOIN g2 USING (child, parent)),
w1 AS (SELECT d1.*, child, parent, en.a AS ea, u FROM d1 JOIN ne ON fn = ne.child AND depth = 1 LEFT JOIN en USING (child, v) WHERE t IS NULL OR t <> parent),
g1 AS (SELECT child, parent FROM ne WHERE depth = 1 AND child NOT IN (SELECT child FROM w1 WHERE k = 'arg' AND t IS NULL OR k = 'free' AND ea IS NULL AND u IS NULL))
SELECT fn AS fn_id, k AS dep_kind, t AS target_id, a AS arg_pos, v AS var FROM (SELECT * FROM d1 WHERE (fn, t) NOT IN (SELECT (parent, child) FROM g1) OR t IS NULL UNION SELECT parent, CASE WHEN k = 'free' AND ea IS NOT NULL THEN 'arg' ELSE k END, t, CASE WHEN k = 'free' THEN ea ELSE a END, CASE WHEN k = 'free' THEN CASE WHEN ea IS NULL THEN u END ELSE v END FROM w1 JOIN g1 USING (child, parent))""")
def j9(spark, d):
    r = cut(_t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p")))
    before = r.select("o", (F.col("n") + 1).alias("n"), F.lit(True).alias("has"))
    line = lambda n: F.concat(F.lit("l:"), F.col("o").cast("string"), F.lit("-"), n.cast("string"))
    inner = F.coalesce(F.col("has"), F.lit(False)) & (F.col("n") % 2 == 0)
    nested = r.join(before, ["o", "n"], "left").select(line(F.col("n")).alias("child_id"), F.when(inner, line(F.col("n") - 1)).otherwise(key("o:", "o")).alias("parent_id"), F.when(inner, 2).otherwise(1).alias("depth"), "n", "p")
    nested = cut(nested)
    none = lambda kind: F.lit(None).cast(kind)
    var = key("v", "n")
    deps = nested.select(F.col("parent_id").alias("fn_id"), F.lit("local").alias("dep_kind"), F.col("child_id").alias("target_id"), none("int").alias("arg_pos"), none("string").alias("var"))
    deps = deps.unionByName(nested.select(F.col("child_id").alias("fn_id"), F.lit("remote").alias("dep_kind"), key("p:", "p").alias("target_id"), none("int").alias("arg_pos"), none("string").alias("var")))
    deps = deps.unionByName(nested.where("p % 3 = 0").select(F.col("child_id").alias("fn_id"), F.lit("free").alias("dep_kind"), none("string").alias("target_id"), none("int").alias("arg_pos"), var.alias("var")))
    env = nested.select(F.col("child_id").alias("fn_id"), var.alias("var"), F.when(F.col("p") % 2 == 0, F.col("n").cast("int")).alias("arg_pos"), F.when((F.col("p") % 2 == 1) & (F.col("p") % 5 != 0), F.concat(F.lit("v"), (F.col("n") - 1).cast("string"))).alias("outer_var"))
    return J.promote_nested(deps, nested.select("child_id", "parent_id", "depth"), env)


# Effects and termination together, over the parts of a brand that follow each other in an order; parts of size 7 are missing.
@query("d3_both", "WITH RECURSIVE " + G.PART.replace(G.LOCAL, G.LOCAL + " AND p.p_size <> 7") + """, f AS (SELECT x, p_size % 3 AS own FROM n JOIN part ON x = p_partkey WHERE p_size <> 7),
k AS (SELECT f.x, f.own, greatest(f.own, coalesce(max(t.own), 0)) AS high, coalesce(bool_or(t.x IS NULL AND c.b IS NOT NULL), FALSE) AS open FROM f LEFT JOIN c ON c.a = f.x LEFT JOIN f t ON t.x = c.b GROUP BY f.x, f.own),
cyc AS (SELECT DISTINCT a FROM c WHERE a = b AND a IN (SELECT x FROM f)), cy AS (SELECT a FROM cyc UNION SELECT c.a FROM c JOIN cyc ON c.b = cyc.a),
u AS (SELECT e.a AS x, max(CASE WHEN NOT t.open THEN t.high END) AS up, string_agg(CASE WHEN t.x IS NULL OR t.open THEN 'p:' || e.b END, ',' ORDER BY 'p:' || e.b) AS deps FROM e LEFT JOIN k t ON t.x = e.b GROUP BY 1)
SELECT 'p:' || k.x AS fn_id, CAST(CASE WHEN k.x IN (SELECT a FROM cy) THEN 3 WHEN open THEN greatest(own, coalesce(up, 0)) ELSE high END AS TINYINT) AS level, CASE WHEN open AND k.x NOT IN (SELECT a FROM cy) THEN coalesce(deps, '') ELSE '' END AS deps FROM k LEFT JOIN u USING (x)""")
def d3(spark, d):
    held = _t(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("src"))
    e = cut(G.part_edges(spark, d).join(held, "src", "left_semi"))
    ends = e.select(F.col("src").alias("p_partkey")).unionByName(e.select(F.col("dst").alias("p_partkey"))).distinct()
    nodes = _t(spark, d, "part").where("p_size <> 7").join(ends, "p_partkey")
    functions = G._fn(nodes, "p:", "p_partkey", "p_brand", F.col("p_size") % 3)
    deps = e.select(key("p:", "src").alias("fn_id"), F.lit(0).cast("bigint").alias("call_id"), F.lit("remote").alias("dep_kind"), key("p:", "dst").alias("target_id"), F.lit(None).cast("int").alias("arg_pos"), F.lit(None).cast("string").alias("var"))
    rules = G.supply(spark, d)[3].limit(0)
    out = P.propagate(functions, deps, spark.createDataFrame([], L.DEP_ARGS), rules, "both")
    return out.where("kind = 'mfa'").select("fn_id", "level", G.labels().alias("deps"))


# The store of the supply graph: checksums are documents' modules, results those of the effect analysis.
def supply_store(spark, d: str):
    f, deps, args, rules = G.supply(spark, d)
    f, deps = cut(f), cut(deps.distinct())
    sums = f.select("module").distinct().select(F.concat(F.lit("src/"), "module").alias("path"), "module", F.md5("module").alias("md5"))
    results = P.propagate_effects(f, deps, args, rules).withColumn("option_key", F.lit("effects"))
    return store.PersistedTables(sums, f, deps, args, cut(results)), rules


def changed_store(spark, d: str):
    """Parts of Brand#11 change their levels, module Brand#12 is broken."""
    old, rules = supply_store(spark, d)
    module = lambda m: spark.sql(f"SELECT '{m}' AS module")
    fresh = old.functions.where("module = 'Brand#11'").withColumn("level", ((F.col("level") + 1) % 4).cast("tinyint"))
    own = old.deps.join(fresh.select("fn_id"), "fn_id", "left_semi")
    new, again = store.analyse_changed(old, module("Brand#11"), module("Brand#12"), fresh, own, old.dep_args)
    return new, again, rules


RMAP = ", mm AS (SELECT DISTINCT b.module AS a, a.module AS b FROM e JOIN f0 a ON src = a.fn_id JOIN f0 b ON dst = b.fn_id WHERE a.module <> b.module)"


@query("d11_analyse_changed", "WITH RECURSIVE " + G.SUPPLY + RMAP + ", t(module) AS (SELECT unnest(['Brand#11', 'Brand#12']) UNION SELECT b FROM mm JOIN t ON a = module) SELECT module FROM t WHERE module <> 'Brand#12'")
def d11(spark, d):
    return changed_store(spark, d)[1]


CHANGED = G.REACHED.replace("SELECT 'p:' || p_partkey, p_brand, CASE", "SELECT 'p:' || p_partkey, p_brand, CASE WHEN p_brand = 'Brand#11' THEN (1 + CASE WHEN p_size = 1 AND p_type = 'PROMO' THEN 3 WHEN p_size IN (2, 3) THEN 2 WHEN p_size BETWEEN 4 AND 9 THEN 1 ELSE 0 END) % 4").replace("FALSE FROM part)", "FALSE FROM part WHERE p_brand <> 'Brand#12')").replace("UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem", "UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#12'")


@query("d12_analyse_warm", "WITH RECURSIVE " + CHANGED + "SELECT fn_id, level, at_least, deps FROM r WHERE fn_id NOT LIKE 's:%'")
def d12(spark, d):
    new, again, rules = changed_store(spark, d)
    out = store.analyse(new, rules, "effects", again)
    return out.where("kind = 'mfa' AND fn_id NOT LIKE 's:%'").select("fn_id", "level", "at_least", G.labels().alias("deps"))


@query("a5_store_round_trip", "WITH RECURSIVE " + G.REACHED + """SELECT 'functions' AS part, fn_id AS k, module AS v FROM f0 UNION ALL SELECT 'deps', src, dst FROM e UNION ALL SELECT 'results', fn_id, CAST(level AS VARCHAR) || deps FROM r
UNION ALL SELECT 'checksums', 'src/' || module, md5(module) FROM (SELECT DISTINCT module FROM f0)""")
def a5(spark, d):
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    supply_store(spark, d)[0].save(path)
    s = store.PersistedTables.load(spark, path)
    rows = [("functions", s.functions, "fn_id", F.col("module")), ("deps", s.deps, "fn_id", F.col("target_id")), ("results", s.results.where("kind = 'mfa'"), "fn_id", F.concat(F.col("level").cast("string"), G.labels())), ("checksums", s.checksums, "path", F.col("md5"))]
    out = [df.select(F.lit(n).alias("part"), F.col(k).alias("k"), v.alias("v")) for n, df, k, v in rows]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("a7_export_text", "WITH RECURSIVE " + G.REACHED + """, w AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS deps FROM e GROUP BY src),
x AS (SELECT 0 AS section, '' AS key, 'version 2' AS value UNION ALL SELECT 1, 'src/' || module, 'src/' || module || ' ' || md5(module) FROM (SELECT DISTINCT module FROM f0)
UNION ALL SELECT 2, fn_id, CASE WHEN w.deps IS NULL THEN fn_id ELSE fn_id || ' ' || w.deps END FROM f0 LEFT JOIN w ON src = fn_id
UNION ALL SELECT 3, 'effects ' || fn_id, 'effects ' || fn_id || ' ' || (CASE WHEN at_least THEN '>= ' ELSE '' END) || ['p', 'e', 'd', 's'][level + 1] || (CASE WHEN deps = '' THEN '' ELSE ' [' || replace(deps, ',', ', ') || ']' END) FROM r)
SELECT row_number() OVER (ORDER BY section, key, value) AS rank, section, value FROM x""")
def a7(spark, d):
    """The rows with their numbers in the export's order."""
    s, _ = supply_store(spark, d)
    s.results = s.results.where("kind = 'mfa'")
    return T.in_order(store.export_text(s).select("section", "value"))


@query("a8_listing", G.WR + "SELECT row_number() OVER (ORDER BY module, fn_id) AS rank, fn_id || ' ' || (CASE WHEN at_least THEN '>= ' ELSE '' END) || ['p', 'e', 'd', 's'][level + 1] || (CASE WHEN deps = '' THEN '' ELSE ' [' || replace(deps, ',', ', ') || ']' END) || '.' AS value FROM r")
def a8(spark, d):
    """G1: the written lines, read back with their numbers over all files."""
    path = f"{scratch_dir(spark)}/listing-{uuid.uuid4().hex}"
    T.write_listing(G.supply_results(spark, d), path)
    return T.read_lines(spark, path)


@query("a9_statistics", G.WR + """, c AS (SELECT module, CASE WHEN at_least AND deps = '' THEN 'limited' WHEN deps <> '' THEN 'undefined' ELSE ['p', 'e', 'd', 's'][level + 1] END AS class FROM r),
t AS (SELECT module, count(*) FILTER (class = 'p') AS p, count(*) AS total FROM c GROUP BY module),
x AS (SELECT 0 AS part, 0.0::DOUBLE AS pct, 'module' AS module, 'p' AS p, 'total' AS total UNION ALL SELECT 1, 100.0::DOUBLE * p / total, module, p::VARCHAR, total::VARCHAR FROM t UNION ALL SELECT 2, 0, count(*) || ' modules', sum(p)::VARCHAR, sum(total)::VARCHAR FROM t)
SELECT row_number() OVER (ORDER BY part, pct, module) AS rank, module, p, total FROM x""")
def a9(spark, d):
    """The written statistics: header, modules from the worst on, totals, read back with their numbers over all files."""
    path = f"{scratch_dir(spark)}/statistics-{uuid.uuid4().hex}"
    T.write_stats(T.stats(G.supply_results(spark, d)), path)
    field = lambda i: F.element_at(F.split("value", ","), i)
    return T.read_lines(spark, path).select("rank", field(1).alias("module"), field(2).alias("p"), field(9).alias("total"))


# Documents as functions of their source, calling the next one. src1 is analysed again and keeps a third of its functions, src2 can't be
# read any more. Termination's results lack some functions and go; those of both stay, without src2.
@query("c15_update_store", """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS k, source, doc_id % 3 AS r FROM documents), kept AS (SELECT k, source, 'old' AS v FROM d WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT k, source, 'new' FROM d WHERE source = 'src1' AND r = 0)
SELECT 'functions' AS part, k, source AS v FROM kept UNION ALL SELECT 'deps', k, v FROM kept
UNION ALL SELECT 'effects', k, v FROM kept UNION ALL SELECT 'effects', 'sys:x/0', 'new' UNION ALL SELECT 'both', k, 'old' FROM d WHERE source <> 'src2'
UNION ALL SELECT 'checksums', source, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END FROM (SELECT DISTINCT source FROM d)""")
def c15(spark, d):
    """C15 on a saved store, of which only the parts of the changed modules are written anew."""
    docs = _t(spark, d, "documents")
    row = docs.select(F.col("doc_id").cast("string").alias("fn_id"), F.lit("mfa").alias("kind"), F.col("source").alias("module"), F.lit("f").alias("name"), F.lit(0).alias("arity"), F.lit(0).cast("tinyint").alias("level"), F.lit(False).alias("at_least"), "doc_id")
    third, cols = row.where("module = 'src1' AND doc_id % 3 = 0"), ["fn_id", "kind", "module", "name", "arity", "level", "at_least"]

    def calls(df, target):
        none = lambda kind: F.lit(None).cast(kind)
        return df.select("fn_id", F.lit(0).cast("bigint").alias("call_id"), F.lit("remote").alias("dep_kind"), F.lit(target).alias("target_id"), none("int").alias("arg_pos"), none("string").alias("var"))

    options = F.explode(F.array(F.lit("effects"), F.lit("termination"), F.lit("both")))
    results = row.withColumn("deps", F.array().cast(P.NODEPS)).withColumn("option_key", options).where("option_key <> 'termination' OR doc_id % 5 <> 1")
    sums = docs.select(F.concat(F.lit("src/"), "source").alias("path"), F.col("source").alias("module"), F.lit("old").alias("md5")).distinct()
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    args = spark.createDataFrame([], L.DEP_ARGS)
    store.PersistedTables(sums, row.select(*cols), calls(row, "old"), args, results.select(*cols, "deps", "option_key")).save(path)
    files = sums.where("module IN ('src1', 'src2')").withColumn("md5", F.when(F.col("module") == "src1", "new"))
    own = third.select(*cols).withColumn("level", F.lit(1).cast("tinyint"))
    builtin = spark.createDataFrame([("sys:x/0", "mfa", "sys", "x", 0, 1, False)], L.FUNCTIONS)
    store.update_saved(spark, path, files, own, calls(own, "new"), args, own.unionByName(builtin).withColumn("deps", F.array().cast(P.NODEPS)))
    new = store.PersistedTables.load(spark, path)
    state = F.when(F.col("level") == 1, "new").otherwise("old")
    out = new.functions.select(F.lit("functions").alias("part"), F.col("fn_id").alias("k"), F.col("module").alias("v"))
    out = out.unionByName(new.deps.select(F.lit("deps").alias("part"), F.col("fn_id").alias("k"), F.col("target_id").alias("v")))
    out = out.unionByName(new.results.select(F.col("option_key").alias("part"), F.col("fn_id").alias("k"), state.alias("v")))
    return out.unionByName(new.checksums.select(F.lit("checksums").alias("part"), F.col("module").alias("k"), F.col("md5").alias("v")))
