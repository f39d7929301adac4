"""Termination, components and cycles over all lines against a brute-force search."""

import os
import shutil

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORDERS = {1: [1, 2, 3, 1], 2: [3, 4], 3: [4, 5, 4], 4: [6, 7], 5: [8, 9, 8], 6: [9, 10], 7: [10, 11, 10], 8: [12, 12, 13], 9: [20, 21, 22, 20], 10: [30]}


def test_against_brute_force(spark, tmp_path):
    for f in os.listdir(SF):
        if not f.startswith("lineitem"):
            shutil.copy(f"{SF}/{f}", tmp_path / f)
    old = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows = [(o, p, 1, k, 1.0 + k) for o, parts in ORDERS.items() for k, p in enumerate(parts)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double")
    names = lines.columns
    lines.selectExpr(*[f"cast({c} as {old.schema[c].dataType.simpleString()}) {c}" for c in names]).write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {(a, b) for parts in ORDERS.values() for a, b in zip(parts, parts[1:]) if a != b}
    nodes = {x for e in edges for x in e}

    def reached(x, edges):
        seen, todo = set(), [x]
        while todo:
            a = todo.pop()
            for b in (b for s, b in edges if s == a and b not in seen):
                seen.add(b)
                todo.append(b)
        return seen

    to = {x: reached(x, edges) for x in nodes}
    comp = {x: min(y for y in nodes if y == x or y in to[x] and x in to[y]) for x in nodes}
    weak = {x: min({x} | reached(x, edges | {(b, a) for a, b in edges})) for x in nodes}
    size = {c: sum(v == c for v in comp.values()) for c in comp.values()}
    leaving = {comp[a] for a, b in edges if comp[a] != comp[b]}
    level = {r.p_partkey: r.p_size % 4 for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    top = {c: max(level[x] for x in nodes if comp[x] == c) for c in size}
    want = {
        "d2_termination_all": {(f"p:{x}", 3 if any(y in to[y] for y in to[x] | {x}) else 0) for x in nodes},
        "d4_components_all": set(comp.items()),
        "d4_weak_components_all": set(weak.items()),
        "d5_independent_all": {(x, c) for x, c in comp.items() if size[c] > 1 and c not in leaving},
        "d6_mutual_level_all": {(f"p:{x}", top[comp[x]]) for x in nodes},
        "d7_cyclic_all": {(x,) for x in nodes if x in to[x]},
    }
    for name, rows in want.items():
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == rows, name
