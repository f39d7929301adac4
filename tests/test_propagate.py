"""Propagation held against a plain evaluator on random graphs, in all three modes; components, labels and patterns."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import levels as L
from tidewater.operators import calls as J
from tidewater.operators import components as C
from tidewater.operators import graph
from tidewater.operators import propagate as P
from tidewater.sources import facts

PREDEFINED = {"effects": {"erl:catch": 2, "erl:receive:finite": 3, "erl:receive:infinite": 3}, "termination": {"erl:catch": 0, "erl:receive:finite": 0, "erl:receive:infinite": 3}}


class World:
    """Tables as plain lists: functions {id: (level, at_least)}, deps (fn, call, kind, target, position), args (fn, call, target, kind,
    pos, own position, passed), rules {id: (level, at_least, positions, targets)}."""

    def __init__(self):
        self.functions, self.deps, self.args, self.rules = {}, [], [], {}


def random_world(r, name, out):
    """A few functions that call each other, rules, missing ones and unknown ones, pass functions and hand on arguments."""
    fns = [f"{name}:f{i}/2" for i in range(r.randint(1, 8))]
    ruled = [f"{name}:r{i}/2" for i in range(r.randint(0, 3))]
    gone = [f"{name}:gone{i}/1" for i in range(2)]
    for f in fns:
        out.functions[f] = (r.choice([None, None, None, 0, 1, 2, 3]), r.random() < 0.05)
        if r.random() < 0.3:
            out.deps += [(f, 900 + p, "arg", None, p) for p in r.sample([1, 2], r.randint(1, 2))]
    for f in ruled:
        out.rules[f] = (r.choice([0, 0, 1, 2, 3]), r.random() < 0.15, r.choice([[], [], [1]]), r.choice([[], [], [r.choice(ruled)]]))
    for f in fns:
        for call in range(r.choice([0, 1, 1, 2, 3])):
            kind = r.choices(["remote", "local", "primop", "erl", "free", "unknown"], [10, 4, 1, 1, 0.4, 0.4])[0]
            target = r.choice(fns * 3 + ruled * 2 + gone[: r.randint(0, 1)])
            target = {"erl": r.choice(list(PREDEFINED["effects"])), "free": None, "unknown": None, "primop": r.choice([*ruled, target])}.get(kind, target)
            out.deps.append((f, call, "remote" if kind == "unknown" else kind, target, None))
            if kind not in ("remote", "local"):
                continue
            for pos in (1, 2):
                what = r.choice(["fn", "arg", "sub", "free", None, None])
                if what == "fn":
                    out.args.append((f, call, target, "fn", pos, None, r.choice([*fns, *ruled, gone[0]])))
                elif what:
                    out.args.append((f, call, target, what, pos, r.choice([1, 2]) if what == "arg" else None, None))


def evaluate(w, mode):
    """{id: (level, at_least, labels of what is left)} by plain closures."""
    if mode == "both":
        a, b = evaluate(w, "effects"), evaluate(w, "termination")
        both = {}
        for f in a.keys() | b.keys():
            x, y = a.get(f, (0, False, set())), b.get(f, (0, False, set()))
            level = max(x[0], y[0])
            both[f] = (level, level < 3 and (x[1] or y[1]), set() if level == 3 else x[2] | y[2])
        return both
    ends = mode == "termination"
    table = {f: (0 if ends else n or 0, low) for f, (n, low) in w.functions.items()}
    deps = list(w.deps)
    used = {t for _, _, k, t, _ in deps if t and k in ("remote", "local", "primop", "erl")} | {x[6] for x in w.args if x[3] == "fn"}
    used |= {t for f in used & w.rules.keys() for t in w.rules[f][3]}
    for f in used & w.rules.keys():
        n, low, positions, targets = w.rules[f]
        table[f] = (0 if ends else n, low)
        deps = [x for x in deps if x[0] != f] + [(f, 0, "arg", None, p) for p in positions] + [(f, 0, "remote", t, None) for t in targets]
    table |= {f: (n, False) for f, n in PREDEFINED[mode].items()}
    # higher-order calls, at the fixpoint
    own = {}
    for f, _, k, _, p in deps:
        if k == "arg":
            own.setdefault(f, set()).add(p)
    calls = {(f, c, t) for f, c, k, t, _ in deps if k in ("remote", "local") and t}
    passed = lambda call, kind, at: [x for x in w.args if x[:3] == call and x[3] == kind and x[4] in at]
    open_calls = lambda: [c for c in calls if c[2] in own and sum(x[6] not in own or x[6] == c[2] for x in passed(c, "fn", own[c[2]])) != len(own[c[2]])]
    while True:
        grown = [(c[0], x[5]) for c in open_calls() for x in passed(c, "arg", own[c[2]]) if x[5] not in own.get(c[0], ())]
        if not grown:
            break
        for f, p in grown:
            own.setdefault(f, set()).add(p)
    unknown = {c[0] for c in open_calls() if len({x[4] for x in passed(c, "arg", own[c[2]])}) < len(own[c[2]])}
    edges = {}
    for f, _, k, t, _ in deps:
        if k != "arg" and t != f:
            edges.setdefault(f, set()).add(t if t and k in ("remote", "local", "primop", "erl") else "undefined")
    for x in w.args:  # by what is called and handed over, whichever call it is
        if x[3] == "fn" and x[4] in own.get(x[2], ()) and x[6] != x[0]:
            edges.setdefault(x[0], set()).add(x[6])
    reach = {}
    for f in table.keys() | edges.keys():
        seen, todo = set(), [f]
        while todo:
            for t in edges.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[f] = seen
    start = {f for f, (n, _) in table.items() if n == 3}
    if ends:
        for f in {x[0] for x in w.deps if x[3] == x[0]}:
            mine = {x[1] for x in w.deps if x[0] == x[3] == f}
            if not any(all((f, c, f, "sub", p) in {x[:5] for x in w.args} for c in mine) for p in (1, 2)):
                start.add(f)
        start |= {f for f in reach if f in reach[f]}
    worst = {f for f in reach if f in start or reach[f] & start}
    open_ = {f for f in reach if f not in worst and (reach[f] - table.keys())}
    high = {f: 3 if f in worst else max(table[x][0] for x in (reach[f] & table.keys()) | {f}) for f in table}
    low = {f for f in table if table[f][1]} | unknown
    out = {}
    for f, (n, _) in table.items():
        level, left = high[f], set()
        if f in open_:
            direct = edges.get(f, set())
            level = max([n, *(high[t] for t in direct if t in table and t not in open_)])
            left = {t for t in direct if t not in table or t in open_}
        if level < 3:
            left |= {str(p) for p in own.get(f, ())}
        out[f] = (level, level < 3 and (f in low or bool(reach[f] & low)), left)
    return out


@pytest.fixture(scope="module")
def worlds():
    r, w = random.Random(11), World()
    for i in range(400):
        random_world(r, f"w{i}", w)
    return w


@pytest.fixture(scope="module")
def tables(spark, worlds):
    named = lambda f: (f, "mfa", f.split(":")[0], f.split(":")[1].split("/")[0], int(f[-1]))
    functions = [(*named(f), n, low) for f, (n, low) in worlds.functions.items()]
    deps = [(f, c, k, t, p, None) for f, c, k, t, p in worlds.deps]
    args = [(*x, None) for x in worlds.args]
    rules = [(*named(f), n, low, [("arg", None, p) for p in at] + [("remote", t, None) for t in targets]) for f, (n, low, at, targets) in worlds.rules.items()]
    return spark.createDataFrame(functions, L.FUNCTIONS), spark.createDataFrame(deps, L.DEPS), spark.createDataFrame(args, L.DEP_ARGS), spark.createDataFrame(rules, L.FUNCTIONS + ", deps " + L.RULES.split("deps ")[1])


@pytest.mark.parametrize("mode", ["effects", "termination", "both"])
def test_random_graphs(worlds, tables, mode):
    want = evaluate(worlds, mode)
    got = {r.fn_id: (r.level, r.at_least, {str(d.arg_pos) if d.dep_kind == "arg" else d.target_id for d in r.deps}) for r in P.propagate(*tables, mode).collect()}
    assert got.keys() == want.keys()
    wrong = {f: (got[f], want[f]) for f in want if got[f] != want[f]}
    assert not wrong, dict(list(wrong.items())[:5])
    assert len({v[0] for v in want.values()}) == (2 if mode == "termination" else 4) and any(v[1] for v in want.values()) and any(v[2] for v in want.values())


def test_rule_lines(spark):
    """Lines put together from the grammar: module (primitive operations have none), name, arity, level, what is left."""
    r, lines, want = random.Random(5), [], {}
    for i in range(300):
        module, name, arity = r.choice([None, "alpha", "beta_2"]), f"op{i}", r.randint(0, 9)
        level, low, places = r.choice("peds"), r.random() < 0.3, r.choice([[], [], [1], [1, 3]])
        word = lambda x: f"'{x}'" if r.random() < 0.5 else x
        line = ",".join([*([word(module)] if module else []), word(name), str(arity)]) + r.choice([" ", "\t", "    "]) + (">= " if low else "") + level
        line += f" [{','.join('{arg,%d}' % p for p in places)}]" if places else ""
        key = f"{module}:{name}/{arity}" if module else f"{name}:/{arity}"
        shape = r.choices(["rule", "comment", "no level"], [8, 1, 1])[0]
        lines.append({"rule": line, "comment": "# " + line, "no level": line.split("\t")[0].split(" ")[0]}[shape])
        if shape == "rule":
            want[key] = ("mfa" if module else "primop", "peds".index(level), low, places)
    got = facts.parse_rules(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "file_rank int, line_no long, value string"))
    assert {x.fn_id: (x.kind, x.level, x.at_least, [d.arg_pos for d in x.deps]) for x in got.collect()} == want


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("e", "g")], "src string, dst string")
    assert dict(C.components(e).collect()) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "g"}
    assert sorted(r.node for r in C.cyclic(e).collect()) == list("abcdef")
    assert C.independent_components(e).count() == 0


def test_labels_rise_to_the_greatest(spark):
    """A label that comes later over a longer way replaces a smaller one that was there before."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("d", "a"), ("q", "r"), (None, "a")], "src string, dst string")
    seeds = spark.createDataFrame([("x", 1), ("d", 3), ("r", 2), (None, 4)], "node string, label int")
    assert dict(graph.highest(edges, seeds).collect()) == {"x": 1, "a": 3, "b": 3, "c": 3, "d": 3, "r": 2, "q": 2}
    assert graph.highest(edges.limit(0), seeds).count() == 3


def test_patterns_of_many_steps(spark):
    """150 pattern steps lead from the parameter to the variable of the self-call."""
    steps = spark.createDataFrame([("f", f"v{i}", f"v{i - 1}") for i in range(1, 151)], "fn_id string, var string, of_var string")
    params = spark.createDataFrame([("f", "v0", 2)], "fn_id string, var string, pos int")
    calls = spark.createDataFrame([("f", 1, "v150", 2), ("f", 2, "v150", 1), ("f", 3, "w", 2)], "fn_id string, call_id int, var string, pos int")
    few = steps.where("var IN ('v1', 'v2', 'v3')")
    last = calls.withColumn("var", F.regexp_replace("var", "v150", "v3"))
    for rows, own, bound in ((steps, calls, 1000), (few, last, 0)):  # in a task, and by rounds
        assert [(r.call_id, r.kind, r.pos) for r in J.reduced_args(own, rows, params, bound).collect()] == [(1, "sub", 2)]
    assert J.reduced_args(calls, steps.limit(0), params).count() == 0
