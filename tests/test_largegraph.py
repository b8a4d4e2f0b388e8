from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import graph, largegraph

NODES = "proof_id string, id string, node_type string, blocked boolean, declares array<string>"
INFERENCES = "proof_id string, id string, deps array<string>, conclusion string, blocked boolean, declares array<string>"


def brute_closure(nodes, inferences):
    source, blocked = {}, {}
    for p, i, t, b, _ in nodes:
        source[p, i] = source.get((p, i), False) or t in graph.SOURCE_TYPES
        blocked[p, i] = blocked.get((p, i), False) or bool(b)
    rules = [(p, set(deps or []), c) for p, _, deps, c, b, _ in inferences if not b and (p, c) in source and all((p, d) in source for d in deps or [])]
    users, left = defaultdict(set), [len(d) for _, d, _ in rules]
    for k, (p, deps, _) in enumerate(rules):
        for d in deps:
            users[p, d].add(k)
    todo = [n for n in source if source[n] and not blocked[n]] + [(p, c) for p, d, c in rules if not d and not blocked[p, c]]
    seen = set(todo)
    while todo:
        for k in users[todo.pop()]:
            left[k] -= 1
            n = rules[k][0], rules[k][2]
            if not left[k] and n not in seen and not blocked[n]:
                seen.add(n)
                todo.append(n)
    return seen, sum(d <= {i for q, i in seen if q == p} for p, d, c in rules) if len(rules) < 5000 else None


def random_graph(n, seed, layers=12, hub=True):
    """Layered, so derivations are as deep as the layers; a hub that a third of all inferences need; some blocked rows and gaps."""
    r = random.Random(seed)
    layer = lambda i: i * layers // n
    nodes, inferences = [], []
    for i in range(n):
        nodes.append(("g", f"n{i}", "assumption" if layer(i) == 0 else "lemma", r.random() < 0.01 or None, [f"s{r.randrange(6)}"] if r.random() < 0.02 else None))
        if layer(i):
            for j in range(r.choice((1, 1, 2))):
                lo, hi = (layer(i) - 1) * n // layers, layer(i) * n // layers
                deps = [f"n{r.randrange(lo, hi)}" for _ in range(r.choice((1, 1, 2, 3)))] + (["n0"] if hub and r.random() < 0.33 else [])
                if r.random() < 0.005:
                    deps.append("missing")
                inferences.append(("g", f"i{i}.{j}", deps, f"n{i}", r.random() < 0.05, [f"t{r.randrange(4)}"] if r.random() < 0.02 else None))
    nodes[0] = ("g", "n0", "assumption", None, None)
    return nodes, inferences


def test_closure_of_100_000_nodes(spark):
    nodes, inferences = random_graph(100_000, 1)
    n, i = spark.createDataFrame(nodes, NODES), spark.createDataFrame(inferences, INFERENCES)
    seen, _ = brute_closure(nodes, inferences)
    assert 20_000 < len(seen) < 95_000
    misses = {r.id for r in largegraph.closure_misses(n, i, hub=1000, salts=4).collect()}
    assert misses == {i for _, i, t, b, _ in nodes if t == "lemma" and not b and ("g", i) not in seen}


ODD_NODES = [
    ("a", "1", "assumption", None, ["x"]), ("a", "1", "assumption", False, ["x"]), ("a", "2", "lemma", None, None), ("a", "3", "lemma", True, ["y"]), ("a", "4", "lemma", None, []),
    ("b", "1", None, None, None), ("b", "2", "lemma", None, None), (None, "1", "assumption", None, None), ("b", None, "assumption", None, None),
]
ODD_INFERENCES = [
    ("a", "i1", ["1", "1"], "2", None, None), ("a", "i1", ["1", "1"], "2", None, None), ("a", "i2", ["2"], "3", None, ["z"]), ("a", "i3", ["3"], "4", None, None),
    ("a", "i4", ["9"], "2", None, None), ("b", "i1", [], "1", None, None), ("b", "i2", None, "2", None, None), ("b", "i3", ["1"], "9", None, None), ("b", None, ["1"], None, None, None),
]


def test_closure_of_odd_rows(spark):
    n, i = spark.createDataFrame(ODD_NODES, NODES), spark.createDataFrame(ODD_INFERENCES, INFERENCES)
    reached, fired = largegraph.closure(n, i)
    seen, count = brute_closure([x for x in ODD_NODES if x[0] and x[1]], ODD_INFERENCES)
    assert {(r.proof_id, r.id) for r in reached.dropna(subset=["proof_id", "id"]).collect()} == seen == {("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")}
    assert sorted((r.proof_id, r.conclusion) for r in fired.collect()) == [("a", "2"), ("a", "3"), ("b", "1"), ("b", "2")] and count == 5
    assert [tuple(r) for r in largegraph.closure_misses(n, i).collect()] == [("a", "4")]
    assert largegraph.closure_misses(n.limit(0), i.limit(0)).count() == 0 and largegraph.closure_misses(n, i.limit(0)).count() > 0


def test_same_as_folds(spark):
    rows = [random_graph(14, s, layers=5, hub=False) for s in range(30)]
    nodes = [(str(s), *x[1:]) for s, (ns, _) in enumerate(rows) for x in ns if not x[3]]
    inferences = [(str(s), *x[1:]) for s, (_, inf) in enumerate(rows) for x in inf if not x[4]]
    n, i = spark.createDataFrame(nodes, NODES), spark.createDataFrame(inferences, INFERENCES)
    folds = {tuple(r) for r in graph.closure_misses(graph.graphs(n, i)).collect()}
    assert folds == {tuple(r) for r in largegraph.closure_misses(n, i).collect()} and folds


def brute_unpeeled(edges):
    edges = set(edges)
    while True:
        us, vs = {u for u, _ in edges}, {v for _, v in edges}
        left = {(u, v) for u, v in edges if u in vs and v in us}
        if left == edges:
            return edges
        edges = left


def test_cycles_of_a_large_graph(spark):
    n = 40_000
    nodes, inferences = random_graph(n, 2, layers=8)
    edges = {(d, c) for _, _, deps, c, _, _ in inferences for d in deps}
    r = random.Random(3)
    back = {(f"n{r.randrange(n * 6 // 10, n)}", f"n{r.randrange(0, n * 4 // 10)}") for _ in range(1500)}
    df = spark.createDataFrame([("g", u, v) for u, v in edges | back] + [("h", u, v) for u, v in edges] + [("s", "x", "x"), ("s", "x", "y")], "proof_id string, u string, v string")
    rest = brute_unpeeled(edges | back)
    assert {(x.u, x.v) for x in largegraph.unpeeled(df).filter("proof_id = 'g'").collect()} == rest and rest
    found = largegraph.witness_cycles(df, hub=1000, salts=4).collect()
    assert [tuple(x) for x in found if x.proof_id == "s"] == [("s", 1, "x", "x")] and {x.proof_id for x in found} == {"g", "s"}
    cycle = [(x.u, x.v) for x in found if x.proof_id == "g"]
    to = {}
    for u, v in rest:
        to[v] = min(u, to.get(v, u))
    cycles = set()
    for v in to:
        path = {}
        while v not in path:
            path[v] = len(path)
            v = to[v]
        cycles.add(frozenset(x for x, k in path.items() if k >= path[v]))
    best = min(cycles, key=lambda c: (len(c), min(c)))
    assert {v for _, v in cycle} == best and all(to[v] == u for u, v in cycle) and {x.length for x in found if x.proof_id == "g"} == {len(best)}


def test_declared_symbols(spark):
    nodes, inferences = random_graph(3000, 4, layers=8)
    n, i = spark.createDataFrame(nodes, NODES), spark.createDataFrame(inferences, INFERENCES)
    have = {x[1]: set(x[4] or []) for x in nodes}
    for _ in range(9):
        for _, _, deps, c, _, own in inferences:
            have[c] |= set(own or []).union(*(have.get(d, set()) for d in deps))
    got = defaultdict(set)
    for r in largegraph.declared(n, i, hub=100, salts=3).collect():
        got[r.id].add(r.symbol)
    assert got == {k: v for k, v in have.items() if v}
    assert largegraph.declared(n.limit(0), i).count() == 0


def test_undeclared_by_kind(spark):
    proofs = spark.createDataFrame([("a", "u + x = 1", ["x"]), ("b", None, None)], "proof_id string, goal_symbolic string, base array<string>")
    nodes = spark.createDataFrame([("a", "1", ["y"], "y = x"), ("a", "2", None, "y = w"), ("a", "3", None, None), ("b", "1", None, "x = sin(q)")], "proof_id string, id string, declares array<string>, claim_formal string")
    inferences = spark.createDataFrame(
        [("a", "i", ["1"], "2", ["m"], {"k": "m + y + x", "l": "v + m", "n": None}), ("a", "j", None, "3", None, {"k": "y"}), ("a", None, ["2"], None, None, {"k": "m + o"})],
        "proof_id string, id string, deps array<string>, conclusion string, declares array<string>, instantiation map<string,string>",
    )
    got = sorted((tuple(r) for r in largegraph.undeclared(proofs, nodes, inferences).collect()), key=str)
    assert got == sorted([("a", "goal", None, None, "goal", "u"), ("a", "node", "2", None, "claim_formal", "w"), ("b", "node", "1", None, "claim_formal", "q"), ("b", "node", "1", None, "claim_formal", "x"), ("a", "inference", "2", "i", "l", "v"), ("a", "inference", "3", "j", "k", "y"), ("a", "inference", None, None, "k", "o")], key=str)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_ring(spark, n):
    edges = spark.createDataFrame([("r", str(i), str((i + 1) % n)) for i in range(n)] + [("r", "0", "tail")], "proof_id string, u string, v string")
    assert sorted((x.u, x.v) for x in largegraph.witness_cycles(edges).collect()) == sorted((str(i), str((i + 1) % n)) for i in range(n))


def test_small_and_large_graphs_have_the_same_witnesses(spark):
    r = random.Random(5)
    rows = [(g, f"n{r.randrange(9)}", f"n{r.randrange(9)}") for g in range(200) for _ in range(r.randrange(1, 12))] + [(None, "a", "a")]
    df = spark.createDataFrame(rows + rows[:50], "proof_id long, u string, v string")
    one_pass, rounds = ({tuple(x) for x in largegraph.witness_cycles(df, small=n).collect()} for n in (500, 0))
    assert one_pass == rounds and len({x[0] for x in rounds}) > 50


def test_rounds_move_only_what_is_new(spark):
    """In a round, edges, nodes and what is known are not shuffled: the plans' exchanges are over the rows that the round found."""
    stages = largegraph.Stages(spark, "trial")
    n = spark.createDataFrame([("g", f"n{i}", "lemma") for i in range(1000)], "proof_id string, id string, node_type string")
    known, number = largegraph.numbered(stages, n)
    edges, hubs = largegraph.numbered_edges(stages, known.select(F.col("h").alias("dep"), F.col("h").alias("k")), 10, 4)
    new, _ = stages.deal("reached", known.select("h").limit(10), "h")
    plan = largegraph.onward(new, edges, hubs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    assert known.join(new.hint("shuffle_hash"), "h")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
