from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import jsonrepair, symbolic
from lemmaflow.functions import text as T
from lemmaflow.operators import critics, graph, linear, nodeproof, normalize, schema, verdict, verifyall
from lemmaflow.sources import artifacts
from lemmaflow.streaming.verify import verify_stream

NODES = "proof_id string, id string, node_type string, covers array<string>"
INFS = "proof_id string, id string, deps array<string>, conclusion string, rules array<string>"


@pytest.fixture(scope="module")
def proof(spark):
    nodes = spark.createDataFrame([("p", "A1", "assumption", []), ("p", "L1", "lemma", []), ("p", "G1", "goal", ["O1", "O2"])], NODES)
    infs = spark.createDataFrame([("p", "I1", ["A1"], "L1", ["chain_rule"]), ("p", "I2", ["A1", "L1"], "G1", ["algebra"])], INFS)
    return nodes, infs


def test_valid_graph_has_no_errors(proof):
    nodes, infs = proof
    g = graph.graphs(nodes, infs)
    assert graph.duplicate_ids(nodes).count() == graph.dangling(nodes, infs).count() == graph.orphans(nodes, infs).count() == 0
    assert graph.closure_misses(g).count() == 0
    assert not graph.with_cycle(g).first()["cyclic"]


def test_mutations(spark, proof):
    nodes, infs = proof
    back = infs.union(spark.createDataFrame([("p", "I3", ["G1"], "L1", ["x"])], INFS))
    assert graph.with_cycle(graph.graphs(nodes, back)).first()["cyclic"]
    loop = spark.createDataFrame([("p", "I1", ["A1"], "A1", ["x"])], INFS)
    assert graph.with_cycle(graph.graphs(nodes.limit(1), loop)).first()["cyclic"]
    assert graph.duplicate_ids(nodes.union(nodes.filter("id = 'L1'"))).count() == 1
    without = nodes.filter("id <> 'L1'")
    assert {(r.role, r.missing) for r in graph.dangling(without, infs).collect()} == {("conclusion", "L1"), ("dep", "L1")}
    assert [r.id for r in graph.closure_misses(graph.graphs(nodes, infs.filter("id = 'I1'"))).collect()] == ["G1"]
    assert {r.id for r in graph.closure_misses(graph.graphs(nodes, infs.limit(0))).collect()} == {"L1", "G1"}
    assert graph.rules_not_allowed(infs, ["chain_rule"]).count() == 1
    assert graph.rules_not_allowed(infs, []).count() == 0


def test_coverage_severity(spark, proof):
    nodes, _ = proof
    p = spark.createDataFrame([("p",)], "proof_id string")
    assert graph.uncovered(nodes, p, ["O1", "O2"]).count() == 0
    assert [r.severity for r in graph.uncovered(nodes, p, ["O1", "O3"]).collect()] == ["high"]
    assert [r.severity for r in graph.uncovered(nodes.withColumn("covers", F.expr("cast(array() as array<string>)")), p, ["O1"]).collect()] == ["medium"]


def test_declarations_follow_inferences_in_any_order(spark):
    nodes = spark.createDataFrame([("p", "N3", []), ("p", "N2", []), ("p", "N1", ["k"])], "proof_id string, id string, declares array<string>")
    infs = spark.createDataFrame([("p", "b", ["N2"], "N3", ["r"]), ("p", "a", ["N1"], "N2", ["r"])], INFS)
    assert {r.id: r.names for r in graph.declared(nodes, infs).collect()} == {"N1": ["k"], "N2": ["k"], "N3": ["k"]}


GOLDEN = [
    ('{"a": 1}', {"a": 1}),
    ('Here it is: {"a": 1} done', {"a": 1}),
    ('{ oops {"a": 1}', {"a": 1}),
    ('{"a": 1, "b":', {"a": 1}),
    ('{"a": 1, "b', {"a": 1}),
    ('{"a": 1, "b"', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('{ {"a": 1} }', {"a": 1}),
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": 1,}', {"a": 1}),
    ('{"a": "x)', {"a": "x"}),
    ('{"goal": "Eq(f(c), N)"}', {"goal": "Eq(f(c), N)"}),
    ('｛"a"： 1｝', {"a": 1}),
    ('{"Proof ID": "p", "a-b": True}', {"proof_id": "p", "a_b": True}),
    ('{"t": "\\(x\\)"}', {"t": "(x)"}),
    ("no object", None),
    (None, None),
    ("", None),
]


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_json_repair(text, expected):
    assert jsonrepair.parse(text) == expected


def test_json_long_and_deep(spark):
    """Time grows with the length, depth kills no job."""
    import time

    began = time.perf_counter()
    assert jsonrepair.parse("{" * 50_000) == {}
    assert jsonrepair.parse('{"a":' * 20_000) is not None
    assert time.perf_counter() - began < 10
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = spark.createDataFrame([(1, deep), (2, '{"K": 1'), (3, '{"k": 1, "t": "a: b"}'), (4, "[1]")], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", jsonrepair.parsed("t").alias("j")).collect()}
    assert got[2] == '{"k":1}' and json.loads(got[3]) == {"k": 1, "t": "a: b"} and got[4] == "[1]"


@pytest.mark.parametrize("text,expected", [('{"a": 1}', {"a": 1}), ('x {"a": {"b": 2}} y', {"a": {"b": 2}}), ('{"a": 1,}', {"a": 1}), ("none", None), ('{"a":[1', None)])
def test_flat_json(text, expected):
    assert jsonrepair.extract_flat(text) == expected


CLAIMS = [
    ("d/dx sin(x^2) = 2*x*cos(x^2)", "derivative", True),
    ("d/dx sin(x^2) = cos(x^2)", "derivative", False),
    ("(x+1)^2 = x^2 + 2*x + 1", "equation", True),
    ("x^2 = x", "equation", False),
    ("x >= 0", "equation", False),
    ("lim x -> 0 sin(x)/x = 1", "limit", True),
    ("integral(2*x, x) = x^2", "integral", True),
    ("integral(2*x, x) = x^3", "integral", False),
    ("Integrate(2*x,(x,0,1)) = 1", "integral", True),
    ("integral(x^2, (x, 0, 3)) = 8", "integral", False),
    ("integral 2*x dx = x^2 + C", "integral", True),
    ("∫ cos(t) dt = sin(t)", "integral", True),
    ("d/dtheta sin(theta) = cos(theta)", "derivative", True),
    ("f(x) = f(x)", "equation", True),
    ("f(x) = g(x)", "equation", False),
    ("sec(x) = 1/cos(x)", "equation", True),
    ("d/dx f(x)^2 = 2*f(x)", "derivative", False),
    ("lim x -> oo 1/x = 0", "limit", True),
    ("lim x -> oo x^2 = oo", "limit", True),
    ("lim x -> 0 1/x = 0", "limit", False),
    ("lim x -> 1 (x^2-1)/(x-1) = 2", "limit", True),
    ("so d/dx x = 1", None, None),
    ("__import__('os').getcwd() = 1", "equation", False),
    ("the function is continuous", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("claim,kind,holds", CLAIMS)
def test_symbolic(claim, kind, holds):
    assert symbolic.check(claim) == (kind, holds)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, "d/dx sin(x^2) = 2*x*cos(x^2)", T.normalized_math("x")) == "d/dxsin(x2)=2xcos(x2)"
    assert one(spark, "f'(x) ∘ g", T.normalized_math("x")) == "fprime(x)og"
    assert one(spark, "Eq(alpha, beta_1) + sin(x)", T.symbols("x")) == ["alpha", "beta_1", "x"]
    assert one(spark, "It is Trivially so", T.vague_terms("x", T.VAGUE_FLAT)) == ["trivially", "trivial"]
    assert one(spark, "Prove the Mean Value Theorem now", T.named_theorems("x")) == ["mean value theorem"]


def test_schema(spark):
    good = {"proof_id": "p", "nodes": [{"id": "A", "node_type": "goal", "claim": "c", "status": "planned"}], "inferences": []}
    bad = json.loads(json.dumps(good))
    bad["nodes"][0]["status"] = "proof_failed"
    del bad["nodes"][0]["id"]
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "{"), (4, "[]")], "k int, a string")
    got = {(r.k, r.path, r.problem) for r in schema.violations(rows, "k", "a", schema.GRAPH).collect()}
    assert got == {(2, "nodes.0.id", "required"), (2, "nodes.0.status", "enum"), (3, "", "json"), (4, "", "json")}


def test_tidied_graph(spark):
    kind = "proof_id string, goal_node_id string, nodes array<struct<id:string,node_type:string>>, inferences array<struct<id:string,conclusion_node:string,premise_nodes:array<string>,side_condition_nodes:array<string>>>"
    g = spark.createDataFrame([("p", "X", [("A1", "assumption"), ("G1", "goal")], [("I1", "nowhere", ["A1", "gone", "G1"], [])])], kind)
    r = normalize.tidied_graph(g).first()
    assert r.goal_node_id == "G1" and r.inferences[0].conclusion_node == "G1" and r.inferences[0].premise_nodes == ["A1"]


def test_fallback_graph(spark):
    kind = "proof_id string, goal string, assumptions array<struct<id:string,statement:string>>, refs array<string>, terms array<string>"
    rows = [
        ("p", "g", [("H", "a"), (None, "b")], ["z", " y ", " ", "x"], []),
        ("p", None, None, None, ["LIMIT"]),
        ("my_mean_value_theorem_1", "g", [], [" "], []),
        ("other", "g", [], [], []),
    ]
    got = [r for r in normalize.fallback_graph(spark.createDataFrame(rows, kind)).collect()]
    assert [x.id for x in got[0].nodes] == ["H", "A2", "G1"] and got[0].nodes[2].claim == "g" and got[0].inferences[0].premise_nodes == ["H", "A2"]
    assert [list(r.inferences[0].rule_refs) for r in got] == [["z", "y"], ["limit_rule"], ["mean_value_theorem"], ["assumption_use"]]
    assert got[1].nodes[0].claim == "Prove the goal"


def test_flat_proof(spark):
    steps = spark.createDataFrame([("p", "S1", "", "by rule", ["S9"]), ("q", "S1", "a", " ", []), ("q", "S2", "clearly b", "by the Mean Value Theorem", ["S1"])], "proof_id string, step_id string, statement string, justification string, refs array<string>")
    proofs = spark.createDataFrame([("p", "x", "limit exists", "limit exists"), ("q", "Prove the Mean Value Theorem", "alpha beta gamma delta", "nothing"), ("r", "x", "g", "c")], "proof_id string, problem string, goal string, conclusion string")
    errors = linear.verify(steps, proofs)
    got = {(r.proof_id, r.check) for r in errors.collect()}
    assert got == {("p", "empty_statement"), ("p", "unknown_ref"), ("p", "one_step"), ("q", "empty_justification"), ("q", "vague"), ("q", "circular"), ("q", "overlap"), ("r", "no_steps")}
    assert not any(r.accepted for r in linear.accepted(proofs, errors).collect())


def test_gate_and_ids(spark):
    e = spark.createDataFrame([("p", "json_schema", 1, "high", True), ("p", "structural", 2, "high", True), ("q", "structural", 2, "low", False)], "proof_id string, source string, ord int, severity string, blocking boolean")
    assert verdict.after_schema_gate(e).count() == 2
    assert {r.error_id for r in verdict.with_error_ids(e, ["ord"]).filter("proof_id = 'p'").collect()} == {"E1", "E2"}


def test_stages_resume(spark, tmp_path):
    calls = []

    def stage(name):
        def f(s, t):
            calls.append(name)
            return s.range(2) if t is None else t.withColumn(name, F.lit(1))

        return name, f

    stages = [stage("a"), stage("b"), stage("c")]
    artifacts.staged_run(spark, stages, str(tmp_path), stop_after="b")
    assert artifacts.load_stage(spark, f"{tmp_path}/c") is None
    assert artifacts.staged_run(spark, stages, str(tmp_path), start_from="c").columns == ["id", "b", "c"]
    assert calls == ["a", "b", "c"] and artifacts.problems(spark).count() == 3 and artifacts.theorems(spark).count() == 29


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    verify_stream(stream, lambda b: b.filter("id % 2 = 0"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_critics(spark):
    rows = [
        ("a", '{"pass": true, "issues": []}'),
        ("b", '{"pass": false, "issues": [{"message": "no case x<0", "severity": "odd", "node_id": "N7"}]}'),
        ("c", '{"pass": false}'),
        ("d", "no json at all"),
        ("e", '```json\n{"issues": ["text only"]}\n```'),
        ("f", '{"issues": "wrong"}'),
    ]
    r = spark.createDataFrame([(k, "I1", "G1", t) for k, t in rows], "proof_id string, inference_id string, node_id string, text string")
    got = {x.proof_id: (x.severity, x.blocking, x.node_id, x.claim) for x in critics.case_coverage(r).collect()}
    assert got["b"] == ("medium", False, "N7", "no case x<0") and got["c"][0] == "medium" and got["d"][0] == got["f"][0] == "low"
    assert got["e"][3] == "text only" and "a" not in got
    assert {x.severity for x in critics.theorem_applicability(r.filter("proof_id = 'c'")).collect()} == {"high"}


def test_node_proofs_and_inferences(spark, proof):
    kind = "proof_id string, id string, node_type string, claim string, claim_formal string, statements array<string>"
    rows = [("p", "A", "assumption", "c", None, []), ("p", "B", "lemma", "x = 1", None, ["so x=1"]), ("p", "C", "lemma", "x = 1", None, ["other"]), ("p", "D", "lemma", "c", "y=2", ["", "y=2"]), ("p", "E", "lemma", "c", None, None)]
    got = {r.id: r.problem for r in nodeproof.node_proofs(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"C": "not_concluded", "D": "blank_statement", "E": "no_steps"}
    nodes, _ = proof
    infs = spark.createDataFrame([("p", "1", ["A1"], "X", ["r"]), ("p", "2", ["Y", "Z"], "L1", []), ("p", "3", ["A1"], "L1", []), ("p", "4", ["A1"], "L1", ["r"])], INFS)
    assert {(r.inference_id, r.problem, r.missing) for r in nodeproof.inference_problems(nodes, infs).collect()} == {("1", "no_conclusion", "X"), ("2", "no_dependency", "Y"), ("2", "no_dependency", "Z"), ("3", "no_rules", None)}


def test_annotated(spark):
    kind = "proof_id string, goal string, nodes array<struct<id:string,source:boolean,covers:array<string>>>, infs array<struct<id:string,deps:array<string>,conclusion:string,rules:array<string>>>, obligations array<string>, blocked_nodes array<string>, blocked_infs array<string>, n_blocking long"
    nodes = [("A", True, []), ("L", False, []), ("G", False, ["O1"])]
    infs = [("I1", ["A"], "L", ["r"]), ("I2", ["L"], "G", ["r"])]
    rows = [("ok", "G", nodes, infs, ["O1", "O2"], [], [], 0), ("bad", "G", nodes, infs, ["O1"], ["L"], [], 1), ("none", "G", [], [], ["O1"], [], [], 0), ("inf", "G", nodes, infs, ["O1"], [], ["I2"], 1)]
    got = {r.proof_id: r for r in verdict.annotated(spark.createDataFrame(rows, kind)).collect()}
    assert got["ok"].accepted and got["ok"].failed_obligations == []
    assert not got["bad"].accepted and got["bad"].verified_nodes == ["A"] and got["bad"].verified_infs == ["I1"] and got["bad"].failed_infs == ["I2"]
    assert not got["none"].accepted and got["inf"].failed_infs == ["I2"] and got["inf"].verified_nodes == ["A", "L"]


@pytest.mark.parametrize("text,context,fails", [("x = x", "", False), ("x = 1", "", True), ("f(x)^2 = f(x)*f(x)", "", False), ("f(x) = g(x)", "", True), ("sqrt(x^2) = x", "x positive", False), ("sqrt(x^2) = x", "", True), ("x = y", "", False), ("x >= 0", "", True), (None, "", False)])
def test_counterexample(text, context, fails):
    assert (symbolic.counterexample(text, "", context) is not None) == fails


def test_counterexample_points():
    """Assumptions choose sample functions, the domain alone chooses points."""
    assert symbolic.counterexample("sqrt(x^2) = x", "x is positive", "") and not symbolic.counterexample("sqrt(x^2) = x", "", "x 為正數")
    assert not symbolic.counterexample("abs(f(x)) = f(x)", "f is positive") and symbolic.counterexample("abs(f(x)) = f(x)")
    assert symbolic.counterexample("x/x*0 = x*0+1", "", "x不為0") and not symbolic.counterexample("x^0 = 1", "", "nonzero")


ARTIFACT = f"""proof_id string, problem struct<goal:struct<text:string,symbolic:string>,assumptions:array<struct<id:string,statement:string>>,hidden_conditions:array<struct<id:string,statement:string>>,variables:array<struct<symbol:string>>,domain:map<string,string>>,
contract struct<obligations:array<struct<id:string>>,allowed_references:array<string>,forbidden_moves:array<string>>, graph struct<goal_node_id:string,nodes:array<{verifyall.NODE}>,inferences:array<{verifyall.INFERENCE}>>, schema_errors array<string>, critic_errors array<{verifyall.ERROR}>"""
CLAIM = "d/dx sin(x^2) = 2*x*cos(x^2)"


def body(*said, reason="by rule", refs=()):
    return dict(format="steps", steps=[dict(statement=s, reason=reason, refs=list(refs)) for s in said])


def artifact(name, change=None):
    """A proof that is accepted, as lists that a mutation changes: (proof_id, problem, contract, graph, schema_errors, critic_errors)."""
    node = lambda i, kind, claim, formal=None, covers=(), said=(): dict(id=i, node_type=kind, status="source" if kind == "assumption" else "proven", claim=claim, claim_formal=formal, covers_obligations=list(covers), proof_body=body(*said), declarations=None)
    inf = lambda i, deps, to, rules: dict(id=i, premise_nodes=deps, side_condition_nodes=[], conclusion_node=to, rule_refs=rules, instantiation=None, declarations=None)
    problem = dict(goal=dict(text=CLAIM, symbolic=CLAIM), assumptions=[dict(id="A1", statement="x is real")], hidden_conditions=[], variables=[dict(symbol="x")], domain={})
    contract = dict(obligations=[dict(id="O1"), dict(id="O2")], allowed_references=["chain_rule", "algebra"], forbidden_moves=["circular reasoning"])
    nodes = [node("A1", "assumption", "x is real"), node("L1", "lemma", "u = x^2 is smooth", said=["so u = x^2 is smooth"]), node("G1", "goal", CLAIM, CLAIM, ["O1", "O2"], ["hence", CLAIM])]
    d = dict(proof_id=name, problem=problem, contract=contract, graph=dict(goal_node_id="G1", nodes=nodes, inferences=[inf("I1", ["A1"], "L1", ["chain_rule"]), inf("I2", ["A1", "L1"], "G1", ["algebra"])]), schema_errors=[], critic_errors=[])
    if change:
        change(d, d["graph"]["nodes"], d["graph"]["inferences"])
    return d


MUTATIONS = {
    "ok": (None, set()),
    "schema": (lambda d, n, f: d.update(schema_errors=["goal"], graph=dict(goal_node_id=None, nodes=[], inferences=[])), {("json_schema", "goal")}),
    "no goal": (lambda d, n, f: d["graph"].update(goal_node_id=None), {("structural", "Goal node must exist.")}),
    "twice": (lambda d, n, f: n.append(dict(n[1])), {("structural", "Node ids must be unique.")}),
    "source": (lambda d, n, f: n[1].update(status="source"), {("structural", "A source must be an assumption or an allowed reference.")}),
    "cycle": (lambda d, n, f: f.append(dict(f[1], id="I3", premise_nodes=["G1"], conclusion_node="L1")), {("structural", "Proof graph must be DAG.")}),
    "rule": (lambda d, n, f: f[0].update(rule_refs=["magic"]), {("structural", "Not in allowed references: magic")}),
    "forbidden": (lambda d, n, f: (f[0].update(rule_refs=["circular"]), d["contract"].update(allowed_references=[])), {("structural", "Forbidden: circular")}),
    "vague": (lambda d, n, f: n[1]["proof_body"]["steps"].extend(body("Clearly so")["steps"]), {("structural", "Vague: clearly")}),
    "vague reason": (lambda d, n, f: n[1].update(proof_body=body("so u = x^2 is smooth", reason="obviously")), {("structural", "Vague: obvious")}),
    "cited in refs": (lambda d, n, f: (d["problem"].update(assumptions=[dict(id="H7", statement="never")]), n[1].update(proof_body=body("so u = x^2 is smooth", refs=["H7"]))), set()),
    "undeclared": (lambda d, n, f: n[1].update(claim_formal="u = u", proof_body=body("u = u")), {("structural", "claim_formal uses undeclared: u")}),
    "declared before": (lambda d, n, f: (n[1].update(claim_formal="u = u", proof_body=body("u = u")), n[0].update(declarations=["u"])), set()),
    "instantiation": (lambda d, n, f: f[1].update(instantiation={"f": "w"}), {("structural", "f uses undeclared: w")}),
    "uncovered": (lambda d, n, f: n[2].update(covers_obligations=["O1"]), {("structural", "Obligation must be covered: O2")}),
    "no coverage": (lambda d, n, f: n[2].update(covers_obligations=None), {("structural", "Obligation must be covered: O1"), ("structural", "Obligation must be covered: O2")}),
    "orphan": (lambda d, n, f: f.pop(0), {("structural", "Non-source node has no incoming inference."), ("inference_closure", "No verified inference proves this node.")}),
    "no steps": (lambda d, n, f: n[1].update(proof_body=None), {("node_proof", "no steps")}),
    "other step": (lambda d, n, f: n[1].update(proof_body=body("x")), {("node_proof", "claim not concluded")}),
    "wrong": (lambda d, n, f: n[1].update(claim_formal="x = 1", proof_body=body("x = 1")), {("symbolic", "equation does not hold")}),
    "missing": (lambda d, n, f: f[0].update(premise_nodes=["Z"]), {("structural", "Referenced node must exist."), ("inference_verifier", "Dependency is missing: Z")}),
    "no rule": (lambda d, n, f: f[0].update(rule_refs=[]), {("inference_verifier", "rule_refs is empty.")}),
    "unused": (lambda d, n, f: d["problem"].update(assumptions=[dict(id="H7", statement="never")]), {("critic", "Assumption may be unused: H7")}),
    "hidden": (lambda d, n, f: d["problem"].update(hidden_conditions=[dict(id="H8", statement="compact")]), {("critic", "Hidden condition may be unchecked: H8")}),
    "domain": (lambda d, n, f: d["problem"].update(domain={"zz": "positive"}), {("critic", "Domain constraint may be unchecked: zz")}),
    "critic": (lambda d, n, f: d.update(critic_errors=[dict(source="critic", node_id="G1", inference_id="I2", severity="high", message="m", blocking=True)]), {("critic", "m")}),
}
ACCEPTED = {"ok", "vague reason", "cited in refs", "no coverage", "vague", "declared before", "unused", "hidden", "domain"}


def test_all_verifiers(spark):
    rows = spark.createDataFrame([artifact(k, change) for k, (change, _) in MUTATIONS.items()], ARTIFACT)
    result = verifyall.verified(rows).cache()
    got = {k: set() for k in MUTATIONS}
    for r in verifyall.error_rows(result).collect():
        got[r.proof_id].add((r.source, r.message))
    for k, (_, want) in MUTATIONS.items():
        assert want <= got[k] and (want or not got[k]), (k, got[k])
    # Besides its own errors, a mutation shows in what follows from them only.
    after = {("inference_closure", "No verified inference proves this node.")}
    assert all(got[k] - want <= after for k, (_, want) in MUTATIONS.items() if k not in ("wrong", "twice", "cycle")), got
    done = {r.proof_id: r for r in result.collect()}
    assert {k for k, r in done.items() if r.accepted} == ACCEPTED
    assert done["ok"].obligation_status == {"O1": "pass", "O2": "pass"} and set(done["ok"].node_status.values()) == {"verified"}
    # Critics' rows about inferences come behind the context's, the others before.
    order = artifact("o", lambda d, n, f: (d["problem"].update(domain={"zz": "positive"}), d.update(critic_errors=[dict(source="critic", node_id=None, inference_id=i, severity="low", message=m, blocking=False) for i, m in (("I1", "theorem"), (None, "case"))])))
    assert [r.message for r in verifyall.error_rows(verifyall.verified(spark.createDataFrame([order], ARTIFACT))).orderBy("error_id").collect()] == ["case", "Domain constraint may be unchecked: zz", "theorem"]
    assert done["critic"].inference_status == {"I1": "verified", "I2": "failed"} and done["no steps"].node_status == {"A1": "verified", "L1": "failed", "G1": "failed"}


def test_claims_are_tested_in_narrow_rows(spark):
    """A row that waits for Python holds its claims, not the proof; proofs of one id, or of none, keep their own results."""
    wrong = lambda d, n, f: n[1].update(claim_formal="x = 1", proof_body=body("x = 1"))
    rows = [artifact("p", wrong), artifact("p"), artifact("p", wrong), artifact(None, wrong), artifact(None)]
    result = verifyall.verified(spark.createDataFrame(rows, ARTIFACT))
    found = sorted((str(r.proof_id), sum(e.source == "symbolic" for e in r.errors)) for r in result.collect())
    want = 1 + bool(symbolic.counterexample("x = 1", "", "{}"))
    assert found == sorted([("p", want), ("p", 0), ("p", want), ("None", want), ("None", 0)])
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    python = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert python and not any("contract" in line or "critic_errors" in line for line in python)
    below = plan.split("ArrowEvalPython")[1:]
    assert not any("Generate inline" in part.split("LogicalRDD")[0].split("LocalRelation")[0] for part in below)


def test_all_verifiers_of_texts(spark):
    """Artifacts as JSON text: schema violations in order stop the other checks; declarations may be names or objects."""
    def texts(name, change=None, cut=None):
        d = artifact(name, change)
        d["problem"] |= dict(problem_id="p", raw_problem="r")
        d["contract"] |= dict(goal={}, obligations=[dict(o, description="d", status="pending") for o in d["contract"]["obligations"]])
        d["graph"] |= dict(proof_id=name)
        for f in d["graph"]["inferences"]:
            f |= dict(relation="proves", status="planned", instantiation=f["instantiation"] or {})
            f.pop("declarations")
        for n in d["graph"]["nodes"]:
            for k in ("claim_formal", "proof_body", "declarations"):
                if n[k] is None:
                    n.pop(k)
        row = [name, json.dumps(d["problem"]), json.dumps(d["contract"]), json.dumps(d["graph"])]
        if cut:
            cut(row)
        return tuple(row)

    declare = lambda *names: lambda d, n, f: (n[1].update(claim_formal="u = u", proof_body=body("u = u")), n[0].update(declarations=list(names)))
    rows = [
        texts("ok"),
        texts("object", declare({"symbol": "u"}, 7)),
        texts("name", declare("u", "two words")),
        texts("undeclared", declare("two words", {"name": "u"})),
        texts("schema", lambda d, n, f: (n[0].update(status="odd"), n[1].pop("claim"), d["contract"].update(allowed_references=["r", 5]))),
        texts("cut", cut=lambda r: r.__setitem__(3, r[3][:-1])),
        texts("null", cut=lambda r: r.__setitem__(1, None)),
    ]
    out = verifyall.verified_texts(spark.createDataFrame(rows, "proof_id string, problem string, contract string, graph string")).collect()
    errors = {r.proof_id: [(e.source, e.message) for e in r.errors] for r in out}
    assert errors["ok"] == errors["object"] == errors["name"] == [] and {r.proof_id for r in out if r.accepted} == {"ok", "object", "name"}
    assert errors["undeclared"][0] == ("structural", "claim_formal uses undeclared: u")
    assert errors["schema"] == [("json_schema", "allowed_references.1: 5 is not of type 'string'"), ("json_schema", "nodes.0.status: 'odd' is not one of ['planned', 'proven', 'verified', 'failed', 'patched', 'source']"), ("json_schema", "nodes.1: 'claim' is a required property")]
    assert errors["cut"] == errors["null"] == [("json_schema", "<root>: no JSON")]


def test_repeated_claims_are_checked_once(monkeypatch):
    import pandas as pd

    seen = []
    monkeypatch.setattr(symbolic, "check", lambda t: (seen.append(t), ("equation", t == "a = a"))[1])
    long = "b = b" + " " * symbolic.KEPT
    got = symbolic._checked.func(pd.Series(["a = a", "a = b", None, "a = a", None, long, long]))
    assert got["holds"].tolist() == [True, False, False, True, False, False, False] and sorted(map(str, seen)) == sorted(["a = a", "a = b", "None", long, long])
