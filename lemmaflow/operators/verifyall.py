"""All verifiers of graph proofs as one plan, a row per proof.

Input: proof_id, and typed nested columns
  problem   struct<goal:struct<text,symbolic>, assumptions and hidden_conditions:array<struct<id,statement>>, variables:array<struct<symbol>>, domain:map<string,string>>
  contract  struct<obligations:array<struct<id>>, allowed_references, forbidden_moves:array<string>>
  graph     struct<goal_node_id, nodes:array<NODE>, inferences:array<INFERENCE>>
  schema_errors   array<string> (paths of violations; any of them suppresses all further checks)
  critic_errors   array<ERROR> (rows of the critics' responses: those about an inference come behind the context's rows, the others before)
Null arrays and maps count as empty. Proofs are a few nodes, so every check is a fold over a row's arrays: no
shuffle, and only formal claims go to Python. A fixpoint takes as many steps as the proof is deep, each over all
inferences; for proofs of thousands of nodes use the joins of largegraph.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbolic
from ..functions.text import BUILTINS, VAGUE_GRAPH
from . import schema
from .graph import SOURCE_TYPES

PROOF = "struct<format:string,steps:array<struct<statement:string,reason:string,refs:array<string>>>>"
NODE = f"struct<id:string,node_type:string,status:string,claim:string,claim_formal:string,covers_obligations:array<string>,proof_body:{PROOF},declarations:array<string>>"
INFERENCE = "struct<id:string,premise_nodes:array<string>,side_condition_nodes:array<string>,conclusion_node:string,rule_refs:array<string>,instantiation:map<string,string>,declarations:array<string>>"
ERROR = "struct<source:string,node_id:string,inference_id:string,severity:string,message:string,blocking:boolean>"
NONE = "cast(array() as array<string>)"
SOURCES = "(" + ", ".join(f"'{t}'" for t in SOURCE_TYPES) + ")"


def error(source: str, node: str, inference: str, severity: str, message: str, blocking: str = "true") -> str:
    return f"named_struct('source', '{source}', 'node_id', cast({node} as string), 'inference_id', cast({inference} as string), 'severity', {severity}, 'message', {message}, 'blocking', {blocking})"


def when(condition: str, *errors: str) -> str:
    return f"if({condition}, array({', '.join(errors)}), cast(array() as array<{ERROR}>))"


def each(items: str, var: str, body: str) -> str:
    return f"transform({items}, {var} -> {body})"


def norm(text: str) -> str:
    """SQL of text.normalized_math."""
    x = f"translate(lower(coalesce({text}, '')), ' *', '')"
    return f"regexp_replace(replace(replace(replace({x}, '\\'', 'prime'), '′', 'prime'), '∘', 'o'), '[^a-z0-9_=()+/\\\\-]', '')"


def let(var: str, value: str, body: str) -> str:
    """SQL of body with var standing for value, which is computed once."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


BUILTIN_LIST = ", ".join(f"'{b}'" for b in BUILTINS)


def runs(text: str) -> str:
    return f"regexp_extract_all({text}, '\\\\b([A-Za-z_][A-Za-z0-9_]*)\\\\b', 1)"


def names(text: str) -> str:
    """SQL of text.symbols."""
    return f"array_sort(array_except(array_distinct({runs(text)}), array({BUILTIN_LIST})))"


def strange(text: str, have: str) -> str:
    """SQL: does the text use a symbol that is not in have? The quick test before names()."""
    return f"exists({runs(text)}, s -> not (s in ({BUILTIN_LIST})) and not array_contains({have}, s))"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '([A-Za-z_]+|[一-鿿]+)', 1)"


def once(d: DataFrame) -> DataFrame:
    """d behind a generator: else the optimizer writes a column's expression out wherever it is used further on.

    proof_id stays outside, so that Spark knows that rows dealt by it still are.
    """
    return d.select("proof_id", F.inline(F.array(F.struct(*[c for c in d.columns if c != "proof_id"]))))


def filled(df: DataFrame) -> DataFrame:
    """The parts of the nested columns as columns, null lists empty."""
    list_of = lambda path, kind: f"coalesce({path}, cast(array() as array<{kind}>))"
    node = "named_struct('id', n.id, 'node_type', n.node_type, 'status', n.status, 'claim', coalesce(n.claim, ''), 'claim_formal', n.claim_formal, 'covers', " + f"coalesce(n.covers_obligations, {NONE}), 'said', coalesce(n.proof_body.steps.statement, {NONE}), 'body', lower(to_json(n.proof_body)), 'declares', coalesce(n.declarations, {NONE}), 'source', coalesce(n.node_type in {SOURCES}, false))"
    inf = f"named_struct('id', f.id, 'deps', concat(coalesce(f.premise_nodes, {NONE}), coalesce(f.side_condition_nodes, {NONE})), 'conclusion', f.conclusion_node, 'rules', coalesce(f.rule_refs, {NONE}), 'made', map_entries(coalesce(f.instantiation, cast(map() as map<string,string>))), 'declares', coalesce(f.declarations, {NONE}))"
    d = once(df.select("proof_id", "problem", "contract", "graph", "schema_errors", "critic_errors")).select(
        "proof_id", "problem", "contract", "graph",
        F.expr(list_of("schema_errors", "string")).alias("schema_errors"), F.expr(list_of("critic_errors", ERROR)).alias("critic_errors"),
        F.expr(each(list_of("graph.nodes", NODE), "n", node)).alias("nodes"), F.expr(each(list_of("graph.inferences", INFERENCE), "f", inf)).alias("infs"),
        F.expr(f"transform(filter(coalesce(contract.obligations, array()), o -> o.id is not null), o -> o.id)").alias("obligations"),
        F.expr(f"filter(transform({list_of('contract.allowed_references', 'string')}, r -> trim(r)), r -> r <> '')").alias("allowed"),
        F.expr(f"lower(array_join({list_of('contract.forbidden_moves', 'string')}, ' '))").alias("forbidden"),
        F.expr(f"array_distinct(concat(transform(filter(coalesce(problem.variables, array()), v -> v.symbol <> ''), v -> v.symbol), map_keys(coalesce(problem.domain, cast(map() as map<string,string>)))))").alias("base"),
        F.expr("lower(to_json(graph))").alias("dump"), F.col("graph.goal_node_id").alias("goal"),
    )
    # Of nodes with one id, the last one is meant.
    return once(d).withColumns({"ids": F.expr("transform(nodes, n -> n.id)"), "by_id": F.expr("if(size(nodes) = size(array_distinct(transform(nodes, n -> n.id))), map_from_arrays(transform(nodes, n -> n.id), nodes), map_from_entries(transform(array_distinct(transform(nodes, n -> n.id)), i -> struct(i, element_at(filter(nodes, n -> n.id = i), -1)))))")})


def structural() -> list[str]:
    """The checks of a graph's structure, in order; each an array of errors."""
    known = "named_struct('id', x.id, 'names', array_distinct(concat(x.names, flatten(transform(filter(infs, f -> f.conclusion = x.id), f -> concat(f.declares, flatten(transform(filter(k, y -> array_contains(f.deps, y.id)), y -> y.names))))))))"
    start = "transform(map_values(by_id), n -> named_struct('id', n.id, 'names', array_distinct(concat(base, n.declares))))"
    # Only texts with symbols that are not known everywhere need the fixpoint.
    formal_nodes = f"filter(nodes, n -> n.claim_formal <> '' and {strange('n.claim_formal', 'base')})"
    values = f"filter(f.made, m -> m.value is not null and {strange('m.value', 'base')})"
    formal = f"exists(nodes, n -> n.claim_formal <> '' and {strange('n.claim_formal', 'base')}) or exists(infs, f -> size({values}) > 0)"
    declared = f"case when {formal} then aggregate(sequence(1, greatest(1, size(infs))), {start}, (k, i) -> transform(k, x -> {known})) else filter({start}, x -> false) end"
    of = lambda i: f"coalesce(flatten(transform(filter(declared, y -> {i}), y -> y.names)), {NONE})"
    missing = lambda text, have: f"array_except({names(text)}, {have})"
    undeclared = lambda text, have, node, inference, label: let("gone", missing(text, have), when("size(gone) > 0", error("structural", node, inference, "'high'", f"concat({label}, ' uses undeclared: ', array_join(gone, ', '))")))
    inference_have = f"concat(base, f.declares, {of('array_contains(f.deps, y.id)')})"
    ends = "array_distinct(concat(ids, flatten(transform(infs, f -> array_append(f.deps, f.conclusion)))))"
    left = until_still(ends, "filter(l, n -> exists(infs, f -> f.conclusion = n and arrays_overlap(f.deps, l)))", "l", f"size({ends})")
    # Where each dep stands before its conclusion in the list of nodes (those that do not stand there count as first), there is no cycle.
    in_order = "forall(infs, f -> forall(f.deps, d -> coalesce(array_position(ids, d) < array_position(ids, f.conclusion), false)))"
    goal_text = "coalesce(nullif(problem.goal.text, ''), problem.goal.symbolic, '')"
    vague = "array(" + ", ".join(f"'{t}'" for t in VAGUE_GRAPH) + ")"
    some = "exists(nodes, n -> size(n.covers) > 0)"
    return [
        f"DECLARED {declared}",
        when("size(ids) <> size(array_distinct(ids))", error("structural", "null", "null", "'high'", "'Node ids must be unique.'")),
        when("size(infs) <> size(array_distinct(transform(infs, f -> f.id)))", error("structural", "null", "null", "'high'", "'Inference ids must be unique.'")),
        each("filter(nodes, n -> n.status = 'source' and not n.source)", "n", error("structural", "n.id", "null", "'high'", "'A source must be an assumption or an allowed reference.'")),
        undeclared("coalesce(problem.goal.symbolic, '')", "base", "null", "null", "'goal'"),
        f"flatten({each(formal_nodes, 'n', undeclared('n.claim_formal', of('y.id = n.id'), 'n.id', 'null', chr(39) + 'claim_formal' + chr(39)))})",
        f"flatten({each('infs', 'f', 'flatten(' + each(values, 'm', undeclared('m.value', inference_have, 'f.conclusion', 'f.id', 'm.key')) + ')')})",
        each("filter(obligations, o -> not exists(nodes, n -> array_contains(n.covers, o)))", "o", error("structural", "null", "null", f"if({some}, 'high', 'medium')", "concat('Obligation must be covered: ', o)", some)),
        "flatten("
        + each(
            "infs",
            "f",
            "concat("
            + ", ".join(
                [
                    when("not coalesce(array_contains(ids, f.conclusion), false)", error("structural", "f.conclusion", "f.id", "'high'", "'Conclusion node must exist.'")),
                    each("filter(f.deps, d -> not array_contains(ids, d))", "d", error("structural", "d", "f.id", "'high'", "'Referenced node must exist.'")),
                    "flatten(" + each("f.rules", "r", "concat(" + when("size(allowed) > 0 and not array_contains(allowed, trim(r))", error("structural", "f.conclusion", "f.id", "'high'", "concat('Not in allowed references: ', r)")) + ", " + when("contains(forbidden, lower(r))", error("structural", "f.conclusion", "f.id", "'high'", "concat('Forbidden: ', r)")) + ")") + ")",
                ]
            )
            + ")",
        )
        + ")",
        when(f"not ({in_order}) and size({left}) > 0", error("structural", "null", "null", "'high'", "'Proof graph must be DAG.'")),
        f"case when not coalesce(array_contains(ids, goal), false) then array({error('structural', 'goal', 'null', chr(39) + 'high' + chr(39), chr(39) + 'Goal node must exist.' + chr(39))}) else "
        + when(f"{goal_text} <> '' and not contains({norm('by_id[goal].claim')}, {norm(goal_text)})", error("structural", "goal", "null", "'high'", "'Goal node does not align.'"))
        + " end",
        "flatten("
        + each(
            "nodes",
            "n",
            "concat("
            + when("not n.source and not coalesce(n.id = goal, false) and not exists(infs, f -> f.conclusion = n.id)", error("structural", "n.id", "null", "'medium'", "'Non-source node has no incoming inference.'", "false"))
            + ", "
            + each(f"filter({vague}, t -> contains(n.body, t))", "t", error("structural", "n.id", "null", "'medium'", "concat('Vague: ', t)", "false"))
            + ")",
        )
        + ")",
    ]


def later() -> list[str]:
    """Node proofs, symbolic claims, context, inferences; each an array of errors."""
    targets = f"filter(array({norm('n.claim_formal')}, {norm('n.claim')}), t -> t <> '')"
    stated = let("targets", targets, f"exists(n.said, s -> {let('ns', norm('s'), 'exists(targets, t -> contains(ns, t))')})")
    problem = f"case when size(n.said) = 0 then 'no steps' when exists(n.said, s -> trim(coalesce(s, '')) = '') then 'blank statement' when not {stated} then 'claim not concluded' end"
    note = lambda what, text: error("critic", "null", "null", "'medium'", f"concat('{what}: ', {text})", "false")
    used = f"(coalesce(a.id, '') <> '' and contains(dump, lower(a.id))) or ({norm('a.statement')} <> '' and contains({norm('dump')}, {norm('a.statement')}))"
    long_words = f"slice(filter({words('lower(coalesce(a.statement, ' + chr(39) * 2 + '))')}, w -> length(w) >= 2), 1, 4)"
    checked = f"(coalesce(a.id, '') <> '' and contains(dump, lower(a.id))) or exists({long_words}, w -> contains(dump, w))"
    addressed = f"contains(dump, lower(e.key)) and exists(slice({words('lower(e.value)')}, 1, 4), w -> contains(dump, w))"
    no_dep = "filter(f.deps, d -> not array_contains(ids, d))"
    conditions = lambda path: f"coalesce({path}, cast(array() as array<struct<id:string,statement:string>>))"
    return [
        f"flatten({each('filter(nodes, n -> not n.source)', 'n', let('problem', problem, when('problem is not null', error('node_proof', 'n.id', 'null', chr(39) + 'high' + chr(39), 'problem'))))})",
        f"flatten({each('symbolic', 's', each('filter(array(s.failed, s.counterexample), m -> m is not null)', 'm', error('symbolic', 's.node_id', 'null', chr(39) + 'high' + chr(39), 'm')))})",
        "filter(critic_errors, e -> e.inference_id is null)",
        each(f"filter({conditions('problem.assumptions')}, a -> not ({used}))", "a", note("Assumption may be unused", "coalesce(a.id, a.statement, '')")),
        each(f"filter({conditions('problem.hidden_conditions')}, a -> not ({checked}))", "a", note("Hidden condition may be unchecked", "coalesce(a.id, a.statement, '')")),
        each(f"filter(map_entries(coalesce(problem.domain, cast(map() as map<string,string>))), e -> not ({addressed}))", "e", note("Domain constraint may be unchecked", "e.key")),
        "filter(critic_errors, e -> e.inference_id is not null)",
        "flatten("
        + each(
            "infs",
            "f",
            f"case when not coalesce(array_contains(ids, f.conclusion), false) then array({error('inference_verifier', 'f.conclusion', 'f.id', chr(39) + 'high' + chr(39), chr(39) + 'Conclusion node must exist.' + chr(39))}) "
            f"when size({no_dep}) > 0 then {each(no_dep, 'd', error('inference_verifier', 'f.conclusion', 'f.id', chr(39) + 'high' + chr(39), 'concat(' + chr(39) + 'Dependency is missing: ' + chr(39) + ', d)'))} "
            f"else {when('size(f.rules) = 0', error('inference_verifier', 'f.conclusion', 'f.id', chr(39) + 'high' + chr(39), chr(39) + 'rule_refs is empty.' + chr(39)))} end",
        )
        + ")",
    ]


def until_still(start: str, step: str, var: str, most: str) -> str:
    """SQL of an array to which step is applied (as var) until its size stays, most times at most."""
    state = f"named_struct('a', {start}, 'still', false)"
    after = f"get(transform(array({step}), y -> named_struct('a', y, 'still', size(y) = size({var}))), 0)"
    return f"aggregate(sequence(1, greatest(1, {most})), {state}, (s, i) -> if(s.still, s, get(transform(array(s.a), {var} -> {after}), 0)), s -> s.a)"


def closure(blocked_nodes: str) -> str:
    """SQL for the ids of the nodes that unblocked sources derive, over the column usable. A proof step fires once all it depends on is there."""
    start = f"transform(filter(map_values(by_id), n -> n.source and not array_contains({blocked_nodes}, n.id)), n -> n.id)"
    step = f"array_union(v, transform(filter(usable, f -> size(array_except(f.deps, v)) = 0 and not array_contains({blocked_nodes}, f.conclusion) and not by_id[f.conclusion].source), f -> f.conclusion))"
    return until_still(start, step, "v", "size(usable)")


#: The formal claims of a proof that an equation sign gives a check, as one text with what the check depends on; null if there are none.
CLAIMS = """case when problem.goal.symbolic like '%=%' or exists(graph.nodes, n -> n.claim_formal like '%=%') then
    to_json(named_struct('texts', concat(array(problem.goal.symbolic), coalesce(transform(graph.nodes, n -> n.claim_formal), cast(array() as array<string>))), 'assumptions', problem.assumptions, 'domain', problem.domain)) end"""


def failing_claims(d: DataFrame, df: DataFrame) -> DataFrame:
    """d with symbolic: node_id, failed, counterexample of the claims that fail, the goal's (without node_id) first.

    The claims are tested in rows of their own and joined: a row that waits for Python is held on disk with all of its columns. Proofs of one id
    are told apart by the claims themselves. d is dealt by proof_id at most once, and is not sorted.
    """
    texts = "concat(array(problem.goal.symbolic), coalesce(transform(graph.nodes, n -> n.claim_formal), cast(array() as array<string>)))"
    own = df.select("proof_id", F.expr(CLAIMS).alias("claims"), F.expr(texts).alias("texts"), F.expr("coalesce(to_json(problem.assumptions), '')").alias("assumed"), F.expr("coalesce(to_json(problem.domain), '')").alias("domain"))
    # Behind a generator, as the filter would be pushed below and the claims tested twice.
    tested = lambda rows: once(rows.select("proof_id", F.md5("claims").alias("of"), symbolic.checked_all(F.col("texts"), F.col("assumed"), F.col("domain")).alias("tests"))).filter("exists(tests, t -> t.failed is not null or t.counterexample is not null)")
    gathered = F.collect_set(F.struct("of", "tests"))
    failing = tested(own.filter("claims is not null and proof_id is not null")).groupBy(F.col("proof_id").alias("_proof")).agg(gathered.alias("_failing"))
    d = d.join(failing.hint("shuffle_hash"), F.col("proof_id") == F.col("_proof"), "left")
    # Proofs without an id share one row; a null-safe join by id would deal all rows anew.
    nameless = tested(own.filter("claims is not null and proof_id is null")).groupBy().agg(gathered.alias("_nameless"))
    d = d.join(F.broadcast(nameless), F.col("proof_id").isNull(), "left").withColumn("_failing", F.coalesce("_failing", "_nameless"))
    shown = "transform(concat(array(cast(null as string)), transform(nodes, n -> n.id)), (c, i) -> named_struct('node_id', c, 'failed', get(ts, i).failed, 'counterexample', get(ts, i).counterexample))"
    own_tests = f"get(filter(_failing, x -> x.of = md5({CLAIMS})), 0).tests"
    symbolic_ = f"case when size(_failing) > 0 then {let('ts', own_tests, shown)} else filter({let('ts', 'cast(null as array<struct<failed:string,counterexample:string>>)', shown)}, x -> false) end"
    return d.withColumn("symbolic", F.expr(symbolic_)).drop("_failing", "_proof", "_nameless")


def verified(df: DataFrame) -> DataFrame:
    """proof_id, errors (array of ERROR in the order of emission, so error_id is E and the place), node_status, inference_status,
    obligation_status (maps by id to verified or failed, pass or fail), accepted."""
    d = failing_claims(once(filled(df)), df)
    declared, *checks = structural()
    d = once(d.withColumn("declared", F.expr(declared.removeprefix("DECLARED "))))
    invalid = each("schema_errors", "p", error("json_schema", "null", "null", "'high'", "p"))
    rest = f"cast(concat({', '.join([*checks, *later()])}) as array<{ERROR}>)"
    d = d.withColumn("before", F.expr(f"case when size(schema_errors) > 0 then cast({invalid} as array<{ERROR}>) else {rest} end"))
    blocked = lambda errors, key: f"array_distinct(filter(transform(filter({errors}, e -> e.blocking or e.severity = 'high'), e -> e.{key}), i -> i is not null))"
    d = once(d.drop("declared", "dump", "problem", "contract", "graph", "symbolic"))
    d = once(d.withColumns({"bn": F.expr(blocked("before", "node_id")), "bi": F.expr(blocked("before", "inference_id"))}))
    usable = "filter(infs, f -> not coalesce(array_contains(bi, f.id), false) and size(f.rules) > 0 and coalesce(array_contains(ids, f.conclusion), false) and size(array_except(f.deps, ids)) = 0)"
    d = once(once(d.withColumn("usable", F.expr(usable))).withColumn("reached", F.expr(closure("bn"))))
    misses = each("filter(nodes, n -> not n.source and not array_contains(bn, n.id) and not array_contains(reached, n.id))", "n", error("inference_closure", "n.id", "null", "'high'", "'No verified inference proves this node.'"))
    d = d.withColumn("errors", F.expr(f"if(size(schema_errors) > 0, before, concat(before, cast({misses} as array<{ERROR}>)))"))
    # The rows of this last check block nodes that were not reached anyway and no inference, so what is reached stays.
    d = once(once(d).withColumn("bn", F.expr(blocked("errors", "node_id"))))
    fired = "not coalesce(array_contains(bi, f.id), false) and size(f.rules) > 0 and coalesce(array_contains(ids, f.conclusion), false) and size(array_except(f.deps, reached)) = 0"
    node_ok = "not coalesce(array_contains(bn, n.id), false) and coalesce(array_contains(reached, n.id), false)"
    d = d.withColumns({"nodes_ok": F.expr(each("nodes", "n", f"struct(n.id as id, {node_ok} as ok, n.covers as covers)")), "infs_ok": F.expr(each("infs", "f", f"struct(f.id as id, {fired} as ok)"))})
    d = once(d)
    covered = "exists(nodes_ok, n -> n.ok and (n.id = goal or array_contains(n.covers, o)))"
    d = d.withColumn("obligations_ok", F.expr(each("obligations", "o", f"struct(o as id, coalesce({covered}, false) as ok)")))
    status = lambda c, good, bad: F.expr(f"map_from_entries(transform(array_distinct(transform({c}, x -> x.id)), i -> struct(i, if(exists({c}, x -> x.id = i and x.ok), '{good}', '{bad}'))))")
    return d.select(
        "proof_id", "errors", status("nodes_ok", "verified", "failed").alias("node_status"), status("infs_ok", "verified", "failed").alias("inference_status"), status("obligations_ok", "pass", "fail").alias("obligation_status"),
        F.expr("not exists(errors, e -> e.blocking or e.severity = 'high') and forall(nodes_ok, x -> x.ok) and forall(infs_ok, x -> x.ok) and forall(obligations_ok, x -> x.ok)").alias("accepted"),
    )


#: Types of the artifacts as read from JSON; declarations stay text, as they may be names or objects.
CONDITION = "array<struct<id:string,statement:string>>"
TYPES = {
    "problem": f"struct<goal:struct<text:string,symbolic:string>,assumptions:{CONDITION},hidden_conditions:{CONDITION},variables:array<struct<symbol:string>>,domain:map<string,string>>",
    "contract": "struct<obligations:array<struct<id:string>>,allowed_references:array<string>,forbidden_moves:array<string>>",
    "graph": f"struct<goal_node_id:string,nodes:array<{NODE}>,inferences:array<{INFERENCE}>>",
}


def declared_names(declarations: str) -> str:
    """SQL of the symbols in declarations: an object's symbol, or a text that is an identifier."""
    return f"filter(transform({declarations}, d -> if(startswith(d, '{{'), get_json_object(d, '$.symbol'), if(d rlike '^[A-Za-z_][A-Za-z0-9_]*$', d, null))), d -> d <> '')"


def typed(df: DataFrame) -> DataFrame:
    """verified()'s input from artifacts as JSON text: proof_id, problem, contract, graph, and critic_errors if there are any.

    schema_errors are the artifacts' violations, problem first, each artifact's by path: 'path: message'. Null and unreadable texts
    are violations, so no further check sees them.
    """
    d = df.select("proof_id", *TYPES, (F.col("critic_errors") if "critic_errors" in df.columns else F.lit(None)).cast(f"array<{ERROR}>").alias("critic_errors"))
    for name, rules in (("problem", schema.PROBLEM), ("contract", schema.CONTRACT), ("graph", schema.GRAPH)):
        d = schema.checked(d, name, rules, f"{name}_found").withColumn(f"{name}_found", schema.by_path(f"{name}_found"))
    found = "concat(problem_found, contract_found, graph_found)"
    errors = F.expr(f"transform({found}, e -> concat({schema.joined_path('e.path', '.')}, ': ', e.message))")
    d = once(d.select("proof_id", *[F.from_json(name, kind).alias(name) for name, kind in TYPES.items()], errors.alias("schema_errors"), "critic_errors"))
    plain = lambda kind: [f.split(":")[0] for f in fields(kind)]
    renamed = lambda var, kind: "named_struct(" + ", ".join(f"'{f}', {declared_names(f'{var}.{f}') if f == 'declarations' else f'{var}.{f}'}" for f in plain(kind)) + ")"
    graph = f"named_struct('goal_node_id', graph.goal_node_id, 'nodes', transform(graph.nodes, n -> {renamed('n', NODE)}), 'inferences', transform(graph.inferences, f -> {renamed('f', INFERENCE)}))"
    return d.withColumn("graph", F.expr(graph))


def fields(kind: str) -> list[str]:
    """The fields of a struct's DDL, at its first level."""
    out, depth = [""], 0
    for c in kind.removeprefix("struct<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def verified_texts(df: DataFrame) -> DataFrame:
    """verified() of artifacts as JSON text (see typed()): the schemas first, then, if they hold, all other verifiers."""
    return verified(typed(df))


def error_rows(result: DataFrame) -> DataFrame:
    """proof_id, error_id (E1, E2 ... in the order of emission) and the fields of ERROR, of a result of verified()."""
    return result.select("proof_id", F.posexplode("errors").alias("at", "e")).select("proof_id", F.concat(F.lit("E"), F.col("at") + 1).alias("error_id"), "e.*")
