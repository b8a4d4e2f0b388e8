"""Normalisers of generated artifacts, on typed nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import THEOREMS
from .graph import SOURCE_TYPES

# Formal goals by kind of problem.
GOALS_BY_KIND = {
    "intermediate_value_theorem": "Eq(f(c), N)",
    "mean_value_theorem": "Eq(Derivative(f(x), x).subs(x, c), (f(b) - f(a)) / (b - a))",
    "chain_rule": "Eq(Derivative(f(g(x)), x), Derivative(f(u), u).subs(u, g(x)) * Derivative(g(x), x))",
}


def numbered(statements: Column, prefix: str) -> Column:
    """Plain statements to records with ids A1, A2 ..."""
    return F.transform(statements, lambda s, i: F.struct(F.concat(F.lit(prefix), i + 1).alias("id"), s.alias("statement")))


def real_variables(symbols: Column) -> Column:
    return F.transform(symbols, lambda s: F.struct(s.alias("symbol"), F.lit("real").alias("type"), F.lit("variable").alias("role")))


def goal_of(text: Column) -> Column:
    """A goal given as text only serves as its symbolic form too."""
    return F.struct(text.alias("text"), text.alias("symbolic"))


def formal_goal(kind: Column, otherwise: Column) -> Column:
    out = otherwise
    for k, v in GOALS_BY_KIND.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def obligations(items: Column) -> Column:
    """Obligations (id, description, text, statement, status) completed: O1, O2 ... for ids, the first text
    there is, pending; O1 alone for an empty list."""
    done = F.transform(items, lambda o, i: F.struct(F.coalesce(o["id"], F.concat(F.lit("O"), i + 1)).alias("id"), F.coalesce(o["description"], o["text"], o["statement"], F.concat(F.lit("obligation "), i + 1)).alias("description"), F.coalesce(o["status"], F.lit("pending")).alias("status")))
    default = F.array(F.struct(F.lit("O1").alias("id"), F.lit("Prove the stated goal").alias("description"), F.lit("pending").alias("status")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, done).otherwise(default)


def references(items: Column) -> Column:
    """Trimmed references without blanks."""
    return F.filter(F.transform(items, lambda r: F.trim(r)), lambda r: r != "")


def chosen_references(*lists: Column) -> Column:
    """The first list that has items: a contract's own references, its theorems, then those of nested fields."""
    out = F.expr("cast(array() as array<string>)")
    for items in reversed(lists):
        out = F.when(F.size(items) > 0, items).otherwise(out)
    return out


def parted_graph(items: Column, inferences: Column) -> Column:
    """nodes and inferences of a generated graph: items (id, node_type, claim, status, premise_nodes, conclusion_node,
    side_condition_nodes, rule_refs, relation) with a premise or a conclusion are inferences, used if there are no others.
    Statuses and types are trimmed; an inference without an id, lists, relation or status gets I1, I2 ..., empty lists,
    implies, planned. error says why a graph without nodes cannot be used."""
    like = lambda x: x["premise_nodes"].isNotNull() | x["conclusion_node"].isNotNull()
    none = F.expr("cast(array() as array<string>)")
    nodes = F.transform(F.filter(items, lambda x: ~like(x)), lambda n: F.struct(n["id"].alias("id"), F.trim(n["node_type"]).alias("node_type"), n["claim"].alias("claim"), F.trim(n["status"]).alias("status")))
    chosen = F.when(F.size(inferences) > 0, inferences).otherwise(F.filter(items, like))
    done = F.transform(
        chosen,
        lambda f, i: F.struct(
            F.coalesce(f["id"], F.concat(F.lit("I"), i + 1)).alias("id"),
            F.coalesce(f["premise_nodes"], none).alias("premise_nodes"),
            F.coalesce(f["side_condition_nodes"], none).alias("side_condition_nodes"),
            F.coalesce(f["rule_refs"], none).alias("rule_refs"),
            F.coalesce(f["conclusion_node"], F.lit("")).alias("conclusion_node"),
            F.coalesce(f["relation"], F.lit("implies")).alias("relation"),
            F.coalesce(F.trim(f["status"]), F.lit("planned")).alias("status"),
        ),
    )
    return F.struct(nodes.alias("nodes"), done.alias("inferences"), F.when(F.coalesce(F.size(nodes), F.lit(0)) <= 0, "empty nodes").alias("error"))


def tidied_graph(df: DataFrame) -> DataFrame:
    """df: proof_id, goal_node_id, nodes (id, node_type, ...), inferences (id, conclusion_node, premise_nodes,
    side_condition_nodes, ...).

    A goal id that names no node becomes the first goal node's; references to missing nodes go; a conclusion
    that is missing becomes the goal, if that is there; a node is no premise of itself.
    """
    ids = F.transform("nodes", lambda n: n["id"])
    d = df.withColumn("_ids", ids)
    first_goal = F.filter("nodes", lambda n: n["node_type"] == "goal")
    d = d.withColumn("goal_node_id", F.when(F.array_contains("_ids", F.col("goal_node_id")), F.col("goal_node_id")).otherwise(F.coalesce(F.get(first_goal, F.lit(0))["id"], F.col("goal_node_id"))))

    def fixed(f: Column) -> Column:
        to = F.when(~F.array_contains(F.col("_ids"), f["conclusion_node"]) & F.array_contains(F.col("_ids"), F.col("goal_node_id")), F.col("goal_node_id")).otherwise(f["conclusion_node"])
        keep = lambda deps: F.filter(F.array_intersect(deps, F.col("_ids")), lambda x: x != to)
        return f.withField("conclusion_node", to).withField("premise_nodes", keep(f["premise_nodes"])).withField("side_condition_nodes", keep(f["side_condition_nodes"]))

    return d.withColumn("inferences", F.transform("inferences", fixed)).drop("_ids")


def has_orphan(nodes: Column, inferences: Column) -> Column:
    """Is there a node, the goal included, that is no source and that nothing concludes? Then the skeleton is
    replaced by the fallback."""
    concluded = F.transform(inferences, lambda f: f["conclusion_node"])
    return F.exists(nodes, lambda n: ~n["node_type"].isin(SOURCE_TYPES) & ~F.coalesce(F.array_contains(concluded, n["id"]), F.lit(False)))


def fallback_problem(df: DataFrame) -> DataFrame:
    """df: raw_problem, hint_goal, hint_kind (null: no hint) to a minimal problem record."""
    text = F.coalesce("hint_goal", "raw_problem")
    return df.withColumn("problem", F.struct(F.concat(F.lit("fallback_"), F.substring(F.md5("raw_problem"), 1, 12)).alias("problem_id"), F.col("raw_problem"), F.struct(text.alias("text"), formal_goal(F.col("hint_kind"), text).alias("symbolic")).alias("goal")))


def fallback_rules(proof_id: Column, refs: Column, terms: Column) -> Column:
    """At most two rules: the contract's references; else library theorems that hold a technical term; else those that
    hold the problem's id or stand in it; else assumption_use. Each in its list's own order."""
    empty, library = F.expr("cast(array() as array<string>)"), F.array(*map(F.lit, THEOREMS))
    pid = F.lower(proof_id)
    of_term = F.filter(library, lambda t: F.exists(F.coalesce(terms, empty), lambda w: F.contains(F.lower(t), F.lower(w))))
    of_id = F.filter(library, lambda t: F.contains(pid, F.lower(t)) | F.contains(F.lower(t), pid))
    given = references(F.coalesce(refs, empty))
    return F.slice(F.when(F.size(given) > 0, given).when(F.size(of_term) > 0, of_term).when(F.size(of_id) > 0, of_id).otherwise(F.array(F.lit("assumption_use"))), 1, 2)


def fallback_graph(df: DataFrame) -> DataFrame:
    """df: proof_id, goal (text), assumptions (array of id, statement), refs, terms (arrays of texts) to a graph of one
    inference from all assumptions to goal G1. Null lists count as empty; assumptions without an id are A1, A2 ... by place."""
    a = F.coalesce("assumptions", F.expr("cast(array() as array<struct<id:string,statement:string>>)"))
    node = lambda i, kind, claim, status: F.struct(i.alias("id"), F.lit(kind).alias("node_type"), claim.alias("claim"), F.lit(status).alias("status"))
    named = lambda s, i: F.coalesce(s["id"], F.concat(F.lit("A"), i + 1))
    sources = F.transform(a, lambda s, i: node(named(s, i), "assumption", s["statement"], "source"))
    goal = F.array(node(F.lit("G1"), "goal", F.coalesce("goal", F.lit("Prove the goal")), "planned"))
    rules = fallback_rules(F.col("proof_id"), F.col("refs"), F.col("terms"))
    inference = F.struct(F.lit("I1").alias("id"), F.transform(a, named).alias("premise_nodes"), F.lit("G1").alias("conclusion_node"), rules.alias("rule_refs"), F.expr("cast(array() as array<string>)").alias("side_condition_nodes"), F.lit("implies").alias("relation"), F.lit("planned").alias("status"))
    return df.select("proof_id", F.lit("G1").alias("goal_node_id"), F.concat(sources, goal).alias("nodes"), F.array(inference).alias("inferences"))
