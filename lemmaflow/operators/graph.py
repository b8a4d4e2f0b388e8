"""Structural checks of proof graphs.

Tables: nodes (proof_id, id, node_type, covers), inferences (proof_id, id, deps, conclusion, rules). Checks
of single nodes or edges are joins on (proof_id, id). Fixpoints run on one row per proof: a graph is a few
nodes, so a fold over its arrays needs one shuffle by proof_id and no loop of jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node types that need no derivation.
SOURCE_TYPES = ["assumption", "allowed_reference", "side_condition"]


def duplicate_ids(items: DataFrame) -> DataFrame:
    """proof_id, n_rows, n_ids of proofs in which an id stands twice."""
    return items.groupBy("proof_id").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids")).filter("n_rows <> n_ids")


def dangling(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """proof_id, inference_id, role, missing: a row for each reference to a node that is not there."""
    refs = inferences.select("proof_id", F.col("id").alias("inference_id"), F.explode(F.concat(F.array(F.struct(F.lit("conclusion").alias("role"), F.col("conclusion").alias("missing"))), F.transform("deps", lambda d: F.struct(F.lit("dep").alias("role"), d.alias("missing"))))).alias("r")).select("proof_id", "inference_id", "r.*")
    return refs.join(nodes.select("proof_id", F.col("id").alias("missing")), ["proof_id", "missing"], "left_anti").select("proof_id", "inference_id", "role", "missing")


def rules_not_allowed(inferences: DataFrame, allowed: list[str]) -> DataFrame:
    """A row for each rule outside the allowed ones (compared trimmed); none if nothing is listed."""
    rules = inferences.select("proof_id", F.col("id").alias("inference_id"), F.explode("rules").alias("rule"))
    return rules.filter(~F.trim("rule").isin(allowed)) if allowed else rules.limit(0)


def rules_forbidden(inferences: DataFrame, forbidden: list[str]) -> DataFrame:
    """A row for each rule whose lower-case name is part of the forbidden moves' joined text."""
    text = F.lit(" ".join(forbidden).lower())
    return inferences.select("proof_id", F.col("id").alias("inference_id"), F.explode("rules").alias("rule")).filter(F.contains(text, F.lower(F.trim("rule"))))


def orphans(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """Nodes that are no sources and that no inference concludes."""
    loose = nodes.filter(~F.col("node_type").isin(SOURCE_TYPES)).select("proof_id", "id").distinct()
    return loose.join(inferences.select("proof_id", F.col("conclusion").alias("id")), ["proof_id", "id"], "left_anti")


def uncovered(nodes: DataFrame, proofs: DataFrame, obligations: list[str]) -> DataFrame:
    """proof_id, obligation, severity: high if some node of the proof covers anything, else medium."""
    wanted = proofs.select("proof_id", F.explode(F.array(*map(F.lit, obligations))).alias("obligation"))
    covers = nodes.select("proof_id", F.explode("covers").alias("obligation")).distinct()
    some = covers.select("proof_id").distinct().withColumn("some", F.lit(True))
    return wanted.join(covers, ["proof_id", "obligation"], "left_anti").join(some, "proof_id", "left").select("proof_id", "obligation", F.when(F.col("some"), "high").otherwise("medium").alias("severity"))


def goals_missing(nodes: DataFrame, goals: DataFrame) -> DataFrame:
    return goals.join(nodes.select("proof_id", F.col("id").alias("goal")), ["proof_id", "goal"], "left_anti").select("proof_id", "goal")


def graphs(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """One row per proof: ids, sources, infs (deps, conclusion), all as arrays."""
    n = nodes.groupBy("proof_id").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set(F.when(F.col("node_type").isin(SOURCE_TYPES), F.col("id")))).alias("sources"))
    i = inferences.groupBy("proof_id").agg(F.collect_set(F.struct("deps", "conclusion")).alias("infs"))
    return n.join(i, "proof_id", "left").withColumn("infs", F.coalesce("infs", F.expr("cast(array() as array<struct<deps:array<string>,conclusion:string>>)")))


def with_closure(graphs: DataFrame) -> DataFrame:
    """graphs with verified: the nodes that sources derive when an inference fires once all its deps are.

    Each step of the fold fires every inference that can; a chain needs as many steps as inferences.
    """
    step = "array_union(v, transform(filter(infs, f -> size(array_except(f.deps, v)) = 0 and array_contains(ids, f.conclusion)), f -> f.conclusion))"
    return graphs.withColumn("verified", F.expr(f"aggregate(sequence(1, greatest(1, size(infs))), sources, (v, i) -> {step})"))


def with_cycle(graphs: DataFrame) -> DataFrame:
    """graphs with cyclic: nodes without an incoming edge from a remaining node are peeled off, round by
    round; what cannot be peeled lies on or behind a cycle. Endpoints that are no nodes count as nodes."""
    ends = "array_distinct(concat(ids, flatten(transform(infs, f -> array_append(f.deps, f.conclusion)))))"
    keep = "filter(left, n -> exists(infs, f -> f.conclusion = n and arrays_overlap(f.deps, left)))"
    return graphs.withColumn("ends", F.expr(ends)).withColumn("left_over", F.expr(f"aggregate(sequence(1, greatest(1, size(ends))), ends, (left, i) -> {keep})")).withColumn("cyclic", F.size("left_over") > 0).drop("ends", "left_over")


def closure_misses(graphs: DataFrame) -> DataFrame:
    """Nodes that are neither sources nor derivable."""
    return with_closure(graphs).select("proof_id", F.explode(F.array_except("ids", "verified")).alias("id"))


def declared(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """proof_id, id, names: symbols that a node's own declarations and, along inferences, its dependencies'
    give it. nodes here: proof_id, id, declares (array); the fixpoint is a fold over (id, names) pairs."""
    n = nodes.groupBy("proof_id").agg(F.collect_list(F.struct("id", F.col("declares").alias("names"))).alias("known"))
    i = inferences.groupBy("proof_id").agg(F.collect_list(F.struct("deps", "conclusion")).alias("infs"))
    step = "transform(k, x -> named_struct('id', x.id, 'names', array_distinct(concat(x.names, flatten(transform(filter(infs, f -> f.conclusion = x.id), f -> flatten(transform(filter(k, y -> array_contains(f.deps, y.id)), y -> y.names))))))))"
    both = n.join(i, "proof_id", "left").withColumn("infs", F.coalesce("infs", F.expr("cast(array() as array<struct<deps:array<string>,conclusion:string>>)")))
    return both.select("proof_id", F.inline(F.expr(f"aggregate(sequence(1, size(known)), known, (k, i) -> {step})")))
