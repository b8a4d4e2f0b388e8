"""From error rows to ids, gates and reports, and the verdict on whole proofs whose errors are known (verifyall.py finds them).

errors: proof_id, phase, ord, source, node_id, inference_id, severity, blocking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A row blocks if it says so or is of high severity.
BLOCKING = "blocking or severity = 'high'"


def with_error_ids(errors: DataFrame, order: list[str]) -> DataFrame:
    """errors with error_id E1, E2 ... in each proof, in the order of emission."""
    w = Window.partitionBy("proof_id").orderBy(*order)
    return errors.withColumn("error_id", F.concat(F.lit("E"), F.row_number().over(w)))


def after_schema_gate(errors: DataFrame) -> DataFrame:
    """Proofs with a blocking schema error keep their schema errors only."""
    stopped = errors.filter(f"source = 'json_schema' and ({BLOCKING})").select("proof_id").distinct().withColumn("stopped", F.lit(True))
    return errors.join(stopped, "proof_id", "left").filter("stopped is null or source = 'json_schema'").drop("stopped")


def severity_report(errors: DataFrame) -> DataFrame:
    return errors.groupBy("source", "severity").agg(F.count("*").alias("n"), F.count_distinct("proof_id").alias("n_proofs"))


def annotated(proofs: DataFrame) -> DataFrame:
    """Statuses and verdict of whole proofs, one row each.

    proofs: proof_id, goal, nodes (array of id, source, covers), infs (array of id, deps, conclusion, rules),
    obligations (array of ids), blocked_nodes, blocked_infs (arrays of ids with blocking errors), n_blocking.
    Adds verified_nodes, verified_infs, failed_obligations, failed_infs, accepted. A blocked conclusion is not
    derived, yet its inference counts as verified if its dependencies are; a verified goal passes every
    obligation; empty lists of nodes or inferences are no failure by themselves.
    """
    usable = "filter(infs, f -> not array_contains(blocked_infs, f.id) and size(f.rules) > 0 and array_contains(ids, f.conclusion) and size(array_except(f.deps, ids)) = 0)"
    p = proofs.withColumn("ids", F.expr("transform(nodes, n -> n.id)")).withColumn("usable", F.expr(usable))
    start = "transform(filter(nodes, n -> n.source and not array_contains(blocked_nodes, n.id)), n -> n.id)"
    step = "array_union(v, transform(filter(usable, f -> size(array_except(f.deps, v)) = 0 and not array_contains(blocked_nodes, f.conclusion)), f -> f.conclusion))"
    p = p.withColumn("verified_nodes", F.expr(f"array_sort(array_distinct(aggregate(sequence(1, greatest(1, size(infs))), {start}, (v, i) -> {step})))"))
    p = p.withColumn("verified_infs", F.expr("array_sort(transform(filter(usable, f -> size(array_except(f.deps, verified_nodes)) = 0), f -> f.id))"))
    covered = "flatten(transform(filter(nodes, n -> array_contains(verified_nodes, n.id)), n -> n.covers))"
    p = p.withColumn("failed_obligations", F.expr(f"case when array_contains(verified_nodes, goal) then cast(array() as array<string>) else array_except(obligations, {covered}) end"))
    p = p.withColumn("failed_infs", F.expr("array_sort(array_union(blocked_infs, array_except(transform(infs, f -> f.id), verified_infs)))"))
    all_nodes = "forall(ids, n -> array_contains(verified_nodes, n))"
    return p.withColumn("accepted", F.expr(f"n_blocking = 0 and size(failed_obligations) = 0 and {all_nodes} and size(array_except(transform(infs, f -> f.id), verified_infs)) = 0")).drop("ids", "usable")
