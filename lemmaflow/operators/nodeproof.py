"""Do nodes' own proofs state their claims, and are inferences well formed?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_math
from .graph import SOURCE_TYPES


def node_proofs(nodes: DataFrame) -> DataFrame:
    """proof_id, id, problem (no_steps, blank_statement, not_concluded) of nodes that are no sources.

    nodes: proof_id, id, node_type, claim, claim_formal, statements (array of the steps' statements). A claim
    that normalises to nothing is not looked for.
    """
    n = nodes.filter(~F.col("node_type").isin(SOURCE_TYPES))
    wanted = F.filter(F.array(normalized_math(F.coalesce("claim_formal", F.lit(""))), normalized_math(F.coalesce("claim", F.lit("")))), lambda t: t != "")
    n = n.withColumns({"wanted": wanted, "said": F.transform("statements", lambda s: normalized_math(F.coalesce(s, F.lit(""))))})
    stated = F.exists("wanted", lambda t: F.exists("said", lambda s: F.contains(s, t)))
    blank = F.exists("statements", lambda s: F.trim(F.coalesce(s, F.lit(""))) == "")
    problem = F.when(F.coalesce(F.size("statements"), F.lit(0)) <= 0, "no_steps").when(blank, "blank_statement").when(~stated, "not_concluded")
    return n.select("proof_id", "id", problem.alias("problem")).filter("problem is not null")


def inference_problems(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """proof_id, inference_id, problem, missing: a missing conclusion hides missing dependencies, and those
    hide an empty list of rules."""
    ids = nodes.groupBy("proof_id").agg(F.collect_set("id").alias("ids"))
    i = inferences.join(ids, "proof_id", "left").withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<string>)")))
    gone = F.filter("deps", lambda d: ~F.array_contains(F.col("ids"), d))
    row = lambda name, m: F.struct(F.lit(name).alias("problem"), m.alias("missing"))
    none = F.lit(None).cast("string")
    found = (
        F.when(~F.array_contains(F.col("ids"), F.col("conclusion")), F.array(row("no_conclusion", F.col("conclusion"))))
        .when(F.size(gone) > 0, F.transform(gone, lambda d: row("no_dependency", d)))
        .when(F.size("rules") == 0, F.array(row("no_rules", none)))
    )
    return i.withColumn("r", F.explode(found)).select("proof_id", F.col("id").alias("inference_id"), "r.problem", "r.missing")
