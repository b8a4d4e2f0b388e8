"""Error rows from critics' responses, which are rows of text: proof_id, inference_id, node_id, text.

node_id is the conclusion of the inference, the default place of its issues. A response passes if it says so,
or says nothing and has no issues; one that fails without issues counts as one issue; one that cannot be read
is a low row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonrepair import parsed

ISSUE = "struct<message:string,evidence:string,rule_ref:string,node_id:string,inference_id:string,severity:string>"


def errors(responses: DataFrame, severity: str, blocking: bool, message: str) -> DataFrame:
    """proof_id, source, node_id, inference_id, severity, claim, evidence, blocking."""
    r = responses.withColumn("v", F.try_parse_json(parsed("text")))
    kind = F.schema_of_variant("v")
    listed = F.try_variant_get("v", "$.issues", "array<variant>")
    shape = F.schema_of_variant(F.try_variant_get("v", "$.issues", "variant"))
    r = r.withColumn("readable", F.coalesce(kind.startswith("OBJECT") & (shape.isNull() | shape.startswith("ARRAY") | (shape == "VOID")), F.lit(False)))
    r = r.withColumn("issues", F.coalesce(listed, F.expr("cast(array() as array<variant>)")))
    r = r.withColumn("passed", F.coalesce(F.try_variant_get("v", "$.pass", "boolean"), F.size("issues") == 0))
    unread = r.filter("not readable").select("proof_id", F.col("node_id"), "inference_id", F.lit("low").alias("severity"), F.lit("The critic's response could not be parsed.").alias("claim"), F.lit("").alias("evidence"), F.lit(False).alias("blocking"))
    failed = r.filter("readable and not passed")
    one = F.from_json(F.to_json("i"), ISSUE)
    each = failed.withColumn("i", F.explode_outer("issues")).withColumn("o", one)
    words = F.coalesce(F.col("o.message"), F.try_variant_get("i", "$", "string"), F.lit(message))
    given = F.col("o.severity").isin("low", "medium", "high")
    each = each.select(
        "proof_id",
        F.coalesce("o.node_id", "node_id").alias("node_id"),
        F.coalesce("o.inference_id", "inference_id").alias("inference_id"),
        F.when(given, F.col("o.severity")).otherwise(severity).alias("severity"),
        F.when(F.coalesce(F.length("o.rule_ref"), F.lit(0)) > 0, F.concat(F.lit("Theorem applicability for "), "o.rule_ref")).otherwise(words).alias("claim"),
        F.coalesce("o.evidence", F.lit("")).alias("evidence"),
        F.lit(blocking).alias("blocking"),
    )
    return unread.unionByName(each).withColumn("source", F.lit("critic"))


def case_coverage(responses: DataFrame) -> DataFrame:
    return errors(responses, "medium", False, "Case analysis may be missing.")


def theorem_applicability(responses: DataFrame) -> DataFrame:
    return errors(responses, "high", True, "Theorem applicability may be missing.")
