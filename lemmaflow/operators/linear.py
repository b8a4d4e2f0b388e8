"""Checks of flat proofs (a list of steps and a conclusion) and the choice among attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import VAGUE_FLAT, goal_overlap, named_theorems, vague_terms

BLANK = "trim(coalesce({}, '')) = ''"


def _rows(df: DataFrame, check: str, severity: str, blocking: bool, detail=None) -> DataFrame:
    return df.select("proof_id", "step_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(blocking).alias("blocking"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def verify(steps: DataFrame, proofs: DataFrame) -> DataFrame:
    """proof_id, step_id, check, severity, blocking, detail.

    steps: proof_id, step_id, statement, justification, refs. proofs: proof_id, problem, goal, conclusion. A
    proof without steps has that one row and no other.
    """
    present = steps.select("proof_id").distinct()
    none = _rows(proofs.join(present, "proof_id", "left_anti").withColumn("step_id", F.lit(None).cast("string")), "no_steps", "high", True)
    own = proofs.join(present, "proof_id", "left_semi").withColumn("step_id", F.lit(None).cast("string"))
    text = F.concat_ws(" ", "statement", "justification")
    vague = steps.withColumn("term", F.explode(vague_terms(text, VAGUE_FLAT)))
    known = steps.select("proof_id", F.col("step_id").alias("ref"))
    refs = steps.select("proof_id", "step_id", F.explode("refs").alias("ref")).join(known, ["proof_id", "ref"], "left_anti")
    proved = proofs.select("proof_id", F.explode(named_theorems("problem")).alias("theorem"))
    circular = steps.withColumn("low", F.lower(F.coalesce("justification", F.lit("")))).join(proved, "proof_id").filter(F.contains("low", F.col("theorem")))
    lone = steps.groupBy("proof_id").agg(F.count("*").alias("n")).filter("n = 1").withColumn("step_id", F.lit(None).cast("string"))
    parts = [
        none,
        _rows(steps.filter(BLANK.format("statement")), "empty_statement", "high", True),
        _rows(steps.filter(BLANK.format("justification")), "empty_justification", "high", True),
        _rows(vague, "vague", "medium", False, F.col("term")),
        _rows(circular, "circular", "high", True, F.col("theorem")),
        _rows(refs, "unknown_ref", "medium", False, F.col("ref")),
        _rows(own.filter(BLANK.format("conclusion")), "no_conclusion", "high", True),
        _rows(lone, "one_step", "medium", False),
        _rows(own.filter(~F.expr(BLANK.format("conclusion")) & (goal_overlap("goal", "conclusion") < 0.3)), "overlap", "low", False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accepted(proofs: DataFrame, errors: DataFrame) -> DataFrame:
    """A flat proof is accepted if no error is both blocking and high."""
    bad = errors.filter("blocking and severity = 'high'").select("proof_id").distinct().withColumn("bad", F.lit(True))
    return proofs.join(bad, "proof_id", "left").select("proof_id", F.col("bad").isNull().alias("accepted"))


def first_valid(attempts: DataFrame, keys: list[str], valid: str) -> DataFrame:
    """keys, attempt: the first attempt that holds, null if none; n_attempts made."""
    return attempts.groupBy(*keys).agg(F.min(F.when(F.expr(valid), F.col("attempt"))).alias("first_valid"), F.count("*").alias("n_attempts"))
