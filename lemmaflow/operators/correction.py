"""Flat proofs corrected in rounds until no error blocks them or the budget is used up.

A round asks for an answer to every open proof, checks all answers in one plan (linear.verify), and hands on only the proofs
that are still blocked, with their errors. Rounds are written (sources/staging.py), so the work shrinks with the open proofs
and a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stages
from . import linear

#: Answers to a proof at most, the first one included (fixed value).
BUDGET = 3
STEP = "struct<step_id:string,statement:string,justification:string,refs:array<string>>"
ERROR = "struct<step_id:string,check:string,severity:string,blocking:boolean,detail:string>"


def failure(check: str) -> str:
    return f"cast(named_struct('step_id', null, 'check', '{check}', 'severity', 'high', 'blocking', true, 'detail', null) as {ERROR})"


def corrected(proofs: DataFrame, respond: Callable[[DataFrame], DataFrame], budget: int = BUDGET) -> DataFrame:
    """proof_id, accepted, attempts, errors (array, those of the last answer, sorted), steps, conclusion (the last answer), a row for each proof.

    proofs: proof_id (unique), problem, goal. respond gets what is asked in a round: proof_id, problem, goal, attempt (from 1), errors, steps,
    conclusion (of the answer before, null at first), and returns proof_id, steps (array<STEP>), conclusion. No row, or null steps,
    is a failure: of the first answer, it leaves no proof (generate_failed, attempts 0); of a later one, the answer before stays, its errors
    too, with correct_failed added, and the attempt is not counted. Of several rows for a proof the smallest counts. All errors are handed on,
    blocking or not. An empty table gives an empty result.
    """
    stages = Stages(proofs.sparkSession, "corrections")
    null = lambda kind: F.lit(None).cast(kind)
    open_ = proofs.select("proof_id", "problem", "goal", null(f"array<{ERROR}>").alias("errors"), null(f"array<{STEP}>").alias("steps"), null("string").alias("conclusion"))
    done = None
    for attempt in range(1, budget + 1):
        asked = stages.put("asked", open_.withColumn("attempt", F.lit(attempt)))
        if asked.isEmpty():
            break
        answers = respond(asked).groupBy("proof_id").agg(F.min(F.struct(F.col("steps").cast(f"array<{STEP}>").alias("steps"), "conclusion")).alias("a"))
        answers = stages.put("answers", asked.join(answers.select("proof_id", F.col("a.steps").alias("new"), F.col("a.conclusion").alias("new_conclusion")), "proof_id", "left"))
        check = "generate_failed" if attempt == 1 else "correct_failed"
        lost = answers.filter("new is null").select("proof_id", F.lit(attempt - 1).alias("attempts"), F.expr(f"array_append(coalesce(errors, cast(array() as array<{ERROR}>)), {failure(check)})").alias("errors"), "steps", "conclusion")
        got = answers.filter("new is not null").select("proof_id", "problem", "goal", F.col("new").alias("steps"), F.col("new_conclusion").alias("conclusion"))
        found = linear.verify(got.select("proof_id", F.inline("steps")), got.select("proof_id", "problem", "goal", "conclusion"))
        found = found.groupBy("proof_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "check", "severity", "blocking", "detail"))).alias("errors"))
        checked = stages.put("checked", got.join(found, "proof_id", "left").withColumn("errors", F.coalesce("errors", F.expr(f"cast(array() as array<{ERROR}>)"))))
        blocked = F.exists("errors", lambda e: e.blocking)
        last = checked if attempt == budget else checked.filter(~blocked)
        ended = lost.unionByName(last.select("proof_id", F.lit(attempt).alias("attempts"), "errors", "steps", "conclusion"))
        _, done = stages.add("done", ended)
        open_ = checked.filter(blocked).select("proof_id", "problem", "goal", "errors", "steps", "conclusion")
    if done is None:
        done = open_.withColumn("attempts", F.lit(0)).filter("false")
    accepted = ~F.exists("errors", lambda e: e.blocking & (e.severity == "high"))
    return done.select("proof_id", accepted.alias("accepted"), "attempts", "errors", "steps", "conclusion")


def recorded(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """respond for corrected() from a table of answers: proof_id, attempt, steps, conclusion."""
    return lambda asked: responses.join(asked.select("proof_id", "attempt"), ["proof_id", "attempt"], "left_semi").select("proof_id", "steps", "conclusion")
