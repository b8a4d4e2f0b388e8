"""Artifacts and stages on disk: JSON or Parquet in, JSON, Parquet or a Markdown report out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The benchmark problems and the theorem library.
PROBLEMS = [
    ("chain_rule_sin_x2", "Prove the chain rule and use it to prove that d/dx sin(x^2) = 2*x*cos(x^2).", "chain_rule", "d/dx sin(x^2) = 2*x*cos(x^2)"),
    ("mean_value_theorem_general", "Prove the Mean Value Theorem: if f is continuous on [a,b] and differentiable on (a,b), then there exists c in (a,b) such that f'(c) = (f(b)-f(a))/(b-a).", "mean_value_theorem", "exists c in (a,b) such that f'(c) = (f(b)-f(a))/(b-a)"),
    ("ivt_general", "Prove the Intermediate Value Theorem: if f is continuous on [a,b] and N lies between f(a) and f(b), then there exists c in [a,b] such that f(c)=N.", "intermediate_value_theorem", "exists c in [a,b] such that f(c)=N"),
]
THEOREMS = [
    "assumption_use", "goal_alignment", "algebraic_simplification", "derivative_rule", "chain_rule",
    "product_rule", "quotient_rule", "power_rule", "implicit_differentiation", "limit_rule",
    "lhopital_rule", "squeeze_theorem", "epsilon_delta_definition", "integration_by_parts", "substitution_rule",
    "fundamental_theorem_of_calculus", "continuity", "differentiability", "uniform_continuity", "mean_value_theorem",
    "rolles_theorem", "intermediate_value_theorem", "IVT", "extreme_value_theorem", "taylor_series",
    "taylor_theorem", "convergence", "divergence_test", "comparison_test",
]


def problems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBLEMS, "problem_id string, raw_problem string, kind string, goal_symbolic string")


def theorems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in THEOREMS], "theorem string")


def load_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table (Parquet, or JSON by its ending); None if it is not there."""
    try:
        return spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_stage(df: DataFrame, path: str) -> None:
    w = df.write.mode("overwrite")
    w.json(path) if path.endswith(".json") else w.parquet(path)


def staged_run(spark: SparkSession, stages: list, path: str, start_from: str | None = None, stop_after: str | None = None) -> DataFrame | None:
    """Run stages [(name, function of (spark, table before))] in turn, each saved below path. start_from takes
    the tables before it from an earlier run; stop_after ends the run behind that stage."""
    table, began = None, start_from is None
    for name, stage in stages:
        began = began or name == start_from
        if began:
            save_stage(stage(spark, table), f"{path}/{name}")
        table = load_stage(spark, f"{path}/{name}")
        if name == stop_after:
            break
    return table


def report(errors: DataFrame, path: str) -> None:
    """A Markdown table of error rows as text files, one line per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in errors.columns]
    errors.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("append").text(path)
