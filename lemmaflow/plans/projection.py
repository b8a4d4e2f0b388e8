"""Proof graphs projected from the order tables, as stand-ins for proofs at scale.

One proof for each order: a node for each line (an assumption for line 1, else a lemma); line n > 1 is also
an inference from node n - 1 to node n whose rule is its return flag. Orders of status P have an inference
from the last line back to line 1. Allowed rules are A and R, obligations F and O, covered by line status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED, OBLIGATIONS = ["A", "R"], ["F", "O"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return line.select(
        F.col("l_orderkey").alias("proof_id"),
        F.col("l_linenumber").alias("node_pos"),
        F.concat(F.lit("L"), "l_linenumber").alias("id"),
        F.when(F.col("l_linenumber") == 1, "assumption").otherwise("lemma").alias("node_type"),
        F.array("l_linestatus").alias("covers"),
    )


def inferences(spark: SparkSession, sf_dir: str, back: bool = False) -> DataFrame:
    """back: with the inferences from the last line to line 1."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = line.filter("l_linenumber > 1").select(
        F.col("l_orderkey").alias("proof_id"),
        F.col("l_linenumber").alias("inf_pos"),
        F.concat(F.lit("I"), "l_linenumber").alias("id"),
        F.array(F.concat(F.lit("L"), F.col("l_linenumber") - 1)).alias("deps"),
        F.concat(F.lit("L"), "l_linenumber").alias("conclusion"),
        F.array("l_returnflag").alias("rules"),
    )
    if back:
        last = line.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
        open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
        ring = last.join(open_, "l_orderkey").select(F.col("l_orderkey").alias("proof_id"), F.lit(99).alias("inf_pos"), F.lit("I99").alias("id"), F.array(F.concat(F.lit("L"), "n")).alias("deps"), F.lit("L1").alias("conclusion"), F.array(F.lit("A")).alias("rules"))
        out = out.unionByName(ring)
    return out


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proof_id"), F.concat(F.lit("L"), 1 + F.col("o_orderkey") % 7).alias("goal"), F.col("o_orderstatus").alias("order_status"))


def one_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proofs, nodes, inferences): all lines and parts as one graph, for operators/largegraph.py.

    A line is a node (first lines are assumptions), a part another. Line n > 1 follows from the line before it in the
    order and its part together; its inference is blocked if its return flag is N. A part follows from a first line of at
    least 49 pieces, and from a later line of flag R. Lines of flag A declare a symbol, inferences of flag R too.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    line = line.select("*", F.expr("concat('o', l_orderkey, '.', l_linenumber)").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("part"), F.lit("all").alias("proof_id"))
    symbol = lambda c, n: f"concat('s', cast({c} as bigint) % {n})"
    nodes = line.select("proof_id", "id", F.expr("if(l_linenumber = 1, 'assumption', 'lemma')").alias("node_type"), F.expr(f"if(l_returnflag = 'A', array({symbol('l_suppkey', 5)}), array())").alias("declares"), F.expr(f"concat({symbol('l_partkey', 7)}, ' = y')").alias("claim_formal"))
    none = F.array().cast("array<string>")
    parts = line.select("proof_id", F.col("part").alias("id")).distinct().select("proof_id", "id", F.lit("lemma").alias("node_type"), none.alias("declares"), F.lit(None).cast("string").alias("claim_formal"))
    steps = line.filter("l_linenumber > 1").select(
        "proof_id",
        F.expr("concat('i', substring(id, 2), '.', l_partkey)").alias("id"),
        F.expr("array(concat('o', l_orderkey, '.', l_linenumber - 1), part)").alias("deps"),
        F.col("id").alias("conclusion"),
        F.expr("l_returnflag = 'N'").alias("blocked"),
        F.expr(f"if(l_returnflag = 'R', array({symbol('l_quantity', 5)}), array())").alias("declares"),
        F.expr(f"map('k', {symbol('l_suppkey', 7)})").alias("instantiation"),
    )
    given = line.filter("l_linenumber = 1 and l_quantity >= 49 or l_linenumber > 1 and l_returnflag = 'R'").select(
        "proof_id", F.expr("concat('j', substring(id, 2), '.', l_partkey)").alias("id"), F.array("id").alias("deps"), F.col("part").alias("conclusion"), F.lit(False).alias("blocked"), none.alias("declares"), F.expr("cast(null as map<string,string>)").alias("instantiation")
    )
    proofs = spark.range(1).select(F.lit("all").alias("proof_id"), F.lit("s0 + s6 = y").alias("goal_symbolic"), F.array(F.lit("y")).alias("base"))
    return proofs, nodes.unionByName(parts), steps.unionByName(given)
