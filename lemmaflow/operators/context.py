"""Which statements stand in which texts, by an index join in place of a comparison of each text with each statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece. A statement asks for its first, middle and last piece; a shorter one is its own piece.
PIECE = 12
#: Characters of a text whose stretches are made at once.
CUT = 100_000


def stretches(texts: DataFrame, size: int) -> DataFrame:
    """text_id, text_key, h: hashes of all stretches of size characters of the texts (_norm), linear in their length."""
    part = F.transform(F.sequence(F.lit(0), F.floor((F.length("_norm") - 1) / CUT).cast("int")), lambda i: F.substring("_norm", i * CUT + 1, F.lit(CUT + size - 1)))
    cut = texts.filter(F.length("_norm") >= size).select("text_id", "text_key", F.explode(part).alias("part"))
    # Made by a regular expression without a width: Spark's substring counts characters from the beginning each time.
    return cut.select("text_id", "text_key", F.explode(F.regexp_extract_all("part", F.lit(f"(?s)(?=(.{{{size}}}))"), 1)).alias("w")).select("text_id", "text_key", F.xxhash64("w").alias("h"))


def contained(texts: DataFrame, parts: DataFrame, piece: int = PIECE, normalized: Callable[[str], Column] = F.col) -> DataFrame:
    """text_id, part_id of all parts that stand in a text, once each.

    texts: text_id, text; parts: part_id, part; both are compared as normalized makes them, and that of texts
    which are no candidates only once. Exact: a text that holds a part holds its pieces, and every candidate is compared. Null
    and empty parts and texts stand nowhere and hold nothing. Equal ids are told apart by nothing: a hit of one row is a hit of its
    id. Each text gives a row for each of its stretches that some part asks for; parts shorter than a piece add one pass over the texts for each of
    their lengths, at most piece - 1.
    """
    p = parts.select("part_id", normalized("part").alias("part")).filter("part <> ''").distinct()
    made = texts.select("text_id", F.xxhash64("text").alias("text_key"), F.explode(F.array(normalized("text"))).alias("_norm"))
    size = F.least(F.length("part"), F.lit(piece))
    at = F.array_distinct(F.array(F.lit(1), (F.length("part") - size) / 2 + 1, F.length("part") - size + 1).cast("array<int>"))
    p = p.withColumns({"size": size, "pieces": F.transform(at, lambda i: F.substring("part", i, F.least(F.length("part"), F.lit(piece))))})
    p = p.withColumn("pieces", F.array_distinct(F.transform("pieces", lambda w: F.xxhash64(w))))
    asked = p.select("part_id", "part", "size", F.size("pieces").alias("n"), F.explode("pieces").alias("h"))
    lengths = sorted(r[0] for r in p.select("size").distinct().collect())
    found = None
    for n in lengths:
        mine = asked.filter(F.col("size") == n)
        # All texts' stretches are many, those that are asked for few: the asked hashes alone meet them first.
        held = stretches(made, n).join(mine.select("h").distinct(), "h", "left_semi").distinct()
        some = held.join(mine, "h").groupBy("text_id", "text_key", "part_id", "part").agg(F.count("*").alias("met"), F.first("n").alias("n"))
        some = some.filter("met = n").select("text_id", "text_key", "part_id", "part")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return texts.select("text_id").join(p.select("part_id"), F.lit(False))
    whole = texts.select(F.col("text_id").alias("_t"), F.xxhash64("text").alias("_k"), "text")
    both = found.join(whole, F.col("text_id").eqNullSafe(F.col("_t")) & (F.col("text_key") == F.col("_k")))
    return both.filter(F.contains(normalized("text"), F.col("part"))).select("text_id", "part_id").distinct()
