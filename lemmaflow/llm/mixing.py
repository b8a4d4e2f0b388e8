"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets follow the weights but stop at a multiple of a source's size, the excess going to the others. Blocks
of equal token counts are given to sources by the highest quotients target / 1, / 3, / 5 ..., then each
source's blocks to its shards in the same way, so every shard has an integer quota. A shard orders its
documents by a seeded hash, cuts that stream into blocks and takes its quota of them at even steps from a
seeded start; a quota above the number of blocks takes some blocks twice.

Everything is arithmetic on one row per document, with no row per block. Shards are bounded in words, so a
source that holds a third of all rows has as many more of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, table

WEIGHTS = (3, 1, 2)
#: Words wanted as a share of all, and the most that a source gives as a multiple of its size.
SHARE, MOST = 1.5, 2
#: Blocks that the mix is cut into at least, while blocks stay under LONGEST words; blocks of a shard.
BLOCKS, LONGEST, SHARD = 20_000, 4096, 1024
SEED = 7


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """parties with a column quota: the seats that each group's parties get by highest quotients.

    Rounding votes * seats / total puts every party within a few seats of the result; only quotients in that
    reach are ranked, at most about three for each party. Ties go by the order columns. No votes: no seats.
    A group's parties are ranked in one task: sources, or a source's shards, one for millions of words.
    """
    g = Window.partitionBy(*group)
    share = F.expr(f"case when _all > 0 then floor({votes} * {seats} / _all + 0.5) else 0 end").cast("long")
    p = parties.withColumns({"_all": F.sum(votes).over(g).cast("double"), "_n": F.count("*").over(g)}).withColumn("_q", share)
    p = p.withColumn("_gap", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_q").over(g)).otherwise(0))
    reach = F.expr(f"cast(floor((_q + 1) * _n / greatest({seats}, 1)) + 2 as int)")
    tried = p.filter("_gap <> 0").withColumn("_j", F.explode(F.sequence(F.lit(0), reach)))
    tried = tried.filter("_gap > 0 or _j < _q").withColumn("_quotient", F.expr(f"case when _gap > 0 then {votes} / (2.0D * (_q + _j) + 1) else {votes} / (2.0D * (_q - _j) - 1) end"))
    best = Window.partitionBy(*group, F.col("_gap") > 0).orderBy(F.expr("case when _gap > 0 then -_quotient else _quotient end"), *order, "_j")
    moved = tried.withColumn("_rank", F.row_number().over(best)).filter("_rank <= abs(_gap)")
    keys = [*group, *[c for c in order if c not in group]]
    moved = moved.groupBy(*keys).agg(F.count("*").alias("_moved"))
    for c in keys:
        moved = moved.withColumnRenamed(c, f"_k_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    p = p.join(moved, same, "left").withColumn("quota", F.expr("_q + coalesce(_moved, 0) * sign(_gap)").cast("long"))
    return p.drop("_all", "_n", "_q", "_gap", "_moved", *[f"_k_{c}" for c in keys])


def seeded(seed: int, *columns: str):
    """Hexadecimal digits that depend on the seed and the columns' values."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def number(digits):
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, idx (place by code point, null last), weight, target.

    The level at which weight * level, held at most * source_size, sums to share * all sizes: sources are
    taken by their cap / weight, and the first at which the rest's level stays under its own cap fixes it.
    The table has one row for each source.
    """
    every = Window.partitionBy(F.lit(1))
    s = sizes.withColumn("idx", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * most, "total": F.sum("source_size").over(every) * share})
    by = every.orderBy(F.col("cap") / F.col("weight"), "idx")
    s = s.withColumns({"before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    ratio = F.col("cap") / F.col("weight")
    s = s.withColumn("level", F.first("level").over(every.orderBy(F.desc(F.col("level") <= ratio), ratio, "idx")))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))))
    return s.select("source", "source_size", "idx", "weight", "target", "total")


def placed_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, longest: int = LONGEST, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """mix() with idx and shard, the place of the source and the shard of each document."""
    own = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, weights, share, most)
    t = t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(F.col("total") / blocks))).cast("long"))
    t = t.withColumns({"seats": F.round(F.col("total") / F.col("block")).cast("long"), "one": F.lit(1)})
    t = sainte_lague(t, ["one"], "target", "seats", ["idx"]).withColumnRenamed("quota", "source_quota")
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * shard))).cast("long"))
    t = t.withColumnRenamed("source", "_source").select("_source", "idx", "source_size", "target", "block", "source_quota", "shards")

    key = seeded(seed, "doc_id")
    placed = own.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("key", key).withColumn("shard", F.pmod(number(F.col("key")), F.col("shards")))
    held = placed.groupBy("idx", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    held = sainte_lague(held, ["idx"], "words", "source_quota", ["shard"])
    held = held.withColumn("n_blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
    held = held.withColumns({"quota": F.least("quota", F.col("n_blocks") * most), "start": F.when(F.col("n_blocks") > 0, F.pmod(number(seeded(seed, "idx", "shard")), F.col("n_blocks"))).otherwise(0)})
    held = held.select("idx", "shard", "n_blocks", "quota", "start")

    stream = Window.partitionBy("idx", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("b", F.sum("size").over(stream)).join(held, ["idx", "shard"])
    before = lambda j: f"((({j}) * quota + start) div n_blocks)"  # noqa: E731  blocks taken of the first j
    words = lambda x: F.expr(f"({before(f'{x} div block')}) * block + ({before(f'{x} div block + 1')} - {before(f'{x} div block')}) * ({x} % block)")
    out = upto.withColumn("taken", F.when(F.col("n_blocks") > 0, words("b") - words("(b - size)")).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "idx", "shard")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) with size, source_size, target and taken, the words that the mix takes.

    Null text has size 0, null source is a source of its own, of empty sources nothing is taken. Repeated rows
    are separate documents. An empty table gives an empty result. The text column is only counted. A document's shard
    depends on its doc_id alone, so equal and null ids of a source are one shard's: such rows should get ids before.
    """
    return placed_mix(docs, **options).drop("idx", "shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same arithmetic for DuckDB.
OP4_SQL = r"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx, source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s1
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM s2
), s4 AS (
  SELECT *, first_value(lv) OVER (ORDER BY lv <= cap / weight DESC, cap / weight, idx) AS level,
    greatest(1, least(4096, floor(total / 20000)))::BIGINT AS block FROM s3
), s5 AS (
  SELECT *, least(cap::DOUBLE, coalesce(weight * level, cap::DOUBLE)) AS target, round(total / block)::BIGINT AS seats FROM s4
), s6 AS (
  SELECT *, sum(target) OVER () AS alltargets, floor(target * seats / sum(target) OVER () + 0.5)::BIGINT AS q FROM s5
), s7 AS (
  SELECT *, (seats - sum(q) OVER ())::BIGINT AS gap FROM s6
), tried AS (
  SELECT idx, gap, j, CASE WHEN gap > 0 THEN target / (2.0::DOUBLE * (q + j) + 1) ELSE target / (2.0::DOUBLE * (q - j) - 1) END AS quotient
  FROM s7, unnest(range(0, 40)) AS r(j) WHERE gap <> 0 AND (gap > 0 OR j < q)
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN gap > 0 THEN -quotient ELSE quotient END, idx, j) AS rk FROM tried
), moved AS (
  SELECT idx, count(*) AS n FROM ranked WHERE rk <= abs(gap) GROUP BY idx
), t AS (
  SELECT s7.*, (q + coalesce(n, 0) * sign(gap))::BIGINT AS source_quota, greatest(1, ceil(source_size / (block * 1024)))::BIGINT AS shards
  FROM s7 LEFT JOIN moved USING (idx)
), placed AS (
  SELECT o.doc_id, o.size, t.idx, t.source_size, t.target, t.block, t.source_quota, md5('7:' || coalesce(o.doc_id::VARCHAR, '')) AS key,
    ('0x' || substr(md5('7:' || coalesce(o.doc_id::VARCHAR, '')), 1, 8))::BIGINT % t.shards AS shard
  FROM own o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), h0 AS (
  SELECT idx, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS seats, any_value(block) AS block FROM placed GROUP BY idx, shard
), h1 AS (
  SELECT *, CASE WHEN sum(words) OVER g > 0 THEN floor(words * seats / (sum(words) OVER g)::DOUBLE + 0.5) ELSE 0 END::BIGINT AS q, sum(words) OVER g AS alls FROM h0 WINDOW g AS (PARTITION BY idx)
), h2 AS (
  SELECT *, CASE WHEN alls > 0 THEN seats - sum(q) OVER (PARTITION BY idx) ELSE 0 END::BIGINT AS gap FROM h1
), htried AS (
  SELECT idx, shard, gap, j, CASE WHEN gap > 0 THEN words / (2.0::DOUBLE * (q + j) + 1) ELSE words / (2.0::DOUBLE * (q - j) - 1) END AS quotient
  FROM h2, unnest(range(0, 40)) AS r(j) WHERE gap <> 0 AND (gap > 0 OR j < q)
), hranked AS (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN gap > 0 THEN -quotient ELSE quotient END, shard, j) AS rk FROM htried
), hmoved AS (
  SELECT idx, shard, count(*) AS n FROM hranked WHERE rk <= abs(gap) GROUP BY idx, shard
), h3 AS (
  SELECT h2.idx, h2.shard, ceil(words / block::DOUBLE)::BIGINT AS n_blocks, (q + coalesce(n, 0) * sign(gap))::BIGINT AS quota0
  FROM h2 LEFT JOIN hmoved USING (idx, shard)
), h AS (
  SELECT idx, shard, n_blocks, least(quota0, n_blocks * 2) AS quota,
    CASE WHEN n_blocks > 0 THEN ('0x' || substr(md5('7:' || idx || ':' || shard), 1, 8))::BIGINT % n_blocks ELSE 0 END AS start FROM h3
), stream AS (
  SELECT placed.*, n_blocks, quota, start,
    (sum(size) OVER (PARTITION BY idx, shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS b
  FROM placed JOIN h USING (idx, shard)
), ends AS (
  SELECT *, b // block AS jb, (b - size) // block AS ja FROM stream WHERE n_blocks > 0
), taken AS (
  SELECT doc_id, size, source_size, target,
    ((jb * quota + start) // n_blocks * block + (((jb + 1) * quota + start) // n_blocks - (jb * quota + start) // n_blocks) * (b % block))
    - ((ja * quota + start) // n_blocks * block + (((ja + 1) * quota + start) // n_blocks - (ja * quota + start) // n_blocks) * ((b - size) % block)) AS taken
  FROM ends
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM taken
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM stream WHERE n_blocks = 0
"""


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: taken / size times, rounded so that sums hold; docs' own
    columns.

    What rounding adds or leaves is carried on through each shard, from its longest document to its shortest.
    Every document comes floor or ceil of taken / size times, and a shard's words differ from what the mix takes
    of it by half its longest document at most. Documents without words are not taken. Rows equal in doc_id, source
    and size are one document here: each comes equally often.
    """
    own = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text")
    own = own.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")).drop("text")
    times = placed_mix(docs.select("doc_id", "source", "text"), **options).filter("size > 0").groupBy("idx", "shard", "doc_id", "source", "size").agg(F.avg("taken").alias("taken"), F.count("*").alias("n"))
    longest = Window.partitionBy("idx", "shard").orderBy(F.desc(F.col("n") * F.col("size")), "doc_id", "size")
    times = times.withColumn("upto", F.round(F.sum(F.col("taken") / F.col("size")).over(longest.rowsBetween(Window.unboundedPreceding, 0))))
    times = times.withColumn("times", (F.col("upto") - F.lag("upto", 1, 0.0).over(longest)).cast("int")).filter("times > 0")
    times = times.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "times")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    return own.join(times.hint("shuffle_hash"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select("_row.*")
