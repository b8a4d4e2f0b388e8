"""Target-distribution importance resampling over hashed n-gram features.

Features are runs of consecutive words; each falls in the bucket that the CRC-32 of its bytes gives. The log-ratio
of a bucket's frequency in a target table and in the documents is its gain; a document's weight is the sum of
the gains of its features, and adding Gumbel noise, seeded by doc_id, to the weights and taking the highest is a draw
without replacement in proportion to exp(weight).

The CRCs of a batch's new features are made together: features of equal length are the rows of a
two-dimensional uint8 array, and each step updates all of its CRCs by one column. Counts of both tables are
at most BUCKETS rows, all else stays in Spark. Ranks come from one range-partitioned sort of (score, doc_id) rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, partitions, slices, staged, table

#: Parameters of the query: runs of up to MAX_N words, buckets, gains in thousandths.
MAX_N, BUCKETS, SCALE = 1, 10_000, 1000
#: Share drawn in per cent of the documents with at least MIN_WORDS words, and the seed of the noise.
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
#: Bytes from which on a feature is hardly ever one of several of its length: a column would be a single byte.
LONG = 1024
#: Features whose buckets a Python worker keeps; the memory is emptied when full.
CACHED = 300_000


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def crc_matrix(m: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, all rows updated column by column."""
    c = np.full(m.shape[0], 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(m.T):
        c = CRC[(c ^ column) & 0xFF] ^ (c >> np.uint32(8))
    return ~c


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature: grouped by length, a matrix for each, scattered back."""
    out = np.zeros(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    starts = np.flatnonzero(np.diff(sizes, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(features)]):
        at = order[a:b]
        if sizes[a] > LONG:
            out[at] = [zlib.crc32(features[i]) for i in at]
        elif sizes[a]:
            out[at] = crc_matrix(np.frombuffer(b"".join([features[i] for i in at]), np.uint8).reshape(b - a, sizes[a]))
    return out


#: Bytes as they are split: A-Z lower-cased, letters, digits and all bytes over 127 kept, the rest blanks.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Hasher:
    """Buckets of a text's features, with a bounded memory of those seen."""

    def __init__(self, max_n: int, buckets: int):
        self.max_n, self.buckets, self.known = max_n, buckets, {}

    def features(self, text: str | None) -> tuple[list[bytes], int]:
        words = (text or "").encode().translate(_KEPT).split()
        out = list(words)
        for n in range(2, self.max_n + 1):
            out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return out, len(words)

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """(buckets of all features, number of words) of each text; the new features of all texts are hashed together."""
        made = [self.features(t) for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        new = list({f for fs, _ in made for f in fs} - self.known.keys())
        if new:
            self.known.update(zip(new, (crcs(new) % np.uint32(self.buckets)).tolist()))
        get = self.known.__getitem__
        return [(np.fromiter(map(get, fs), np.int64, len(fs)), n) for fs, n in made]


def bucket_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts in each bucket (those with any). Each task sends at most `buckets` rows."""

    def run(batches):
        h, total = Hasher(max_n, buckets), np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            for ids, _ in h.batch([t for (t,) in part]):
                total += np.bincount(ids, minlength=buckets)
        yield from batched(((int(b), int(total[b])) for b in np.flatnonzero(total)), arrow_schema("bucket long, n long"))

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: SCALE times the log-ratio of its smoothed frequencies, rounded down. At most 2 * buckets rows come to the driver."""
    s, t = [dict(map(tuple, bucket_counts(d, max_n, buckets).collect())) for d in (docs, target)]
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    return [math.floor(SCALE * math.log((float(t.get(b, 0)) + 1) * (all_s + buckets) / ((float(s.get(b, 0)) + 1) * (all_t + buckets)))) for b in range(buckets)]


WEIGHED = "doc_id long, key long, n_features long, weight long, score long, n_words long"


def weighed(docs: DataFrame, gain: list[int], max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """doc_id, key (a hash of the text), n_features, weight, score, n_words of every document.

    Null, empty and wordless texts have no features and weight 0. A null doc_id is seeded as the word null. Repeated rows
    get the same score each.
    """

    def run(batches):
        h, g = Hasher(max_n, len(gain)), np.array(gain, np.int64)

        def records():
            for part in slices(batches, "doc_id", "key", "text"):
                for (d, key, _), (ids, n) in zip(part, h.batch([t for *_, t in part])):
                    weight = int(g[ids].sum())
                    u = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
                    yield d, key, len(ids), weight, weight + math.floor(-SCALE * math.log(-math.log((u + 0.5) / 4294967296))), n

        yield from batched(records(), arrow_schema(WEIGHED))

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, WEIGHED)


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... by score for the drawn share of the documents with min_words words or more, null for others.

    Ties go to the smaller doc_id (null last), then to the row with fewer features; rows equal in all of these take any order.
    The rows are dealt by ranges of that order and written sorted, so a row's rank is its place in its part and the sizes
    of the parts before it, which are as many numbers as there are shuffle partitions.
    """
    spark = scored.sparkSession
    # Written first, as the ranges are found by a pass of their own.
    d = staged(scored, "scored").withColumn("out", F.coalesce(F.col("n_words") < min_words, F.lit(True)))
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    d = staged(d.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, d.groupBy(part.alias("part")).agg(F.count_if(~F.col("out")).alias("n")).collect()))
    quota, before, offsets = sum(n for _, n in sizes) * percent // 100, 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    # A row for each shuffle partition at most.
    starts = spark.createDataFrame(offsets, "part long, before long")
    d = d.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return d.withColumn("rank", F.when(~F.col("out") & (rank <= quota), rank)).drop("part", "before", "at", "out")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, all columns as they are (of any name), in no order.

    Copies of one row (equal doc_id and text) are drawn together or not at all when the last place falls among them.
    An empty docs gives an empty result; an empty target counts as even over all buckets.
    """
    drawn = ranked(weighed(docs, gains(docs, target, max_n, buckets), max_n, seed), percent, min_words).filter("rank is not null")
    drawn = drawn.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    packed = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    return packed.join(drawn, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_k")), "left_semi").select("_row.*")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(weighed(docs, gains(docs, table(spark, sf_dir, "benchmark")))).drop("key", "n_words")


OP12_SQL = r"""
WITH c AS (
  SELECT list(v ORDER BY n) AS steps FROM (
    SELECT n, list_reduce([n] || range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS n))
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents
), f AS (
  SELECT 0 AS side, rid, unnest(words) AS w FROM d
  UNION ALL SELECT 1, 0, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) FROM benchmark
), x AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda v, b: xor(steps[(xor(v, b) & 255) + 1], v >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM f), c
), n AS (
  SELECT b AS bucket, count(rid) FILTER (side = 0)::DOUBLE AS s, count(rid) FILTER (side = 1)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN (SELECT * FROM f JOIN x USING (w)) j ON j.bucket = b GROUP BY b
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n
), w AS (
  SELECT rid, sum(gain)::BIGINT AS weight FROM f JOIN x USING (w) JOIN g USING (bucket) WHERE side = 0 GROUP BY rid
), k AS (
  SELECT rid, doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)
), r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS total FROM k WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM k LEFT JOIN r USING (rid)
"""
