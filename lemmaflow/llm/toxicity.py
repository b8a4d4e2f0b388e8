"""Toxic passages by maximum-scoring segments.

1. Labelled documents give each word, and each word beginning of 4 and of 5 letters, a log-odds of toxic
   against other text. Counts are smoothed with Dirichlet priors: a word's prior is centred on its longer
   beginning, that on the shorter one, and that on all text; so unseen forms of a toxic stem still score.
2. A word scores its log-odds less a drift, so ordinary text runs downhill. One linear scan finds all maximal
   scoring segments of a text.
3. A segment's score is calibrated as an extreme value: for a text of n words, E = K n exp(-lambda S)
   segments of that score are expected by chance. lambda comes from the word scores of untoxic text, K from
   the best segments of untoxic documents. Segments with E under a threshold are significant.
4. The best segment's -log p and the sum over significant ones give a probability by logistic regression.

Word scores and calibration are learned on different documents.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, rows, table

#: Labelled documents that the model is fitted on at most (those with the smallest hash of doc_id), and the
#: units of text that it keeps at most. So the model's size is bounded whatever the corpus.
TRAIN_ROWS, UNITS = 50_000, 200_000
#: Weight of each prior in words, the drift, and the expected chance segments below which one is significant.
PRIOR, DRIFT, SIGNIFICANT = 4.0, 1.0, 0.1
STRIP = ".,;:!?\"'()[]{}|#*$%&<>-_/\\…«»“”„’`~=+"


def word_of(raw: str) -> str:
    return raw.lower().strip(STRIP)


def units_of(word: str) -> list[str]:
    """The word and its beginnings, from the most general on."""
    return [f"{word[:k]}*" for k in (4, 5) if len(word) > k] + [word]


@dataclass
class Model:
    counts: dict = field(default_factory=dict)  # unit: (words in toxic text, in other text)
    totals: tuple = (1.0, 1.0)
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple = (-3.0, 0.0, 0.0)

    def score(self, word: str) -> float:
        """Log-odds under the chain of priors, less the drift."""
        t, o = self.totals
        base = rate = t / (t + o)
        for u in units_of(word) if word else ():
            a, b = self.counts.get(u, (0, 0))
            rate = (a + PRIOR * rate) / (a + b + PRIOR)
        return math.log(rate * (1 - base) / (base * (1 - rate))) - DRIFT

    def segments(self, text: str | None, cache: dict | None = None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments: first word, end, score."""
        import numpy as np

        words = (text or "").split()
        cache = _Scores(self) if cache is None else cache
        s = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        return len(words), maximal(s)

    def expected(self, n: int, score: float) -> float:
        return math.exp(min(50.0, self.log_k + math.log(max(n, 1)) - self.lam * score))

    def evidence(self, n: int, found) -> tuple[float, float]:
        """-log p of the best segment, and the sum of it over significant ones."""
        best = total = 0.0
        for _, _, score in found:
            e = self.expected(n, score)
            p = -math.log(-math.expm1(-e)) if e > 1e-12 else -math.log(max(e, 1e-300))
            best = max(best, p)
            total += p if e < SIGNIFICANT else 0.0
        return math.log1p(best), math.log1p(total)

    def probability(self, x: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * x[0] + self.weights[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Scores(dict):
    def __init__(self, model):
        self.model = model

    def __missing__(self, raw):
        s = self.model.score(word_of(raw))
        if len(self) < 400_000:
            self[raw] = s
        return s


def maximal(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Candidates are runs of positive scores. Each new one looks back, over candidates kept in a list, for the
    last that begins lower; if that one also ends lower, the two and all between become one candidate.
    """
    import numpy as np

    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    kept: list[list] = []  # start, end, total before, total after, place of the last candidate that begins lower
    for i in up.tolist():
        new = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
        kept.append(new)
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold (crc32 of doc_id as text, mod 5, is 0).

    labels: doc_id, toxic (null: not used). Folds 1 to 3 count words, fold 4 calibrates. Without labels of
    both kinds the model says that nothing is toxic. A doc_id with several labels has one of them, documents that
    repeat an id count each, whole texts are read, null texts have no words. Of units seen twice or more, the UNITS
    most frequent are kept, so the driver's share is bounded.
    """
    use = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    # At most TRAIN_ROWS rows of two numbers: a broadcast of bounded size, so no text is shuffled.
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    train = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").withColumn("fold", F.expr("cast(crc32(cast(doc_id as string)) % 5 as int)"))

    schema = "unit string, t long, o long"

    def count(batches):
        from collections import Counter

        got = (Counter(), Counter())
        for text, toxic in rows(batches, "text", "toxic"):
            for raw in (text or "").split():
                if w := word_of(raw):
                    got[toxic != 1].update(units_of(w))
                    got[toxic != 1][""] += 1
        yield from batched(((u, got[0][u], got[1][u]) for u in {*got[0], *got[1]}), arrow_schema(schema), 20_000)

    units = train.filter("fold < 4").select("text", "toxic").mapInArrow(count, schema).groupBy("unit").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    # "" has the totals and is the largest of all; units seen once say nothing.
    found = units.filter("t + o > 1").orderBy(F.desc(F.col("t") + F.col("o")), "unit").limit(UNITS).collect()
    counts = {r.unit: (r.t, r.o) for r in found}
    t, o = counts.pop("", (0, 0))
    if not t or not o:
        return Model()
    model = Model(counts, (float(t), float(o)))

    measured = "toxic int, n int, best double, n_up long, ups array<double>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        import numpy as np

        cache = _Scores(shared.value)

        def records():
            for text, toxic in rows(batches, "text", "toxic"):
                words = (text or "").split()
                s = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
                # Scores by half points, -10 to 10, for the distribution of untoxic words.
                yield toxic, len(words), max((x for _, _, x in maximal(s)), default=0.0), len(words), np.bincount(np.clip(np.round(s * 2) + 20, 0, 40).astype(int), minlength=41).astype(float)

        yield from batched(records(), arrow_schema(measured), 500)

    held = train.filter("fold = 4").select("text", "toxic").mapInArrow(measure, measured)
    bins = held.filter("toxic <> 1").select(F.posexplode("ups").alias("bin", "w")).groupBy("bin").agg(F.sum("w").alias("w")).collect()
    weight = {r.bin / 2 - 10: r.w for r in bins if r.w}
    model.lam = _positive_root(weight)
    # The best segment M of n untoxic words: lambda M - ln n is a standard Gumbel about ln K.
    best = held.filter("toxic <> 1 and n > 0 and best > 0").agg(F.avg(F.lit(model.lam) * F.col("best") - F.log("n")).alias("m")).first()["m"]
    model.log_k = (best - 0.5772156649) if best is not None else 0.0

    shared = docs.sparkSession.sparkContext.broadcast(model)
    points = "x0 double, x1 double, toxic int"

    def features(batches):
        m = shared.value
        cache = _Scores(m)
        yield from batched(((*m.evidence(*m.segments(text, cache)), toxic) for text, toxic in rows(batches, "text", "toxic")), arrow_schema(points), 20_000)

    # At most TRAIN_ROWS rows of three numbers.
    model.weights = _logistic([tuple(r) for r in train.filter("fold = 4").select("text", "toxic").mapInArrow(features, points).collect()])
    return model


def _positive_root(weight: dict[float, float]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; 1 if the scores have no such root."""
    total = sum(weight.values())
    f = lambda x: sum(w / total * math.exp(x * s) for s, w in weight.items()) - 1
    if not total or max(weight) <= 0 or sum(w * s for s, w in weight.items()) >= 0:
        return 1.0
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 16:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(points: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Weights by Newton steps with a small ridge; ones that call nothing toxic if only one label is there."""
    import numpy as np

    if len({int(p[2] == 1) for p in points}) < 2:
        return Model().weights
    a = np.array(points, float)
    x, y = np.c_[np.ones(len(a)), a[:, :2]], (a[:, 2] == 1).astype(float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 1e-2, 1e-2]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_words int, n_passages int, passages array<int>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), with the number of significant
    passages and their first and end words, in turn.

    Null and empty texts have no passage and the score of that. Repeated rows stay; no row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        cache = _Scores(m)

        def records():
            for d, text in rows(batches, "doc_id", "text"):
                n, found = m.segments(text, cache)
                p = m.probability(m.evidence(n, found))
                sure = [x for x in found if m.expected(n, x[2]) < SIGNIFICANT]
                yield d, d is not None and fold(d) == 0, p, int(p >= 0.5), n, len(sure), [w for x in sure for w in x[:2]]

        yield from batched(records(), arrow_schema(SCORED))

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "n_passages")
