"""Quality rules in a short-circuit cascade, in Spark expressions only.

Each rule is a SQL predicate that is true for a document to reject. On a sample, each rule's cost (time of a
pass with it, less the time of a pass without, the least of REPEATS) and rejection rate are measured; the cascade
is one CASE expression with the rules by rejection per cost, so a document leaves it at the first rule that
rejects it. A rule's inputs stand in its branch: those of later rules are not computed for documents that have
left. The order changes the time and which reason is named, never the verdict.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

SEPARATORS = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_LINES = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
# Windows as hashes: a text without a repeated one needs no more than their array.
_WINDOWS = "case when size(words) > 2 then transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) else cast(array() as array<bigint>) end"
_AGAIN = "filter(sequence(0, size(s) - 1), k -> get(s, k).h = get(s, k - 1).h or get(s, k).h = get(s, k + 1).h)"
_COVERED = f"size(array_distinct(flatten(transform({_AGAIN}, k -> array(get(s, k).i, get(s, k).i + 1, get(s, k).i + 2)))))"
_SORTED = "sort_array(transform(ws, (h, i) -> struct(h, i)))"
#: Inputs of rules as SQL over text and words; n_repeat_words: words in a 3-word window that the text holds twice or more, all occurrences.
INPUTS = {
    "n_words": "cast(size(words) as bigint)",
    "word_chars": "cast(length(array_join(words, '')) as bigint)",
    "n_symbols": f"cast(length(regexp_replace(text, '[^{SYMBOLS}]+', '')) as bigint)",
    "n_lines": f"cast(size({_LINES}) as bigint)",
    "n_dup_lines": let("ls", _LINES, "cast(size(ls) - size(array_distinct(ls)) as bigint)"),
    "n_repeat_words": let("ws", _WINDOWS, f"cast(case when size(array_distinct(ws)) < size(ws) then {let('s', _SORTED, _COVERED)} else 0 end as bigint)"),
}


#: Predicates over text, words and INPUTS.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("exclamations", "2 * length(regexp_replace(text, '[^!?]+', '')) > n_words"),
    Rule("capitals", r"2 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > length(regexp_replace(text, '[^\\p{L}]+', ''))"),
    Rule("letterless_words", r"10 * size(filter(words, w -> w rlike '\\p{L}')) < 7 * n_words"),
)
BASE = {"few_words", "repeated_words"}
#: Rows of the sample at most. Costs and rates are estimated on it; every document is judged in full.
SAMPLE_ROWS = 2000
#: Timings of each rule; the least one counts.
REPEATS = 3


def worded(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty) and words, computed once however often they are used."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("_words", F.expr(f"filter(split(text, '{SEPARATORS}'), w -> w <> '')"))
    return d.withColumn("words", F.explode(F.array("_words"))).drop("_words")


def measured(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty), words and all of INPUTS, which replace columns of these names.

    The same values as INPUTS', with the steps of n_dup_lines and n_repeat_words as columns: Spark compiles those, while
    what stands in a lambda is interpreted.
    """
    d = worded(docs).withColumn("_lines", F.expr(_LINES)).withColumn("_windows", F.expr(_WINDOWS))
    d = d.withColumns({name: F.expr(INPUTS[name]) for name in ("n_words", "word_chars", "n_symbols")} | {"n_lines": F.expr("cast(size(_lines) as bigint)"), "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)")})
    d = d.withColumn("s", F.expr(f"case when size(array_distinct(_windows)) < size(_windows) then {_SORTED.replace('(ws,', '(_windows,')} end"))
    return d.withColumn("n_repeat_words", F.expr(f"cast(case when s is null then 0 else {_COVERED} end as bigint)")).drop("s", "_lines", "_windows")


def inlined(rejects: str) -> str:
    """A rule's predicate with its inputs' SQL in place of their names."""
    return re.sub(r"\b(" + "|".join(INPUTS) + r")\b", lambda m: f"({INPUTS[m[0]]})", rejects)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 1) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, each with its rate and cost in seconds on a sample of docs.

    An empty table gives the rules as they stand, with rate and cost 0.
    """
    total = docs.count()
    sample = staged(docs.select("text").sample(fraction=min(1.0, rows / max(total, 1)), seed=seed).limit(rows), "quality-sample")
    sample = worded(sample)

    def run(*tests):
        began = time.perf_counter()
        row = sample.agg(F.count("*").alias("n"), *[F.count_if(F.expr(inlined(t))).alias(f"r{i}") for i, t in enumerate(tests)]).first()
        return time.perf_counter() - began, row

    run()
    floor, row = min((run() for _ in range(REPEATS)), key=lambda x: x[0])
    if not row["n"]:
        return [(r, 0.0, 0.0) for r in rules]
    found = []
    for r in rules:
        seconds, got = min((run(r.rejects) for _ in range(REPEATS)), key=lambda x: x[0])
        found.append((r, got["r0"] / row["n"], max(seconds - floor, 1e-3)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def reason(order: list[Rule], predicate=inlined):
    """The name of the first rule that rejects, null for documents to keep; over worded() documents. predicate: what
    makes SQL of a rule's predicate (str where its inputs are columns already)."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(F.expr(predicate(r.rejects)), F.lit(r.name)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with reason: which rule rejects the document (null: keep). A column of that name is replaced.

    Null and empty texts have no words and are rejected by few_words. Repeated rows are judged alike; an empty table
    gives an empty result.
    """
    order = [r for r, _, _ in ordered(docs, rules)]
    own = docs.select(F.struct(*[c for c in docs.columns if c != "reason"]).alias("_row"), F.col("text"))
    # Behind a generator, a filter on reason isn't pushed into the projection, where it would be computed again.
    made = worded(own).withColumn("_reason", reason(order)).select("_row.*", F.explode(F.array("_reason")).alias("reason"))
    return made


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' own columns, whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("_own"), F.col("text"))
    return judged(packed, rules).filter("reason is null").select("_own.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = [r for r, _, _ in ordered(docs) if r.name not in BASE]
    base = [r for r in RULES if r.name in BASE]
    out = measured(docs)  # all counts are asked for here, so they are columns
    out = out.withColumn("base_failed", reason(base, str).isNotNull())
    out = out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(reason(extra, str).isNull()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w, unnest(range(1, len(words) - 1)) AS r(i) WHERE len(words) > 2
), again AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, text, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > n_lines
    OR 2 * length(regexp_replace(text, '[^!?]+', '', 'g')) > n_words
    OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
    OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 7 * n_words) AS kept
FROM b
"""
