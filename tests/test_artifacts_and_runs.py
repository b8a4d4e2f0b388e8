"""Schema checks, retries, stored results, and generated text that used to end a job."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import jsonrepair, symbolic
from lemmaflow.operators import attempts, context, correction, schema
from lemmaflow.sources.memo import Memo

GOOD = [
    {"problem_id": "p", "raw_problem": "r", "goal": {"text": "t", "symbolic": "s"}, "technical_terms": ["a"], "domain": {"x": "real"}},
    {"goal": {}, "obligations": [{"id": "O1", "description": "d", "status": "pass"}], "allowed_references": ["r"], "acceptance_rubric": []},
    {"proof_id": "p", "current_graph_version": 2, "nodes": [{"id": "A", "node_type": "goal", "claim": "c", "status": "planned", "proof_body": {}}], "inferences": []},
]


def shown(value):
    """Objects with sorted keys and whole numbers without a fraction, as VARIANT has them."""
    if isinstance(value, (dict, list)):
        return re.sub(r"\.0\b", "", json.dumps(value, separators=(",", ":"), sort_keys=True))
    return repr(value).removesuffix(".0") if isinstance(value, float) else repr(value)


def plain(value, rules, path=()):
    """A validator of the same keywords, one value at a time."""
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value)) or ("integer" if value == int(value) else "number")
    out = []
    for k, r in rules.items():
        if k == "type" and kind != r and not (r == "number" and kind == "integer"):
            out.append((path, f"{shown(value)} is not of type {r!r}"))
        elif k == "required" and kind == "object":
            out += [(path, f"{n!r} is a required property") for n in r if n not in value]
        elif k == "enum" and value not in r:
            out.append((path, f"{shown(value)} is not one of {r!r}"))
        elif k == "properties" and kind == "object":
            out += [e for n, s in r.items() if n in value for e in plain(value[n], s, (*path, n))]
        elif k == "items" and kind == "array":
            out += [e for i, x in enumerate(value) for e in plain(x, r, (*path, i))]
    return out


def damaged(value, r):
    """A copy with values replaced, dropped or doubled at random."""
    value = json.loads(json.dumps(value))
    for _ in range(r.randrange(1, 5)):
        box = value
        while True:
            keys = list(box) if isinstance(box, dict) else list(range(len(box)))
            if not keys:
                break
            k = r.choice(keys)
            if isinstance(box[k], (dict, list)) and box[k] and r.random() < 0.7:
                box = box[k]
                continue
            what = r.randrange(4)
            if what == 0:
                del box[k]
            elif what == 1 and isinstance(box, list):
                box.append(box[k])
            else:
                box[k] = r.choice([7, -1.5, 2.0, True, None, "x y", "it", [], [1, "b"], {}, {"k": 1}])
            break
    return value


@pytest.mark.parametrize("rules,good", list(zip((schema.PROBLEM, schema.CONTRACT, schema.GRAPH), GOOD)))
def test_schema_equals_a_plain_validator(spark, rules, good):
    r = random.Random(5)
    artifacts = [good, 7, [], "x", None, *(damaged(good, r) for _ in range(150))]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(artifacts)], "i int, a string")
    got = schema.checked(rows, "a", rules).select("i", "violations", schema.by_path("violations").alias("sorted"), schema.messages("violations").alias("texts"), schema.first_messages("graph", "violations").alias("first"))
    for row in got.collect():
        want = [(p, m) for p, m in plain(artifacts[row.i], rules)]
        steps = lambda e: tuple(s.s or s.i for s in e.path)
        assert [(steps(e), e.message) for e in row.violations] == want
        assert [(steps(e), e.message) for e in row.sorted] == sorted(want, key=lambda e: [(s, "") if isinstance(s, int) else (0, s) for s in e[0]])
        texts = [f"{chr(39).join(map(str, p)) or '<root>'}: {m}" for p, m in want]
        assert row.texts == texts and row["first"] == ("graph schema errors: " + "; ".join(texts[:5]) if texts else None)


def test_schema_of_no_json(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, '{"a":'), (4, '{"a": 1}')], "k int, _artifact2 string")
    got = {r.k: [(list(e.path), e.keyword) for e in r.violations] for r in schema.checked(rows, "_artifact2", {"type": "object", "properties": {"a": {"type": "number"}}}).collect()}
    assert got == {1: [([], "json")], 2: [([], "json")], 3: [([], "json")], 4: []}
    assert schema.checked(rows.limit(0), "_artifact2", schema.GRAPH).count() == 0


def retried(outcomes, compact, limit=3, on_failure=True):
    """The retries as a loop: (chosen, attempts, calls, prompts, failure)."""
    attempt, tried, prompt, prompts = 0, False, "original", []
    for i, o in enumerate(outcomes):
        attempt += 1
        prompts.append(prompt)
        if o == "valid":
            return i, attempt, len(prompts), prompts, None
        first = o == "too_long" or o != "error" and attempt == 1 and on_failure
        if compact and not tried and first:
            prompt, tried, attempt = "compact", True, attempt - 1
        elif o in ("too_long", "error"):
            return None, attempt, len(prompts), prompts, "error"
        elif attempt >= limit:
            return None, attempt, len(prompts), prompts, "exhausted"
        else:
            prompt = "repair"
    return None, attempt, len(prompts), prompts, "open"


@pytest.mark.parametrize("limit,on_failure", [(3, True), (3, False), (1, True), (5, False)])
def test_attempt_ladder(spark, limit, on_failure):
    r = random.Random(limit)
    cases = [([r.choice(["valid", "invalid", "invalid", "invalid", "too_long", "error", None]) for _ in range(r.randrange(1, 8))], r.random() < 0.5) for _ in range(300)]
    rows = [(k if k else None, i, o, c) for k, (os, c) in enumerate(cases) for i, o in enumerate(os)]
    rows += [(5, None, "valid", True), *[x for x in rows if x[0] == 7]]
    got = attempts.ladder(spark.createDataFrame(rows, "k int, order long, outcome string, compact boolean").repartition(3), ["k"], limit, on_failure).collect()
    assert {r.k or 0: tuple(r)[1:] for r in got} == {k: retried([o or "invalid" for o in os], c, limit, on_failure) for k, (os, c) in enumerate(cases)}


def test_attempt_ladder_of_a_hot_key(spark):
    """One key with most rows: groups are limited before the shuffle."""
    rows = spark.range(200_000).selectExpr("if(id < 150000, 1, id) as k", "id as order", "'invalid' as outcome", "true as compact")
    out = attempts.ladder(rows, ["k"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert out.filter("k = 1").first().failure == "exhausted" and out.count() == 50_001


def test_memo_runs(spark, tmp_path):
    calls = []

    def compute(df):
        df = df.cache()
        calls.append(sorted((r.a or "", r.b) for r in df.collect()))
        return df.select("key", F.expr("length(a) + b").alias("n"))

    memo = Memo(spark, f"file://{tmp_path}/store", "n int")
    rows = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "yy", 1), (4, None, 2), (5, None, 2)], "i int, a string, b int")
    first = memo.run(rows.filter("i < 4"), ["a", "b"], "r1", compute)
    assert sorted((r.i, r.n, r.reused) for r in first.collect()) == [(1, 2, False), (2, 2, False), (3, 3, False)]
    second = memo.run(rows, ["a", "b"], "r2", compute)
    assert sorted((r.i, r.n, r.reused) for r in second.collect()) == [(1, 2, True), (2, 2, True), (3, 3, True), (4, None, False), (5, None, False)]
    assert calls == [[("x", 1), ("yy", 1)], [("", 2)]]
    # A run that is repeated computes its part again and replaces it; one cut off counts as not there.
    memo.run(rows, ["a", "b"], "r2", compute)
    assert calls[-1] == [("", 2)] and memo.known().count() == 3 and memo.runs() == ["r1", "r2"]
    (tmp_path / "store" / "r1" / "_SUCCESS").unlink()
    assert memo.runs() == ["r2"] and memo.known().count() == 1
    assert memo.run(rows.limit(0), ["a", "b"], "r3", compute).count() == 0
    # Columns of the rows named like the result's.
    again = memo.run(rows.withColumn("n", F.lit("old")).withColumn("key", F.col("i")), ["a", "b"], "r4", compute)
    assert again.columns == ["i", "a", "b", "key", "n", "reused"] and {r.n for r in again.collect()} == {2, 3, None}
    with pytest.raises(ValueError):
        memo.run(rows, ["a"], "_r", compute)


JOB_ENDERS = [
    ('{"a": "\\ud83d\\ude00",', {"a": "\U0001f600"}),
    ('{"a": "\\ud83d x",', {"a": "� x"}),
    ("{'a': b'x'}", None),
    ("{'a': {1, 2}}", None),
    ('{"a": NaN, "b": [Infinity, 1]}', {"a": None, "b": [None, 1]}),
    ("{'a': 1j}", None),
]


def test_json_that_ended_jobs(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JOB_ENDERS)], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", jsonrepair.parsed("t").alias("j")).collect()}
    assert {i: j and json.loads(j) for i, j in got.items()} == {i: w for i, (_, w) in enumerate(JOB_ENDERS)}


def test_deep_nesting_around_one_bad_character():
    began = time.perf_counter()
    assert jsonrepair.found_object('{"a":' * 3000 + "?" + "}" * 3000) is None
    assert jsonrepair.found_object('{"a":' * 300 + "?" + "}" * 300 + ' {"b": 1}') == {"b": 1}
    assert jsonrepair.found_object('{"a": ? {"b": {"c": 1}}}') == {"b": {"c": 1}}
    assert time.perf_counter() - began < 5


TRUE_CLAIMS = ["f(2) = f(2)", "f(g(x)) = f(g(x))", "1" + "+1" * 2000 + " = 2001", "x^100 = x^100", "x^2 - 1 = (x - 1)*(x + 1)"]


def test_true_claims_stand(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*TRUE_CLAIMS, "x^100 = x^101", "1" + "+1" * 2000 + " = 2002"])], "i int, c string")
    got = rows.select("i", symbolic.checked_all(F.array("c"), F.lit(""), F.lit(""))[0].alias("t")).orderBy("i").collect()
    assert [(r.t.failed, r.t.counterexample) for r in got[: len(TRUE_CLAIMS)]] == [(None, None)] * len(TRUE_CLAIMS)
    assert all(r.t.failed for r in got[len(TRUE_CLAIMS) :])


PROOFS = "proof_id string, problem string, goal string"
ANSWERS = f"proof_id string, attempt int, steps array<{correction.STEP}>, conclusion string"


def steps(*justifications):
    return [dict(step_id=str(i), statement="the goal holds", justification=j, refs=[]) for i, j in enumerate(justifications)]


def test_correction_rounds(spark):
    good, bad = steps("by a", "by b"), steps("by a", " ")
    answers = {
        "first": [(good, "the goal")], "third": [(bad, "the goal"), (bad, ""), (good, "the goal")], "never": [(bad, "the goal")] * 5, "none": [], "null": [(None, "x")],
        "broken": [(bad, "the goal"), (None, None), (good, "the goal")], "short": [(bad, "the goal")], "empty": [([], "the goal"), (good, "the goal")], "mild": [(steps("clearly"), "other")],
    }
    proofs = spark.createDataFrame([(k, "p", "the goal") for k in answers], PROOFS)
    rows = spark.createDataFrame([(k, i, s, c) for k, a in answers.items() for i, (s, c) in enumerate(a, 1)], ANSWERS)
    asked = []

    def respond(df):
        asked.append(sorted((r.proof_id, r.attempt, [e.check for e in r.errors or []]) for r in df.collect()))
        return correction.recorded(rows)(df)

    got = {r.proof_id: (r.accepted, r.attempts, sorted({e.check for e in r.errors}), r.conclusion) for r in correction.corrected(proofs, respond).collect()}
    assert got == {
        "first": (True, 1, [], "the goal"), "third": (True, 3, [], "the goal"), "never": (False, 3, ["empty_justification"], "the goal"), "none": (False, 0, ["generate_failed"], None), "null": (False, 0, ["generate_failed"], None),
        "broken": (False, 1, ["correct_failed", "empty_justification"], "the goal"), "short": (False, 1, ["correct_failed", "empty_justification"], "the goal"), "empty": (True, 2, [], "the goal"), "mild": (True, 1, ["one_step", "overlap", "vague"], "other"),
    }
    assert [[k for k, *_ in a] for a in asked] == [sorted(answers), ["broken", "empty", "never", "short", "third"], ["never", "third"]]
    assert ("third", 3, ["empty_justification", "no_conclusion"]) in [(k, n, sorted(e)) for k, n, e in asked[2]]
    assert correction.corrected(proofs.limit(0), respond).count() == 0


def test_contained(spark, monkeypatch):
    monkeypatch.setattr(context, "CUT", 50)
    r = random.Random(9)
    make = lambda n: "".join(r.choice("ab ") for _ in range(n))
    texts = [(i, make(r.randrange(0, 200))) for i in range(60)] + [(None, "ab" * 20), (3, "é中ab" * 9), (61, None), (61, "")]
    parts = [(i, make(r.randrange(0, 20))) for i in range(80)] + [(100 + i, t[i : i + 5 * i]) for i, (_, t) in enumerate(texts[:30])] + [(200, None), (201, ""), (None, "ab"), (202, "é中ab" * 8), (202, "zzz")]
    got = context.contained(spark.createDataFrame(texts, "text_id int, text string").repartition(3), spark.createDataFrame(parts, "part_id int, part string"))
    want = {(t, p) for t, text in texts for p, part in parts if text and part and part in text}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert context.contained(got.selectExpr("text_id", "'x' as text").limit(0), spark.createDataFrame(parts, "part_id int, part string")).count() == 0
    assert context.contained(got.selectExpr("text_id", "'x' as text"), spark.createDataFrame([], "part_id int, part string")).count() == 0
