"""JSON Schema checks of artifacts: a schema tree is compiled to one expression over the artifact's VARIANT.

A text is parsed once, and one pass gives all of its violations as an array, in the order in which a validator that follows
the schema's keywords meets them. Keywords: type, required, properties, items, enum (the others say nothing wrong). Types are
those of JSON Schema: a whole number is an integer however it is written, a boolean is no number.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step of a path is an object's key (s) or an array's place (i).
STEP = "struct<i:int,s:string>"
VIOLATION = f"struct<path:array<{STEP}>,keyword:string,name:string,message:string>"

# The artifacts' schemas.
STRINGS = {"type": "array", "items": {"type": "string"}}
TEXT, LIST, OBJECT = {"type": "string"}, {"type": "array"}, {"type": "object"}
STATUS = ["planned", "proven", "verified", "failed", "patched"]
PROBLEM = {
    "type": "object",
    "required": ["problem_id", "raw_problem", "goal"],
    "properties": {"problem_id": TEXT, "raw_problem": TEXT, "goal": {"type": "object", "required": ["text", "symbolic"], "properties": {"text": TEXT, "symbolic": TEXT}}, "assumptions": LIST, "variables": LIST, "domain": OBJECT, "technical_terms": STRINGS, "hidden_conditions": LIST},
}
OBLIGATION = {"type": "object", "required": ["id", "description", "status"], "properties": {"id": TEXT, "description": TEXT, "status": {"type": "string", "enum": ["pending", "pass", "fail"]}}}
CONTRACT = {
    "type": "object",
    "required": ["goal", "obligations", "allowed_references"],
    "properties": {"goal": OBJECT, "assumptions": LIST, "allowed_references": STRINGS, "allowed_theorems": STRINGS, "forbidden_moves": STRINGS, "obligations": {"type": "array", "items": OBLIGATION}, "acceptance_rubric": STRINGS},
}
NODE = {
    "type": "object",
    "required": ["id", "node_type", "claim", "status"],
    "properties": {"id": TEXT, "node_type": TEXT, "claim": TEXT, "claim_formal": TEXT, "proof_flow": STRINGS, "proof_body": OBJECT, "planned_rule_refs": STRINGS, "covers_obligations": STRINGS, "errors": LIST, "status": {"type": "string", "enum": [*STATUS, "source"]}},
}
INFERENCE = {
    "type": "object",
    "required": ["id", "premise_nodes", "conclusion_node", "rule_refs", "side_condition_nodes", "relation", "status"],
    "properties": {"id": TEXT, "premise_nodes": STRINGS, "conclusion_node": TEXT, "rule_refs": STRINGS, "side_condition_nodes": STRINGS, "instantiation": OBJECT, "relation": TEXT, "status": {"type": "string", "enum": STATUS}, "verifier_notes": LIST},
}
GRAPH = {
    "type": "object",
    "required": ["proof_id", "nodes", "inferences"],
    "properties": {"proof_id": TEXT, "based_on_graph_id": TEXT, "current_graph_version": {"type": "integer"}, "goal_node_id": TEXT, "nodes": {"type": "array", "items": NODE}, "inferences": {"type": "array", "items": INFERENCE}, "errors": LIST, "obligation_status": LIST, "graph_patches": LIST},
}


def text(s: str) -> str:
    """SQL of a string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(var: str, value: str, body: str) -> str:
    """SQL of body, in which var stands for value, computed once."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def kind_of(v: str) -> str:
    """SQL of the JSON type of VARIANT v; 'integer' for numbers without a fraction."""
    t = f"schema_of_variant({v})"
    whole = f"coalesce(try_variant_get({v}, '$', 'double') = floor(try_variant_get({v}, '$', 'double')), false)"
    return bind("t", t, f"case when startswith(t, 'OBJECT') then 'object' when startswith(t, 'ARRAY') then 'array' when t = 'STRING' then 'string' when t = 'BOOLEAN' then 'boolean' when t = 'VOID' then 'null' when {whole} then 'integer' else 'number' end")


def shown(v: str) -> str:
    """SQL of a value as messages show it: strings in single quotes, true, false and null as Python's, lists and objects as JSON."""
    return f"case schema_of_variant({v}) when 'STRING' then concat('\\'', try_variant_get({v}, '$', 'string'), '\\'') when 'BOOLEAN' then if(try_variant_get({v}, '$', 'boolean'), 'True', 'False') when 'VOID' then 'None' else to_json({v}) end"


def compiled(schema: dict, value: str) -> str:
    """SQL of array<VIOLATION> for a VARIANT expression that is not null."""
    number = count()

    def violation(path: str, keyword: str, name: str, message: str) -> str:
        return f"named_struct('path', {path}, 'keyword', '{keyword}', 'name', {name}, 'message', {message})"

    def tree(s: dict, v: str, path: str) -> str:
        """SQL for the subtree s at variable v, whose path is an expression."""
        n = next(number)
        k, parts = f"k{n}", []
        for keyword, rule in s.items():
            if keyword == "type":
                fits = f"{k} in ('number', 'integer')" if rule == "number" else f"{k} = '{rule}'"
                parts.append(f"if({fits}, {NONE}, array({violation(path, 'type', 'cast(null as string)', f'concat({shown(v)}, {text(f" is not of type {rule!r}")})')}))")
            elif keyword == "required":
                absent = "filter(array(" + ", ".join(f"if(try_variant_get({v}, {text('$.' + r)}, 'variant') is null, {text(r)}, null)" for r in rule) + "), r -> r is not null)"
                parts.append(f"if({k} = 'object', transform({absent}, r -> {violation(path, 'required', 'r', 'concat(' + text(chr(39)) + ', r, ' + text(chr(39) + ' is a required property') + ')')}), {NONE})")
            elif keyword == "enum":
                listed = "(" + ", ".join(map(text, rule)) + ")"
                parts.append(f"if({k} = 'string' and try_variant_get({v}, '$', 'string') in {listed}, {NONE}, array({violation(path, 'enum', 'cast(null as string)', f'concat({shown(v)}, {text(f" is not one of {rule!r}")})')}))")
            elif keyword == "properties":
                for name, sub in rule.items():
                    c = f"v{n}_{next(number)}"
                    inner = tree(sub, c, f"array_append({path}, named_struct('i', 0, 's', {text(name)}))")
                    parts.append(bind(c, f"if({k} = 'object', try_variant_get({v}, {text('$.' + name)}, 'variant'), null)", f"if({c} is null, {NONE}, {inner})"))
            elif keyword == "items":
                c = f"v{n}_{next(number)}"
                inner = tree(rule, c, f"array_append({path}, named_struct('i', i{n}, 's', ''))")
                parts.append(f"if({k} = 'array', flatten(transform(try_variant_get({v}, '$', 'array<variant>'), ({c}, i{n}) -> {inner})), {NONE})")
        body = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else NONE
        return bind(k, kind_of(v), body)

    return bind("root", value, tree(schema, "root", f"cast(array() as array<{STEP}>)"))


NONE = f"cast(array() as array<{VIOLATION}>)"


def checked(df: DataFrame, column: str, schema: dict, out: str = "violations") -> DataFrame:
    """df with out: array<VIOLATION> of the JSON text in column, in the order of the schema's keywords.

    A text that is no JSON, or null, has one violation of keyword json. Text is parsed once: the parsed value passes through
    a generator.
    """
    d = df.select("*", F.explode(F.array(F.try_parse_json(column))).alias("_artifact"))
    odd = f"array(named_struct('path', cast(array() as array<{STEP}>), 'keyword', 'json', 'name', cast(null as string), 'message', 'no JSON'))"
    return d.withColumn(out, F.expr(f"cast(if(_artifact is null, {odd}, {compiled(schema, '_artifact')}) as array<{VIOLATION}>)")).drop("_artifact")


def joined_path(path: str, by: str) -> str:
    """SQL of a path as text, <root> if it is empty."""
    return f"coalesce(nullif(array_join(transform({path}, s -> if(s.s = '', cast(s.i as string), s.s)), {text(by)}), ''), '<root>')"


def by_path(violations: str) -> Column:
    """The violations sorted by path, of one path in the order found."""
    keyed = f"sort_array(transform({violations}, (e, n) -> struct(e.path as path, n as n, e as e)))"
    return F.expr(f"transform({keyed}, x -> x.e)")


def messages(violations: str, first: int | None = None) -> Column:
    """'path: message' of each violation (of the first ones), a path's steps joined with a single quote."""
    some = f"slice({violations}, 1, {first})" if first else violations
    return F.expr(f"transform({some}, e -> concat({joined_path('e.path', chr(39))}, ': ', e.message))")


def first_messages(name: str, violations: str) -> Column:
    """What stops a stage: the first five messages in one text; null if there is none."""
    return F.when(F.expr(f"size({violations}) > 0"), F.concat(F.lit(f"{name} schema errors: "), F.array_join(messages(violations, 5), "; ")))


def violations(artifacts: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """key, path, problem (required, type, enum, or json for text that is no JSON object), a row for each violation. A
    missing property's path ends with its name; the path of the whole is ''."""
    d = checked(artifacts.select(key, column), column, schema).select(key, F.explode("violations").alias("e"))
    path = F.expr("array_join(concat(transform(e.path, s -> if(s.s = '', cast(s.i as string), s.s)), if(e.name is null, array(), array(e.name))), '.')")
    return d.select(key, path.alias("path"), F.expr("if(e.keyword = 'type' and size(e.path) = 0, 'json', e.keyword)").alias("problem"))

