"""Extraction and repair of JSON objects from generated text.

Texts that are JSON already are handled by Spark's own parser; only the rest goes through Python, in Arrow
batches. There one reader with an explicit stack takes a text from a brace on and forgives what generated text
gets wrong, so its time grows with the text's length and its depth has no limit of Python's.
"""

from __future__ import annotations

import ast
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import FULL_WIDTH, ascii_punctuation

CLOSER = {"{": "}", "[": "]"}
#: A string with its escapes, its closing quote if there is one; or one other character.
PIECE = re.compile(r'"(?:[^"\\]|\\.)*"?|\\.|.', re.S)
FENCE = re.compile(r"^```[A-Za-z]*\s*|\s*```$")
BLANKS, WORD, QUOTED_BRACE = re.compile(r"\s*"), re.compile(r"[-+.\w]+"), re.compile(r'"\{\s*(?=[A-Za-z_])')
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


def _loads(text: str):
    try:
        return json.loads(text), True
    except (ValueError, RecursionError):
        return None, False


def balanced(text: str, start: int) -> str | None:
    """The object that starts at a brace, if its braces close."""
    depth = 0
    for m in PIECE.finditer(text, start):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0:
            return text[start : m.end()]
    return None


def without_trailing_commas(text: str) -> str:
    return re.sub(r"(?:,\s*)+(?=[}\]])", "", text)


def spans(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of the objects whose braces close, by start, and the starts of those whose do not: in one scan."""
    first = text.find("{")
    done, open_ = [], []
    for m in PIECE.finditer(text, max(first, 0)):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            done.append((open_.pop(), m.end()))
    return sorted(done), open_


def quoted(text: str, i: int) -> tuple[str, int, bool]:
    """The string that starts behind the quote before i, where it ends, and whether it does. A backslash before no escape
    is dropped; a ')' that no '(' of the string opened ends it."""
    out, depth = [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            return "".join(out), i + 1, True
        if c == ")" and depth == 0:
            return "".join(out), i, True
        if c == "\\" and i + 1 < len(text):
            i += 1
            e = text[i]
            if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", text[i + 1 : i + 5]):
                out.append(chr(int(text[i + 1 : i + 5], 16)))
                i += 4
            else:
                out.append(ESCAPES.get(e, e))
                depth += (e == "(") - (e == ")" and depth > 0)
        else:
            depth += (c == "(") - (c == ")")
            out.append(c)
        i += 1
    return "".join(out), i, False


def literal(word: str):
    """(value, known) of a bare word."""
    if word in LITERALS:
        return LITERALS[word], True
    return _loads(word)


class _Stop(ValueError):
    """The text is no object from that brace on; nor from those braces behind it that were open (starts) when that showed."""

    def __init__(self, stack):
        self.starts = {start for *_, start in stack}


def forgiving(text: str, start: int) -> tuple[dict, int, bool]:
    """The object from a brace on, where it ends, and whether it is closed there; _Stop if it cannot be one.

    ')' closes what is open; closers that match nothing and commas too many go; a key without a value goes; what is
    open at the end is closed there, strings included; Python's literals count as JSON's.
    """
    root: dict = {}
    stack: list[list] = [[root, None, start]]  # container, key that waits for its value, where it began
    expect, i = "key", start + 1

    def put(value):
        box, key, _ = stack[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key] = value
            stack[-1][1] = None

    while True:
        i = BLANKS.match(text, i).end()
        if i >= len(text):
            return root, i, False
        c, box = text[i], stack[-1][0]
        if c in "}])":
            if c != ")" and c != ("]" if isinstance(box, list) else "}"):
                i += 1
                continue
            stack.pop()
            i, expect = i + 1, "next"
            if not stack:
                return root, i, True
        elif c == ",":
            i, expect = i + 1, "value" if isinstance(box, list) else "key"
        elif expect == "key":
            if c != '"':
                raise _Stop(stack)
            key, i, whole = quoted(text, i + 1)
            if not whole:
                return root, i, False
            stack[-1][1], expect = key, "colon"
        elif expect == "colon":
            if c != ":":
                raise _Stop(stack)
            i, expect = i + 1, "value"
        elif expect == "next":
            raise _Stop(stack)
        elif c in "{[":
            new = {} if c == "{" else []
            put(new)
            stack.append([new, None, i])
            i, expect = i + 1, "key" if c == "{" else "value"
        elif m := QUOTED_BRACE.match(text, i):  # the quote of the first key stands before the brace
            new = {}
            put(new)
            brace = i + 1
            key, i, whole = quoted(text, m.end())
            if not whole:
                return root, i, False
            stack.append([new, key, brace])
            expect = "colon"
        elif c == '"':
            value, i, _ = quoted(text, i + 1)
            put(value)
            expect = "next"
        else:
            m = WORD.match(text, i)
            value, known = literal(m[0]) if m else (None, False)
            if not known and not (m and m.end() == len(text)):
                raise _Stop(stack)
            if known:
                put(value)
            i, expect = m.end(), "next"


def found_object(text: str | None):
    """The first object of a text whose braces close, read as it is or forgivingly; else the first that can be read
    with what is open at its end closed. None if there is none."""
    if not isinstance(text, str):
        return None
    text = FENCE.sub("", text.strip()).translate(str.maketrans(FULL_WIDTH))
    closing, open_ = spans(text)
    bad: set[int] = set()
    for start, end in closing:
        if start in bad:
            continue
        value, ok = _loads(text[start:end])
        if ok:
            return value
        try:
            value, at, closed = forgiving(text[start:end], 0)
        except _Stop as e:
            bad |= {start + s for s in e.starts}
            continue
        if closed and at == end - start:
            return value
    for start in sorted({*open_, *(s for s, _ in closing)} - bad):
        if start in bad:
            continue
        try:
            return forgiving(text, start)[0]
        except _Stop as e:
            bad |= e.starts
    return None


def normalized_keys(value):
    """Keys trimmed, in lower case, with '_' for spaces and hyphens, at every depth; NaN and infinities null, as JSON has none."""
    done: list = [value]
    todo = [(done, 0)]
    while todo:
        box, at = todo.pop()
        v = box[at]
        if isinstance(v, dict):
            box[at] = new = {re.sub(r"[ -]", "_", str(k).strip().lower()): x for k, x in v.items()}
            todo += [(new, k) for k in new]
        elif isinstance(v, list):
            box[at] = new = list(v)
            todo += [(new, k) for k in range(len(new))]
        elif isinstance(v, float) and not math.isfinite(v):
            box[at] = None
    return done[0]


def parse(text: str | None):
    """The value in a generated text, with normalised keys; None if nothing can be read."""
    if not isinstance(text, str):
        return None
    found = found_object(text)
    if found is not None:
        return normalized_keys(found)
    for read in (json.loads, ast.literal_eval):
        try:
            return normalized_keys(read(text))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None


def compact(value) -> str | None:
    """Minified JSON; None for what is nested deeper than can be written (about a thousand levels) or is no JSON (bytes, sets).

    Escaped surrogates are joined where they are pairs; lone ones become U+FFFD.
    """
    try:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (RecursionError, TypeError):
        return None
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def extract_flat(text: str | None):
    """The flat-proof reader: whole text, first object, the object with all braces then all brackets closed,
    then the same with LaTeX backslashes doubled."""
    if not text:
        return None
    value, ok = _loads(text.strip())
    if ok:
        return value
    start = text.find("{")
    if start < 0:
        return None
    for t in (text, re.sub(r"\\(?![\"\\/])", r"\\\\", text)):
        body = t[t.find("{") :]
        got = balanced(t, t.find("{")) or body
        fixed = without_trailing_commas(re.sub(r'(["}])\s*\)', r"\1]", body))
        if len(re.findall(r'(?<!\\)"', fixed)) % 2:
            fixed += '"'
        bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", fixed)
        fixed += "}" * max(0, bare.count("{") - bare.count("}")) + "]" * max(0, bare.count("[") - bare.count("]"))
        for candidate in (got, without_trailing_commas(fixed)):
            value, ok = _loads(candidate)
            if ok and isinstance(value, dict):
                return value
    return None


@F.pandas_udf(StringType())
def repaired(texts):
    import pandas as pd

    return pd.Series([None if t is None or (v := parse(t)) is None else compact(v) for t in texts])


def parsed(c: Column | str) -> Column:
    """Compact JSON with normalised keys of any generated text; null if nothing can be read.

    An object that Spark's parser reads and whose keys are normal already does not go to Python.
    """
    x = F.col(c) if isinstance(c, str) else c
    v = native_object(x)
    ready = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & ~x.rlike(r'"[^"]*[^"a-z0-9_.][^"]*"\s*[:：]')
    return F.coalesce(F.when(ready, F.to_json(v)), repaired(F.when(~ready, x)))


def native_object(c: Column | str) -> Column:
    """VARIANT of a text that is JSON once its fence is off and its punctuation is ASCII; else null."""
    x = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.try_parse_json(ascii_punctuation(x))
