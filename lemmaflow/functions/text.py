"""Text predicates of the proof checks, as column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vague wording for graph proofs and for flat proofs.
VAGUE_GRAPH = ["obvious", "clearly", "some theorem", "顯然", "容易看出"]
VAGUE_FLAT = ["obvious", "clearly", "some theorem", "it follows trivially", "顯然", "容易看出", "trivially", "trivial"]
# Words of a goal that don't count for its overlap with a conclusion.
STOP_WORDS = ["a", "an", "the", "of", "in", "is", "and", "to", "that", "we", "have", "let", "for", "be", "with"]
# Identifiers that need no declaration.
BUILTINS = [
    "f", "g", "h", "d", "dx", "dy", "dz", "dt", "df", "sin", "cos", "tan", "sec", "csc",
    "cot", "arcsin", "arccos", "arctan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "log", "ln", "sqrt",
    "abs", "Eq", "Ne", "Lt", "Le", "Gt", "Ge", "Derivative", "Integral", "Limit", "Sum", "Product", "Function", "Symbol",
    "Integer", "Float", "Rational", "diff", "integrate", "limit", "simplify", "lim", "sup", "inf", "max", "min", "forall", "exists",
    "true", "false", "implies", "iff",
]
# Full-width punctuation and its ASCII forms.
FULL_WIDTH = {"，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "｛": "{", "｝": "}", "「": '"', "」": '"', "、": ","}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_math(c: Column | str) -> Column:
    """Lower case without spaces and '*', primes and compositions spelt out, only [a-z0-9_=()+/-] kept."""
    x = F.regexp_replace(F.lower(_col(c)), "[ *]", "")
    x = F.regexp_replace(F.regexp_replace(x, "['′]", "prime"), "∘", "o")
    return F.regexp_replace(x, r"[^a-z0-9_=()+/\-]", "")


def symbols(c: Column | str) -> Column:
    """Sorted distinct identifiers (whole runs of letters, digits and _ that are ASCII) that are no builtins."""
    runs = F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    found = F.filter(runs, lambda r: r.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, BUILTINS))))


def ascii_punctuation(c: Column | str) -> Column:
    return F.translate(_col(c), "".join(FULL_WIDTH), "".join(FULL_WIDTH.values()))


def vague_terms(c: Column | str, terms: list[str] = VAGUE_GRAPH) -> Column:
    """The terms that the lower-cased text contains, in the terms' order."""
    low = F.lower(_col(c))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def goal_words(c: Column | str) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+)"), 1))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def goal_overlap(goal: Column | str, conclusion: Column | str) -> Column:
    """Share of the goal's words that occur in the conclusion, inside longer words too; null without words."""
    words, text = goal_words(goal), F.lower(_col(conclusion))
    return F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0))


# Fixed value: what a named theorem looks like.
NAMED_THEOREM = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s+(?:Theorem|Lemma|Corollary|Law))"


def named_theorems(c: Column | str) -> Column:
    """Lower-cased names of two or more capitalised words before Theorem, Lemma, Corollary or Law."""
    found = F.regexp_extract_all(_col(c), F.lit(NAMED_THEOREM), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def clean_for_display(c: Column | str) -> Column:
    """Without control characters and carriage returns; tabs and newlines stay."""
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0b-\x1f\x7f]", "")
