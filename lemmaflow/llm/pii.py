"""Personal data replaced by surrogates.

Entities are found by patterns (and checks such as Luhn's), and each gets a surrogate that a secret key and
the entity alone decide: the same entity has the same surrogate in every document (coreference), of the same
type, script, length and format; names get names of the same gender. A collision check over all distinct
entities keeps two entities from sharing a surrogate and a surrogate from being an entity of the corpus: the
losers move to their next candidate until none collides. A format that has no free value left (single initials,
dense networks) is left after LONGER candidates: later ones are longer, and addresses leave their private network.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, rows, staged, table

#: For tests and trial runs; a run whose surrogates must not be recomputed by others sets its own (KEY_CONF).
KEY, KEY_CONF = b"lemmaflow surrogate key", "spark.lemmaflow.pii.key"
#: Entities off their first candidate that are held in every task at most; with more, they are joined.
HELD = 100_000
#: Candidates of an entity's own length; each one after them is a character longer than the one before.
LONGER = 30

# Patterns by type, in the order in which they claim text.
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|api[_-]?key|password)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-]{16,})",
    "email": r"(?<![\w.+-])[_.+-]*+(?P<email>[^\W_][\w.+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})",
    "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "ip": r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))",
    "phone": r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d))",
    "ssn": r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    "card": r"(?P<card>(?<![\d.-])\d{4}(?:[ -]?\d{4}){3}(?![\d-]|\.\d)|(?<![\d.-])\d{13,19}(?![\d-]|\.\d))",
    "name": r"(?P<title>\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Madame|Monsieur|Señor|Señora|Sra|Sr|Dr|Prof)\b\.?\s+)(?P<name>[^\W\d_]+(?:[ -][^\W\d_]+)?)",
}
# Titles by gender (the others are for men, or for both), and given names by gender.
FEMALE_TITLES = {"mrs", "ms", "miss", "frau", "mme", "madame", "señora", "sra"}
OPEN_TITLES = {"dr", "prof"}
GIVEN = {
    "f": "Ada Alma Anna Clara Edith Elena Emma Eva Flora Greta Helen Ida Irene Jane Julia Laura Lena Lucia Marta Mary Nina Nora Olga Paula Rosa Ruth Sara Sofia Vera Wanda".split(),
    "m": "Adam Albert Anton Bruno Carl David Emil Eric Felix Frank Georg Henry Hugo Ivan Jacob Jan John Karl Leo Louis Mark Martin Max Oscar Otto Paul Peter Simon Tom Victor".split(),
}
# Alphabets that a letter is replaced within.
ALPHABETS = [(r, s) for s in ("abcdefghijklmnopqrstuvwxyz", "àâçéèêëîïôùûáíóúñäöü", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω") for r in (set(s),)]

SEARCH = re.compile("|".join(PATTERNS.values())).search
DIGIT = re.compile(r"\d").search
TITLES = ("Mr", "Ms", "Miss", "Herr", "Frau", "Mme", "Madame", "Monsieur", "Señor", "Sra", "Sr", "Dr", "Prof")


def hint(text: str) -> bool:
    """Cheap signs that a text may hold an entity at all; no text that has one is left out."""
    return "@" in text or "=" in text or ":" in text or DIGIT(text) is not None or any(t in text for t in TITLES)


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity) in the order of the text; names of two words have their gender in the type.

    A name begins with a capital in scripts that have them, and so does its second word. A name that stands again
    in the same text without a title is found there too.
    """
    out, names, at = [], {}, 0
    if not text or not hint(text):
        return out
    while m := SEARCH(text, at):
        kind = next(k for k in PATTERNS if m.group(k) is not None)
        start, end = m.span(kind)
        at = max(m.end(), at + 1)
        value = m.group(kind)
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        if kind == "name":
            title = m.group("title").strip(" .\n\t").lower()
            first, cut, last = re.match(r"([^ -]+)([ -]?)(.*)", value, re.S).groups()
            if first[0].islower():
                at = start  # the title belongs to no name; another may follow
                continue
            if cut and last[0].islower():
                value, cut = first, ""
                at = end = start + len(first)
            kind = "name_s" if not cut else "name_f" if title in FEMALE_TITLES else "name_u" if title in OPEN_TITLES else "name_m"
            names[value] = kind
        out.append((start, end, kind, value))
    if names:
        again = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b")
        taken, free = sorted(out), []
        for m in again.finditer(text):
            k = bisect.bisect(taken, (m.end(),)) - 1  # the last entity that starts before its end
            if k < 0 or taken[k][1] <= m.start():
                free.append((*m.span(), names[m[0]], m[0]))
        out = sorted(out + free)
    return out


def canonical(kind: str, value: str) -> str:
    """One form of an entity that is written in several: cards and IBANs without gaps, addresses in lower case."""
    if kind == "card":
        return "".join(c for c in value if c.isdecimal())
    return value.replace(" ", "") if kind == "iban" else value.lower() if kind == "email" else value


class Draw:
    """Numbers that a key, a type, an entity and the number of the candidate decide."""

    def __init__(self, key: bytes, *parts):
        self.seed, self.block, self.pool = hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64]).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


@lru_cache(1)
def letters_by_script() -> dict[tuple[str, str], list[str]]:
    """Letters in code point order by the first word of their name (the script) and their category."""
    out = {}
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            out.setdefault((unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c)), []).append(c)
    return out


@lru_cache(100_000)
def alike(c: str) -> list[str]:
    """Letters of c's script and category: those of its part of the code table, a wider one while under ten are there."""
    same = letters_by_script()[unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c)]
    for part in (7, 9, 11):
        near = [x for x in same if ord(x) >> part == ord(c) >> part]
        if len(near) >= 10:
            return near
    return same


def digit_like(c: str, digit: str) -> str:
    """The digit in the block of c, a decimal digit of any script."""
    return digit if c.isascii() else chr(ord(c) - unicodedata.decimal(c) + int(digit))


def longer(kind: str, value: str, attempt: int) -> str:
    """value with as many characters more as attempt is past the candidates of its own length."""
    more = max(0, attempt - LONGER + 1)
    if not more or kind == "ip":
        return value
    local, at, domain = value.rpartition("@") if kind == "email" else (value, "", "")
    letter = next((c.lower() for c in reversed(local) if c.isalpha() and len(c.lower()) == 1 and len(alike(c.lower())) > 1), "a")
    digit = next((c for c in reversed(local) if c.isdecimal()), "0")
    return local + (letter if kind == "email" or kind.startswith("name_") else digit) * more + at + domain


def shaped(value: str, draw: Draw, first_digit: bool = False) -> str:
    """Each letter becomes one of its script and case, each digit a digit; the rest stays."""
    out = []
    for c in value:
        if c.isdecimal():
            out.append(digit_like(c, str(draw.below(9) + 1) if first_digit else str(draw.below(10))))
            first_digit = False
        elif c.isalpha():
            low = c.lower()
            letters = next((s for r, s in ALPHABETS if low in r), None)
            if letters is None:
                near = None if "一" <= c <= "鿿" else alike(c)
                out.append(chr(0x4E00 + draw.below(5000)) if near is None else near[draw.below(len(near))])
            else:
                new = letters[draw.below(len(letters))]
                out.append(new.upper() if c != low else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Candidate number attempt for an entity. A domain has one surrogate for all its addresses, a surname one for all
    its bearers, with and without a given name."""
    draw, entity, value = Draw(key, kind, canonical(kind, value), attempt), value, longer(kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return f"{shaped(local, draw)}@{shaped(host, Draw(key, 'domain', domain.lower(), attempt))}{dot}{top}"
    if kind == "ip":
        octets = ["".join(str(unicodedata.decimal(c)) for c in x) for x in value.split(".")]
        plain = ".".join(octets)
        private = next((p for p in ("10.", "192.168.", "172.16.", "127.") if plain.startswith(p)), "")
        if attempt >= LONGER:  # the network may be full: the large private one, then any
            private = "10." if private and attempt < LONGER + 5 else ""
        kept = private.rstrip(".").split(".") if private else [str(draw.below(222) + 1)]
        new = ".".join(kept + [str(draw.below(254) + 1) for _ in octets[len(kept) :]])
        return "".join(digit_like(value[0], c) if c != "." else c for c in new)
    if kind == "card":
        digits, checked = ("".join(str(unicodedata.decimal(c)) for c in x if c.isdecimal()) for x in (value, entity))
        new = digits[0] + "".join(str(draw.below(10)) for _ in digits[1:-1])
        last = [d for d in "0123456789" if luhn(new + d) == luhn(checked)]
        new = iter(new + last[draw.below(len(last))])
        return "".join(digit_like(c, next(new)) if c.isdecimal() else c for c in value)
    if kind == "phone":
        country, rest = re.match(r"(\+\d{1,3}(?=[ .(-]))?(.*)", value, re.S).groups()
        return (country or "") + shaped(rest, draw, True)
    if kind == "iban":
        return value[:2] + shaped(value[2:], draw)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
        letters = "0123456789ABCDEF" if entity.upper() == entity else "0123456789abcdef"
        return "".join(letters[draw.below(16)] for _ in value)
    if kind.startswith("name_"):
        first, cut, last = re.match(r"([^ -]+)([ -]?)(.*)", value, re.S).groups()
        surname = lambda x: shaped(x, Draw(key, "surname", x, attempt))
        if not cut:
            return surname(first)
        names = GIVEN[kind[-1]] if kind[-1] in GIVEN else GIVEN["f"] + GIVEN["m"]
        return (names[draw.below(len(names))] if first.isascii() else shaped(first, draw)) + cut + surname(last)
    return shaped(value, draw, kind == "ssn")


def moved(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, attempt of the entities of docs whose first candidate is taken; nearly none.

    Of entities with one candidate, the first by value keeps it; a candidate that is an entity itself goes to
    nobody. Only distinct entities are shuffled.
    """
    schema = "kind string, value string"

    def find(batches):
        seen = set()

        def records():
            for (text,) in rows(batches, "text"):
                for _, _, kind, value in entities(text):
                    value = canonical(kind, value)
                    if (kind, value) not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add((kind, value))
                        yield kind, value

        yield from batched(records(), arrow_schema(schema), 20_000)

    @F.pandas_udf("string")
    def candidate(kind, value, attempt):
        import pandas as pd

        return pd.Series([surrogate(k, v, a, key) for k, v, a in zip(kind, value, attempt)])

    found = staged(docs.select("text").mapInArrow(find, schema).distinct(), "pii-entities")
    known = found.select(F.col("value").alias("new")).distinct().withColumn("real", F.lit(True))
    now = staged(found.withColumn("attempt", F.lit(0)).withColumn("new", candidate("kind", "value", "attempt")), "pii-candidates")
    while True:
        holder = now.groupBy("new").agg(F.min(F.struct("kind", "value")).alias("holder"), F.count("*").alias("n"))
        losers = now.join(holder.join(known, "new", "left").filter("n > 1 or real"), "new").filter(F.col("real").isNotNull() | (F.struct("kind", "value") != F.col("holder")))
        losers = staged(losers.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "pii-losers")
        if losers.isEmpty():
            break
        stay = now.join(losers.select("kind", "value"), ["kind", "value"], "left_anti")
        now = staged(stay.unionByName(losers.withColumn("new", candidate("kind", "value", "attempt"))), "pii-candidates")
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs (doc_id, text) to doc_id, text with surrogates, n_entities, kinds.

    Null text stays null, with no entity; empty and repeated rows stay as rows. An empty table gives an empty
    result. Texts are not shuffled, unless more than HELD entities are off their first candidate.
    """
    spark = docs.sparkSession
    off = staged(moved(docs, key), "pii-moved")
    out = "doc_id long, text string, n_entities int, kinds array<string>"

    def replaced(text, attempt):
        found, parts, at = entities(text), [], 0
        for start, end, kind, value in found:
            parts += [text[at:start], surrogate(kind, value, attempt.get((kind, canonical(kind, value)), 0), key)]
            at = end
        return ("".join(parts) + text[at:] if found else text), len(found), sorted({k for _, _, k, _ in found})

    if off.count() <= HELD:
        held = spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in off.collect()})

        def run(batches):
            yield from batched(((d, *replaced(t, held.value)) for d, t in rows(batches, "doc_id", "text")), arrow_schema(out))

        return docs.select("doc_id", "text").mapInArrow(run, out)

    schema = "row long, kind string, value string"

    def mentions(batches):
        yield from batched(((h, k, v) for h, t in rows(batches, "row", "text") for k, v in {(k, canonical(k, v)) for _, _, k, v in entities(t)}), arrow_schema(schema), 20_000)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    own = keyed.select("row", "text").mapInArrow(mentions, schema).distinct().join(off, ["kind", "value"]).groupBy("row").agg(F.to_json(F.collect_list(F.array("kind", "value", F.col("attempt").cast("string")))).alias("off"))

    def run_joined(batches):
        import json

        yield from batched(((d, *replaced(t, {(k, v): int(a) for k, v, a in json.loads(o or "[]")})) for d, t, o in rows(batches, "doc_id", "text", "off")), arrow_schema(out))

    return keyed.join(own, "row", "left").select("doc_id", "text", "off").mapInArrow(run_joined, out)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, None)
    return pseudonymised(table(spark, sf_dir, "documents"), key.encode() if key else KEY)
