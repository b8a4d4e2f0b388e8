"""Fuzzy line dedup in Spark expressions only.

Lines are normalised (lower case, runs of anything but letters and digits to one space) and exact copies are
grouped by hash. Each line gets a SimHash in blocks: its words are dealt to blocks by hash, and a block's bits
are the majority vote of its VOTERS longest words (ties by hash), which are the rarest as a rule. So a changed
word touches two of the four blocks at most, and by pigeonhole near lines have a block in common: they meet in
the bucket of that block. Lines that meet and have an edit similarity of at least SIMILAR are linked; of every
connected group, the first occurrence (by doc_id, then line number) stays.

In a bucket, each line is first paired with a few of the bucket's lines (pivots), in rounds, so that groups form.
Then lines are only compared across groups: pairs within a group that is known already are not. All lines of a bucket whose
lengths allow the similarity meet, however many it holds, and are told apart within the join: by bitmaps of their words, then by
the words, then by the edit distance. So no pair is stored or shuffled that is not a link, and a pair is compared in one of its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, shuffles_removed, staged, table
from .graph import components

#: Words that a line has at least to be deduplicated; edit similarity at least.
MIN_WORDS, SIMILAR = 4, 0.9
#: Words of a line from which on a block needs two words, and three, to be used.
NEED = {2: 8, 3: 12}
#: Words of a block that vote on its bits: with three, the vote on all bits is one expression.
VOTERS = 3
#: Pivots of a bucket in each round; lines of a bucket, about, that one of its parts joins with the others, over four.
PIVOTS, CROWDED = (1, 6), 64
#: Parts of a bucket at most, so that a line's copies stay a few however many lines a bucket holds.
PARTS = 8
#: Longs of the bitmap of a line's words.
BITS = 4
#: Characters from which on lines are compared word by word, each word being one character of CODES.
LONG, CODES = 2000, 20_000
#: Share of distinct words that near lines have in common at least: with fewer, they hardly ever share a block.
COMMON = 0.5
#: SQL for the distinct words of a text, as hashes.
WORDS = "array_distinct(transform(split({0}, ' '), w -> xxhash64(w)))"
#: Slots of the bitmap that picks the lines whose text is needed: 64 * this many, the same for every input.
BITMAP_WORDS = 1 << 17
#: Runs of anything but letters and digits, single blanks between words left out, as they would be replaced by
#: themselves. ASCII is listed sign by sign: such a class is the fastest test, and decides for most characters.
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
SEPARATORS = rf"[^{PLAIN} ](?<![\p{{L}}\p{{N}}])[^a-z0-9\p{{L}}\p{{N}}]*| (?=[^{PLAIN}])[^a-z0-9\p{{L}}\p{{N}}]+"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, norm, key of every line that has MIN_WORDS words or more."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # As a generator's output, norm is computed once: else the filter below is pushed through the projection, with
    # norm written out in it for each use.
    norm = F.trim(F.regexp_replace(F.lower("line"), SEPARATORS, " "))
    d = d.select("doc_id", "text_hash", "pos", F.explode(F.array(norm)).alias("norm"))
    d = d.filter(F.octet_length(F.substring_index("norm", " ", MIN_WORDS - 1)) < F.octet_length("norm"))
    return d.withColumn("key", F.xxhash64("norm"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, key, size, blocks of lines: the bits of each usable block, told apart by place.

    hs holds a long for each word: two bits of its hash (its block), then its length, longest first, then more bits of
    the hash. Sorted, with a mark before each block, so that a block's voters are the values behind its mark.
    """
    own = ["doc_id", "text_hash", "pos", "key", "size"]
    d = lines.select("doc_id", "text_hash", "pos", "key", F.length("norm").alias("size"), F.split("norm", " ").alias("words"))
    marks = [f"shiftleft({k}L, 62)" for k in (-2, -1, 0, 1)]
    d = once(d, ("hs", f"sort_array(concat(array({', '.join(marks)}), transform(words, w -> (xxhash64(w) | {63 << 56}L) - shiftleft(cast(length(w) as bigint), 56))))"))
    d = once(d.withColumn("n", F.size("words")).drop("words"), ("at", "array(" + ", ".join(f"cast(array_position(hs, {m}) as int)" for m in marks) + ")"))
    v, held = [f"get(hs, p + {i})" for i in range(VOTERS)], [f"shiftright(get(hs, p + {i}), 62) = k - 2" for i in range(VOTERS)]
    fewer = f"when n >= {NEED[3]} then null when {held[1]} then {v[0]} ^ {v[1]} when n >= {NEED[2]} then null when {held[0]} then {v[0]}"
    vote = f"case when {held[2]} then {v[0]} & {v[1]} | {v[1]} & {v[2]} | {v[0]} & {v[2]} {fewer} end"
    return d.select(*own, F.expr(f"transform(filter(transform(at, (p, k) -> struct(k, {vote} as b)), x -> x.b is not null), x -> xxhash64(x.k, x.b))").alias("blocks"))


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, drop: numbers of the lines that are not the first of their group. What is staged on the way is removed."""
    with shuffles_removed(docs.sparkSession):
        return found_drops(docs)


def found_drops(docs: DataFrame) -> DataFrame:
    thin = staged(blocks_of(lines_of(docs)), "line-occurrences")
    comps = groups(docs, thin)

    at = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_hash", "pos")
    keys = thin.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    again = staged(keys.join(comps.withColumnRenamed("node", "key"), "key", "left").filter("n > 1 or root is not null").select("key", "first", F.coalesce("root", "key").alias("root")), "line-again")
    released(comps)
    keepers = again.groupBy("root").agg(F.min("first").alias("keeper"))
    keepers = again.join(keepers, "root").select("key", "keeper")
    repeats = thin.select("key", "doc_id", "text_hash", "pos").join(keepers, "key").filter(~at.eqNullSafe(F.col("keeper")))
    gone = staged(repeats.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop")), "line-drops")
    released(thin, again)
    return gone


def groups(docs: DataFrame, thin: DataFrame) -> DataFrame:
    """node, root: the lines (by key) that near lines connect; thin: a result of blocks_of(), the same lines as docs'."""
    bands = thin.select("key", "size", F.explode("blocks").alias("v"))
    # Counted where they are made first, so a block that a third of all lines hold costs a row per task.
    counted = bands.groupBy("v").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    counted = staged(counted, "line-buckets")
    met = staged(marked(bands, counted, "v", "v").join(counted.select("v"), "v").distinct(), "line-met")
    released(counted)
    wanted = staged(met.select("key").distinct(), "line-wanted")
    texts = staged(texts_of(docs, wanted).withColumn("words", F.expr(WORDS.format("norm"))), "line-texts")

    released(wanted)
    member, roots, old = met.withColumn("root", F.col("key")), None, [met]
    for number in range(len(PIVOTS) + 1):
        if number < len(PIVOTS):
            pairs = staged(pivoted(member, number).distinct(), "line-pairs")
            links, old = similar(pairs, texts), [*old, pairs]
        else:
            mixed = member.join(member.groupBy("v").agg(F.count("*").alias("n")), "v")
            # Lines that meet one over LONG are not much shorter.
            links = crossed(mixed, texts.withColumn("code", F.expr(f"if(length(norm) >= {SIMILAR * LONG:.0f}, {code('norm')}, null)")), NEAR)
            old.append(links)
        links = links.select(F.col("root1").alias("a"), F.col("root2").alias("b")).distinct()
        # Only the groups that the new links join are looked at again.
        links = staged(links, "line-links")
        comps = components(links, "line-groups")
        new, old = comps.select(F.col("node").alias("root"), F.col("root").alias("to")), [*old, links, comps]
        if roots is None:
            roots = staged(new.select(F.col("root").alias("node"), F.col("to").alias("root")), "line-roots")
        else:
            late = new.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
            old.append(roots)
            roots = staged(roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(late), "line-roots")
        if number < len(PIVOTS):
            member = member.join(new, "root", "left").select("v", "key", "size", F.coalesce("to", "root").alias("root"))
            still = member.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("v")
            member = staged(member.join(still, "v"), "line-member")
        released(*old)
        old = [member] if number < len(PIVOTS) else []
    released(texts)
    return roots


def pivoted(member: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b, root1, root2) of each bucket's lines with its pivots of that round, of other groups."""
    picks = [[F.min_by(c, F.xxhash64("key", F.lit(10 * number + j))).alias(f"{c}{j}") for c in ("key", "size", "root")] for j in range(PIVOTS[number])]
    pivots = member.groupBy("v").agg(*[c for pick in picks for c in pick])
    pivots = pivots.select("v", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{c}{j}").alias(c) for c in ("key", "size", "root")]) for j in range(PIVOTS[number])]))).alias("p"))
    pairs = member.join(pivots, "v").filter(f"root <> p.root and least(size, p.size) >= {SIMILAR} * greatest(size, p.size)")
    swap = F.col("key") > F.col("p.key")
    return pairs.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b"), F.when(swap, F.col("p.root")).otherwise(F.col("root")).alias("root1"), F.when(swap, F.col("root")).otherwise(F.col("p.root")).alias("root2"))


def crossed(mixed: DataFrame, texts: DataFrame, near: str = "true") -> DataFrame:
    """Pairs (a, b, root1, root2) of lines of one bucket (v, of n lines) and different groups whose lengths allow the similarity and
    whose words (of texts) may have COMMON in common by their bitmaps; each pair once. near: a condition more (SQL, on columns of
    texts, left ones with a 1 behind, right ones with a 2), tested within the join.

    A bucket of over 4 * CROWDED lines is dealt to parts, PARTS at most: each line is in one of them on the left and in all on the right,
    and there lines meet by bands of lengths, those of the bands beside too: lengths that allow the similarity are never further apart.
    Hashes of words, which hardly compress, are made where the lines were dealt to if texts have norm. The result reads a staged table, to be released().
    """
    n = f"least(n div {4 * CROWDED}, {PARTS - 1})"
    bits = ", ".join(f"aggregate(words, 0L, (s, w) -> if(pmod(w, {BITS}) = {i}, s | shiftleft(1L, cast(shiftright(w, 8) & 63 as int)), s))" for i in range(BITS))
    own = once(mixed.groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("vs")).join(texts, "key"), ("bits", f"array({bits})"))
    own = own.drop("words") if "norm" in texts.columns else own
    lines = staged(mixed.join(own, "key"), "line-mixed")
    band, most = f"cast(floor(ln(greatest(size, 1)) / {-1.001 * math.log(SIMILAR):.9f}) as int)", 4 * CROWDED
    at = {"left": (f"if(n > {most}, transform(array(-1, 0, 1), i -> {band} + i), array(0))", f"array(cast(pmod(xxhash64(key), 1 + {n}) as int))"), "right": (f"array(if(n > {most}, {band}, 0))", f"sequence(0, cast({n} as int))")}
    sides = []
    for k, (bands, parts) in enumerate(at.values(), 1):
        spots = F.inline(F.expr(f"flatten(transform({bands}, g -> transform({parts}, p -> struct(g as band, p as part))))"))
        side = lines.select("v", *[F.col(c).alias(f"{c}{k}") for c in lines.columns if c not in ("v", "n")], spots)
        sides.append(once(side.repartition("v", "band", "part"), (f"words{k}", WORDS.format(f"norm{k}") if "norm" in texts.columns else f"words{k}")))
    lacks = " + ".join(f"bit_count(bits{{0}}[{i}] & ~bits{{1}}[{i}])" for i in range(BITS))
    # A bit that one bitmap lacks is a word that its line lacks: lines with COMMON in common lack no more than so many.
    common = f"ceil({COMMON} * greatest(size(words1), size(words2)))"
    alike = " and ".join(f"{lacks.format(i, 3 - i)} <= size(words{i}) - {common}" for i in (1, 2))
    first = "array_intersect(vs1, vs2)[0] = v"
    apart = f"key1 < key2 and root1 <> root2 and least(size1, size2) >= {SIMILAR} * greatest(size1, size2)"
    left, right = sides
    met = left.join(right.withColumnsRenamed({"v": "v2", "band": "band2", "part": "part2"}), F.expr(f"v = v2 and band = band2 and part = part2 and if({apart}, if({alike}, if({first}, {near}, false), false), false)"))
    out = met.select(F.col("key1").alias("a"), F.col("key2").alias("b"), "root1", "root2")
    out.staged_path = lines.staged_path
    return out


def marked(rows: DataFrame, some: DataFrame, column: str, by: str) -> DataFrame:
    """The rows whose column may be a value in some (column by, a long): all of those and few others.

    A bitmap of fixed size, broadcast as a table of at most BITMAP_WORDS longs, drops rows where they are read.
    """
    slots = 64 * BITMAP_WORDS
    bitmap = some.select(F.pmod(F.col(by), F.lit(slots)).alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))
    slot = f"pmod({column}, {slots}L)"
    return rows.withColumn("_word", F.expr(f"{slot} div 64")).join(F.broadcast(bitmap), "_word").filter(f"shiftrightunsigned(_bits, cast({slot} % 64 as int)) & 1L = 1L").drop("_word", "_bits")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, norm of the lines in keys (key)."""
    lines = marked(lines_of(docs.select("doc_id", "text")), keys, "key", "key").select("key", "norm")
    return lines.join(keys.hint("shuffle_hash"), "key", "left_semi").groupBy("key").agg(F.first("norm").alias("norm"))


def code(text: str) -> str:
    """SQL for the words of a text as a character each."""
    return f"decode(unhex(array_join(transform(split({text}, ' '), w -> hex(19968 + pmod(xxhash64(w), {CODES}))), '')), 'UTF-16BE')"


def edits_allow(a: str, b: str) -> str:
    return f"levenshtein({a}, {b}, cast(floor({1 - SIMILAR:.6f} * greatest(length({a}), length({b})) + 1e-6) as int)) >= 0"


#: SQL for what similar() asks of two lines, on columns norm, words, code (null unless a text is over LONG) with a 1 and a 2 behind.
NEAR = f"""if(size(array_intersect(words1, words2)) >= {COMMON} * greatest(size(words1), size(words2)),
    if(greatest(length(norm1), length(norm2)) > {LONG}, {edits_allow("code1", "code2")}, {edits_allow("norm1", "norm2")}), false)"""


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of line keys whose texts have the edit similarity: edits of single characters, of at most
    1 - SIMILAR of the longer text's length, between texts that have COMMON of their words in common. If that is over LONG, both are compared word by word in the same way
    (words of one code, one in CODES, count as equal).
    """
    one, two = (texts.select(*[F.col(c).alias(f"{c}{k}") for c in ("key", "norm", "words")]) for k in (1, 2))
    both = pairs.join(one.withColumnRenamed("key1", "a"), "a").join(two.withColumnRenamed("key2", "b"), "b")
    long = f"greatest(length(norm1), length(norm2)) > {LONG}"
    both = once(both, *[(f"code{k}", f"if({long}, {code(f'norm{k}')}, null)") for k in (1, 2)])
    return both.filter(NEAR).select(*pairs.columns)


def once(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """df with columns (name, SQL) that pass through a generator, so each is computed once, however often it is used below.

    They are made in a projection before it: in a generator, higher-order functions would have all of it interpreted.
    """
    names = {name for name, _ in columns}
    made = df.select(*[c for c in df.columns if c not in names], *[F.expr(sql).alias(f"_{name}") for name, sql in columns])
    one = F.inline(F.array(F.struct(*[F.col(f"_{name}").alias(name) for name, _ in columns])))
    return made.select(*[c for c in df.columns if c not in names], one)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns as they are but text without the lines that repeat an earlier one of their group, and
    n_lines, n_dropped (which replace columns of these names).

    Earlier means smaller doc_id (null last), then line number. Lines under MIN_WORDS words (empty ones too)
    always stay. Null text stays null, with 0 lines. Rows equal in doc_id and text are one document: each
    keeps the same lines. An empty table gives an empty result.
    """
    d = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_h"))
    gone = drops(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "drop")
    d = d.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    kept = F.expr("case when drop is null then text else array_join(filter(split(text, '\\n'), (l, i) -> not array_contains(drop, i)), '\\n') end")
    d = d.withColumns({"_kept": kept, "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), "n_dropped": F.coalesce(F.size("drop"), F.lit(0))})
    d = d.withColumns({"n_lines": F.greatest("n_lines", F.lit(0)), "n_dropped": F.greatest("n_dropped", F.lit(0))})
    return d.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
