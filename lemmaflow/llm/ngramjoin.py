"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct 5-word shingles. Two sets link when their Jaccard
similarity is at least 0.8. With a common order of all tokens, similar sets share at least l tokens of their
l-prefixes (the first n - ceil(0.8 n) + l tokens), for any l; two sets with different l share the smaller l.

1. Every document: size and signature of its set. Equal sets are one from here on.
2. Screen. In hash order, the tokens of a (1 + n/20)-prefix of each set are matched; sets with too few
   shared tokens can have no partner. Nothing but these prefix tokens of all documents is shuffled.
3. The sets left get their tokens' exact frequencies and are ordered rarest first. Each set chooses its l by
   estimated cost: the longer prefix costs more list reading, the higher l leaves fewer candidates.
4. In each token's list, bitmaps bound the overlap of two sets. First each set is paired with one pivot (a
   number of pairs linear in the list), pairs are verified on the whole sets, links give components. Then
   pairs across components that pass the bound in at least l lists are verified too. So no link between two
   components is lost, and pairs inside a component that is known already are never made.
Long lists are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, partitions, rows, staged, table
from .graph import components

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Bits of a set's bitmap; members of one block of a list; longest extra prefix that a set may choose.
BITMAP, BLOCK, LONGEST = 1024, 4096, 32
#: Cost of verifying a candidate, in list entries read for each token of a set.
VERIFY = 0.05


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None, k: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the k-word shingles; one of the whole sequence if it is shorter."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        width = min(k, n)
        h = np.full(n - width + 1, 0x9E3779B97F4A7C15 * width % (1 << 64), np.uint64)
        for i in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + ids[i : n - width + 1 + i]
            h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return np.unique(h)


def signature(tokens) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)


def least_overlap(n):
    """ceil(0.8 n): tokens that a set of n shares with any similar one."""
    return -(-SIMILAR * n // 100)


def place():
    """Tells documents apart, those without a doc_id too: a struct of doc_id (null last) and hash of the text."""
    return F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, at, n_shingles, sig of every row. Null, empty and blank texts have size 0 and sig 0."""
    schema = "doc_id long, text_hash long, n_shingles long, sig long"

    def run(batches):
        def records():
            for d, t, h in rows(batches, "doc_id", "text", "text_hash"):
                s = shingles(t)
                yield d, h, len(s), signature(s) if len(s) else 0

        yield from batched(records(), arrow_schema(schema), 20_000)

    made = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)
    return made.select("doc_id", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("text_hash").alias("t")).alias("at"), "n_shingles", "sig")


def _whole(batches, *columns):
    """All of a partition's batches as numpy columns."""
    import pyarrow as pa

    got = list(batches)
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return [t[c].to_numpy() for c in columns] if t.num_rows else None


def _parts(schema, columns, size=50_000):
    """Arrow batches of numpy columns."""
    import pyarrow as pa

    for i in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size], t) for c, t in zip(columns, schema.types)], schema=schema)


def screened(docs: DataFrame) -> DataFrame:
    """sig, shared: how many tokens of its hash-order prefix each set shares with another set.

    A token that two sets of one map batch hold is known to be shared: it is counted there and one row of it
    goes on for the others, so a very frequent token costs a row per batch.
    """
    import numpy as np

    schema = "tok long, sig long, w int"

    def prefixes(batches):
        for b in batches:
            toks, sigs, seen = [], [], set()
            for t in b.column("text").to_pylist():
                s = shingles(t)
                n = len(s)
                if n and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    size = min(n, n - least_overlap(n) + 1 + n // 20)
                    toks.append(s[:size].view(np.int64))
                    sigs.append(np.full(size, sig, np.int64))
            if not toks:
                continue
            tok, sig = np.concatenate(toks), np.concatenate(sigs)
            _, first, inverse, count = np.unique(tok, return_index=True, return_inverse=True, return_counts=True)
            known = count[inverse] > 1
            lone, again = ~known, first[count > 1]
            own, n = np.unique(sig[known], return_counts=True)
            yield from _parts(arrow_schema(schema), (np.concatenate([tok[lone], tok[again], own]), np.concatenate([sig[lone], sig[again], own]), np.concatenate([np.zeros(lone.sum(), np.int32), np.full(len(again), -1, np.int32), n.astype(np.int32)])))

    out = "sig long, shared long"

    def match(batches):
        got = _whole(batches, "tok", "sig", "w")
        if got is None:
            return
        tok, sig, w = got
        told = w > 0
        rest = ~told
        order = np.lexsort((w[rest], sig[rest], tok[rest]))
        t, s, a = tok[rest][order], sig[rest][order], w[rest][order] < 0
        # One row for each token and set: of equal rows, the first, which is the one counted already if any is.
        keep = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])][: len(t)]
        t, s, a = t[keep], s[keep], a[keep]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]][: len(t)])
        size = np.diff(np.r_[start, len(t)])
        shared = np.repeat((size > 1), size) & ~a
        if len(start):
            shared |= np.repeat(np.logical_or.reduceat(a, start), size) & ~a
        ids, n = np.unique(s[shared], return_counts=True)
        yield from _parts(arrow_schema(out), (np.r_[ids, sig[told]], np.r_[n, w[told]].astype(np.int64)))

    return docs.select("text").mapInArrow(prefixes, schema).repartition(partitions(docs.sparkSession), "tok").mapInArrow(match, out).groupBy("sig").agg(F.sum("shared").alias("shared"))


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, n, toks (array<long>), bitmap of the wanted sets (sig, at: a document that has it)."""
    import numpy as np

    schema = "sig long, n int, toks array<long>, bitmap binary"

    def run(batches):
        def records():
            seen = set()
            for t, sig in rows(batches, "text", "sig"):
                s = shingles(t)
                if sig not in seen and len(s) and signature(s) == sig:
                    seen.add(sig)
                    bits = np.bincount((s % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
                    yield sig, len(s), s.view(np.int64), np.packbits(bits.astype(np.uint8)).tobytes()

        yield from batched(records(), arrow_schema(schema), 500)

    joined = docs.select("text", place().alias("at")).join(wanted.select("at", "sig").hint("shuffle_hash"), "at")
    return joined.select("text", "sig").mapInArrow(run, schema)


def chosen_length(n: int, freq, lone: int) -> int:
    """l for a set of n tokens of which lone are in no other set; freq: the others' frequencies, ascending.

    Reading the lists of an l-prefix costs the sum of their lengths S(l); about S(l) / l sets then share l
    of them and are verified. The cheapest l wins. 0: even the 1-prefix has no shared token.
    """
    import numpy as np

    base = n - least_overlap(n) + 1 - lone
    if base <= 0:
        return 0
    longest = min(LONGEST, least_overlap(n), len(freq) - base + 1)
    if longest < 1:
        return 1
    read = np.cumsum(freq - 1.0)[base - 1 : base - 1 + longest]
    return int(np.argmin(read * (1 + VERIFY * n / np.arange(1, longest + 1)))) + 1


def prefix_lists(sets: DataFrame) -> DataFrame:
    """tok, sig, n, pos, ell, df: the tokens of each set's chosen prefix that some other set has too."""
    import numpy as np

    spark = sets.sparkSession
    one = "tok long, sig long, n int"

    def tokens(batches):
        for b in batches:
            sizes = b.column("toks").value_lengths().to_numpy()
            yield from _parts(arrow_schema(one), (b.column("toks").flatten().to_numpy(), np.repeat(b.column("sig").to_numpy(), sizes), np.repeat(b.column("n").to_numpy(), sizes)))

    counted = "tok long, sig long, n int, df int"

    def frequencies(batches):
        got = _whole(batches, "tok", "sig", "n")
        if got is None:
            return
        order = np.lexsort((got[1], got[0]))
        tok, sig, n = (c[order] for c in got)
        keep = np.r_[True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])]
        tok, sig, n = tok[keep], sig[keep], n[keep]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        df = np.repeat(np.diff(np.r_[start, len(tok)]), np.diff(np.r_[start, len(tok)]))
        held = df > 1
        yield from _parts(arrow_schema(counted), (tok[held], sig[held], n[held], df[held].astype(np.int32)))

    out = "tok long, sig long, n int, pos int, ell int, df int"

    def choose(batches):
        got = _whole(batches, "tok", "sig", "n", "df")
        if got is None:
            return
        order = np.lexsort((got[0], got[3], got[1]))
        tok, sig, n, df = (c[order] for c in got)
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        kept = []
        for a, b in zip(start.tolist(), np.r_[start[1:], len(sig)].tolist()):
            size, lone = int(n[a]), int(n[a]) - (b - a)
            if ell := chosen_length(size, df[a:b], lone):
                k = min(b - a, size - least_overlap(size) + ell - lone)
                at = np.arange(a, a + k)
                kept.append((at, lone + np.arange(k), np.full(k, ell)))
        if kept:
            at, pos, ell = (np.concatenate(c) for c in zip(*kept))
            yield from _parts(arrow_schema(out), (tok[at], sig[at], n[at], pos.astype(np.int32), ell.astype(np.int32), df[at]))

    p = partitions(spark)
    return sets.select("toks", "sig", "n").mapInArrow(tokens, one).repartition(p, "tok").mapInArrow(frequencies, counted).repartition(p, "sig").mapInArrow(choose, out)


def _lists(batches):
    """Each (list, block pair) of a partition: numpy columns sig, comp, n, pos, ell, own block, i, j, bitmaps."""
    import numpy as np
    import pyarrow as pa

    got = list(batches)
    if not got or not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got).sort_by([("tok", "ascending"), ("i", "ascending"), ("j", "ascending"), ("sig", "ascending")])
    tok, i, j = (t[c].to_numpy() for c in ("tok", "i", "j"))
    cols = [t[c].to_numpy() for c in ("sig", "comp", "n", "pos", "ell", "block")]
    bits = np.frombuffer(b"".join(t["bitmap"].to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
    start = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    for a, b in zip(start.tolist(), np.r_[start[1:], len(tok)].tolist()):
        if b - a > 1:
            yield (*(c[a:b] for c in cols), int(i[a]), int(j[a]), bits[a:b])


def _may_link(n, bits, k, others):
    """Can set k be similar to the others, by the bitmaps' bound of the overlap?"""
    import numpy as np

    apart = np.bitwise_count(bits[others] ^ bits[k]).sum(1, dtype=np.int64)
    total = n[others].astype(np.int64) + int(n[k])
    return (100 + SIMILAR) * (total - apart) >= 2 * SIMILAR * total  # overlap <= (total - apart) / 2


def pivot_pairs(batches):
    """One pair for each set of a list and the first set that the bound lets it link with."""
    import numpy as np

    for sig, comp, n, pos, ell, block, i, j, bits in _lists(batches):
        left = np.arange(len(sig))
        while len(left) > 1:
            k, left = left[0], left[1:]
            ok = _may_link(n, bits, k, left)
            for m in left[ok]:
                yield int(sig[k]), int(sig[m]), 0
            left = left[~ok]


def cross_pairs(batches):
    """All pairs of a list across components that the bound lets link, each in one block pair only."""
    import numpy as np

    for sig, comp, n, pos, ell, block, i, j, bits in _lists(batches):
        if (comp == comp[0]).all():
            continue
        for k in range(len(sig) - 1):
            o = np.arange(k + 1, len(sig))
            o = o[(comp[o] != comp[k]) & (np.minimum(block[o], block[k]) == i) & (np.maximum(block[o], block[k]) == j)]
            if len(o):
                for m in o[_may_link(n, bits, k, o)]:
                    yield int(sig[k]), int(sig[m]), int(min(ell[k], ell[m]))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    a = sets.select(F.col("sig").alias("a"), F.col("toks").alias("ta"))
    b = sets.select(F.col("sig").alias("b"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").filter((100 + SIMILAR) * both >= SIMILAR * (F.size("ta") + F.size("tb"))).select("a", "b")


def set_links(docs: DataFrame, sets_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between sets that join all similar sets' components, and the components (node, root).

    sets_of: sig, at, n of each distinct non-empty set of docs.
    """
    spark = docs.sparkSession
    need = 1 + F.floor(F.ceil(F.col("n") * SIMILAR / 100) / 20)  # least l of any partner: it has 0.8 n tokens or more
    wanted = staged(sets_of.join(screened(docs), "sig").filter(F.col("shared") >= need).select("sig", "at"), "ngram-wanted")
    sets = staged(token_sets(docs, wanted), "ngram-sets")
    lists = staged(prefix_lists(sets).join(sets.select("sig", "bitmap"), "sig"), "ngram-lists")
    pair = "a long, b long, ell int"

    def dealt(comps: DataFrame | None, find) -> DataFrame:
        e = lists.withColumn("comp", F.col("sig")) if comps is None else lists.join(comps.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")
        blocks = F.ceil(F.col("df") / BLOCK).cast("int")
        e = e.withColumn("block", F.pmod(F.xxhash64("sig"), blocks).cast("int"))
        e = e.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        e = e.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "df")
        schema = arrow_schema(pair)
        return e.repartition(partitions(spark), "tok", "i", "j").mapInArrow(lambda batches: batched(find(batches), schema, 20_000), pair)

    first = staged(linked(dealt(None, pivot_pairs).select("a", "b").distinct(), sets), "ngram-links")
    comps = components(first, "ngram-first")
    pairs = dealt(comps, cross_pairs).groupBy("a", "b").agg(F.count("*").alias("lists"), F.min("ell").alias("ell")).filter("lists >= ell").select("a", "b")
    links = first.unionByName(staged(linked(pairs, sets), "ngram-links"))
    return links, components(links, "ngram-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable by links, the document's own included; documents with the
    same set are linked. Null, empty and blank texts link with nothing. Repeated rows stay, each a row. A row without
    a doc_id links like any other; a component of such rows only has a null component_id.
    """
    members = staged(signed(docs), "ngram-members")
    sets_of = staged(members.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.first("n_shingles").alias("n")), "ngram-reps")
    _, comps = set_links(docs, sets_of)
    named = comps.join(sets_of.select(F.col("sig").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    moved = named.join(least, "root").select(F.col("node").alias("sig"), "least")
    ids = sets_of.select("sig", "rep").join(moved, "sig", "left").select("sig", F.coalesce("least", "rep").alias("component"))
    # Texts without a word are not joined: together they may be a third of all rows.
    full = members.filter("n_shingles > 0").join(ids, "sig").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return full.unionByName(members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each component does: that with the smallest doc_id, and
    all documents without a word or without a doc_id. Of rows that repeat a doc_id, one stays for each text.

    docs' own columns, whatever their names.
    """
    own = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.col("text"))
    found = near_duplicates(docs.select("doc_id", "text")).filter("n_shingles > 0 and doc_id is not null and doc_id <> component_id")
    gone = staged(found.select("doc_id").distinct(), "ngram-gone")
    return own.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select("_row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
