"""Document fingerprints: a canonical exact digest.

Canonical form: Unicode NFKC, case folding, runs of white space to one space, ends trimmed. Documents are
grouped by the 128-bit xxhash of it, and inside a bucket the canonical bytes are compared: contents that
differ although their digests are equal get fingerprints with a suffix (-1, -2 ...), so equal fingerprints
always mean equal canonical bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, batched, partitions, rows, staged, table


def canonical(text: str | None) -> bytes:
    """Null counts as the empty text."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def digests(content: bytes) -> tuple[str, int]:
    """The wide digest and an independent 63-bit check that tells colliding contents apart later."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(content), xxhash.xxh3_64_intdigest(content, 0x5EED) >> 1


#: Hexadecimal digits of a digest that name its slot in the bitmap of suspects: 16 M slots, 2 MB.
SLOT = 6


def suspects(digest: DataFrame, column: str) -> bytearray:
    """A bitmap of the slots that two or more rows' digests share; its size is the same for every input."""
    slot = F.conv(F.substring(column, 33 - SLOT, SLOT), 16, 10).cast("long")
    shared = digest.groupBy(slot.alias("slot")).count().filter("count > 1")
    words = shared.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    bitmap = bytearray(16**SLOT // 8)
    for word, bits in words.toLocalIterator():
        bitmap[word * 8 : word * 8 + 8] = (bits % (1 << 64)).to_bytes(8, "little")
    return bitmap


def collisions(docs: DataFrame, text: str = "text", among: bytearray | None = None) -> DataFrame:
    """Contents that share a digest with a different content: digest, check, class (1 or more).

    among: a result of suspects() for the same texts; contents whose slot is not in it share no digest and are
    not sent.
    Each map task sends one compressed copy of a content that it has seen (an exact copy is compared where it
    is read), so a content that a third of all rows hold costs one row per task. In a bucket, contents are
    compared byte by byte. Almost always empty.
    """
    sent_schema = "digest string, `check` long, packed binary"
    bitmap = docs.sparkSession.sparkContext.broadcast(bytes(among)) if among is not None else None

    def send(batches):
        import zstandard

        seen, held, pack = {}, 0, zstandard.ZstdCompressor(level=1)

        def records():
            nonlocal held
            for (t,) in rows(batches, "t"):
                content = canonical(t)
                d, c = digests(content)
                slot = int(d[-SLOT:], 16)
                if bitmap and not bitmap.value[slot // 8] >> slot % 8 & 1 or seen.get(d) == content:
                    continue
                yield d, c, pack.compress(content)
                if held + len(content) > 32 << 20:
                    seen.clear()
                    held = 0
                seen[d] = content
                held += len(content)

        yield from batched(records(), arrow_schema(sent_schema))

    found_schema = "digest string, `check` long, class int"

    def compare(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def records():
            last, contents = None, []
            for d, c, z in rows(batches, "digest", "check", "packed"):
                content = unpack.decompress(z)
                if d != last:
                    last, contents = d, [content]
                elif content not in contents:
                    yield d, c, len(contents)
                    contents.append(content)

        yield from batched(records(), arrow_schema(found_schema))

    sent = docs.select(F.col(text).alias("t")).mapInArrow(send, sent_schema)
    sent = sent.repartition(partitions(docs.sparkSession), "digest").sortWithinPartitions("digest", "check")
    return sent.mapInArrow(compare, found_schema)


def classed(digest: DataFrame, found: DataFrame, column: str, check: str) -> DataFrame:
    """Put the class suffix on a digest column; found is a result of collisions()."""
    f = found.select(F.col("digest").alias("_d"), F.col("check").alias("_c"), "class")
    out = digest.join(f, (F.col(column) == F.col("_d")) & (F.col(check) == F.col("_c")), "left")
    return out.withColumn(column, F.when(F.col("class").isNull(), F.col(column)).otherwise(F.concat_ws("-", column, F.col("class")))).drop("_d", "_c", "class")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint, which replaces one of that name; its other columns stay, whatever their names.

    Null and empty texts share one fingerprint; repeated rows stay; an empty table gives an empty result.
    """

    @F.pandas_udf("digest string, check long")
    def both(t):
        import pandas as pd

        return pd.DataFrame([digests(canonical(x)) for x in t], columns=["digest", "check"])

    out = docs.select(F.struct(*docs.columns).alias("_row"), both(F.col(text)).alias("_both"))
    out = out.select("_row", F.col("_both.digest").alias("fingerprint"), F.col("_both.check").alias("_check"))
    out = classed(out, collisions(docs, text), "fingerprint", "_check")
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "fingerprint"], "fingerprint")


def edited(text: str, after: str) -> str:
    """text with its last third replaced by the start of the document after it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, `check` long, edited_fingerprint string, edited_check long, next_fingerprint string, next_check long"


def _compared(doc_id, text, after):
    e = edited(text, after)
    return (doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), *digests(canonical(text)), *digests(canonical(e)), *digests(canonical(after)))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text and of the next one in descending doc_id.

    Null and empty texts are one content; repeated rows stay. Ties in doc_id are ordered by a hash of the text, null
    ids come last; an empty table gives an empty result. Documents are dealt in ranges of doc_id; each range keeps its
    first and last text, so that the pairs across two ranges are made afterwards. Contents of documents with equal
    digests are told apart by their bytes; an edited text is held by its digest and check (192 bits together).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"part int, edge string, text binary, {ROW}"

    @F.pandas_udf("binary")
    def packed(t):
        import pandas as pd
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        return pd.Series([c.compress(x.encode("utf-8", "surrogatepass")) for x in t])

    def walk(batches):
        import zstandard
        from pyspark import TaskContext

        part, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()

        def records():
            before = None
            for doc_id, z in rows(batches, "doc_id", "z"):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                if before is None:
                    yield (part, "head", z, doc_id, *[None] * 8)
                else:
                    yield (part, None, None, *_compared(*before[:2], text))
                before = (doc_id, text, z)
            if before:
                yield (part, "tail", before[2], before[0], *[None] * 8)

        yield from batched(records(), arrow_schema(schema))

    ordered = docs.select("doc_id", F.xxhash64("text").alias("h"), packed("text").alias("z"))
    ordered = ordered.repartitionByRange(partitions(spark), F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "h")
    walked = staged(ordered.mapInArrow(walk, schema), "fingerprint")

    heads = walked.filter("edge = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = walked.filter("edge = 'tail'").select("part", "doc_id", "text")
    # One row for each range of documents, so this window stays as small as the number of partitions.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = tails.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(whole)).alias("next_part"))

    def join_edges(batches):
        import zstandard

        un = zstandard.ZstdDecompressor()
        text = lambda z: un.decompress(z).decode("utf-8", "surrogatepass")
        yield from batched((_compared(d, text(a), text(b)) for d, a, b in rows(batches, "doc_id", "text", "next_text")), arrow_schema(ROW))

    edges = tails.join(order, "part").join(heads, "next_part").select("doc_id", "text", "next_text").mapInArrow(join_edges, ROW)
    out = walked.filter("edge is null").drop("part", "edge", "text").unionByName(edges)

    found = staged(collisions(docs, among=suspects(out, "fingerprint")), "collisions")
    for column, check in (("fingerprint", "check"), ("edited_fingerprint", "edited_check"), ("next_fingerprint", "next_check")):
        out = classed(out, found, column, check)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
