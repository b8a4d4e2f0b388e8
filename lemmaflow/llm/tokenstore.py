"""Token ids in a content-addressed store.

An id stream is cut where a rolling hash of its last 16 ids says so; a chunk is stored once under the digest
of its bytes; a document is a recipe, the list of its chunks' digests; manifests hold the recipes in
ascending doc_id order with the Merkle root of each document and of each shard.

Layout of a store:
  objects/kind=1  chunks: key (16-byte BLAKE2b of payload), n, payload (ids, little-endian unsigned 16 or 32 bits)
  manifest        shard, doc_id, n, recipe (the keys, one after another), root
  shards          shard, first doc_id, n_docs, n_tokens, root
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .align import byte_of
from .common import arrow_schema, batched, discard, partitions, rows, table, tokenizer_file, work_dir

KEY = 16
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 64, 9, 2048

#: The pre-tokeniser pattern of the byte-level vocabulary (a fixed value of its file format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Entries that a cache of a Python worker may hold; a full cache keeps what it has, mostly frequent words.
CACHED = 800_000
#: Bytes of text, about, whose words are looked up together.
TOGETHER = 8 << 20


class _Pieces(dict):
    """Pre-token to packed ids; a new one is encoded by the tokenizers library's BPE model."""

    def __init__(self, tokenizer, width):
        self.tokenize = tokenizer.model.tokenize
        self.packed = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]
        self.letters = {b: c for c, b in byte_of().items()}
        self.space = self.letters[32]

    def encode(self, piece):
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.space)  # other printable ASCII stands for itself
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(mapped)])

    def __missing__(self, piece):
        ids = self.encode(piece)
        if len(self) < CACHED // 4:
            self[piece] = ids
        return ids


class _Words(dict):
    """A space-delimited word (prefix: what stands before it) to packed ids."""

    def __init__(self, pieces, prefix, most):
        import regex

        self.most = most
        self.pieces, self.prefix, self.cut = pieces, prefix, regex.compile(PRETOKEN).findall

    def __missing__(self, word):
        if word.isalpha():  # letters only: one pre-token with its space
            ids = self.pieces.encode(self.prefix + word)
        elif word[:-1].isalpha() and word[-1] in ",.;:!?":
            return self[word[:-1]] + self.pieces[word[-1]]
        else:
            pieces = self.pieces
            ids = b"".join([pieces[p] for p in self.cut(self.prefix + word)])
        if len(self) < self.most:
            self[word] = ids
        return ids


class ByteLevelEncoder:
    """Same ids as tokenizers' encode(text, add_special_tokens=False), packed, with caches of words.

    Added tokens of the vocabulary (such as <|endoftext|>) that stand in a text are cut out first, the longest of
    those that start at one place, and have their own ids; what lies between them is encoded by itself.
    A lone space or newline between two other characters always ends a pre-token: texts whose only white space
    is of that kind are cut there first. Other texts go through the pattern whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        self.pieces = _Pieces(tok, self.width)
        self.bare, self.spaced = _Words(self.pieces, "", CACHED // 4), _Words(self.pieces, " ", CACHED)
        self.cut = regex.compile(PRETOKEN).findall
        added = tok.get_added_tokens_decoder()
        for a in added.values():
            if a.single_word or a.lstrip or a.rstrip:
                raise ValueError(f"added token {a.content!r} takes in what stands beside it")
        self.added = {a.content: i.to_bytes(self.width, "little") for i, a in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        # What plain() looks for, as a pattern of Arrow's; there is no white space beyond U+3000.
        self.odd = "[ \n]{2}|[" + "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]"

    @staticmethod
    def plain(text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        if text.isascii():
            return not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
        return len("".join(text.split())) == len(text) - text.count(" ") - text.count("\n")

    def __call__(self, text: str) -> bytes:
        for a in self.added:
            if a in text:
                parts = self.split(text)
                return b"".join([self.added[p] if k % 2 else self.between(p) for k, p in enumerate(parts)])
        return self.between(text)

    def between(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return b"".join([self.pieces[p] for p in self.cut(text)])
        newline, out, spaced = self.pieces["\n"], [], self.spaced.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            first = words.pop(0)
            out.append((self.bare[first] if first else b"") + b"".join(map(spaced, words)))
        return newline.join(out)

    def many(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array of strings without nulls: each different word is looked up once for all of them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, self.odd)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        # A word behind a newline has it in front, and so has a text's first one, whose newline is cut off again below.
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(pc.if_else(odd, "\n", marked), " ")
        coded = words.flatten().dictionary_encode()
        newline, bare, spaced = self.pieces["\n"], self.bare, self.spaced
        packed = [newline + bare[w[1:]] if w[:1] == "\n" else spaced[w] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids = pa.array(packed, pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[words.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2])
        out = [bytes(data[i + len(newline) : j]) for i, j in zip(ends[:-1], ends[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self(texts[k].as_py())
        return out


def cuts(ids) -> list[int]:
    """Ends of the content-defined chunks of a numpy array of ids; they depend on the last 16 ids only,
    but for chunks being MIN_CHUNK to MAX_CHUNK ids long."""
    import numpy as np

    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        factor, step = 0x85EBCA6B, 1
        while step < 16:
            h[step:] += np.uint32(factor) * h[:-step]
            factor, step = factor * factor % (1 << 32), step * 2
    ends, at = [], 0
    for e in (np.flatnonzero(h < 1 << 32 - MEAN_BITS) + 1).tolist():
        while e - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if e - at >= MIN_CHUNK:
            ends.append(e)
            at = e
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    return ends + [n] if at < n else ends


def key_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=KEY).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a lone node goes up unchanged, no leaves give the digest of nothing."""
    level = leaves or [hashlib.blake2b(b"", digest_size=KEY).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=KEY).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split_keys(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + KEY] for i in range(0, len(recipe), KEY)]


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0) -> None:
    """Encode every whole text of docs (doc_id, text; null text: empty) and write the store at path. tokenizer: its
    vocabulary file (default: the public byte-level one of 50k).

    Each document gets end_id behind its ids. Repeated rows and equal doc_ids are separate documents; an
    empty table gives an empty store. Only the encoded rows are shuffled: a chunk once per task that met it.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_file("byte_bpe_50k.json")
    schema = "kind int, key binary, doc_id long, n int, payload binary"

    def encode(batches):
        import numpy as np
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        w, kind = encoder.width, np.dtype(f"<u{encoder.width}")
        end = b"" if end_id is None else end_id.to_bytes(w, "little")

        def records():
            seen: set[bytes] = set()
            for row, (doc_id, data) in enumerate(_encoded(batches, encoder)):
                data += end
                keys, at = [], 0
                for e in cuts(np.frombuffer(data, kind)):
                    payload = data[at * w : e * w]
                    key = key_of(payload)
                    keys.append(key)
                    if key not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(key)
                        yield 1, key, None, e - at, payload
                    at = e
                # Documents of one doc_id lie in the order of their roots, as starts() counts them.
                yield 0, merkle(keys) + part.to_bytes(8, "big") + row.to_bytes(8, "big"), doc_id, len(data) // w, b"".join(keys)

        yield from batched(records(), arrow_schema(schema))

    made = docs.select("doc_id", "text").mapInArrow(encode, schema).dropDuplicates(["kind", "key"])
    made.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/objects")

    kinds = spark.read.schema("key binary, doc_id long, n int, payload binary, kind int").parquet(f"{path}/objects")
    recipes = kinds.filter("kind = 0").select("doc_id", "n", F.col("payload").alias("recipe"), "key")
    ordered = recipes.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "key")
    entry = "shard int, doc_id long, n int, recipe binary, root binary"

    def sign(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        yield from batched(((shard, d, n, r, merkle(split_keys(r))) for d, n, r in rows(batches, "doc_id", "n", "recipe")), arrow_schema(entry))

    ordered.mapInArrow(sign, entry).write.option("compression", "uncompressed").parquet(f"{path}/manifest")
    total = "shard int, first long, n_docs long, n_tokens long, root binary"

    def roots(t):
        t = t.sort_by([("doc_id", "ascending"), ("root", "ascending")])
        row = (t["shard"][0].as_py(), t["doc_id"][0].as_py(), t.num_rows, sum(t["n"].to_pylist()), merkle(t["root"].to_pylist()))
        return next(pa_tables([row], total))

    manifest(spark, path).select("shard", "doc_id", "n", "root").groupBy("shard").applyInArrow(roots, total).write.parquet(f"{path}/shards")
    discard(spark, f"{path}/objects/kind=0")


def _encoded(batches, encoder: ByteLevelEncoder):
    """(doc_id, packed ids) of each row of Arrow batches (doc_id, text); TOGETHER bounds the memory that this takes."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), pc.fill_null(b.column("text"), "")
        upto, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while at < len(ids):
            most = TOGETHER + (int(upto[at - 1]) if at else 0)
            n = max(1, int(np.searchsorted(upto, most, "right")) - at)
            yield from zip(ids[at : at + n], encoder.many(texts.slice(at, n)))
            at += n


def pa_tables(records, ddl):
    import pyarrow as pa

    for b in batched(records, arrow_schema(ddl)):
        yield pa.Table.from_batches([b])


_ENCODERS: dict = {}


def _encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each Python worker; its bounded caches serve later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, doc_id long, n int, recipe binary, root binary").parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, n int, payload binary, kind int").parquet(f"{path}/objects").filter("kind = 1").drop("kind")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """manifest with row (a number within the shard) and start: the ids of all documents before."""
    m = manifest(spark, path)
    within = Window.partitionBy("shard").orderBy("doc_id", "root")
    # One row for each shard: this window is as small as the number of shards.
    before = spark.read.schema("shard int, first long, n_docs long, n_tokens long, root binary").parquet(f"{path}/shards")
    before = before.select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return m.withColumns({"row": F.row_number().over(within), "upto": F.sum(F.col("n").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))}).join(before, "shard").withColumn("start", F.col("base") + F.col("upto") - F.col("n")).drop("upto", "base")


def _recipe_rows(m: DataFrame) -> DataFrame:
    """A row for each chunk of each document: shard, row, pos, key."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast(length(recipe) / {KEY} as int) - 1")), lambda i: F.substring("recipe", i * KEY + 1, F.lit(KEY)))).alias("pos", "key")
    return m.filter("length(recipe) > 0").select("shard", "row", at)


def ids_of(payload: bytes, n: int):
    """A chunk's ids: their width, 2 or 4 bytes, is what its n ids take."""
    import numpy as np

    width = len(payload) // max(n, 1)
    if len(payload) != n * width or n and width not in (2, 4):
        raise ValueError(f"chunk {key_of(payload).hex()} is damaged")
    return np.frombuffer(payload, f"<u{width or 2}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>): every document put together from its chunks, each chunk checked
    against its key and the whole against the document's Merkle root."""
    m = starts(spark, path)
    parts = _recipe_rows(m).join(chunks(spark, path), "key").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "payload", "n"))).alias("parts"))
    joined = m.join(parts, ["shard", "row"], "left").select("doc_id", "start", "root", F.col("parts.key").alias("keys"), F.col("parts.n").alias("ns"), F.col("parts.payload").alias("payloads"))
    out = "doc_id long, start long, ids array<int>"

    def build(batches):
        import numpy as np

        def records():
            for d, s, root, keys, ns, payloads in rows(batches, "doc_id", "start", "root", "keys", "ns", "payloads"):
                keys, ns, payloads = keys or [], ns or [], payloads or []
                if merkle(keys) != root or any(key_of(p) != k for k, p in zip(keys, payloads)):
                    raise ValueError(f"document {d} does not match its manifest")
                yield d, s, np.concatenate([np.zeros(0, np.int32), *map(ids_of, payloads, ns)]).astype(np.int32)

        yield from batched(records(), arrow_schema(out), 200)

    return joined.mapInArrow(build, out)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the stored files.

    Each stored chunk is read once, checked against its key and reduced to the CRC-32 of its ids as unsigned
    32-bit integers; recipes then join these thin rows, and a document's CRC is combined from its chunks'.
    So chunk bytes are never shuffled again, however many documents share them.
    """
    thin = "key binary, n int, crc long"

    def check(batches):
        def records():
            for key, n, payload in rows(batches, "key", "n", "payload"):
                if key_of(payload) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                yield key, n, zlib.crc32(ids_of(payload, n).astype("<u4").tobytes())

        yield from batched(records(), arrow_schema(thin))

    m = starts(spark, path)
    parts = _recipe_rows(m).join(chunks(spark, path).mapInArrow(check, thin), "key").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("parts"))
    joined = m.join(parts, ["shard", "row"], "left").select("doc_id", "start", "n", "root", F.col("parts.key").alias("keys"), F.col("parts.n").alias("ns"), F.col("parts.crc").alias("crcs"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def combine(batches):
        def records():
            for d, s, n, root, keys, ns, crcs in rows(batches, "doc_id", "start", "n", "root", "keys", "ns", "crcs"):
                keys, ns, crcs = keys or [], ns or [], crcs or []
                if merkle(keys) != root or sum(ns) != n:
                    raise ValueError(f"document {d} does not match its manifest")
                crc = 0
                for k, c in zip(ns, crcs):
                    zeros = bytes(4 * k)
                    crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ c
                yield d, s, n, crc

        yield from batched(records(), arrow_schema(out))

    return joined.mapInArrow(combine, out)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokenstore")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_checksums(spark, path)
