"""Alignment of the tokens of two tokenizers, a byte-level BPE (A) and a SentencePiece model (B).

Texts are cut where a blank, or a newline between two other characters, stands behind a character that is no white space:
both tokenizers end a token there (A's pattern starts a new pre-token, and no piece of B goes on with a blank or holds
a newline), so a text's tokens and links are those of its segments, and equal segments are aligned once. For the same reason
segments can be encoded together, as one text.

In such a text, the libraries' spans give the coarse ends of tokens: A's are character offsets, B's are byte spans of its
proto output. Tokens that hold a part of a character (A's pieces of multibyte characters, B's byte fallback) have no end
of their own there; their ends are refined with the bytes that the
token decodes to. (The installed sentencepiece calls its immutable proto 'proto'.)

Counts of linked id pairs are made over all documents by Spark, with the links of a block of documents added up first.
A block is a row of its documents' segments, its segments' links and its distinct pairs; the pairs' counts come back to it
by a join and are summed there.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from contextlib import contextmanager
from itertools import chain
from operator import attrgetter, itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WIDE, arrow_schema, batched, rows, staged, table, tokenizer_file

SPACE = "▁"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that a Python worker keeps, none longer than KEPT characters: a full memory keeps what it has, mostly frequent ones.
CACHED, KEPT = 250_000, 64
#: Segments that are encoded together.
TOGETHER = 2000
#: Characters of text after which a block ends. One longer document is a block of its own.
BLOCK = 1_500_000
#: White space: Python's, which includes all that A's pattern knows, and U+180E.
WHITE = r"\s\u180e"
#: A blank with something behind it (B makes no token of an empty text), or a lone newline.
CUT = re.compile(rf"(?<=[^{WHITE}])(?= .|\n[^{WHITE}])", re.DOTALL)
#: Texts without this can be cut by plain splitting.
UNCUT = re.compile(rf"[{WHITE}][ \n]|\n[{WHITE}]|[{WHITE}]$")
#: Of a piece in B's proto output; of an alignment, the numbers of A tokens, B tokens and groups.
ID_END, COUNTS = attrgetter("id", "end"), itemgetter(0, 1, 2)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        to, vocabulary = byte_of(), self.a.get_vocab()
        self.size_a = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size_a[list(vocabulary.values())] = list(map(len, vocabulary))
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.size_b = np.array(list(map(len, self.bytes)), np.int64)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in names) or not all(c in to for t in vocabulary for c in t if t not in self.special()):
            raise ValueError("these tokenizers do not end their tokens where texts are cut")
        texts = lambda n, by: np.array([f"{i}{by}" for i in range(n)], object)
        self.text_a = texts(len(self.size_a), ","), texts(len(self.size_a), "|")
        self.text_b = texts(len(self.bytes), ","), texts(len(self.bytes), ";")
        self.known: dict[str, tuple] = {}

    def special(self) -> set[str]:
        return {t.content for t in self.a.get_added_tokens_decoder().values()}

    @staticmethod
    def cut(text: str) -> list[str]:
        """The segments of a text that begins with a blank."""
        return Aligner.cut_plain(text) if not UNCUT.search(text) else CUT.split(text)

    @staticmethod
    def cut_plain(text: str) -> list[str]:
        """As cut(), of a text without UNCUT."""
        parts = [" " + w for w in text[1:].split(" ")]
        if "\n" not in text:
            return parts
        return [s for p in parts for s in ([p] if "\n" not in p else [(x if i == 0 else "\n" + x) for i, x in enumerate(p.split("\n"))])]

    def together(self, segments: list[str]) -> list[tuple] | None:
        """For each segment (number of A tokens, B tokens, groups; the groups as text; linked id pairs, a << 32 | b, packed); null if B's
        tokens do not give back the bytes, or a segment does not end with a token of both.

        The first segment begins with a blank; all but the last end with no white space.
        """
        import numpy as np

        text = "".join(segments)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        # Each piece of the proto is a Python object while it is read: once is enough.
        ids_a, of_b = np.array(a.ids, np.int64), np.fromiter(chain.from_iterable(map(ID_END, b)), np.int64, 2 * len(b))
        ids_b = of_b[::2]
        if b"".join(map(self.bytes.__getitem__, ids_b.tolist())) != raw:
            return None
        at = np.arange(len(raw) + 1)
        if len(raw) != len(text):  # where each character begins
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])
        ends_a = refined(at[np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(ids_a))[1::2]], self.size_a[ids_a])
        # The blank before B's text is in no span.
        ends_b = refined(of_b[1::2] + 1, self.size_b[ids_b])
        borders = np.cumsum(list(map(len, segments if len(raw) == len(text) else map(str.encode, segments))))
        if ends_a[-1] != len(raw) or ends_b[-1] != len(raw):
            return None
        is_a, is_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        is_common, ends = is_a & is_b, np.flatnonzero(is_a | is_b)
        if not is_common[borders].all():
            return None
        # Numbers of ends up to each byte. Between two neighbouring ends lies exactly one pair of overlapping tokens.
        to_a, to_b, to_common, to_any = (np.cumsum(x) for x in (is_a, is_b, is_common, is_a | is_b))
        links = ids_a[to_a[ends - 1]] << 32 | ids_b[to_b[ends - 1]]
        group = np.concatenate([2 * to_common[ends_a - 1], 2 * to_common[ends_b - 1] + 1])
        shown = np.concatenate([np.where(is_b[ends_a], self.text_a[1][ids_a], self.text_a[0][ids_a]), np.where(is_a[ends_b], self.text_b[1][ids_b], self.text_b[0][ids_b])])
        shown = shown[np.argsort(group, kind="stable")].tolist()
        cuts = [x[borders] for x in (to_a, to_b, to_common, to_any)]
        n_a, n_b, n_groups = (np.diff(c, prepend=0).tolist() for c in cuts[:3])
        both, links_to = (cuts[0] + cuts[1]).tolist(), cuts[3].tolist()
        froms = zip([0, *both], both, [0, *links_to], links_to)
        return [(x, y, z, "".join(shown[lo:hi])[:-1], links[l0:l1].tobytes()) for x, y, z, (lo, hi, l0, l1) in zip(n_a, n_b, n_groups, froms)]

    def alone(self, segments: list[str]) -> dict[str, tuple | None]:
        """Alignments of segments that are encoded together, or in halves where that does not work; null for those whose bytes B does not give back."""
        # A segment that begins with a newline stands behind another one.
        own = self.together(segments) if segments[0][0] == " " else (r := self.together([" a", *segments])) and r[1:]
        if own is not None:
            return dict(zip(segments, own))
        if len(segments) == 1:
            return {segments[0]: None}
        half = len(segments) // 2
        return self.alone(segments[:half]) | self.alone(segments[half:])

    def of(self, segments: list[str], loose: set[str]) -> list[tuple | None]:
        """Alignments of distinct segments. loose: those that may not stand before others in one text."""
        known, made, held, size = self.known, {}, [], 0
        for s in [s for s in segments if s not in known]:
            if s in loose:
                made |= self.alone([s])
                continue
            held.append(s)
            size += len(s)
            if len(held) >= TOGETHER or size > 50 * TOGETHER:
                made |= self.alone(held)
                held, size = [], 0
        if held:
            made |= self.alone(held)
        out = [made[s] if s in made else known[s] for s in segments]
        for s, m in made.items():
            if len(known) >= CACHED:
                break
            if len(s) <= KEPT:
                known[s] = m
        return out


def refined(coarse, sizes):
    """Ends of tokens in bytes. coarse: the ends of the libraries' spans; sizes: how many bytes each token decodes to.

    A token that ends with a character ends where its span does. One that ends within a character has a span to
    that character's end, or to its beginning, and ends behind the bytes that it and those before it decode to.
    """
    import numpy as np

    decoded = np.cumsum(sizes)
    return np.where(coarse == decoded, coarse, decoded)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each Python worker."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


BLOCKS = (
    "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "doc_at array<int>, segs array<int>, times array<int>, seg_at array<int>, links array<int>, pairs array<long>, n_pairs array<long>"
)


class Places(dict):
    """Segment to its number, in the order of appearance."""

    def __missing__(self, segment):
        self[segment] = n = len(self)
        return n


@contextmanager
def uncollected():
    """No search for cycles: a block makes millions of tuples and none of them is in a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@uncollected()
def block_row(t: Aligner, docs: list[tuple]) -> tuple:
    """A row of BLOCKS of documents (doc_id, text).

    Document d has the distinct segments segs[doc_at[d]:doc_at[d + 1]], so many times each; segment s has the links
    links[seg_at[s]:seg_at[s + 1]], places in pairs, which the block holds n_pairs times.
    """
    import numpy as np

    place, loose, ids = Places(), set(), []
    for _, x in docs:
        cut = []
        if x and SPACE not in x:
            if UNCUT.search(x := " " + x):
                cut = CUT.split(x)
                loose |= {s for s in cut if UNCUT.search(s)}
            else:
                cut = t.cut_plain(x)
        ids.append(np.fromiter(map(place.__getitem__, cut), np.int64, len(cut)))
    found = t.of(list(place), loose)
    bad = np.array([m is None for m in found], bool)
    ids = [i if not bad[i].any() else i[:0] for i in ids]
    meta = [m or (0, 0, 0, "", b"") for m in found]
    counts = np.fromiter(chain.from_iterable(map(COUNTS, meta)), np.int64, 3 * len(meta)).reshape(-1, 3)
    texts = np.array([m[3] for m in meta], object)
    sizes = np.array([len(m[4]) // 8 for m in meta], np.int64)
    pairs, links = np.unique(np.frombuffer(b"".join([m[4] for m in meta]), np.int64), return_inverse=True)
    seg_at = np.concatenate([[0], np.cumsum(sizes)])
    total, doc_at = np.zeros(len(meta), np.int64), [0]
    segs, times, shas, numbers = [], [], [], []
    for i in ids:
        own, n = np.unique(i, return_counts=True)
        total[own] += n
        segs.append(own)
        times.append(n)
        doc_at.append(doc_at[-1] + len(own))
        numbers.append([*(n @ counts[own]).tolist(), int(n @ sizes[own])] if len(i) else [0, 0, 0, 0])
        shas.append(hashlib.sha256(";".join(texts[i].tolist()).encode()).hexdigest() if len(i) else "")
    n_pairs = np.bincount(links, weights=np.repeat(total, sizes), minlength=len(pairs)).astype(np.int64) if len(pairs) else []
    join = lambda parts: np.concatenate(parts).astype(np.int32) if parts else []
    return (os.urandom(16).hex(), [d for d, _ in docs], *map(list, zip(*numbers)), shas, doc_at, join(segs), join(times), seg_at.astype(np.int32), links.astype(np.int32), pairs, n_pairs)


def blocks(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Rows of BLOCKS that hold each row of docs (doc_id, text) once. The name of a block is random: write them before use."""
    paths = byte_level or tokenizer_file(BYTE_LEVEL), pieces or tokenizer_file(PIECES)

    def run(batches):
        t, schema = aligner(*paths), arrow_schema(BLOCKS)

        def records():
            held, size = [], 0
            for d, x in rows(batches, "doc_id", "text"):
                if held and size + len(x or "") > BLOCK:
                    yield block_row(t, held)
                    held, size = [], 0
                held.append((d, x))
                size += len(x or "") + 50
            if held:
                yield block_row(t, held)

        yield from batched(records(), schema, 1)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n, best: links of all documents that join the two ids; does no other A id have more with that B id?

    One row for each B id is broadcast: at most as many as B's vocabulary has.
    """
    n = made.select(F.explode(F.arrays_zip("pairs", "n_pairs")).alias("p")).groupBy("p.pairs").agg(F.sum("p.n_pairs").alias("n"))
    n = staged(n.select(F.col("pairs").alias("pair"), "n", F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b")), "pair-counts")
    best = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """ALIGNED of every row of docs. Texts null, empty, or not given back by B's pieces (U+2581, characters that its
    normaliser changes) have no tokens: zeros and ''. Repeated rows stay, and count as often as they stand. An empty table
    gives an empty result; other columns are not read.
    """
    made = staged(blocks(docs, byte_level, pieces), "aligned-blocks", **WIDE)
    asked = made.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(made), "pair")
    answers = asked.select(F.col("block").alias("of"), "at", "n", "best")
    own = made.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc_at", "segs", "times", "seg_at", "links")
    # Groups go to Python one by one; joined rows would go in batches of thousands of blocks, of several MB each.
    return own.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed, ALIGNED)


def summed(block, answers):
    """Rows of ALIGNED of a block (a row of it) with the counts of its pairs (a row each)."""
    import numpy as np
    import pyarrow as pa

    schema = arrow_schema(ALIGNED)
    r = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
    v = {c: r[c].to_numpy() for c in ("doc_at", "segs", "times", "seg_at", "links")}
    at = answers.column("at").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
    # Sums over a segment's links by differences of running sums.
    run_n, run_best = (np.concatenate([[0], np.cumsum(x[v["links"]])]) if len(v["links"]) else np.zeros(1, np.int64) for x in (n, best))
    seg_n, seg_best = (np.diff(x[v["seg_at"]]) for x in (run_n, run_best))
    doc_n, doc_best = (np.concatenate([[0], np.cumsum(x[v["segs"]] * v["times"])]).astype(np.int64) if len(v["segs"]) else np.zeros(1, np.int64) for x in (seg_n, seg_best))
    sums = [pa.array(np.diff(x[v["doc_at"]]), pa.int64()) for x in (doc_best, doc_n)]
    columns = [*(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, r["groups_sha256"]]
    return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def groups(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, at (group's number in the document), a_ids, b_ids of every row of docs: the groups themselves."""
    paths = byte_level or tokenizer_file(BYTE_LEVEL), pieces or tokenizer_file(PIECES)
    schema = "doc_id long, at long, a_ids array<int>, b_ids array<int>"

    def run(batches):
        t = aligner(*paths)

        def records():
            for d, x in rows(batches, "doc_id", "text"):
                cut = [] if not x or SPACE in x else t.cut(" " + x)
                names = list(dict.fromkeys(cut))
                found = dict(zip(names, t.of(names, {s for s in names if UNCUT.search(s)})))
                if all(found.values()):
                    every = (g for s in cut for g in found[s][3].split(";"))
                    yield from ((d, k, *([int(i) for i in side.split(",")] for side in g.split("|"))) for k, g in enumerate(every))

        yield from batched(records(), arrow_schema(schema))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
