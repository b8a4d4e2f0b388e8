"""SentencePiece (BPE) encoding and decoding by a table of each prefix's last token.

For merge-type vocabularies the encoding of every prefix of a text ends in one certain token: the only piece
that matches there and may stand behind the last token of the prefix before it. An automaton lists the
pieces that end at each character, a pair test (does merging the two pieces' text give just these two?)
picks the one, and the ids are then read backwards from the end.

Characters in no piece become their UTF-8 byte pieces. Pieces that are runs of white space share one score,
so ties, not ranks, decide there; units with such runs are merged directly instead.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, rows, table, tokenizer_file

SPACE = "▁"
#: Entries that a cache of a Python worker may hold; a full cache keeps what it has, mostly frequent words.
CACHED = 400_000
MODEL = "piece_bpe_32k.model"


class PieceTable:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece] = (-sp.get_score(i), i)
        #: Characters that stand side by side in no piece: no token goes across such a place.
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.pairable: dict[int, bool] = {}
        self.piece = {i: p for p, (_, i) in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if not p.strip(SPACE) or self.merge(p) == [p]:
                self.automaton.add_word(p, (self.rank[p][1], len(p)))
        self.automaton.make_automaton()
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best adjacent pair first, the leftmost among equals."""
        symbols, rank = list(text), self.rank
        while len(symbols) > 1:
            best = min(((rank[s][0], i) for i in range(len(symbols) - 1) if (s := symbols[i] + symbols[i + 1]) in rank), default=None)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def pair(self, left: int, right: int) -> bool:
        """May the token right stand behind the token left? So if merging their text gives these two."""
        a, b = self.piece[left], self.piece[right]
        known = self.merge(a + b) == [a, b]
        if len(self.pairable) < CACHED:
            self.pairable[left << 20 | right] = known
        return known

    def tokens(self, text: str) -> list[int]:
        """Ids of a text without runs of white space, whose characters are all pieces but for a lone one."""
        last, known, pair = [0] * len(text), self.pairable.get, self.pair
        for end, (token, size) in self.automaton.iter(text):
            if not last[end]:
                left = last[end - size] if end >= size else 0
                if not left or (ok if (ok := known(left << 20 | token)) is not None else pair(left, token)):
                    last[end] = token
        out, i = [], len(text)
        while i > 0:
            token = last[i - 1]
            if token:
                out.append(token)
                i -= len(self.piece[token])
            else:  # a character in no piece: its bytes
                i -= 1
                out += [self.bytes[b] for b in reversed(text[i].encode("utf-8"))]
        return out[::-1]

    def ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            if s in self.rank:
                out.append(self.rank[s][1])
            else:
                out += [self.bytes[b] for b in s.encode("utf-8")]
        return out

    def part(self, text: str) -> bytes:
        """Packed ids of a stretch within which every two neighbours stand together in some piece."""
        known = self.parts.get(text)
        if known is None:
            ids = self.ids(self.merge_runs(text)) if SPACE * 2 in text else self.tokens(text)
            known = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.parts) < CACHED and len(text) < 64:
                self.parts[text] = known
        return known

    def merge_runs(self, text: str) -> list[str]:
        """As merge(), in n log n: a heap of pairs over linked symbols."""
        import heapq

        symbols, rank = list(text), self.rank
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def push(i):
            j = after[i]
            if j < len(symbols) and (s := symbols[i] + symbols[j]) in rank:
                heapq.heappush(heap, (rank[s][0], i, s))

        for i in range(len(symbols) - 1):
            push(i)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, ""
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s in symbols if s]

    def unit(self, text: str) -> bytes:
        """Packed ids of white space and the word behind it."""
        known = self.units.get(text)
        if known is None:
            at, out, pairs = 0, [], self.pairs
            for i in range(1, len(text)):
                if text[i - 1 : i + 1] not in pairs:
                    out.append(self.part(text[at:i]))
                    at = i
            out.append(self.part(text[at:]))
            known = b"".join(out)
            if len(self.units) < CACHED and len(text) < 64:
                self.units[text] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids with begin and end id, packed as little-endian unsigned 32-bit integers."""
        out = [self.bos.to_bytes(4, "little")]
        if text:
            text = text.replace(SPACE, " ")
            unit = self.unit
            if text[0] == " " or "  " in text or text[-1] == " ":
                import re

                out += [unit(u.replace(" ", SPACE)) for u in re.findall(r" *[^ ]+| +", " " + text)]
            else:
                units = self.units
                out += [units.get(u) or unit(u) for u in (SPACE + text.replace(" ", " " + SPACE)).split(" ")]
        out.append(self.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        import numpy as np

        return self.lib.decode(np.frombuffer(packed, "<u4").tolist())


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table for each Python worker; its bounded caches serve later tasks too."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, ids (array<int>), decoded.

    Null text counts as empty and gives the begin and end ids and an empty decoded text. Repeated rows stay.
    No shuffle: each row is encoded where it is read. model: its file (default: the public one of 32k).
    """
    schema, model = "doc_id long, ids array<int>, decoded string", model or tokenizer_file(MODEL)

    def run(batches):
        import numpy as np

        t = piece_table(model)
        made = ((d, np.frombuffer(p := t.encode(x or ""), "<u4").astype(np.int32), t.decode(p)) for d, x in rows(batches, "doc_id", "text"))
        yield from batched(made, arrow_schema(schema), 200)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(docs: DataFrame, model: str | None = None) -> DataFrame:
    """As encoded(), with digests instead of ids and text."""
    model = model or tokenizer_file(MODEL)

    def run(batches):
        t = piece_table(model)

        def records():
            for d, x in rows(batches, "doc_id", "text"):
                p = t.encode(x or "")
                yield d, len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(t.decode(p).encode()).hexdigest()

        yield from batched(records(), arrow_schema(DIGEST))

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
