from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lemmaflow.llm import align, resample
from lemmaflow.llm.common import tokenizer_file

from .test_operators import none, odd  # noqa: F401


def brute_weights(docs, target, percent=10, min_words=20):
    words = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    bucket = lambda w: zlib.crc32(w) % 10000
    s, t = Counter(bucket(w) for _, x in docs for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in words(x))
        out.append((d, len(words(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[3], math.inf if r[0] is None else r[0], r[1]) for r in out if r[1] >= min_words)
    return out, able[: percent * len(able) // 100]


def test_crc_matrices():
    words = [b"", b"a", b"bc", b"a", b"\xff" * 7, bytes(range(256)), b"x" * 5000, "ünï".encode()]
    assert resample.crcs(words).tolist() == [zlib.crc32(w) for w in words]
    assert resample.crcs([]).tolist() == []
    assert np.array_equal(resample.crc_matrix(np.zeros((3, 4), np.uint8)), np.full(3, zlib.crc32(b"\0" * 4), np.uint32))


def test_op12_brute_force(spark, odd, none):  # noqa: F811
    target = spark.createDataFrame([(1, "w1 w2 Ünïcode text"), (2, None), (3, "one two two")], "item_id long, text string")
    made = resample.weighed(odd, resample.gains(odd, target))
    got = resample.ranked(made, percent=50).drop("key", "n_words").collect()
    rows, drawn = brute_weights([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], percent=50)
    key = lambda r: tuple(math.inf if v is None else v for v in r)
    assert sorted(map(key, (r[:4] for r in got))) == sorted(map(key, rows))
    assert sorted((r.rank, -r.score) for r in got if r["rank"]) == [(i + 1, s) for i, (s, _, _) in enumerate(drawn)]
    assert resample.ranked(resample.weighed(none, resample.gains(none, target))).count() == 0
    assert resample.gains(odd, none) and resample.resampled(none, target).count() == 0


def test_op12_rows(spark, odd):  # noqa: F811
    """The drawn rows keep all columns, those named like the operator's own too."""
    target = odd.filter("doc_id = 9")
    docs = odd.selectExpr("doc_id", "text", "doc_id as rank", "source as key", "n_chars as _row")
    got = resample.resampled(docs, target, percent=40)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()
    pairs = resample.resampled(docs, target, percent=100, max_n=3, buckets=500)
    assert pairs.count() == len([1 for r in docs.collect() if len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r.text or "")) >= 20])


def test_op12_ties_and_parts(spark):
    """Ranks run on over the parts of the sort; equal scores go to the smaller doc_id."""
    rows = [(i, i % 7, 30, 0, i // 100, 30 if i % 10 else 3) for i in range(3000)]
    got = resample.ranked(spark.createDataFrame(rows, resample.WEIGHED).repartition(7), percent=30).collect()
    want = sorted(((-r[4], r[0]) for r in rows if r[5] >= 20))[: 30 * 2700 // 100]
    assert [(-r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want
    assert [r["rank"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == list(range(1, len(want) + 1))


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    to = align.byte_of()
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for x in texts:
        a = tok.encode(" " + x, add_special_tokens=False) if x else None
        ab = [bytes(to[c] for c in t) for t in a.tokens] if x else []
        b = sp.encode(x) if x else []
        bb = [piece(i) for i in b]
        if not x or not b"".join(ab) == b"".join(bb) == (" " + x).encode():
            docs.append(([], [], 0, [], ""))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(ab), ends(bb)
        links = [(a.ids[i], b[j]) for i in range(len(ab)) for j in range(len(bb)) if ea[i] - len(ab[i]) < eb[j] and eb[j] - len(bb[j]) < ea[i]]
        counts.update(links)
        cuts = sorted(set(ea) & set(eb))
        group = lambda ids, es, lo, hi: ",".join(str(i) for i, e in zip(ids, es) if lo < e <= hi)
        text = ";".join(f"{group(a.ids, ea, lo, hi)}|{group(b, eb, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        docs.append((a.ids, b, len(cuts), links, hashlib.sha256(text.encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), n, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for a, b, n, ls, sha in docs]


ODD_TEXTS = [
    "", " ", "  ", "\n", " a", "a ", "a  b   c", "a\n  b\n\n c\t d", "x y", "ﬁne ﬁ", "▁", "a▁b", "a ▁ b", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "中文字 中文　字", "😀 😀😀 👩‍👩‍👧 x", "é é ü", "\x00 \x01\x1c a", "don't I'll   'tis", "a​ b", "﻿a b", "a᠎ b", "１２３ ½ ²", "x" * 300, "ab " * 50, "\r\n x\r\n y",
    "ẞ ſ K Å", "हिन्दी भाषा", "한국어 텍스트", "عربى نص", "1234567 3.14 a_b-c", "a\x85 b   c", "\U0010ffff  z",
]


def test_op13_brute_force(spark, odd, none, sf_dir, monkeypatch):  # noqa: F811
    monkeypatch.setattr(align, "BLOCK", 3000)
    real = [r.text[:3000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(25).collect()]
    texts = [*ODD_TEXTS, None, *real, *(r.text and r.text[:2000] for r in odd.collect()), real[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align.aligned(docs).collect()}
    want = dict(enumerate(brute_alignment(texts)))
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert align.aligned(none).collect() == []


def test_op13_groups(spark, odd):  # noqa: F811
    docs = odd.selectExpr("doc_id", "text", "source as block", "lang as pairs").filter("doc_id in (1, 2, 5, 11, 12)")
    got, sums = align.groups(docs).collect(), {r.doc_id: r for r in align.aligned(docs).collect()}
    for d in (1, 2, 5, 11, 12):
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r["at"])
        text = ";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in mine)
        assert (hashlib.sha256(text.encode()).hexdigest() if mine else "") == sums[d].groups_sha256
        assert len(mine) == sums[d].n_groups and sum(len(r.a_ids) for r in mine) == sums[d].n_a


@pytest.mark.parametrize("text", ["a b", "word, word.\nnext line", "é 中 😀 a"])
def test_op13_spans(text):
    """On plain ASCII the libraries' spans are the ends already; else tokens in a character end by their bytes."""
    t = align.Aligner(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    a = t.a.encode(" " + text, add_special_tokens=False)
    at = [0] + [len((" " + text)[: i + 1].encode()) for i in range(len(text) + 1)]
    ends = align.refined(np.array([at[y] for _, y in a.offsets]), t.size_a[np.array(a.ids)])
    assert ends.tolist() == np.cumsum(t.size_a[np.array(a.ids)]).tolist() and ends[-1] == len(text.encode()) + 1
    assert not text.isascii() or ends.tolist() == [e for _, e in a.offsets]


def test_op13_cuts():
    assert align.Aligner.cut(" a b\nc\n\nd  e f ") == [" a", " b", "\nc\n\nd", "  e", " f "]
    assert align.Aligner.cut(" a b") == [" a", " b"] and align.Aligner.cut(" a\nb") == [" a", "\nb"]


def test_op13_block_without_collector(monkeypatch):
    """While a block is aligned, Python does not look for cycles; afterwards it does as before, after an error too."""
    import gc

    t, seen, of = align.aligner(tokenizer_file(align.BYTE_LEVEL), tokenizer_file(align.PIECES)), [], align.Aligner.of
    monkeypatch.setattr(align.Aligner, "of", lambda *a: seen.append(gc.isenabled()) or of(*a))
    assert gc.isenabled() and align.block_row(t, [(1, "naïve words"), (2, None)])[1] == [1, 2]
    with pytest.raises(TypeError):
        align.block_row(t, [(1, 5)])
    assert seen == [False] and gc.isenabled()


def test_op5_wide_ids_and_ties(spark, tmp_path):
    """Ids of four bytes are read back as such; documents of one doc_id have one order in the file and in the starts."""
    from lemmaflow.llm import tokenstore

    rows = [(7, f"text number {i} " * 40) for i in range(30)] + [(i, "short") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    path = f"file://{tmp_path}/store"
    tokenstore.write_store(docs, path)
    in_file = [(r.doc_id, r.root) for r in tokenstore.manifest(spark, path).select("shard", "doc_id", "root", "_metadata.file_path").sort("shard").collect()]
    by_start = [(r.doc_id, r.root) for r in tokenstore.starts(spark, path).orderBy("start").collect()]
    assert in_file == by_start
    ids = np.array([70_000, 3, 70_000], "<u4").tobytes()
    assert tokenstore.ids_of(ids, 3).tolist() == [70_000, 3, 70_000] and tokenstore.ids_of(b"", 0).tolist() == []
    with pytest.raises(ValueError):
        tokenstore.ids_of(ids[:-1], 3)


def test_op13_wide_rows_stay_few(spark, monkeypatch, tmp_path):
    """Blocks of several MB: readers and Python get a few of them at a time."""
    import pyarrow.parquet as pq

    made, paths = align.staged, []

    def staged(df, name, **options):
        out = made(df, name, **options)
        paths.append((name, out.inputFiles()))
        return out

    wide = "transform(sequence(0, 499999), i -> pmod(hash(i, id), 1000))"
    rows = spark.range(0, 60, 1, 1).selectExpr("concat('b', id) as block", *[f"array(id) as {c}" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], "array('x') as groups_sha256", "array(0, 500000) as doc_at", f"{wide} as segs", f"{wide} as times", "sequence(0, 1000) as seg_at", "sequence(0, 999) as links", "sequence(0L, 999L) as pairs", "array_repeat(1L, 1000) as n_pairs")
    monkeypatch.setattr(align, "staged", staged)
    monkeypatch.setattr(align, "blocks", lambda *a: rows)
    out = align.aligned(None)
    files = [f.removeprefix("file:") for name, fs in paths if name == "aligned-blocks" for f in fs]
    groups = [m.row_group(i).num_rows for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= 20
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString().replace("FlatMapCoGroupsInArrow", "")
    assert out.count() == 60
