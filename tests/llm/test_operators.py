from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lemmaflow.llm import fingerprint, linededup, mixing, ngramjoin, pieces, pii, quality, tokenstore, toxicity, warc
from lemmaflow.llm.common import tokenizer_file, work_dir
from lemmaflow.llm.queries import ORACLE_SQL, QUERIES

from .. import oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, prefix="w"):
    r = random.Random(seed)
    return [f"{prefix}{r.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties."""
    base = words(60, 1)
    near = base[:30] + ["changed"] + base[31:]
    long = " ".join(words(6000, 2))
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, " ".join(base), None, None),
        (3, " ".join(base), None, None),
        (4, None, "en", "a"),
        (5, "", "en", "a"),
        (6, " \n\t ", "en", "b"),
        (7, "one two", "en", "c"),
        (8, "One TWO", "en", "c"),
        (9, long, "en", "a"),
        (10, long + " end", "en", "a"),
        (None, " ".join(words(20, 5)), "en", "b"),
        (11, "Ünïcode ﬁne text 中文 😀 \x00 ▁x", "de", "b"),
        (12, "a\n\n\nb  c \n d\t\te ", "de", "b"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def near_copies(n, edits, seed):
    base, r, out = words(80, seed), random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        out.append(" ".join(w))
    return out


def test_op1_brute_force(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(odd).collect()), key=str)
    assert got == brute_components(rows)
    texts = near_copies(60, 2, 3) + near_copies(40, 3, 4)
    rows = list(enumerate(texts, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert ngramjoin.near_duplicates(none).count() == 0


def test_op1_null_ids(spark):
    """Rows without a doc_id link too; they give a component no name."""
    texts = near_copies(1, 0, 12) + near_copies(1, 1, 12)
    other = near_copies(1, 0, 13) + near_copies(1, 1, 13)
    rows = [(None, texts[0]), (5, texts[1]), (None, other[0]), (None, other[1]), (None, other[1])]
    got = sorted(((r.doc_id, r.component_id) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (None, None), (None, None)], key=str)


def test_op1_blocks(spark, monkeypatch):
    """Lists longer than a block are dealt to pairs of blocks."""
    assert ngramjoin.chosen_length(100, __import__("numpy").array([2.0] * 80), 20) >= 1
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    rows = list(enumerate(near_copies(50, 2, 9)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_op2_segments():
    import numpy as np

    r = random.Random(0)
    for _ in range(200):
        s = np.array([r.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(r.randrange(0, 25))], float)
        found = toxicity.maximal(s)

        def split(a, b):
            """Definition: the best segment, then the rest on both sides of it."""
            best = max(((s[i:j].sum(), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return split(a, i) + [round(best[0], 6)] + split(j, b)

        assert sorted(round(x, 6) for _, _, x in found) == sorted(split(0, len(s)))
        assert all(abs(s[a:b].sum() - x) < 1e-9 for a, b, x in found)


def test_op2_accuracy(spark, odd, none):
    r, rows, labels = random.Random(1), [], []
    for i in range(600):
        w, toxic = words(80, i), i % 4 == 0
        for _ in range(4 if toxic else 0):
            w[r.randrange(80)] = "vile" + r.choice(["a", "b", "c", "ness", "ly"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, lab)).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == dict(labels)[x.doc_id] for x in held) >= 0.95 * len(held)
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.predicted == 0 and 0 <= x.score <= 1 for x in toxicity.scored(odd, model).collect())
    assert toxicity.scored(none, model).count() == 0


def test_op3_surrogates(spark, none):
    text = "call +1 (743) 555-3824 or bo.19@mail5.example.com, 8.196.197.208, 4539578763621486; token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" Mrs. Maria Weber 123-45-6789"
    docs = spark.createDataFrame([(1, text), (2, text + " again"), (3, None), (4, ""), (5, "no data 12 here")], "doc_id long, text string").withColumn("kind", F.lit("x"))
    got = {r.doc_id: r for r in pii.pseudonymised(docs).collect()}
    assert got[2].text == got[1].text + " again" and got[3].text is None and got[4].text == "" and got[5].text == "no data 12 here"
    assert set(got[1].kinds) == {"phone", "email", "ip", "card", "secret", "name_f", "ssn"}
    for _, _, kind, value in pii.entities(text):
        assert value not in got[1].text
    new = {k.split("_")[0]: v for _, _, k, v in pii.entities(got[1].text)}
    assert pii.luhn(new["card"]) and new["card"][0] == "4" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["phone"]) and new["name"].split()[0] in pii.GIVEN["f"] and new["email"].endswith(".com")
    assert pii.pseudonymised(none).count() == 0


def test_op3_collisions(spark, monkeypatch):
    """With a tiny space of candidates, all surrogates still differ and are no entities."""
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt=0, key=b"": f"u{(len(value) * 7 + int(value[1:].split('@')[0]) + attempt * 13) % 97}@x.org")
    rows = [(i, f"u{i}@x.org") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in pii.pseudonymised(docs).collect()]
    monkeypatch.setattr(pii, "HELD", -1)
    assert sorted(r.text for r in pii.pseudonymised(docs).collect()) == sorted(got)
    assert len(set(got)) == 12 and not set(got) & {t for _, t in rows}


def test_op3_scripts():
    """Letters of any script and digits of any block are replaced by others of their kind."""
    import unicodedata

    for value in ("김민수", "さくら", "محمد", "דוד", "Łøżść", "Щйыъё", "ß"):
        new = pii.shaped(value, pii.Draw(b"k", value))
        assert len(new) == len(value) and sum(a != b for a, b in zip(new, value)) >= len(value) / 2
        assert [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in value]
        assert [unicodedata.name(c).split()[0] for c in new] == [unicodedata.name(c).split()[0] for c in value]
    card = "".join(chr(0x660 + int(c)) for c in "4539578763621486")
    for kind, value in (("card", card), ("phone", "+49 " + card[:8]), ("ip", "١٩٢.١٦٨.١.٢")):
        new = pii.surrogate(kind, value)
        assert new != value and [c.isdecimal() and not c.isascii() for c in new if c != "."][-3:] == [True] * 3
    assert pii.luhn([str(int(c)) for c in pii.surrogate("card", card)])
    long = pii.surrogate("card", "4539578763621486", pii.LONGER + 1)
    assert len(long) == 18 and pii.luhn(long)


def test_op3_coreference(spark):
    """Names end at lower-case words, come again without a title and keep their surname; forms of a card agree; tokens without end take linear time."""
    import time

    text = "Mrs. Weber is back. Mr. and Mrs. Smith saw Mrs. Maria Weber; Maria Weber left. Miss the bus. 4539 5787 6362 1486 or 4539578763621486, Bo@Mail.org, bo@mail.org"
    found = [(k, v) for _, _, k, v in pii.entities(text)]
    assert found[:4] == [("name_s", "Weber"), ("name_s", "Smith"), ("name_f", "Maria Weber"), ("name_f", "Maria Weber")] and len(found) == 8
    new = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert "Weber" not in new and "Miss the bus" in new and "Mr. and Mrs. " in new
    first = re.match(r"Mrs\. (\S+) is back\. .* saw Mrs\. (\S+) (\S+); (\S+) (\S+) left", new)
    assert first[1] == first[3] == first[5] and first[2] == first[4]
    a, b = re.search(r"(\d{4} \d{4} \d{4} \d{4}) or (\d{16})", new).groups()
    assert a.replace(" ", "") == b
    began = time.perf_counter()
    for x in ("a", "a.", "_-"):
        assert pii.entities("1 " + x * 60_000) == []
    assert time.perf_counter() - began < 5


def test_op3_full_formats(spark, monkeypatch):
    """More initials than letters left, a name without other letters: all get surrogates, all differ."""
    monkeypatch.setattr(pii, "LONGER", 4)
    names = [f"Mr. {c}" for c in "ABCDEFGHIJKLMNOPQRSTUVW"] + ["Mr. 김민수", "Frau ²"]
    docs = spark.createDataFrame([(i, x + ", 12") for i, x in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs).collect()}
    new = [v for r in got.values() for _, _, _, v in pii.entities(r.text)]
    old = {v for d in docs.collect() for _, _, _, v in pii.entities(d.text)}
    assert len(new) == len(set(new)) == len(old) == len(names) and not set(new) & old
    full = [pii.surrogate("ip", "192.168.1.2", a) for a in (3, 4, 8, 9)]
    assert [x.startswith("192.168.") for x in full] == [True, False, False, False] and [x.startswith("10.") for x in full[1:3]] == [True, True]


def test_op4_apportionment(spark):
    r = random.Random(2)
    rows = [(g, p, float(r.randrange(0, 1000)), seats) for g, seats in ((1, 37), (2, 400), (3, 0)) for p in range(9)]
    df = spark.createDataFrame(rows, "g int, p int, votes double, seats long")
    got = {(x.g, x.p): x.quota for x in mixing.sainte_lague(df, ["g"], "votes", "seats", ["p"]).collect()}
    for g, seats in ((1, 37), (2, 400), (3, 0)):
        own = {p: v for gg, p, v, _ in rows if gg == g}
        have = dict.fromkeys(own, 0)
        for _ in range(seats):
            best = max(own, key=lambda p: (own[p] / (2 * have[p] + 1), -p))
            have[best] += 1
        assert {p: got[g, p] for p in own} == have


def test_op4_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= x.taken <= 2 * x.size for x in got)
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    assert set(mixing.mixed(odd.withColumn("taken", F.lit(9))).columns) == {*odd.columns, "taken"}


def test_op4_copies(spark):
    """The copies of each source have as many words as the mix takes, by half its longest document; null and hot sources too."""
    r = random.Random(6)
    sources = [("a", 40), ("b", 1500), ("c", 80), ("d", 60), (None, 90)]
    rows = [(10_000 * k + i, " ".join(["w"] * r.choice([0, 5, 60, 90, 400])), s) for k, (s, n) in enumerate(sources) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, longest, copies = {}, {}, {}
    shares = {}
    for x in mixing.placed_mix(docs).collect():
        taken[x.source] = taken.get(x.source, 0) + x.taken
        longest.setdefault(x.source, {})[x.shard] = 400
        shares[x.doc_id] = x.taken / x.size if x.size else 0
    for x in mixing.mixed(docs).collect():
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    for k, (s, n) in enumerate(sources):
        got = sum(copies.get(d, 0) * len(t.split()) for d, t, source in rows if source == s)
        assert abs(got - taken[s]) <= sum(longest[s].values()) / 2
    assert all(int(x) <= copies.get(d, 0) <= int(x) + (x > int(x)) for d, x in shares.items())
    assert sum(copies.get(d, 0) for d, t, s in rows if s == "b" and len(t.split()) == 400) > 50


def test_op5_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    path = work_dir(spark, "test-store")
    tokenstore.write_store(odd, path)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = sorted(((d, [*tok.encode(t, add_special_tokens=False).ids, 0]) for d, t in texts), key=lambda x: (x[0] is not None, x[0] or 0))
    got = tokenstore.read_ids(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((d or -1, i) for d, i in want)
    sums = {r.start: r for r in tokenstore.read_checksums(spark, path).collect()}
    at = 0
    for r in got:
        assert r.start == at and sums[at].doc_id == r.doc_id and sums[at].n_tokens == len(r.ids)
        assert sums[at].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        at += len(r.ids)
    assert [d for d, _ in want] == [r.doc_id for r in got]
    assert tokenstore.chunks(spark, path).count() == tokenstore.chunks(spark, path).select("key").distinct().count()
    path = work_dir(spark, "test-store")
    tokenstore.write_store(none, path)
    assert tokenstore.read_checksums(spark, path).count() == 0


def test_op5_added_tokens():
    """Ids of texts that hold the vocabulary's added token are the library's with its default settings."""
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), tokenstore.ByteLevelEncoder(path)
    r = random.Random(5)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", "<|ENDOFTEXT|>", "<<|endoftext|>|>"]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "word", "é中", "'s", "12", "."]) for _ in range(r.randrange(20))) for _ in range(2000)]
    for x in texts:
        assert np.frombuffer(encoder(x), f"<u{encoder.width}").tolist() == tok.encode(x, add_special_tokens=False).ids


def test_op5_words_together(monkeypatch):
    """Texts encoded together have the library's ids, whatever their white space; each different word is looked up once for all."""
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), tokenstore.ByteLevelEncoder(path)
    r = random.Random(6)
    bits = ["<|endoftext|>", " ", " ", " ", "\n", "\n", "word", "été", "中文", "'s", "12", ".", "\t", "\r", "\x0b", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\0"]
    texts = ["", " ", "\n", "a", "\na", "a\n", " a", "a ", "a\nb", "a \nb", "a\n b", "a\n\nb", "a  b", None]
    texts += ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(3000)] + [" ".join(words(9, i)) + "\n" + " ".join(words(5, i)) for i in range(50)]
    monkeypatch.setattr(tokenstore, "TOGETHER", 2000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts) + 3)), "text": ["x", "y", "z", *texts]}).slice(3)
    got = list(tokenstore._encoded([batch, batch.slice(0, 0)], encoder))
    assert [d for d, _ in got] == list(range(3, len(texts) + 3))
    for (_, ids), x in zip(got, texts, strict=True):
        assert np.frombuffer(ids, f"<u{encoder.width}").tolist() == tok.encode(x or "", add_special_tokens=False).ids, repr(x)
    plain = [x for x in texts if x is not None and encoder.plain(x) and "<|endoftext|>" not in x]
    monkeypatch.setattr(encoder, "between", lambda text: pytest.fail(f"{text!r} was encoded by itself"))
    assert len(plain) > 200 and len(encoder.many(pa.array(plain))) == len(plain)


def test_op5_chunks():
    import numpy as np

    ids = np.random.default_rng(0).integers(0, 50000, 20000).astype(np.uint16)
    ends = tokenstore.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MAX_CHUNK and sizes[:-1].min() >= tokenstore.MIN_CHUNK
    shifted = tokenstore.cuts(np.r_[ids[:5], ids])
    assert len({e - 5 for e in shifted} & set(ends)) > 0.8 * len(ends)
    assert tokenstore.merkle([b"a", b"b", b"c"]) != tokenstore.merkle([b"a", b"c", b"b"])


def test_op7_equals_library(odd, none):
    t = pieces.PieceTable(tokenizer_file(pieces.MODEL))
    r = random.Random(3)
    texts = ["".join(r.choice(list("abTheing  ,.\n\t▁é中😀12\x00'")) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, " " * 100 + "x", "▁▁▁"] + [x.text or "" for x in odd.collect()]
    import numpy as np

    for x in texts:
        want = t.lib.encode(x, add_bos=True, add_eos=True)
        packed = t.encode(x)
        assert np.frombuffer(packed, "<u4").tolist() == want and t.decode(packed) == t.lib.decode(want)
    got = pieces.encoded(odd.select("doc_id", "text")).collect()
    assert len(got) == odd.count() and all(list(g.ids[:1]) == [1] for g in got)
    assert pieces.digested(none).count() == 0


def test_op8_brute_force(spark, odd, none, monkeypatch):
    def canon(t):
        return fingerprint.canonical(t)

    rows = sorted(((r.doc_id, r.text or "") for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()), reverse=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs.write.parquet(path := work_dir(spark, "test-docs") + "/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op8_fingerprint(spark, path.rpartition("/")[0]).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        g = got[d]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert g.near_edited == float(canon(t) == canon(e)) and g.near_next == float(canon(t) == canon(after))
    f = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(odd).collect()}
    assert f[1] == f[3] and f[4] == f[5] == f[6] and f[7] == f[8] and f[1] != f[2]
    assert fingerprint.fingerprints(none).count() == 0


def test_op8_clashes_and_ties(spark, none):
    """Columns of the operator's own names stay, null and repeated ids keep their rows, an empty table has none."""
    docs = spark.createDataFrame([(1, "a b", "x", 5, 6), (1, "A  B", "y", 7, 8), (None, None, "z", 9, 0), (None, "", "z", 9, 0)], "doc_id long, text string, fingerprint string, _check int, _both int")
    out = fingerprint.fingerprints(docs)
    assert out.columns == ["doc_id", "text", "_check", "_both", "fingerprint"]
    got = {(r.doc_id, r.text): (r._check, r._both, r.fingerprint) for r in out.collect()}
    assert got[1, "a b"][:2] == (5, 6) and got[1, "A  B"][:2] == (7, 8) and got[1, "a b"][2] == got[1, "A  B"][2] != got[None, ""][2] == got[None, None][2]
    for table, n in ((docs.select("doc_id", "text"), 4), (none, 0)):
        table.write.parquet(path := work_dir(spark, "test-docs") + "/documents.parquet")
        rows = fingerprint.op8_fingerprint(spark, path.rpartition("/")[0]).collect()
        assert len(rows) == n and all(r.near_next in (0.0, 1.0) for r in rows)


def test_op8_collisions(spark, monkeypatch):
    """Contents of one digest are told apart by their bytes."""
    monkeypatch.setattr(fingerprint, "digests", lambda c: ("0" * 32, zlib.crc32(c)))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    found = fingerprint.collisions(docs).collect()
    assert sorted(r["class"] for r in found) == [1, 2]


def test_op9_lines(spark, odd, none):
    base = words(12, 7)
    line, other = " ".join(base), " ".join(words(12, 8))
    near = " ".join([*base[:-1], base[-1] + "s"])
    rows = [(2, f"{line}\nshort\n{other}"), (1, f"{near}\nshort"), (3, line.upper() + "!"), (4, None), (5, ""), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1].text == f"{near}\nshort" and got[3].text == "" and got[4].text is None and got[5].text == ""
    assert got[2].text == f"short\n{other}"
    assert got[None].text == "" and got[None].n_dropped == 1
    assert linededup.dedup_lines(odd).count() == odd.count() and linededup.dedup_lines(none).count() == 0


def test_op9_recall(spark, sf_dir):
    """Of lines with one letter or one word changed that keep the edit similarity, 0.9 and more are found; all that is found is similar."""
    r, made = random.Random(3), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    lines = sorted({n for x in docs.collect() for n in map(normal_line, (x.text or "").split("\n")) if len(n.split()) >= linededup.MIN_WORDS and len(n) < linededup.LONG})
    for i, line in enumerate(r.sample(lines, 300)):
        w = line.split()
        k = r.randrange(len(w))
        if i % 2:
            w[k] = "".join(r.choice("abcdefghij") for _ in w[k])
        else:
            w[k] = w[k][:-1] + "q"
        near = " ".join(w)
        if near != line and distance_at_most(line, near, int(0.1 * max(len(line), len(near)))):
            made.append((2 * i, line, near))
    rows = [(d, a) for d, a, _ in made] + [(d + 1, b) for d, _, b in made]
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[d + 1].n_dropped for d, _, _ in made)
    assert len(made) > 200 and found >= 0.9 * len(made)
    earlier = []
    for d, text in sorted(rows):
        if got[d].n_dropped:
            assert any(distance_at_most(text, e, int(0.1 * max(len(text), len(e)))) for e in earlier)
        earlier.append(text)


def test_op9_verification(spark):
    """Pairs that share a block are kept just if the plain edit distance allows it; long lines are compared by words."""
    r, pairs, texts = random.Random(5), [], []
    for i in range(120):
        a = words(r.choice([6, 15, 60]), i)
        b = list(a)
        for _ in range(r.randrange(0, len(b) // 2)):
            b[r.randrange(len(b))] = f"w{r.randrange(10**6)}"
        texts += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        pairs.append((2 * i, 2 * i + 1))
    long = words(500, 77)
    texts += [(900, " ".join(long)), (901, " ".join(long[:460] + words(40, 78))), (902, " ".join(long[:400] + words(100, 79)))]
    pairs += [(900, 901), (900, 902)]
    t = spark.createDataFrame(texts, "key long, norm string").withColumn("words", F.expr("array_distinct(transform(split(norm, ' '), w -> xxhash64(w)))"))
    got = {(x.a, x.b) for x in linededup.similar(spark.createDataFrame(pairs, "a long, b long"), t).collect()}
    by = dict(texts)
    want = {(a, b) for a, b in pairs if a < 900 and distance_at_most(by[a], by[b], int(0.1 * max(len(by[a]), len(by[b]))))}
    assert got == want | {(900, 901)}


def test_op9_blocks(spark):
    """A changed word touches two blocks at most."""
    r, rows = random.Random(8), []
    for i in range(60):
        w = words(r.choice([12, 30, 200]), i)
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(len(w))] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame([(d, x, 0, 0, d) for d, x in rows], "doc_id long, norm string, text_hash long, pos int, key long")
    got = {x.doc_id: set(x.blocks) for x in linededup.blocks_of(docs).collect()}
    assert all(len(got[2 * i] - got[2 * i + 1]) <= 2 and len(got[2 * i + 1] - got[2 * i]) <= 2 for i in range(60))
    assert all(got[2 * i] & got[2 * i + 1] for i in range(60) if len(rows[2 * i][1].split()) > 100)


def test_op9_crowded_bucket(spark):
    """Lines of a bucket of any size meet: 100 near pairs that have one block in common, the same for all, are linked each."""
    texts = []
    for i in range(100):
        w = words(20 + i % 7, 5000 + i)
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], w[-1] + "q"]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    thin = linededup.lines_of(docs).select("doc_id", "text_hash", "pos", "key", F.length("norm").alias("size"), F.expr("array(7L)").alias("blocks"))
    assert thin.count() == 200 > 2 * linededup.CROWDED
    doc = {r.key: r.doc_id for r in thin.collect()}
    groups = {}
    for r in linededup.groups(docs, thin).collect():
        groups.setdefault(r.root, set()).add(doc[r.node])
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(100)]


def test_op9_pairs_of_a_crowded_bucket(spark, monkeypatch):
    """Lines of a crowded bucket that have few words in common are no pairs: their number grows with the lines, not with its square."""
    docs = spark.createDataFrame([(i, " ".join(["shared", "words", *words(12, 9000 + i)])) for i in range(300)], "doc_id long, text string")
    thin = linededup.lines_of(docs).select("doc_id", "text_hash", "pos", "key", F.length("norm").alias("size"), F.expr("array(7L)").alias("blocks"))
    made, similar = [], linededup.similar
    monkeypatch.setattr(linededup, "similar", lambda pairs, texts: made.append(pairs.count()) or similar(pairs, texts))
    assert linededup.groups(docs, thin).count() == 0
    assert sum(made) < 10 * 300


def test_op9_pairs_by_words(spark):
    """In buckets of any size, all pairs that have COMMON of their words in common and lengths that allow the similarity are made, but for groups known."""
    r, lines = random.Random(12), []
    families = [[f"w{r.randrange(60):03d}" for _ in range(10)] for _ in range(12)]
    for i in range(150):
        own = r.sample(families[i % 12], r.randrange(3, 9))
        lines.append((i, i % 90, own + [f"r{r.randrange(200):03d}" for _ in range(10 - len(own) + r.randrange(2))]))
    hashed = spark.createDataFrame(lines, "key long, root long, words array<string>").withColumn("words", F.expr("array_distinct(transform(words, w -> xxhash64(w)))"))
    mixed = hashed.select(F.expr("if(key < 10, 1L, 2L)").alias("v"), "key", F.expr("5 * size(words)").alias("size"), "root").withColumn("n", F.expr("if(key < 10, 10L, 140L)"))
    got = {(x.a, x.b) for x in linededup.crossed(mixed, hashed.select("key", "words")).collect()}
    sets = {x.key: (set(x.words), x.root, x.key < 10) for x in hashed.collect()}
    close = lambda x, y: min(len(x), len(y)) >= linededup.SIMILAR * max(len(x), len(y)) and len(x & y) >= linededup.COMMON * max(len(x), len(y))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and sets[a][2] == sets[b][2] and close(sets[a][0], sets[b][0])}
    assert len(want) > 20 and want <= got


def test_op9_disk(spark, monkeypatch):
    """What is staged on the way is removed, all but the dropped lines; lines of a large bucket are copied a few times, whatever its size."""
    monkeypatch.setattr(linededup, "CROWDED", 1)
    made, once = {}, linededup.once
    monkeypatch.setattr(linededup, "once", lambda df, *columns: (made.update({columns[0][0]: df.count()}) if columns[0][0][-1] in "12" else None, once(df, *columns))[1])
    passage, lines = words(40, 31), []
    for i in range(60):
        own = words(16, 7000 + (i // 2 if i < 8 else 1000 + i))
        lines.append((i, " ".join([*own[:5], *passage, *own[5:]]) + "q" * (i % 2)))
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    folder = work_dir(spark, "x").removeprefix("file://").rpartition("/")[0]
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    thin = linededup.staged(linededup.lines_of(docs).select("doc_id", "text_hash", "pos", "key", F.length("norm").alias("size"), F.expr("array(7L)").alias("blocks")), "line-occurrences")
    monkeypatch.setattr(linededup, "blocks_of", lambda lines: thin)
    got = linededup.drops(docs)
    assert {r.doc_id for r in got.collect()} == {1, 3, 5, 7}
    assert made["words1"] <= 3 * len(lines) and len(lines) < made["words2"] <= linededup.PARTS * len(lines)
    left = sorted(name.rpartition("-")[0] for name in set(os.listdir(folder)) - held)
    assert left == ["line-drops", "line-occurrences"], left  # the second is this test's own


def test_op9_lines_of_one_passage(spark, monkeypatch):
    """Lines of one passage that are too different are compared, in parts, but no table holds their pairs; the near ones are linked."""
    passage, lines = words(40, 31), []
    monkeypatch.setattr(linededup, "CROWDED", 16)
    for i in range(100):
        own = words(16, 7000 + (i // 2 if i % 50 < 2 else 1000 + i))
        lines.append((i, " ".join([*own[:5], *passage, *own[5:]]) + "q" * (i % 2)))
    near = lambda x, y: distance_at_most(x, y, int(0.1 * max(len(x), len(y))))
    assert all(near(lines[k][1], lines[k + 1][1]) for k in (0, 50)) and not any(near(lines[k][1], lines[k + 7][1]) for k in range(0, 90, 10))
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    thin = linededup.lines_of(docs).select("doc_id", "text_hash", "pos", "key", F.length("norm").alias("size"), F.expr("array(7L, 9L)").alias("blocks"))
    made, staged = {}, linededup.staged

    def counted(df, name, **options):
        out = staged(df, name, **options)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(linededup, "staged", counted)
    key = {r.key: r.doc_id for r in thin.select("key", "doc_id").collect()}
    got = {}
    for r in linededup.groups(docs, thin).collect():
        got.setdefault(r.root, set()).add(key[r.node])
    assert sorted(map(sorted, got.values())) == [[0, 1], [50, 51]]
    assert max(made.values()) <= 14 * len(lines), made


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = list(zip(w, w[1:], w[2:]))
    at = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)


def test_op6_brute_force(spark, odd, none):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a ", "b ", "a b c ", "# ", "\n", "x\n", " ", "\t", "é "]) for _ in range(r.randrange(80)))) for i in range(60)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for x in quality.measured(docs).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_quality(dict(rows)[x.doc_id])
    clash = odd.withColumns({"words": F.lit(1), "reason": F.lit("x"), "_row": F.lit(2)})
    kept = quality.quality_filter(clash)
    assert kept.columns == clash.columns and {x.doc_id for x in kept.collect()} >= {1, 2, 3, 9, 10}
    assert quality.quality_filter(none).count() == 0
    # The inputs of later rules are not computed for documents that an earlier one rejects.
    some = docs.filter("doc_id < 98").select("doc_id", "text")
    fails = quality.Rule("fails", "raise_error('computed') is null")
    assert {x.reason for x in quality.worded(some).select(quality.reason([quality.Rule("all", "n_words >= 0"), fails]).alias("reason")).collect()} == {"all"}
    with pytest.raises(Exception, match="computed"):
        quality.worded(some).select(quality.reason([fails]).alias("reason")).collect()
    assert {x.name for x, _, _ in quality.ordered(odd)} == {x.name for x in quality.RULES}


def test_op10_round_trip(spark, monkeypatch):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (5, "http://c é\nq", ""), (4, "http://d", "ünï" * 50), (1, "http://b", "<p>x</p>"), (None, "http://e", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    path = work_dir(spark, "test-warc")
    warc.write_archives(pages, path)
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect()), key=str)
    assert got == sorted([(3, "revisit", 1, 8), (1, "response", None, 8), (1, "response", None, 8), (2, "response", None, 0), (5, "revisit", 2, 0), (4, "response", None, 250), (-1, "revisit", 1, 8)], key=str)
    path = work_dir(spark, "test-warc")
    warc.write_archives(pages, path, min_revisit_bytes=9)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}
    path = work_dir(spark, "test-warc")
    warc.write_archives(pages, path, archive_bytes=300)
    assert warc.read_archives(spark, path).count() == len(rows)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("length").count() >= 3
    path = work_dir(spark, "test-warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_op10_reader():
    a, b = warc.member(1, "http://a", b"xyz" * 1000, None, False), warc.member(2, None, b"", 1, True)
    data = a + b
    for size in (1, 7, 100, 10**6):
        got = list(warc.read_records(data[i : i + size] for i in range(0, len(data), size)))
        assert [h["warc-type"] for h, _ in got] == ["response", "revisit"] and got[0][1] == b"xyz" * 1000
    with pytest.raises(ValueError):
        list(warc.read_records([a[:-10]]))
    text = zlib.decompress(a, 31)
    for bad in (text.replace(b"xyz", b"xyy", 1), text[:-4], text.replace(b"Content-Length: 3000", b"Content-Length: 2999")):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    oracle.same(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLE_SQL[name])


def distance_at_most(a, b, most):
    """Is the edit distance of a and b at most that? The plain table, in a band."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (a[i - 1] != b[j - 1]))
        row = new
    return row.get(len(b), most + 1) <= most


def normal_line(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def test_pipeline_brute_force(spark, sf_dir, tmp_path):
    """Each stage against a plain version of it, on the stage's own input; the chain of them is run()."""
    import corpus_pipeline as c

    assert [name for name, _ in c.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "SentencePiece"]
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, tables[-1], sf_dir)
        assert k == 4 or out.columns == list(c.COLUMNS)
        out.coalesce(1).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[tuple(r) for r in t.collect()] for t in tables]

    def keeps(t):
        n, chars, symbols, dup, repeat = brute_quality(t)
        lines = sum(bool(x.split()) for x in t.split("\n"))
        upper, letters = sum(x.isupper() for x in t), sum(x.isalpha() for x in t)
        lettered = sum(any(x.isalpha() for x in w) for w in t.split())
        return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or chars < 3 * n or chars > 10 * n or 2 * dup > lines or 2 * sum(x in "!?" for x in t) > n or 2 * upper > letters or 10 * lettered < 7 * n)

    assert sorted(r for r in rows[0] if keeps(r[1] or "")) == sorted(rows[1])

    # Line dedup: all exact repeats are dropped, and only lines that are near an earlier one.
    after, earlier = {r[0]: r[1] for r in rows[2]}, []
    for d, text, *_ in sorted(rows[1]):
        left = (after[d] if d in after else "").split("\n")
        for line in text.split("\n"):
            norm = normal_line(line)
            kept = bool(left) and left[0] == line
            if kept:
                left.pop(0)
            if len(norm.split()) >= linededup.MIN_WORDS:
                if norm in earlier:
                    assert not kept
                elif not kept:
                    assert any(distance_at_most(norm, e, int(0.1 * max(len(norm), len(e)))) for e in earlier)
                earlier.append(norm)
            else:
                assert kept or d not in after
        assert not left or left == [""]

    groups = {d: g for d, _, g in brute_components([r[:2] for r in rows[2]])}
    assert sorted(r for r in rows[2] if groups[r[0]] == r[0]) == sorted(rows[3])

    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    times = {d: round(t / s) if s else 0 for d, s, _, _, t in con.sql(ORACLE_SQL["op4_mixing"]).fetchall()}
    got = [r[0] for r in rows[4]]
    assert all(abs(got.count(d) - n) <= (1 if n else 0) for d, n in times.items()) and set(got) <= set(times)

    t = pieces.PieceTable(tokenizer_file(pieces.MODEL))
    want = []
    for d, text, *_ in rows[4]:
        ids = t.lib.encode(text, add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.lib.decode(ids).encode()).hexdigest()))
    assert sorted(want) == sorted(rows[5])
    assert sorted(tuple(r) for r in c.run(spark, sf_dir).collect()) == sorted(want)


def test_pipeline_odd_and_empty(spark, odd, none, tmp_path):
    """Null ids, sources and texts, repeated rows, very long texts and an empty table pass through all stages."""
    import corpus_pipeline as c

    long = " ".join(f"word{i % 997} and {i}" for i in range(20_000))
    fine = " ".join(f"plain{i}" for i in range(60))
    extra = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, fine, None, None, None), (2, fine, None, None, None), (None, fine + " more", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs in (("odd", odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).unionByName(extra)), ("none", extra.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = c.run(spark, f"{tmp_path}/{name}").collect()
        assert all(len(r.ids_sha256) == 64 and r.n_tokens > 2 for r in got)
        assert 1 in {r.doc_id for r in got} if name == "odd" else not got
