from __future__ import annotations

import re
from collections import Counter

import pytest

from lemmaflow.llm import licenses

from .test_operators import none, odd  # noqa: F401


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_scan(texts, notices=licenses.NOTICES, phrases=licenses.PHRASES):
    df = Counter(w for t in texts for w in set(words(t)))
    probes = licenses.index(df, notices)
    out = []
    for t in texts:
        ws = words(t)
        base = sorted((i, label) for p, label in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        found = []
        for (label, body, keys), probe in zip(notices, probes):
            begins = Counter(i - q for w, q in probe for i, x in enumerate(ws) if x == w)
            for at, n in begins.items():
                start = max(at - licenses.SLACK, 0)
                around = f" {' '.join(ws[start : start + len(body.split()) + 2 * licenses.SLACK])} "
                if 2 * n >= len(probe) and all(f" {k} " in around for k in keys):
                    found.append((at, label, n / len(probe)))
        out.append((len(ws), [(label, i) for i, label in base], [(label, at, share) for at, label, share in sorted(found)]))
    return out


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation"""
TEXTS = [
    None, "", " \n", "Released under the MIT License.", "x UNDER-THE (mit) license under the mit license y", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
    "Licensed under CC BY-NC 4.0.", "ccby nc", "cc by ncx", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.",
    "/* " + MIT + " */", MIT.replace("obtaining", "who gets"), MIT.replace("free of charge", "for a fee"), "gnu public license " * 300, ("Licensed under the GNU General Public License version 2. " + "word " * 30) * 20,
    "Under the mit Lİcense under the K license", "Grüße under the mit license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "the license", "This is free and unencumbered software released into the public domain.", "free " + "and unencumbered " * 5 + "software",
]


def rows_of(df):
    return [(r.n_words, [(x.label, x["at"]) for x in r.base], [(x.label, x["at"], x.share) for x in r.found]) for r in df.orderBy("i").collect()]


def test_op11_brute_force(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = TEXTS + real + real[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = rows_of(licenses.scanned(docs))
    assert [(i, texts[i], g, w) for i, (g, w) in enumerate(zip(got, brute_scan(texts))) if g != w] == []
    labels = [{x[0] for x in g[2]} for g in got]
    assert labels[9] == {"gpl-3"} and labels[10] == set() and labels[11] == labels[12] == {"mit"} and labels[13] == set() and labels[5] == {"apache-2"}
    assert len(got[15][2]) == 20 and got[4][1] == [("mit", 1), ("mit", 5)]


def test_op11_odd_and_empty(spark, odd, none):  # noqa: F811
    docs = odd.selectExpr("doc_id", "text", "source as base", "lang as _words", "n_chars as n_words", "doc_id as _at")
    got = licenses.scanned(docs)
    assert set(got.columns) == {"doc_id", "text", "_words", "_at", "base", "found", "n_words"} and got.count() == odd.count()
    assert {r.n_words for r in got.filter("text is null").collect()} == {0}
    assert licenses.scanned(none).collect() == []


@pytest.mark.parametrize("text", ["a", "--a--b c", "\x00a\x1f", "A.B", "é--É"])
def test_op11_words(spark, text):
    got = licenses.words_of(spark.createDataFrame([(text,)], "text string")).first()
    assert got._words == words(text) and got._norm == f" {' '.join(words(text))} "
