"""License scans by a positional index of rare words, in Spark expressions only.

The vocabulary of the licence notices below is counted over all documents; each notice puts its PROBES words that the
fewest documents hold into the index, with their positions. A file's words that stand in the index are its licence words
of highest IDF; each posting of such a word says where the notice would begin in the file. A notice whose probes
agree on one beginning is a candidate, and counts if all of its key phrases stand around that place.

Besides, exact phrases (PHRASES) are listed wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, notice, key phrases): wordings of public licence notices, in words as words_of() makes them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "associated documentation files")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted", "appear in all copies")),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2", "except in compliance with the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("under the terms of the gnu general public license", "either version 2 of the license")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("under the terms of the gnu general public license", "either version 3 of the license")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", ("subject to the terms of the mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("the accompanying materials", "eclipse public license")),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license version 1",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)
#: Words of a notice in the index; of these, as many as must agree on a place (in halves, rounded up).
PROBES = 6
#: Words before and behind a notice's place in which its key phrases may stand.
SLACK = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of separators other than a lone blank between words, which would be replaced by itself.
SEPARATORS = r"[\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F][\x00-\x2F\x3A-\x60\x7B-\x7F]*| [\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sql_array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def words_of(docs: DataFrame) -> DataFrame:
    """docs with _norm (the words, a blank around each) and _words. Null text has no words.

    Only A-Z become lower case: lower() does the same to ASCII texts, faster.
    """
    lower = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    norm = F.trim(F.regexp_replace(F.coalesce(lower, F.lit("")), SEPARATORS, " "))
    # A generator's output is computed once, however often it is used below.
    d = docs.withColumn("_norm", norm).select(*docs.columns, F.explode(F.array("_norm")).alias("_norm"))
    d = d.withColumn("_made", F.when(F.col("_norm") == "", F.array().cast("array<string>")).otherwise(F.split("_norm", " ")))
    return d.select(*docs.columns, F.concat(F.lit(" "), "_norm", F.lit(" ")).alias("_norm"), F.explode(F.array("_made")).alias("_words"))


def vocabulary(notices=NOTICES) -> list[str]:
    return sorted({w for _, text, _ in notices for w in text.split()})


def document_frequencies(docs: DataFrame, notices=NOTICES) -> dict[str, int]:
    """How many documents hold each word of the notices; as many rows come to the driver as the notices have words."""
    held = words_of(docs.select("text")).select(F.explode(F.array_distinct(F.filter("_words", lambda w: w.isin(vocabulary(notices))))).alias("w"))
    return dict(map(tuple, held.groupBy("w").count().collect()))


def index(frequencies: dict[str, int], notices=NOTICES, probes: int = PROBES) -> list[list[tuple[str, int]]]:
    """For each notice, (word, position) of its rarest words, ties by the word; a word's first position."""
    out = []
    for _, text, _ in notices:
        words = text.split()
        rare = sorted(set(words), key=lambda w: (frequencies.get(w, 0), w))[:probes]
        out.append([(w, words.index(w)) for w in rare])
    return out


def scanned(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """docs with n_words, base (array of (label, at): exact phrases and the word they begin at, from 0), found (array of
    (label, at, share): notices, where they begin, and the share of their probes that agree on that), in order of place.

    These replace columns of their names. Null, empty and wordless texts have none; repeated rows are scanned alike; an
    empty table gives an empty result. A notice that begins before the text has a negative place. Works in a row, so
    the time for a text grows with its length and nothing is shuffled but the counts of the notices' words.
    """
    probes = index(document_frequencies(docs, notices), notices)
    postings: dict[str, list[str]] = {}
    for t, words in enumerate(probes):
        for w, q in words:
            postings.setdefault(w, []).append(f"shiftleft({t}L, 40) - {q}")
    keys = sorted(postings)
    lookup = f"map_from_arrays({sql_array(keys)}, array({', '.join('array(' + ', '.join(postings[k]) + ')' for k in keys)}))"
    need = f"array({', '.join(str((len(p) + 1) // 2) for p in probes)})"
    size = f"array({', '.join(str(len(p)) for p in probes)})"

    own = [c for c in docs.columns if c not in ("n_words", "base", "found")]
    d = docs.select(F.struct(*own).alias("_row"), "text")
    d = words_of(d).drop("text")
    base = [
        f"if(contains(_norm, ' {p} '), transform(filter(sequence(0, size(_words) - {len(p.split())}), i -> slice(_words, i + 1, {len(p.split())}) = {sql_array(p.split())}), i -> struct('{label}' as label, cast(i as bigint) as at)), array())"
        for p, label in phrases.items()
    ]
    d = d.withColumn("_base", F.expr(f"array_sort(concat({', '.join(base)}), (x, y) -> if(x.at < y.at, -1, if(x.at > y.at, 1, 0)))"))
    # Places (from 0) of words in the index, then where each posting would have the notice begin: notice << 40 + place.
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(keys), i)), lambda i: i.isNotNull())
    d = d.withColumn("_at", at).withColumn("_begins", F.expr(f"sort_array(flatten(transform(_at, i -> transform({lookup}[_words[i]], p -> p + i))))"))
    # In sorted order a notice's equal beginnings stand together; b + 2^39 keeps negative places with their notice.
    notice = "cast(shiftright(b + 549755813888L, 40) as int)"
    d = d.withColumn("_met", F.expr(f"transform(filter(transform(_begins, (b, j) -> struct(b, j, {notice} as t)), x -> (x.j = 0 or get(_begins, x.j - 1) <> x.b) and get(_begins, x.j + get({need}, x.t) - 1) = x.b), x -> struct(x.t, x.b - shiftleft(cast(x.t as bigint), 40) as at, size(filter(sequence(0, get({size}, x.t) - 1), k -> get(_begins, x.j + k) = x.b)) as votes))"))
    lengths = f"array({', '.join(str(len(text.split())) for _, text, _ in notices)})"
    phrases_of = f"array({', '.join(sql_array(f' {k} ' for k in ks) for _, _, ks in notices)})"
    around = f"concat(' ', array_join(slice(_words, cast(greatest(x.at - {SLACK}, 0) as int) + 1, get({lengths}, x.t) + {2 * SLACK}), ' '), ' ')"
    labels = sql_array(label for label, _, _ in notices)
    verified = f"filter(_met, x -> forall(get({phrases_of}, x.t), k -> contains({around}, k)))"
    d = d.withColumn("_found", F.expr(f"array_sort(transform({verified}, x -> struct(x.at as at, get({labels}, x.t) as label, x.votes / get({size}, x.t) as share)))"))
    return d.select("_row.*", F.size("_words").cast("long").alias("n_words"), F.col("_base").alias("base"), F.expr("transform(_found, x -> struct(x.label, x.at, x.share))").alias("found"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's score is 1 with a base phrase, else the best share of a notice found, else 0."""
    d = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: f"array_join(array_sort(array_distinct({labels})), ',')"
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"),
        F.expr(joined("base.label")).alias("base_labels"),
        F.expr(joined("concat(base.label, found.label)")).alias("labels"),
        F.expr("if(size(base) > 0, 1D, coalesce(array_max(found.share), 0D))").alias("score"),
    )


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, '{UPPER}', '{LOWER}')), []) AS words FROM documents
), w AS (
  SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM d
), notice(t, label, body, keys) AS (VALUES {', '.join(f"({t}, '{label}', string_split('{text}', ' '), {list(keys)})" for t, (label, text, keys) in enumerate(NOTICES))}
), phrase(label, body) AS (VALUES {', '.join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())}
), base AS (
  SELECT d.rid, label, w.i FROM w JOIN phrase ON w.w = body[1] JOIN d ON d.rid = w.rid AND words[w.i + 1 : w.i + len(body)] = body
), b AS (
  SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY rid
), place AS (
  SELECT t, w, min(q) AS q FROM (SELECT t, unnest(body) AS w, unnest(range(len(body))) AS q FROM notice) GROUP BY t, w
), df AS (
  SELECT w, count(DISTINCT rid) AS n FROM w WHERE w IN (SELECT w FROM place) GROUP BY w
), probe AS (
  SELECT t, w, q, count(*) OVER (PARTITION BY t) AS size FROM (SELECT t, w, q, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) AS k FROM place LEFT JOIN df USING (w)) WHERE k <= {PROBES}
), met AS (
  SELECT rid, t, i - q AS begins, count(*) / max(size) AS share FROM w JOIN probe USING (w) GROUP BY rid, t, i - q HAVING 2 * count(*) >= max(size)
), found AS (
  SELECT m.rid, label, share FROM met m JOIN notice USING (t) JOIN d ON d.rid = m.rid
  WHERE len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(words[greatest(begins - {SLACK}, 0) + 1 : greatest(begins - {SLACK}, 0) + len(body) + {2 * SLACK}], ' ') || ' ', ' ' || k || ' '))) = 0
), f AS (
  SELECT rid, max(share) AS share, list(label) AS labels FROM found GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""
