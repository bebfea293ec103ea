"""License scans (operator 1), native: a positional rare-token index.

Templates are licence phrases and the clauses of licence texts, each with a label and a mandatory key phrase. The index
gives for each word its postings (template, offset). IDF is counted over all texts for all words of the index. Of a
file, the highest-IDF licence words are looked up: for each template that the file may hold, the rarest of the words
that such a copy must have. Their postings give candidate starts; the postings of the template's other words must
stand at the same relative positions (all of them for short templates; four fifths for templates of LONG words or
more), and the key phrase must be complete. All places are found, also those that share words.

Scale: only SQL functions, no shuffle but that of the IDF counts (one row for each word of the index and task). A text is
split into words once a pass; places are computed only for texts that hold a rare word.

Defined results: null and empty texts have no words, no labels, score 0; repeated rows give equal rows; null ids
pass through; extra columns are ignored; an empty table gives none (IDF is then 0 throughout, ties by length).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: (template, label, mandatory key phrase)
MORE = [
    ("all rights reserved", "proprietary", "rights reserved"),
    ("licensed under cc by nc", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa", "cc-by-sa", "cc by sa"),
    ("gnu lesser general public license", "lgpl", "lesser general public license"),
    ("gnu affero general public license", "agpl", "affero general public license"),
    ("mozilla public license", "mpl", "mozilla public license"),
    ("bsd license", "bsd", "bsd license"),
    ("isc license", "isc", "isc license"),
    ("creative commons attribution", "creative-commons", "creative commons"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission is hereby granted"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "into the public domain"),
]
#: Clauses of licence texts and of the notices that licences ask for (fixed values: the licences' own words).
CLAUSES = [
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions:""",
        "mit",
        "to deal in the software without restriction",
    ),
    (
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
        "mit",
        "copies or substantial portions of the software",
    ),
    (
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
        "fitness for a particular purpose and noninfringement",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        "isc",
        "with or without fee is hereby granted",
    ),
    (
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.""",
        "bsd",
        "redistributions of source code must retain",
    ),
    (
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        "bsd",
        "redistributions in binary form must reproduce",
    ),
    (
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        "bsd",
        "endorse or promote products derived from this software",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        "apache",
        "you may not use this file except in compliance with the license",
    ),
    (
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
        "apache",
        "unless required by applicable law or agreed to in writing",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "gpl",
        "terms of the gnu general public license as published by the free software foundation",
    ),
    (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version.""",
        "lgpl",
        "terms of the gnu lesser general public license as published by the free software foundation",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mpl",
        "source code form is subject to the terms of the mozilla public license",
    ),
    (
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unlicense",
        "publish use compile sell or distribute this software",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software.""",
        "zlib",
        "in no event will the authors be held liable",
    ),
    (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software""",
        "boost",
        "any person or organization obtaining a copy of the software",
    ),
    (
        """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
        neighboring rights to this work.""",
        "cc0",
        "waived all copyright and related or neighboring rights",
    ),
]
LONG, SHARE = 8, 0.8


def templates() -> list[tuple[list[str], str, int, int, bool]]:
    """(words, label, start and length of the key phrase, base) of each template."""
    out = [(p.split(), label, 0, len(p.split()), True) for p, label in BASE]
    for p, label, key in MORE + CLAUSES:
        w, k = re.findall(WORD, p.lower()), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append((w, label, at, len(k), False))
    return out


VOCABULARY = sorted({w for t in templates() for w in t[0]})


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def split_words(low: Column) -> Column:
    """Words of a lower-cased text; where it begins or ends with separators, an empty word stands there."""
    return F.split(low, SEPARATORS)


def lowered() -> Column:
    """The text in lower case, to find template words by. Other letters may change too, but none turns into a separator or back; the
    few that become one of a-z are seen apart later."""
    return F.lower(F.coalesce("text", F.lit("")))


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of each word of the index over all rows of docs; a row for each word reaches the driver."""
    found = F.array_intersect(split_words(lowered()), strings(VOCABULARY))
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r["w"]: r["n"] for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in VOCABULARY}


def postings() -> dict[str, list[tuple[int, int]]]:
    """The index: (template, offset) of each word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (words, *_) in enumerate(templates()):
        for o, w in enumerate(words):
            out.setdefault(w, []).append((t, o))
    return out


def mandatory(t: tuple) -> range:
    """Offsets of the words that no copy lacks."""
    words, _, key, n, base = t
    return range(len(words)) if base or len(words) < LONG else range(key, key + n)


def rarest(weights: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """The part of the index to look up first: each template by its mandatory word of highest IDF (ties: the longest, then the first)."""
    first = {}
    for k, t in enumerate(templates()):
        first[k] = max(mandatory(t), key=lambda o: (weights[t[0][o]], len(t[0][o]), -o))
    words = {templates()[k][0][o] for k, o in first.items()}
    return {w: [(k, o) for k, o in p if first[k] == o] for w, p in postings().items() if w in words}


def scan_licenses(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    weights = idf(docs) if weights is None else weights
    ts = templates()
    index = rarest(weights)
    int_pair = lambda p: F.struct(F.lit(p[0]).alias("t"), F.lit(p[1]).alias("o"))
    lookup = F.create_map(*[x for w, p in sorted(index.items()) for x in (F.lit(w), F.array(*map(int_pair, p)))])
    # what a template asks for, by its number
    wanted = F.array(*[strings(t[0]) for t in ts])
    phrase = F.array(*[strings(t[0][t[2] : t[2] + t[3]]) for t in ts])
    key_at = F.array(*[F.lit(t[2]) for t in ts])
    need = F.array(*[F.lit(len(t[0]) if t[4] or len(t[0]) < LONG else math.ceil(SHARE * len(t[0]) - 1e-9)) for t in ts])
    label = strings([t[1] for t in ts])
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), split_words(lowered()).alias("seen"))
    blank = lambda at: F.when(F.get("seen", at) == "", 1).otherwise(0)
    # "" splits into one empty word, which is first and last
    n_words = F.greatest(F.lit(0), F.size("seen") - blank(F.lit(0)) - F.when(F.size("seen") > 1, blank(F.size("seen") - 1)).otherwise(0))
    # the words as they are compared, only where a rare word stands; empty ones at the beginning don't count
    exact = F.filter(split_words(F.translate("text", UPPER, LOW)), lambda w: w != "")
    df = df.select("doc_id", n_words.cast("long").alias("n_words"), F.when(F.arrays_overlap("seen", strings(sorted(index))), exact).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(sorted(index)))
    df = df.withColumn("places", F.when(F.col("w").isNotNull(), places))
    starts = F.flatten(F.transform("places", lambda x: F.transform(F.element_at(lookup, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("s")))))
    df = df.withColumn("starts", F.array_distinct(starts))

    def stands(c: Column) -> Column:
        t, s = c["t"], c["s"]
        keyed = F.slice("w", F.greatest(s, F.lit(0)) + F.get(key_at, t) + 1, F.size(F.get(phrase, t))) == F.get(phrase, t)
        same = F.size(F.filter(F.zip_with(F.slice("w", F.greatest(s, F.lit(0)) + 1, F.size(F.get(wanted, t))), F.get(wanted, t), lambda a, b: a == b), lambda x: x))
        return (s >= 0) & keyed & (same >= F.get(need, t))

    none = F.array().cast("array<struct<t:int,s:int>>")
    df = df.withColumn("found", F.coalesce(F.filter("starts", stands), none)).select("doc_id", "n_words", "found")
    base = F.filter("found", lambda c: c["t"] < len(BASE))
    df = df.withColumn("base", base).withColumn("kinds", F.size(F.array_distinct("found.t")))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label, x["t"])))), ",")
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.s").cast("long").alias("first_word"),
        F.array_max("base.s").cast("long").alias("last_word"),
        names("base").alias("base_labels"),
        names("found").alias("labels"),
        F.when(F.col("kinds") > 0, F.col("kinds") / (F.col("kinds") + F.lit(1.0)) * 0.5 + 0.5).otherwise(0.0).alias("score"),
    )


def op1_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB: every template tried at every word that may begin it or its key phrase."""
    parts, counts, base = [], [], []
    for k, (words, label, key, key_len, is_base) in enumerate(templates()):
        n = len(words)
        quoted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        if is_base or n < LONG:
            cond = f"w[i + 1] = '{words[0]}' AND w[i + 1 : i + {n}] = {quoted}"
            starts = "c"
        else:
            same = " + ".join(f"coalesce((w[i + {j + 1}] = '{x}')::INT, 0)" for j, x in enumerate(words))
            keyed = "[" + ", ".join(f"'{w}'" for w in words[key : key + key_len]) + "]"
            cond = f"i >= 0 AND w[i + {key + 1} : i + {key + key_len}] = {keyed} AND {same} >= {SHARE} * {n}"
            starts = f"list_transform(list_filter(c, lambda i: w[i + 1] = '{words[key]}'), lambda i: i - {key})"
        parts.append(f"list_filter({starts}, lambda i: {cond}) AS t{k}")
        counts.append((f"t{k}", label, is_base))
    base = " || ".join(c for c, _, b in counts if b)
    join = lambda which: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len({c}) > 0 THEN '{label}' END" for c, label, b in counts if which(b)) + "], lambda x: x IS NOT NULL))), ',')"
    kinds = " + ".join(f"(len({c}) > 0)::INT" for c, _, _ in counts)
    heads = "[" + ", ".join(sorted({f"'{t[0][0]}'" for t in templates()} | {f"'{t[0][t[2]]}'" for t in templates()})) + "]"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT *, list_filter(range(0, len(w)), lambda i: list_contains({heads}, w[i + 1])) AS c FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, {", ".join(parts)} FROM s),
b AS (SELECT *, {base} AS base, {kinds} AS kinds FROM m)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
  {join(lambda b: b)} AS base_labels, {join(lambda b: True)} AS labels,
  CASE WHEN kinds > 0 THEN kinds / (kinds + 1.0::DOUBLE) * 0.5 + 0.5 ELSE 0.0::DOUBLE END AS score FROM b
"""


SQL = _sql()
