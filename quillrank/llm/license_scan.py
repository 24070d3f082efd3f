"""Licence scan with a positional rare-token index, in built-in expressions only.

The index holds the licence words of high inverse document frequency over the templates, those in at most RARE of them and the ANCHORS
rarest of each, with all their positions in all templates. Each such word of a file is looked up; a word at file position i that a template has
at position p votes for the placement i - p. Placements with NEED votes are candidates, and one stands if every mandatory key phrase of
the template is in the file at its place. The phrases of BASE are counted wherever their words stand consecutively.

A file can only hold a template if it has the first of its key phrases; files without any of these, or of BASE, are told apart by
their longest words, and only their words are counted. Everything about a file is computed within its row: there is no join, and no shuffle.
The index is a literal of the plan, of a size that the templates fix (some 30 KB).

Null and empty texts have no words, no labels and the score 0. Rows without an id and repeated rows get a row each. Other columns are not
read, whatever their names. A text of any length is scanned whole. An empty table gives no rows. score: 0 without a label; else the larger of 0.5 (for a base phrase) and the share of its words that the best template has in place.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Label, words of a public licence or its notice (lower case, without signs), and its mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["free of charge to any person obtaining a copy", "without restriction"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["free of charge to any person obtaining a copy", "without restriction"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["unless required by applicable law or agreed to in writing", "language governing permissions and limitations"]),
    ("gpl", "licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software foundation", "general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain", "following disclaimer"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["or as a compiled binary for any purpose commercial or non commercial"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not be misrepresented", "wrote the original software"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["as long as the name is changed"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("artistic", "this package is free software you may redistribute it and or modify it under the terms of the artistic license", ["artistic license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
]
ANCHORS, NEED, RARE, BUCKETS = 4, 3, 3, 512
_SHIFT, _ZERO = 1 << 40, 1 << 32
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def indexed_words() -> set[str]:
    """The words of highest inverse document frequency: in at most RARE templates, or among the ANCHORS rarest of any."""
    words = [t.split() for _, t, _ in TEMPLATES]
    df = Counter(w for t in words for w in set(t))
    idf = {w: math.log(len(words) / n) for w, n in df.items()}
    rarest = {w for t in words for w in sorted(set(t), key=lambda w: (-idf[w], -len(w), w))[:ANCHORS]}
    return rarest | {w for w, n in df.items() if n <= RARE}


def postings() -> dict[str, list[int]]:
    """For each indexed word, template * _SHIFT + _ZERO - position, for all its positions in all templates."""
    out: dict[str, list[int]] = {w: [] for w in sorted(indexed_words())}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for p, w in enumerate(text.split()):
            if w in out:
                out[w].append(t * _SHIFT + _ZERO - p)
    return out


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(_literal, value))
    return F.struct(*(_literal(v).alias(k) for k, v in value.items())) if isinstance(value, dict) else F.lit(value)


def _placed(words: Column, start: Column, size: Column, text: Column) -> Column:
    return (start >= 0) & (F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, size), " ") == text)


def _placements(words: Column) -> Column:
    """The template placements that stand, as template * _SHIFT + first word + _ZERO."""
    table: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for w, places in postings().items():
        table[zlib.crc32(w.encode()) % BUCKETS].append({"w": w, "p": places})
    buckets = F.from_json(F.lit(json.dumps(table)), "array<array<struct<w:string,p:array<bigint>>>>")
    bucket = lambda w: F.get(buckets, (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))
    entries = F.filter(F.transform(words, lambda w, i: F.struct(F.get(F.filter(bucket(w), lambda e: e.w == w), 0)["p"].alias("p"), i.cast("long").alias("i"))), lambda h: h.p.isNotNull())
    votes = F.array_sort(F.flatten(F.transform(entries, lambda h: F.transform(h.p, lambda p: p + h.i))))
    # a lambda's argument is computed once; a column inside a lambda, once for each element
    enough = F.get(F.transform(F.array(votes), lambda found: F.array_distinct(F.filter(found, lambda v, i: F.get(found, i + NEED - 1) == v))), 0)
    phrases = []
    for _, text, mandatory in TEMPLATES:
        words_of = text.split()
        starts = [next(i for i in range(len(words_of)) if words_of[i : i + len(m.split())] == m.split()) for m in mandatory]
        phrases.append([{"at": s, "size": len(m.split()), "text": m} for s, m in zip(starts, mandatory)])
    table = _literal(phrases)
    return F.filter(enough, lambda v: F.forall(F.get(table, (v / _SHIFT).cast("int")), lambda m: _placed(words, (v % _SHIFT - _ZERO).cast("int") + m["at"], m["size"], m["text"])))


def _cover(words: Column, placement: Column) -> Column:
    text = F.get(_literal([t.split() for _, t, _ in TEMPLATES]), (placement / _SHIFT).cast("int"))
    start = (placement % _SHIFT - _ZERO).cast("int")
    return F.size(F.filter(text, lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False)))) / F.size(text)


def _stands(words: Column, phrase: str, label: str) -> Column:
    """Where phrase stands in words."""
    first, size = phrase.split()[0], len(phrase.split())
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    whole = F.filter(starts, lambda i: _placed(words, i, F.lit(size), F.lit(phrase)))
    return F.transform(whole, lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))


def _may_hold(phrase: str) -> Column:
    """True for every file that holds phrase, from its longest word or, where that is short, from its words in a row."""
    word = max(phrase.split(), key=len)
    found = F.col("low").contains(word)
    return found if len(word) > 4 else found & F.col("low").rlike(f"{GAP}+".join(phrase.split()))


def n_words(text: Column) -> Column:
    """Words of text, without building them."""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, f"{GAP}*{WORD}+(?:{GAP}+\\z)?", "w"))).otherwise(0).cast("long")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.withColumn("low", F.lower("text"))
    candidate = reduce(or_, (_may_hold(p) for p in sorted({*BASE, *(m[0] for _, _, m in TEMPLATES)})))
    split = F.filter(F.split(F.translate("text", upper, upper.lower()), f"{GAP}+"), lambda w: w != "")
    rows = rows.select("doc_id", F.when(~candidate, n_words(F.col("text"))).alias("n"), F.when(candidate, split).otherwise(F.array().cast("array<string>")).alias("w"))
    words = F.col("w")
    places = F.concat(*(_stands(words, phrase, label) for phrase, label in BASE.items()))
    rows = rows.select("doc_id", F.coalesce("n", F.size("w")).cast("long").alias("n_words"), "w", places.alias("base"), _placements(words).alias("templates"))
    base_labels = F.transform("base", lambda b: b["label"])
    names = F.array(*(F.lit(n) for n, _, _ in TEMPLATES))
    every = F.concat(base_labels, F.transform("templates", lambda v: F.get(names, (v / _SHIFT).cast("int"))))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    cover = F.array_max(F.transform("templates", lambda v: _cover(words, v)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["i"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["i"])).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(every).alias("labels"),
        F.greatest(F.coalesce(cover, F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
