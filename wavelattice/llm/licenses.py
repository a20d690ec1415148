"""Licence scans with a positional rare-token index, in DataFrame operations only.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
Templates are the paragraphs of licence texts that are a licence's own, the
notices and sentences by which one is granted or referred to, and the SPDX
identifiers. The document frequency of every template word is counted over all
documents; a template is indexed under its rarest words, with their positions.
A file's words that are in the index are looked up; each gives the start at
which the template would have to lie, and starts that enough different words
agree on are candidates. A candidate counts once all mandatory phrases of the
template stand in the file where the template lies. A template whose indexed
words stand in a file but not at one alignment (all but one edited away, say)
is not found.

A word that more than a fifth of all documents have is indexed only where a
template would otherwise have fewer than two. Postings and frequencies are
bounded by the templates below, whatever the data.

Besides, phrases that name a licence are found wherever their words stand
consecutively (base labels), and labels are the union of both.

Null counts as empty; texts without licence words have empty labels, null
first_word and last_word and a score of 0. Rows are told apart by their place;
repeated rows are scanned alike. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.llm.store import literal_table, materialise, with_row_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, text of the template, mandatory phrases. Paragraphs of full texts, notices and references.
PARAGRAPHS = (
    ("mit-license", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions""", ("permission is hereby granted free of charge", "sublicense and or sell copies of the software")),
    ("mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mit-license", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice shall be included in all copies or substantial portions",)),
    ("mit-license", "released under the MIT License", ("mit license",)),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""", ("you may not use this file except in compliance with the license", "apache org licenses license 2 0")),
    ("apache-2.0", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive,
        no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform,
        sublicense, and distribute the Work and such Derivative Works in Source or Object form""", ("each contributor hereby grants to you", "in source or object form")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License", ("redistribute it and or modify it", "general public license")),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license as published", "version 2 of the license")),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published", "version 3 of the license")),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation", ("gnu general public license version 3 29 june 2007",)),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation", ("gnu general public license version 2 june 1991",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("affero general public license", "version 3")),
    ("agpl", "under the terms of the GNU Affero General Public License", ("affero general public license",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc", "4 0")),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa", "4 0")),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international",)),
    ("cc0-1.0", "waived all copyright and related or neighboring rights under CC0 1.0 Universal", ("cc0 1 0",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-2-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY""", ("redistributions in binary form must reproduce the above copyright notice", "provided with the distribution this software is provided")),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission""", ("neither the name of", "endorse or promote products derived from this software")),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ("all advertising materials mentioning features or use of this software",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", ("eclipse public license v1 0",)),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies""", ("use copy modify and or distribute", "provided that the above copyright notice")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("use copy modify and or distribute", "with or without fee")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software""", ("in no event will the authors be held liable for any damages arising from the use",)),
    ("zlib", """The origin of this software must not be misrepresented; you must not claim that you wrote the original software""", ("must not be misrepresented you must not claim that you wrote the original software",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license""", ("any person or organization obtaining a copy", "covered by this license")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means""", ("anyone is free to copy modify publish use compile sell or distribute",)),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("you want to public license",)),
    ("artistic-2.0", "This package is released under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    ("odbl-1.0", "This database is made available under the Open Database License", ("open database license",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license version 1 1",)),
)
# Identifiers, none of which begins another.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CDDL-1.0 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OpenSSL PostgreSQL Python-2.0 Ruby Unlicense "
    "UPL-1.0 Vim W3C WTFPL Zlib"
).split()


def _words_of(text: str) -> str:
    return " ".join(w for w in re.split(SEPARATORS, text.lower()) if w)


TEMPLATES = tuple((label, _words_of(text), phrases) for label, text, phrases in PARAGRAPHS) + tuple(
    ("mit-license" if x == "MIT" else x.lower(), _words_of(f"SPDX-License-Identifier: {x}"), (_words_of(f"SPDX-License-Identifier: {x}"),)) for x in SPDX
)
RARE_WORDS = 6
MAX_SHARE = 0.2
MIN_WEIGHT = 0.6


def words(text: Column) -> Column:
    """The words of a text; an empty first or last one where it starts or ends with a separator."""
    return F.split(_lower(text), SEPARATORS)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lower(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), letters, letters.lower())


def _rows(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """doc_id, words, how many empty ones stand in front, and how many others there are."""
    all_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, words(F.col(text_col)).alias("words"))
    front = F.when(F.col("words")[0] == "", 1).otherwise(0)
    back = F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    return all_.withColumn("skip", front).withColumn("n", (F.size("words") - front - back).cast("long"))


def document_frequencies(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows in all, and in how many of them each word of the (small, fixed) vocabulary occurs."""
    rows = _rows(docs, id_col, text_col).select(F.array_intersect("words", _strings(vocabulary)).alias("w"))
    counts = rows.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").count().collect()
    found = {r.w: r["count"] for r in counts}
    return found.pop("", 0), found


def rare_postings(total: int, found: dict[str, int]) -> list[tuple[str, float, int, int, float]]:
    """(word, idf, template, position, template's weight) for each template's rarest words."""
    out = []
    for t, (_, wording, _) in enumerate(TEMPLATES):
        listed = wording.split()
        ranked = sorted(set(listed), key=lambda w: (found.get(w, 0), w))[:RARE_WORDS]
        rare = [w for w in ranked if found.get(w, 0) <= MAX_SHARE * total]
        rare = rare if len(rare) >= 2 else ranked[:2]
        idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-6 for w in rare}
        weight = sum(idf[w] for w in listed if w in idf)
        out += [(w, idf[w], t, i, weight) for i, w in enumerate(listed) if w in idf]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, base phrases, labels, alignments and score of every row of ``docs``."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, wording, _ in TEMPLATES for w in wording.split()})
    postings = rare_postings(*document_frequencies(docs, vocabulary, id_col, text_col))
    rare = sorted({p[0] for p in postings})
    docs, key = with_row_key(docs)

    # One pass: base phrases, only looked for in rows that have all their words, and the words of rows with two indexed ones.
    lists = []
    for phrase, _ in BASE:
        parts = phrase.split()
        test = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(parts))
        has = F.array_contains("words", "license") & F.array_contains("words", parts[0])
        spots = F.expr(f"transform(filter(sequence(0, size(words) - 1), i -> words[i] = '{parts[0]}' and {test}), i -> i - skip)")
        lists.append(F.when(has, spots).otherwise(F.array().cast("array<int>")))
    candidate = F.size(F.array_intersect("words", _strings(rare))) >= 2
    seen = _rows(docs, id_col, text_col, F.col(key).alias("key"))
    seen = seen.select("doc_id", "key", "n", F.when(candidate, F.col("words")).alias("words"), *[x.alias(f"p{i}") for i, x in enumerate(lists)])
    seen = materialise(seen, "license-rows")
    some = seen.where("words is not null").select("key", "words")
    index = F.broadcast(literal_table(spark, postings, "word string, idf double, template int, position int, weight double"))
    places = some.select("key", F.posexplode("words").alias("at", "word")).join(index, "word")
    votes = places.select("key", "template", (F.col("at") - F.col("position")).alias("start"), "position", "idf", "weight").distinct()
    starts = votes.groupBy("key", "template", "start").agg(F.sum("idf").alias("got"), F.first("weight").alias("weight"), F.count("*").alias("n"))
    starts = starts.where((F.col("n") >= 2) & (F.col("got") >= MIN_WEIGHT * F.col("weight")))

    # Mandatory phrases, within the stretch where the template lies.
    shape = [(t, label, len(wording.split()), list(phrases)) for t, (label, wording, phrases) in enumerate(TEMPLATES)]
    shape = F.broadcast(literal_table(spark, shape, "template int, label string, length int, phrases array<string>"))
    near = starts.join(some, "key").join(shape, "template")
    near = near.withColumn("stretch", F.expr("concat(' ', array_join(slice(words, greatest(start, 0) + 1, length + least(start, 0)), ' '), ' ')"))
    sure = near.where(F.expr("forall(phrases, p -> contains(stretch, concat(' ', p, ' ')))"))
    sure = sure.select("key", "label", (F.col("got") / F.col("weight")).alias("share"), "start")
    best = sure.groupBy("key").agg(F.collect_set("label").alias("method"), F.max("share").alias("share"), F.count("*").alias("n_aligned"))

    base = seen.select("doc_id", "key", F.col("n").alias("n_words"), *[f"p{i}" for i in range(len(BASE))])
    spots = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    names = F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])
    base = base.select("doc_id", "key", "n_words", spots.alias("spots"), F.array_sort(F.array_compact(names)).alias("base"))
    out = base.join(best, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("method", F.array().cast("array<string>")))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("spots").cast("long").alias("n_base"),
        F.array_min("spots").cast("long").alias("first_word"),
        F.array_max("spots").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("share").isNotNull(), F.least("share", F.lit(1.0))).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
        F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"),
    )
