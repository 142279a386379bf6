"""Licence scan by sentences and rules, in DataFrame operations only.

Texts are cut into sentences, sentences are normalised (lower case, letters and digits, one blank between) and mapped to identifiers of
known licence sentences by an equi-join; what a document says is then the sequence of its identifiers, and a licence is found where the sequence holds the
sentences of one of its rules in their order, other sentences in between allowed.  Of two rules that a document meets, one that contains the other hides it.

A sentence ends after . ! or ? before white space, after a clause that opens a list of conditions, and at a line that is empty but for comment marks.  As licences are wrapped and also stand on lines of their own, a sentence that is not known as
a whole is looked up line by line, and in runs of lines: where a line is the beginning of a known sentence, the lines behind it are put to it.  Nothing is cut: all sentences of all texts are looked up.

Very long texts and texts of very many lines cost in proportion to their length; an empty table gives an empty one.  Null and empty texts have no sentences and no licences.  Rows that repeat an id and a text get the same result each; other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, table

# Sentences of public licences and of the statements that name them.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd2-licensed": "Licensed under the BSD 2-Clause License.",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License.",
    "bsd2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-licensed": "Licensed under the ISC License.",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-later-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl2-later-spdx": "SPDX-License-Identifier: GPL-2.0-or-later",
    "lgpl3-work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "lgpl3-spdx": "SPDX-License-Identifier: LGPL-3.0-only",
    "agpl3-spdx": "SPDX-License-Identifier: AGPL-3.0-only",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-terms-cut": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-spdx": "SPDX-License-Identifier: MPL-2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense-spdx": "SPDX-License-Identifier: Unlicense",
    "cc0-dedicated": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-licensed": "Licensed under CC0 1.0.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-licensed": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-licensed": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "proprietary": "All rights reserved.",
}

# Rules: licence, and the sentences that must follow one another.  A longer rule hides the rules whose sentences it contains.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    *[("MIT", [s]) for s in ("mit-title", "mit-name", "mit-released", "mit-licensed", "mit-spdx")],
    ("Apache-2.0", ["apache-comply", "apache-unless", "apache-see"]),
    *[("Apache-2.0", [s]) for s in ("apache-comply", "apache-header", "apache-copy", "apache-licensed", "apache-released", "apache-spdx")],
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    *[("BSD-2-Clause", [s]) for s in ("bsd2-licensed", "bsd2-spdx")],
    *[("BSD-3-Clause", [s]) for s in ("bsd3-licensed", "bsd3-spdx")],
    ("ISC", ["isc-grant", "isc-as-is"]),
    *[("ISC", [s]) for s in ("isc-grant", "isc-licensed", "isc-spdx")],
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    *[("GPL-3.0-or-later", [s]) for s in ("gpl-free", "gpl3-later-spdx")],
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    *[("GPL-2.0-or-later", [s]) for s in ("gpl2-free", "gpl2-later-spdx")],
    *[("GPL-3.0-only", [s]) for s in ("gpl3-work", "gpl3-spdx")],
    *[("GPL-2.0-only", [s]) for s in ("gpl2-work", "gpl2-spdx")],
    *[("LGPL-3.0-only", [s]) for s in ("lgpl3-work", "lgpl3-spdx")],
    *[("AGPL-3.0-only", [s]) for s in ("agpl3-work", "agpl3-spdx")],
    ("MPL-2.0", ["mpl-terms-cut", "mpl-obtain"]),
    *[("MPL-2.0", [s]) for s in ("mpl-terms", "mpl-obtain", "mpl-spdx")],
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    *[("Unlicense", [s]) for s in ("unlicense-free", "unlicense-spdx")],
    *[("CC0-1.0", [s]) for s in ("cc0-dedicated", "cc0-licensed")],
    *[("CC-BY-4.0", [s]) for s in ("cc-by-licensed", "cc-by-work")],
    *[("CC-BY-SA-4.0", [s]) for s in ("cc-by-sa-licensed", "cc-by-sa-work")],
    *[("CC-BY-NC-4.0", [s]) for s in ("cc-by-nc-licensed", "cc-by-nc-work")],
    ("CC-BY-ND-4.0", ["cc-by-nd-licensed"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-licensed"]),
    ("LicenseRef-proprietary", ["proprietary"]),
]

MARK = "\x01"
# The sentence table is broadcast: entries at most.
MOST_SENTENCES = 20_000
# Lines of a block in which runs are looked for.
BLOCK_LINES = 1_000
# Clauses that open a list of conditions end like sentences.
SENTENCE_END = r"([.!?]|conditions:|met:)[\x20\x09-\x0D]+"
EMPTY_LINE = r"\n[\x20\x09-\x0D]*\n"
# Comment marks at the start of a line, with the letters that some languages use for them.
COMMENT_WORD = r"(^|\n)([\x20\x09]*)(?:dnl|REM)(?=[\x20\x09\n])"
COMMENT_LINE = r"\n[\x20\x09-\x0D#*/;%<>!|-]*(?=\n)"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


def normalised(sentence: Column) -> Column:
    """The same for a column.  Only A-Z are lowered, so that every engine agrees."""
    lowered = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def contains(long: list[str], short: list[str]) -> bool:
    rest = iter(long)
    return len(long) > len(short) and all(s in rest for s in short)


def first_word(text: Column) -> Column:
    return F.substring_index(F.substring_index(text, "\n", 1), " ", 1)


def alone(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: a generator's output is not copied into the expressions that use it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def sentence_hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(_row, _pos, _line, _end, sentence_id) of every known sentence.  known: (sentence, sentence_id), normalised.

    Line 0 is the whole sentence; lines with letters or digits count from 1.
    """
    bounds = known.agg(F.min(F.length("sentence")).alias("least"), F.max(F.length("sentence")).alias("most"), F.max(F.size(F.split("sentence", " "))).alias("words"), F.array_sort(F.collect_set(first_word(F.col("sentence")))).alias("first")).first()
    bare = F.regexp_replace("text", COMMENT_WORD, "$1$2#")
    # A line of comment marks alone becomes an empty one.
    bare = F.regexp_replace(bare, COMMENT_LINE, "\n")
    marked = F.regexp_replace(F.regexp_replace(bare, SENTENCE_END, "$1" + MARK), EMPTY_LINE, MARK)
    sentences = docs.filter("text IS NOT NULL").select("_row", F.posexplode(F.split(marked, MARK)).alias("_pos", "_sentence"))
    # A normal form is never longer than its text, and at most as much shorter as the wrapping of a long sentence adds.
    least, most = bounds["least"] or 0, bounds["most"] or 0
    whole = sentences.filter(F.length("_sentence") >= least).select("_row", "_pos", F.lit(0).alias("_line"), normalised(F.col("_sentence")).alias("sentence")).filter(F.length("sentence") <= most)
    # Each line is normalised once; what is longer than any known sentence is cut to where it shows that.
    lines = F.filter(F.transform(F.split("_sentence", "\n"), lambda x: F.substring(normalised(x), 1, most + 2)), lambda x: x != "")
    several = alone(sentences.filter(F.contains("_sentence", F.lit("\n"))), _lines=lines).select("_row", "_pos", "_lines")
    single = several.select("_row", "_pos", F.posexplode("_lines").alias("_line", "sentence")).filter(F.length("sentence").between(least, most)).withColumn("_line", F.col("_line") + 1)
    hits = whole.unionByName(single).join(F.broadcast(known), "sentence").select("_row", "_pos", "_line", F.col("_line").alias("_end"), "sentence_id")
    return hits.union(run_hits(several, known, most, bounds["words"] or 1, bounds["first"] or [""]))


def run_hits(several: DataFrame, known: DataFrame, most: int, words: int, first: list[str]) -> DataFrame:
    """(_row, _pos, _line, _end, sentence_id) of every known sentence that stands in a run of lines within a longer sentence.

    A line that begins with a known sentence's first word starts a window: the lines from there on, no more than the longest known sentence has words, and no more letters than it has.  The lines are
    dealt in blocks that overlap by one window, so the work is in proportion to the lines, and no row holds more than a block's windows.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / BLOCK_LINES).cast("int")), lambda b: F.struct((b * BLOCK_LINES).alias("base"), F.slice("_lines", b * BLOCK_LINES + 1, F.lit(BLOCK_LINES + words)).alias("lines")))
    dealt = several.filter(F.size("_lines") > 1).select("_row", "_pos", F.explode(blocks).alias("_block")).select("_row", "_pos", F.col("_block.base").alias("_base"), F.col("_block.lines").alias("_part"))
    window = lambda k: F.struct((F.col("_base") + k).alias("line"), F.substring(F.array_join(F.slice("_part", k, F.lit(words)), "\n"), 1, most + 1).alias("window"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK_LINES), F.size("_part"))), lambda k: F.when(first_word(F.get("_part", k - 1)).isin(*first), window(k)))
    opened = dealt.select("_row", "_pos", F.explode(F.array_compact(starts)).alias("_w")).select("_row", "_pos", F.col("_w.line").alias("_line"), F.col("_w.window").alias("_window"))
    met = opened.withColumn("_first", first_word(F.col("_window"))).join(F.broadcast(known.withColumn("_begins", first_word(F.col("sentence")))), F.col("_first") == F.col("_begins"))
    n = F.length("sentence")
    ends = (F.length("_window") == n) | (F.substring(F.col("_window"), n + 1, F.lit(1)) == "\n")
    found = met.filter(F.startswith(F.translate("_window", "\n", " "), F.col("sentence")) & ends)
    breaks = F.regexp_count(F.substring(F.col("_window"), F.lit(1), n), F.lit("\n"))
    return found.withColumn("_end", F.col("_line") + breaks).filter("_end > _line").select("_row", "_pos", "_line", "_end", "sentence_id")


def row_print() -> Column:
    """128 bits of a row's id and text: rows that repeat both are one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")))


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Add n_sentences (known sentences found), sentences (their ids in order) and licences (sorted names), both as text joined by commas."""
    spark = docs.sparkSession
    if len(sentences) > MOST_SENTENCES:
        raise ValueError("the sentence table is too large to broadcast")
    known = spark.createDataFrame([(normal(s), i) for i, s in sentences.items()], "sentence string, sentence_id string")
    rows = fresh(docs, "n_sentences", "sentences", "licences", "_row", "_of").withColumn("_row", row_print())
    hits = sentence_hits(rows.select("_row", "text"), known)
    # A row's hits: as a set, so that repeated rows count once.
    each = hits.groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_set(F.struct("_pos", "_line", "_end", "sentence_id"))).alias("_hits"))
    whole = F.transform(F.filter("_hits", lambda h: h["_line"] == 0), lambda h: h["_pos"])
    # A run of lines hides the lines and the shorter runs in it.
    runs = F.filter("_hits", lambda h: h["_end"] > h["_line"])
    inside = lambda h, r: (r["_pos"] == h["_pos"]) & (r["_line"] <= h["_line"]) & (h["_end"] <= r["_end"]) & (r["_end"] - r["_line"] > h["_end"] - h["_line"])
    own = F.filter("_hits", lambda h: (h["_line"] == 0) | (~F.array_contains(F.col("_whole"), h["_pos"]) & ~F.exists("_runs", lambda r: inside(h, r))))
    each = each.withColumn("_whole", whole).withColumn("_runs", runs).withColumn("_ids", F.transform(own, lambda h: h["sentence_id"])).withColumn("_text", F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|")))
    met = F.array(*[F.col("_text").like("%" + "%".join(f"|{s}|" for s in ids) + "%") for _, ids in rules])
    each = each.withColumn("_met", met)
    names = []
    for n, (licence, ids) in enumerate(rules):
        hiding = [k for k, (_, other) in enumerate(rules) if contains(other, ids)]
        shown = F.col("_met")[n]
        for k in hiding:
            shown = shown & ~F.col("_met")[k]
        names.append(F.when(shown, F.lit(licence)))
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    each = each.select("_of", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentences"), F.array_join(licences, ",").alias("licences"))
    out = rows.drop("text").join(each, F.col("_row") == F.col("_of"), "left").drop("_row", "_of")
    return out.fillna({"n_sentences": 0, "sentences": "", "licences": ""}, subset=["n_sentences", "sentences", "licences"])


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    """The same in SQL: sentences, look-up, and each rule as a pattern over the sequence of identifiers."""
    known = ", ".join(f"('{normal(s)}', '{i}')" for i, s in SENTENCES.items())
    like = lambda ids: "ids LIKE '%" + "%".join(f"|{s}|" for s in ids) + "%'"
    cases = []
    for licence, ids in RULES:
        hiding = "".join(f" AND NOT {like(other)}" for _, other in RULES if contains(other, ids))
        cases.append(f"CASE WHEN {like(ids)}{hiding} THEN '{licence}' END")
    return rf"""
WITH known(sentence, sentence_id) AS (VALUES {known}),
cut AS (
  SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?]|conditions:|met:)[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '\n[\x20\x09-\x0D]*\n', chr(1), 'g'), chr(1)) AS s
  FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM cut),
pieces AS (
  SELECT doc_id, pos, 0 AS line, sentence AS piece FROM sentences
  UNION ALL
  SELECT doc_id, pos, generate_subscripts(string_split(sentence, chr(10)), 1), unnest(string_split(sentence, chr(10))) FROM sentences WHERE contains(sentence, chr(10))),
hits AS (
  SELECT doc_id, pos, line, sentence_id FROM pieces
  JOIN known ON known.sentence = trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ')),
own AS (SELECT * FROM hits h WHERE line = 0 OR NOT EXISTS (SELECT 1 FROM hits w WHERE w.doc_id = h.doc_id AND w.pos = h.pos AND w.line = 0)),
each AS (SELECT doc_id, count(*) AS n, string_agg(sentence_id, ',' ORDER BY pos, line) AS sentences, '|' || string_agg(sentence_id, '||' ORDER BY pos, line) || '|' AS ids FROM own GROUP BY doc_id),
named AS (SELECT *, list_sort(list_distinct([{", ".join(cases)}])) AS names FROM each)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentences, '') AS sentences, coalesce(array_to_string(names, ','), '') AS licences
FROM documents d LEFT JOIN named USING (doc_id)
"""


OP5_SQL = _oracle()
