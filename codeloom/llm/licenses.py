"""License scans by an exact set-similarity join, in DataFrame operations only.

Templates are sets of words. A text block is a window of consecutive words of one text, whatever its
line ends, of the template's length divided by the containment; it meets a template if it holds
at least `containment` of the template's distinct words. A template's words are ordered from the
rarest in the whole corpus on. Prefix filter: a block that meets it holds one of its first
|T| - need + 1 words, so only these words (anchors) are joined, against a broadcast list whose size the
templates fix. Length filter: the text has `need` known words. Positional filter: of a block whose first word in the
global order is the anchor, at place i of the template and j of the block, no more can be common than
what follows on either side: |T| - i of the template, and the block's words of that place or later. What passes is compared in full, so every block over
the threshold is found.

Texts are cut into words once; what is kept of them is the places of words that templates have, in
segments of bounded size that overlap by a block, so no task meets more than a segment at a time.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import written

#: What a word is made of, after A-Z are lower-cased (fixed values).
LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORDS = f"[{LETTER}]+"
#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of the similarity join, by label (fixed values: the public wording of the notices).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
CONTAINMENT = 0.8
#: Words of a segment, without what it shares with the next.
SEGMENT = 512


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; other letters stay, in so far as they could otherwise turn into ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike("[\\x{130}\\x{212A}]"), F.translate(c, upper, upper.lower())).otherwise(F.lower(c))


def template_list(text: str) -> list[str]:
    """A template's words, in order."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_words(text: str) -> list[str]:
    """A template's distinct words, in order of appearance."""
    return list(dict.fromkeys(template_list(text)))


def measures(templates: dict[str, str], containment: float) -> dict[str, tuple[list[str], int, int]]:
    """For each label: its distinct words, how many of them a block needs, and a block's length."""
    out = {k: (template_words(v), math.ceil(len(template_words(v)) * containment - 1e-9), math.ceil(len(template_list(v)) / containment - 1e-9)) for k, v in templates.items()}
    if not all(w for w, _, _ in out.values()) or not 0 < containment <= 1:
        raise ValueError("templates need words, and containment lies in (0, 1]")
    return out


def cut(docs: DataFrame, text: str, key: str, phrases: dict[str, str], known: list[str], pad: int) -> DataFrame:
    """(rid, key, n_words, hits, segs): one pass over every text; rid names the row once this is written.

    hits are the places (i, label) of phrases; segs are segments of the places (p, w) of known words.
    """

    def parts(w: Column) -> Column:
        def at(word, i):
            out = F.lit(None).cast("struct<i:int,label:string>")
            for phrase, label in phrases.items():
                first, *more = phrase.split(" ")
                hit = word == F.lit(first)
                for k, m in enumerate(more):
                    hit &= F.get(w, i + k + 1) == F.lit(m)
                out = F.when(hit, F.struct(i.cast("int").alias("i"), F.lit(label).alias("label"))).otherwise(out)
            return out

        def segment(s):
            here = F.transform(F.slice(w, s * SEGMENT + 1, SEGMENT + pad), lambda x, i: F.struct((i + s * SEGMENT).cast("int").alias("p"), x.alias("w")))
            return F.filter(here, lambda x: x["w"].isin(known))

        segs = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / SEGMENT).cast("int")), segment)).otherwise(F.array().cast("array<array<struct<p:int,w:string>>>"))
        hits = F.filter(F.transform(w, at), lambda x: x.isNotNull())
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"), segs.alias("segs"))

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.regexp_extract_all(lower_ascii(t), F.lit(WORDS), F.lit(0))
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), bound(words, parts).alias("x")).select("rid", "key", "x.*")


def similar(found: DataFrame, templates: dict[str, str], containment: float = CONTAINMENT) -> DataFrame:
    """(rid, label, containment): for rows of cut(), every template that a block meets, with the best block's containment."""
    spark = found.sparkSession
    use = measures(templates, containment)
    segs = found.select("rid", F.explode("segs").alias("seg")).where(F.size(F.array_distinct(F.transform("seg", lambda x: x["w"]))) >= min(n for _, n, _ in use.values()))
    seen = segs.select(F.explode("seg").alias("t")).groupBy("t.w").agg(F.count("*").alias("n"))
    rows = ", ".join(f"('{k}', {n}, {length}, array({', '.join(map(repr, w))}))" for k, (w, n, length) in use.items())
    t = spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, need, length, words)").select("*", F.explode("words").alias("w"))
    order = Window.partitionBy("label").orderBy(F.coalesce("n", F.lit(0)), "w")
    ranked = written(t.join(seen, "w", "left").withColumn("place", F.row_number().over(order) - 1), "ranked")
    later = ranked.alias("a").join(ranked.alias("b"), "label").where("b.place >= a.place").groupBy("label", F.col("a.w").alias("w")).agg(F.collect_list("b.w").alias("later"))
    prefix = ranked.where("place <= size(words) - need").join(later, ["label", "w"]).select("label", "need", "length", "w", "later", F.size("words").alias("of"))
    first = [r.w for r in prefix.select("w").distinct().collect()]  # no more than the templates' words
    anchors = segs.select("rid", "seg", F.explode(F.filter("seg", lambda x: x["w"].isin(first))).alias("a")).select("rid", "seg", F.col("a.p").alias("p"), F.col("a.w").alias("w"))
    near = anchors.join(F.broadcast(prefix), "w")  # bounded by the templates' words
    around = F.filter("seg", lambda x: (x["p"] > F.col("p") - F.col("length")) & (x["p"] < F.col("p") + F.col("length")) & F.array_contains("later", x["w"]))
    near = near.select("rid", "label", "need", "length", "of", "p", around.alias("around"))
    distinct = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["w"])))
    near = near.where(distinct(F.col("around")) >= F.col("need"))
    best = F.array_max(F.transform(F.filter("around", lambda x: x["p"] <= F.col("p")), lambda x: distinct(F.filter("around", lambda y: (y["p"] >= x["p"]) & (y["p"] < x["p"] + F.col("length"))))))
    return near.select("rid", "label", "of", "need", best.alias("common")).where("common >= need").groupBy("rid", "label").agg(F.max(F.col("common") / F.col("of")).alias("containment"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: base phrases and template labels.

    Null and empty texts have no words, no labels and a score of 0. score is 1 if a base phrase
    occurs, else the highest containment found. Rows of equal keys, or of none, get a row each, by
    their own texts. Other columns are left behind.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    use = measures(templates, containment)
    known = sorted({w for words, _, _ in use.values() for w in words})
    found = written(cut(docs, text, key, phrases, known, max(n for _, _, n in use.values())), "words")
    hits = similar(found, templates, containment).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    at, labels = F.transform("hits", lambda x: x["i"]), F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["label"])))
    base = found.select("rid", "key", "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), labels.alias("base"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return base.join(hits, "rid", "left").select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns, by scan(): a row for each document; null texts count as empty."""
    return scan(docs)


def oracle() -> str:
    """DuckDB SQL for op10: every window that begins with a template's word, compared in full."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    use = measures(TEMPLATES, CONTAINMENT)
    rows = ", ".join(f"('{k}', {n}, {length}, [{', '.join(map(repr, w))}])" for k, (w, n, length) in use.items())
    ph = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
p AS (SELECT * FROM (VALUES {ph}) AS p(phrase, label)),
c AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
hit AS (SELECT c.doc_id, i, label FROM c JOIN p ON c.words[i + 1] = string_split(phrase, ' ')[1] WHERE array_to_string(c.words[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS l FROM hit GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {rows}) AS t(label, need, length, tw)),
cand AS (SELECT doc_id, words, label, need, length, tw FROM w, t WHERE len(list_intersect(words, tw)) >= need),
win AS (SELECT doc_id, label, need, tw, words, length, unnest(range(1, len(words) + 1)) AS i FROM cand),
sim AS (SELECT doc_id, label, max(len(list_intersect(words[i : i + length - 1], tw)) / len(tw)) AS s FROM win WHERE list_contains(tw, words[i]) AND len(list_intersect(words[i : i + length - 1], tw)) >= need GROUP BY doc_id, label),
tpl AS (SELECT doc_id, list(label) AS l, max(s) AS s FROM sim GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.l, CAST([] AS VARCHAR[]))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, CAST([] AS VARCHAR[])), coalesce(tpl.l, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(tpl.s, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN tpl USING (doc_id)
"""
