"""License scans by diagonal voting.

Every word k-gram hash of a text is joined to the places where it stands in the templates; a hit at text place p and template place t
votes for the diagonal p - t. Votes are summed per diagonal, and neighbouring diagonals (a few words put in or left out) are merged around
each anchor: all within ``NEIGHBOUR`` of it. A merged span is verified by the share of the template's k-grams whose *own place* voted: a
diagonal lays the template on the text once, and a place that votes on several diagonals counts once, so a phrase however often repeated
covers no more than its own places; and as all diagonals of a span are near one anchor, its places follow each other as in the template.
Of anchors that see the same occurrence the best one stays, and of overlapping spans with different labels the better covered ones.
Short base phrases are templates too; they need every vote on one diagonal, so their spans are exact places.

Only DataFrame functions are used. The template table has a fixed size, so its hashes go to every task as a literal hash set that keeps
k-grams that can't join from ever leaving their row. Null texts have no words and no labels. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import words

K = 3
#: Share of a template's k-grams that a span must hold, unless the template says otherwise.
COVERAGE = 0.8
#: Diagonals this near to the anchor belong to its span.
NEIGHBOUR = 6

# The base phrases and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Notices and texts of public licenses. WHOLE ones differ from other licenses or versions by a word and must stand whole.
WHOLE = 1.0
NOTICES = [
    ("mit", COVERAGE, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", COVERAGE, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", COVERAGE, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", COVERAGE, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", COVERAGE, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", COVERAGE, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", COVERAGE, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", COVERAGE, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", COVERAGE, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("gpl-3", WHOLE, "licensed under the GNU General Public License, version 3"),
    ("gpl-2", WHOLE, "licensed under the GNU General Public License, version 2"),
    ("gpl", COVERAGE, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", WHOLE, "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", WHOLE, "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", WHOLE, "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", WHOLE, "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", WHOLE, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", WHOLE, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", WHOLE, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", WHOLE, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", WHOLE, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", WHOLE, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", WHOLE, "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("unlicense", COVERAGE, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", COVERAGE, "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def templates(base=BASE, notices=NOTICES) -> list[tuple[int, str, bool, float, list[str]]]:
    """(number, label, exact, least share, words) of every template."""
    both = [(label, True, WHOLE, text) for label, text in base] + [(label, False, least, text) for label, least, text in notices]
    return [(tid, label, exact, least, template_words(text)) for tid, (label, exact, least, text) in enumerate(both)]


def template_grams(spark: SparkSession, base=BASE, notices=NOTICES, k: int = K) -> DataFrame:
    """(gram, h, tid, tpos, label, exact, need, least): one row per k-gram of each template."""
    rows = [(tid, label, exact, len(w) - k + 1, least, i, w[i : i + k]) for tid, label, exact, least, w in templates(base, notices) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "tid int, label string, exact boolean, need int, least double, tpos int, g array<string>")
    return df.select(F.array_join("g", " ").alias("gram"), F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("h"), "tid", "tpos", "label", "exact", "need", "least")


def reach(base=BASE, notices=NOTICES, k: int = K, neighbour: int = NEIGHBOUR) -> int:
    """How far apart two overlapping spans can start."""
    return max(len(w) for *_, w in templates(base, notices)) + 2 * neighbour + k


def scan(docs: DataFrame, base=BASE, notices=NOTICES, k: int = K, neighbour: int = NEIGHBOUR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words and spans: array of (tid, label, exact, first word, last word, votes, cover)."""
    spark = docs.sparkSession
    grams = template_grams(spark, base, notices, k)
    hashes = ",".join(str(r.h) for r in grams.select("h").distinct().collect())  # as many as the templates have words
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    hits = F.expr(
        f"if(size(wh) >= {k}, transform(filter(sequence(1, size(wh) - {k - 1}), i -> xxhash64(slice(wh, i, {k})) IN ({hashes})), "
        f"i -> struct(i - 1 AS pos, xxhash64(slice(wh, i, {k})) AS h, array_join(slice(w, i, {k}), ' ') AS gram)), cast(array() AS array<struct<pos:int,h:bigint,gram:string>>))"
    )
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))
    row, template = ["rid", "doc_id", "n_words"], ["tid", "label", "exact", "need", "least"]
    votes = rows.select(*row, F.explode_outer("hits").alias("x")).select(*row, "x.pos", "x.h", "x.gram").join(F.broadcast(grams), ["h", "gram"], "left")
    # on one diagonal each template place stands once; rows without a hit go along with nulls, so that none is lost
    diagonals = votes.groupBy(*row, *template, (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_list("tpos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    near = F.when(F.col("exact"), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(-neighbour, neighbour + 1))))
    anchored = diagonals.withColumn("off", F.explode(F.when(F.col("tid").isNull(), F.array(F.lit(0))).otherwise(near))).withColumn("anchor", F.col("diag") + F.col("off"))
    merged = anchored.groupBy(*row, *template, "anchor").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"), F.min("lo").cast("long").alias("first"), (F.max("hi") + k - 1).cast("long").alias("last"))
    good = F.col("votes") >= F.col("least") * F.col("need")
    own = F.struct("votes", (-F.abs(F.col("last") - F.col("first"))).alias("short"), (-F.col("anchor")).alias("early"))
    # of the anchors that see one occurrence the one with most places, then the shortest span, then the first
    around = Window.partitionBy("rid", "tid").orderBy("anchor").rangeBetween(-2 * neighbour, 2 * neighbour)
    best = merged.withColumn("good", good).withColumn("own", F.when(F.col("good"), own)).withColumn("top", F.max("own").over(around))
    cover = F.col("votes") / F.col("need")
    best = best.select(*row, "first", F.when(F.col("good") & (F.col("exact") | (F.col("own") == F.col("top"))), F.struct("tid", "label", "exact", "first", "last", "votes", cover.alias("cover"))).alias("s"))
    far = reach(base, notices, k, neighbour)
    rivals = F.collect_list(F.when(~F.col("s.exact"), F.col("s"))).over(Window.partitionBy("rid").orderBy("first").rangeBetween(-far, far))
    beaten = F.exists("rivals", lambda y: (y["label"] != F.col("s.label")) & (y["cover"] > F.col("s.cover")) & (y["first"] <= F.col("s.last")) & (y["last"] >= F.col("s.first")))
    kept = best.withColumn("rivals", rivals).select(*row, F.when(F.col("s.exact") | ~beaten, F.col("s")).alias("s"))
    return kept.groupBy(*row).agg(F.array_sort(F.collect_list("s")).alias("spans"))


def report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: places of base phrases, their labels, all labels, and the best cover as score (0.0 without a span)."""
    r = scan(docs, **kw)
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return r.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))
