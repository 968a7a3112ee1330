"""License scans by diagonal voting, in DataFrame functions only.

All word k-grams (k = 3) of the documents are joined to the k-grams of the templates on
their hash and, for exactness, on the words. The templates are the constants below, a
few hundred k-grams whatever the input, so that side is broadcast and documents are
neither sorted nor shuffled by k-gram; the only shuffle moves the matches, with one
length row per document.

A match votes for its diagonal, document position less template position, so the votes
of one copy of a template meet there, whatever stray matches stand between them. They are
counted by (row, template, diagonal). Diagonals of a template that are at most `DRIFT`
apart (an inserted or lost word shifts the rest of a text) merge into one span. A span is
verified by the share of the template's words that its matches cover: base phrases have to
match whole on one diagonal, longer texts by `COVER`. A longer text stays unless a span
that overlaps it has more votes; spans meet in blocks of `GAP` words for that.

The base phrases are templates like the rest; a place of one is a diagonal on which all
its k-grams match. Labels of longer texts come on top and never remove a base label.

Defined results: words are runs of ASCII digits and letters and of all non-ASCII
characters, A-Z lower-cased; null text is empty, and a document without matches has no
labels, score 0 and null first and last words; texts of fewer words than k have no matches. Repeated rows each get their result, null
ids included. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_words, materialize, shifted

K = 3
DRIFT = 3
GAP = 64
COVER = 0.75
BROADCAST_GRAMS = 100_000

#: phrase and label; every place where the words stand consecutively counts
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: label and text of common license headers and whole licenses, in the words that the scan sees
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)


def templates(spark: SparkSession, base=BASE, texts=TEMPLATES, k: int = K) -> DataFrame:
    """(h, gram, template, label, base, at, size): the k-grams of all templates.

    Broadcast while they are at most `BROADCAST_GRAMS`.
    """
    rows = []
    for number, (label, text, is_base) in enumerate([(label, text, True) for text, label in base] + [(label, text, False) for label, text in texts]):
        words = text.split()
        rows += [(words[i : i + k], number, label, is_base, i, len(words)) for i in range(len(words) - k + 1)]
    rows.append(([""] * k, -1, "", False, 0, 0))  # meets the length row of every document
    df = spark.createDataFrame(rows, "w array<string>, template int, label string, base boolean, at int, size int")
    df = df.select(F.xxhash64(*[F.col("w")[i] for i in range(k)]).alias("h"), F.array_join("w", " ").alias("gram"), "template", "label", "base", "at", "size")
    return F.broadcast(df) if len(rows) <= BROADCAST_GRAMS else df


def votes(docs: DataFrame, base=BASE, texts=TEMPLATES) -> DataFrame:
    """One row per k-gram match and one (template -1, pos = n_words) per document.

    row numbers the input rows, and is fixed here because the votes are written.
    """
    # beyond the last word stand empty ones, so that the position n_words has a k-gram of them
    words = F.concat(ascii_words(F.col("text")), F.array(*[F.lit("")] * K))
    padded = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("w"))
    grams = F.arrays_zip(F.col("w").alias("a"), shifted(F.col("w"), 1).alias("b"), shifted(F.col("w"), 2).alias("c"))
    exploded = padded.select("doc_id", "row", F.posexplode(grams).alias("pos", "g"))
    hashed = exploded.select("doc_id", "row", "pos", F.xxhash64("g.a", "g.b", "g.c").alias("h"), F.concat_ws(" ", "g.a", "g.b", "g.c").alias("has"))
    met = materialize(hashed.join(templates(docs.sparkSession, base, texts), "h"), "license-votes")
    return met.where("has = gram").select("doc_id", "row", "pos", "template", "label", "base", "at", "size")


def spans(found: DataFrame, k: int = K) -> DataFrame:
    """Verified spans (row, template, label, base, start, last, votes, share) of the votes."""
    of = ["row", "template", "label", "base", "size"]
    # one diagonal holds at most as many votes as the template has k-grams
    lines = (
        found.where("template >= 0")
        .withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy(*of, "diagonal")
        .agg(F.collect_set("at").alias("ats"))
        .where(~F.col("base") | (F.size("ats") == F.col("size") - k + 1))
    )
    by_diagonal = W.partitionBy("row", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(by_diagonal)
    fresh = before.isNull() | F.col("base") | (F.col("diagonal") - before > DRIFT)
    runs = lines.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_diagonal))
    merged = runs.groupBy(*of, "run").agg(
        F.min(F.col("diagonal") + F.array_min("ats")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("ats") + k - 1).alias("last"),
        F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    whole = (
        merged.select("row", "template", "label", "base", "start", "last", F.size("ats").alias("votes"), (covered / F.col("size")).alias("share"))
        .where(F.col("base") | (F.col("share") >= COVER))
    )
    # a longer text goes if one that overlaps it has more votes: its span meets all those in its blocks
    sides = whole.select("row", "base", "start", "last", "votes", F.explode(F.sequence(F.floor(F.col("start") / GAP), F.floor(F.col("last") / GAP))).alias("block"))
    best = sides.where("NOT base").groupBy("row", "block").agg(F.collect_set(F.struct("start", "last", "votes")).alias("near"))
    lost = (
        sides.where("NOT base")
        .join(best, ["row", "block"])
        .where(F.exists("near", lambda x: (x["votes"] > F.col("votes")) & (x["start"] <= F.col("last")) & (x["last"] >= F.col("start"))))
        .select("row", "base", "start", "last", "votes")
        .distinct()
    )
    return whole.join(lost, ["row", "base", "start", "last", "votes"], "left_anti")


def scan(docs: DataFrame, base=BASE, texts=TEMPLATES) -> DataFrame:
    """One row per document: n_words, places of base phrases, labels, score and spans.

    The score is the largest verified share of a template, 1 for a whole base phrase.
    spans lists all verified spans as structs (start, last, label, base, share), in
    words from 0, both ends included.
    """
    found = votes(docs, base, texts)
    start = F.when(F.col("base"), F.col("start"))
    label = F.when(F.col("base"), F.col("label"))
    per_row = spans(found).groupBy("row").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.sort_array(F.collect_set(label)).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "last", "label", "base", "share"))).alias("spans"),
    )
    lengths = found.where("template = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return lengths.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
