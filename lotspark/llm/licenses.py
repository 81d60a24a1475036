"""License phrases and notices by diagonal voting, in Spark SQL alone.

All rolling two-word hashes of a text join the positions that they have in the
templates. Place in text less place in template is a diagonal; a template that
occurs puts all its hits on one diagonal, with a word added or left out on
neighbouring ones. Hits are summed by diagonal, neighbouring diagonals merged,
and the merged spans verified: a short phrase has to be there word for word, of a
notice ``NOTICE_SHARE`` of the word pairs, within a span of about its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Wordings of public license notices, lower-cased, without punctuation.
NOTICES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "gpl-notice": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
}
NOTICE_SHARE = 0.8
#: Diagonals at most so far apart belong to one occurrence of a notice.
NEAR = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, list[str]]) -> DataFrame:
    """(hash, template, label, base, tpos, pairs): one row per word pair; as many rows as the templates have words."""
    rows = [(i, label, text, base) for i, (label, text, base) in enumerate([(k, v, True) for k, v in phrases.items()] + [(k, t, False) for k, v in notices.items() for t in v])]
    if any(not 2 <= len(r[2].split()) <= 63 for r in rows):
        raise ValueError("a template has 2 to 63 words")
    made = spark.createDataFrame(rows, "template int, label string, text string, base boolean").withColumn("w", F.split("text", " "))
    pairs = made.select("template", "label", "base", F.size("w").alias("words"), F.expr("posexplode(transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1])))").alias("tpos", "hash"))
    return F.broadcast(pairs)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """Per id of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` lists every verified occurrence (start, words, label, base, share),
    from the first on; ``score`` is the largest share, 0 without a span.

    * null, empty and wordless texts: no words, no spans, null first and last word
    * rows that repeat an id count as one document with their places united
    * other columns are ignored; an empty table gives an empty result
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_col).alias("_id"), F.regexp_extract_all(low, F.lit(WORD), 0).alias("w"))
    # the last word's hash stands alone and matches no pair; it keeps a row for every text with words
    grams = F.expr("zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> xxhash64(a, b))")
    # the words themselves end here: explode would copy whatever else is read of the row to each of its pairs
    paired = words.select("_id", F.size("w").cast("long").alias("n_words"), grams.alias("grams"))
    rolled = paired.select("_id", "n_words", F.posexplode_outer("grams").alias("pos", "hash"))
    hits = rolled.join(_templates(docs.sparkSession, phrases, notices), "hash", "left").where("template is not null or coalesce(pos, 0) = 0")
    voted = hits.groupBy("_id", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("words").alias("words"),
        F.expr("bit_or(shiftleft(1L, tpos))").alias("mask"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    along = W.partitionBy("_id", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR) | (F.col("low") - F.max("high").over(along.rowsBetween(W.unboundedPreceding, -1)) > NEAR + 2), 1).otherwise(0)
    marked = voted.withColumn("run", F.sum(apart).over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = marked.groupBy("_id", "template", "run").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("words").alias("words"),
        F.expr("bit_count(bit_or(mask))").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    share = F.col("pairs") / (F.col("words") - 1)
    size = F.col("high") + 2 - F.col("low")
    right = F.when(F.col("base"), share == 1).otherwise((share >= NOTICE_SHARE) & (size <= F.col("words") * 1.25 + NEAR))
    span = F.when(right, F.struct(F.col("low").cast("long").alias("start"), size.cast("long").alias("words"), "label", "base", share.alias("share")))
    per = spans.groupBy("_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"))
    base = "filter(spans, s -> s.base)"
    return per.select(
        F.col("_id").alias(id_col), "n_words", F.expr(f"cast(size({base}) as long)").alias("n_base"),
        F.expr(f"array_min(transform({base}, s -> s.start))").alias("first_word"), F.expr(f"array_max(transform({base}, s -> s.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, s -> s.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(spans, s -> s.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(spans, s -> s.share)), 0D)").alias("score"), "spans",
    )
