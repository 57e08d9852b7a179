"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word k-gram hashes of the documents are joined with the templates' (a fixed table, broadcast). A hit at document
word i and template word j votes for the diagonal i - j; diagonals of a few words' difference are one occurrence with insertions or
deletions, and an occurrence counts where enough of the template's k-grams stand in it, word for word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further phrases and license texts, and the labels that this scan adds.
MORE_PHRASES = {
    "all rights reserved": "all-rights-reserved",
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "bsd license": "bsd",
}
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
}
SHORT, LONG = 2, 4  # words of a k-gram for phrases and for texts
SLACK = 3  # words between diagonals of one occurrence of a text; phrases must stand as they are
LEAST = 0.6  # share of a text's k-grams


def template_rows() -> list[tuple[str, bool, int, int, int, list[str]]]:
    """(label, base, words in a k-gram, k-grams of the template, place, the k-gram) of all templates."""
    out = []
    for text, label, base in [(t, y, True) for t, y in PHRASES.items()] + [(t, y, False) for t, y in MORE_PHRASES.items()] + [(t, y, False) for y, t in TEXTS.items()]:
        words = re.findall("[0-9a-z]+", text.lower())
        k = SHORT if label not in TEXTS else LONG
        n = len(words) - k + 1
        out += [(label, base, k, n, j, words[j : j + k]) for j in range(n)]
    return out


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. lower() also changes other letters, which no template has; only the Kelvin sign would become one of a-z."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """The templates' k-grams: their words, and the hash of the first two."""
    rows = spark.createDataFrame(template_rows(), "label string, base boolean, k int, grams int, j int, words array<string>")
    return rows.select("label", "base", "k", "grams", "j", "words", F.xxhash64(*(F.get("words", F.lit(o)) for o in range(SHORT))).alias("t2"))


def occurrences(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, label, base, first and last word and coverage (0 to 1) of every occurrence of a template's k-grams.

    Every pair of neighbouring words is hashed; those that no template has go before the join, those that are left are joined with
    the templates' places by their hash, and a place votes only where the k-gram's words are the template's. Null texts have no words. Rows
    that repeat an id and a text count once.
    """
    known = templates(docs.sparkSession)  # a fixed table of some hundred rows
    hashes = [r.t2 for r in known.select("t2").distinct().collect()]
    words = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("w")).where(F.size("w") >= SHORT)
    two = lambda i: F.xxhash64(*(F.get("w", i + o) for o in range(SHORT)))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - SHORT), lambda i: two(i).isin(hashes))
    rolled = words.select("doc_id", "text_hash", F.explode(F.transform(places, lambda i: F.struct(i.alias("i"), F.slice("w", i + 1, LONG).alias("g")))).alias("p"))
    rolled = rolled.select("doc_id", "text_hash", "p.i", "p.g", F.xxhash64(*(F.get("p.g", F.lit(o)) for o in range(SHORT))).alias("h2"))
    hits = rolled.join(F.broadcast(known), (F.col("h2") == F.col("t2")) & (F.slice("g", F.lit(1), F.col("k")) == F.col("words")))
    votes = hits.groupBy("doc_id", "text_hash", "label", "base", "k", "grams", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last"))
    order = Window.partitionBy("doc_id", "text_hash", "label").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("k") == LONG, SLACK).otherwise(0)
    merged = votes.withColumn("run", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order))
    spans = merged.groupBy("doc_id", "text_hash", "label", "base", "k", "grams", "run").agg(F.min("first").alias("first"), (F.max("last") + F.max("k") - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("votes"))
    return spans.select("doc_id", "text_hash", "label", "base", "k", "first", "last", (F.col("votes") / F.col("grams")).alias("coverage"))


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    A phrase counts where all of its words stand consecutively, a license text where LEAST of its k-grams stand in one occurrence.
    score is the largest coverage of any text, 1 with a phrase, 0 where nothing was found. Null and empty texts have no words; a null id
    is an id like another; repeated rows give repeated results; other columns are not looked at.
    """
    spans = occurrences(docs, text, id_column)
    counts = (F.col("k") == LONG) & (F.col("coverage") >= LEAST) | (F.col("coverage") == 1)
    score = F.when(counts | (F.col("k") == LONG), F.col("coverage"))
    found = spans.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(
        F.count_if(counts & F.col("base")).alias("n_base"),
        F.min(F.when(counts & F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(counts & F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts & F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("label")))), ",").alias("labels"),
        F.max(score).alias("score"),
    )
    sizes = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    both = sizes.join(found, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
