"""License scans by diagonal voting.

Every rolling K-gram of a text's words is joined with the places of the same gram in license templates. A match at
text place p and template place t votes for the diagonal p - t; neighbouring diagonals, as a word
more or less makes them, are merged, and a span that holds a share of the template's grams is verified word by word: it is aligned with
its template by a table of edits, which also counts the words that turn a grant into a refusal, put in, left out or just before. In families of licenses that a word changes, a span must have just the
changing words of its template. Native functions only.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, DRIFT, COVERAGE = 3, 4, 0.6
#: Edits of a span as a share of its template's words, words around a gram that are kept for the alignment, words before a span in which a refusal counts.
EDITS, REACH, BEFORE = 0.4, 12, 2

# The base phrases with their labels, and the wording of public license notices.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("reserved", "all rights reserved"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
]
# Identifiers of the SPDX list, by label.
SPDX = {
    "agpl": ["agpl 3 0 only", "agpl 3 0 or later"], "apache": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "cc-by": ["cc by 4 0"], "cc-by-nc": ["cc by nc 4 0"], "cc-by-sa": ["cc by sa 4 0"], "cc0": ["cc0 1 0"], "epl": ["epl 2 0"],
    "gpl": ["gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later"], "isc": ["isc"], "lgpl": ["lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later"], "mit": ["mit"], "mpl": ["mpl 2 0"], "unlicense": ["unlicense"],
}
TEMPLATES += [(label, f"spdx license identifier {name}") for label, names in SPDX.items() for name in names]
#: Words that refuse what a notice grants; put into a span, left out of it, or just before it, they make it no notice.
REFUSALS = "not no never nor neither without cannot unless except isn aren doesn don won wasn".split()
_CC, _APART = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}, {"nc": "non commercial", "sa": "share alike", "nd": "no derivatives"}
for _parts in (["nc"], ["sa"], ["nd"], ["nc", "sa"], ["nc", "nd"]):
    _label = "-".join(["cc-by", *_parts])
    for _spelled in (_CC, _APART):
        TEMPLATES.append((_label, f"this work is licensed under a creative commons attribution {' '.join(_spelled[x] for x in _parts)} 4 0 international license"))
    TEMPLATES += [(_label, f"licensed under cc by {' '.join(_parts)} 4 0")] * (_parts != ["nc"])

#: Words that change a license of the family, by what they mean; a span must have just those of its template.
CHANGES = {
    "cc-by": {"nc": "nc noncommercial commercial", "sa": "sa sharealike alike", "nd": "nd noderivatives noderivs derivatives derivs"},
    "gpl": {"lesser": "lesser library", "affero": "affero"},
}
FAMILIES = {"agpl": "gpl", "gpl": "gpl", "lgpl": "gpl"}
MEANS = {w: f"{family}:{code}" for family, codes in CHANGES.items() for code, words in codes.items() for w in words.split()}


def family_of(label: str) -> str:
    return FAMILIES.get(label, "cc-by" if label.startswith("cc-by") else "")


def changes_of(label: str, words: list[str]) -> str:
    """The sorted meanings of a template's words that change a license of its family."""
    return ",".join(sorted({MEANS[w] for w in words if MEANS.get(w, "").startswith(f"{family_of(label)}:")}))


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def template_grams(k: int = K) -> list[tuple[int, str, int, str, int, int, str, str]]:
    """(template, label, place, gram, hash, grams of the template, family, changing words)."""
    out = []
    for n, (label, words) in enumerate((label, t.split()) for label, t in TEMPLATES):
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        out += [(n, label, i, g, signed(xxhash.xxh64_intdigest(g.encode(), 42)), len(grams), family_of(label), changes_of(label, words)) for i, g in enumerate(grams)]
    return out


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def features(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """One row per row: doc_id, h (the text's hash), n_words, base matches, `hits`, the grams that some template has, and `near`, the words around them.

    Null texts count as empty; texts without a word or a hit have empty lists, repeated rows stay, an empty table gives an empty one.
    """
    phrase = f" ({'|'.join(PHRASES)})(?= )"
    hashes = sorted({g[4] for g in template_grams(k)})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    rows = rows.withColumn("found", F.regexp_extract_all("joined", F.lit(phrase), F.lit(1)))
    rows = rows.withColumn("parts", F.when(F.size("found") > 0, F.split("joined", phrase, -1)))
    gram = lambda i: F.array_join(F.slice("words", i + 1, F.lit(k)), " ")
    hash_ = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("words", i + j) for j in range(k)]))
    # the join below is an inner one, so grams that no template has can go before they become rows
    places = F.when(F.col("n_words") >= k, F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - k), lambda i: hash_(i).isin(hashes)))
    around = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(i - REACH, F.lit(0)), F.least(i + k + REACH, F.col("n_words").cast("int")) - 1)))))
    last = F.element_at("parts", -1)
    return rows.select(
        "doc_id", "h", "n_words", F.size("found").cast("long").alias("n_base"),
        _spaces(F.element_at("parts", 1)).cast("long").alias("first_word"),
        F.when(F.size("found") > 0, F.col("n_words") - (_spaces(last) - 1) - (_spaces(F.element_at("found", -1)) + 1)).cast("long").alias("last_word"),
        F.array_distinct(F.transform("found", lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv]), p))).alias("base"),
        F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.struct(i.alias("place"), hash_(i).alias("hash"), gram(i).alias("gram"))).alias("hits"),
        F.when(F.size(places) > 0, F.transform(around, lambda i: F.struct(i.alias("place"), F.get("words", i).alias("word")))).alias("near"),
    )


def spans(rows: DataFrame, k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, h, label, start, end, coverage): verified license spans, in words. Rows of one doc_id and text have one set of spans; no hits, no spans."""
    # the templates are a fixed list of a few hundred grams
    grams = F.broadcast(rows.sparkSession.createDataFrame(template_grams(k), "template int, label string, at int, gram string, hash long, grams int, family string, changes string"))
    hits = rows.filter(F.size("hits") > 0).select("doc_id", "h", F.explode("hits").alias("hit")).select("doc_id", "h", "hit.*")
    met = hits.join(grams, ["hash", "gram"]).withColumn("diagonal", F.col("place") - F.col("at"))
    key = ["doc_id", "h", "template"]
    about = ["label", "grams", "family", "changes"]
    lines = met.groupBy(*key, *about, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    by_diagonal = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift, F.lit(True))
    lines = lines.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    bands = lines.groupBy(*key, *about, "band").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("low").alias("start"), (F.max("high") + k).alias("end"))
    share = F.size("ats") / F.col("grams")
    bands = bands.withColumn("coverage", share).filter(F.col("coverage") >= coverage)
    # words that were put in may have cut a template's beginning or end off
    head, tail = F.array_min("ats"), F.col("grams") - 1 - F.array_max("ats")
    bands = bands.withColumns({"low": F.col("start") - head, "high": F.col("end") + tail, "slack": F.lit(2 * drift), "headless": (head > 0).cast("int"), "tailless": (tail > 0).cast("int")})
    texts = rows.filter(F.size("hits") > 0).groupBy("doc_id", "h").agg(F.first("near").alias("near"))
    texts = texts.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "near")
    met = bands.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    words = F.array(*[F.array(*map(F.lit, t.split())) for _, t in TEMPLATES])
    met = met.withColumn("wanted", F.element_at(words, F.col("template") + 1))
    within = lambda a, z: F.filter("near", lambda x: (x.place >= a) & (x.place < z))
    meaning = F.create_map(*[F.lit(x) for kv in MEANS.items() for x in kv])
    wide = within(F.col("low") - F.col("slack") * F.col("headless"), F.col("high") + F.col("slack") * F.col("tailless"))
    own = F.filter(F.transform(wide, lambda x: F.when(x.word.isin(list(MEANS)), F.element_at(meaning, x.word))), lambda m: F.coalesce(m.startswith(F.concat("family", F.lit(":"))), F.lit(False)))
    met = met.filter((F.col("family") == "") | (F.array_join(F.array_sort(F.array_distinct(own)), ",") == F.col("changes")))
    span = F.transform(within(F.col("low"), F.col("high")), lambda x: x.word)
    refused = F.exists(within(F.col("low") - BEFORE, F.col("low")), lambda x: x.word.isin(REFUSALS))
    met = met.withColumn("edits", edits(span, F.col("wanted"))).filter((F.col("edits") % 1000 == 0) & ~refused & (F.floor(F.col("edits") / 1000) <= EDITS * F.size("wanted")))
    return met.select("doc_id", "h", "label", "start", "end", "coverage")


def edits(span: Column, wanted: Column) -> Column:
    """1000 times the fewest words to put in, leave out or replace to make one list of words of the other, and among such ways the fewest refusing words concerned.

    One row of the table of edits is carried from word to word of the span.
    """
    cost = lambda w: F.lit(1000) + w.isin(REFUSALS).cast("int")
    first = F.aggregate(wanted, F.array(F.lit(0)), lambda row, t: F.concat(row, F.array(F.element_at(row, -1) + cost(t))))

    def next_row(row: Column, w: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            t = F.element_at(wanted, j)
            kept = F.element_at(row, j) + F.when(w == t, 0).otherwise(1000 + (w.isin(REFUSALS) | t.isin(REFUSALS)).cast("int"))
            return F.concat(made, F.array(F.least(kept, F.element_at(row, j + 1) + cost(w), F.element_at(made, -1) + cost(t))))

        return F.aggregate(F.sequence(F.lit(1), F.size(wanted)), F.array(F.element_at(row, 1) + cost(w)), cell)

    return F.element_at(F.aggregate(span, first, next_row), -1)


def scanned(docs: DataFrame, text: str = "text", k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """For each row doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty. doc_ids may be null; rows with one doc_id keep results of their own texts, repeated rows stay, an empty table gives
    an empty one. score is the best coverage of a template, 1 where a base phrase stands. Other columns are ignored.
    """
    rows = written(features(docs, text, k), "license-features")
    found = spans(rows, k, drift, coverage).groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "more", "best")
    met = rows.join(found, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.h == F.col("__h")), "left")
    none = F.array().cast("array<string>")
    return met.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
