"""License scan by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined to the positions at
which license templates hold the same k-gram. A match at word ``p`` of the text
and ``t`` of the template votes for diagonal ``p - t``. Votes are counted by
diagonal, diagonals are joined where text has words put in or left out, and the
spans they mark are verified by how much of the template they cover. Diagonals of
a short template are merged when they are neighbours. A long template may hold a
k-gram twice, so the runs of its diagonals are chained instead: the longest chain
in order of both text and template, whatever other runs lie between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
#: Diagonals this close, with spans this near, belong to one occurrence of a short template.
MAX_SHIFT, MAX_GAP = 4, 12
#: Share of a template's k-grams that an occurrence must hold; short templates must be whole.
MIN_COVERAGE, SHORT_WORDS = 0.7, 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "array<struct<first:int,last:int,covered:int>>"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every exact place counts as a base place.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Opening or characteristic passages of public licenses and the short notices that name them.
TEMPLATES = (
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("bsd", "under the bsd license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
)


def words_of(text: Column) -> Column:
    """A-Z lowered, then maximal runs of digits, letters and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def _grams(rows: DataFrame) -> DataFrame:
    """One row per k-gram of ``words`` (``place``, ``hash``), and one of a null hash at the end of each row's words."""
    gram = F.xxhash64(*[F.get("words", F.col("place") + j) for j in range(GRAM)])
    return rows.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("place", "word")).withColumn(
        "hash", F.when(F.col("place") <= F.col("n_words") - GRAM, gram)
    )


def _slice(at: Column) -> Column:
    return F.array(*[F.get("words", at + j) for j in range(GRAM)])


def template_positions(spark: SparkSession) -> DataFrame:
    """``hash, gram, template, label, base, at, n_grams, least`` of each template's k-grams; its size is fixed by the lists above."""
    rows = [(i, label, i < len(BASE_PHRASES), text) for i, (label, text) in enumerate(BASE_PHRASES + TEMPLATES)]
    spelled = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    n_grams = F.col("n_words") - (GRAM - 1)
    least = F.when(F.col("n_words") <= SHORT_WORDS, n_grams).otherwise(F.ceil(n_grams * MIN_COVERAGE).cast("int"))
    return _grams(spelled).where("hash is not null").select("hash", _slice(F.col("place")).alias("gram"), "template", "label", "base", F.col("place").alias("at"), n_grams.alias("n_grams"), least.alias("least"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chains(runs: Column) -> Column:
    """``best, found`` of one long template in one text: most k-grams in order, and (first, last, covered) of its occurrences.

    ``runs`` are the maximal runs (last, diagonal, first) of its diagonals. A run goes
    on from an earlier one with what lies behind that one's end in text and template,
    at most a template's length further on in the text. A chain through runs never
    gains by leaving one before its end, so ends are all that is kept, and those too
    far back to be reached are dropped: what is kept does not grow with the text.
    A chain that has half of what an occurrence needs inside the last occurrence found belongs to that one.
    """
    gap = F.greatest(F.col("n_grams"), F.lit(MAX_GAP))
    half = F.ceil(F.col("least") / 2).cast("int")

    def entry(end: Column, run: Column) -> Column:
        return F.greatest(run["first"], end["last"] + 1, end["at"] + 1 + run["diagonal"])

    def reached(ends: Column, run: Column) -> Column:
        going = F.filter(ends, lambda e: (entry(e, run) <= run["last"]) & (entry(e, run) - e["last"] <= gap))
        middle = lambda more, start: (start + half - 1 - more).alias("middle")
        longer = F.transform(
            going,
            lambda e: F.struct(
                (e["covered"] + run["last"] - entry(e, run) + 1).alias("covered"), e["first"].alias("first"), F.when(e["covered"] >= half, e["middle"]).otherwise(middle(e["covered"], entry(e, run))).alias("middle")
            ),
        )
        return F.array_max(F.concat(F.array(F.struct((run["last"] - run["first"] + 1).alias("covered"), run["first"].alias("first"), middle(F.lit(0), run["first"]))), longer))

    def kept(found: Column, run: Column, top: Column) -> Column:
        chain = F.array(F.struct(top["first"].alias("first"), run["last"].alias("last"), top["covered"].alias("covered")))
        final = F.get(found, F.size(found) - 1)
        same = top["middle"] <= final["last"]
        longer = F.when(top["covered"] > final["covered"], F.concat(F.slice(found, F.lit(1), F.size(found) - 1), chain)).otherwise(found)
        return F.when(top["covered"] < F.col("least"), found).when((F.size(found) > 0) & same, longer).otherwise(F.concat(found, chain))

    def step(state: Column, run: Column) -> Column:
        def add(ends: Column, top: Column) -> Column:
            end = F.struct(run["last"].alias("last"), (run["last"] - run["diagonal"]).alias("at"), top["first"].alias("first"), top["covered"].alias("covered"), top["middle"].alias("middle"))
            return F.struct(F.concat(ends, F.array(end)).alias("ends"), F.greatest(state["best"], top["covered"]).alias("best"), kept(state["found"], run, top).alias("found"))

        near = F.filter(state["ends"], lambda e: e["last"] >= run["last"] - gap - F.col("n_grams"))
        return _let(near, lambda ends: _let(reached(ends, run), lambda top: add(ends, top)))

    none = F.from_json(F.lit("{\"ends\": [], \"best\": 0, \"found\": []}"), f"ends array<struct<last:int,at:int,first:int,covered:int,middle:int>>, best int, found {_FOUND}")
    return F.aggregate(F.array_sort(runs), none, step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``n_base`` counts every place where a base phrase stands word for word,
    ``first_word`` and ``last_word`` are the first and last such start (null
    without any). ``labels`` adds what templates cover; ``score`` is the largest
    covered share of any template (1 for a base phrase, 0 without a match), and
    ``spans`` lists (label, first word, end word, share) of all occurrences.
    Null and empty texts have no words and no labels; very long texts are scanned
    whole; of templates that tie all labels count; repeated rows are scanned one
    by one; an empty table gives an empty result; other columns are ignored.

    Only matching k-grams and one closing row per text are shuffled, by row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "words", F.size("words").alias("n_words")
    )
    grams = _grams(rows)
    templates = F.broadcast(template_positions(spark))
    hits = (
        grams.join(templates, (grams["hash"] == templates["hash"]) & (_slice(grams["place"]) == templates["gram"]), "left")
        .where(F.col("template").isNotNull() | (F.col("place") == F.col("n_words")))
        .select("row", "doc_id", "n_words", "place", "template", "label", "base", "at", "n_grams", "least")
        .repartition("row")
    )
    diagonals = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "least", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats")
    )
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > MAX_SHIFT) | (F.col("first") - reach > MAX_GAP)
    # a long template may hold a k-gram twice: all its diagonals go to one group, to be chained by their runs
    starts, ends = (F.array_sort(F.array_except("ats", F.transform("ats", lambda at: at + step))) for step in (1, -1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct((F.col("diagonal") + e).alias("last"), "diagonal", (F.col("diagonal") + s).alias("first")))
    long = F.col("n_grams") + (GRAM - 1) > SHORT_WORDS
    merged = (
        diagonals.withColumn("new", F.when(F.col("base") | F.coalesce(apart, F.lit(True)), 1).otherwise(0))
        .withColumn("occurrence", F.when(long, 0).otherwise(F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        .withColumn("runs", F.when(long, runs))
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "least", "occurrence")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.flatten(F.collect_list("runs")).alias("runs"))
        .withColumn("chains", F.when(long, _chains(F.col("runs"))))
        .withColumn("covered", F.coalesce("chains.best", "covered"))
        .withColumn("ok", F.col("covered") >= F.col("least"))
        .withColumn("found", F.when(F.col("ok"), F.coalesce("chains.found", F.array(F.struct("first", "last", "covered")))).otherwise(F.array().cast(_FOUND)))
    )
    is_base = F.col("base") & F.col("ok")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return (
        merged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(is_base).alias("n_base"),
            F.min(F.when(is_base, F.col("first").cast("long"))).alias("first_word"),
            F.max(F.when(is_base, F.col("first").cast("long"))).alias("last_word"),
            joined(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(F.col("ok"), F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.col("covered") / F.col("n_grams")), F.lit(0.0)).alias("score"),
            F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda c: F.struct(c["first"].alias("first"), (c["last"] + GRAM).alias("end"), "label", (c["covered"] / F.col("n_grams")).alias("share")))))).alias("spans"),
        )
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )
