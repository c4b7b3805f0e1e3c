"""License scan: MinHash bands retrieve templates, shingle containment verifies.  DataFrame functions only.

A document's lower-cased words are read in windows of twice the template's
length, starting at every multiple of the template's length, so a copy of a
template lies whole in some window.  Window and template are sets of five-word shingles; a
band is one MinHash value, and ``BANDS`` of them miss a window whose Jaccard
similarity to the template is 1/6 or more with probability below 1e-12.

A band can only collide if the window holds the very shingle that is the
template's minimum, so windows without any such shingle are left out before the
signatures are computed; this loses no collision.  Retrieved windows are kept if
they contain at least ``CONTAINMENT`` of the template's shingles.

Cases: null, empty and shorter texts match nothing; repeated rows match each on
its own; an empty table gives no rows; templates below five words are refused;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import WORD

SHINGLE = 5
BANDS = 160
CONTAINMENT = 0.8

# Common one-line notices, headers, and the whole wording of short licenses without names.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0-notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "bsd-disclaimer": (
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "gpl-header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl-header": (
        "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."
    ),
    "agpl-header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle(words: Column, start: Column) -> Column:
    """Hash of the shingle that starts at the one-based place."""
    return F.xxhash64(F.concat_ws(" ", F.slice(words, start, SHINGLE)))


def _shingles(words: Column) -> Column:
    number = F.size(words) - SHINGLE + 1
    starts = F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: _shingle(words, i)))


def _signature(shingles: Column) -> Column:
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """Name, number of words, shingles, signature and the shingles that are minima; a row a template."""
    table = spark.createDataFrame(list(templates.items()), "template string, _text string")
    rows = table.select("template", words_of(F.col("_text")).alias("_words")).select(
        "template", F.size("_words").alias("t_words"), "_words", _shingles(F.col("_words")).alias("t_shingles")
    )
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    least = F.transform(
        seeds, lambda s: F.array_min(F.transform("t_shingles", lambda h: F.struct(F.xxhash64(h, s).alias("x"), h.alias("h"))))
    )
    return rows.withColumn("_least", least).select(
        "template", "t_words", "t_shingles", F.transform("_least", lambda m: m["x"]).alias("t_signature"),
        F.array_distinct(F.transform("_least", lambda m: m["h"])).alias("t_minima"),
        F.transform(F.sequence(F.lit(1), F.size("_words") - SHINGLE + 1), lambda i: F.element_at("_words", i)).alias("t_firsts"),
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, template, windows, first_word, containment`` (best window) of every document with a match."""
    templates = TEMPLATES if templates is None else templates
    known = template_table(docs.sparkSession, templates)
    parts = known.select("t_words", "t_minima", "t_firsts").collect()  # one row a template
    if any(r[0] < SHINGLE for r in parts):
        raise ValueError(f"a template needs {SHINGLE} words")
    minima = sorted({h for r in parts for h in r[1]})
    firsts = sorted({w for r in parts for w in r[2]})
    # the generator keeps the words from being cut anew inside every expression that uses them
    words = docs.select(F.col("doc_id").cast("long"), F.explode(F.array(words_of(F.col("text")))).alias("words"))
    number = F.size("words") - SHINGLE + 1
    starts = F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(
        starts,
        lambda i: F.element_at("words", i).isin(firsts) & _shingle(F.col("words"), i).isin(minima),
    )
    found = words.withColumn("hits", hits).where(F.size("hits") > 0)
    stride = F.col("t_words")
    numbers = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("hits", lambda i: F.array_contains("t_minima", _shingle(F.col("words"), i))),
                lambda i: F.array(F.floor((i - 1) / stride) - 1, F.floor((i - 1) / stride)),
            )
        )
    )
    shared = F.broadcast(known.withColumn("_any", F.explode("t_minima")))
    hashes = F.array_distinct(F.transform("hits", lambda i: _shingle(F.col("words"), i)))
    retrieved = found.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hash", F.explode(hashes))
    # a row of a document and template, whichever minimum led to it
    retrieved = retrieved.join(shared, F.col("_hash") == F.col("_any")).where(
        F.col("_hash") == F.element_at(F.array_intersect(hashes, "t_minima"), 1)
    )
    candidates = retrieved.withColumn("_n", F.explode(numbers)).where("_n >= 0").withColumn(
        "window", F.slice("words", (F.col("_n") * stride + 1).cast("int"), F.col("t_words") * 2)
    )
    banded = candidates.withColumn("shingles", _shingles(F.col("window"))).where(
        F.exists(F.arrays_zip(_signature(F.col("shingles")).alias("a"), F.col("t_signature").alias("b")), lambda p: p["a"] == p["b"])
    )
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    return (
        banded.withColumn("share", share).where(F.col("share") >= CONTAINMENT)
        .groupBy("_row", "doc_id", "template").agg(
            F.count("*").alias("windows"), (F.min("_n") * F.first("t_words")).cast("long").alias("first_word"),
            F.max("share").alias("containment"),
        ).drop("_row")
    )
