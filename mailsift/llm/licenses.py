"""License scans with DataFrame functions only.

Words are ``[a-z0-9]+`` of the lower-cased text, shingles five words. Texts are cut into overlapping windows of ``SIZE``
shingles at every ``STRIDE``-th shingle, templates into windows at every shingle; each window has ``BANDS`` minimal hashes, each
a band of its own. A template of one shingle has similarity 1/4 to each of the two windows around it and is retrieved with
probability 1 - 0.75**32 = 0.9999; a longer one shares a window of similarity 0.6 or more (1 - 0.4**16 > 0.999999).
Only retrieved pairs of text and template are verified, exactly: the share of the template's shingles that the text holds
within one stretch of the template's length (and a slack for inserted words) must be ``LEAST``, and all shingles with a number
must be there, so another version of a license is no match.

Templates are a bounded table (a few thousand notices); their bands are broadcast only if they are at most ``BROADCAST`` rows,
beyond it the join is a shuffle. Defined cases: null, empty and short texts match nothing; templates under five words are
left out; rows with equal id and text give one result, null ids too; other columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE, SIZE, STRIDE, BANDS = 5, 4, 2, 16
LEAST = 0.8
BROADCAST = 500_000

# Customary license notices.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "gpl-2.0-or-later": "either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-or-later": "either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                   "General Public License as published by the Free Software Foundation",
    "agpl-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                      "not use this file except in compliance with the License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                      "2.0 which is available at",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                 "the following conditions are met",
    "bsd-source-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                         "following disclaimer.",
    "bsd-file-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
                  "held liable for any damages arising from the use of this software.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-3.0-notice": "Licensed under CC BY 3.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-3.0-notice": "Licensed under CC BY-SA 3.0.",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
}

def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template string, text string")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add an array column as the output of a generator, so that lambdas read it and never compute it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def shingles(df: DataFrame, text_col: str = "text", flags: bool = False) -> DataFrame:
    """``df`` without the text, with ``h``: the hashes of the text's shingles in order; ``flags`` adds ``numeric``: whether a word
    of the shingle is a number."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    out = _once(df, "w", words).drop(text_col).where(F.size("w") >= SHINGLE)
    h = F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)),
                    lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(SHINGLE)]))
    if flags:
        out = _once(out, "numeric", F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)),
                                                lambda i: F.exists(F.slice("w", i, SHINGLE), lambda x: x.rlike("^[0-9]+$"))))
    return _once(out, "h", h).drop("w")


def bands(df: DataFrame, stride: int) -> DataFrame:
    """A row for each band of each window: the other columns and ``band``, the minimal hash of one hash function.

    A window's shingles become plain columns (a short text's first one is repeated, which changes no minimum), so that the
    hashes are compiled instead of being interpreted in a lambda.
    """
    others = [c for c in df.columns if c != "h"]
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - (SIZE - stride) - 1, F.lit(0)), F.lit(stride))
    window = F.transform(starts, lambda i: F.struct(*[F.coalesce(F.get("h", i + k), F.get("h", i)).alias(f"s{k}") for k in range(SIZE)]))
    rows = df.select(*others, F.inline(window))
    least = [F.least(*[F.xxhash64(f"s{k}", F.lit(j)) for k in range(SIZE)]) for j in range(BANDS)]
    return rows.select(*others, F.explode(F.array(*least)).alias("band"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Matches: id, template, matched and total shingles, and the first shingle (0-based word) of the stretch."""
    # the id as a struct: null ids are equal to each other in joins
    texts = docs.select(F.struct(F.col(id_col).alias("id")).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    listed = shingles(templates.select("template", "text"))
    index = bands(listed, 1).select("template", "band").distinct()
    numeric = shingles(templates.select("template", "text"), flags=True)
    grams = numeric.select("template", F.explode(F.array_distinct(F.arrays_zip("h", "numeric"))).alias("x")).select("template", F.col("x.h").alias("g"), F.col("x.numeric").alias("must"))
    few = index.limit(BROADCAST + 1).count() <= BROADCAST
    held = F.broadcast if few else (lambda x: x)
    # Retrieval: only these (text, template) pairs go on.
    retrieved = bands(shingles(texts), STRIDE).join(held(index), "band").select("doc", "key", "template").distinct()
    places = (shingles(texts).select("doc", "key", F.posexplode("h").alias("at", "g")).join(held(grams), "g")
              .join(retrieved, ["doc", "key", "template"]).select("doc", "key", "template", "g", "must", "at").distinct())
    size = grams.groupBy("template").agg(F.count("*").alias("total"), F.count_if("must").alias("musts"))
    # A stretch starts at a matching shingle and is as long as the template plus a fifth and two words.
    near = places.join(held(size), "template").withColumn("room", (F.col("total") * 1.2 + 2).cast("long"))
    again = Window.partitionBy("doc", "key", "template", "g").orderBy("at")
    near = near.withColumn("next", F.lead("at").over(again))
    near = near.withColumn("bucket", F.floor(F.col("at") / F.col("room")))
    starts = near.select("doc", "key", "template", "bucket", F.col("at").alias("start"))
    spread = near.select("doc", "key", "template", "g", "must", "at", "next", "room", "total", "musts",
                         F.explode(F.array(F.col("bucket") - 1, F.col("bucket"))).alias("bucket"))
    # Of a shingle that comes several times in a stretch, the last place counts, so each counts once.
    both = starts.distinct().join(spread, ["doc", "key", "template", "bucket"])
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("room")) & (
        F.col("next").isNull() | (F.col("next") >= F.col("start") + F.col("room")))
    counted = both.where(inside).groupBy("doc", "key", "template", "start").agg(
        F.count("*").alias("matched"), F.count_if("must").alias("numbers"), F.max("total").alias("total"), F.max("musts").alias("musts"))
    fits = (F.col("matched") >= least * F.col("total")) & (F.col("numbers") == F.col("musts"))
    best = counted.where(fits).groupBy("doc", "key", "template").agg(F.max(F.struct("matched", (-F.col("start")).alias("s"), "total")).alias("m"))
    return best.select(F.col("doc.id").alias(id_col), "template", F.col("m.matched").alias("matched"), F.col("m.total").alias("total"),
                       (-F.col("m.s")).cast("long").alias("first_word"))
