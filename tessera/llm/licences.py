"""Licence scan: segments of every file against licence templates, then inheritance from directories.

Segments of a text are its lines, and its sentences: there, line ends within a paragraph and the comment marks after them
count as blanks, so that wrapped headers are whole; a blank line ends a sentence. Segments and the sentences of the
templates are sparse TF-IDF vectors over words; inverse document frequencies are over the templates, and a word that none
has weighs most. A file has the licence of the highest cosine, `threshold` at least; of equal ones, that of which more
sentences are there, then the smaller name. A file called LICENSE, LICENCE or COPYING speaks for its directory: a file
without a licence of its own takes that of the nearest ancestor directory that has one.

A cosine of `threshold` can't come from words alone whose weights' squares sum to less than threshold^2. Common words are
put into that set first, then short ones; only texts with one of the others are split at all, and none is lost by that.

Null and empty texts state no licence; a null path has no ancestors. All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import discard, stored

#: What licence headers and files say.
SUBJECT_TO = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Zero-Clause BSD", "SPDX-License-Identifier: 0BSD"],
    "AGPL-3.0": [GPL_NOTICE.format("Affero", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License 2.0", "This file is licensed under the Apache License 2.0"],
    "BSD-2-Clause": [REDISTRIBUTION, "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [REDISTRIBUTION, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "BSD License", "Licensed under the BSD 3-Clause License"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-SA-3.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "SPDX-License-Identifier: CC-BY-SA-3.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Creative Commons Legal Code CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "Eclipse Public License - v 1.0", "SPDX-License-Identifier: EPL-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [GPL_NOTICE.format("", "2"), "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "Distributed under the terms of the GNU General Public License v2", "Licensed under GPLv2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": [GPL_NOTICE.format("", "3"), "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the terms of the GNU General Public License v3", "Licensed under GPLv3", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": [GPL_NOTICE.format("Lesser", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": [SUBJECT_TO, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Released under the MIT License.", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT", "Licensed under the MIT License.", "This project is licensed under the MIT License"],
    "MIT OR Apache-2.0": ["SPDX-License-Identifier: (MIT OR Apache-2.0)", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib"],
}
#: Words that any text may have, the likeliest first.
COMMON = "the of and to a in is that it for on was be with as by this are or at not have from you all can what any do use only work your free later has will may under other following form written general public so possible want file person made available either except including provided specific terms whom without works anyone copies forms program version source".split()
#: A line end within a paragraph, and the comment mark after it.
LINE_END = r"\r?\n[ \t]*+(?:#++|/{2,}+|/?\*++/?+|;++|-{2,}+|%++)?+[ \t]*+(?=\S)"
SENTENCE_END = r"\n|(?<=[.!?])\s"
NOT_WORD = r"[^\p{L}\p{N}]+"


def template_vectors(templates: dict[str, list[str]]) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """Inverse document frequencies, that of other words, and (licence, number, word, weight), weights of norm 1."""
    sets = [(name, k, Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)) for name, texts in templates.items() for k, text in enumerate(texts)]
    n = len(sets)
    seen = Counter(w for _, _, c in sets for w in c)
    idf = {w: log((1 + n) / (1 + k)) + 0.1 for w, k in seen.items()}
    rows = []
    for name, k, c in sets:
        norm = sqrt(sum((m * idf[w]) ** 2 for w, m in c.items()))
        rows += [(name, k, w, m * idf[w] / norm) for w, m in c.items()]
    return idf, log(1 + n) + 0.1, rows


def needed_words(rows: list[tuple[str, int, str, float]], threshold: float) -> list[str]:
    """Words of which a sentence has at least one if its cosine with some template is `threshold` or more."""
    needed: set[str] = set()
    for key in {(name, k) for name, k, _, _ in rows}:
        light = 0.0
        for _, word, weight in sorted((COMMON.index(w) if w in COMMON else len(COMMON) + len(w), w, x) for name, k, w, x in rows if (name, k) == key):
            light += weight * weight
            if light >= (threshold - 1e-9) ** 2:
                needed.add(word)
    return sorted(needed)


def has_word(text: Column, words: list[str]) -> Column:
    """Whether text has one of the words, by itself."""
    return F.arrays_overlap(F.split(text, NOT_WORD), F.array(*map(F.lit, words)))


def segments(text: Column) -> Column:
    """Lines and sentences, each once."""
    return F.array_distinct(F.concat(F.split(text, r"\r?\n"), F.split(F.regexp_replace(text, LINE_END, " "), SENTENCE_END)))


def stated(files: DataFrame, key: str = "path", text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """key, licence, score, share (of the text that the segment is), one row for each key that states a licence.

    Rows with the same key count as one file; rows with a null key are left out.
    """
    spark = files.sparkSession
    idf, other, rows = template_vectors(templates)
    needed = needed_words(rows, threshold)
    parts = (
        files.select(key, F.lower(text).alias("t")).filter(F.col(key).isNotNull() & has_word(F.col("t"), needed))
        .select(key, F.length("t").alias("size"), F.explode(segments(F.col("t"))).alias("segment"))
        .filter(has_word(F.col("segment"), needed))
    )
    parts = stored(parts)
    # many files say the same: each different segment is weighed once
    kinds = stored(parts.select("segment").distinct().withColumn("at", F.monotonically_increasing_id()))
    words = kinds.select("at", F.explode(F.filter(F.split("segment", NOT_WORD), lambda w: w != "")).alias("word")).groupBy("at", "word").agg(F.count("*").alias("n"))
    known = spark.createDataFrame(sorted(idf.items()), StructType([StructField("word", StringType()), StructField("idf", DoubleType())]))
    terms = spark.createDataFrame([(n, k, w, x) for n, k, w, x in rows], "licence string, k int, word string, weight double")
    weighed = stored(words.join(F.broadcast(known), "word", "left").select("at", "word", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("x")))
    norms = weighed.groupBy("at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(terms), "word").groupBy("at", "licence", "k").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosine = F.round(F.least(F.lit(1.0), F.col("dot") / F.col("norm")), 6)
    alike = dots.join(norms, "at").select("at", "licence", "k", cosine.alias("score")).filter(F.col("score") >= threshold)
    found = parts.join(alike.join(kinds, "at").select("segment", "licence", "k", "score"), "segment")
    share = F.length("segment") / F.greatest("size", F.lit(1))
    each = found.groupBy(key, "licence").agg(F.max(F.struct("score", share.alias("share"))).alias("top"), F.count_distinct("k").alias("n"))
    best = F.min(F.struct((-F.col("top.score")).alias("score"), (-F.col("n")).alias("n"), "licence", F.col("top.share").alias("share"))).alias("b")
    out = stored(each.groupBy(key).agg(best).select(key, "b.licence", (-F.col("b.score")).alias("score"), "b.share"))
    discard(parts, kinds, weighed)
    return out


def parent(path: Column) -> Column:
    """The directory of a path; of a name without one, the empty root; of the root, null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path != "", F.lit(""))


def licence_file(key: str = "path") -> Column:
    return F.regexp_extract(key, r"([^/]*)$", 1).rlike(r"^(?i)(licen[cs]e|copying)(\.[a-z]+)?$")


def inherited(files: DataFrame, found: DataFrame, key: str = "path", speaks: Column | None = None) -> DataFrame:
    """key, licence, score, source (header, inherited or none), licence_dir, for every row of files.

    found: from stated(). speaks: which of its rows give their directory a licence (by default, files called LICENSE and
    the like); of several, that of the highest score.
    """
    found = stored(found)
    dirs = stored(found.filter(licence_file(key) if speaks is None else speaks).groupBy(parent(F.col(key)).alias("at")).agg(F.max_by(F.struct("licence", "score"), F.struct("score", "licence")).alias("given")))
    every = files.select(parent(F.col(key)).alias("dir")).distinct().filter(F.col("dir").isNotNull())
    steps = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    chains = every.select("dir", F.posexplode(ancestors).alias("depth", "at"))
    nearest = stored(chains.join(dirs, "at").groupBy("dir").agg(F.max_by(F.struct("given", "at"), "depth").alias("near")))
    rows = files.select(key, parent(F.col(key)).alias("dir")).join(found.select(key, "licence", "score"), key, "left")
    own, near = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return rows.join(nearest, "dir", "left").select(
        key,
        F.coalesce("licence", "near.given.licence").alias("licence"),
        F.when(own, F.col("score")).otherwise(F.col("near.given.score")).alias("score"),
        F.when(own, "header").when(near, "inherited").otherwise("none").alias("source"),
        F.when(~own & near, F.col("near.at")).alias("licence_dir"),
    )
