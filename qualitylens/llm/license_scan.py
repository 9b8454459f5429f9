"""License scans: sparse TF-IDF cosine to templates, then inheritance by path.

A text is taken apart into segments: its lines that are not blank, and of a
line of more than ``SPAN`` words overlapping windows of that many. Headers are
put together from them: neighbouring segments that may be part of a notice
form a block, so a notice that is wrapped over lines, or stands within a long
one, is compared as a whole, and a file that a licence file's name marks is
compared whole too. Templates are short notices, headers and whole licences.
Terms are weighted by how rare they are among all segments; a term that no
template has counts as rarest. The best segment, block or whole text at or
above the threshold gives the file its licence. A file that is a licence text,
by its name or because notices are most of its words, licenses its directory,
and a file without a notice of its own takes the licence of its nearest
ancestor directory that has one, by a join on path prefixes.

All is DataFrame expressions. A segment can only reach the threshold if it has
enough template terms for its other terms, whatever the weights; segments that
do not are left out before weighing, which drops no match of a segment.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.llm.common import SPACE, SPACE_CHARS
from qualitylens.session import Scratch

THRESHOLD = 0.6
SPAN, STEP = 24, 12
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
FILE_SHARE = 0.5

#: Whole licences and file headers, as their publishers give them.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
LICENSES = [
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_2 + _BSD_3 + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", _GNU.format("General", "2")),
    ("GPL-3.0", _GNU.format("General", "3")),
    ("LGPL-2.1", _GNU.format("Lesser General", "2.1").replace("program", "library")),
    ("LGPL-3.0", _GNU.format("Lesser General", "3")),
    ("AGPL-3.0", _GNU.format("Affero General", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

#: Notices of licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
TEMPLATES = NOTICES + LICENSES


def terms(text: str) -> list[str]:
    """Distinct lower-cased runs of ASCII letters and digits."""
    return sorted(set(re.findall(r"[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(lower: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(lower, "[^a-z0-9]+")), "")


def _segments(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per text (h, whole) its segments: words (those that no window before has),
    template terms, and number of other terms.

    Terms are found once per stretch of ``STEP`` words; a window is two
    stretches. What a lambda uses twice is bound by a ``transform`` of its own,
    as expressions inside a lambda are evaluated wherever they stand."""
    none = F.array().cast("array<string>")
    last = lambda n: F.greatest(F.ceil((n - SPAN) / STEP), F.lit(0)).cast("int")
    line_words = F.transform(F.split(_lower(F.col("text")), "\n"), lambda x: F.split(F.btrim(x, F.lit(SPACE_CHARS)), SPACE))
    line_words = F.filter(line_words, lambda w: F.get(w, F.lit(0)) != "")

    def stretches(w: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(w) - 1) / STEP).cast("int"))
        return F.struct(F.size(w).alias("n"), F.transform(starts, lambda k: _terms(F.array_join(F.slice(w, k * STEP + 1, STEP), " "))).alias("terms"))

    def known(x: Column) -> Column:
        mark = lambda t: F.struct(F.filter(t, lambda v: v.isin(*vocabulary)).alias("known"), t.alias("all"))  # noqa: E731  a hash set made once
        return F.struct(x["n"].alias("n"), F.transform(x["terms"], mark).alias("at"))

    def windows(x: Column) -> Column:
        both = lambda k, name: F.array_union(F.get(x["at"], k)[name], F.coalesce(F.get(x["at"], k + 1)[name], none))
        # a window counts the words up to the next one's start
        words = lambda k: F.when(k < last(x["n"]), STEP).otherwise(x["n"] - k * STEP)
        return F.transform(F.sequence(F.lit(0), last(x["n"])), lambda k: F.struct(words(k).alias("words"), both(k, "known").alias("known"), F.size(both(k, "all")).alias("all")))

    segments = F.flatten(F.transform(F.transform(F.transform(line_words, stretches), known), windows))
    counted = F.transform(segments, lambda x: F.struct(x["words"].alias("words"), x["known"].alias("known"), (x["all"] - F.size(x["known"])).alias("others")))
    return files.select("h", "whole", counted.alias("segments"))


def notices(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Units of ``files`` (h, whole, text; a row per text) that match a template:
    h, n_words, unit, words, license, score. Unit 2k is segment k, unit 2k + 1 the block
    that begins with it, unit -1 the whole text where ``whole`` is true. Each
    unit has its best template; of equal ones the first."""
    spark = files.sparkSession
    scratch = Scratch(spark)
    vocabulary = sorted({t for _, notice in templates for t in terms(notice)})
    # texts are taken apart once; what is kept of a segment is a few words
    taken = scratch.save(_segments(files, vocabulary))
    lines = taken.select("h", "whole", F.posexplode("segments").alias("pos", "s")).select("h", "whole", "pos", "s.*")
    # rarity is counted over all segments
    df = lines.select(F.explode("known").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = taken.agg(F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("n"))
    every = spark.range(1).select(F.explode(F.split(F.lit(" ".join(vocabulary)), " ")).alias("term")).join(df, "term", "left")
    idf = every.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"), (F.log(F.col("n") + 1.0) + 1).alias("rarest"))
    idf = scratch.save(idf)  # a row per template term
    # Texts that repeat count in the rarity but are weighed once.
    # cosine**2 <= weight of template terms / weight of all, and no term outweighs the rarest
    least = threshold**2 / (1 - threshold**2) if threshold < 1 else float("inf")
    may = lambda known, others: (F.size(known) > 0) & (F.size(known) >= least * F.col(others) - 1e-9)
    near = scratch.save(lines.where(may("known", "others")).select("h", "pos", "words", "known", "others").dropDuplicates(["h", "pos"]))
    # neighbours form a block
    run = near.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("h").orderBy("pos")))
    whole = F.array_distinct(F.flatten(F.collect_list("known")))
    blocks = run.groupBy("h", "run").agg(F.min("pos").alias("pos"), F.sum("words").cast("int").alias("words"), whole.alias("known"), F.sum("others").cast("int").alias("others"), F.count("*").alias("k")).where("k > 1")
    texts = lines.where("whole").dropDuplicates(["h", "pos"]).groupBy("h").agg(F.sum("words").cast("int").alias("words"), whole.alias("known"), F.sum("others").cast("int").alias("others"))
    units = near.select("h", (2 * F.col("pos")).alias("unit"), "words", "known", "others")
    units = units.union(blocks.select("h", 2 * F.col("pos") + 1, "words", "known", "others")).union(texts.select("h", F.lit(-1), "words", "known", "others"))
    units = scratch.save(units.where(may("known", "others")))

    given = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(license).alias("license"), F.lit(" ".join(terms(notice))).alias("terms")) for i, (license, notice) in enumerate(templates)])
    wanted = spark.range(1).select(F.explode(given).alias("t")).select("t.template", "t.license", F.explode(F.split("t.terms", " ")).alias("term"))
    weights = wanted.join(idf, "term")
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    weights = scratch.save(weights.join(norms, "template").select("template", "license", "term", "norm"))
    found = units.select("h", "unit", "words", "others", F.explode("known").alias("term")).join(F.broadcast(idf), "term")
    # sums by unit, then by unit and template
    sizes = found.groupBy("h", "unit", "words").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf")) + F.first("others") * F.first("rarest") * F.first("rarest")).alias("size"))
    dots = found.join(F.broadcast(weights), "term").groupBy("h", "unit", "template", "license", "norm").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    scored = dots.join(sizes, ["h", "unit"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6))
    scored = scored.where(F.col("score") >= threshold)
    best = F.max_by(F.struct("license", "score"), F.struct(F.col("score"), -F.col("template")))
    sums = F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    of = taken.select("h", sums.alias("n_words")).dropDuplicates(["h"])
    out = scored.groupBy("h", "unit", "words").agg(best.alias("best")).join(of, "h")
    return out.select("h", "n_words", "unit", "words", "best.license", "best.score")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every row of ``files`` (doc_id, path, text; other columns
    are ignored).

    Returns doc_id, path, license (or null), score (of the notice, null if
    inherited), origin (own, inherited or none), license_dir (whose licence
    was inherited). Null and empty texts have no notice but may inherit; a null
    path neither gives nor inherits; whole texts are read; a null doc_id stays
    null; rows that repeat are each answered. Of several notices in a text the
    best score counts, then the first; of several licence files in a
    directory the least licence. An empty table gives no rows.
    """
    scratch = Scratch(files.sparkSession)
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    # the same text under a licence file's name and another is two texts: only one is compared whole
    h = F.xxhash64("text", named)
    rows = files.select("doc_id", "path", h.alias("h"), named.alias("whole"), "text")
    found = notices(rows.select("h", "whole", "text"), templates, threshold)
    # notices take the words of the segments that match, or of the block that matches best
    top = F.max_by(F.struct("license", "score", "unit", "words"), F.struct(F.col("score"), -F.col("unit")))
    single = F.coalesce(F.sum(F.when(F.col("unit") % 2 == 0, F.col("words"))), F.lit(0))
    own = found.groupBy("h", "n_words").agg(top.alias("own"), single.alias("single"))
    own = own.select("h", "n_words", "own", F.greatest("single", F.when(F.col("own.unit") > 0, F.col("own.words"))).alias("notice_words"))
    own = scratch.save(own)
    keys = scratch.save(rows.select("doc_id", "path", "h").join(own, "h", "left").drop("h"))

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_license = F.coalesce(F.col("path").rlike(LICENSE_FILE) | (F.col("notice_words") >= FILE_SHARE * F.col("n_words")), F.lit(False))
    given = keys.where(F.col("own").isNotNull() & F.col("path").isNotNull() & is_license).groupBy(folder.alias("dir")).agg(F.min("own.license").alias("given"))
    given = scratch.save(given)
    # distinct directories of files without a notice, each with all its ancestors
    need = keys.where(F.col("own").isNull() & F.col("path").isNotNull()).select(folder.alias("folder")).distinct()
    steps = F.split("folder", "/")
    up = need.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("dir")).distinct()
    nearest = up.join(given, "dir").groupBy("folder").agg(F.max_by(F.struct("dir", "given"), F.length("dir")).alias("near"))
    nearest = scratch.save(nearest)
    out = keys.withColumn("folder", F.when(F.col("own").isNull(), folder)).join(nearest, "folder", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own.license", "near.given").alias("license"),
        F.col("own.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("near.dir").alias("license_dir"),
    )
