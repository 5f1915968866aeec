"""License scans: TF-IDF cosine of header lines to templates, and inheritance along paths; DataFrame functions only.

A *header* is a line that has a licence word (``MARK``).  Distinct header lines
and the templates are one collection; each is a sparse vector of
``(1 + log tf) * (log((1 + N) / (1 + df)) + 1)`` over its words.  Lines meet
templates through an inverted index of the templates' words, whose size is
fixed, and take the template of greatest cosine, from ``threshold`` on.  A file
whose name is that of a licence file (``NAMES``) gives its licence to its
directory; a file without one of its own takes that of its nearest ancestor
directory.  Each distinct directory is looked up once, by joins on its
ancestors' paths.

Beside the lines, *notices* are compared in the same way, as a collection of
their own (copies count as often as they occur), to full texts, headers, titles and SPDX tags (:func:`notices`): the
whole text of a licence file, its first lines, and every run of adjacent
comment or notice lines that has a licence word.  Comment marks and lines of
copyright holders are no part of them.  A file takes the licence of its whole
text, else of its best other notice, else of its best line.  The full text of
AGPL-3.0 is made from that of GPL-3.0; CC BY licences have titles and headers,
but no full text.

Defined results: null text has no header; equal scores go to the template that
comes first by name; two licence files in one directory: the greater score,
then the lesser licence name; a path without a directory has the root's.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm._spill import written
from inkwell.llm.quality import bound

#: Words that make a line a header, and names of licence files.
MARK = r"(?i)licen[cs]e|copyright|spdx|public domain"
NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Licence names and a common notice of each.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
)
THRESHOLD = 0.8
#: What begins a comment line, lines that name holders, SPDX tags.
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/|\*+|--|;+|%+|<!--)[ \t]*"
HOLDER = r"(?im)^\W*(?:copyright|\(c\)|\xA9).*\d{4}.*$"
SPDX = r"(?i)spdx-license-identifier:\s*\S+"
GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation, "
OLD = "either version {} of the License, or (at your option) any later version."
WARRANTY = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
FAMILY = {"GPL-2.0": ("program", ";", "General Public License", 2), "GPL-3.0": ("program", ":", "General Public License", 3), "LGPL-3.0": ("library", ":", "Lesser General Public License", 3), "AGPL-3.0": ("program", ":", "Affero General Public License", 3)}
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    )


def tokens(line: Column) -> Column:
    """Lower-case runs of a-z, 0-9 with inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def match_lines(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct ``lines`` (line) that fit a template: line, license, score (rounded to 6 places)."""
    spark = lines.sparkSession
    given = spark.createDataFrame(list(TEMPLATES), "license string, line string")
    every = lines.select(F.lit(None).cast("string").alias("license"), "line").unionByName(given)
    terms = every.select("license", "line", F.explode(tokens(F.col("line"))).alias("term")).groupBy("license", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = every.agg(F.count(F.lit(1))).scalar()
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1)
    weighed = terms.join(df, "term").select("license", "line", "term", weight.alias("w"))
    norms = weighed.groupBy("license", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = weighed.where("license is not null").join(norms.where("license is not null").drop("line"), "license").select("term", F.col("license").alias("to"), (F.col("w") / F.col("norm")).alias("u"))
    dots = weighed.where("license is null").select("line", "term", "w").join(F.broadcast(index), "term").groupBy("line", "to").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scores = dots.join(norms.where("license is null").select("line", "norm"), "line").select("line", "to", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scores.where(F.col("score") >= threshold).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "to")).alias("b"))
    return best.select("line", F.col("b.to").alias("license"), (-F.col("b.s")).alias("score"))


def notices() -> list[tuple[str, str]]:
    """Licence names and a notice each: full texts, headers, titles, SPDX tags."""
    out = [*TITLES, *HEADERS]
    for name in dict.fromkeys(n for n, _ in TEMPLATES):
        held = Path(__file__).parent / "license_texts" / f"{name}.txt"
        if held.exists():
            out.append((name, held.read_text()))
        tags = [f"{name}-only", f"{name}-or-later", f"{name}+"] if name in FAMILY else []
        out += [(name, f"SPDX-License-Identifier: {tag}") for tag in [name, *tags]]
    out.append(("AGPL-3.0", next(t for n, t in out if n == "GPL-3.0" and len(t) > 9999).replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL", "GNU AFFERO GENERAL")))
    for name, (what, mark, full, version) in FAMILY.items():
        first = GNU.format(what, mark, full) + OLD.format(version)
        out += [(name, first), (name, first + WARRANTY.format(what, full))]
    return out


def term_counts(text: Column) -> Column:
    """array<struct<term, n>> of the distinct tokens of a text: runs of equal ones in sorted order, so no row leaves its task."""
    runs = lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
    each = lambda own: bound(runs(own), lambda at: F.transform(at, lambda i, k: F.struct(F.get(own, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(own)) - i).alias("n"))))
    return bound(F.sort_array(tokens(text)), lambda own: F.when(F.size(own) > 0, each(own)))


def match_notices(given: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``given`` (key, notice; a key names one text) that fit one of :func:`notices`: key, license, score (rounded to 6 places).

    A notice's weights outside the templates' words are at least
    ``1 + log tf`` each, so those words alone tell that most texts cannot reach
    the threshold: only the words of the others meet the document frequencies.
    """
    spark = given.sparkSession
    known = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(notices())], "t int, license string, notice string")
    own = known.select("t", F.inline(term_counts(F.col("notice"))))
    theirs = given.select("key", F.inline(term_counts(F.col("notice"))))
    df = written(theirs.select("term").unionByName(own.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n = given.agg(F.count(F.lit(1)) + F.lit(known.count())).scalar()
    idf = F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1
    tf = 1 + F.log(F.col("n").cast("double"))
    words = df.join(F.broadcast(own.select("term").distinct()), "term").select("term", idf.alias("idf"))  # of fixed size
    bounds = theirs.join(F.broadcast(words), "term", "left").groupBy("key").agg(
        F.sum(F.when(F.col("idf").isNotNull(), (tf * F.col("idf")) ** 2)).alias("inside"), F.sum(F.when(F.col("idf").isNull(), tf**2).otherwise(0.0)).alias("outside")
    )
    rest = 1 / (threshold - 1e-5) ** 2 - 1
    able = bounds.where(F.col("outside") <= F.col("inside") * rest).select("key")
    texts = written(given.join(able, "key", "left_semi").dropDuplicates(["key"]), "able")
    weighed = texts.select("key", F.inline(term_counts(F.col("notice")))).join(df, "term").select("key", "term", (tf * idf).alias("w"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    mine = own.join(F.broadcast(words), "term").select("t", "term", (tf * F.col("idf")).alias("w"))
    lengths = mine.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = mine.join(lengths, "t").select("term", "t", (F.col("w") / F.col("norm")).alias("u"))
    dots = weighed.join(F.broadcast(index), "term").groupBy("key", "t").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scores = dots.join(norms, "key").select("key", "t", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    fit = scores.where(F.col("score") >= threshold).join(F.broadcast(known.select("t", "license")), "t")
    return fit.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def parts(files: DataFrame) -> DataFrame:
    """path, rank, notice of ``files`` (path, text): whole licence files (0); their first lines, runs of adjacent notice lines and SPDX tags (1); header lines (2)."""
    flat = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, HOLDER, ""), r"[\s\x01]+|\*/|-->", " "))
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(NAMES), F.lit(False))
    rows = files.where(F.col("text").rlike(MARK) | (named & F.col("text").isNotNull()))
    marked = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), COMMENT, "\x01")
    apart = F.regexp_replace(F.regexp_replace(marked, r"(?m)^(\x01.*)\n(?=[^\x01\n])", "$1\n\n"), r"(?m)^([^\x01\n].*)\n(?=\x01)", "$1\n\n")
    runs = F.filter(F.split(apart, r"\n(?:[ \t]*\n)+"), lambda x: x.rlike(MARK) & F.trim(x).contains("\n"))
    head = F.filter(F.split(marked, "\n"), lambda x: x.rlike(r"\w"))
    heads = F.when(named, F.array(F.get(head, F.lit(0)), F.array_join(F.slice(head, 1, 2), "\n"))).otherwise(F.array())
    tags = F.regexp_extract_all("text", F.lit(SPDX), F.lit(0))
    whole = F.struct(F.lit(0).alias("rank"), flat(marked).alias("notice"))
    each = F.transform(F.filter(F.concat(heads, runs, tags), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(1).alias("rank"), flat(x).alias("notice")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MARK))
    lines = F.transform(lines, lambda x: F.struct(F.lit(2).alias("rank"), F.trim(F.regexp_replace(x, r"[\s]+", " ")).alias("notice")))
    found = F.array_distinct(F.concat(F.when(named, F.array(whole)).otherwise(F.array()), each, lines))
    return rows.select("path", F.inline(found)).where("notice <> ''")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (path, text and any other columns) with the licence of each.

    Adds own_license, own_score, license, license_dir (the directory whose
    licence file gave it, null for an own one) and drops nothing.
    """
    new = ["own_license", "own_score", "license", "license_dir"]
    kept = files.drop(*new)
    rows = kept.withColumn("_dir", directory(F.col("path")))
    noted = written(parts(kept.select("path", "text")).withColumn("key", F.md5(F.col("notice").cast("binary"))), "notices")
    headers, whole = noted.where("rank = 2"), noted.where("rank < 2")
    found = match_lines(headers.select(F.col("notice").alias("line")).distinct(), threshold)
    fits = headers.withColumnRenamed("notice", "line").join(found, "line").select("path", "rank", "license", "score")
    found = written(match_notices(whole.select("key", "notice"), threshold), "matches")
    fits = fits.unionByName(whole.select("path", "rank", "key").join(found, "key").select("path", "rank", "license", "score"))
    own = fits.groupBy("path").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "license")).alias("b"))
    own = own.select("path", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))
    givers = own.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(NAMES)).groupBy(directory(F.col("path")).alias("license_dir"))
    givers = givers.agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("b")).select("license_dir", F.col("b.l").alias("given"))
    depth = F.size(F.split("_dir", "/"))
    up = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), i), "/")))
    paths = rows.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(up)).alias("license_dir"))
    nearest = paths.join(givers, "license_dir").groupBy("_dir").agg(F.max_by(F.struct("license_dir", "given"), F.length("license_dir")).alias("g"))
    out = rows.join(own, "path", "left").join(nearest, "_dir", "left")
    return out.select(
        *kept.columns, "own_license", "own_score", F.coalesce("own_license", "g.given").alias("license"), F.when(F.col("own_license").isNull(), F.col("g.license_dir")).alias("license_dir")
    )


def directory(path: Column) -> Column:
    """The path without its last part and that slash; '' for a bare name or null."""
    return F.coalesce(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit(""))
