"""License scans (DataFrame functions only): TF-IDF cosine of headers and license files to templates, then inheritance
from the nearest ancestor directory that has a license file."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.functions.text import let
from plotmark.llm.common import materialise

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published
by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} License for more details. You should have received a copy of the GNU {} License
along with this program. If not, see https://www.gnu.org/licenses/."""


_FREE = "The GNU {} License is a free, copyleft license for software and other kinds of works{}."
_CC = """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative
Commons {} International Public License ("Public License"). To the extent this Public License may be interpreted as a
contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor
grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these
terms and conditions."""


def _gnu(kind: str, version: int) -> str:
    return _GNU.format(kind, version, kind, kind)


#: Public license notices, headers, titles, bodies and, of long bodies, paragraphs that no other license has, by SPDX-like name.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", _gnu("Affero General Public", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _FREE.format("Affero General Public", ", specifically designed to ensure cooperation with the community in the case of network server software")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    ],
    "BSD-2-Clause": [f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_END}", f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_THIRD} {_BSD_END}", f"{_BSD} {_BSD_THIRD} {_BSD_END}"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _CC.format("Attribution 4.0")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", _CC.format("Attribution-NonCommercial 4.0")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", _CC.format("Attribution-ShareAlike 4.0")],
    "CC0-1.0": [
        "Released into the public domain under CC0 1.0.",
        "Creative Commons Legal Code CC0 1.0 Universal",
        """The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon
the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("General Public", 2),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.
This General Public License applies to most of the software of the Free Software Foundation and to any other program whose authors
commit to using it. You can apply it to your programs, too.""",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("General Public", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FREE.format("General Public", "")],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        _gnu("Lesser General Public", 3),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        f"""MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "MPL-2.0": [
        "Subject to the terms of the Mozilla Public License, version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License Version 2.0",
        '1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means."""
    ],
}
THRESHOLD = 0.7
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([-_.].*)?$"
GAP = r"\n[^A-Za-z0-9\n]*\n"  # a line without letters or digits, between blocks
SCOPES = ("line", "block", "file")


def _terms(text: Column) -> Column:
    """Terms: lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _listed(templates: dict[str, list[str]]) -> list[tuple[str, int, str]]:
    """(name, variant, text) of all templates, with an SPDX tag for each license that has an identifier."""
    tags = {k: [*v, *([] if k == "Proprietary" else [f"SPDX-License-Identifier: {k}"])] for k, v in templates.items()}
    return [(k, i, text) for k, v in sorted(tags.items()) for i, text in enumerate(v)]


def _within(terms: Column, counts: dict[tuple[str, int], Counter], weight: dict[str, float], unseen: float, threshold: float) -> Column:
    """Whether the cosine of ``terms`` to some template may reach the threshold, by bounds that lose nothing.

    (1) Of each template the rarest terms are probes, so many that the others hold less than threshold squared of its squares: without
    a probe there is no match. (2) The weights of known terms are at most ``unseen``, which all unknown ones weigh, and their squares are
    the most when one term has all the repetitions. (3) The terms that are shared with one template must hold threshold squared of its
    squares, and of those of ``terms``, counting repetitions, beside the distinct unknown terms.
    """
    least = max(threshold - 1e-6, 0.0) ** 2  # scores are rounded to six digits
    close, probes = [], set()
    for c in counts.values():
        square = {t: (n * weight[t]) ** 2 for t, n in c.items()}
        whole, left = sum(square.values()), 1.0
        mine = []
        for t in sorted(c, key=lambda t: (-weight[t], t)):
            if left >= least:
                mine.append(t)
                left -= square[t] / whole
        probes.update(mine)
        close.append({"probes": mine, "terms": [{"term": t, "share": square[t] / whole, "square": weight[t] ** 2} for t in sorted(c)]})
    close = F.from_json(F.lit(json.dumps(close)), "array<struct<probes array<string>, terms array<struct<term string, share double, square double>>>>")

    def sums(xs: Column, value) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + value(x))

    def reaches(template: Column, known: Column, distinct: Column, unknown: Column) -> Column:
        shared = F.filter(template["terms"], lambda x: F.array_contains(distinct, x["term"]))
        times = lambda x: F.size(known) - F.size(F.array_remove(known, x["term"]))
        own = lambda s: sums(s, lambda x: F.pow(times(x).cast("double"), F.lit(2.0)) * x["square"])
        enough = let(shared, lambda s: (sums(s, lambda x: x["share"]) >= least) & (own(s) * (1 - least) >= unknown * (least * unseen * unseen)))
        return F.arrays_overlap(template["probes"], distinct) & enough

    def bounded(known: Column, distinct: Column, unknown: Column) -> Column:
        repeats = (F.size(known) - F.size(distinct)).cast("double")
        most = F.size(distinct) - 1 + (repeats + 1) * (repeats + 1)
        return (most * (1 - least) >= unknown * least) & F.exists(close, lambda t: reaches(t, known, distinct, unknown))

    vocabulary = sorted(weight)
    known, unknown = F.filter(terms, lambda t: t.isin(vocabulary)), F.size(F.array_distinct(F.filter(terms, lambda t: ~t.isin(vocabulary))))
    return F.exists(terms, lambda t: t.isin(sorted(probes))) & let(known, lambda k: let(F.array_distinct(k), lambda d: let(unknown, lambda u: bounded(k, d, u))))


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def license_scan(
    files: DataFrame,
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """Per file: doc_id, path, license (its own best template), score, scope ("line", "block" or "file") and line (of a
    notice of one line, from 0), inherited_license and inherited_from (directory), effective_license and how ("own",
    "inherited" or "none").

    Every line of the whole text, every header block (of several lines, between lines without letters and digits) and the
    whole file (of several blocks) are compared with every template by the cosine of TF-IDF vectors. Document
    frequencies are taken over all files for the templates' terms (a bounded list); all other terms weigh as if
    unseen, the largest weight, so prose that shares a few words stays far from a notice. Left out are lines, blocks and files only
    whose cosine can't reach the threshold by the bounds of ``_within``. A file without a notice inherits from the nearest ancestor directory that holds a license file (named license, copying or notice) with one; ancestors
    are joined to directories, not to files.

    Defined cases: null text is empty and has no notice; a null path has no ancestors; ties of score go to the
    line before the block before the file, then to the earlier, then to the name first in order; several texts under one
    id and path are one file; several license files of a directory: the smallest path counts; an empty table gives an
    empty result; rows that are repeated give repeated rows; other columns are ignored.
    """
    spark = files.sparkSession
    listed = _listed(templates or TEMPLATES)
    counts = {(k, i): Counter(re.findall("[a-z0-9]+", text.lower())) for k, i, text in listed}
    vocabulary = sorted({t for c in counts.values() for t in c})
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    seen = rows.select(F.explode(F.concat(F.array_distinct(F.filter(_terms(F.col("text")), lambda t: t.isin(vocabulary))), F.array(F.lit("")))).alias("term"))
    frequency = {r["term"]: r["n"] for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = frequency.pop("", 0)
    weight = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + total) + 1
    weights = _table(spark, [{"term": t, "weight": w} for t, w in weight.items()], "term string, weight double")
    norms = {key: math.sqrt(sum((n * weight[t]) ** 2 for t, n in c.items())) for key, c in counts.items()}
    vectors = [{"term": t, "name": key[0], "variant": key[1], "value": n * weight[t] / norms[key]} for key, c in counts.items() for t, n in c.items()]
    vectors = _table(spark, vectors, "term string, name string, variant int, value double")

    def units(scope: int, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.named_struct(F.lit("scope"), F.lit(scope), F.lit("at"), i, F.lit("terms"), _terms(x)))

    blocks = F.split("text", GAP)
    whole = F.when(F.size(blocks) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    headers = F.filter(F.transform(blocks, lambda x, i: F.struct(x.alias("content"), i.alias("at"))), lambda u: F.contains(u["content"], F.lit("\n")))
    headers = F.transform(headers, lambda u: F.named_struct(F.lit("scope"), F.lit(1), F.lit("at"), u["at"], F.lit("terms"), _terms(u["content"])))
    each = F.concat(units(0, F.split("text", "\n")), headers, units(2, whole))
    each = F.filter(each, lambda u: _within(u["terms"], counts, weight, unseen, threshold))
    each = rows.select("doc_id", "path", F.xxhash64("text").alias("body"), F.explode_outer(each).alias("u")).filter("u is not null").select("doc_id", "path", "body", "u.*")
    key = ["doc_id", "path", "body", "scope", "at"]
    tokens = materialise(each.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf")), "tokens")
    # Both tables are as small as the list of templates.
    weighed = tokens.join(F.broadcast(weights), "term", "left").withColumn("value", F.col("tf") * F.coalesce("weight", F.lit(unseen)))
    norm = materialise(weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")), "norms")
    dots = weighed.select(*key, "term", F.col("value").alias("own")).join(F.broadcast(vectors), "term").groupBy(*key, "name", "variant").agg(F.sum(F.col("own") * F.col("value")).alias("dot"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    scored = dots.alias("d").join(norm.alias("n"), same).select(*[f"d.{c}" for c in key], "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    scored = scored.filter(F.col("score") >= threshold)
    best = scored.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "scope", "at", "name")).alias("b"))
    scope = F.element_at(F.lit(list(SCOPES)), F.col("b.scope") + 1)
    line = F.when(F.col("b.scope") == 0, F.col("b.at"))
    own = materialise(best.select("doc_id", "path", F.col("b.name").alias("license"), (-F.col("b.s")).alias("score"), scope.alias("scope"), line.alias("line")), "licenses")

    directory, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    holders = own.filter(F.col("path").isNotNull()).withColumn("directory", directory).withColumn("name", name)
    holders = holders.filter(F.col("name").rlike(FILE_NAMES)).groupBy("directory").agg(F.min(F.struct("path", "license")).alias("h"))
    holders = materialise(holders.select(F.col("directory").alias("ancestor"), F.col("h.license").alias("inherited_license")), "holders")
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    folders = rows.filter(F.col("path").isNotNull()).select(directory.alias("directory")).distinct()
    nearest = folders.select("directory", F.explode(F.array_distinct(ancestors)).alias("a")).select("directory", "a.depth", "a.ancestor").join(holders, "ancestor")
    nearest = nearest.groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "inherited_license")).alias("n"))
    nearest = materialise(nearest.select("directory", F.col("n.ancestor").alias("inherited_from"), F.col("n.inherited_license").alias("inherited_license")), "nearest")

    out = rows.select("doc_id", "path", directory.alias("directory"))
    mine = own.withColumnsRenamed({"doc_id": "own_id", "path": "own_path"})
    out = out.join(mine, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    out = out.join(nearest, "directory", "left")
    lacks = F.col("license").isNull()
    return out.select(
        "doc_id",
        "path",
        "license",
        "score",
        "scope",
        "line",
        F.when(lacks, F.col("inherited_license")).alias("inherited_license"),
        F.when(lacks, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("license", "inherited_license").alias("effective_license"),
        F.when(~lacks, "own").when(F.col("inherited_license").isNotNull(), "inherited").otherwise("none").alias("how"),
    )


#: Documents have no paths: their source is the top directory, 64 neighbouring ids share a folder, every 16th document
#: is its folder's license file and every 1024th its source's.
PATH = """concat_ws('/', source, CASE WHEN doc_id % 1024 = 0 THEN concat('LICENSE-', doc_id)
  ELSE concat(CAST(floor(doc_id / 64) AS BIGINT), '/', CASE WHEN doc_id % 16 = 0 THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END) END)"""


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs.select("doc_id", F.expr(PATH).alias("path"), "text"))


_QUOTED = ", ".join(f"('{k}', {i}, '{t}')" for k, i, t in _listed(TEMPLATES))
_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
OP2_SQL = f"""
WITH templates(name, variant, terms) AS (SELECT name, variant, {_SPLIT.format("body")} FROM (VALUES {_QUOTED}) v(name, variant, body)),
counted AS (SELECT name, variant, term, count(*) AS n FROM (SELECT name, variant, unnest(terms) AS term FROM templates) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM counted),
files AS (SELECT doc_id, {PATH} AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM files),
frequency AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({_SPLIT.format("text")})) AS term FROM files) GROUP BY term),
weights AS (SELECT v.term, ln((1.0 + t.n) / (1 + coalesce(f.n, 0))) + 1 AS w FROM vocabulary v CROSS JOIN total t LEFT JOIN frequency f USING (term)),
tnorms AS (SELECT name, variant, sqrt(sum(n * w * n * w)) AS norm FROM counted JOIN weights USING (term) GROUP BY ALL),
split AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '{GAP}') AS blocks FROM files),
units AS (SELECT doc_id, path, 0 AS scope, unnest(range(len(lines))) AS at_, unnest(lines) AS content FROM split
  UNION ALL SELECT * FROM (SELECT doc_id, path, 1, unnest(range(len(blocks))), unnest(blocks) AS content FROM split) WHERE contains(content, chr(10))
  UNION ALL SELECT doc_id, path, 2, 0, text FROM split WHERE len(blocks) > 1),
termed AS (SELECT doc_id, path, scope, at_, {_SPLIT.format("content")} AS terms FROM units),
tokens AS (SELECT doc_id, path, scope, at_, term, count(*) AS tf FROM (SELECT doc_id, path, scope, at_, unnest(terms) AS term FROM termed) GROUP BY ALL),
weighed AS (SELECT k.*, tf * coalesce(w, ln(1.0 + t.n) + 1) AS value FROM tokens k LEFT JOIN weights USING (term) CROSS JOIN total t),
norms AS (SELECT doc_id, path, scope, at_, sqrt(sum(value * value)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, path, scope, at_, name, variant, sum(value * n * w) AS dot FROM weighed JOIN counted USING (term) JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT d.*, round(dot / (o.norm * m.norm), 6) AS score FROM dots d JOIN norms o USING (doc_id, path, scope, at_) JOIN tnorms m USING (name, variant)),
own AS (SELECT doc_id, path, name, score, ['line', 'block', 'file'][scope + 1] AS scope, CASE WHEN scope = 0 THEN at_ END AS line
  FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, scope, at_, name) = 1),
holders AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min(name, path) AS lic FROM own WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{FILE_NAMES}') GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
nearest AS (SELECT d.dir, arg_max(h.lic, length(h.dir)) AS lic, arg_max(h.dir, length(h.dir)) AS up FROM dirs d JOIN holders h ON d.dir = h.dir OR starts_with(d.dir, h.dir || '/') OR h.dir = '' GROUP BY d.dir)
SELECT f.doc_id, f.path, o.name AS license, o.score, o.scope, o.line,
  CASE WHEN o.name IS NULL THEN n.lic END AS inherited_license, CASE WHEN o.name IS NULL THEN n.up END AS inherited_from,
  coalesce(o.name, n.lic) AS effective_license, CASE WHEN o.name IS NOT NULL THEN 'own' WHEN n.lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM files f LEFT JOIN own o USING (doc_id, path) LEFT JOIN nearest n ON n.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""
