"""License scans in DataFrame functions only: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.orderminhash import _let, words_sql

SHINGLE = 3
#: A template is reported where a window holds at least this share of its shingles.
CONTAINMENT = 0.8
#: Windows that hold a template so far are missed by the bands with at most this probability.
MISS = 1e-4
ROWS = 1

# Wording of common license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MIT-line": "Released under the MIT License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
    "GPL-notice": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy "
        "of the GNU General Public License along with this program."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Rights-reserved-line": "All rights reserved.",
    "Rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}


def bands_for(containment: float = CONTAINMENT, miss: float = MISS, rows: int = ROWS) -> int:
    """Bands needed so that a window that holds `containment` of a template's shingles is retrieved but for `miss`.

    A window has at most twice the template's shingles, so its Jaccard similarity to the template is then at least
    containment / (3 - containment), and each band of `rows` hashes matches with that to the power of rows.
    """
    s = containment / (3 - containment)
    return math.ceil(math.log(miss) / math.log(1 - s**rows))


def _shingles(words: str, size: int = SHINGLE) -> str:
    """SQL: a hash for each run of `size` words, one of all words if there are fewer, none if there is none."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return f"case when size({words}) = 0 then cast(array() as array<bigint>) when size({words}) < {size} then array(xxhash64({words})) else transform(sequence(0, size({words}) - {size}), i -> xxhash64({at})) end"


def _normal(text: str) -> str:
    """SQL: lower case, with quotes, brackets and end punctuation taken as blanks."""
    return rf"regexp_replace(lower({text}), '[\"\'`()\\[\\]{{}}<>,;:.!?*#]+', ' ')"


def _bands(shingles: str, bands: int, rows: int = ROWS) -> str:
    """SQL: the band hashes of a set of shingle hashes, each led by its number."""
    least = [f"array_min(transform({shingles}, x -> xxhash64(x, {k})))" for k in range(bands * rows)]
    return "array(" + ", ".join(f"xxhash64({b}, {', '.join(least[b * rows : (b + 1) * rows])})" for b in range(bands)) + ")"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, length): one row per template, as many as the dictionary has."""
    made = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    made = made.select("license", F.expr(f"array_distinct({_let(words_sql(_normal('template')), 'w', _shingles('w'))})").alias("shingles"))
    return made.withColumn("length", F.size("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, bands: int | None = None) -> DataFrame:
    """Rows (doc_id, license, containment, first_word): the licenses found in each document's text.

    Words are lower-case and free of punctuation, shingles are three words long. For each length of a template the
    text's shingles are cut into windows twice as long that start one length apart, so a template lies in one of them
    as a whole. A window's MinHash bands look templates of its length up; there are enough bands that a window that
    contains a template is missed less often than MISS. What was looked up is kept if the window holds at least
    `containment` of the template's shingles, counted exactly. A window can share a minimum with a template only if
    it shares a shingle, so windows of foreign shingles alone are not hashed at all.

    Null or empty text: no rows. Null doc_id: scanned, returned as null. Rows that repeat a doc_id are merged: the
    best containment and the first place (a word's number, from 0) count. An empty table gives no rows. Columns
    besides doc_id and text are not read. Templates that lie in each other are each reported.
    """
    bands = bands or bands_for(containment)
    table = template_table(docs.sparkSession, templates)
    held = table.select("shingles", "length").collect()  # as many rows as templates
    known = ", ".join(f"{x}L" if x > -(2**63) else f"({x + 1}L - 1L)" for x in sorted({x for r in held for x in r.shingles}))
    lengths = ", ".join(map(str, sorted({r.length for r in held})))
    looked_up = table.select("license", F.col("length").alias("l"), F.col("shingles").alias("wanted"), F.explode(F.expr(_bands("shingles", bands))).alias("band"))

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    hashed = taken.select("doc_id", F.expr(_let(words_sql(_normal("text")), "w", _shingles("w"))).alias("s"))
    marked = hashed.select("doc_id", "s", F.expr(f"filter(transform(s, (x, i) -> if(x in ({known}), i, null)), i -> i is not null)").alias("hits")).filter("size(hits) > 0")
    placed = marked.select("doc_id", "s", "hits", F.explode(F.expr(f"array({lengths})")).alias("length"))
    starts = "array_distinct(flatten(transform(hits, i -> array(i div length, greatest(i div length - 1, 0)))))"
    windows = placed.select("doc_id", "s", "length", F.explode(F.expr(starts)).alias("j"))
    windows = windows.select("doc_id", "length", F.expr("cast(j as int) * length").alias("at"), F.expr("slice(s, cast(j as int) * length + 1, 2 * length)").alias("window")).filter("size(window) > 0")
    banded = windows.select("*", F.expr("array_distinct(window)").alias("own")).select("doc_id", "length", "at", "window", F.explode(F.expr(_bands("own", bands))).alias("band"))
    found = banded.join(F.broadcast(looked_up), (banded.length == looked_up.l) & (banded.band == looked_up.band)).select("doc_id", "license", "at", "window", "wanted")
    shared = found.withColumn("both", F.expr("array_intersect(wanted, window)")).withColumn("containment", F.expr("cast(size(both) as double) / size(wanted)"))
    kept = shared.filter(F.col("containment") >= containment)
    first = F.expr("cast(at + array_min(transform(both, x -> array_position(window, x))) - 1 as bigint)")
    return kept.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min(first).alias("first_word"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The rows of scan() over a table `documents`, from the definition of windows and containment, without bands."""

    def words(text: str) -> str:
        return rf"""regexp_extract_all(regexp_replace(lower({text}), '["''`()\[\]{{}}<>,;:.!?*#]+', ' ', 'g'), '[^\x20\x09-\x0D]+')"""

    def shingles(source: str, key: str) -> str:
        several = f"select {key}, i - 1 i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from (select {key}, w, unnest(range(1, len(w) - 1)) i from {source} where len(w) >= {SHINGLE})"
        return f"{several} union all select {key}, 0, array_to_string(w, ' ') from {source} where len(w) between 1 and {SHINGLE - 1}"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates.items())
    return f"""with t0 as (select license, {words('template')} w from (values {rows}) v(license, template)),
        t as (select distinct license, s from ({shingles('t0', 'license')})), n as (select license, count(*) n from t group by license),
        d0 as (select doc_id, {words('text')} w from documents where text is not null), d as ({shingles('d0', 'doc_id')}),
        h as (select doc_id, license, n, i, s, unnest([i // n, i // n - 1]) j from d join t using (s) join n using (license)),
        c as (select doc_id, license, cast(count(distinct s) as double) / any_value(n) containment, min(i) i from h where j >= 0 group by doc_id, license, j)
        select doc_id, license, max(containment) containment, min(i) first_word from c where containment >= {containment} group by doc_id, license"""
