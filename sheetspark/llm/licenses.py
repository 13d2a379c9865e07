"""Licence scans: normalised text against templates by Dice coefficient over word
bigrams, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Opened, let

#: Notices and permission texts as their licences state them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS '
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

SEPARATORS = "".join(chr(c) for c in range(0x20, 0x80) if not chr(c).isalnum())


def _normal(text: Column) -> Column:
    """A-Z in lower case, every other ASCII character but digits and line breaks as a
    blank."""
    marks = SEPARATORS + "\t\x0b\x0c\r"
    return F.translate(text, UPPER + marks, UPPER.lower() + " " * len(marks))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Distinct word bigrams; a single word is one."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
        F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))),
    )
    return F.array_distinct(pairs)


def _few_bigrams(words: Column, least: int, most: int) -> Column:
    """The distinct bigrams, or null where their number is not from least to most.

    Fewer words than ``least`` cannot have as many, and when the beginning has more
    than ``most`` the whole has: so long texts cost no more than their beginning.
    """
    ahead = 2 * most + 1
    few = F.when(F.size(words) <= ahead, _bigrams(words)).otherwise(
        let(_bigrams(F.slice(words, 1, ahead)), lambda g: F.when(F.size(g) <= most, _bigrams(words)))
    )
    return F.when(F.size(words) >= least, let(few, lambda g: F.when(F.size(g).between(least, most), g)))


def _blocks(lines: Column, alike: Column) -> Column:
    """Runs of two or more licence-like lines that follow each other."""

    def ends(step: int) -> Column:
        at_end = F.transform(alike, lambda a, i: F.when(a & ~F.coalesce(F.get(alike, i + step), F.lit(False)), i))
        return F.filter(at_end, lambda i: i.isNotNull())

    runs = F.filter(F.arrays_zip(ends(-1).alias("first"), ends(1).alias("last")), lambda r: r["first"] < r["last"])

    def unit(r: Column) -> Column:
        first = F.get(lines, r["first"])["line"]
        words = F.flatten(F.transform(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), lambda x: x["words"]))
        return F.struct(first.alias("line"), (F.get(lines, r["last"])["line"] - first + 1).alias("lines"), words.alias("words"))

    return F.transform(runs, unit)


def _units(text: Column, vocabulary: list[str], least: int, most: int) -> Column:
    """Units of a text with their bigrams, but for those of sizes that match nothing."""
    known = F.array(*[F.lit(w) for w in vocabulary])

    def licence_like(words: Column) -> Column:
        return let(F.array_distinct(words), lambda d: 5 * F.size(F.array_intersect(d, known)) >= 3 * F.size(d))

    def of_lines(lines: Column) -> Column:
        whole = F.struct(
            F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("lines"), F.flatten(F.transform(lines, lambda x: x["words"])).alias("words")
        )
        single = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.lit(1).alias("lines"), x["words"].alias("words")))
        blocks = let(F.transform(lines, lambda x: licence_like(x["words"])), lambda alike: _blocks(lines, alike))
        sized = F.transform(
            F.concat(F.array(whole), single, blocks),
            lambda u: F.struct(u["line"].alias("line"), u["lines"].alias("lines"), _few_bigrams(u["words"], least, most).alias("found")),
        )
        return F.filter(sized, lambda u: u["found"].isNotNull())

    split = F.transform(F.split(_normal(text), "\n"), lambda t, i: F.struct(i.alias("line"), _words(t).alias("words")))
    return let(F.filter(split, lambda x: F.size(x["words"]) > 0), of_lines)


def _template_table(spark, templates: Sequence[tuple[str, str]], percent: int) -> DataFrame:
    """Templates with their bigrams, one row for each size that can match them.

    Dice of percent / 100 between sets of n and m needs n in
    [percent * m / (200 - percent), m * (200 - percent) / percent].
    """
    rows = [(name, i, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "license string, template int, body string").withColumn("words", _words(_normal(F.col("body")))).withColumn("grams", _bigrams(F.col("words")))
    m = F.size("grams")
    low = F.ceil(F.lit(percent) * m / F.lit(200 - percent)).cast("int")
    high = F.floor(F.lit(200 - percent) * m / F.lit(percent)).cast("int")
    sized = table.where(F.size("words") > 0).select("license", "template", "words", "grams", m.alias("m"), low.alias("low"), high.alias("high"))
    return sized.withColumn("size", F.explode(F.sequence("low", "high")))


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    broadcast_bigrams: int = 500_000,
) -> DataFrame:
    """Licences of each document, one row for every unit that matches a template.

    Words are lower-cased (A-Z) and parted at ASCII punctuation and white space. Units
    are the whole text, each line with a word, and each block: two or more consecutive
    lines with words (lines without any are passed over) of which at least 60 % of the
    different words occur in the templates, as many as follow each other. So a notice
    wrapped over lines is found among other lines. A unit matches a template when the
    Dice coefficient of their sets of word bigrams, 200 * common / (n + m), is
    ``percent`` or more. Only templates whose size allows that are compared: units
    meet them by an equal join on the number of bigrams, and units of a size that
    no template allows are given up before their bigrams are complete. Of several
    templates the most alike counts, then the first.

    Returns ``id_col line lines license template dice`` (``line`` from 0 and the number
    of lines; null for the whole text). Null and empty texts match nothing; very long
    texts are judged as any other, in one row; repeated rows are listed each; other
    columns are not read, whatever their names; an empty table gives no rows. Template bigrams of
    up to ``broadcast_bigrams``, all sizes counted, are broadcast; more are left to
    Spark's own choice of join.
    """
    opened = Opened(docs, id_col, text_col)
    table = _template_table(docs.sparkSession, templates, percent)
    held, least, most = table.agg(F.sum("m"), F.min("low"), F.max("high")).first()
    vocabulary = [r[0] for r in table.select(F.explode("words")).distinct().orderBy("col").collect()]
    units = _units(F.col(opened.text), vocabulary, least or 1, most or 0)
    each = opened.df.select("key", F.col(opened.id).alias("id"), F.explode(units).alias("u"))
    counted = each.select("key", "id", "u.line", "u.lines", "u.found").withColumn("size", F.size("found"))
    grams = table.drop("words", "low", "high")
    met = counted.join(F.broadcast(grams) if (held or 0) <= broadcast_bigrams else grams, "size")
    common = F.size(F.array_intersect("found", "grams"))
    scored = met.select("key", "id", "line", "lines", "license", "template", (200.0 * common / (F.col("size") + F.col("m"))).alias("dice"))
    alike = scored.where(F.col("dice") >= percent)
    best = alike.groupBy("key", "id", "line", "lines").agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), "line", "lines", F.col("b.license").alias("license"), (-F.col("b.t")).alias("template"), F.round("b.dice", 6).alias("dice")
    )


def op6_license_scan(spark, folder: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _grams_sql(words: str) -> str:
    return (
        f"CASE WHEN len({words}) = 1 THEN [{words}[1] || ' '] ELSE "
        f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) END"
    )


def _words_sql(text: str) -> str:
    """Words parted at ASCII characters other than letters and digits, lower-cased A-Z."""
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{UPPER.lower()}'), '[^\\x09-\\x0D\\x20-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP6_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_quoted(n)}, {_quoted(b)})' for i, (n, b) in enumerate(TEMPLATES))}) AS v(template, license, body)),
  tw AS (SELECT template, license, {_words_sql('body')} AS w FROM t),
  tg AS (SELECT template, license, {_grams_sql('w')} AS grams FROM tw),
  known AS (SELECT list(DISTINCT x) AS v FROM (SELECT unnest(w) AS x FROM tw)),
  split AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS body
    FROM documents WHERE text IS NOT NULL),
  words AS (SELECT doc_id, line, {_words_sql('body')} AS w FROM split),
  lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM words WHERE len(w) > 0),
  alike AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM lines, known
    WHERE 5 * len(list_intersect(list_distinct(w), v)) >= 3 * len(list_distinct(w))),
  uw AS (SELECT doc_id, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS lines, flatten(list(w ORDER BY line)) AS w FROM lines GROUP BY doc_id
    UNION ALL SELECT doc_id, line, 1, w FROM lines
    UNION ALL SELECT doc_id, min(line), max(line) - min(line) + 1, flatten(list(w ORDER BY line)) FROM alike GROUP BY doc_id, run HAVING count(*) > 1),
  ug AS (SELECT doc_id, line, lines, {_grams_sql('w')} AS found FROM uw),
  s AS (SELECT doc_id, line, lines, template, license, 200.0::DOUBLE * len(list_intersect(found, grams)) / (len(found) + len(grams)) AS dice FROM ug, tg
    WHERE len(found) <= 2 * len(grams) AND len(grams) <= 2 * len(found))
SELECT doc_id, line, lines, arg_max(license, (dice, -template)) AS license, CAST(arg_max(template, (dice, -template)) AS INTEGER) AS template,
  round(max(dice), 6) AS dice FROM s WHERE dice >= 80 GROUP BY doc_id, line, lines
"""
