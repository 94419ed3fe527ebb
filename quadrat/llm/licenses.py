"""Licence scans: passages against licence templates, by Dice over word bigrams.

Texts are normalised to lower-case runs of a-z and 0-9. Passages are the lines, paragraphs and whole texts, and windows
of a template's length, so a notice is found among other words as well. Two sets of bigrams can only reach the
least Dice if the smaller has least / (2 - least) of the larger's size. That bounds the passages a template is compared with, and
says how many of its bigrams any such passage shares: of a template's longest bigrams, its anchors, a fixed number at
least. All bigrams of the texts are joined with the anchors; a text's candidates are the templates of which it holds enough anchors, and
each anchor lays a window of the template's words over the text. Only texts with candidates are looked at again.

All in DataFrame functions. Counts of anchors are made where the text is read, so only candidates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_by_text, sealed, settle
from .winnowing import SMALL, UPPER

#: Candidates' texts, up to which what they hold is broadcast; beyond it rows are joined by the hash of the text.
MOST_HELD = 50_000

#: Public licences and the usual notices that refer to them, by their short names.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def words_sql(text: str) -> str:
    return f"filter(split(regexp_replace(translate({text}, '{UPPER}', '{SMALL}'), '[^a-z0-9]+', ' '), ' '), x -> x <> '')"


def pairs_sql(words: str) -> str:
    """All bigrams, in their order."""
    return f"CASE WHEN size({words}) > 1 THEN zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> concat(a, ' ', b)) ELSE cast(array() AS array<string>) END"


def prepared(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame, least_percent: int) -> DataFrame:
    """(tid, name, n_words, b, least, anchors): a template's distinct bigrams, how many anchors a passage holds at least, and its anchors."""
    told = templates if isinstance(templates, DataFrame) else spark.createDataFrame([(k, t) for k, t in templates], "name string, text string")
    told = told.selectExpr("name", f"{words_sql('text')} AS w").selectExpr("name", "size(w) AS n_words", f"{pairs_sql('w')} AS p").where("size(p) > 0").distinct()
    told = told.selectExpr("xxhash64(name, p) AS tid", "name", "n_words", "p", "array_distinct(p) AS b").withColumn("shared", F.expr(f"cast(ceil({least_percent} * size(b) / {200 - least_percent}) AS int)"))
    told = told.withColumn("least", F.expr("least(shared, greatest(1, size(b) div 4))"))
    longest = "transform(array_sort(transform(b, x -> struct(-length(x) AS n, x AS g))), x -> x.g)"
    return told.withColumn("anchors", F.expr(f"slice({longest}, 1, size(b) - shared + least)"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, least_percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows with licenses (sorted short names, comma-joined), n_templates and dice (the best, in percent, rounded down).

    templates: (name, text), as a list or a table; it is broadcast, some hundreds of texts are meant. A passage (a line,
    a paragraph between blank lines, the whole text, or a window of the template's number of words laid by an anchor)
    is a licence if 200 * shared >= least_percent * (its bigrams + the template's), of distinct bigrams. Of templates whose
    best windows overlap, those stay that have the most bigrams shared less those not shared; n_templates
    counts them. Null and empty texts, and passages of one word, have none: licenses is empty and dice 0.
    Repeated rows are each given what their text holds. Columns that have the new names are replaced.
    """
    spark = docs.sparkSession
    new = ("licenses", "n_templates", "dice")
    keep = [c for c in docs.columns if c.lower() not in new]
    told = settle(prepared(spark, templates, least_percent))
    anchors = told.select("tid", "least", "p", F.explode("anchors").alias("g")).selectExpr("xxhash64(g) AS h", "tid", "least", "explode(filter(sequence(1, size(p)), i -> p[i - 1] = g)) AS at")
    texts = docs.select(*keyed_by_text(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # Hashes of bigrams by place; made before they are dealt out, so no filter repeats the steps.
    places = texts.withColumn("w", F.expr(words_sql("__text"))).select("__h1", "__h2", F.posexplode(F.expr(f"transform({pairs_sql('w')}, x -> xxhash64(x))")).alias("place", "h"))
    hits = places.join(F.broadcast(anchors), "h").groupBy("__h1", "__h2", "tid").agg(F.first("least").alias("least"), F.collect_set("h").alias("met"), F.collect_set(F.col("place") + 1 - F.col("at")).alias("lays"))
    hits = settle(hits.where("size(met) >= least").select("__h1", "__h2", "tid", "lays"))
    # The texts with candidates, once each, with their candidates.
    some = hits.select(F.col("__h1").alias("k1"), F.col("__h2").alias("k2")).distinct()
    some = F.broadcast(some) if some.count() <= MOST_HELD else some
    seen = texts.join(some, (F.col("__h1") == F.col("k1")) & (F.col("__h2") == F.col("k2")), "left_semi").dropDuplicates(["__h1", "__h2"])
    met = hits.join(F.broadcast(told.select("tid", "name", "n_words", "b")), "tid").groupBy("__h1", "__h2").agg(F.collect_list(F.struct("name", "n_words", "b", "lays")).alias("ts"))
    rows = seen.join(met, ["__h1", "__h2"])
    rows = sealed(rows.select("__h1", "__h2", "ts", F.expr(words_sql("__text")).alias("w"), F.expr(f"transform(array_distinct(concat(split(__text, '\\n'), split(__text, '\\n[ \\t\\r]*\\n'), array(__text))), u -> {words_sql('u')})").alias("units")), ["w", "units"])
    rows = sealed(rows.select("__h1", "__h2", "ts", "w", F.expr(f"transform(filter(units, u -> size(u) > 1), u -> array_distinct({pairs_sql('u')}))").alias("sets")), ["sets"])
    bounds = f"{least_percent} * (size(u) + size(t.b)) <= 200 * least(size(u), size(t.b))"
    window = "slice(w, greatest(l, 0) + 1, least(l, 0) + t.n_words)"
    # Of each passage: Dice in percent, the bigrams shared, and for windows their place, the first last.
    told = lambda bigrams, place: f"transform(array({bigrams}), v -> transform(array(size(array_intersect(v, t.b))), c -> named_struct('dice', 200 * c div (size(v) + size(t.b)), 'shared', c, 'place', {place}))[0])[0]"
    units = f"transform(filter(sets, u -> {bounds}), u -> {told('u', 'cast(null AS int)')})"
    laid = f"transform(t.lays, l -> {told(f'array_distinct(transform(array({window}), v -> {pairs_sql("v")})[0])', '-l')})"
    of_one = f"transform(array({laid}), w -> named_struct('name', t.name, 'n', t.n_words, 'size', size(t.b), 'best', array_max(concat({units}, w)), 'place', -array_max(w).place))[0]"
    rows = sealed(rows.select("__h1", "__h2", F.expr(f"transform(ts, t -> {of_one})").alias("all")), ["all"])
    # 200 * shared >= least * both is dice, rounded down, >= least. Of two templates over the same words, the one that explains more of them stays.
    rows = rows.select("__h1", "__h2", F.expr(f"filter(all, x -> x.best.dice >= {least_percent})").alias("some"))
    gain = "2 * {0}.best.shared - {0}.size"
    rows = rows.select("__h1", "__h2", F.expr(f"filter(some, x -> NOT exists(some, y -> {gain.format('y')} > {gain.format('x')} AND y.place < x.place + x.n AND x.place < y.place + y.n))").alias("good"))
    rows = sealed(rows, ["good"]).where("size(good) > 0").selectExpr("__h1 AS k1", "__h2 AS k2", "array_join(array_sort(array_distinct(transform(good, x -> x.name))), ',') AS __licenses", "cast(size(good) AS bigint) AS __n", "cast(array_max(transform(good, x -> x.best.dice)) AS bigint) AS __dice")
    found = settle(rows)
    found = F.broadcast(found) if found.count() <= MOST_HELD else found
    out = docs.select(*keyed_by_text(F.col(text_col)), *[F.col(f"`{c}`") for c in keep]).join(found, (F.col("__h1") == F.col("k1")) & (F.col("__h2") == F.col("k2")), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__licenses", F.lit("")).alias("licenses"), F.coalesce("__n", F.lit(0).cast("long")).alias("n_templates"), F.coalesce("__dice", F.lit(0).cast("long")).alias("dice"))
