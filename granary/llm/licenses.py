"""Licence scans: Dice coefficient over word bigrams against templates, with size bounds."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import rows_of, table

#: Least Dice coefficient of a match.
THRESHOLD = 0.9

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
#: Licence id and template text: full texts of short licences, and the notices by which a text names a licence.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "proprietary-notice": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The normalised text: runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    w = words(text)
    return frozenset(zip(w, w[1:]))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a bigram set may have to reach the threshold with a template of ``size`` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, windows: bool = False):
        self.threshold, self.windows = threshold, windows
        self.sets = {k: b for k, t in sorted(templates.items()) if (b := bigrams(t))}
        self.limits = {k: bounds(len(b), threshold) for k, b in self.sets.items()}
        # bigrams in common that a set of the least size needs
        self.need = {k: math.ceil(threshold * (len(b) + self.limits[k][0]) / 2 - 1e-9) for k, b in self.sets.items()}
        self.owners: dict[tuple[str, str], list[str]] = {}
        for k, b in self.sets.items():
            for g in b:
                self.owners.setdefault(g, []).append(k)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice coefficient, first line, last line): for each template its best run of lines or window of words, if good enough.

        Every run of whole lines counts; those that begin or end with a line
        without a template bigram can't be best and are skipped. With
        ``windows`` every run of words counts, wherever in a line it begins and
        ends. Ties go to the earlier, then the shorter run.
        """
        if not text:
            return []
        w = words(text)
        owners = self.owners
        hits = [(p, g) for p, g in enumerate(zip(w, w[1:])) if g in owners]
        if not hits:
            return []
        found: dict[str, set] = {}
        for _, g in hits:
            for k in owners[g]:
                found.setdefault(k, set()).add(g)
        wanted = [k for k, f in found.items() if len(f) >= self.need[k]]
        if not wanted:
            return []
        line_of: list[int] = []
        starts: dict[int, int] = {}
        for n, line in enumerate(text.split("\n")):
            k = len(words(line))
            if k:
                starts[n] = len(line_of)
                line_of += [n] * k
        out = []
        for k in sorted(wanted):
            template, (lo, hi) = self.sets[k], self.limits[k]
            mine = [(p, g) for p, g in hits if g in template]
            if self.windows:
                if best := self._window(w, mine, template, lo, hi):
                    out.append((k, round(best[0], 6), line_of[best[1]], line_of[best[2]]))
                continue
            touched = sorted({line_of[q] for p, _ in mine for q in (p, p + 1)})
            ends = set(touched)
            best = None
            for first in touched:
                seen: set = set()
                common = 0
                last_word = len(w) - 1
                at = starts[first]
                # the run grows word by word until it is too large or has all that the template has
                for p in range(at, len(w)):
                    if p > at:
                        g = (w[p - 1], w[p])
                        if g not in seen:
                            seen.add(g)
                            common += g in template
                            if len(seen) > hi:
                                break
                    if p == last_word or line_of[p + 1] != line_of[p]:
                        if line_of[p] in ends and len(seen) >= lo:
                            dice = 2 * common / (len(seen) + len(template))
                            if dice >= self.threshold - 1e-12 and (best is None or dice > best[0] + 1e-12):
                                best = (dice, first, line_of[p])
                        if common == len(template):
                            break
            if best:
                out.append((k, round(best[0], 6), best[1], best[2]))
        return out


    def _window(self, w: list[str], mine: list, template: frozenset, lo: int, hi: int) -> tuple[float, int, int] | None:
        """(Dice coefficient, first word, last word) of the best window, from one template bigram to another.

        A window that has its first bigram again is no better than the one
        without its first word, so none grows that far. Where the words that the
        last look from the same bigram went over come again, so would its result,
        and that is later; so text that repeats costs a comparison of lists.
        """
        best = None
        looked: dict[tuple[str, str], tuple[int, int]] = {}
        for p0, g0 in mine:
            if g0 in looked:
                q0, q = looked[g0]
                if w[p0 : p0 + q - q0] == w[q0:q]:
                    continue
            seen, common = {g0}, 1
            p = p0
            while True:
                if len(seen) >= lo and (w[p], w[p + 1]) in template:
                    dice = 2 * common / (len(seen) + len(template))
                    if dice >= self.threshold - 1e-12 and (best is None or dice > best[0] + 1e-12):
                        best = (dice, p0, p + 1)
                p += 1
                if common == len(template) or p + 1 >= len(w):
                    break
                g = (w[p], w[p + 1])
                if g == g0:
                    break
                if g not in seen:
                    seen.add(g)
                    common += g in template
                    if len(seen) > hi:
                        break
            looked[g0] = p0, p + 2
        return best


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", windows: bool = True) -> DataFrame:
    """(id, license_id, dice, first_line, last_line), lines counted from 0: one row for each template that a document has a window of words for.

    Texts and templates are compared as sets of word bigrams, words being runs
    of letters and digits in lower case. A window begins and ends at any word;
    without ``windows`` only runs of whole lines count. Only templates whose size lies within
    the bounds that the threshold puts on a run's size, and that the document
    has enough bigrams of, are compared. Null and empty texts and templates
    without a bigram match nothing, nor does an empty table. A text of any length
    is scanned whole, in time that grows with its length. Repeated rows give
    repeated results, of windows that tie the first counts; other columns are
    ignored. Nothing is shuffled; templates travel with the code.
    """
    picked = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    templates = TEMPLATES if templates is None else templates
    schema = T.StructType(
        [
            T.StructField(id_col, picked.schema[0].dataType),
            T.StructField("license_id", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("first_line", T.IntegerType()),
            T.StructField("last_line", T.IntegerType()),
        ]
    )

    return picked.mapInArrow(_as_arrow(templates, threshold, schema, windows), schema)


def _as_arrow(templates, threshold, schema, windows):
    names = schema.names

    def run(batches):
        scanner = Scanner(templates, threshold, windows)
        for batch in rows_of(batches, 500):
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for m in scanner.scan(t):
                    at.append(k)
                    rows.append(m)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=names)

    return run


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_T = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())
OP5_SQL = rf"""
WITH tt(license_id, body) AS (VALUES {_T}),
tw AS (SELECT license_id, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM tt),
tb AS (SELECT DISTINCT license_id, w[i] || ' ' || w[i + 1] AS g FROM tw, range(1, len(w)) AS r(i)),
ts AS (SELECT license_id, count(*) AS m, ceil(count(*) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) AS lo, floor(count(*) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9) AS hi FROM tb GROUP BY 1),
lines AS (SELECT doc_id, i - 1 AS line, regexp_extract_all(lower(ls[i]), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), range(1, len(ls) + 1) AS r(i)),
tokens AS (SELECT doc_id, line, w[i] AS word, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS p FROM lines, range(1, len(w) + 1) AS r(i)),
b AS (SELECT a.doc_id, a.line AS l1, c.line AS l2, a.word || ' ' || c.word AS g FROM tokens a JOIN tokens c ON a.doc_id = c.doc_id AND c.p = a.p + 1),
hits AS (SELECT b.*, tb.license_id FROM b JOIN tb USING (g)),
few AS (SELECT doc_id, license_id FROM hits JOIN ts USING (license_id) GROUP BY doc_id, license_id, m, lo HAVING count(DISTINCT g) >= ceil({THRESHOLD} * (m + lo) / 2 - 1e-9)),
ends AS (SELECT DISTINCT doc_id, license_id, l FROM (SELECT doc_id, license_id, l1 AS l FROM hits UNION ALL SELECT doc_id, license_id, l2 FROM hits) JOIN few USING (doc_id, license_id)),
runs AS (SELECT a.doc_id, a.license_id, a.l AS i, c.l AS j FROM ends a JOIN ends c ON a.doc_id = c.doc_id AND a.license_id = c.license_id AND a.l <= c.l),
sized AS (SELECT r.doc_id, r.license_id, r.i, r.j, count(DISTINCT b.g) AS n, count(DISTINCT CASE WHEN tb.g IS NOT NULL THEN b.g END) AS c
          FROM runs r JOIN b ON b.doc_id = r.doc_id AND b.l1 >= r.i AND b.l2 <= r.j LEFT JOIN tb ON tb.license_id = r.license_id AND tb.g = b.g GROUP BY ALL),
scored AS (SELECT s.*, 2.0 * c / (n + m) AS dice FROM sized s JOIN ts USING (license_id) WHERE n BETWEEN lo AND hi)
SELECT doc_id, license_id, round(CAST(dice AS DOUBLE), 6) AS dice, CAST(i AS INTEGER) AS first_line, CAST(j AS INTEGER) AS last_line FROM scored WHERE dice >= {THRESHOLD} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY dice DESC, i, j) = 1
"""
