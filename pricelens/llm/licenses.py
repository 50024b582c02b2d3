"""Licence scans: a trained paragraph classifier confirmed by templates.

A paragraph is the lines of a text up to one without words.  It is judged in
stretches of ``STRETCH`` words that overlap by half, so a notice of up to half
a stretch lies in one as a whole; overlapping hits are merged, within a family or
with unknown ones, and reported as the run of words that speaks for the family.
Sparse features are hashed word 1- to 3-grams, each once; a multinomial
logistic regression over them names a licence family, ``unknown`` (licence
wording of no known family) or ``none``.  It is fitted here on varied pieces of
the templates below and on stretches of a bounded sample: the ``SAMPLE_DOCS``
documents of least hash, read whole, and of their distinct stretches the
``SAMPLE_STRETCHES`` of least hash.  Its temperature and the least probability of
a named family are calibrated on a part kept out of the fit.  A named family
must also resemble one of its templates (shared 2-grams), else the stretch is
``unknown``.  A stretch is reported if ``none`` is less likely than a bound, 0.1
to 0.5, that all but ``FALSE_ALARMS`` of the other stretches in the calibration
part exceed, if the bound can be as low; likeness to a template is no
condition.  A paragraph of one word, alone or repeated, is no wording: it is
reported only if the word is one of ``IDENTIFIERS``, with its family and
probability 1.

Prediction reads whole texts, slice by slice, without a shuffle.  Null and
empty texts have no paragraphs, an empty table no rows.  Repeated rows are
answered once each.  The columns asked for in ``keep`` pass through, whatever
their names; others aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, fresh, mix, slices, words_of

BITS = 16
STRETCH = 16
SAMPLE_DOCS, SAMPLE_STRETCHES = 400, 4000
SEED = 7
#: Share of 2-grams shared with a template of the family.
CONFIRM = 0.5
#: Share of paragraphs without licence wording that may be reported.
FALSE_ALARMS = 0.001
NONE, UNKNOWN = "none", "unknown"

#: Usual notices of each family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    UNKNOWN: (
        "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
        "Use of this material is governed by the terms of the licence agreement you accepted.",
        "Licensed under the Example Community Terms, revision 7.",
        "This content is released under its own licence; see the terms for details.",
        "Proprietary and confidential. Unauthorised copying is prohibited.",
    ),
}
#: Short names that stand for a licence on their own, compared as written.
IDENTIFIERS = {
    "apache": ("Apache-2.0", "Apache2.0", "ASL2.0"),
    "mit": ("MIT", "Expat"),
    "bsd": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "0BSD"),
    "gpl": ("GPL", "GPLv2", "GPLv2+", "GPLv3", "GPLv3+", "LGPL", "LGPLv2.1", "LGPLv3", "AGPL", "AGPLv3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
            "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "mpl": ("MPL", "MPLv2", "MPL-1.1", "MPL-2.0"),
    "cc": ("CC0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
}
_NAMED = {x: family for family, names in IDENTIFIERS.items() for x in names}
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


@dataclass
class Stretches:
    """Hashed 1- to 3-grams of each stretch's words (rows x 3, -1 where they would leave the stretch or occur in it
    before); of each stretch its first row, its first and last word, its text and paragraph; of each word its line."""

    grams: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    paragraph: np.ndarray
    whole: np.ndarray
    lines: np.ndarray
    words: Words


def _stretches(col: pa.Array) -> Stretches:
    w = words_of(col, lower=True, word_bytes=_LETTERS)
    n = len(w.starts)
    empty = np.empty(0, np.int64)
    if not n:
        return Stretches(np.empty((0, 3), np.int64), empty, empty, empty, empty, empty, empty, empty, w)
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.starts)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    new = np.ones(n, dtype=bool)
    new[1:] = (line[1:] > line[:-1] + 1) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    # a stretch begins at every half stretch, as long as it holds words that the one before doesn't
    half = STRETCH // 2
    many = np.maximum(1, -(-size // half) - 1)
    paragraph = np.repeat(np.arange(len(begin)), many)
    first = begin[paragraph] + half * (np.arange(len(paragraph)) - np.repeat(np.cumsum(many) - many, many))
    wide = np.minimum(STRETCH, begin[paragraph] + size[paragraph] - first)
    starts = np.cumsum(wide) - wide
    stretch = np.repeat(np.arange(len(first)), wide)
    step = np.arange(len(stretch)) - starts[stretch]
    at = first[stretch] + step
    grams = np.full((len(at), 3), -1, dtype=np.int64)
    acc = w.hashes.copy()
    for k in range(3):
        if k:
            acc = acc[:-1] * np.uint64(0xD6E8FEB86659FD93) + w.hashes[k:]
        got = (mix(acc + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = step + k < wide[stretch]
        grams[inside, k] = got[at[inside]]
    flat = grams.reshape(-1)
    once = np.full_like(flat, -1)
    _, at = np.unique(np.repeat(stretch, 3) << (BITS + 1) | flat + 1, return_index=True)
    once[at] = flat[at]
    base = np.concatenate(([0], np.searchsorted(breaks, np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in col])[1:])))
    return Stretches(once.reshape(-1, 3), starts, first, first + wide - 1, text[first], paragraph, many[paragraph] == 1, line - base[text], w)


def _features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Grams, first rows, texts and lines of the stretches, and the words."""
    x = _stretches(col)
    return x.grams, x.starts, x.text, x.lines[x.first], x.words


def _bigrams(text: str) -> set[tuple[str, str]]:
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return set(zip(words[:-1], words[1:], strict=True))


@dataclass
class LicenseModel:
    """Weights (features x classes), bias, temperature, the least probability of a family and the bound on that of ``none``."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    none_below: float = 0.5

    def logits(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        used = grams >= 0
        w = self.weights[np.where(used, grams, 0)] * used[:, :, None]
        total = np.add.reduceat(w.sum(axis=1), starts, axis=0)
        many = np.add.reduceat(used.sum(axis=1), starts)
        return total / np.sqrt(many)[:, None] + self.bias

    def probabilities(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.logits(grams, starts) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def training_rows(negatives: list[str], seed: int = SEED, variants: int = 60) -> list[tuple[str, str]]:
    """Varied template pieces, and the negatives: (text, class)."""
    rng = np.random.default_rng(seed)
    fill = [w for t in negatives for w in t.split()] or ["lorem"]
    rows = [(t, NONE) for t in negatives]
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = t.split()
            rows.append((t, family))
            for _ in range(variants):
                lo, hi = 0, len(words)
                if len(words) > 14:
                    lo = int(rng.integers(0, len(words) - 12))
                    hi = int(rng.integers(lo + 12, len(words) + 1))
                part = [w for w in words[lo:hi] if rng.random() > 0.04]
                pad = lambda: [fill[int(i)] for i in rng.integers(0, len(fill), int(rng.integers(0, 5)))]
                rows.append((" ".join([*pad(), *part, *pad()]), family))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def fit(rows: list[tuple[str, str]], steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> LicenseModel:
    """Multinomial logistic regression on two thirds of the rows; calibration on the rest."""
    classes = [NONE, *TEMPLATES]
    part = np.arange(len(rows)) % 3 == 2

    def design(own: list[tuple[str, str]]):
        x = _stretches(pa.array([t.replace("\n", " ") for t, _ in own], pa.string()))
        return x.grams, x.starts, np.array([classes.index(own[i][1]) for i in x.text.tolist()])

    grams, starts, y = design([r for r, p in zip(rows, part, strict=True) if not p])
    used = grams >= 0
    stretch = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(grams))))
    cell, feature = np.broadcast_to(stretch[:, None], grams.shape)[used], grams[used]
    value = 1 / np.sqrt(np.bincount(cell, minlength=len(starts)))[cell]
    m = LicenseModel(classes, np.zeros((1 << BITS, len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32))
    goal = np.eye(len(classes))[y]
    for _ in range(steps):
        error = (goal - m.probabilities(grams, starts)) / len(y)
        for k in range(len(classes)):
            m.weights[:, k] += (rate * 20 * (np.bincount(feature, value * error[cell, k], 1 << BITS) - decay * m.weights[:, k] / 20)).astype(np.float32)
        m.bias += (rate * error.sum(axis=0)).astype(np.float32)
    grams, starts, y = design([r for r, p in zip(rows, part, strict=True) if p])

    def loss(t: float) -> float:
        m.temperature = t
        return -np.log(m.probabilities(grams, starts)[np.arange(len(y)), y] + 1e-12).mean()

    m.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = m.probabilities(grams, starts)
    right = p[np.arange(len(y)), y][(p.argmax(axis=1) == y) & (y > 0)]
    m.least = float(np.clip(np.quantile(right, 0.01), 0.3, 0.9)) if len(right) else 0.5
    others = p[y == 0, 0]
    m.none_below = float(np.clip(np.quantile(others, FALSE_ALARMS), 0.1, 0.5)) if len(others) else 0.5
    return m


def sampled_stretches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_stretches: int = SAMPLE_STRETCHES) -> list[str]:
    """Stretches of the lines of sampled documents: bounded, the same for the same rows.

    Documents are taken by a bound on the hash of ``doc_id``, so the tasks send
    about twice ``sample_docs`` rows in all; their lines are cut to stretches
    over the whole text, of which those of least hash are drawn.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 32)
    some = docs.where(F.col(text).isNotNull())
    share = min(1.0, 2 * sample_docs / max(1, some.count()))
    drawn = some.select(draw.alias("draw"), F.col(text).alias("t")).where(F.col("draw") < int(share * 2**32)).orderBy("draw", "t").limit(sample_docs)
    words = drawn.select(F.explode(F.split("t", "\n")).alias("line")).select(F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    parts = words.select(F.explode(F.transform(F.expr(f"sequence(0, (size(w) - 1) DIV {STRETCH})"), lambda i: F.array_join(F.slice("w", i * STRETCH + 1, F.lit(STRETCH)), " "))).alias("part")).distinct()
    return [r["part"] for r in parts.orderBy(F.xxhash64("part"), "part").limit(sample_stretches).collect()]


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_stretches: int = SAMPLE_STRETCHES) -> LicenseModel:
    """Fit on template pieces and on sampled stretches of the documents; those
    that hold a licence word are left out of the negatives."""
    trigger = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistribut", "proprietary", "spdx", "creative commons", "warrant")
    parts = sampled_stretches(docs, text, doc_id, sample_docs, sample_stretches)
    return fit(training_rows([x for x in parts if not any(w in x.lower() for w in trigger)]))


@dataclass
class Hit:
    """A reported run of words: where, and as what."""

    text: int
    paragraph: int
    first: int
    last: int
    family: str
    probability: float
    similarity: float = 0.0


def _span(m: LicenseModel, grams: np.ndarray, best: int) -> tuple[int, int]:
    """The run of words that speaks most for class ``best`` against ``none``: first and last of the rows."""
    used = grams >= 0
    gain = ((m.weights[:, best] - m.weights[:, 0])[np.where(used, grams, 0)] * used).sum(axis=1)
    gain = gain - gain.max() / 10  # words that say nothing don't lengthen the run
    total = np.concatenate(([0.0], np.cumsum(gain)))
    least = np.minimum.accumulate(total[:-1])
    last = int((total[1:] - least).argmax())
    return int(total[:last + 1].argmin()), min(last + 2, len(grams) - 1)  # a gram reaches two words further


def _judged(m: LicenseModel, x: Stretches, templates: dict[str, list[set]]) -> list[Hit]:
    """The hits of a slice, merged where they overlap or touch and are not of two families."""
    p = m.probabilities(x.grams, x.starts)
    short = x.whole & (x.last - x.first < 8)
    ends = np.append(x.starts[1:], len(x.grams))
    out: list[Hit] = []
    for i in np.flatnonzero((p[:, 0] < m.none_below) | short).tolist():
        first, last = int(x.first[i]), int(x.last[i])
        family = _NAMED.get(_blank_word(x.words, first, last)) if short[i] else None
        sure = 1.0
        if family is None:
            own = _bigrams(_between(x.words, first, last))
            if p[i, 0] >= m.none_below or all(a == b for a, b in own):
                continue
            best = 1 + int(p[i, 1:].argmax())
            family, sure = m.classes[best], float(p[i, best])
            a, z = _span(m, x.grams[x.starts[i]:ends[i]], best)
            first, last = first + a, first + z
            own = _bigrams(_between(x.words, first, last)) or own
            if family == UNKNOWN or sure < m.least or _likeness(own, templates[family]) < CONFIRM:
                family = UNKNOWN
        old = out[-1] if out and out[-1].paragraph == x.paragraph[i] and first <= out[-1].last + 1 else None
        if old and (old.family == family or UNKNOWN in (old.family, family)):  # a part of a notice may be unknown
            old.first, old.last = min(old.first, first), max(old.last, last)
            old.probability = max(old.probability, sure) if old.family == family else sure if old.family == UNKNOWN else old.probability
            old.family = family if old.family == UNKNOWN else old.family
        else:
            out.append(Hit(int(x.text[i]), int(x.paragraph[i]), first, last, family, sure))
    for h in out:
        own = _bigrams(_between(x.words, h.first, h.last))
        h.similarity = 1.0 if not own else max(_likeness(own, t) for f, t in templates.items() if h.family in (f, UNKNOWN))
    return out


def _likeness(own: set, templates: list[set]) -> float:
    """The greatest share of 2-grams in common with a template, of the smaller of both."""
    return max(len(own & t) / max(1, min(len(own), len(t))) for t in templates)


def _between(w: Words, first: int, last: int) -> str:
    return w.data[w.starts[first]:w.ends[last]].tobytes().decode()


def _blank_word(w: Words, first: int, last: int) -> str:
    """The words from ``first`` to ``last`` with the signs among them, if no blank is; else empty."""
    name = _between(w, first, last)
    return "" if any(c.isspace() for c in name) else name + "+" * w.data[w.ends[last]:w.ends[last] + 1].tobytes().count(b"+")


def scan(docs: DataFrame, model: LicenseModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Licence paragraphs: ``keep``, paragraph (number of the line that the hit starts in), word (its place in the text), family, probability, similarity, passage."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("paragraph", T.LongType()), T.StructField("word", T.LongType()), T.StructField("family", T.StringType()),
                           T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("passage", T.StringType())])
    templates = {f: [_bigrams(t) for t in ts] for f, ts in TEMPLATES.items()}
    body = fresh("body", list(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, body, 1 << 19):
            x = _stretches(b.column(len(keep)))
            if not len(x.starts):
                continue
            firsts = x.words.firsts()
            rows = [(h.text, int(x.lines[h.first]), h.first - firsts[h.text], h.family, h.probability, h.similarity, _between(x.words, h.first, h.last)) for h in _judged(m, x, templates)]
            if rows:
                src, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(src)) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True))], schema.names)

    return docs.select(*keep, F.col(text).alias(body)).mapInArrow(run, schema)
