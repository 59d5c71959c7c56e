"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and, as notices are wrapped, windows of words that run over line ends. A template
has windows of its own size: of 2 * L words, one every L words, where L is its length rounded up to a power of
two. Its length of consecutive words lies in one of them, whatever the line ends in it, and a short notice is
not gathered from words all over a long text.

Tokens are ordered by their frequency over all lines of the corpus, rarest first. A block can hold
``THRESHOLD`` of a template's tokens only if it holds one of the template's first
|T| - ceil(THRESHOLD * |T|) + 1 tokens (prefix filter), has at least ceil(THRESHOLD * |T|) tokens (length
filter), and has enough tokens left after the first common one (positional filter); survivors are verified.
The filters only skip work: the result is that of comparing all blocks with all templates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

THRESHOLD = Fraction(4, 5)

#: label -> phrase whose words must stand consecutively.
BASE_PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# The words of well-known notices and license texts, in lower case without punctuation.
#: (label, notice); a notice counts as the set of its words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc0", "to the extent possible under law all copyright has been waived cc0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("no-copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided "
        "by the copyright holders and contributors as is and any express or implied warranties including but not limited to the "
        "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright "
        "holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but "
        "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however "
        "caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising "
        "in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of "
        "the gnu general public license along with this program if not see https www gnu org licenses",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
        "and by any means",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software altered source versions must be "
        "plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered "
        "from any source distribution",
    ),
)

#: Lower-cases A-Z; keeps digits, letters, bytes of non-ASCII characters and line feeds; all else is a space.
_WORDS = bytes(
    c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in (b + 32 if 65 <= b <= 90 else b for b in range(256))
)


def normalized(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)


def size_class(notice: str) -> int:
    """The notice's number of words, rounded up to a power of two."""
    return 1 << max(0, len(normalized(notice).split()) - 1).bit_length()


def windows(words: list[bytes], ends: list[int], size: int) -> Iterator[list[bytes]]:
    """Windows i * size to (i + 2) * size that hold words of both sides of one of ``ends``, the line ends."""
    last = -1
    for end in ends:
        for i in (end // size - 1, end // size):
            if i > last and i * size < end:
                last = i
                yield words[i * size : (i + 2) * size]


class Join:
    """Templates against blocks, given how many lines hold each template token."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: Fraction = THRESHOLD) -> None:
        sets = [(label, size_class(notice), set(normalized(notice).split())) for label, notice in templates]
        tokens = sorted(set().union(*(t for _, _, t in sets)), key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.vocabulary = frozenset(tokens)
        self.templates = []
        self.by_prefix: dict[int, list[tuple[int, int]]] = {}
        for label, size, own in sets:
            ranks = sorted(self.rank[t] for t in own)
            need = math.ceil(threshold * len(ranks))
            n = len(self.templates)
            self.templates.append((label, frozenset(ranks), need, size))
            for at, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.by_prefix.setdefault(rank, []).append((n, at))
        self.prefixes = frozenset(t for t, r in self.rank.items() if r in self.by_prefix)

    def matches(self, block: set[bytes], size: int | None = None) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template (of a size class) that the block meets."""
        if self.prefixes.isdisjoint(block):
            return
        ranks = sorted(self.rank[t] for t in block & self.vocabulary)
        seen: set[int] = set()
        for j, rank in enumerate(ranks):
            for n, i in self.by_prefix.get(rank, ()):
                label, template, need, own_size = self.templates[n]
                if n in seen or (size is not None and size != own_size):
                    continue
                if len(ranks) < need or min(len(template) - i, len(ranks) - j) < need:
                    continue
                seen.add(n)
                both = len(template.intersection(ranks))
                if both >= need:
                    yield label, both / len(template)

    def found(self, lines: list[list[bytes]], words: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) over all blocks of a text. A block is a part of the text, so a template that the
        whole text does not meet is met by no block, and sizes without one that it meets are left out."""
        whole = {label for label, _ in self.matches(set(words))}
        if not whole:
            return
        for line in lines:
            yield from self.matches(set(line))
        ends, n = [], 0  # as numbers of the words that follow
        for line in lines:
            if line:
                ends.append(n := n + len(line))
        for size in sorted({size for label, _, _, size in self.templates if label in whole}):
            for block in windows(words, ends[:-1], size):
                yield from self.matches(set(block), size)


def base_places(words: list[bytes]) -> dict[str, list[int]]:
    """label -> word numbers, from 0, at which its phrase starts."""
    line = b" " + b" ".join(words) + b" "
    found: dict[str, list[int]] = {}
    for label, phrase in BASE_PHRASES.items():
        wanted, at, counted, number = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(wanted, at + 1)) >= 0:
            number, counted = number + line.count(b" ", counted, at), at
            found.setdefault(label, []).append(number)
    return found


def scan_text(text: str | None, join: Join) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a whole text."""
    lines = [line.split() for line in normalized(text).split(b"\n")]
    words, labels, score = [w for line in lines for w in line], set(), 0.0
    for label, share in join.found(lines, words):
        labels.add(label)
        score = max(score, share)
    base = base_places(words)
    starts = [s for places in base.values() for s in places]
    if starts:
        score = 1.0
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels | set(base))),
        score,
    )


def token_frequency(docs: DataFrame, text_col: str, templates: tuple[tuple[str, str], ...]) -> dict[bytes, int]:
    """Lines that hold a template token, over all documents. One row a template token reaches the driver."""
    vocabulary = frozenset(t for _, notice in templates for t in normalized(notice).split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for line in normalized(text.as_py()).split(b"\n"):
                    seen.update(vocabulary.intersection(line.split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "token binary, n long")
    return {bytes(r.token): r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("*",),
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` in a struct column ``record`` (so no name can clash), with n_words,
    n_base, first_word, last_word, base_labels, labels and score. Null and empty texts have no words and no
    labels, score 0; an empty table gives an empty table. Every row is scanned by itself, so rows that repeat give
    equal rows; the work on a text grows with its length alone. score: the largest containment found, 1 for
    a base phrase, else 0; a template met several times counts once."""
    join = docs.sparkSession.sparkContext.broadcast(Join(templates, token_frequency(docs, text_col, templates)))
    packed = docs.select(F.struct(*keep).alias("record"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["record"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = join.value
        for batch in batches:
            rows = [scan_text(t.as_py(), own) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["record", *names])

    return packed.mapInArrow(
        find,
        f"record {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select(
        F.col("record.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def _sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {listed(sorted(set(notice.split())))})" for label, notice in TEMPLATES)
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for label, p in BASE_PHRASES.items())
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH tpl(label, toks) AS (VALUES {templates}), ph(label, toks) AS (VALUES {phrases}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {word}) AS ws FROM d),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) AS toks FROM d),
m AS (SELECT doc_id, label, max(len(list_intersect(b.toks, tpl.toks))::DOUBLE / len(tpl.toks)) AS share
  FROM b, tpl WHERE len(list_intersect(b.toks, tpl.toks)) * {THRESHOLD.denominator} >= {THRESHOLD.numerator} * len(tpl.toks) GROUP BY ALL),
p AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(toks)] = toks)) AS place FROM w, ph),
pb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM p GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
  (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM p) GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN pb USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP4_SQL = _sql()
