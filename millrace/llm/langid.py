"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are learned from a bounded, hash-chosen set of labelled rows (all of them up to the bound); the
log-probability matrix (buckets x languages, 8 bytes a cell) is broadcast, and the texts of a batch are scored
together by summing the matrix rows of their n-grams, read sparsely in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows that the counts are learned from at most (about); more only sharpen what is sharp already.
TRAIN_ROWS = 40_000
#: Languages of one broadcast matrix, 256 KB each; more languages are scored in several passes, one matrix each.
LANGUAGES_AT_ONCE = 512
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters scored at a time, which bounds the memory for a very long text.
CHUNK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _buckets(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and the 3-character runs of character codes; place i is that of the run that starts there."""
    pairs = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA77))
    threes = (pairs[:-1] * np.uint32(0xC2B2AE3D)) ^ (c[2:] * np.uint32(0x27D4EB2F))
    mixed = [(k ^ (k >> np.uint32(15))) * np.uint32(own) for k, own in ((pairs, 0x165667B1), (threes, 0x9E3779B1))]
    return tuple(m >> np.uint32(32 - BUCKET_BITS) for m in mixed)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all 2- and 3-character runs of the lower-cased text, with repeats, in chunks."""
    low = " " + text.lower() + " "
    for at in range(0, len(low), CHUNK):
        for keys in _buckets(_codes(low[at : at + CHUNK + 2])):
            yield keys[:CHUNK]


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (BUCKETS, languages): log probability of a bucket
    prior: np.ndarray

    def totals(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): log of prior and likelihood. Texts are taken together up to CHUNK characters; a
        longer one by itself, in chunks. A text's sum does not depend on the others."""
        out = np.tile(self.prior, (len(texts), 1))
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) + 2 > CHUNK:
                for keys in filter(len, grams(text)):
                    out[i] += self._sums(keys, np.zeros(1, np.int64))[0]
                continue
            if size + len(text) + 2 > CHUNK:
                self._together(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(text) + 2
        self._together(texts, held, out)
        return out

    def _sums(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of the keys' matrix rows over the segments that begin at ``first``, some columns at a time."""
        step = max(1, (1 << 22) // max(1, len(keys)))
        parts = [np.add.reduceat(self.matrix[keys, at : at + step], first, axis=0) for at in range(0, len(self.languages), step)]
        return np.concatenate(parts, axis=1)

    def _together(self, texts: list[str], held: list[int], out: np.ndarray) -> None:
        if not held:
            return
        lows = [" " + texts[i].lower() + " " for i in held]
        lengths = np.array([len(x) for x in lows])
        owner = np.repeat(np.arange(len(lows)), lengths)
        for width, keys in enumerate(_buckets(_codes("".join(lows))), 2):
            inside = owner[: len(keys)] == owner[width - 1 :]  # runs do not cross into the next text
            mine = owner[: len(keys)][inside]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.empty(0, np.int64)
            if len(first):
                out[np.array(held)[mine[first]]] += self._sums(keys[inside], first)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text the likeliest language, its log weight and that of all languages; (und, 0, 0) if the text has no
        letter or nothing was learned."""
        found = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        good = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        totals = self.totals([texts[i] for i in good])
        for i, total in zip(good, totals, strict=True):
            best = int(total.argmax())
            rest = float(np.log(np.exp(np.clip(total - total[best], -700, 0)).sum()))
            found[i] = self.languages[best], float(total[best]), float(total[best]) + rest
        return found

    def parts(self) -> list[Model]:
        """Models of LANGUAGES_AT_ONCE languages or fewer; at least one."""
        at = range(0, max(1, len(self.languages)), LANGUAGES_AT_ONCE)
        return [Model(self.languages[i : i + LANGUAGES_AT_ONCE], self.matrix[:, i : i + LANGUAGES_AT_ONCE], self.prior[i : i + LANGUAGES_AT_ONCE]) for i in at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            for keys in grams(text):
                own += np.bincount(keys, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(at) + 1), pa.string()),
                pa.array(np.append(at, -1).astype(np.int32)),
                pa.array(np.append(own[at], docs[lang])),
            ],
            ["lang", "bucket", "n"],
        )


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """``labelled`` (id, lang, text). Rows are chosen by a hash of the id once there are more than
    ``max_rows``; what reaches the driver is at most BUCKETS + 1 numbers a language, of the languages of these rows."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    n = usable.select("lang").count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 32))
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < share)
    sums = (
        usable.select("lang", "text")
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    table = sums.toArrow()
    lang, bucket, n_seen = (table.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    languages = sorted(set(lang.tolist()))
    number = {x: i for i, x in enumerate(languages)}
    which = np.array([number[x] for x in lang], dtype=np.int64)
    counts = np.zeros((BUCKETS, len(languages)))
    docs = np.zeros(len(languages))
    seen = bucket >= 0
    counts[bucket[seen], which[seen]] = n_seen[seen]
    docs[which[~seen]] = n_seen[~seen]
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return Model(languages, matrix, np.log(docs / docs.sum()) if languages else np.zeros(0))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """Columns ``keep`` of ``df`` in a struct column ``record`` (so no name can clash), with ``lang_pred``
    and ``score``, its posterior probability, for the whole text. Null and empty texts and texts without a letter
    are ``und`` with score 0, as is every text if nothing was learned. Of languages that weigh the same the first by
    name is told. Rows that repeat give equal rows; an empty table gives an empty table. A very long text is
    scored in chunks, whatever its length."""
    packed = df.select(F.struct(*keep).alias("record"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["record"].dataType.simpleString()
    parts = model.parts()
    scratch = Scratch(df.sparkSession, "langid") if len(parts) > 1 else None
    told = packed.withColumns({"lang_pred": F.lit(None).cast("string"), "best": F.lit(0.0), "log_all": F.lit(0.0)})
    for n, part in enumerate(parts):
        told = told.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(part)), f"record {kind}, text string, lang_pred string, best double, log_all double")
        if n + 1 < len(parts):  # one matrix at a time in the executors' memory
            told = scratch.save(told)
    score = F.when(F.col("lang_pred") == UNDETERMINED, 0.0).otherwise(F.exp(F.col("best") - F.col("log_all")))
    return told.select("record", "lang_pred", F.least(score, F.lit(1.0)).alias("score"))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (record, text, lang_pred, best, log_all), the last three over earlier parts (lang_pred null: none)."""
        for batch in batches:
            found = []
            for new, *old in zip(shared.value.predict(batch.column(1).to_pylist()), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if old[0] is None or old[0] == UNDETERMINED or new[0] == UNDETERMINED:
                    found.append(new if old[0] is None or old[0] == UNDETERMINED else tuple(old))
                else:
                    best = new if new[1] > old[1] else old
                    found.append((best[0], best[1], float(np.logaddexp(old[2], new[2]))))
            kinds = (pa.string(), pa.float64(), pa.float64())
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["record", "text", "lang_pred", "best", "log_all"])

    return score


def train_on_documents(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and lang of the documents that are not held out; rows without either teach nothing, repeated
    rows count as often as they are there, and of an empty table nothing is learned."""
    known = docs.where(~held_out(F.col("doc_id")))
    return train(known.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text"), max_rows)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train_on_documents(docs), keep=("doc_id",))
    key = F.col("record.doc_id")
    return found.select(key.alias("doc_id"), held_out(key).alias("held_out"), "lang_pred", "score")
