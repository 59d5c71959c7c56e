"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Unary potentials see the line's own shape and that of its neighbours; transition
potentials reward staying. The field is trained on a bounded, hash-chosen set of labelled documents whose
lines all carry the document's label; a document's score is the mean of its lines' forward-backward
marginals, weighted by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .langid import held_out

#: Labelled documents that the field is trained on at most (about); their line features reach the driver.
TRAIN_DOCS = 4_000
#: Lines of a training chain; longer documents give several chains, of which CHAINS at most are learned from, spread
#: evenly over the document. So 4,000 documents bring 2 million lines of 33 features at most.
CHAIN = 64
CHAINS = 8
STEPS = 120
RATE = 0.15
RIDGE = 1e-3
PASS = 0.7

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()")

OWN = 10
WIDTH = 1 + OWN + 2 * OWN + 2


def line_shapes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) features and the lines' lengths in bytes; blank lines are left out."""
    own: list[tuple[float, ...]] = []
    lengths: list[int] = []
    seen: set[bytes] = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, m = len(line), len(words)
        letters, upper = n - len(line.translate(None, _LETTERS)), n - len(line.translate(None, _UPPER))
        symbols = n - len(line.translate(None, _SYMBOLS))
        own.append(
            (
                min(math.log1p(n) / 8, 2.0),
                letters / n,
                (n - len(line.translate(None, _DIGITS))) / n,
                symbols / n,
                min(symbols / m, 2.0),
                upper / max(letters, 1),
                sum(map(eq, words, islice(words, 1, None))) / m,
                len(set(words)) / m,
                min(n / m / 10, 3.0),
                float(line in seen),
            )
        )
        seen.add(line)
        lengths.append(n)
    x = np.zeros((len(own), WIDTH))
    if own:
        o = np.array(own)
        x[:, 0] = 1
        x[:, 1 : 1 + OWN] = o
        x[1:, 1 + OWN : 1 + 2 * OWN] = o[:-1]
        x[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = o[1:]
        x[0, -2] = x[-1, -1] = 1
    return x, np.array(lengths, dtype=np.int64)


@dataclass
class Field:
    """``weights`` give the log-odds of a good line; ``stay`` the potentials of bad-bad and good-good."""

    weights: np.ndarray
    stay: tuple[float, float]

    def marginals(self, x: np.ndarray) -> list[float]:
        """P(good) of each line, by forward and backward log-odds."""
        u = (x @ self.weights).tolist()
        bad, good = math.exp(min(self.stay[0], 50.0)), math.exp(min(self.stay[1], 50.0))

        def sent(r: float) -> float:
            """Log-odds that a neighbour with log-odds r passes on."""
            if r > 0:
                e = math.exp(-r)
                return math.log((good + e) / (1 + bad * e))
            e = math.exp(r)
            return math.log((good * e + 1) / (e + bad))

        ahead, r = [], 0.0
        for k, v in enumerate(u):
            r = v + (sent(r) if k else 0.0)
            ahead.append(r)
        out, back = [0.0] * len(u), 0.0
        for k in range(len(u) - 1, -1, -1):
            z = max(-700.0, min(700.0, ahead[k] + back))
            out[k] = 1 / (1 + math.exp(-z))
            back = sent(back + u[k])
        return out

    def score(self, text: str | None) -> float:
        """0 for a text without a word."""
        x, lengths = line_shapes(text)
        if not len(x):
            return 0.0
        return min(1.0, max(0.0, float(np.dot(self.marginals(x), lengths) / lengths.sum())))


def fit(chains: list[tuple[np.ndarray, int]]) -> Field:
    """Maximum conditional likelihood by Adam; each chain counts alike, whatever its length. With one class
    only, or no chain, the field is constant."""
    good = sum(y for _, y in chains)
    if not chains or good in (0, len(chains)):
        p = (good + 1) / (len(chains) + 2)
        return Field(np.append(math.log(p / (1 - p)), np.zeros(WIDTH - 1)), (0.0, 0.0))
    bins: dict[int, list[tuple[np.ndarray, int]]] = {}
    for x, y in chains:
        bins.setdefault(max(1, math.ceil(math.log2(len(x)))) if len(x) > 1 else 0, []).append((x, y))
    packs = []
    for own in bins.values():
        t = max(len(x) for x, _ in own)
        X, on = np.zeros((len(own), t, WIDTH)), np.zeros((len(own), t))
        for k, (x, _) in enumerate(own):
            X[k, : len(x)], on[k, : len(x)] = x, 1
        packs.append((X, on, np.array([y for _, y in own], dtype=float)))

    theta = np.zeros(WIDTH + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = -RIDGE * len(chains) * theta
        for X, on, y in packs:
            grad += _gradient(theta, X, on, y)
        grad /= len(chains)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:WIDTH], (float(theta[WIDTH]), float(theta[WIDTH + 1])))


def _gradient(theta: np.ndarray, X: np.ndarray, on: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the log likelihood of all lines carrying y, each chain divided by its length."""
    n, t, _ = X.shape
    u = np.stack([np.zeros((n, t)), X @ theta[:WIDTH]], axis=2)
    A = np.diag(theta[WIDTH:])
    f = np.zeros((n, t, 2))
    f[:, 0] = u[:, 0]
    for k in range(1, t):
        step = np.logaddexp(f[:, k - 1, 0, None] + A[0], f[:, k - 1, 1, None] + A[1]) + u[:, k]
        f[:, k] = np.where(on[:, k, None] > 0, step, f[:, k - 1])
    b = np.zeros((n, t, 2))
    for k in range(t - 2, -1, -1):
        own = b[:, k + 1] + u[:, k + 1]
        step = np.logaddexp(own[:, 0, None] + A[:, 0], own[:, 1, None] + A[:, 1])
        b[:, k] = np.where(on[:, k + 1, None] > 0, step, 0)
    z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
    share = on / on.sum(axis=1, keepdims=True)
    p = np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None])
    grad = np.zeros_like(theta)
    grad[:WIDTH] = np.tensordot((y[:, None] - p) * share, X, 2)
    for s in (0, 1):
        joint = np.exp(f[:, :-1, s] + A[s, s] + u[:, 1:, s] + b[:, 1:, s] - z[:, None]) * on[:, 1:]
        real = (y == s)[:, None] * on[:, 1:]
        grad[WIDTH + s] = ((real - joint) * share[:, 1:]).sum()
    return grad


def _some_chains(x: np.ndarray) -> np.ndarray:
    """The lines of CHAINS chains, first and last among them; all lines if there are no more chains."""
    n = -(-len(x) // CHAIN)
    if n <= CHAINS:
        return x
    at = np.arange(CHAINS) * (n - 1) // (CHAINS - 1)
    return np.concatenate([x[CHAIN * k : CHAIN * (k + 1)] for k in at])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_some_chains(line_shapes(t.as_py())[0]).astype(np.float32).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "h"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Field:
    """From text and labels.quality of the documents that are not held out. Label rows are chosen by a hash
    of their doc_id once there are more than ``max_docs``, so the side that is broadcast stays that small;
    of several labels for a document the majority counts, ties as 1. Of a document's chains ``CHAINS`` are learned from.
    Null labels and ids teach nothing, nor do texts without a word."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    votes = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = votes.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    if n > max_docs:
        votes = votes.where(order < int(max_docs / n * (1 << 32)))
    chosen = votes.withColumn("h", order).withColumnRenamed("doc_id", "labelled")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "y", "h")
    found = rows.mapInArrow(_shapes, "x binary, y int, h long").orderBy("h", "x").toArrow()
    chains = []
    for x, y in zip(found.column("x"), found.column("y"), strict=True):
        own = np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH).astype(float)
        chains += [(own[at : at + CHAIN], y.as_py()) for at in range(0, len(own), CHAIN)]
    return fit(chains)


def assess(docs: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` in a struct column ``record`` (so no name can clash), with ``score``.
    Texts that are null, empty or without a word score 0. Every line of a text counts, whatever its length; rows
    that repeat give equal rows, and an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    packed = docs.select(F.struct(*keep).alias("record"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["record"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["record", "score"])

    return packed.mapInArrow(score, f"record {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = assess(docs, train(docs, read_table(spark, sf_dir, "labels")), keep=("doc_id",))
    key = F.col("record.doc_id")
    return found.select(
        key.alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted")
    )
