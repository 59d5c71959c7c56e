"""Suffix-array deduplication: removes every byte covered by a ``SPAN``-byte string that starts twice.

Suffixes are sorted by the difference-cover method (sort sampled triples, recurse on their names, merge the
other suffixes), and adjacent suffixes are compared over their first SPAN bytes. So that no task sees more
than a bounded share of the corpus, an exact routing comes first. Of every SPAN-byte window the GRAM-byte
string of least hash is its anchor; equal windows have equal anchors at the same place. An anchor's context
(all windows that can own it) therefore needs to be sorted only with contexts of the same anchor:

- anchors seen once in the corpus cannot lie in a repeat and go;
- contexts that are equal as a whole (by 192 bits) are a class, of which the first and the last are sorted; classes
  that follow each other in the same two rows are sorted as one stretch. What the sort finds of a class holds for all
  its members;
- classes that differ but share the anchor are sorted together.

Anchors with very many different contexts are split by the bytes around them: of a window's REACH bytes beside its
anchor, l stand on the left and the rest on the right, so contexts that share a window agree for some l of a grid in l
bytes on the left and all but a grid step of the rest on the right. Grids get finer until groups are small; at the
finest the groups are those of equal windows. So no group is paired with itself, however hot.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, row_name

SPAN = 200
GRAM = 100
REACH = SPAN - GRAM
#: Bytes of a long text worked on at a time.
PIECE = 1 << 19
#: Bytes of a key's contexts that are sorted together at most, and of small groups that are held for one sort.
CHUNK = 1 << 20
HELD = 1 << 18
#: Bytes of a stretch sorted at a time; pieces overlap, so that no window is cut.
STRETCH = 1 << 16
#: Bytes handed over at a time, about.
BATCH = 1 << 23
#: Rows with texts, contexts or spans that Spark hands over at a time, at most.
ROWS = 1000
#: Bytes of a key's contexts beyond which they are split by the bytes around, and the grids of the splits.
MOST = CHUNK
GRIDS = (50, 10)

_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEPS = {k: np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in (1, 2, 4, 8, 16, 32, 64, 128)}


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:-rest], x[rest:]) if rest else x


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM consecutive bytes, by doubling."""
    part, size, out, done = _TABLE[b], 1, None, 0
    while True:
        if GRAM & size:
            n = len(b) - GRAM + 1
            out = part[:n] if out is None else out * _STEPS[size] + part[done : done + n]
            done += size
        if 2 * size > GRAM:
            break
        part = part[:-size] * _STEPS[size] + part[size:]
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all SPAN-byte windows of a text."""
    places, hashes = [], []
    for at in range(0, len(text) - SPAN + 1, PIECE):
        h = _gram_hashes(text[at : at + PIECE + SPAN - 1])
        least = _slide(h, REACH + 1, np.minimum)
        edge = np.zeros(REACH, np.uint64)
        own = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == h)
        places.append(own + at)
        hashes.append(h[own])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s`` (integers from 1), by the difference cover {1, 2} modulo 3. Places and ranks take 4 bytes
    each, keys 8; a key goes as soon as it is sorted."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int32)
    t = np.concatenate([s.astype(np.int32), np.zeros(3, np.int32)])
    base = np.int64(int(t.max()) + 1)
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    triples = (t[sampled] * base + t[sampled + 1]) * base + t[sampled + 2]
    order = np.argsort(triples).astype(np.int32)
    triples = triples[order]
    name = np.empty(len(sampled), np.int32)
    name[order] = np.concatenate([[1], 1 + np.cumsum(triples[1:] != triples[:-1], dtype=np.int32)])
    del triples
    if name.max() < len(sampled):
        order = suffix_array(name)
    del name
    sample_order = sampled[order]
    del order, sampled
    rank = np.zeros(n + 3, np.int32)
    rank[sample_order] = np.arange(1, len(sample_order) + 1, dtype=np.int32)
    sample_order = sample_order[sample_order < n]

    zeros = np.arange(0, n, 3, dtype=np.int32)
    width = np.int64(n + 4)
    zeros = zeros[np.argsort(t[zeros] * width + rank[zeros + 1])]
    one, two = sample_order[sample_order % 3 == 1], sample_order[sample_order % 3 == 2]
    before = np.searchsorted(t[one] * width + rank[one + 1], t[zeros] * width + rank[zeros + 1])
    pair = lambda i: (t[i] * base + t[i + 1]) * width + rank[i + 2]
    before = before + np.searchsorted(pair(two), pair(zeros))
    out = np.empty(n, np.int32)
    at = np.arange(len(zeros)) + before
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zeros, sample_order
    return out


def repeats(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, the places at which a SPAN-byte string starts that starts elsewhere too."""
    lengths = np.array([len(x) for x in segments])
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    s = joined.astype(np.int32) + 2
    s[starts + lengths] = 1
    order = suffix_array(s)
    ends = np.repeat((starts + lengths).astype(np.int32), lengths + 1)
    whole = np.arange(len(s), dtype=np.int32) + SPAN <= ends  # suffixes whose SPAN bytes lie in their segment
    order = order[whole[order]]
    del ends, whole
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(joined), 8), (1, 1))
    word = np.ascontiguousarray(words).view(np.uint64)[:, 0]
    alike = np.arange(len(order) - 1) if len(order) > 1 else np.empty(0, np.int64)
    for off in range(0, SPAN, 8):
        alike = alike[word[order[alike] + off] == word[order[alike + 1] + off]]
    hit = np.zeros(len(s), bool)
    hit[order[alike]] = True
    hit[order[alike + 1]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(starts, lengths, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs covered by the spans; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _given_back(work):
    """``work`` on batches, after which its process gives free memory back: workers stay for later stages, and an executor counts
    with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # (other C libraries have no such call)
                ctypes.CDLL(None).malloc_trim(0)

    return run


ROW = "r1 long, r2 long"


def _bytes(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        places, hashes, contexts, lengths, counts = [], [], [], [], []
        for value in batch.column(2):
            text = _bytes(value)
            place, own = anchors(text)
            counts.append(len(place))
            if not len(place):
                continue
            start, end = np.maximum(place - REACH, 0), np.minimum(place + SPAN, len(text))
            raw = memoryview(text)
            contexts += [
                xxhash.xxh3_128_digest(raw[a:b], left) for a, b, left in zip(start.tolist(), end.tolist(), (place - start).tolist(), strict=True)
            ]
            places.append(place)
            hashes.append(own)
            lengths.append(end - start)
        none = np.empty(0, np.int64)
        place = np.concatenate(places) if places else none
        digest = np.frombuffer(b"".join(contexts), "<i8").reshape(-1, 2)
        start = np.maximum(place - REACH, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((np.concatenate(hashes) if hashes else none.astype(np.uint64)).view(np.int64)),
                pa.array(digest[:, 0].copy()),
                pa.array(digest[:, 1].copy()),
                pa.array(np.repeat(r1, counts)),
                pa.array(np.repeat(r2, counts)),
                pa.array(start.astype(np.int32)),
                pa.array((place - start).astype(np.int32)),
                pa.array((np.concatenate(lengths) if lengths else none).astype(np.int32)),
            ],
            ["a", "c1", "c2", "r1", "r2", "start", "left_", "length"],
        )


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _stretches(row: tuple[int, int], pairs: list[dict]) -> Iterator[tuple[bytes, int, int, bool]]:
    """(name, start, end, lead) of the stretches of a row that lie in another row (or elsewhere in this one) at a
    fixed distance: classes whose first and last members these are, one behind the other. Both rows tell the
    same names."""
    by: dict[tuple, list[tuple[int, int]]] = {}
    for p in pairs:
        by.setdefault((p["o1"], p["o2"], p["ostart"] - p["start"], p["lead"]), []).append((p["start"], p["start"] + p["length"]))
    for (o1, o2, shift, lead), own in by.items():
        for start, end in merged(own):
            first = (*row, o1, o2, shift, start) if lead else (o1, o2, *row, -shift, start + shift)
            yield struct.pack("<6q", *first), start, end, lead


COLUMNS = {"key": pa.int64(), "r1": pa.int64(), "r2": pa.int64(), "start": pa.int32(), "left_": pa.int32(), "context": pa.binary(), "alone": pa.bool_(), "pair": pa.bool_()}
CONTEXTS = "key long, r1 long, r2 long, start int, left_ int, context binary, alone boolean, pair boolean"


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(COLUMNS.values())], list(COLUMNS))


def _pieces(start: int, end: int, stretch: int) -> Iterator[tuple[int, int]]:
    """Parts of a segment that hold all its windows."""
    for at in range(start, max(start + 1, end - SPAN + 1), stretch):
        yield at, min(end, at + stretch + SPAN - 1)


def _emit_contexts(stretch: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (r1, r2, text, pairs, marks) -> stretches and contexts, to be sorted with those of the same key. A row's
        contexts of one anchor that overlap are one segment (the anchor comes again and again in periodic text)."""
        for batch in batches:
            out, size = [], 0
            for r1, r2, value, pairs, marks in zip(*(batch.column(k) for k in range(5)), strict=True):
                text, row, n = _bytes(value).tobytes(), (r1.as_py(), r2.as_py()), len(out)
                for name, start, end, lead in _stretches(row, pairs.as_py() or []):
                    for a, b in _pieces(start, end, stretch):
                        out.append((_signed(xxhash.xxh64_intdigest(name, a - start)), *row, a, 0, text[a:b], lead, True))
                by: dict[int, list[dict]] = {}
                for m in marks.as_py() or ():
                    by.setdefault(m["a"], []).append(m)
                for key, own in by.items():
                    at = own[0]["start"] + own[0]["left_"]
                    gram, alone = text[at : at + GRAM], any(m["alone"] for m in own)
                    for start, end in merged([(m["start"], m["start"] + m["length"]) for m in own]):
                        for a, b in _pieces(start, end, stretch):
                            if (left := text.find(gram, a, b)) >= 0:
                                out.append((key, *row, a, left - a, text[a:b], alone, False))
                size += sum(len(o[5]) for o in out[n:])
                if size > BATCH:
                    yield _pack(out)
                    out, size = [], 0
            yield _pack(out)

    return emit


def _finer(grid: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments, each place of their anchor under a key for every l of the grid (see above)."""
        for batch in batches:
            out, size = [], 0
            for _, r1, r2, start, left, segment, alone, pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram, at, by = segment[left : left + GRAM], left, {}
                while at >= 0:
                    for l in range(0, REACH, grid):  # noqa: E741
                        end = at + GRAM + REACH - l - grid
                        if l <= at and end <= len(segment):
                            key = _signed(xxhash.xxh64_intdigest(segment[at - l : end], l))
                            by.setdefault(key, []).append((max(0, at - REACH), min(len(segment), at + SPAN)))
                    at = segment.find(gram, at + 1)
                for key, own in by.items():
                    for a, b in merged(own):
                        out.append((key, r1, r2, start + a, segment.find(gram, a) - a, segment[a:b], alone, pair))
                        size += b - a
                if size > BATCH:
                    yield _pack(out)
                    out, size = [], 0
            yield _pack(out)

    return split


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (r1, r2, start, segment, alone) -> their different windows, with all places: (window, r1, r2, starts, alone)."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_())
    for batch in batches:
        out = []
        for k, (r1, r2, start, segment, alone) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
            places: dict[bytes, list[int]] = {}
            for i in range(len(segment) - SPAN + 1):
                places.setdefault(segment[i : i + SPAN], []).append(start + i)
            out += [(window, r1, r2, starts, alone) for window, starts in places.items()]
            if len(out) * SPAN > BATCH or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["window", "r1", "r2", "starts", "alone"])
                out = []


def _sorted_repeats(items: list[tuple]) -> list[tuple]:
    """(r1, r2, start, end) of repeated strings among contexts (r1, r2, start, context, alone). Contexts of
    one row that overlap become one segment, so no place of a text can repeat itself."""
    segments: list[list] = []
    for r1, r2, start, context, alone in sorted(items, key=lambda i: i[:3]):
        last = segments[-1] if segments else None
        if last and last[0] == (r1, r2) and start <= last[1] + len(last[2]):
            last[2] += context[max(0, last[1] + len(last[2]) - start) :]
            last[3] |= alone
        else:
            segments.append([(r1, r2), start, bytearray(context), alone])
    if len(segments) < 2 and not any(len(s[2]) > SPAN for s in segments):
        return []
    out = []
    for (row, start, _, alone), at in zip(segments, repeats([bytes(s[2]) for s in segments]), strict=True):
        if alone and len(at):
            cuts = np.flatnonzero(np.diff(at) > SPAN) + 1
            out += [(*row, start + int(p[0]), start + int(p[-1]) + SPAN) for p in np.split(at, cuts)]
    return out


SPANS = f"{ROW}, start int, end int"


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTEXTS in the order of their keys -> repeated strings. Small groups are sorted together: what repeats
    over groups repeats as well."""

    def pack(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["r1", "r2", "start", "end"])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "r1", "r2", "start", "context", "alone")), strict=True)

    held: list[tuple] = []
    size = 0
    for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
        own = [r[1:] for r in group]
        if len(own) < 2 and len(own[0][3]) <= SPAN:
            continue
        held += own
        size += sum(len(r[3]) for r in own)
        if size > HELD:
            yield pack(_sorted_repeats(held))
            held, size = [], 0
    if held:
        yield pack(_sorted_repeats(held))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r1, r2, spans) -> the same with maximal runs."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        runs = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in own])] for own in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(runs, kind)], ["r1", "r2", "spans"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r1, r2, text, spans) -> what is left of the text."""
    for batch in batches:
        out = []
        for value, spans in zip(batch.column(2), batch.column(3), strict=True):
            text = _bytes(value).tobytes()
            runs = merged([(s["start"], min(s["end"], len(text))) for s in spans.as_py()])
            edges = [0, *itertools.chain.from_iterable(runs), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["r1", "r2", "n_removed", "n_spans", "kept_sha256", "kept"])


def _found(routed: DataFrame, scratch: Scratch) -> DataFrame:
    """SPANS of the repeated strings among CONTEXTS, hot keys split until every group is small."""
    now, small, spans = routed, [], None
    for split in (*map(_finer, GRIDS), None):
        hot = scratch.save(now.where("NOT pair").groupBy("key").agg(F.sum(F.length("context")).alias("n")).where(F.col("n") > MOST).select("key"))
        if hot.isEmpty():
            break
        small.append(now.join(hot, "key", "left_anti"))
        rest, now = now.join(hot, "key", "left_semi"), None
        if split is not None:
            now = scratch.save(rest.select(*COLUMNS).mapInArrow(_given_back(split), CONTEXTS))
            continue
        once = rest.select("r1", "r2", "start", "context", "alone").distinct()
        every = scratch.save(once.mapInArrow(_given_back(_windows), f"window binary, {ROW}, starts array<int>, alone boolean"))
        # windows by their bytes: (places that two segments of a row share count once)
        places = every.groupBy("window", "r1", "r2").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.bool_or("alone").alias("alone"))
        often = places.groupBy("window").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("window")
        spans = places.where("alone").join(often, "window", "left_semi").select("r1", "r2", F.explode("starts").alias("start"))
        spans = spans.select("r1", "r2", "start", (F.col("start") + SPAN).alias("end"))
    if now is not None:
        small.append(now)
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    ordered = every.repartition("key").sortWithinPartitions("key", "r1", "r2", "start")
    found = ordered.select("key", "r1", "r2", "start", "context", "alone").mapInArrow(_given_back(_sort_contexts), SPANS)
    return found if spans is None else found.unionByName(spans)


def removals(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(r1, r2, n_removed, n_spans, kept_sha256, kept) for the rows that hold a repeat, by ``row_name``; one row each."""
    row = ["r1", "r2"]
    rows = docs.select(*row_name(id_col, text_col), F.col(text_col).cast("binary").alias("text")).where(F.length("text") >= SPAN)
    again = scratch.save(rows.groupBy(*row).count().where("count > 1").select(*row))  # rows that repeat as a whole
    if not again.isEmpty():
        once = rows.join(again, row, "left_semi").dropDuplicates(row)
        rows = rows.join(again, row, "left_anti").unionByName(once)
    every = scratch.save(rows.mapInArrow(_given_back(_emit_anchors), f"a long, c1 long, c2 long, {ROW}, start int, left_ int, length int"), ROWS)
    # (stored, so that both sides of the join are plain exchanges, which adaptive execution can split at a hot anchor)
    often = scratch.save(every.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    shared = scratch.save(every.join(often, "a", "left_semi"))
    scratch.drop(every, often)

    member = F.struct("r1", "r2", "start", "left_", "length")
    classes = scratch.save(shared.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last")))
    kinds = scratch.save(classes.groupBy(F.col("a").alias("anchor")).agg(F.count("*").alias("kinds")).where("kinds > 1"))
    side = lambda own, other, lead: F.struct(
        f"{own}.r1",
        f"{own}.r2",
        F.struct(f"{own}.start", f"{own}.length", F.col(f"{other}.r1").alias("o1"), F.col(f"{other}.r2").alias("o2"), F.col(f"{other}.start").alias("ostart"), F.lit(lead).alias("lead")).alias("pair"),
    )
    pairs = classes.where("n > 1").select(F.explode(F.array(side("first", "last", True), side("last", "first", False))).alias("s")).select("s.*")
    marks = classes.join(kinds, F.col("a") == F.col("anchor")).select(
        "first.r1", "first.r2", F.struct("a", "first.start", "first.left_", "first.length", (F.col("n") == 1).alias("alone")).alias("mark")
    )
    told = pairs.unionByName(marks, allowMissingColumns=True)
    # a row has one pair or mark a place and side at most: lists are bounded by its own text
    per_row = scratch.save(told.groupBy(*row).agg(F.collect_list("pair").alias("pairs"), F.collect_list("mark").alias("marks")))
    scratch.drop(kinds)
    chosen = rows.join(per_row, row).select(*row, "text", "pairs", "marks")
    routed = scratch.save(chosen.mapInArrow(_given_back(_emit_contexts(STRETCH)), CONTEXTS), ROWS)
    scratch.drop(per_row)
    found = scratch.save(_found(routed, scratch), ROWS)
    scratch.drop(routed)

    # a class repeats where the sort found all of its first member
    runs = found.groupBy(*row).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    runs = scratch.save(runs.mapInArrow(_given_back(_merge_spans), f"{ROW}, spans array<struct<start:int,end:int>>"), ROWS)
    heads = classes.where("n > 1").select("a", "c1", "c2", "first.r1", "first.r2", "first.start", "first.length").join(runs, row)
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("start") + F.col("length")))
    sure = scratch.save(heads.where(inside).select("a", "c1", "c2"))
    scratch.drop(classes)
    equal = shared.join(sure, ["a", "c1", "c2"], "left_semi").select(*row, F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span"))
    whole = again.select(*row, F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("end")).alias("span"))
    every_span = equal.unionByName(runs.select(*row, F.explode("spans").alias("span"))).unionByName(whole)
    spans = scratch.save(every_span.groupBy(*row).agg(F.collect_list("span").alias("spans")).mapInArrow(_given_back(_merge_spans), f"{ROW}, spans array<struct<start:int,end:int>>"), ROWS)
    scratch.drop(shared, sure, runs, found)
    gone = scratch.save(rows.join(spans, row).select(*row, "text", "spans").mapInArrow(_given_back(_remove), f"{ROW}, n_removed long, n_spans long, kept_sha256 string, kept string"), ROWS)
    scratch.drop(spans, again)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` in a struct column ``record`` (so no name can clash), with n_bytes, n_removed, n_spans,
    kept_sha256 and ``kept``, the text left (null: all of it; characters cut at the edge of a removed run go
    from it, the digest covers all bytes left). Null texts count as empty, texts under
    SPAN bytes hold no repeat, rows equal in id and text repeat each other as a whole and are worked on once; a long
    text is worked on in pieces; an empty table gives an empty table."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    gone = removals(docs, scratch, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(
        F.struct("*").alias("record"),
        *row_name(id_col, text_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("sha"),
    )
    return mine.join(gone, ["r1", "r2"], "left").select(
        "record",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("record.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
