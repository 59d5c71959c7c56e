"""SentencePiece encoding and decoding with Gumbel top-k sampling of segmentations without replacement.

A text's segmentations are the paths of its piece lattice. Pieces never cross from a word into the next
run of spaces, so the lattice is a chain of small lattices, one per chunk (spaces and the word after them),
and each distinct chunk's lattice is built once. Backward sums turn piece weights into the probability of
each edge given its node; a path is then a sequence of decisions.

The search is A-star on Gumbel-perturbed log-probabilities. Every open set of paths (those that leave a
known path at a given decision) carries the exact maximum of its perturbed values, drawn as a Gumbel
truncated at its parent's; the bound is the value itself, so the sets are popped in the order of the
perturbed paths, each pop completes one path by forward sampling, and the first k are a sample without
replacement. The best value left open is the threshold from which inclusion scores follow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: The vocabulary file that the query reads unless the session's SETTING names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SETTING = "spark.millrace.pieceModel"
SAMPLES = 2
SEED = 23
#: Chunks sampled at a time, which bounds the memory; a longer text is a slice of its own.
SLICE = 300_000
SPACE = "▁"
#: Stands for a literal U+2581 in a text; no valid text holds a lone surrogate.
LITERAL = "\udc81"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KNOWN_BITS = 20
#: Levels (characters to a chunk's end) summed for all chunks together; beyond them chunks are few.
LEVELS = 256
#: So many chunks or fewer are walked one by one, WALK draws at a time.
FEW = 8
WALK = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A vocabulary as arrays; ``weight`` is a piece's log weight, ``surface`` its bytes in the text."""

    hashes: np.ndarray  # sorted hashes of the pieces that may be used
    ids: np.ndarray
    weight: np.ndarray
    lengths: list[int]
    byte_first: int
    surface: list[bytes]
    known: np.ndarray  # by the leading KNOWN_BITS of a hash: whether a piece may have it
    first: np.ndarray  # by the same bits: the first place in ``hashes``, and the end

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes ``h`` (all of known leading bits) are pieces, and their places in ``hashes``."""
        lead = h >> np.uint64(64 - KNOWN_BITS)
        at, end = self.first[lead], self.first[lead + np.uint64(1)]
        open_ = np.flatnonzero(self.hashes[at] != h)
        found = np.ones(len(h), bool)
        while len(open_):  # a few pieces share their leading bits
            at[open_] += 1
            over = at[open_] >= end[open_]
            found[open_[over]] = False
            open_ = open_[~over]
            open_ = open_[self.hashes[at[open_]] != h[open_]]
        hit = np.flatnonzero(found)
        return hit, at[hit]

    @staticmethod
    def load(path: str) -> Pieces:
        """BPE models give merge ranks and no probabilities; a piece of rank r weighs 1 / (1 + r), a byte
        as much as the last rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in text[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces that hold a space after other characters need whole-text lattices")
        weight = np.full(n, -np.log(n + 1.0))
        weight[plain] = [-np.log(1.0 + max(0.0, -model.get_score(i))) for i in plain]
        surface = [b""] * n
        for i in plain:
            surface[i] = text[i].replace(SPACE, " ").encode()
        bytes_ = [i for i in range(n) if model.is_byte(i)]
        for i in bytes_:
            surface[i] = bytes([int(text[i][3:5], 16)])
        hashes = np.array([_hash_of(text[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        known = np.zeros(1 << KNOWN_BITS, bool)
        known[hashes >> np.uint64(64 - KNOWN_BITS)] = True
        hashes = hashes[order]
        first = np.searchsorted(hashes, np.arange(1 << KNOWN_BITS, dtype=np.uint64) << np.uint64(64 - KNOWN_BITS))
        return Pieces(hashes, np.array(plain)[order], weight, sorted({len(text[i]) for i in plain}), bytes_[0], surface, known, np.append(first, len(hashes)))


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Terms of a polynomial hash: sums of code * BASE^place; hash(i, j) = (sum_j - sum_i) * BASE^-i."""
    terms = codes * _powers(len(codes))[0]
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            own = np.multiply.accumulate(p)
            if len(_POWERS) > k:
                _POWERS[k] = own
            else:
                _POWERS.append(own)
    return _POWERS[0][:n], _POWERS[1][:n]


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(0x51ED)) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(31))


def _hash_of(text: str) -> int:
    return int(_prefix(_codes(text))[-1])


class Lattices:
    """The lattices of some chunks: nodes are places in chunks, edges the pieces that start there.

    Nodes are numbered by what remains of their chunk, so backward sums run over contiguous edges; a node's
    edges are contiguous too, with their cumulative probabilities (the last is 1)."""

    def __init__(self, chunks: list[str], pieces: Pieces) -> None:
        lengths = np.fromiter(map(len, chunks), np.int32, len(chunks))
        joined = "".join(chunks)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(raw)
        stop = np.cumsum(lengths, dtype=np.int32)
        place = np.arange(n, dtype=np.int32)
        remains = np.repeat(stop, lengths) - place
        sums, inverse = _prefix(_codes(joined)), _powers(n + 1)[1]
        number = np.empty(n + 1, np.int32)
        most = int(remains.max(initial=0))
        number[np.argsort(remains.astype(np.uint16) if most < 1 << 16 else remains, kind="stable")] = place
        self.start = number[stop - lengths].astype(np.int64)
        found = []  # for each piece length, from the shortest: places, places of the pieces
        at = place
        for length in pieces.lengths:
            if length <= 6:  # most places can start so short a piece: no gathering
                m = n - length + 1
                h = (sums[length:] - sums[:m]) * inverse[:m] if m > 0 else sums[:0]
                maybe = np.flatnonzero(pieces.known[h >> np.uint64(64 - KNOWN_BITS)] & (remains[: max(m, 0)] >= length))
                h = h[maybe]
            else:
                at = at[remains[at] >= length]
                if not len(at):
                    break
                h = (sums[length:][at] - sums[at]) * inverse[at]
                keep = np.flatnonzero(pieces.known[h >> np.uint64(64 - KNOWN_BITS)])
                h, maybe = h[keep], at[keep]
            hit, k = pieces.places(h)
            found.append((length, maybe[hit], k))
        alone = np.ones(n, bool)  # characters that are no piece: their bytes, as one edge
        if found and found[0][0] == 1:
            alone[found[0][1]] = False
        spare = np.flatnonzero(alone)

        # edges by node, long pieces first: they are the likely ones, so draws end early
        count = np.zeros(n + 1, np.int32)
        for _, own, _ in found:
            count[number[own]] += 1
        count[number[spare]] += 1
        edge_start = np.zeros(n + 1, np.int64)
        np.cumsum(count[:n], out=edge_start[1:])
        total = int(edge_start[n])
        free = edge_start[:n].copy()
        node, ids, target = (np.empty(total, np.int32) for _ in range(3))
        weight, rank = np.empty(total), np.empty(total, np.int8)
        for length, own, k in reversed(found):
            v = number[own]
            to = free[v]
            free[v] += 1
            node[to], ids[to], weight[to], rank[to] = v, pieces.ids[k], pieces.weight[pieces.ids[k]], to - edge_start[v]
            target[to] = np.where(remains[own] == length, -1, number[np.minimum(own + length, n)])
        v = number[spare]
        to = free[v]
        point = raw[spare].astype(np.int64)
        point[point == ord(LITERAL)] = ord(SPACE)
        sizes = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        node[to], ids[to], weight[to], rank[to] = v, -1 - point, sizes * pieces.weight[pieces.byte_first], to - edge_start[v]
        target[to] = np.where(remains[spare] == 1, -1, number[np.minimum(spare + 1, n)])
        self.ids, self.target = ids, target
        self.n_ids = np.ones(total, np.int8)
        self.n_ids[to] = sizes

        level = np.cumsum(np.bincount(remains, minlength=most + 1))  # nodes before each level
        beta = np.zeros(n + 1)  # the last stands for a chunk's end
        for a, b in zip(level[: LEVELS + 1], level[1 : LEVELS + 1], strict=False):
            ea, eb = edge_start[a], edge_start[b]
            value = weight[ea:eb] + beta[self.target[ea:eb]]
            cut = edge_start[a:b] - ea
            top = np.maximum.reduceat(value, cut)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(cut, eb - ea)))), cut))
        if most > LEVELS:
            self._sum_singly(beta, weight, edge_start, int(level[LEVELS]))
        self.log_p = weight + beta[self.target] - beta[node]
        p = np.exp(self.log_p)
        cumulative = p.copy()  # added edge by edge, so that it doesn't depend on the other chunks
        for k in range(1, int(rank.max(initial=0)) + 1):
            at = np.flatnonzero(rank == k)
            cumulative[at] += cumulative[at - 1]
        cumulative = np.minimum(cumulative, 1.0)
        cumulative[edge_start[1:] - 1] = 1.0
        self.p = p
        self.single = np.zeros(total, bool)
        self.single[edge_start[:n][count[:n] == 1]] = True
        self.log_p[self.single] = 0.0
        self.cumulative = cumulative
        self.node = node
        self.edge_start = edge_start

    def _sum_singly(self, beta: np.ndarray, weight: np.ndarray, edge_start: np.ndarray, first: int) -> None:
        """The backward sums of the nodes from ``first`` on, which are few a level, one by one."""
        known = beta.tolist()
        cuts = edge_start[first:].tolist()
        base = cuts[0]
        own, target = weight[base:].tolist(), self.target[base:].tolist()
        for node, a, b in zip(range(first, len(beta) - 1), cuts, cuts[1:], strict=False):
            values = [own[e] + known[target[e]] for e in range(a - base, b - base)]
            top = max(values)
            known[node] = top if len(values) == 1 else top + math.log(math.fsum(math.exp(v - top) for v in values))
        beta[:] = known

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its cumulative probabilities."""
        e = self.edge_start[nodes]
        on = np.flatnonzero(u >= self.cumulative[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.cumulative[e[on]]]
        return e


def _uniform(key: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and counters alone."""
    x = key.astype(np.uint64)
    for c in counters:
        x = (x ^ np.asarray(c).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + _BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncated(location: np.ndarray, u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A Gumbel at ``location``, given that it is below ``top``."""
    return -np.logaddexp(-top, -(location + _gumbel(u)))


@dataclass
class _Path:
    """One path of each text of a slice: its edges in order, and the perturbed maximum of the open set at
    each decision (-inf: none that belongs to this path)."""

    edges: np.ndarray
    counts: np.ndarray  # decisions of each chunk
    open_: np.ndarray
    before: np.ndarray  # log-probability of the decisions before
    bounds: np.ndarray  # first decision of each text, and the end
    value: np.ndarray  # the path's own perturbed log-probability, by text
    has: np.ndarray  # texts that have such a path


class Sampler:
    """Samples for the texts of a slice. ``chunk`` numbers the lattice of each chunk; ``cuts`` are the first
    chunks of the texts, and the end."""

    def __init__(self, lattices: Lattices, chunk: np.ndarray, cuts: np.ndarray, keys: np.ndarray) -> None:
        self.lattices, self.cuts, self.keys = lattices, cuts, keys.astype(np.uint64)
        self.start = lattices.start[chunk]
        self.text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.local = np.arange(len(chunk)) - cuts[self.text]

    def _forward(self, state: np.ndarray, round_: int, step: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Completes chunks from their states (-1: nothing to do): (chunk, step, edge) lists."""
        active = np.flatnonzero(state >= 0)
        state, step, out = state[active], step[active], []
        while len(active) > FEW:
            u = _uniform(self.keys[self.text[active]], np.uint64(2 * round_), self.local[active], step)
            edge = self.lattices.draw(state, u)
            out.append((active, step, edge))
            state = self.lattices.target[edge]
            on = state >= 0
            active, state, step = active[on], state[on], step[on] + 1
        for own, node, at in zip(active.tolist(), state.tolist(), step.tolist(), strict=True):
            edge = self._walk(own, node, at, round_)
            out.append((np.full(len(edge), own), at + np.arange(len(edge)), edge))
        return out

    def _walk(self, chunk: int, node: int, step: int, round_: int) -> np.ndarray:
        """The edges that complete one chunk: the same draws as of many together."""
        first, cumulative, target = self.lattices.edge_start, self.lattices.cumulative, self.lattices.target
        key, local, edges = self.keys[[self.text[chunk]]], self.local[[chunk]], []
        while node >= 0:
            for u in _uniform(key, np.uint64(2 * round_), local, step + np.arange(WALK)).tolist():
                e = int(first[node])
                while u >= cumulative[e]:
                    e += 1
                edges.append(e)
                node = int(target[e])
                if node < 0:
                    break
            step += WALK
        return np.array(edges, np.int64)

    def _path(self, parts: list, value: np.ndarray, has: np.ndarray, round_: int, branch: np.ndarray | None) -> _Path:
        """Puts (chunk, step, edge) parts in order; decisions up to ``branch`` of a text open no set here."""
        counts = np.zeros(len(self.start), np.int64)
        for chunks, step, _ in parts:
            np.maximum.at(counts, chunks, step + 1)
        offsets = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for chunks, step, edge in parts:
            edges[offsets[chunks] + step] = edge
        bounds = np.append(offsets, len(edges))[self.cuts]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        log_p = self.lattices.log_p[edges]
        before = np.empty(len(edges))
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):  # by text, so that others don't matter
            if a < b:
                before[a] = 0.0
                np.cumsum(log_p[a : b - 1], out=before[a + 1 : b])
        place = np.arange(len(edges)) - bounds[text]
        several = ~self.lattices.single[edges]
        if branch is not None:
            several &= place > branch[text]
        at = np.flatnonzero(several)
        open_ = np.full(len(edges), -np.inf)
        with np.errstate(divide="ignore"):
            rest = before[at] + np.log1p(-np.minimum(self.lattices.p[edges[at]], 1.0))
        u = _uniform(self.keys[text[at]], np.uint64(2 * round_ + 1), place[at])
        open_[at] = _truncated(rest, u, value[text[at]])
        return _Path(edges, counts, open_, before, bounds, value, has)

    def sample(self, k: int) -> tuple[list[_Path], np.ndarray]:
        """Paths in the order of their perturbed values, and by text the best value left open (-inf: none)."""
        n = len(self.cuts) - 1
        root = _gumbel(_uniform(self.keys, np.uint64(0)))
        none = np.zeros(len(self.start), np.int64)
        paths = [self._path(self._forward(self.start, 1, none), root, np.ones(n, bool), 1, None)]
        excluded: dict[tuple[int, int, int], set[int]] = {}
        for round_ in range(2, k + 2):
            at, best = np.zeros(n, np.int64), np.full(n, -np.inf)
            whose = np.zeros(n, np.int64)
            for i, path in enumerate(paths):
                own, where = _segment_max(path.open_, path.bounds)
                better = own > best
                best[better], at[better], whose[better] = own[better], where[better], i
            if round_ == k + 1:
                return paths, best
            paths.append(self._branch(paths, whose, at, best, round_, excluded))
        return paths, np.full(n, -np.inf)

    def _branch(self, paths: list[_Path], whose: np.ndarray, at: np.ndarray, value: np.ndarray, round_: int, excluded: dict) -> _Path:
        n, lat = len(value), self.lattices
        has = np.isfinite(value)
        state = np.full(len(self.start), -1)
        step = np.zeros(len(self.start), np.int64)
        branch_chunk = np.zeros(n, np.int64)
        branch_step = np.zeros(n, np.int64)
        chosen = np.zeros(n, np.int64)
        for i, path in enumerate(paths):
            mine = np.flatnonzero(has & (whose == i))
            if not len(mine):
                continue
            offsets = np.cumsum(path.counts) - path.counts
            where = path.bounds[mine] + at[mine]
            branch_chunk[mine] = np.searchsorted(offsets, where, side="right") - 1
            branch_step[mine] = where - offsets[branch_chunk[mine]]
            draws = _uniform(self.keys[mine], np.uint64(2 * round_), np.uint64(1 << 40), np.uint64(0))
            again = _uniform(self.keys[mine], np.uint64(2 * round_), np.uint64(1 << 40), np.uint64(1))
            for t, w, u, v in zip(mine.tolist(), where.tolist(), draws.tolist(), again.tolist(), strict=True):
                out = excluded.setdefault((i, t, w), {int(path.edges[w])})
                node = lat.node[path.edges[w]]
                edges = [e for e in range(lat.edge_start[node], lat.edge_start[node + 1]) if e not in out]
                mass = np.cumsum(lat.p[edges])
                pick = min(int(np.searchsorted(mass, u * mass[-1], side="right")), len(edges) - 1)
                chosen[t] = edges[pick]
                out.add(edges[pick])
                left = mass[-1] - lat.p[edges[pick]]
                if len(edges) > 1 and left > 0:
                    value_left = _truncated(np.array(path.before[w] + np.log(left)), np.array(v), np.array(value[t]))
                    path.open_[w] = value_left
                else:
                    path.open_[w] = -np.inf
        text = self.text
        later = has[text] & (np.arange(len(text)) > branch_chunk[text])
        state[later] = self.start[later]
        live = np.flatnonzero(has)
        state[branch_chunk[live]] = lat.target[chosen[live]]
        step[branch_chunk[live]] = branch_step[live] + 1
        parts = self._forward(state, round_, step)
        parts.append((branch_chunk[live], branch_step[live], chosen[live]))
        for i, path in enumerate(paths):  # the decisions before the branch, from the path that it leaves
            offsets = np.cumsum(path.counts) - path.counts
            owner = np.repeat(np.arange(n), np.diff(path.bounds))
            copied = np.flatnonzero((has & (whose == i))[owner] & (np.arange(len(owner)) - path.bounds[owner] < at[owner]))
            chunks = np.searchsorted(offsets, copied, side="right") - 1
            parts.append((chunks, copied - offsets[chunks], path.edges[copied]))
        return self._path(parts, value, has, round_, at)


def _segment_max(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each segment and its place in it; (-inf, 0) for an empty one."""
    n = len(bounds) - 1
    best, where = np.full(n, -np.inf), np.zeros(n, np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        top = np.maximum.reduceat(x, bounds[full])
        sizes = np.diff(bounds)[full]
        hits = np.flatnonzero(x[bounds[full[0]] :] == np.repeat(top, sizes)) if len(full) == n else None
        if hits is None:
            starts = np.repeat(top, sizes)
            hits = np.flatnonzero(x == starts)
        owner = np.searchsorted(bounds[full], hits + (bounds[full[0]] if len(full) == n else 0), side="right") - 1
        first = np.unique(owner, return_index=True)
        best[full] = top
        where[full[first[0]]] = hits[first[1]] + (bounds[full[0]] if len(full) == n else 0) - bounds[full[first[0]]]
    return best, where


def _chunks(text: str) -> list[str]:
    """The chunks of a text that is not empty, each without the space that it begins with (the first is given one)."""
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]


def encode_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text number, sample from 1, ids, log probability, perturbed value, log inclusion score)."""
    number: dict[str, int] = {}
    chunks, cuts = [], [0]
    for text in texts:
        if text:
            chunks += [number.setdefault(c, len(number)) for c in _chunks(text)]
        cuts.append(len(chunks))
    if not chunks:
        for t in range(len(texts)):
            yield t, 1, np.empty(0, np.int32), 0.0, 0.0, 0.0
        return
    lattices = Lattices([SPACE + c for c in number], pieces)
    paths, threshold = Sampler(lattices, np.array(chunks), np.array(cuts), keys).sample(k)
    for i, path in enumerate(paths):
        values, bounds = _ids(path, lattices, pieces)
        log_p = np.append(path.before + lattices.log_p[path.edges], 0.0)
        for t in np.flatnonzero(path.has).tolist():
            empty = path.bounds[t] == path.bounds[t + 1]
            if empty and i:
                continue
            phi = 0.0 if empty else float(log_p[path.bounds[t + 1] - 1])
            yield t, i + 1, values[bounds[t] : bounds[t + 1]], phi, float(path.value[t]), _log_inclusion(phi, float(threshold[t]))


def _log_inclusion(phi: float, threshold: float) -> float:
    """log P(Gumbel(phi) > threshold) = log(1 - exp(-exp(phi - threshold)))."""
    if threshold == -np.inf:
        return 0.0
    x = phi - threshold
    if x < -30:
        return x  # 1 - exp(-y) is y
    return float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def _ids(path: _Path, lattices: Lattices, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a path's texts in one array, and each text's bounds in it."""
    sizes = lattices.n_ids[path.edges]
    offsets = np.append(0, np.cumsum(sizes))
    values = np.empty(int(offsets[-1]), np.int32)
    ids = lattices.ids[path.edges]
    plain = ids >= 0
    values[offsets[:-1][plain]] = ids[plain]
    for at in np.flatnonzero(~plain).tolist():
        raw = chr(-1 - int(ids[at])).encode("utf-8", "surrogatepass")
        values[offsets[at] : offsets[at] + len(raw)] = [pieces.byte_first + b for b in raw]
    return values, offsets[path.bounds]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text's bytes: surfaces joined, without the space that encoding put first."""
    surface = pieces.surface
    return b"".join([surface[i] for i in ids.tolist()])[1:]


def sample_segmentations(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    samples: int = SAMPLES,
    seed: int = SEED,
    model_path: str = MODEL,
    keep: tuple[str, ...] = ("*",),
) -> DataFrame:
    """Columns ``keep`` of ``df`` in a struct column ``record`` (so no name can clash), with sample (from 1,
    in order of perturbed log-probability), ids, n_pieces, log_prob, perturbed, log_inclusion and
    round_trip (whether the ids decode to the text, byte for byte).

    A text gives ``samples`` distinct segmentations, or all if it has fewer. The draws depend on seed, id
    and text alone: repeated rows give the same samples. A null text counts as empty; an empty text has one
    segmentation, without pieces. The vocabulary is read on the driver and broadcast (32,000 pieces)."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    packed = df.select(
        F.struct(*keep).alias("record"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = packed.schema["record"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            keys = batch.column(1).to_numpy()
            sizes = [(n or 0) // 4 + 1 for n in pc.binary_length(batch.column(2)).to_pylist()]
            at = 0
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= SLICE:
                    size += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                yield _encode_slice(part, part.column(2).to_pylist(), keys[at:end], pieces, samples)
                at = end

    return packed.mapInArrow(
        encode,
        f"record {kind}, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, round_trip boolean",
    )


def _encode_slice(part: pa.RecordBatch, texts: list[str], keys: np.ndarray, pieces: Pieces, samples: int) -> pa.RecordBatch:
    found = list(encode_texts(texts, keys, pieces, samples))
    rows = pa.array([f[0] for f in found], pa.int64())
    ids = [f[2] for f in found]
    offsets = np.cumsum([0, *map(len, ids)])
    same = [decode_ids(i, pieces) == texts[f[0]].encode("utf-8", "surrogatepass") for i, f in zip(ids, found, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            part.column(0).take(rows),
            pa.array([f[1] for f in found], pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())),
            pa.array([len(i) for i in ids], pa.int32()),
            *(pa.array([f[c] for f in found], pa.float64()) for c in (3, 4, 5)),
            pa.array(same, pa.bool_()),
        ],
        ["record", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_segmentations(read_table(spark, sf_dir, "documents"), model_path=spark.conf.get(SETTING, MODEL), keep=("doc_id",))
    return found.select(F.col("record.doc_id").alias("doc_id"), *found.columns[1:])
