"""MinHash families, leakage between splits, and contamination by an evaluation set."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import Scratch
from .components import components

PERMUTATIONS = 32
BANDS = 8
NEAR = 0.8
#: Tokens whose hashes are held at a time, 256 bytes each.
TOKENS = 100_000
#: Slices of the grams' hashes that are shuffled one after the other, each gone before the next: what bounds the disk.
SLICES = 3
#: Bytes of texts whose grams are hashed at a time.
PIECE = 1 << 20
_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _least_hashes(permutations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, words) -> (id, sig): a token is hashed once for all seeds, however often a batch holds it."""
        seeds = [f"{s}|".encode() for s in range(permutations)]
        for batch in batches:
            words = batch.column(1)
            coded = words.flatten().dictionary_encode()
            told = b"".join(hashlib.md5(s + t).digest()[:8] for t in (w.encode() for w in coded.dictionary.to_pylist()) for s in seeds)
            hashes = np.frombuffer(told, ">u8").astype(np.uint64).reshape(-1, permutations)
            which, cuts = coded.indices.to_numpy(), np.asarray(words.offsets) - words.offsets[0].as_py()
            least = np.empty((batch.num_rows, permutations), np.uint64)
            first = 0
            while first < batch.num_rows:  # so many rows that their tokens' hashes stay small
                end = max(first + 1, int(np.searchsorted(cuts, cuts[first] + TOKENS)) - 1)
                least[first:end] = np.minimum.reduceat(hashes[which[cuts[first] : cuts[end]]], cuts[first:end] - cuts[first])
                first = end
            sig = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * permutations, pa.array([f"{x:016x}" for x in least.ravel().tolist()], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sig], ["id", "sig"])

    return run


def signatures(df: DataFrame, id_col: str, text_col: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, sig): the least hash of the text's tokens under each seed (the first 16 hex digits of md5 of 'seed|token'; equal
    widths, so text order is numeric order); a text without tokens counts as the token <empty>."""
    words = T.token_set(F.col(text_col))
    told = df.select(F.col(id_col).alias("id"), F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("<empty>"))).alias("words"))
    return told.mapInArrow(_least_hashes(permutations), f"id {told.schema['id'].dataType.simpleString()}, sig array<string>")


def band_keys(signed: DataFrame, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, band, key): a row per band."""
    rows = permutations // bands
    keys = F.array(*[F.array_join(F.slice("sig", b * rows + 1, rows), "") for b in range(bands)])
    return signed.select("id", F.posexplode(keys).alias("band", "key"))


def star_links(banded: DataFrame) -> DataFrame:
    """(src, dst): each member of a bucket with its smallest one; connects what all pairs would."""
    heads = banded.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return banded.join(heads, ["band", "key"]).where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst")).distinct()


def candidate_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Star links of a table of texts; band keys are written once, as both sides of the join read them."""
    return star_links(Scratch(df.sparkSession, "bands").save(band_keys(signatures(df, id_col, text_col))))


def families(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, family): everything that shares a band is one family, named by its smallest id."""
    scratch = Scratch(df.sparkSession, "families")
    banded = scratch.save(band_keys(signatures(df, id_col, text_col)))
    found = components(star_links(banded), scratch)
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("family"))


def verified_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = NEAR) -> DataFrame:
    """(a, b, similarity) with a < b: texts that share a band and whose token sets' Jaccard similarity is at
    least the threshold. Equal token sets are compared once, through their smallest ids, and handed back as
    pairs with that id, so a group of copies costs a row a copy."""
    scratch = Scratch(df.sparkSession, "pairs")
    words = F.array_sort(T.token_set(F.col(text_col)))
    told = df.select(F.col(id_col).alias("id"), words.alias("words")).where(F.size("words") > 0)
    keyed = scratch.save(told.withColumn("set", F.sha2(F.array_join("words", " "), 256)))
    sets = keyed.groupBy("set").agg(F.min("id").alias("id"))
    reps = scratch.save(keyed.join(sets, ["set", "id"], "left_semi").dropDuplicates(["set"]))
    banded = scratch.save(band_keys(signatures(reps.select("id", F.array_join("words", " ").alias("text")), "id", "text")))
    a, b = banded.select("band", "key", F.col("id").alias("a")), banded.select("band", "key", F.col("id").alias("b"))
    pairs = a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()
    near = (
        pairs.join(reps.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        .join(reps.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        .withColumn("similarity", T.jaccard(F.col("wa"), F.col("wb")))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
    copies = keyed.select("set", F.col("id").alias("b")).join(sets.withColumnRenamed("id", "a"), "set").where("a < b")
    return near.unionByName(copies.select("a", "b", F.lit(1.0).alias("similarity")))


def exact_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_id, n) of every group of equal normal forms with more than one row."""
    return (
        df.groupBy(F.md5(T.normalize(F.col(text_col))).alias("key"))
        .agg(F.min(id_col).alias("first_id"), F.count("*").cast("long").alias("n"))
        .where("n > 1")
        .select("first_id", "n")
    )


def exact_leakage(df: DataFrame, text_col: str, split: str) -> DataFrame:
    """One row: pairs of equal normal forms in different splits, counted from group sizes without pairing."""
    sizes = df.groupBy(F.md5(T.normalize(F.col(text_col))).alias("key"), split).agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("key").agg(
        (F.sum("n") * (F.sum("n") - 1) / 2 - F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("crossing")
    )
    return pairs.agg(F.coalesce(F.sum("crossing"), F.lit(0)).cast("long").alias("exact_pairs"))


def spanning_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).cast("long").alias("n_splits")).where("n_splits > 1")


def _grams(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, gram): the distinct runs of n words of each normal form, a shorter text as one; none for no words."""
    words = F.filter(F.split(T.normalize(F.col("text")), " "), lambda w: w != "")
    return df.select(id_col, F.explode(F.array_distinct(T.shingles(words, n))).alias("gram"))


def contamination(docs: DataFrame, evaluation: DataFrame, n: int = 8, threshold: float = NEAR) -> DataFrame:
    """(item_id, doc_id, contained): documents that hold at least ``threshold`` of the n-word shingles of an
    evaluation item. Only shingles of the evaluation set leave the scan of the documents. Texts without a word
    hold nothing and are held by nothing."""
    items = _grams(evaluation, "item_id", n)
    sizes = items.groupBy("item_id").agg(F.count("*").alias("size"))
    hits = _grams(docs, "doc_id", n).join(items, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return (
        hits.join(sizes, "item_id")
        .withColumn("contained", F.round(F.col("hits") / F.col("size"), 4))
        .where(F.col("hits") >= F.col("size") * threshold)
        .select("item_id", "doc_id", "contained")
    )


def external_overlap(docs: DataFrame, evaluation: DataFrame, family: str, n: int = 8, threshold: float = NEAR) -> DataFrame:
    """One row a ``family`` of documents: documents, those with an evaluation item's exact normal form, those that contain one
    (as ``contamination`` says), their percentages, and the class: ``in_distribution`` from 20 % contained on,
    ``near`` above 0, else ``out_of_distribution``."""
    told = docs.select("doc_id", family, T.normalize(F.col("text")).alias("norm"))
    norms = evaluation.select(T.normalize(F.col("text")).alias("norm")).where("norm <> ''").distinct().withColumn("exact", F.lit(True))
    held = contamination(docs, evaluation, n, threshold).select("doc_id").distinct().withColumn("held", F.lit(True))
    joined = told.join(norms, "norm", "left").join(held, "doc_id", "left")
    out = joined.groupBy(family).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("exact", F.lit(False))).alias("n_exact"),
        F.count_if(F.coalesce("held", F.lit(False))).alias("n_contained"),
    )
    share = F.col("n_contained") / F.col("n")
    kind = F.when(share >= 0.2, "in_distribution").when(share > 0, "near").otherwise("out_of_distribution")
    return out.withColumn("pct_contained", F.round(F.col("n_contained") * 100.0 / F.col("n"), 2)).withColumn("kind", kind)


def purge(df: DataFrame, id_col: str, text_col: str, split: str, priority: list[str], threshold: float = NEAR) -> DataFrame:
    """Rows to drop: of each near pair across splits, the one whose split comes later in ``priority``."""
    pairs = verified_pairs(df, id_col, text_col, threshold)
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(split))
    rank = df.select(F.col(id_col).alias("id"), order.alias("rank"))
    both = pairs.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(
        rank.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b"
    )
    return both.where("ra <> rb").select(F.when(F.col("ra") > F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def _mixed(state: np.ndarray, more: np.ndarray, factor: int) -> np.ndarray:
    state = (state ^ more) * np.uint64(factor)
    return state ^ (state >> np.uint64(32))


def _norm(lowered: str) -> bytes:
    """The normal form of a text in lower case, as ``text.normalize`` gives it."""
    return b" ".join(lowered.encode().translate(_PLAIN).split())


def _runs(norms: Iterator[bytes], n: int) -> list[bytes]:
    """The runs of n words of some normal forms, a shorter one as one run; none for no words."""
    out: list[bytes] = []
    for norm in norms:
        words = norm.split(b" ") if norm else []
        if words:
            ends = list(itertools.accumulate([len(w) + 1 for w in words]))
            out += [norm[x : y - 1] for x, y in zip([0, *ends], ends[min(n, len(words)) - 1 :], strict=False)]
    return out


def _alike(runs: list[bytes], other: set[bytes], threshold: float) -> bool:
    """Whether the runs and the others have a Jaccard similarity above the threshold. A first part of the runs decides if more of
    it is not among the others than all runs may miss."""
    if len(set(runs[: len(runs) // 3]) - other) > (1 - threshold) * len(runs) + 1:
        return False
    own = set(runs)
    both = len(own & other)
    return both > (len(own) + len(other) - both) * threshold


def _hashed_grams(norms: pa.Array, n: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, k1, k2) of the runs of n words (a shorter text is one run) whose 128 bits k1, k2 fall into slice ``part``, in the
    order of the rows. No normal form is empty."""
    lists = pc.split_pattern(norms, b" ")
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    told = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()), "<u8").reshape(-1, 2)
    told = np.concatenate([told, np.zeros((1, 2), np.uint64)])  # the last entry: no word
    words = np.concatenate([coded.indices.to_numpy(), np.full(n, len(told) - 1, np.int32)])
    first, end = offsets[:-1], offsets[1:]
    at = np.arange(offsets[-1])
    whole = at + n <= np.repeat(end, end - first)
    short = first[end - first < n]
    until = end[end - first < n]
    factors = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def run(lane: int, starts: np.ndarray, ends: np.ndarray | None) -> np.ndarray:
        state = np.full(len(starts), n, np.uint64)
        for k in range(n):
            w = words[starts + k]
            state = _mixed(state, told[w if ends is None else np.where(starts + k < ends, w, len(told) - 1), lane], factors[lane])
        return state

    starts, ends = np.flatnonzero(whole), until
    k1 = np.concatenate([run(0, starts, None), run(0, short, ends)])
    mine = k1 % np.uint64(parts) == part
    starts, short, ends = starts[mine[: len(starts)]], short[mine[len(starts) :]], ends[mine[len(starts) :]]
    k2 = np.concatenate([run(1, starts, None), run(1, short, ends)])
    rows = np.searchsorted(end, np.concatenate([starts, short]), "right")
    order = np.argsort(rows, kind="stable")
    return rows[order], k1[mine][order], k2[order]


def _gram_keys(n: int, part: int, parts: int, most: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, text in lower case) -> (k1, k2, id), once an id here. Of a run that more than ``most`` ids here hold, as many as
        show it come: it is not rare, whatever other batches hold."""
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                until = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PIECE, "right"))
                piece = batch.slice(first, max(1, until - first))
                first += piece.num_rows
                ids = piece.column(0).dictionary_encode("encode").indices.to_numpy()
                if (ids[1:] <= ids[:-1]).any():  # ids that repeat stand together
                    order = np.argsort(ids, kind="stable")
                    piece, ids = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in piece.columns], piece.schema.names), ids[order]
                norms = [_norm(t) for t in piece.column(1).to_pylist()]
                known = np.flatnonzero([len(t) > 0 for t in norms])
                if not len(known):
                    continue
                rows, k1, k2 = _hashed_grams(pa.array([norms[k] for k in known], pa.binary()), n, part, parts)
                if not len(rows):
                    continue
                rows = known[rows]
                order = np.argsort(k1, kind="stable")
                rows, k1, k2 = rows[order], k1[order], k2[order]
                fresh = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
                once = fresh.copy()
                once[1:] |= ids[rows[1:]] != ids[rows[:-1]]
                rows, k1, k2, fresh = rows[once], k1[once], k2[once], fresh[once]
                place = np.arange(len(rows))
                keep = place - place[fresh][np.cumsum(fresh) - 1] <= most
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[keep].view(np.int64)), pa.array(k2[keep].view(np.int64)), piece.column(0).take(pa.array(rows[keep]))], ["k1", "k2", "id"]
                )

    return emit


def _rare_lists(most: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, k2, id) in this order -> ids: those of each key that 2 to ``most`` different ids hold. An id that is null counts
        and is not told."""

        def told(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            sizes, known = np.diff(cuts), rows.column("id").is_valid().to_numpy()
            good = np.repeat((sizes >= 2) & (sizes <= most), sizes) & known
            counts = np.add.reduceat(good, cuts[:-1], dtype=np.int32)
            values = rows.column("id").combine_chunks().filter(pa.array(good))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts[counts > 0])]).astype(np.int32), values)
            lists = lists.filter(pc.greater(pc.list_value_length(lists), 1))
            return pa.RecordBatch.from_arrays([lists], ["ids"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
            ids = rows.column("id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            fresh = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            once = fresh.copy()
            once[1:] |= ids[1:] != ids[:-1]
            rows, cuts = rows.filter(pa.array(once)), np.flatnonzero(fresh[once])
            if len(cuts) > 1:
                yield told(rows.slice(0, int(cuts[-1])), cuts)
            rest = rows.slice(int(cuts[-1]), most + 1)  # so many show that the key is not rare
        if rest is not None:
            yield told(rest, np.array([0, rest.num_rows]))

    return emit


def _heads(prefix: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, text in lower case) -> (id, digest of the first ``prefix`` words); none for no words."""
        for batch in batches:
            heads = [t.encode().translate(_PLAIN).split(None, prefix)[:prefix] for t in batch.column(1).to_pylist()]
            known = [k for k, h in enumerate(heads) if h]
            keys = pa.array([hashlib.md5(b" ".join(heads[k])).digest() for k in known], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(known, pa.int32())), keys], ["id", "key"])

    return emit


def _rare_groups(lowered: DataFrame, scratch: Scratch, n: int, most: int, prefix: int, most_prefix: int) -> DataFrame:
    """(ids): the different lists of ids that share a rare key of ``rare_gram_purge``."""
    kind = lowered.schema["id"].dataType.simpleString()
    groups = []
    for part in range(SLICES):
        keys = lowered.mapInArrow(_gram_keys(n, part, SLICES, most), f"k1 long, k2 long, id {kind}")
        ordered = keys.repartition("k1").sortWithinPartitions("k1", "k2", "id")
        groups.append(scratch.save(ordered.mapInArrow(_rare_lists(most), f"ids array<{kind}>").distinct()))
    heads = scratch.save(lowered.mapInArrow(_heads(prefix), f"id {kind}, key binary"))
    few = heads.groupBy("key").count().where(F.col("count").between(2, most_prefix))
    groups.append(heads.join(few, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1").select("ids"))
    out = groups[0]
    for more in groups[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _near(n: int, threshold: float):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, texts in lower case, those of another id) -> the ids of those whose runs of n words have a Jaccard
        similarity above the threshold."""
        last, runs = None, set()
        for batch in batches:
            near = []
            for one, other in zip(batch.column(1), batch.column(2), strict=True):
                if (texts := other.as_py()) != last:  # (the join leaves equal ones together)
                    last, runs = texts, set(_runs(map(_norm, texts), n))
                near.append(_alike(_runs(map(_norm, one.as_py()), n), runs, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near, pa.bool_()))], ["id"])

    return tell


def rare_gram_purge(df: DataFrame, split: str, priority: dict[str, int], most: int = 25, prefix: int = 12, most_prefix: int = 50, threshold: float = NEAR) -> DataFrame:
    """(id) of the rows (id, text, split) to drop: pairs of different splits that share a run of 8 words which at most
    ``most`` rows hold, or their first ``prefix`` words where at most ``most_prefix`` rows do, and whose runs have a
    Jaccard similarity above the threshold; of each the row of larger priority goes, of equal ones the larger id.
    The bounds on rows are the operator's definition of a rare key; they bound the pairs of a key too. Texts of one id
    count as one row with the runs of all. Runs are told apart by 128 bits to find the pairs, by their words to compare them."""
    scratch = Scratch(df.sparkSession, "rare")
    lowered = df.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    groups = _rare_groups(lowered, scratch, 8, most, prefix, most_prefix)
    links = groups.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b")).distinct()
    sides = df.select("id", split, F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(split)].alias("p")).distinct()
    a, b = (sides.select(F.col("id").alias(x), F.col(split).alias(f"s{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    pairs = scratch.save(links.join(a, "a").join(b, "b").where("sa <> sb").select("a", "b", F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = scratch.save(lowered.join(asked, "id", "left_semi").groupBy("id").agg(F.collect_list("text").alias("texts")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("texts").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("texts").alias("tb")), "b")
    return both.select("id", "ta", "tb").mapInArrow(_near(8, threshold), f"id {df.schema['id'].dataType.simpleString()}").distinct()
