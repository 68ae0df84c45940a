"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits; two are linked when at most 4 bits differ. Then in one of
their two 32-bit halves at most 2 bits differ. The anchors of a half are a covering code:
the [31, 26] Hamming code (each word of 31 bits lies within 1 bit of exactly one code
word) with the last bit free. Its covering radius is 1. Two halves that differ in up to
2 bits have a word between them that is within 1 bit of both, and that word has an anchor
within the covering radius; so both halves lie within radius 1 + 1 = 2 of one anchor. Each
fingerprint is replicated to every anchor within that distance of its halves (2 or 17 a
half, 33 in all on average, out of 2**28), and compared within the anchors alone, by the
whole fingerprint. No link is lost, and none is approximate.

Equal fingerprints are one node, so copies never meet in an anchor. Anchors of more than
``BLOCK`` fingerprints are split into blocks; each pair of blocks is a group of its own, so
a task holds two blocks at most. A group gives the links of a spanning forest rather than
all its pairs. Components are found by distributed star contraction.

Defined cases: a null or empty text, or one of white space only, has fingerprint 0 and is
linked like any other; repeated rows come out each; a component all of whose ``doc_id`` are
null has a null ``component_id``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered, small_batches
from .components import components, local_components

SEED, SHINGLE, BITS_APART, BLOCK = 42, 4, 4, 2048


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest as h

    # bytes.lower() touches A-Z alone and bytes.split() splits at \x20 and \x09-\x0D alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return h(b" ".join(words), SEED)
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    view = memoryview(body)
    hashes = [h(view[s:e], SEED) for s, e in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist())]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones, raw = np.zeros(64, np.int64), hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), 8192):  # 64 bytes a hash once unpacked
        ones += np.unpackbits(raw[i : i + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, carried: Column | None = None) -> DataFrame:
    """doc_id, row (the long ``carried``, or null), fp (the fingerprint's bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "row", "fp"])

    row = F.lit(None).cast("long") if carried is None else carried
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("string").alias("body")).mapInArrow(run, "doc_id long, row long, fp long")


# --- anchors --------------------------------------------------------------------------


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the exclusive or of the positions 1..31 of their set bits."""
    s = np.zeros(len(words), np.uint64)
    for position in range(1, 32):
        s ^= ((words >> np.uint64(position - 1)) & np.uint64(1)) * np.uint64(position)
    return s


def _flip_table() -> np.ndarray:
    """For each syndrome 1..31 the 16 patterns of one or two bits that have it; row 0 is unused."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a < a ^ s]
        out[s] = [1 << (s - 1), *pairs]
    return out


FLIPS = _flip_table()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of both halves of unsigned fingerprints: (index of the fingerprint, anchor).

    An anchor is a number of 33 bits: the half's side, the free bit, the code word.
    """
    rows, keys = [], []
    top, index = np.uint64(1 << 31), np.arange(len(fps))
    for side in (0, 1):
        half = (fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
        word, free = half & np.uint64(0x7FFFFFFF), half & top
        base = np.uint64(side << 32)
        s = _syndrome(word).astype(np.int64)
        on = s == 0  # a code word: within 2 bits are itself, with the free bit as it is or flipped
        for f in (np.uint64(0), top):
            rows.append(index[on])
            keys.append(base | word[on] | (free[on] ^ f))
        off, flips = ~on, FLIPS[s[~on]]
        near = word[off][:, None] ^ flips
        rows.append(np.repeat(index[off], 16))
        keys.append((base | near | free[off][:, None]).ravel())
        rows.append(index[off])  # one bit of the word and the free bit
        keys.append(base | near[:, 0] | (free[off] ^ top))
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        rows, keys = anchors(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["anchor", "fp"])


def linked_groups(group: np.ndarray, fps: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each group: ``group`` is sorted, ``fps`` unsigned.

    Compares the k-th next row of the same group, for k = 1, 2, ...; so arrays of a batch's
    length are all it holds.
    """
    n, k = len(fps), 1
    order = np.arange(n)
    root, seen_a, seen_b, held = order, [], [], 0
    alive = order
    while True:
        alive = alive[alive + k < n]
        alive = alive[group[alive] == group[alive + k]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + k]) <= apart]
        near = near[root[near] != root[near + k]]
        if len(near):
            seen_a.append(near)
            seen_b.append(near + k)
            held += len(near)
        if held > 200_000:
            root = local_components(n, np.concatenate([order, *seen_a]), np.concatenate([root, *seen_b]))
            seen_a, seen_b, held = [], [], 0
        k += 1
    if held:
        root = local_components(n, np.concatenate([order, *seen_a]), np.concatenate([root, *seen_b]))
    moved = root != order
    return fps[moved], fps[root[moved]]


def _compare(apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs(parts):
            cols = [np.concatenate(c) for c in zip(*parts)]
            step = np.zeros(len(cols[0]), np.int64)
            step[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            a, b = linked_groups(np.cumsum(step), cols[3].view(np.uint64), apart)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in gathered(batches):
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            differs = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])
            last = len(differs) - int(np.argmax(differs[::-1])) if differs.any() else 0  # where the last group starts
            if last:
                yield pairs([*held, tuple(c[:last] for c in cols)])
                held = [tuple(c[last:] for c in cols)]
            elif held and any(h[0] != c[0] for h, c in zip(held[-1][:3], cols[:3])):
                yield pairs(held)
                held = [cols]
            else:
                held.append(cols)
        if held:
            yield pairs(held)

    return run


def links(nodes: DataFrame, apart: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all fingerprints ``fp`` (distinct) within ``apart`` <= 4 bits."""
    if not 0 <= apart <= 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    dealt = nodes.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    counts = dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = dealt.join(counts, "anchor").select("anchor", "fp", blocks.alias("m"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    # block i meets block j in group (i, j); an anchor of one block has the group (0, 0) alone
    rows = rows.select("anchor", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    rows = rows.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return rows.mapInArrow(_compare(apart), "a long, b long")


# --- the operator ---------------------------------------------------------------------


def simhash_groups(docs: DataFrame, apart: int = BITS_APART, size: int = SHINGLE, block: int = BLOCK, carried: Column | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), and row (``carried``), root (a fingerprint that stands for the component)."""
    found = checkpointed(fingerprints(docs, size, carried))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, apart, block))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # read anew, it is dealt out for the join, and Spark can split a large component's nodes
    least = checkpointed(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = nodes.join(least, "root").select("fp", "component_id", "root")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row", "root")


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """Of each component the row with the smallest ``doc_id`` (null last; then of the least columns), all columns kept."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = simhash_groups(docs, carried=key, **options)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("kept_row"))
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that can't clash
    rows = docs.select("*", key.alias("row")).toDF(*own, "own_row").join(kept, F.col("own_row") == F.col("kept_row"), "left_semi")
    rows = rows.groupBy("own_row").agg(F.min(F.struct(*own)).alias("first")).select(*[F.col(f"first.{c}") for c in own])  # rows that are there twice
    return rows.toDF(*docs.columns)
