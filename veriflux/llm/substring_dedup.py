"""Substring dedup: paragraphs that repeat, exactly or nearly, and passages that repeat wherever their lines end.

A paragraph is a line of at least ``min_words`` words. Its words' 5-word shingles are a
set; two paragraphs are near if the Jaccard similarity of their sets is ``similarity`` or
more.

1. Distinct paragraphs, by 128 bits of hash of their words, with the first's position.
2. MinHash banding: ``rows`` minima to a band and so many bands that a pair at the
   threshold collides with probability ``recall`` at least (``banding``).
3. Paragraphs that share a band key with another are joined with their shingles and
   compared within the key, exactly. A key of more than ``BLOCK`` paragraphs is dealt
   into pairs of blocks; a group gives the links of a spanning forest, not all its pairs.
4. Components of the links; in each the earliest paragraph, by (doc_id, line), stays and
   all others are removals.

Links use the first 64 bits of the hash as the paragraph's number.

A passage is a run of ``PASSAGE`` or more words that is in the table twice, over the whole text;
every such run is found (``repeated_passages``).

1. Winnowing: of the ``SEED``-word grams in each window of ``PASSAGE`` words the last with the
   least hash is the window's seed. Equal windows have equal seeds.
2. Seeds that occur twice fill a filter of ``SEED_BITS`` bits, whatever the table's size. A seed
   that is not in it ends the matter for its windows; the filter lets some too many through.
3. The windows that are left are dealt by their seeds and compared by 64 bits of hash of all their
   words, besides the seed's 64. Of equal ones the earliest stays; the others go, but for those
   that overlap it. Seeds of more than ``HOT`` places, which fill a second filter, are not dealt to
   one task each: the earliest of their equal windows and how many there are come from combined
   aggregates, and a join hands them on whose skewed partitions Spark splits.
4. Windows that follow each other and repeat windows that follow each other make a passage.

Defined cases: null and empty texts have no paragraphs; rows with a null ``doc_id`` come
first; rows that share an id share positions, and each comes out; an empty table gives
no rows; other columns are ignored. Passages tell rows that share an id apart by a hash of their
texts; rows with the same id and text count as one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import checkpointed, fresh_folder, small_batches
from .components import components
from .line_dedup import among

SHINGLE, SIMILARITY, MIN_WORDS, BLOCK = 5, 0.8, 20, 512
ROWS, RECALL = 3, 0.995
PASSAGE, SEED = 50, 26
#: Places of a seed that one task may hold.
HOT = 2048
#: Bits of the filter of seeds (16 MB), and of one of Spark's bitmaps.
SEED_BITS, MAP_BITS = 1 << 27, 1 << 15


def banding(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands for which 1 - (1 - s**rows)**bands reaches ``recall`` at s = ``similarity``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows))))


_MIX = np.random.default_rng(20_240_607).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def paragraphs(text: str | None, min_words: int, h) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, first words and hashed words (flat) of a text's paragraphs."""
    lines, counts, flat = [], [], []
    for i, own in enumerate(words.lines(text)):
        if len(own) >= min_words:
            lines.append(i)
            counts.append(len(own))
            flat += own
    return np.array(lines, np.int64), np.array(counts, np.int64), np.fromiter(map(h, flat), np.uint64, len(flat))


def shingles(counts: np.ndarray, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles (flat) of paragraphs of ``counts`` words each, and how many each has (one, of all words, if too short)."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    own = np.repeat(np.arange(len(counts)), counts)
    for k in range(size):
        same = own[k:] == own[: n - k] if k else np.ones(n, bool)
        total[: n - k] += np.where(same, _mixed(hashes[k:] + _ODD[k]) * _ODD[k], np.uint64(0))
    number = np.maximum(counts - size + 1, 1)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mixed(total[place < np.repeat(number, counts)]), number


def _identity(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each paragraph's sequence of words."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(hashes)) - np.repeat(starts, counts)).astype(np.uint64)
    return tuple(_mixed(np.add.reduceat(_mixed(hashes * _ODD[k] + place * _ODD[k + 2]), starts) + counts.astype(np.uint64)) for k in (0, 1))


def band_keys(shingled: np.ndarray, number: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, paragraphs by bands."""
    starts, keys = np.cumsum(number) - number, np.empty((len(number), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(number), b + 1, np.uint64)
        for r in range(rows):
            i = b * rows + r
            low = np.minimum.reduceat((shingled ^ _MIX[0, i]) * _MIX[1, i], starts)
            key = _mixed(key * _ODD[0] + low)
        keys[:, b] = key
    return keys


def _hashed(bodies: list[str | None], h) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashed words (flat) of some texts, and of each line with words the text's number, its own and how many words it has."""
    flat, text, line, counts = [], [], [], []
    for t, body in enumerate(bodies):
        for i, own in enumerate(words.lines(body)):
            if own:
                flat += own
                text.append(t)
                line.append(i)
                counts.append(len(own))
    return np.fromiter(map(h, flat), np.uint64, len(flat)), *(np.array(x, np.int64) for x in (text, line, counts))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("body"))


def _scan(docs: DataFrame, *, min_words: int = MIN_WORDS, bands: int = 0, rows: int = ROWS) -> DataFrame:
    """What one pass over all texts gives, written to the shared folder and read back: a row for each
    paragraph (doc, line, h1, h2, keys), and rows with the seeds of all windows of some texts (seeds)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        kinds = {"doc": pa.int64(), "line": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "keys": pa.list_(pa.int64()), "seeds": pa.list_(pa.int64())}
        schema = pa.schema(kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                hashes, text, line, counts = _hashed(part.column(1).to_pylist(), h)
                if not len(hashes):
                    continue
                long = counts >= min_words
                if long.any():
                    own, own_hashes = counts[long], hashes[np.repeat(long, counts)]
                    one, two = _identity(own, own_hashes)
                    keys = band_keys(*shingles(own, own_hashes), bands, rows).view(np.int64)
                    cols = [part.column(0).take(pa.array(text[long])), pa.array(line[long].astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * bands, pa.int32()), pa.array(keys.ravel())))
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(own), kinds["seeds"])], schema=schema)
                if found := _passage_windows(hashes, np.repeat(text, counts)):
                    _, place, grams = found
                    seeds = pa.array([grams[np.unique(place)].view(np.int64)], kinds["seeds"])
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in list(kinds.values())[:-1]), seeds], schema=schema)

    at = f"{fresh_folder(docs.sparkSession, 'paragraphs')}/rows"
    _texts(docs).mapInArrow(run, "doc long, line int, h1 long, h2 long, keys array<long>, seeds array<long>").write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id), sorted, of keys that two ids share at least. Holds one batch and one row."""
    tail = None  # the last row so far, and whether it has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if tail is not None:
            key, own = np.concatenate(([tail[0]], key)), np.concatenate(([tail[1]], own))
        after = np.concatenate((key[1:] == key[:-1], [False]))
        keep = after | np.concatenate(([False], after[:-1]))
        if tail is not None:
            keep[0] &= not tail[2]
        out = np.flatnonzero(keep)
        given = bool(keep[-1]) or (len(key) == 1 and tail is not None and tail[2])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(own[out])], ["key", "id"])
        tail = (key[-1], own[-1], given)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def near_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the near pairs of one group."""
    n, out = len(ids), []
    order = np.argsort([len(s) for s in sets], kind="stable")
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    for x in range(n):
        i = order[x]
        for y in range(x - 1, -1, -1):
            j = order[y]
            if sizes[j] < similarity * sizes[i] - 1e-9:
                break  # too short, like all before it
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= similarity - 1e-12:
                root[root == root[i]] = root[j]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def done():
            links = near_links(np.array(ids), sets, similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, own, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != group:
                    if len(ids) > 1:
                        yield done()
                    group, ids, sets = key, [], []
                ids.append(own)
                sets.append(np.frombuffer(data, np.uint64))
        if len(ids) > 1:
            yield done()

    return run


def _shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """id, data (the sorted shingles' bytes) of the paragraphs at the positions ``wanted`` (id, doc, line)."""
    lines = _texts(docs).select("doc", F.posexplode(F.split("body", "\n")).alias("line", "body"))
    place = F.xxhash64("doc", "line").alias("h1")
    lines = among(lines.filter(F.length("body") >= 2 * min_words - 1).select("*", place), wanted.select(place))  # so that not all lines are shuffled
    at = wanted.select("id", F.col("doc").alias("at_doc"), F.col("line").alias("at_line"))
    rows = lines.join(at, F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("line") == F.col("at_line"))).select("id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            out_id, out = [], []
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, counts, hashes = paragraphs(body, min_words, h)
                if len(counts) == 1:
                    one, _ = _identity(counts, hashes)
                    if int(one.view(np.int64)[0]) == own:  # rows that share an id may hold another line there
                        out_id.append(own)
                        out.append(np.unique(shingles(counts, hashes)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.binary())], ["id", "data"])

    return rows.mapInArrow(run, "id long, data binary").groupBy("id").agg(F.first("data").alias("data"))


def scan(docs: DataFrame, *, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, rows: int = ROWS, recall: float = RECALL, **_) -> DataFrame:
    """``_scan`` with as many bands as the options ask for."""
    bands = banding(similarity, rows, recall)
    if bands * rows > _MIX.shape[1]:
        raise ValueError("too many minima")
    return _scan(docs, min_words=min_words, bands=bands, rows=rows)


def near_paragraphs(docs: DataFrame, listed: DataFrame, *, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of the paragraphs ``listed`` (of ``scan``) the distinct ones (h1, h2, first, times), and the components of the near ones among them (node, root: h1)."""
    distinct = checkpointed(listed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("times"), F.first("keys").alias("keys")))
    dealt = distinct.select(F.explode("keys").alias("key"), F.col("h1").alias("id")).repartition("key").sortWithinPartitions("key", "id")
    met = checkpointed(dealt.mapInArrow(_colliding, "key long, id long"))
    wanted = met.select("id").distinct().join(distinct.select(F.col("h1").alias("id"), "first.doc", "first.line"), "id")
    sets = _shingle_sets(docs, wanted, min_words)
    counts = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    pairs = met.join(counts, "key").select("key", "id", blocks.alias("m"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    pairs = pairs.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id").join(sets, "id")
    pairs = pairs.select("key", "i", "j", "id", "data").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return distinct.drop("keys"), components(pairs.mapInArrow(_verify(similarity), "a long, b long"))


def repeated_paragraphs(docs: DataFrame, scanned: DataFrame | None = None, **options) -> DataFrame:
    """Each paragraph that is in a group of two or more: doc_id, line, keep_doc_id, keep_line, group_size, removed."""
    listed = (scan(docs, **options) if scanned is None else scanned).filter("h1 is not null").drop("seeds")
    distinct, roots = near_paragraphs(docs, listed, **{k: v for k, v in options.items() if k not in ("rows", "recall")})
    named = distinct.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "h2", "first", "times", F.coalesce("root", "h1").alias("root"))
    groups = named.groupBy("root").agg(F.min("first").alias("keep"), F.sum("times").alias("group_size")).filter("group_size > 1")
    named = checkpointed(named.join(groups, "root").select("h1", "h2", "keep", "group_size"))
    rows = listed.select("doc", "line", "h1", "h2").join(named, ["h1", "h2"])
    removed = F.struct("doc", "line") > F.col("keep")
    return rows.select(F.col("doc").alias("doc_id"), "line", F.col("keep.doc").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), "group_size", removed.alias("removed"))


# --- passages -------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def gram_hashes(hashes: np.ndarray, size: int, k: int) -> np.ndarray:
    """Hash (the ``k``th of two) of each ``size`` consecutive words of the flat hashed words."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    base = int(_ODD[k])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes + _ODD[k + 2]) * _powers(base, n)[:n])))
    return _mixed((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), n)[: n - size + 1])


def seeds(grams: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive grams the place of the last least one."""
    at, done = np.arange(len(grams)), 1
    while done < width and len(at):
        step = min(done, width - done)
        a, b = at[:-step], at[step:]
        at, done = np.where(grams[b] <= grams[a], b, a), done + step
    return at


def _passage_windows(hashes: np.ndarray, text: np.ndarray) -> tuple | None:
    """Of hashed words, each with its text: the first words of windows that lie in one text, their seeds' places and all grams."""
    if len(hashes) < PASSAGE:
        return None
    grams = gram_hashes(hashes, SEED, 0)
    place = seeds(grams, PASSAGE - SEED + 1)
    inside = np.flatnonzero(text[: len(place)] == text[PASSAGE - 1 :])
    return (inside, place[inside], grams) if len(inside) else None


def _filter_of(met: DataFrame) -> np.ndarray:
    """The bytes of a filter of the seeds: ``SEED_BITS`` bits."""
    place = F.pmod("seed", F.lit(SEED_BITS))
    maps = met.groupBy((place / MAP_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(place % MAP_BITS).alias("map"))
    bits = np.zeros((SEED_BITS // MAP_BITS, MAP_BITS // 8), np.uint8)
    for r in maps.toLocalIterator():
        bits[r.bucket] = np.frombuffer(r.map, np.uint8)
    return bits.ravel()


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the rows of ``values``, cut at ``starts``."""
    ends = np.append(starts, len(values)).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _in_filter(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    bit = seeds & np.uint64(SEED_BITS - 1)
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(docs: DataFrame, bits: np.ndarray, hot: np.ndarray) -> DataFrame:
    """A row for each run of windows with one seed that is in the filter: whether it is in the filter ``hot``, the first word of the first window that has it, and of all these windows a hash and the lines they begin and end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                hashes, text, line, counts = _hashed(part.column(1).to_pylist(), h)
                text, line = np.repeat(text, counts), np.repeat(line, counts)
                if not (found := _passage_windows(hashes, text)):
                    continue
                first, place, grams = found
                hit = _in_filter(bits, grams[place])
                first, place = first[hit], place[hit]
                if not len(first):
                    continue
                # a seed that comes again in each of the next windows, as in words said over and over, gives one row
                own_seed = grams[place]
                starts = np.flatnonzero(np.concatenate(([True], (own_seed[1:] != own_seed[:-1]) | (first[1:] != first[:-1] + 1) | (text[first[1:]] != text[first[:-1]]))))
                at_first = first[starts]
                own = pa.array(text[at_first])
                word = pa.array((at_first - np.searchsorted(text, text[at_first])).astype(np.int32))
                lines = np.stack((line[first], line[first + PASSAGE - 1]), axis=1).astype(np.int32)
                seed = own_seed[starts]
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(_in_filter(hot, seed)), part.column(0).take(own), part.column(2).take(own), word, _binary(gram_hashes(hashes, PASSAGE, 1)[first], starts), _binary(lines, starts)], ["seed", "hot", "doc", "copy", "word", "hashes", "lines"])

    return _texts(docs).withColumn("copy", F.xxhash64("body")).mapInArrow(run, "seed long, hot boolean, doc long, copy long, word int, hashes binary, lines binary")


_RUNS = "doc long, copy long, keep_doc long, keep_copy long, shift int, removed boolean, word int, n int, line int, last_line int, keep_line int, times int"


def _runs(doc, copy, word: int, lines: list[int], met: list[tuple]) -> Iterator[tuple]:
    """``_RUNS`` of one place: ``met`` has for some of its windows, in order, their numbers, the earliest (doc, copy, word, line) and how many there are."""
    run, last = None, -2
    for i, keep, times in met:
        same, shift = (doc, copy) == tuple(keep[:2]), word + i - keep[2]
        kind = None
        if not same or shift == 0 or shift >= PASSAGE:
            kind = (doc, copy, *keep[:2], shift, not same or shift > 0)
        if run is not None and (i != last + 1 or tuple(run[:6]) != kind):
            yield tuple(run)
            run = None
        if run is not None:
            run[7], run[9], run[11] = run[7] + 1, lines[2 * i + 1], max(run[11], times)
        elif kind is not None:
            run = [*kind, word + i, 1, lines[2 * i], lines[2 * i + 1], keep[3], times]
        last = i
    if run is not None:
        yield tuple(run)


def _matched(rows: list[tuple]) -> Iterator[tuple]:
    """``_RUNS`` of the places of one seed, which are sorted: of each window the earliest stays."""
    places = [(d, c, w, np.frombuffer(h, np.int64).tolist(), np.frombuffer(x, np.int32).tolist()) for d, c, w, h, x in rows]
    first: dict = {}
    times: dict = {}
    for doc, copy, word, hashes, lines in places:
        for i, h in enumerate(hashes):
            first.setdefault(h, (doc, copy, word + i, lines[2 * i]))
            times[h] = times.get(h, 0) + 1
    for doc, copy, word, hashes, lines in places:
        yield from _runs(doc, copy, word, lines, [(i, first[h], times[h]) for i, h in enumerate(hashes) if times[h] > 1])


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _RUNS.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seed, held, out = None, [], []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if own != seed:
                if held:
                    out += _matched(held)
                seed, held = own, []
            if not held or held[-1][:3] != row[:3]:  # the same id and text again is the same place
                held.append(row)
        if len(out) > 2000:
            yield _run_batch(out)
            out = []
    if held:
        out += _matched(held)
    if out:
        yield _run_batch(out)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (seed, alike, n, doc, copy, word, lines, hashes) each window's hash for itself: once, with the numbers ``at`` of all windows that have it, and the first one's word and line."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column(7).to_pylist()
        sizes = np.array([len(x) // 8 for x in found], np.int64)
        number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lines = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int32)[::2]
        run, hashes = np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(found), np.int64)
        order = np.lexsort((number, hashes, run))
        starts = np.flatnonzero(np.concatenate(([True], (run[order[1:]] != run[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]]))))
        first = order[starts]
        at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(number[order].astype(np.int32)))
        own = [batch.column(i).take(pa.array(run[first])) for i in range(5)]
        word = batch.column(5).to_numpy()[run[first]] + number[first]
        yield pa.RecordBatch.from_arrays([*own[:2], at, pa.array(hashes[first]), *own[2:], pa.array(word.astype(np.int32)), pa.array(lines[first])], ["seed", "alike", "at", "hash", "n", "doc", "copy", "word", "line"])


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_RUNS`` of the places (doc, copy, word, lines, met)."""
    for batch in batches:
        out = []
        for doc, copy, word, lines, met in zip(*(c.to_pylist() for c in batch.columns)):
            met = sorted((i, (m["doc"], m["copy"], m["word"], m["line"]), m["times"]) for m in met for i in m["at"])
            out += _runs(doc, copy, word, np.frombuffer(lines, np.int32).tolist(), met)
        if out:
            yield _run_batch(out)


def _matched_apart(rows: DataFrame) -> DataFrame:
    """``_RUNS`` of seeds of any number of places. Places whose windows are all alike are told apart last, and equal windows of one place, as in words said over and over, go as one row."""
    rows = checkpointed(rows.distinct().withColumn("alike", F.xxhash64("hashes")))
    alike = rows.groupBy("seed", "alike").agg(F.min(F.struct("doc", "copy", "word", "lines", "hashes")).alias("first"), F.count(F.lit(1)).alias("n"))
    single = checkpointed(alike.select("seed", "alike", "n", "first.*").mapInArrow(_single, "seed long, alike long, at array<int>, hash long, n long, doc long, copy long, word int, line int"))
    first = single.groupBy("seed", "hash").agg(F.min(F.struct("doc", "copy", "word", "line")).alias("keep"), F.sum(F.col("n") * F.size("at")).cast("int").alias("times")).filter("times > 1")
    met = single.select("seed", "alike", "at", "hash").join(checkpointed(first), ["seed", "hash"])
    met = met.groupBy("seed", "alike").agg(F.collect_list(F.struct("at", "keep.doc", "keep.copy", "keep.word", "keep.line", "times")).alias("met"))
    found = rows.join(checkpointed(met), ["seed", "alike"]).select("doc", "copy", "word", "lines", "met")
    return found.mapInArrow(_split_runs, _RUNS)


def repeated_passages(docs: DataFrame, scanned: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """Each passage that repeats: the columns of ``repeated_paragraphs``, and last_line, first_word, last_word, keep_first_word.

    Words are counted in the document from 0; ``group_size`` is the most that one of its windows occurs.
    """
    small_batches(docs.sparkSession)
    found = (_scan(docs) if scanned is None else scanned).select(F.explode("seeds").alias("seed"))
    met = checkpointed(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = _windows(docs, _filter_of(met), _filter_of(met.filter(F.col("n") > hot)))
    placed = checkpointed(placed)
    rows = placed.filter("not hot").drop("hot").repartition("seed").sortWithinPartitions("seed", "doc", "copy", "word")
    rows = rows.mapInArrow(_match, _RUNS).unionByName(_matched_apart(placed.filter("hot").drop("hot")))
    # runs that follow each other have the same first word less the windows before them
    group = ["doc", "copy", "keep_doc", "keep_copy", "shift", "removed"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("run", F.col("word") - before)
    out = rows.groupBy(*group, "run").agg(F.min("word").alias("first_word"), (F.max(F.col("word") + F.col("n")) + PASSAGE - 2).alias("last_word"), F.min("line").alias("line"), F.max("last_line").alias("last_line"), F.min("keep_line").alias("keep_line"), F.max("times").cast("long").alias("group_size"))
    return out.select(F.col("doc").alias("doc_id"), "line", F.col("keep_doc").alias("keep_doc_id"), "keep_line", "group_size", "removed", "last_line", "first_word", "last_word", (F.col("first_word") - F.col("shift")).alias("keep_first_word"))


def repeats(docs: DataFrame, **options) -> DataFrame:
    """The repeated paragraphs (no word numbers: whole lines), and the repeated passages."""
    scanned = scan(docs, **options)
    lines = repeated_paragraphs(docs, scanned, **options).withColumn("last_line", F.col("line"))
    return lines.unionByName(repeated_passages(docs, scanned), allowMissingColumns=True)
