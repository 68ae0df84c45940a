"""Sum-of-squares online packing of documents into fixed windows.

Each task packs the documents of its partition in ascending order of ``doc_id``. A level
array counts the open windows by how many tokens they hold. A document is cut into full
windows and a rest; the rest goes to the level for which the sum of the squared counts
grows least (a full window leaves the array). With ``max_open`` windows open none is opened
for a whole rest: the rule then weighs, besides, to cut it so that its first part fills a
window up. When a partition ends, the emptiest of the open windows, ``max_open`` at most,
are cut up to fill the fuller ones, so that one window with padding remains at most. No shuffle
is needed, memory is bounded by ``max_open`` windows, and a task that runs again gives the same rows.

Defined cases: a null or empty text is a document of one id (the end id); rows with a null
``doc_id`` come first; repeated rows are packed each; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches

WINDOW, MAX_OPEN = 4096, 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """The packer of one partition. A piece is (doc_id, start, ids, doc_tokens); ids has 4 bytes an id."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_sequence: int = 0):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.counts = [0] * (window + 1)  # the level array: open windows by fill
        self.by_rule = 0  # windows that the rule itself closed
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, full = len(ids) // 4, self.window
        at = 0
        while n - at >= full:
            self.by_rule += 1
            self._close([(doc_id, at, ids[4 * at : 4 * (at + full)], n)])
            at += full
        if at < n:
            self._place((doc_id, at, ids[4 * at :], n))

    def _place(self, piece: tuple) -> None:
        doc_id, start, ids, n = piece
        size, full, c = len(ids) // 4, self.window, self.counts
        # growth of the sum of squares if the piece opens a window, goes to one, fills one up, or fills one up and opens one with what is left
        best = (2 * c[size] + 1, 1, 0) if self.n_open < self.max_open else None
        for level in self.open:
            to = level + size
            if to < full:
                found = (2 * (c[to] - c[level]) + 2, 1, level)
            elif to == full:
                found = (1 - 2 * c[level], 0, level)
            elif self.n_open >= self.max_open:
                left = to - full
                found = (2 * (c[left] - c[level]) + (0 if left == level else 2), 2, level)
            else:
                continue
            if best is None or found < best:
                best = found
        level = best[2]
        room = full - level
        if size > room:  # cut
            self.by_rule += 1
            self._close([*self._take(level), (doc_id, start, ids[: 4 * room], n)])
            self._place((doc_id, start + room, ids[4 * room :], n))
            return
        self.by_rule += size == room
        self._put([*self._take(level), piece] if level else [piece], level + size)

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        pieces = self.open[level].pop()
        if not self.open[level]:
            del self.open[level]
        return pieces

    def _put(self, pieces: list[tuple], level: int) -> None:
        if level == self.window:
            self._close(pieces)
        else:
            self.counts[level] += 1
            self.n_open += 1
            self.open.setdefault(level, []).append(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids) // 4, ids, n, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def consolidate(self) -> None:
        """Fill the fuller open windows with what the emptiest hold, cutting pieces; one open window is left at most."""
        windows = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts = [0] * (self.window + 1)
        spare: list[tuple] = []  # pieces of windows that were given up
        low, high = 0, len(windows) - 1
        while low <= high:
            level, pieces = windows[high]
            room = self.window - level
            while room and (spare or low < high):
                if not spare:
                    spare = list(reversed(windows[low][1]))
                    low += 1
                doc_id, start, ids, n = spare.pop()
                fits = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * fits], n))
                if 4 * fits < len(ids):
                    spare.append((doc_id, start + fits, ids[4 * fits :], n))
                room -= fits
            self._put(pieces, self.window - room)
            high -= 1
        level, rest = 0, []
        while spare:  # what is left of the last window that was given up: under one window
            rest.append(spare.pop())
            level += len(rest[-1][2]) // 4
        if rest:
            self._put(rest, level)

    def finish(self) -> None:
        self.consolidate()
        for stacks in self.open.values():
            for pieces in stacks:
                self._close(pieces)
        self.open, self.n_open = {}, 0
        self.counts = [0] * (self.window + 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW)], schema=ARROW)


def pack(docs: DataFrame, *, window: int = WINDOW, end_id: int = 2, tokenizer_path: str | None = None, max_open: int = MAX_OPEN) -> DataFrame:
    """The pieces of all documents: ``SCHEMA``. ``ids`` holds little-endian unsigned 32-bit ids.

    ``sequence_id`` is unique; its high bits are the partition's number.
    """
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() << 36)
        encode = tokens.encoder(tokenizer_path).encode
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.add(doc_id, ids + end)
            if len(packer.done) >= 256:
                yield _batch(packer.done)
                packer.done = []
        packer.finish()
        for i in range(0, len(packer.done), 1024):
            yield _batch(packer.done[i : i + 1024])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, SCHEMA)
