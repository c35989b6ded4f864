"""Packing documents into token windows: best-fit decreasing.

Each task packs its own rows, so nothing is shuffled. A document is tokenised,
closed with an end id and cut into full windows; what is left over joins a
batch. A batch is placed longest first, each piece into the open window with
the least room that still holds it, found by a segment tree over remaining
capacities. Open windows live on into the task's next batch. When a task ends,
the emptiest open windows are taken apart and their pieces, cut where needed,
fill the gaps of the others; the last remainder is laid out in windows whose
lengths are powers of two, which need no padding.

Defined results: a null or empty text is a document of the end id alone; a null
id stays null; repeated rows are packed once each; an empty table gives no
pieces; further columns, whatever their names, are not read. Every id lies in
exactly one piece. A task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.textbuf import tidy
from tablelog.llm.units import encoder, pieces


class Rooms:
    """Open windows by remaining capacity; a segment tree counts them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list] = defaultdict(list)

    def _add(self, room: int, n: int) -> None:
        k = self.leaves + room
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, room: int, window) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open window that is at least `least`."""
        k = self.leaves + least
        if not self.count[k]:
            while k & 1 or not self.count[k + 1]:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves

    def take(self, room: int):
        self._add(room, -1)
        return self.open[room].pop()


class Packer:
    """Pieces of one task; rows come out as (id, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.rooms = Rooms(size)
        self.rows: list[tuple] = []
        self.batch: list[tuple] = []  # (length, id, start, ids, tokens)
        self.held: dict[int, list[tuple]] = {}  # windows of the current batch that aren't full, with their pieces

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        length, key, start, ids, tokens = piece
        self.rows.append((key, start, length, zlib.crc32(ids), tokens, sequence, offset))

    def add(self, key, ids: np.ndarray) -> None:
        n = len(ids)
        for a in range(0, n - n % self.size, self.size):
            self._row((self.size, key, a, ids[a : a + self.size], n), self.next, 0)
            self.next += 1
        if n % self.size:
            a = n - n % self.size
            self.batch.append((n - a, key, a, ids[a:].copy(), n))

    def place(self) -> None:
        """Best fit, longest piece first, for the batch at hand."""
        self.batch.sort(key=lambda p: -p[0])
        for piece in self.batch:
            length = piece[0]
            room = self.rooms.tightest(length)
            if room is None:
                room, sequence = self.size, self.next
                self.next += 1
                self.held[sequence] = []
            else:
                sequence = self.rooms.take(room)
            if sequence in self.held:
                self.held[sequence].append((piece, self.size - room))
            else:
                self._row(piece, sequence, self.size - room)
            if room > length:
                self.rooms.put(room - length, sequence)
            elif sequence in self.held:
                self._settle(sequence)
        self.batch = []

    def _settle(self, sequence: int) -> None:
        for piece, offset in self.held.pop(sequence):
            self._row(piece, sequence, offset)

    def settle(self) -> None:
        """Let go of the ids of pieces placed so far; their windows stay open."""
        for sequence in list(self.held):
            self._settle(sequence)

    def finish(self) -> None:
        """Fill gaps from the emptiest windows; lay the rest out in powers of two."""
        gaps = {s: room for room, windows in self.rooms.open.items() for s in windows}
        loose = sorted((s for s in self.held), key=lambda s: -gaps[s])
        for s in loose:
            if s not in gaps:  # filled meanwhile
                continue
            used = self.size - gaps[s]
            spare = sum(gaps.values()) - gaps[s]
            if len(gaps) > 1 and spare < used:
                break
            self._spill([p for p, _ in self.held.pop(s)], gaps, s)
        for s in sorted((s for s in self.held if gaps.get(s, 0) >= 64), key=lambda s: -gaps[s])[:1]:
            self._spill([p for p, _ in self.held.pop(s)], {}, s)
        self.settle()

    def _spill(self, taken: list[tuple], gaps: dict[int, int], source: int) -> None:
        gaps.pop(source, None)
        order = iter(sorted(gaps, key=lambda s: gaps[s]))
        left = sum(p[0] for p in taken)
        target, room = source, 0
        for piece in taken:
            while piece[0]:
                if not room:
                    target = next(order, None)
                    if target is not None:
                        room = gaps.pop(target)
                        at = self.size - room
                    else:  # a fresh window of the largest power of two that the rest fills
                        target, self.next = self.next, self.next + 1
                        room, at = 1 << (left.bit_length() - 1), 0
                length, key, start, ids, tokens = piece
                n = min(room, length)
                self._row((n, key, start, ids[:n], tokens), target, at)
                piece = (length - n, key, start + n, ids[n:], tokens)
                room, at, left = room - n, at + n, left - n
        if target is not None and room and target != source:
            gaps[target] = room

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(documents: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", batch_tokens: int = 2_000_000) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `batch_tokens` bounds the left-over ids that a task holds. `size` must be a power of two.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        packer, held, kind = Packer(size, TaskContext.get().partitionId() << 36), 0, None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, texts in pieces(batch.column(1)):
                ids, before = known.encode(texts)
                ids = np.insert(ids, before[1:], end_id).astype("<u4")
                before = before + np.arange(len(before))
                for k, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    packer.add(key, ids[before[k] : before[k + 1]])
                held += int(((before[1:] - before[:-1]) % size).sum())
                if held > batch_tokens:
                    packer.settle()
                    packer.place()
                    held = 0
                if packer.rows:
                    yield table(packer.drain(), kind)
        packer.settle()
        packer.place()
        packer.finish()
        if packer.rows:
            yield table(packer.drain(), kind)

    kind = documents.schema[id_column].dataType.simpleString()
    out = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tidy(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
