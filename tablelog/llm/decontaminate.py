"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are normalised alike: A-Z lower-cased, every run of ASCII
characters other than letters and digits one space. An item may occur with up
to `error_rate` of its length in edits. It is split into one piece more than
that budget, so any such occurrence holds some piece exactly; an Aho-Corasick
automaton finds all pieces, and each hit is verified by Myers' bit-parallel
edit distance over the window around it. An item so short that it has no budget
must stand as whole words.

Defined results: a null or empty text has no match; an item that is empty after
normalising, or null, matches nothing; a null id stays null; repeated rows give
repeated results; repeated items are reported each; empty tables give an empty
result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.textbuf import LOWER, slices, text_buffer, tidy

_PLAIN = LOWER.copy()
_KEEP = np.zeros(256, bool)
_KEEP[0x80:] = _KEEP[0x30:0x3A] = _KEEP[0x41:0x5B] = _KEEP[0x61:0x7B] = True
_PLAIN[~_KEEP] = 0x20


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets by text, and the original place of each."""
    data, offsets = text_buffer(column)
    plain = _PLAIN[data]
    blank = plain == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(keep)
    return plain[at], np.searchsorted(at, offsets), at


def plain(text: str | None) -> bytes:
    return normalised(pa.array([text], pa.string()))[0].tobytes().strip()


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of `pattern` to any part of `text`, and where the first such part ends."""
    m = len(pattern)
    mask: dict[int, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        mask[c] |= 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = mask.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """Test items and the pieces by which they are found."""

    keys: list
    kind: pa.DataType
    texts: list[bytes]
    budgets: list[int]
    pieces: dict[str, list[tuple[int, int]]]  # piece -> (item, where it begins in the item)

    @staticmethod
    def of(rows: pa.Table, error_rate: float) -> "Items":
        """`rows` has the item's id and its text."""
        out = Items([], rows.schema.field(0).type, [], [], defaultdict(list))
        for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            p = plain(text)
            if not p:
                continue
            budget = int(len(p) * error_rate)
            cut = [len(p) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cut, cut[1:]):
                out.pieces[p[a:b].decode("latin-1")].append((len(out.keys), a))
            out.keys.append(key)
            out.texts.append(p)
            out.budgets.append(budget)
        return out

    def automaton(self):
        found = ahocorasick.Automaton()
        for piece, where in self.pieces.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found


def matches(text: bytes, items: Items, automaton) -> list[tuple[int, int, int, int]]:
    """(item, distance, start, end) of the best occurrence of each item that occurs within its budget."""
    hits: dict[int, set[int]] = defaultdict(set)
    for end, (length, where) in automaton.iter(text.decode("latin-1")):
        for item, at in where:
            hits[item].add(end + 1 - length - at)
    out = []
    for item, starts in hits.items():
        p, k = items.texts[item], items.budgets[item]
        if not k:  # every hit is the whole item
            whole = [s for s in sorted(starts) if (s == 0 or text[s - 1] == 0x20) and (s + len(p) == len(text) or text[s + len(p)] == 0x20)]
            out += [(item, 0, s, s + len(p)) for s in whole[:1]]
            continue
        best = None
        done = -1
        for s in sorted(starts):
            if s + len(p) + k <= done:  # the window before held this one
                continue
            low, high = max(0, s - k), min(len(text), s + len(p) + 2 * k)
            done = high
            if len(p) - (high - low) > k:
                continue
            distance, end = myers(p, text[low:high])
            if distance <= k and (best is None or distance < best[0]):
                tail = text[max(low, low + end - len(p) - k) : low + end]
                back = myers(p[::-1], tail[::-1])[1]
                best = (distance, low + end - back, low + end)
        if best:
            out.append((item, *best))
    return sorted(out)


def find_leaks(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", most_bytes: int = 2 << 20) -> DataFrame:
    """Per document and item that occurs in it: id, item, distance, start and end (UTF-8 bytes of the text).

    About `most_bytes` of item text are broadcast at a time, some 100 bytes of
    automaton each; more take further scans.
    """
    spark = documents.sparkSession
    id_kind, item_kind = documents.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}, distance int, start long, end long"
    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = None
    for items in _parts(benchmark, error_rate, item_column, item_text, most_bytes):
        found = source.mapInArrow(tidy(_scanner(spark.sparkContext.broadcast(items))), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def _parts(benchmark: DataFrame, error_rate: float, item_column: str, item_text: str, most_bytes: int) -> Iterator[Items]:
    """The items, about `most_bytes` of text at a time."""
    rows = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most_bytes) or 1
    for part in range(parts):
        yield Items.of(rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").toArrow(), error_rate)


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        automaton = items.automaton() if items.keys else None
        for batch in batches:
            if automaton is None:
                continue
            rows: list[tuple] = []
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                flat, before, at = normalised(texts)
                origin = text_buffer(texts)[1]
                raw = flat.tobytes()
                for k in range(b - a):
                    x, y = int(before[k]), int(before[k + 1])
                    for item, distance, s, e in matches(raw[x:y], items, automaton):
                        rows.append((a + k, items.keys[item], distance, int(at[x + s] - origin[k]), int(at[x + e - 1] + 1 - origin[k])))
            if rows:
                pick, keys, distance, start, end = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick)), pa.array(keys, items.kind), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["id", "item", "distance", "start", "end"])

    return run


def keep_clean(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", most_bytes: int = 2 << 20) -> DataFrame:
    """The rows of `documents`, all columns, in which no item occurs; nothing is shuffled.

    More than `most_bytes` of items are held against the rows in turn, in one stage.
    """
    at = documents.columns.index(text_column)
    for items in _parts(benchmark, error_rate, item_column, item_text, most_bytes):
        documents = documents.mapInArrow(tidy(_sieve(documents.sparkSession.sparkContext.broadcast(items), at)), documents.schema)
    return documents


def _sieve(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        automaton = items.automaton() if items.keys else None
        for batch in batches:
            if automaton is None:
                yield batch
                continue
            for a, b in slices(batch.column(at)):
                flat, before, _ = normalised(batch.column(at).slice(a, b - a))
                raw = flat.tobytes()
                clean = [not matches(raw[x:y], items, automaton) for x, y in zip(before[:-1].tolist(), before[1:].tolist())]
                yield batch.slice(a, b - a).filter(pa.array(clean, pa.bool_()))

    return run
