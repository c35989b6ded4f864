"""Text quality by a byte-level convolutional network in numpy.

Every byte has a learned input vector. Filters of `WIDTH` bytes run over
overlapping chunks that together cover the whole text, each chunk is max-pooled
per filter, and one logistic unit combines the maximum and the mean over chunks
into the probability of label 1. Gradients run through the max-pooling to the
winning positions only. A score depends on nothing but its text.

Defined results: a null or empty text is one chunk of padding and gets that
chunk's score; a null id stays null; repeated rows give repeated results; an
empty table gives an empty one; without labelled rows of both classes every
score is the share of label 1 in the sample (1 without any); further columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.labelled import labelled_rows
from tablelog.llm.textbuf import slices, text_buffer, tidy

WIDTH, FILTERS, CHANNELS, CHUNK = 8, 16, 8, 256
STRIDE = 224  # from chunk to chunk: neighbours share 32 bytes
SYMBOLS, PADDING = 257, 256  # bytes, and what stands behind a text


@dataclass
class Layout:
    """Texts laid out one after another, each with padding behind it."""

    symbols: np.ndarray
    chunk_start: np.ndarray  # into the positions of the convolution
    chunk_end: np.ndarray  # windows begin before it, and so inside their own text
    chunk_text: np.ndarray
    n_texts: int


def lay_out(column: pa.Array) -> Layout:
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    room = np.maximum(lengths, 1) + WIDTH - 1
    start = np.cumsum(room) - room
    out = np.full(int(room.sum()) + 1, PADDING, np.int32)
    place = np.arange(len(data)) + np.repeat(start - offsets[:-1], lengths)
    out[place] = data
    chunks = 1 + -(-np.maximum(lengths - CHUNK, 0) // STRIDE)
    text = np.repeat(np.arange(n), chunks)
    first = np.cumsum(chunks) - chunks
    begin = start[text] + (np.arange(len(text)) - first[text]) * STRIDE
    return Layout(out, begin, np.minimum(begin + CHUNK, (start + np.maximum(lengths, 1))[text]), text, n)


def chunk_maxima(responses: np.ndarray, lay: Layout) -> np.ndarray:
    """[chunks, FILTERS]: the largest response inside each chunk."""
    edges = np.stack([lay.chunk_start, lay.chunk_end], 1).ravel()
    return np.maximum.reduceat(responses, edges, axis=1)[:, ::2].T


@dataclass
class Network:
    embed: np.ndarray  # [SYMBOLS, CHANNELS]
    kernel: np.ndarray  # [WIDTH, CHANNELS, FILTERS]
    shift: np.ndarray  # [FILTERS]
    head: np.ndarray  # [2 * FILTERS]
    bias: float
    constant: float | None = None

    def tables(self) -> np.ndarray:
        """[WIDTH, FILTERS, SYMBOLS]: per place in the window and symbol, what it adds to each filter."""
        return np.einsum("sc,wcf->wfs", self.embed, self.kernel).astype(np.float32)

    def respond(self, lay: Layout, tables: np.ndarray) -> np.ndarray:
        """[FILTERS, positions]: the convolution."""
        n = len(lay.symbols) - WIDTH + 1
        at = lay.symbols.astype(np.intp)
        out, part = np.empty((FILTERS, n), np.float32), np.empty(n, np.float32)
        for f in range(FILTERS):
            tables[0, f].take(at[:n], 0, out[f], "clip")
            for k in range(1, WIDTH):
                tables[k, f].take(at[k : k + n], 0, part, "clip")
                out[f] += part
        return out

    def pool(self, lay: Layout, tables: np.ndarray) -> np.ndarray:
        """[chunks, FILTERS]: the maximum, rectified."""
        return np.maximum(chunk_maxima(self.respond(lay, tables), lay) + self.shift, 0)

    def combine(self, pooled: np.ndarray, lay: Layout) -> np.ndarray:
        """[texts, 2 * FILTERS]: maximum and mean over the chunks of each text."""
        first = np.flatnonzero(np.diff(lay.chunk_text, prepend=-1))
        count = np.bincount(lay.chunk_text, minlength=lay.n_texts)[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / count], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        if not len(column):
            return np.zeros(0)
        lay = lay_out(column)
        z = self.combine(self.pool(lay, self.cached()), lay) @ self.head + self.bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def cached(self) -> np.ndarray:
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
        return self._tables


def gradients(net: Network, column: pa.Array, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log-loss, by every parameter; the pooling passes them to the winning positions."""
    lay = lay_out(column)
    r = net.respond(lay, net.tables())
    top = chunk_maxima(r, lay)
    size = lay.chunk_end - lay.chunk_start
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(owner)) + np.repeat(lay.chunk_start - (np.cumsum(size) - size), size)
    where = np.zeros(top.shape, np.int64)
    for f in range(FILTERS):
        hit = np.flatnonzero(r[f, place] == top[owner, f])[::-1]  # of equal positions the first wins
        where[owner[hit], f] = place[hit]
    pooled = np.maximum(top + net.shift, 0)
    x = net.combine(pooled, lay)
    dz = (1 / (1 + np.exp(-(x @ net.head + net.bias))) - y) * weight / len(y)
    dx = dz[:, None] * net.head
    count = np.bincount(lay.chunk_text, minlength=lay.n_texts)
    is_top = pooled == x[lay.chunk_text, :FILTERS]
    ties = np.zeros((lay.n_texts, FILTERS))
    np.add.at(ties, lay.chunk_text, is_top)
    dp = is_top * (dx[:, :FILTERS] / np.maximum(ties, 1))[lay.chunk_text] + (dx[:, FILTERS:] / count[:, None])[lay.chunk_text]
    dp *= pooled > 0
    d_table = np.zeros((WIDTH, SYMBOLS, FILTERS))
    fs = np.broadcast_to(np.arange(FILTERS), where.shape)
    for w in range(WIDTH):
        np.add.at(d_table[w], (lay.symbols[where + w], fs), dp)
    return {"embed": np.einsum("wsf,wcf->sc", d_table, net.kernel), "kernel": np.einsum("wsf,sc->wcf", d_table, net.embed), "shift": dp.sum(0), "head": x.T @ dz, "bias": dz.sum()}


def fit(texts: list[str], y: np.ndarray, epochs: int = 14, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the log-likelihood, classes weighted alike; each epoch sees every text of the sample whole."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (SYMBOLS, CHANNELS)), rng.normal(0, 0.3, (WIDTH, CHANNELS, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 1.0
        return net
    net.head = np.where(np.arange(2 * FILTERS) % 2, 0.3, -0.3) / FILTERS
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    moment: dict[str, list] = {}
    column, t = pa.array(texts, pa.string()), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick, t = order[k : k + batch], t + 1
            for name, g in gradients(net, column.take(pa.array(pick)), y[pick], weight[pick]).items():
                g = g + 1e-4 * net.head if name == "head" else g
                m, v = moment.get(name, (0.0, 0.0))
                moment[name] = m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
                setattr(net, name, getattr(net, name) - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
    net.shift, net.head, net.bias = net.shift.astype(np.float32), net.head.astype(np.float32), float(net.bias)
    return net


def train(documents: DataFrame, labels: DataFrame, per_class: int = 600, most_bytes: int = 8192, id_column: str = "doc_id", text_column: str = "text") -> Network:
    """Fit on a bounded sample: about `per_class` labelled rows a class outside the held-out fold, texts of `most_bytes` at most; equal texts count once."""
    rows = labelled_rows(documents, labels, "quality", per_class, most_bytes, id_column, text_column).orderBy("id").toPandas()
    rows = rows.drop_duplicates("text")
    return fit(rows["text"].tolist(), rows["y"].to_numpy(np.float64))


def score_texts(documents: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, score (probability of label 1) and predicted (score >= threshold)."""
    shared = documents.sparkSession.sparkContext.broadcast(net)  # some 150 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 18):
                score = net.score(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = documents.schema[id_column].dataType.simpleString()
    out = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tidy(run), f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_column)
