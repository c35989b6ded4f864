"""Quality rules: base counts of each text, and a learned decision list over them.

The list is learned by sequential covering: each rule starts empty, grows by
the threshold that gains most information on two thirds of the rows, and is
pruned from its end on the other third; the rows it covers then leave. Rules
say "reject"; what no rule covers is kept. The list is emitted as one ordered
Spark conditional expression over the statistics.

Defined results: a null or empty text has zero counts and fails the base; a
null id stays null; repeated rows give repeated results; an empty table gives
an empty one; without labelled rows of both classes the list is empty, and only
the base rejects; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelog.llm.labelled import labelled_rows
from tablelog.llm.textbuf import WHITE, slices, span_hashes, text_buffer, tidy, window_hashes, words

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_distinct", "n_bytes"]
#: The statistics that rules may test, each an expression over the counts.
STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]
    return np.diff(total)


def count_batch(column: pa.Array) -> list[np.ndarray]:
    """The COUNTS of every text of a batch."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    starts, ends, before = words(data, offsets)
    n_words = np.diff(before)
    whole = np.append(data, np.uint8(10))  # so that the last text has an end
    visible = ~WHITE[whole[:-1]] & ((whole[:-1] & 0xC0) != 0x80)
    # lines with a word, equal to an earlier one of the same text
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (line_end > line_start) * (data[np.maximum(line_end - 1, 0)] == 10) if len(line_start) else line_end[:0]
    doc = np.searchsorted(offsets, line_start, "right") - 1
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    lh = span_hashes(data, line_start[filled], line_end[filled]) if filled.any() else np.zeros(0, np.uint64)
    doc = doc[filled]
    key = lh ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(key, return_index=True)
    n_dup = np.bincount(doc, minlength=n) - np.bincount(doc[one], minlength=n)
    # words inside 8-word windows that the text has twice or more
    h = span_hashes(data, starts, ends)
    wdoc = np.repeat(np.arange(n), n_words)
    salt = wdoc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, one = np.unique(h ^ salt, return_index=True)
    n_distinct = np.bincount(wdoc[one], minlength=n)
    repeated = np.zeros(len(h), np.int64)
    if len(h) >= 8:
        w = window_hashes(h, 8) ^ salt[: len(h) - 7]
        inside = wdoc[: len(h) - 7] == wdoc[7:]
        at = np.flatnonzero(inside)
        _, back, times = np.unique(w[at], return_inverse=True, return_counts=True)
        first = at[times[back] > 1]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + 8, -1)
        repeated = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    n_repeat = np.bincount(wdoc[repeated > 0], minlength=n)
    upper = (data >= 65) & (data <= 90)
    return [n_words, _sums(visible, offsets), _sums(_SYMBOL[data], offsets), n_dup, n_repeat, _sums(upper, offsets), _sums(data == 33, offsets), n_distinct, np.diff(offsets)]


def count_texts(documents: DataFrame, id_column: str = "id", text_column: str = "text", carry: list[str] = ()) -> DataFrame:
    """Per row: id, the carried columns and COUNTS (all long)."""
    kept = [id_column, *carry]
    names = [*(f"c{k}" for k in range(len(kept))), *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts, 1 << 20):
                own = [batch.column(k).slice(a, b - a) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in count_batch(texts.slice(a, b - a)))], names=names)

    source = documents.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(kept)), F.col(text_column).alias("t"))
    kinds = [f"c{k} {documents.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)]
    out = source.mapInArrow(tidy(run), ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *COUNTS)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_at_least, threshold): such rows are rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, high, at in self.tests:
            hit &= x[name] >= at if high else x[name] < at
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for name, high, at in self.tests:
            c = F.expr(STATISTICS[name])
            out = out & ((c >= F.lit(at)) if high else (c < F.lit(at)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if h else '<'} {t:g}" for n, h, t in self.tests)


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, most_rules: int = 12, most_tests: int = 3, least_precision: float = 0.9) -> list[Rule]:
    """Sequential covering. `bad` marks rows to reject, `part` the rows to prune on."""
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    cuts = {k: _cuts(v) for k, v in x.items()}
    while len(rules) < most_rules and (bad & left & ~part).sum() >= 3:
        grow = left & ~part
        rule = Rule(())
        covered = grow.copy()
        while len(rule.tests) < most_tests and (covered & ~bad).any():
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            best, gain = None, 1e-9
            for name, values in x.items():
                v, y = values[covered], bad[covered]
                order = np.argsort(v, kind="stable")
                pos = np.concatenate([[0], np.cumsum(y[order])])
                place = np.searchsorted(v[order], cuts[name], "left")
                for high in (True, False):
                    p = p0 - pos[place] if high else pos[place]
                    t = len(v) - place if high else place
                    with np.errstate(all="ignore"):
                        g = p * (np.log2(p / t) - np.log2(p0 / (p0 + n0)))
                    g = np.where((p > 0) & (t > 0), g, 0)
                    k = int(np.argmax(g)) if len(g) else 0
                    if len(g) and g[k] > gain:
                        best, gain = (name, high, float(cuts[name][k])), g[k]
            if best is None:
                break
            rule = Rule((*rule.tests, best))
            covered = grow & rule.covers(x)
        prune = left & part
        worth = {}
        for k in range(1, len(rule.tests) + 1):
            hit = prune & Rule(rule.tests[:k]).covers(x)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth[k] = (p - n) / (p + n) if p + n else -1.0
        if not worth:
            break
        keep = max(worth, key=lambda k: (worth[k], -k))
        rule = Rule(rule.tests[:keep])
        hit = left & rule.covers(x)
        if not hit.any() or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _cuts(v: np.ndarray, most: int = 200) -> np.ndarray:
    """Candidate thresholds: midpoints between neighbouring values, at most about `most`, spread by rank and by value."""
    u = np.unique(v)
    if len(u) < 2:
        return np.zeros(0)
    mid = (u[1:] + u[:-1]) / 2
    if len(mid) <= most:
        return mid
    by_rank = mid[np.linspace(0, len(mid) - 1, most // 2).astype(int)]
    by_value = mid[np.minimum(np.searchsorted(mid, np.linspace(mid[0], mid[-1], most // 2)), len(mid) - 1)]
    return np.unique(np.concatenate([by_rank, by_value]))


def with_statistics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *(F.expr(e).alias(k) for k, e in STATISTICS.items()))


def fit_rules(documents: DataFrame, labels: DataFrame, per_class: int = 6000, id_column: str = "doc_id", text_column: str = "text") -> list[Rule]:
    """The decision list from a bounded sample: at most 2 * `per_class` labelled rows of a class."""
    rows = with_statistics(count_texts(labelled_rows(documents, labels, "quality", per_class, None, id_column, text_column), "id", "text", ["y"])).select("id", "y", *STATISTICS).toPandas()
    bad = (rows["y"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    part = (rows["id"].astype(str).map(hash_text) % 3 == 0).to_numpy()
    return learn_list({k: rows[k].to_numpy(float) for k in STATISTICS}, bad, part)


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(f"part {s}".encode())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false where a rule rejects, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(documents: DataFrame, rules: list[Rule], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_failed and kept."""
    counts = count_texts(documents, id_column, text_column)
    return counts.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(documents: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, that judge() keeps; nothing is shuffled."""
    named = documents.columns
    inner = documents.select(*(F.col(c).alias(f"own_{k}") for k, c in enumerate(named)))
    counted = count_texts(inner, inner.columns[0], f"own_{named.index(text_column)}", inner.columns[1:])
    kept = counted.where(~base_failed() & verdict(rules))
    return kept.select(*(F.col(f"own_{k}").alias(c) for k, c in enumerate(named)))
