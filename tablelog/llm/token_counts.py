"""Token counts of whole documents by overlap resynchronisation.

Every document is encoded by the library that its tokenizer file belongs to, in
chunks of `chunk` characters; one that fits a single chunk needs no more. The
chunks of a longer one overlap and are encoded with offsets. Two neighbouring
encodings are spliced at the last boundary that both have inside the overlap
and that is proven stable (a visible character before it, ASCII white space
after it: no pre-token runs across, none behind it looks back). Where the
overlap has no such boundary it is widened, at most to the whole chunk, and
then the chunk itself grows.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id
stays null; repeated rows give repeated results; an empty table gives an empty
one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.textbuf import tidy
from tablelog.llm.units import library, pieces

#: A place that may be proven stable: visible before, ASCII white space behind.
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n\r\x0b\x0c]")


def _token_at(encoding, at: int) -> int | None:
    """The number of the token that starts at character `at`, if one does."""
    k = encoding.char_to_token(at)
    return k if k is not None and encoding.token_to_chars(k)[0] == at else None


def spliced_count(tokenizer, text: str, chunk: int = 8192, overlap: int = 256) -> int:
    """The token count of `text` from overlapping chunks.

    `held` encodes the text from `begin` to `end`; `total` counts the tokens
    before its token `seen`, which starts where the last splice was.
    """

    def encode(a: int, b: int):
        return tokenizer.encode(text[a:b], add_special_tokens=False)

    n, total, done, begin, seen = len(text), 0, 0, 0, 0
    end = min(n, chunk)
    held = encode(0, end)
    while end < n:
        width = overlap
        while True:
            low, after = max(done, end - width), min(n, end + chunk)
            following = encode(low, after)
            spot = None
            for m in reversed([m.start() for m in _STABLE.finditer(text, low + 1, end)]):
                mine, its = _token_at(held, m - begin), _token_at(following, m - low)
                if mine is not None and its is not None:
                    spot = m
                    break
            if spot is not None or low == done:
                break
            width *= 2
        if spot is None:  # no boundary in all that is left of the chunk: the longer encoding replaces it
            held, begin, seen, end = following, low, 0, after
            chunk *= 2
            continue
        total += mine - seen
        held, begin, seen, done, end = following, low, its, spot, after
    return total + len(held.ids) - seen


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(tokenizer)
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                n_bytes = np.asarray(pc.binary_length(texts.fill_null("")), np.int64)
                unlike = pc.dictionary_encode(texts.fill_null(""))  # equal texts of a batch are counted once
                each, at = unlike.dictionary.to_pylist(), np.asarray(unlike.indices)
                count = np.zeros(len(each), np.int64)
                whole = [k for k, t in enumerate(each) if len(t) <= chunk]
                count[whole] = [len(e) for e in known.encode_batch_fast([each[k] for k in whole], add_special_tokens=False)]
                for k, t in enumerate(each):
                    if len(t) > chunk:
                        count[k] = spliced_count(known, t, chunk, overlap)
                tokens = count[at]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema[id_column].dataType.simpleString()
    out = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_column)
