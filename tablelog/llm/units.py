"""Token ids of whole texts through units that provably tokenise alone.

A cut between a character that is not white space and white space that follows
it is a token boundary whatever stands further left, and what stands right of
it never looks back: no pre-token of the supported tokenizers runs from a
visible character into white space. So a text is the concatenation of units
"white space, then visible characters", each encoded once by the library and
remembered. The memory of encoded units is bounded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tablelog.llm.textbuf import LOWER, WHITE, slices, span_hashes, text_buffer

_ENCODERS: dict[tuple, "UnitEncoder"] = {}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Proven cuts: the starts of texts, and ASCII white space after a visible character.

    Bytes that may end a white-space character beyond ASCII count as invisible,
    unless they are continuation bytes of Latin letters (lead byte C3).
    """
    n = len(data)
    white = WHITE[data]
    odd = (data >= 0x80) & (data <= 0xAF)
    odd[1:] &= data[:-1] != 0xC3
    # control characters that some libraries take for white space
    odd |= (data >= 0x1C) & (data <= 0x1F)
    cut = np.zeros(n, bool)
    cut[1:] = white[1:] & ~white[:-1] & ~odd[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Merger:
    """The merges of a .json vocabulary run by a faster public library, for Latin text.

    Merge order is id order in these vocabularies, which is checked here, so
    ranks are ids. A word end is written as the byte 01; texts that hold it,
    special strings or other scripts go to the tokenizer of the file itself.
    """

    END = "\x01"

    def __init__(self, spec: dict, dropped: bool):
        import regex
        import tiktoken

        alphabet, model = _byte_alphabet(), spec["model"]
        end = model.get("end_of_word_suffix") or ""
        special = {t["content"] for t in spec["added_tokens"]}
        made = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("merges are not in the order of ids")
        ranks: dict[bytes, int] = {}
        for token, k in model["vocab"].items():
            if token in special:
                continue
            last = bool(end) and token.endswith(end)
            ranks[bytes(alphabet[c] for c in (token[: -len(end)] if last else token)) + (b"\x01" if last else b"")] = k
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.run = tiktoken.Encoding("units", pat_str="[^\x01]+\x01" if dropped else pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall if dropped else None

    def __call__(self, unit: str) -> list[int]:
        if self.find is None:
            return self.run(unit)
        if not unit.isascii():
            unit = "".join(c.lower() for c in unicodedata.normalize("NFC", unit))
        found = self.find(unit.lower() if unit.isascii() else unit)
        return self.run(self.END.join(found) + self.END) if found else []


_OTHER = re.compile("[<\x01\u0250-\U0010ffff]")


class UnitEncoder:
    """Encodes batches of texts with a tokenizers .json; one per worker process.

    Units are remembered under a 64-bit hash in an open-addressing table of
    numpy arrays, at most `keep` of them; a full memory starts afresh.
    """

    def __init__(self, path: str, spec: dict, dropped: bool, keep: int):
        self.tokenizer = library(path)
        self.merger = _Merger(spec, dropped)
        self.lower, self.keep = dropped, keep
        self._forget()

    def _forget(self) -> None:
        self.bits, self.known = 18, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.length, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint16), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't known."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            got = self.keys[slot]
            hit = got == h[open_]
            out[open_[hit]] = self.place[slot[hit]]
            go = ~hit & (got != 0)
            open_, slot = open_[go], (slot[go] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)  # one hash a slot
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.place[slot[won]] = h[won], place[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, place, slot = h[left], place[left], (slot[left] + 1) & mask

    def _grow(self, name: str, n: int) -> None:
        a = getattr(self, name)
        if n > len(a):
            b = np.zeros(max(n, 2 * len(a)), a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)

    def _learn(self, h: np.ndarray, units: list[str]) -> None:
        got = [self.tokenizer.encode(u, add_special_tokens=False).ids if _OTHER.search(u) else self.merger(u) for u in units]
        n, new = self.known, np.fromiter(map(len, got), np.int64, len(got))
        self._grow("length", n + len(got))
        self.length[n : n + len(got)] = new
        flat = np.fromiter((i for g in got for i in g), np.int64, int(new.sum()))
        self._grow("first", n + len(got))
        self._grow("flat", self.used + len(flat))
        self.first[n : n + len(got)] = self.used + np.cumsum(new) - new
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known += len(got)
        if 2 * self.known > 1 << self.bits:
            used = self.keys != 0
            keys, place = self.keys[used], self.place[used]
            while 2 * self.known > 1 << self.bits:
                self.bits += 1
            self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, place)
        self._put(h, np.arange(n, self.known, dtype=np.int32))

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of every unit in the memory, and units before each text."""
        data, offsets = text_buffer(column)
        if self.lower and b"<|" not in data.tobytes():
            data = LOWER[data]  # the tokenizer lower-cases too, after it has looked for special strings
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends) | np.uint64(1 << 63)
        if self.known > self.keep:
            self._forget()
        place = self._find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = missing[one]
            n = self.known
            self._learn(new, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place[missing] = n + back
        return place, np.searchsorted(starts, offsets)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch as unsigned 32-bit, and where each text's begin."""
        place, before = self._units(column)
        each = self.length[place].astype(np.int64)
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place] - (ends - each), each)
        return self.flat[at].astype(np.uint32), np.concatenate([[0], ends])[before]


@lru_cache(maxsize=2)
def supported(path: str) -> tuple[dict, bool]:
    """The file's content, and whether it drops white space.

    Raises ValueError for a tokenizer to which the proof of the cuts does not apply.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    steps = pre.get("pretokenizers", [pre])
    byte_level = steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
    dropped = steps[0].get("type") == "Split" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
    if not (byte_level or dropped) or model["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or "<" not in t["content"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError("units are proven for byte-level and white-space-dropping BPE only")
    return spec, bool(dropped)


@lru_cache(maxsize=2)
def library(path: str):
    """The library's tokenizer of a file, whole texts and no padding; one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    supported(path)
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encoder(path: str, keep: int = 400_000) -> UnitEncoder:
    """The process-wide encoder of a file; `keep` bounds the units it remembers."""
    if (path, keep) not in _ENCODERS:
        spec, dropped = supported(path)
        if max(spec["model"]["vocab"].values()) > 65535:
            raise ValueError("ids of more than 16 bits")
        _ENCODERS[path, keep] = UnitEncoder(path, spec, dropped, keep)
        supported.cache_clear()
    return _ENCODERS[path, keep]


def pieces(column: pa.Array, limit: int = 1 << 20):
    """The batch in runs of rows of about `limit` bytes."""
    for a, b in slices(column, limit):
        yield a, b, column.slice(a, b - a)
