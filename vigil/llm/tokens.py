"""Ids of whole texts under the public word tokenizer, part by part.

The tokenizer lower-cases, drops white space and encodes each run of letters,
each digit and each run of other signs by itself.  A text can therefore be cut
at white space and between a letter and a sign.  The different parts of a batch
of texts are found first and each is looked up once, in a cache that a Python
worker keeps between its tasks; the unknown ones are encoded together.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes that the cache of one worker may hold
CACHE_BYTES = 64_000_000
#: places that mark which parts were met before; a part is cached when it comes again
MET = 1 << 22
_ENTRY = 170        # bytes of two small objects and their place in a dict
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
# the bytes of texts whose full stops and commas can be cut off without a pattern
_SIMPLE = bytes(range(0x80, 0xC0)) + b"\xc3abcdefghijklmnopqrstuvwxyz0123456789 .,'-"
# what must not come before a full stop or comma there: a space or a sign (the
# last byte of a multiplication or division sign is enough)
_BEFORE = re.compile(rb"[ .,'\-\x97\xb7][.,]")
# a letter and the sign after it, which is never part of a contraction
_WORD_SIGN = re.compile(rb"([a-z])([!-&(-/:-@\[-`{-~])")
_WORD = re.compile("[a-zß-öø-ÿ]+")
# byte-level vocabularies write bytes that do not print as the signs from 256 on
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(
    x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))}


def _values(column: pa.LargeStringArray) -> list[bytes]:
    """The bytes of each string of a column without nulls."""
    if not len(column):
        return []
    _, ends, data = column.buffers()
    raw = data.to_pybytes() if data else b""
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


class WordIds:
    """``encode(texts)``: for each text its ids as little-endian unsigned
    32-bit integers.  None is the empty text."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.whole.model            # for lower-case words, which need no other step
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)          # words come here once
        self.limit = cache_bytes
        self.new: dict[bytes, bytes] = {}
        self.size = 0
        self.met, self.marks = bytearray(MET), 0

    @staticmethod
    def spaced(text: str) -> bytes:
        """The text with spaces around parts whose ids are those of the text
        when put in a row."""
        raw = text.encode("utf-8", "replace").lower().translate(_SPACES)
        if raw.translate(None, _SIMPLE) or raw[:1] in (b".", b",") or _BEFORE.search(raw):
            raw = _WORD_SIGN.sub(rb"\1 \2", raw)
        else:
            raw = raw.replace(b". ", b" . ").replace(b", ", b" , ")
        return raw

    @staticmethod
    def parts(text: str) -> list[bytes]:
        """These parts."""
        return WordIds.spaced(text).split()

    def _fresh(self, missed: list[bytes]) -> dict[bytes, bytes]:
        out, other, tokenize = {}, [], self.model.tokenize
        for p in missed:
            if p.isalpha():   # of ASCII letters
                out[p] = array("I", [t.id for t in tokenize(p.decode("ascii"))]).tobytes()
            elif _WORD.fullmatch(s := p.decode("utf-8")):
                signs = p.decode("latin-1").translate(_BYTE_SIGNS)
                out[p] = array("I", [t.id for t in tokenize(signs)]).tobytes()
            else:
                other.append((p, s))
        for i in range(0, len(other), 1000):
            some = other[i:i + 1000]
            for (p, _), e in zip(some, self.whole.encode_batch_fast([s for _, s in some], add_special_tokens=False)):
                out[p] = array("I", e.ids).tobytes()
        return out

    def _met(self, parts: Iterable[bytes]) -> list[bytes]:
        """The parts that were met in an earlier batch.  (By chance rarely others.)"""
        met, n = self.met, len(self.met)
        out = []
        for p in parts:
            at = hash(p) % n
            if met[at]:
                out.append(p)
            else:
                met[at] = 1
                self.marks += 1
        if self.marks > n // 4:
            self.met, self.marks = bytearray(n), 0
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        spaced = [self.spaced(t) if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, spaced)])
        column = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(spaced)))
        pool = pa.system_memory_pool()   # gives back what a batch took
        cut = pc.ascii_split_whitespace(column, memory_pool=pool)
        parts = pc.dictionary_encode(cut.flatten(), memory_pool=pool)
        # an empty part before leading and after trailing space has no ids
        ids = self._look_up(_values(parts.dictionary))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = parts.indices.to_numpy()
        n = lengths[at]
        last = np.cumsum(n)
        # an id's place among those of the different parts
        places = np.repeat((np.cumsum(lengths) - lengths)[at] - last + n, n)
        places += np.arange(len(places))
        flat = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        borders = 4 * np.r_[0, last][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different parts."""
        new = self.new
        ids = list(map(new.get, parts))
        missed = [p for p, x in zip(parts, ids) if x is None]
        if missed:
            fresh = self._fresh(missed)
            ids = [fresh[p] if x is None else x for p, x in zip(parts, ids)]
            again = {p: fresh[p] for p in self._met(missed)}
            new.update(again)
            self.size += sum(map(len, again)) + sum(map(len, again.values())) + _ENTRY * len(again)
            if self.size > self.limit:   # the later half goes: frequent parts come early
                self.new = dict(islice(new.items(), len(new) // 2))
                self.size //= 2
        return ids


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker for the tokenizer file at ``path``."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
