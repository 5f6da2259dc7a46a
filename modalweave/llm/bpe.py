"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the table stores the one token that ends the BPE
encoding of that prefix. A token ``t`` that covers bytes i..j is that token
exactly if the last token of the prefix up to i may stand before ``t``, so a
prefix costs a few dictionary look-ups, whatever the length of the piece, and
the table of a piece stays valid when bytes are appended.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_document, pick

#: Pieces and token pairs a task remembers before it starts anew.
MEMO = 1 << 20
#: Bytes of a prefix that pieces share at most.
SHARED_BYTES = 24


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """The tokens of pieces seen before; a new one is encoded when it is asked for."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.codec.piece(text)
        if len(self) >= MEMO:
            self.clear()
        if len(text) <= 64:
            self[text] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary; ``pattern`` cuts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = regex.compile(pattern).findall
        self.find = regex.compile(pattern).finditer
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shared: dict[bytes, int] = {}
        self._memo = _Pieces(self)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                joined = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 40) for a, b in zip(parts, parts[1:])]
                at = joined.index(min(joined))
                parts[at : at + 2] = [joined[at]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` apart when they are neighbours.

        Walk back through the merges that made the two tokens, latest first. At
        every step a merge across the border must not have had precedence over
        the merge just undone; on equal ranks the leftmost pair goes first.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        if len(self._fits) >= MEMO:
            self._fits.clear()
        a, b, before, answer = left, right, 1 << 40, True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < before:
                answer = False
                break
            cut_a, cut_b = self.halves(a), self.halves(b)
            if cut_a is None and cut_b is None:
                break
            if cut_b is None or (cut_a is not None and a > b):
                before, a = a, cut_a[1]
            else:
                before, b = b + 1, cut_b[0]
        self._fits[left, right] = answer
        return answer

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding of data[:end], given the last tokens of the shorter prefixes."""
        for start in range(max(0, end - self.longest), end):
            token = self.ranks.get(data[start:end])
            if token is not None and (start == 0 or self.fits(last[start - 1], token)):
                return token
        raise ValueError("a byte is missing from the vocabulary")

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (the last token of each non-empty prefix) up to the end of ``data``.

        Pieces with a common beginning share its entries: a prefix has one last
        token, whatever follows.
        """
        shared = self._shared
        for end in range(len(last) + 1, len(data) + 1):
            prefix = data[:end] if end <= SHARED_BYTES else None
            token = shared.get(prefix)
            if token is None:
                token = self.last_token(data, end, last)
                if prefix is not None:
                    if len(shared) >= MEMO:
                        shared.clear()
                    shared[prefix] = token
            last.append(token)
        return last

    def read(self, last: list[int]) -> tuple[int, ...]:
        """The tokens of the whole piece, from its last one backwards."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.read(self.extend(data, []))

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self._memo.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids, which need not form whole characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Buffer:
    """A text under edit with its encoding: only the pieces near a change are encoded again."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.encoded_bytes = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[start:end] (code points)."""
        from bisect import bisect_right

        old_starts, old_tables, old_text = self.starts, self.tables, self.text
        self.text = old_text[:start] + new + old_text[end:]
        # a piece depends on its own text and on the one character after it
        first = max(0, bisect_right(old_starts, start) - 1)
        while first and old_starts[first] >= max(0, start - 1):
            first -= 1
        shift = len(new) - (end - start)
        kept = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        starts, tables = old_starts[:first], old_tables[:first]
        for m in self.codec.find(self.text, old_starts[first] if first < len(old_starts) else 0):
            at = m.start()
            if at in kept and at > start + len(new):
                tail = kept[at]
                starts += [s + shift for s in old_starts[tail:]]
                tables += old_tables[tail:]
                break
            data, table = m.group().encode(), []
            if len(starts) < len(old_starts) and old_starts[len(starts)] == at:  # same start: shared prefix stays valid
                i = len(starts)
                stop = old_starts[i + 1] if i + 1 < len(old_starts) else len(old_text)
                before, same = old_text[at:stop].encode(), 0
                while same < min(len(before), len(data)) and before[same] == data[same]:
                    same += 1
                table = old_tables[i][:same]
            self.encoded_bytes += len(data) - len(table)
            starts.append(at)
            tables.append(self.codec.extend(data, table))
        self.starts, self.tables = starts, tables

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.codec.read(table)]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value.

    A null or empty text has no ids; repeated rows and null ids of documents
    stay; columns other than doc_id and text are not read. Special tokens of
    other tools are ordinary text. ``vocabulary`` is a rank file that every
    executor can open.
    """

    def row():
        codec = Codec(load_ranks(vocabulary), pattern)

        def one(text):
            ids = codec.encode(text)
            if ids.itemsize != 4 or __import__("sys").byteorder != "little":
                import numpy as np

                return (np.asarray(ids, dtype="<u4").tobytes(),)
            return (ids.tobytes(),)

        return one

    return per_document(documents(docs), "ids binary", row)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for; null ids give no bytes."""
    pairs = pick(encoded, "doc_id", "ids").select("doc_id", F.col("ids").alias("text"))

    def row():
        import numpy as np

        codec = Codec(load_ranks(vocabulary), "")
        return lambda ids: (codec.decode(np.frombuffer(ids or b"", dtype="<u4").tolist()),)

    return per_document(pairs, "data binary", row)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): encode, then decode what was encoded, in one pass over the documents."""
    encoded = encode(docs, vocabulary, pattern)

    def row():
        import numpy as np

        codec = Codec(load_ranks(vocabulary), "")
        return lambda ids: (ids, codec.decode(np.frombuffer(ids, dtype="<u4").tolist()))

    return per_document(encoded.withColumnRenamed("ids", "text"), "ids binary, data binary", row)
