"""Token counts by prefix dynamic programming.

For every byte prefix of a piece a table holds the number of tokens of its BPE
encoding and the token that ends it. The count of a prefix is one more than the
count of the prefix before its last token, so one pass over a piece answers how
many tokens any beginning of it has; prefix sums over the pieces carry this to
the whole text. Truncation and budget questions read the tables.

The vocabulary is a byte-level BPE file of the tokenizers library (vocab and an
ordered list of merges); special tokens of the file are matched in the text, as
the library does by default.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import documents, per_document

#: Pieces and token pairs a task remembers before it starts anew.
MEMO = 1 << 19
#: A piece of more characters is counted anew each time it occurs.
LONG = 48
#: Pieces of at most so many characters may be split anew when they are cut (contractions).
SHORT = 3
#: Rank of a whole token: no merge takes it any further.
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for a byte: itself if it is printable Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        pre, model = held["pre_tokenizer"], held["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or held["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        letter = byte_letters()
        self.bytes_of = {i: bytes(letter[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        #: (left, right) -> (rank of the merge, token made)
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (model["vocab"][p] for p in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.merges[left, right] = rank
            self.parts.setdefault(whole, (left, right, rank))
        self.special = {a["content"]: a["id"] for a in held["added_tokens"]}


class _Pieces(dict):
    """Piece -> its tokens; a piece not seen before is counted when it is asked for."""

    def __init__(self, table):
        super().__init__()
        self.table = table

    def __missing__(self, text: str) -> int:
        count = self.table(text.encode())[-1]
        if len(text) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[text] = count
        return count


class TokenCounter:
    """Counts tokens of texts under one vocabulary; ``pattern`` cuts a text into pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import ahocorasick
        import regex

        self.words = vocabulary
        self.split = regex.compile(pattern).finditer
        self.cut = regex.compile(pattern).findall
        self.marks = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.table)
        # every token that ends at a byte, read off in one walk over the bytes
        self.ends = ahocorasick.Automaton()
        for token, data in vocabulary.bytes_of.items():
            if self.whole(token):
                self.ends.add_word(data.decode("latin-1"), (token, len(data)))
        self.ends.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at its left (0) or right (1) edge, bytes first, each with the rank of the merge that uses it up."""
        known = self._spines.get((token, side))
        if known is None:
            known, at, until = [], token, NEVER
            while at is not None:
                known.append((at, until))
                made = self.words.parts.get(at)
                at, until = (made[side], made[2]) if made else (None, until)
            known.reverse()
            self._spines[token, side] = known
        return known

    def crossed(self, left: int, right: int, limit: int) -> bool:
        """Whether a merge of a rank under ``limit`` joins the neighbours' edges while both grow.

        Both edges grow in order of merge ranks; at equal ranks the merge
        further left goes first.
        """
        a, b, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.words.merges.get((x, y))
            if rank is not None and rank < limit and rank < x_until and rank <= y_until:
                return True
            if x_until == NEVER and y_until == NEVER:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether BPE makes this token from its own bytes."""
        made = self.words.parts.get(token)
        if made is None:
            return len(self.words.bytes_of[token]) == 1
        left, right, rank = made
        return not self.crossed(left, right, rank) and self.whole(left) and self.whole(right)

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two tokens apart when they are neighbours; remembered."""
        if len(self._apart) >= MEMO:
            self._apart.clear()
        known = self._apart[left, right] = not self.crossed(left, right, NEVER)
        return known

    def table(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ..., data."""
        counts, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        known, apart, done = self._apart.get, self.apart, -1
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            if end == done:
                continue  # a prefix has one encoding, so one token fits
            before = end + 1 - size
            if before:
                fits = known((last[before], token))
                if fits is None:
                    fits = apart(last[before], token)
                if not fits:
                    continue
            done = end
            counts[end + 1], last[end + 1] = counts[before] + 1, token
        return counts

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        return sum(map(self.pieces.__getitem__, self.cut(text)))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total, at = 0, 0
        for m in self.marks.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:] if at else text)


class Prefixes:
    """The token count of every prefix of one text, by code points.

    A prefix is judged as a text of its own: white space at its end, a
    contraction or a special token cut short are split as they then would be.
    All else is read from the tables.
    """

    def __init__(self, counter: TokenCounter, text: str):
        self.counter, self.text = counter, text
        #: start of each piece, and whether it is a special token
        self.starts: list[int] = []
        self.marked: list[bool] = []
        sizes, at = [], 0
        for m in [*counter.marks.finditer(text), None]:
            stop = m.start() if m else len(text)
            for p in counter.split(text[at:stop]):
                self.starts.append(at + p.start())
                self.marked.append(False)
                sizes.append(counter.pieces[p.group()])
            if m:
                self.starts.append(stop)
                self.marked.append(True)
                sizes.append(1)
                at = m.end()
        #: tokens before each piece, and in all
        self.before = list(accumulate(sizes, initial=0))
        self._tables: dict[int, list[int]] = {}

    @property
    def total(self) -> int:
        return self.before[-1]

    def stop(self, i: int) -> int:
        return self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)

    def at(self, end: int) -> int:
        """Tokens of text[:end], encoded by itself."""
        if end <= 0 or not self.text:
            return 0
        end = min(end, len(self.text))
        i = bisect_left(self.starts, end) - 1  # the piece of the last character
        start, stop = self.starts[i], self.stop(i)
        if end == stop and (self.marked[i] or not self.text[start:end].isspace()):
            return self.before[i + 1]
        if not self.marked[i] and not self.text[start:end].isspace():
            if stop - start > SHORT or len(self.counter.cut(self.text[start:end])) == 1:
                return self.before[i] + self.table(i)[end - start]
            return self.before[i] + self.counter.plain(self.text[start:end])
        # what was cut joins white space before it, a special token cut short also the piece before it
        first = i - 1 if self.marked[i] and i and not self.marked[i - 1] else i
        while first and not self.marked[first - 1] and self.text[self.starts[first] : self.stop(first)].isspace():
            if not self.text[self.starts[first - 1] : self.starts[first]].isspace():
                break
            first -= 1
        if not self.marked[i] and first and not self.marked[first - 1] and self.text[self.starts[first - 1] : self.starts[first]].isspace():
            first -= 1
        return self.before[first] + self.counter.plain(self.text[self.starts[first] : end])

    def table(self, i: int) -> list[int]:
        """Tokens of every prefix of a piece, by code points."""
        if i not in self._tables:
            piece = self.text[self.starts[i] : self.stop(i)]
            counts = self.counter.table(piece.encode())
            self._tables[i] = [counts[b] for b in accumulate((len(c.encode()) for c in piece), initial=0)]
        return self._tables[i]

    def longest(self, budget: int) -> int:
        """Most code points that a prefix of at most ``budget`` tokens can have.

        Counts need not grow from one prefix to the next, so every end is tried
        from the far end of the last piece that can hold such a prefix: a prefix
        that ends in a piece keeps all pieces but the three before it as they
        are, so it has their tokens at least.
        """
        if self.total <= budget:
            return len(self.text)
        i = min(bisect_right(self.before, budget) + 2, len(self.starts) - 1)
        end = self.stop(i)
        while end > 0 and self.at(end) > budget:
            end -= 1
        return end


def _counter(vocabulary: str, pattern: str) -> TokenCounter:
    return TokenCounter(Vocabulary(vocabulary), pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text.

    A null or empty text has neither bytes nor tokens; repeated rows and null
    ids stay; an empty table gives an empty result; columns other than doc_id
    and text are not read. ``vocabulary`` is a file that every executor can
    open. One pass, no shuffle.
    """

    def row():
        count = _counter(vocabulary, pattern).count
        return lambda text: (len(text.encode()), count(text))

    return per_document(documents(docs), "n_bytes bigint, n_tokens bigint", row)


def truncate(docs: DataFrame, vocabulary: str, pattern: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): the longest beginning of each text, in code points, that has at most ``budget`` tokens, and its tokens.

    Rows as in token_counts; a budget below one leaves empty texts.
    """

    def row():
        counter = _counter(vocabulary, pattern)

        def one(text):
            held = Prefixes(counter, text)
            end = held.longest(budget)
            return text[:end], held.at(end)

        return one

    return per_document(documents(docs), "text string, n_tokens bigint", row)


def counts_at(docs: DataFrame, vocabulary: str, pattern: str, ends: list[int]) -> DataFrame:
    """(doc_id, counts): the tokens of the first ``ends`` code points of each text; ends beyond the text mean all of it."""

    def row():
        counter = _counter(vocabulary, pattern)

        def one(text):
            held = Prefixes(counter, text)
            return ([held.at(e) for e in ends],)

        return one

    return per_document(documents(docs), "counts array<bigint>", row)
