"""Cross-tokenizer alignment by whitespace-token anchors.

A text is encoded whole by both tokenizers. Ends that both share right before a
token that begins with a space are anchors; they cut the two id sequences into
windows. A window's alignment depends on its ids alone, so a task works it out
once per pair of id tuples and looks it up afterwards.

How often an id pair is linked across the corpus is a second step in Spark: one
row per document carries its distinct pairs and how often it has each, pairs are
counted with partial sums, and the counts go back to the documents by a join.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents

#: Bytes of windows, and of parts of texts, that a task remembers before it starts anew, about.
MEMO = 1 << 27
#: Where texts are cut for encoding.
CUT = re.compile(r"(?<=\S)(?= )")
#: Code points handed to a tokenizer at once, about.
AT_ONCE = 1 << 18
#: Pairs that hold more than one in so many of all (document, pair) entries are joined by broadcast; there are fewer of them than this.
FREQUENT = 1 << 19
#: A pair of ids (a, b) is carried as a * ROOM + b.
ROOM = 1 << 32

ROW = "_row bigint, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for a byte: itself if it is printable Latin-1, else from U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)}
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Memory:
    """Keys to the tuples that ``make`` gives for them; new keys are made together, and beyond about MEMO bytes it starts anew."""

    def __init__(self, make):
        self.make, self.known, self.held = make, {}, 0

    def look_up(self, keys: list) -> list[tuple]:
        if self.held > MEMO:
            self.known, self.held = {}, 0
        found = list(map(self.known.get, keys))
        new = list(dict.fromkeys(k for k, v in zip(keys, found) if v is None))
        if new:
            made = self.make(new)
            self.known.update(zip(new, made))
            self.held += sum(300 + len(k) + len(v[0]) + len(v[1]) for k, v in zip(new, made))
            found = [self.known[k] if v is None else v for k, v in zip(keys, found)]
        return found


class Tokens:
    """Both tokenizers with the bytes of their tokens.

    The byte-level file is run by tiktoken: it merges by rank of the merged
    token, which is the order of the file's merges if merge k makes the k-th id
    after the bytes and each token has one merge; both are checked here.
    """

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        import numpy as np
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            held = json.load(f)
        pre, model, letter = held["pre_tokenizer"], held["model"], byte_letters()
        if pre["type"] != "ByteLevel" or held["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"].get(x + y) != k + 256 for k, (x, y) in enumerate(merges)) or len(model["vocab"]) != len(merges) + 256:
            raise ValueError("the merges are not in the order of the ids")
        names = sorted(model["vocab"], key=model["vocab"].get)
        self.a_bytes = [bytes(map(letter.__getitem__, t)) for t in names]
        self.a = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelt = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in spelt):
            raise ValueError("a piece goes on behind a space")
        self.blank = self.b.piece_to_id("▁")
        self.parts = Memory(self.encode_parts)
        self.b_bytes = [piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(spelt)]
        # bytes of each token and whether it begins with a space, as arrays
        self.a_table, self.b_table = (
            (np.array([len(t) for t in table]), np.array([t[:1] == b" " for t in table])) for table in (self.a_bytes, self.b_bytes)
        )

    def encode(self, texts: list[str]) -> list[tuple]:
        """Both encodings of each whole text as arrays of ids; empty ones where a text's tokens do not give back a space and the text.

        A text is cut before spaces that follow something else. Neither the
        pattern of side A nor a piece of side B goes on behind such a place, so
        the parts have the ids that they have in the text, and a task encodes
        each part once.
        """
        import numpy as np

        none = np.zeros(0, dtype=np.uint32)
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        stops = list(accumulate(map(len, cut)))
        found, out = self.parts.look_up(list(chain.from_iterable(cut))), []
        for start, stop in zip([0, *stops], stops):
            left, right, same = zip(*found[start:stop]) if stop > start else ((), (), ())
            a, b = (np.frombuffer(b"".join(ids), dtype=np.uint32) for ids in (left, right))
            out.append((a, b) if same and all(same) else (none, none))
        return out

    def encode_parts(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both sides of parts that begin with a space, and whether the tokens give back the part.

        Parts that may stand before a space are encoded as one text and taken
        apart at their ends.
        """
        import numpy as np

        made = {}
        inner = [p for p in parts if not p[-1].isspace() and "▁" not in p]
        if inner:
            text = "".join(inner)
            data, ends = text.encode(), np.cumsum([len(p.encode()) for p in inner])
            sides = []
            for ids, (size, _), table in (
                (self.a.encode_to_numpy(text, disallowed_special=()), self.a_table, self.a_bytes),
                (np.array(self.b.encode(text[1:], num_threads=1), dtype=np.uint32), self.b_table, self.b_bytes),
            ):
                if b"".join(map(table.__getitem__, ids.tolist())) != data:
                    break
                stops = (np.searchsorted(np.cumsum(size[ids]), ends, "right") * 4).tolist()
                held = ids.tobytes()
                sides.append([held[s:e] for s, e in zip([0, *stops], stops)])
            if len(sides) == 2:
                made = {p: (a, b, True) for p, a, b in zip(inner, *sides)}
        for part in parts:
            if part not in made:
                # the model puts a space before what it is given, but not before nothing
                a, b, data = self.a.encode_ordinary(part), self.b.encode(part[1:]) if part != " " else [self.blank], part.encode()
                same = all(b"".join(map(table.__getitem__, ids)) == data for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
                made[part] = (array("I", a).tobytes(), array("I", b).tobytes(), same)
        return [made[p] for p in parts]


#: Ends each side of a window's ids; no id is as large.
MARK = 0xFFFFFFFF


class Windows:
    """Ids of both sides of a window -> (groups as text, linked pairs as 64-bit integers).

    A window is keyed by its ids as 32-bit integers, each side ended by MARK.
    Windows not seen before are aligned together: one after the other they are
    an aligned text of their own.
    """

    def __init__(self, tokens: Tokens):
        import numpy as np

        self.a_size, self.b_size = tokens.a_table[0], tokens.b_table[0]
        spelt = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.a_text = spelt(len(self.a_size), ","), spelt(len(self.a_size), "|")
        self.b_text = spelt(len(self.b_size), ","), spelt(len(self.b_size), ";")
        self.memory = Memory(self.link)

    def link(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """Two tokens are linked if their bytes overlap, so one link ends wherever a token of either side does; a group ends where both do."""
        import numpy as np

        ids = np.frombuffer(b"".join(keys), dtype=np.uint32)
        side = np.cumsum(ids == MARK)
        a_side = (side & 1 == 0) & (ids != MARK)
        b_side = (side & 1 == 1) & (ids != MARK)
        a, b = ids[a_side].astype(np.int64), ids[b_side].astype(np.int64)
        # tokens of both sides up to the end of each window
        n = np.arange(len(keys))
        a_stop, b_stop = (np.searchsorted(side[s] >> 1, n, "right") for s in (a_side, b_side))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        end = np.union1d(a_end, b_end)
        a_at, b_at = np.searchsorted(a_end, end), np.searchsorted(b_end, end)
        pairs = a[a_at] * ROOM + b[b_at]
        pair_stop = np.searchsorted(end, a_end[a_stop - 1], "right").tolist()
        shared = end[a_end[a_at] == b_end[b_at]]
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        # each group is written as its tokens of one side, then those of the other
        text = np.empty(len(a) + len(b), dtype=object)
        a_last, b_last = shared[a_group] == a_end, shared[b_group] == b_end
        text[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(a_last, self.a_text[1][a], self.a_text[0][a])
        text[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = np.where(b_last, self.b_text[1][b], self.b_text[0][b])
        parts, text_stop, data = text.tolist(), (a_stop + b_stop).tolist(), pairs.tobytes()
        return [
            ("".join(parts[s:e])[:-1], data[8 * t : 8 * f])
            for s, e, t, f in zip([0, *text_stop], text_stop, [0, *pair_stop], pair_stop)
        ]


def align(tokens: Tokens, windows: Windows, encoded: list[tuple]) -> list[tuple]:
    """(groups as text, their number, linked pairs) of each document, window by window; no tokens give no groups."""
    import numpy as np

    keys, stops, end = [], [], MARK.to_bytes(4, "little")
    for a, b in encoded:
        if len(a):
            i, j = (np.append(at, n) * 4 for at, n in zip(anchors(tokens, a, b), (len(a), len(b))))
            a_ids, b_ids, i, j = a.tobytes(), b.tobytes(), i.tolist(), j.tolist()
            keys += [a_ids[s:e] + end + b_ids[t:f] + end for s, e, t, f in zip([0, *i], i, [0, *j], j)]
        stops.append(len(keys))
    found, out = windows.memory.look_up(keys), []
    for start, stop in zip([0, *stops], stops):
        texts, pairs = zip(*found[start:stop]) if stop > start else ((), ())
        groups = ";".join(texts)
        out.append((groups, groups.count(";") + 1 if groups else 0, np.frombuffer(b"".join(pairs), dtype=np.int64)))
    return out


def anchors(tokens: Tokens, left, right):
    """Token positions on both sides: shared ends, each before a token that begins with a space on both sides."""
    import numpy as np

    places = []
    for ids, (size, space) in ((left, tokens.a_table), (right, tokens.b_table)):
        end = np.cumsum(size[ids])
        at = np.flatnonzero(space[ids[1:]])
        places.append((at + 1, end[at]))
    (i, a_end), (j, b_end) = places
    if not len(i) or not len(j):
        return i[:0], j[:0]
    near = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
    shared = b_end[near] == a_end
    return i[shared], j[near[shared]]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about AT_ONCE code points."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """(_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): one row per document, in one pass.

    pairs are the document's distinct linked id pairs, times how often it has
    each. _row tells rows apart, also those of one doc_id.
    """
    given = documents(docs)
    schema = ROW.format(given.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        from pyspark import TaskContext

        tokens = Tokens(byte_level, pieces, pattern)
        windows = Windows(tokens)
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for start, stop in slices(texts):
                held = [[] for _ in range(7)]
                encoded = tokens.encode(texts[start:stop])
                for (a, b), (groups, n, pairs) in zip(encoded, align(tokens, windows, encoded)):
                    distinct, times = np.unique(pairs, return_counts=True)
                    sha = hashlib.sha256(groups.encode()).hexdigest() if len(a) else ""
                    for column, value in zip(held, (len(a), len(b), n, len(pairs), sha, distinct, times)):
                        column.append(value)
                size = stop - start
                offsets = pa.array(np.cumsum([0] + [len(x) for x in held[5]]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in held[5:]]
                flat = [pa.array(c, pa.int64()) for c in held[:4]] + [pa.array(held[4], pa.string())]
                rows = pa.array(np.arange(at, at + size), pa.int64())
                at += size
                names = [f.split()[0] for f in ROW.split(", ")]
                yield pa.RecordBatch.from_arrays([rows, ids.slice(start, size), *flat, *lists], names)

    return given.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold a pair, and whether no other pair of its A id is held by more."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # an A id has at most as many pairs as the other vocabulary has tokens
    same = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", F.col("n") == F.max("n").over(same))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(_row, n_best, count_sum) of the rows that have links.

    Pairs held by more than a FREQUENT-th of all (row, pair) entries are fewer
    than FREQUENT, whatever the corpus, and are broadcast; every other pair is
    held by so few rows that a shuffle by pair has no hot key. Sums leave a task
    as one row per document.
    """
    entries = rows.select(F.sum(F.size("pairs")).alias("n")).first()["n"] or 0
    limit = entries // FREQUENT
    often, seldom = counts.where(F.col("n") > limit), counts.where(F.col("n") <= limit)
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("_row", "e.times", F.col("e.pairs").alias("pair"))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    ]
    known = each.join(F.broadcast(often), "pair").groupBy("_row").agg(*sums)
    rest = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair").groupBy("_row").agg(*sums)
    return known.unionByName(rest).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])


def align_documents(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of documents.

    A null or empty text, and one whose tokens do not give back a space and the
    text on both sides, has no tokens: zeros and an empty groups_sha256. A
    pair's count is taken over all rows, so repeated rows count each and stay.
    Null ids stay; an empty table gives an empty result; columns other than
    doc_id and text are not read. Both files must open on every executor;
    ``pattern`` is the one by which the byte-level file splits text. The
    per-document rows and the counts are written once each, so ids of rows are
    fixed before they are joined, and lost executors cost no second encoding.
    """
    rows = materialize(aligned(docs, byte_level, pieces, pattern), "crosstok-rows")
    counts = materialize(pair_counts(rows), "crosstok-pairs")
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(scored(rows, counts), "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
