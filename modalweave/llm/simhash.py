"""SimHash near-duplicates, verified through tables of pivot distances; texts alike by shared shingles.

The distance of two fingerprints is at least the difference of their distances
to any third one. Distances to a few reference fingerprints (pivots) are
computed once per fingerprint; a pair whose distances differ by more than the
radius at any pivot is discarded without being compared.

Two measures of likeness are offered: ``near_duplicates`` links fingerprints
within three bits, ``similar_documents`` links texts with a Jaccard similarity of
their word shingles from a threshold on: the classes of near fingerprints are
searched first, keys of shingle minima bring in what lies beyond three bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import aside, documents, pair_cells, per_document
from .components import connected

#: Blocks of the fingerprint. Two fingerprints within three bits agree on two of five blocks at least.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
PIVOTS = 12
#: Rows of a chunk of a hot key; a cell compares at most two chunks.
CHUNK = 2048
#: Keys of a text by the minima of its shingles, and minima in a key: a pair of similarity 0.8 has none in common with chance 0.0002.
BANDS, MINIMA = 16, 4
#: Rows of a chunk where whole shingle sets travel.
SET_CHUNK = 512


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit integer) of each whole text.

    A-Z are lower-cased, words are runs without space, tab, line feed, vertical
    tab, form feed or carriage return; shingles count as often as they occur. A
    text of fewer words is one shingle, a text without words (null and empty
    texts too) has fingerprint zero. Other columns are not read.
    """

    def row():
        from itertools import repeat

        import numpy as np
        import xxhash

        def one(text):
            split = text.encode().lower().split()
            if not split:
                return (0,)
            n = max(1, len(split) - words + 1)
            parts = zip(*(split[i:] for i in range(words))) if len(split) >= words else [split]
            return (majority(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64, n)),)

        return one

    return per_document(documents(docs), "fingerprint bigint", row)


def majority(hashes, block: int = 1 << 16) -> int:
    """The fingerprint of a text's shingle hashes, as a signed 64-bit integer: a bit is 1 if set in over half of them."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):  # bounded memory for a very long text
        bits = np.unpackbits(hashes[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def pivots(seed: int = 20):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def near_pairs(prints, left, right, radius: int):
    """Positions of pairs within the radius among the candidates (left[i], right[i])."""
    import numpy as np

    for p in pivots():
        far = np.bitwise_count(prints ^ p).astype(np.int16)
        keep = np.abs(far[left] - far[right]) <= radius
        left, right = left[keep], right[keep]
        if len(left) < 64:
            break
    keep = np.bitwise_count(prints[left] ^ prints[right]) <= radius
    return left[keep], right[keep]


def stars(left, right, rank):
    """For linked positions: the position of least rank that each can reach."""
    import numpy as np

    n = len(rank)
    by_rank = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[by_rank] = np.arange(n)
    label, a, b = np.arange(n), place[left], place[right]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return by_rank[label[place]]
        label = new


def grouped(frames: Iterator, keys: list[str]) -> Iterator:
    """Sorted pandas batches cut at group borders; a group is never split over two."""
    import pandas as pd

    held = None
    for frame in frames:
        if not len(frame):
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held[keys].iloc[-1]
        same = (held[keys] == last).all(axis=1).to_numpy()
        cut = len(same) if not same.any() else int(same.argmax())
        if cut:
            yield held.iloc[:cut].reset_index(drop=True)
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def candidates(starts, sizes, own, i, j, block: int = 256):
    """Pairs of positions inside each group, block by block: all of a cell (i, i), those across chunks of (i, j)."""
    import numpy as np

    small = sizes <= 64
    if small.any():  # step d pairs every row with the one d below it
        group = np.repeat(np.arange(len(starts)), sizes)
        last = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(small[group])
        for d in range(1, int(sizes[small].max())):
            at = at[at + d < last[at]]
            a, b = at, at + d
            keep = (i[a] == j[a]) | (own[a] != own[b])
            yield a[keep], b[keep]
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        rows = np.arange(s, s + n)
        one = rows if i[s] == j[s] else rows[own[s : s + n] == i[s]]
        two = rows if i[s] == j[s] else rows[own[s : s + n] != i[s]]
        for k in range(0, len(one), block):
            a = np.repeat(one[k : k + block], len(two))
            b = np.tile(two, len(one[k : k + block]))
            keep = a < b if i[s] == j[s] else slice(None)
            yield a[keep], b[keep]


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect just what the pairs within the radius connect.

    prints (node, fingerprint), one row per distinct fingerprint. Candidates
    agree on two of five blocks of bits, which no pair within three bits can
    avoid; pivot distances discard most of them. A task returns at most one edge
    per row and cell (to the least node of its local component), not all pairs.
    """
    if radius > RADIUS:
        raise ValueError("two equal blocks of five are certain only within three bits")
    keys = []
    for one, two in combinations(BLOCKS, 2):
        mask = sum(((1 << n) - 1) << s for s, n in (one, two))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(len(keys)).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("bits")))
    banded = prints.withColumn("_k", F.explode(F.array(*keys))).select("node", "fingerprint", "_k.band", "_k.bits")
    cells = pair_cells(banded, ["band", "bits"], "node", chunk)
    by = ["band", "bits", "_i", "_j"]
    node = prints.schema["node"].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in grouped(frames, by):
            values = frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
            group = frame[by]
            fresh = np.flatnonzero(np.r_[True, (group.iloc[1:].to_numpy() != group.iloc[:-1].to_numpy()).any(axis=1)])
            sizes = np.diff(np.r_[fresh, len(frame)])
            own, i, j = (frame[c].to_numpy() for c in ("_own", "_i", "_j"))
            found = [near_pairs(values, a, b, radius) for a, b in candidates(fresh, sizes, own, i, j)]
            found = [f for f in found if len(f[0])]
            if found:
                left, right = (np.concatenate(x) for x in zip(*found))
                root = stars(left, right, frame["node"].to_numpy())
                moved = np.flatnonzero(root != np.arange(len(frame)))
                ids = frame["node"].to_numpy()
                yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    dealt = cells.select("node", "fingerprint", "_own", *by).repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInPandas(run, f"a {node}, b {node}").where("a != b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, node, component): documents linked by fingerprints within ``radius`` bits.

    component_id is the least doc_id reachable, the document itself included.
    Equal fingerprints (exact copies, empty texts) are one node, so copies cost
    nothing beyond one row. A repeated doc_id joins the components of its rows
    only through their fingerprints; a document with a null doc_id takes part,
    and its class bears the least id that is not null (null if there is none).
    node is the fingerprint again and component the least node of the class, a
    name that classes without an id have as well.
    """
    marked = materialize(fingerprints(docs, words), "simhash")
    nodes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    classes = nodes.join(near_classes(nodes.select("fingerprint"), radius), "fingerprint")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fingerprint", "component_id", "component")
    return marked.join(named, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", F.col("fingerprint").alias("node"), "component"
    )


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, component) of distinct fingerprints: the least one reachable by steps within the radius."""
    # rows of one doc_id may have different texts: each fingerprint is a node of its own
    numbered = prints.select(F.col("fingerprint").alias("node"), "fingerprint")
    found = connected(links(numbered, radius), "simhash-links")
    return numbered.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))


def words_digest(df: DataFrame) -> DataFrame:
    """(doc_id, node) of (doc_id, text): the node of ``sketches`` alone."""

    def row():
        import xxhash

        return lambda text: (xxhash.xxh3_128_hexdigest(b" ".join(text.encode().lower().split())),)

    return per_document(df, "node string", row)


def keep_first(docs: DataFrame, found: DataFrame, marks: Callable[[DataFrame], DataFrame] = words_digest) -> DataFrame:
    """The rows of docs that stay, all columns as they are: one row of each class, one with its least doc_id.

    found (doc_id, component_id, node, component): the classes of docs, from
    ``near_duplicates`` or ``similar_documents``; marks: the function that gave
    each (doc_id, text) its node (``fingerprints``, or ``words_digest`` for ``similar_documents``). Of a class
    without any id one row stays. Rows that share their doc_id (or have none) are
    told apart by the node of their text; of equal ones an arbitrary row stays.
    """
    held, back = aside(docs, "doc_id", "text")
    first = materialize(found.where("doc_id <=> component_id").groupBy("doc_id", "node", "component").count(), "first")
    several = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_again"))
    several = materialize(several, "repeated-ids")
    if several.isEmpty():
        stay = first.select(F.col("doc_id").alias("_stay"))
        return back(held.join(stay, held["doc_id"] == stay["_stay"], "left_semi"))
    again = held["doc_id"].eqNullSafe(several["_again"])
    stay = first.select(F.col("doc_id").alias("_stay"))
    stay = stay.join(several, stay["_stay"].eqNullSafe(several["_again"]), "left_anti")
    alone = held.join(stay, held["doc_id"] == stay["_stay"], "left_semi")
    # few rows as a rule: each gets the node of its text anew and is looked up by it
    shared = held.join(several, again, "left_semi")
    whole = F.struct(*[F.col(c) for c in held.columns]).alias("doc_id")
    noted = marks(shared.select(whole, F.coalesce("text", F.lit("")).alias("text")))
    noted = noted.select(F.col("doc_id").alias("_row"), F.col(noted.columns[1]).alias("_node"))
    led = first.select(F.col("doc_id").alias("_stay"), F.col("node").alias("_lead"), F.col("component").alias("_class"))
    met = noted["_row"]["doc_id"].eqNullSafe(led["_stay"]) & (noted["_node"] == led["_lead"])
    # one row of each class: the partial results of a task hold one row per class
    one = noted.join(led, met).groupBy("_class").agg(F.first("_row").alias("_row")).select("_row.*")
    return back(alone.unionByName(one))


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, node, bands, shingles, fingerprint) of each whole text.

    fingerprint and words as in ``fingerprints``; elsewhere each distinct shingle counts once. node is
    a 128-bit digest of the words, so texts that differ in spacing or in the case
    of A-Z are one node. bands hold digests of their minima under random orders, shingles the sorted
    upper 32 bits of their hashes (two sets of 500 hold a false match with chance
    0.00006, which counts only within one shingle of the threshold). All three are
    null for a text without words.
    """

    def row():
        from itertools import repeat

        import numpy as np
        import xxhash

        rng = np.random.default_rng(21)
        flip = rng.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64)
        odd = rng.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
        block = 4096

        def one(text):
            split = text.encode().lower().split()
            node = xxhash.xxh3_128_hexdigest(b" ".join(split))
            if not split:
                return node, None, None, None
            n = max(1, len(split) - words + 1)
            parts = zip(*(split[i:] for i in range(words))) if len(split) >= words else [split]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64, n)
            distinct = np.unique(hashes)
            least = np.full(len(odd), (1 << 64) - 1, np.uint64)
            for i in range(0, len(distinct), block):
                part = distinct[i : i + block]
                least = np.minimum(least, ((part[:, None] ^ flip) * odd).min(axis=0))
            short = np.unique((distinct >> np.uint64(32)).astype(np.uint32))
            digests = [xxhash.xxh64_intdigest(least[b * MINIMA : (b + 1) * MINIMA].tobytes(), b) for b in range(BANDS)]
            return node, np.array(digests, np.uint64).view(np.int64).tolist(), short.tobytes(), majority(hashes)

        return one

    return per_document(documents(docs), "node string, bands array<bigint>, shingles binary, fingerprint bigint", row)


def joined(sets: list, left, right, label, similarity: float):
    """label after joining the candidate pairs that reach the similarity; pairs already joined are not compared."""
    import numpy as np

    size = np.fromiter(map(len, sets), np.int64, len(sets))
    # no pair whose sizes differ this much can reach it
    keep = np.minimum(size[left], size[right]) / np.maximum(size[left], size[right]) >= similarity
    left, right = left[keep], right[keep]
    while True:
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
        if not len(left):
            return label
        for a, b in zip(left[:128].tolist(), right[:128].tolist()):
            if label[a] == label[b]:
                continue
            one, two = sets[a], sets[b]
            both = np.concatenate((one, two))
            both.sort(kind="stable")  # two sorted runs: a merge
            shared = np.count_nonzero(both[1:] == both[:-1])
            if shared / (len(both) - shared) >= similarity:
                label = np.where(label == label[b], label[a], label)
        left, right = left[128:], right[128:]


def similar_links(
    texts: DataFrame, sets: DataFrame, similarity: float, chunk: int = SET_CHUNK, found: DataFrame | None = None
) -> DataFrame:
    """``set_links`` of the texts (node, bands), one row per node, that share a band.

    Bands all of whose texts found (node, component) has in one component are left out.
    """
    keyed = texts.select("node", F.posexplode("bands").alias("band", "bits"))
    if found is not None:
        named = texts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.select("node", "component", F.posexplode("bands").alias("band", "bits"))
        ends = named.groupBy("band", "bits").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
        several = named.join(ends.where("_least != _most"), ["band", "bits"], "left_semi")
        keyed = materialize(several.select("node", "band", "bits"), "similar-open")
    return set_links(keyed, sets, similarity, chunk)


def set_links(keyed: DataFrame, sets: DataFrame, similarity: float, chunk: int = SET_CHUNK) -> DataFrame:
    """(a, b): edges that connect what candidate pairs of at least the similarity connect.

    keyed (node, band, bits): candidates agree in band and bits; sets (node, shingles), any number of
    equal rows per node. The shingle sets of all candidates decide. Sets are looked up only for nodes
    that share a key with another.
    """
    cells = materialize(pair_cells(keyed, ["band", "bits"], "node", chunk), "similar-cells")
    # written, so that Spark knows its size: broadcast below its threshold, else both sides are shuffled
    listed = materialize(cells.select("node").distinct(), "similar-wanted")
    wanted = sets.join(listed, "node", "left_semi").dropDuplicates(["node"])
    by = ["band", "bits", "_i", "_j"]

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in grouped(frames, by):
            group, ids = frame[by].to_numpy(), frame["node"].to_numpy()
            fresh = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[fresh, len(frame)])
            own, i, j = (frame[c].to_numpy() for c in ("_own", "_i", "_j"))
            sets = [np.frombuffer(s, np.uint32) for s in frame["shingles"]]
            label = np.arange(len(frame))
            for a, b in candidates(fresh, sizes, own, i, j):
                label = joined(sets, a, b, label, similarity)
            moved = np.flatnonzero(label != np.arange(len(frame)))
            yield pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    full = cells.join(wanted, "node").select("node", "shingles", "_own", *by)
    return full.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a string, b string").where("a != b")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id, node, component): documents linked by a Jaccard similarity of their distinct word shingles.

    Texts of equal words are one node, whatever their spacing or the case of A-Z;
    null and empty texts are equal too. A text of fewer words than a shingle is
    one shingle. component_id and component as in ``near_duplicates``: the least doc_id
    reachable, null where a class has no id, and the class itself.

    The classes of ``near_classes`` (fingerprints within three bits, by blocks, pivots and
    popcount) are searched first: their shingle sets are compared and what reaches the similarity
    is linked. Most pairs at 0.8 differ in more bits, so texts that share a band of minima
    are searched next, but for bands whose texts the first search has already joined. A
    pair is missed only if its fingerprints are in different classes and it shares no
    band (see there); no pair below the similarity is linked. similarity 0.8 or
    more suits the bands.
    """
    if similarity < 0.8:
        raise ValueError("bands are laid out for similarities from 0.8 on")
    marked = materialize(sketches(docs, words), "similar")
    firsts = [F.first(c).alias(c) for c in ("bands", "fingerprint")]
    nodes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *firsts), "similar-nodes")
    sets = marked.select("node", "shingles")
    near = near_classes(nodes.where("fingerprint IS NOT NULL").select("fingerprint").distinct())
    near = nodes.select("node", "fingerprint").join(near, "fingerprint")
    near = set_links(near.select("node", F.lit(-1).alias("band"), F.col("component").alias("bits")), sets, similarity)
    near = materialize(near, "similar-near")
    beyond = similar_links(nodes.select("node", "bands"), sets, similarity, found=connected(near, "similar-near"))
    edges = near.unionByName(beyond)
    classes = nodes.join(connected(edges, "similar-links"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id", "component")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id", "node", "component")
