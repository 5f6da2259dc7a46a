"""Packing: optimal length buckets and token-budget batches inside them.

The histogram of lengths over all documents decides the bucket borders: dynamic
programming finds the ones with the least padding. Inside a bucket documents
are numbered and cut into batches of as many as fit the budget at the padded
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import load_ranks
from .common import documents, per_document

#: A grid, where one is asked for, is exact up to here; beyond it lengths are rounded up to 1/256 of their power of two.
EXACT = 4096
#: Documents of a bucket that one task numbers, about.
SHARE = 50_000


def lengths(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of each whole text under a tiktoken rank file."""

    def row():
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
        return lambda text: (len(own.encode_ordinary(text)),)

    return per_document(documents(docs), "n_tokens bigint", row)


def slot(length: Column) -> Column:
    """The grid length that a length is counted under; at most EXACT + 256 per further power of two exist (``pack``: grid)."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT)))) - 8)
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def layer_of(best, layer: int, top, count, total):
    """(cost, split) of each last length j when one more bucket, from after split to j, follows the best buckets so far.

    The best split never moves down as j grows, so the middle j of a range halves
    the splits left for both sides. All middles of a depth are solved at once:
    about log2 m steps on arrays of at most 2 m numbers.
    """
    import numpy as np

    m = len(top)
    new, split = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    low, high, least, most = (np.array([x]) for x in (layer, m - 1, layer - 1, m - 2))
    while len(low):
        j = (low + high) // 2
        n = np.minimum(j - 1, most) - least + 1
        start = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(j)), n)
        i = np.arange(int(n.sum())) - (start - least)[owner]
        last = j[owner]
        cost = best[i] + (count[last + 1] - count[i + 1]) * top[last] - (total[last + 1] - total[i + 1])
        new[j] = np.minimum.reduceat(cost, start)
        hits = np.flatnonzero(cost == new[last])
        at = i[hits[np.unique(owner[hits], return_index=True)[1]]]  # of equal splits the first
        split[j] = at
        low, high, least, most = np.r_[low, j + 1], np.r_[j - 1, high], np.r_[least, at], np.r_[at, most]
        keep = low <= high
        low, high, least, most = low[keep], high[keep], least[keep], most[keep]
    return new, split


def borders(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding, exact for totals below 2^63.

    histogram: (length, documents, tokens) in any order, as rows of a list or an
    array. A bucket from after i to j costs documents * length(j) - tokens.
    """
    import numpy as np

    rows = np.array(histogram, dtype=np.int64).reshape(-1, 3)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    m = len(rows)
    if not m:
        return []
    top = rows[:, 0]
    count, total = (np.r_[0, np.cumsum(rows[:, c])] for c in (1, 2))
    best, layers = count[1:] * top - total[1:], []
    for layer in range(1, min(buckets, m)):
        best, split = layer_of(best, layer, top, count, total)
        layers.append(split)
    out = [m - 1]
    for split in reversed(layers):
        out.append(int(split[out[-1]]))
    return [int(top[x]) for x in reversed(out)]


def pack(sized: DataFrame, budget: int = 65_536, buckets: int = 12, grid: bool = False) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch, place): every row once.

    sized: (doc_id, n_tokens). bucket counts from 0 by length, batch from 0
    inside its bucket, place from 0 inside its batch; documents of a batch, all
    padded to padded_length, fit ``budget`` tokens, and a document longer than
    the budget is a batch by itself. Order in a bucket is a hash of doc_id, then
    doc_id and length, nulls first, so a rerun gives the same batches; equal
    rows are interchangeable. A null length counts as 0. An empty table gives an empty result.

    Only the histogram reaches the driver, as Arrow columns: one row per distinct
    length. n tokens in all have fewer than sqrt(2 n) + 1 distinct lengths, 7
    million (170 MB) at 2.5e13 tokens. With ``grid`` lengths are counted on a
    grid, for fewer rows; the borders may then miss the optimum. A bucket that holds most rows is numbered in shares by
    hash, whose sizes are then summed up, never in one task.
    """
    import numpy as np

    length = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    sized = sized.select("doc_id", "n_tokens", (slot(length) if grid else length).alias("_slot"))
    counted = sized.groupBy("_slot").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).toArrow()
    histogram = np.stack([c.to_numpy() for c in counted.columns], axis=1)
    tops = borders(histogram, buckets)
    rows = int(histogram[:, 1].sum())
    shares = max(16, -(-rows // SHARE))
    bucket = F.lit(0)
    for top in tops[:-1]:
        bucket = bucket + F.when(F.col("_slot") > top, 1).otherwise(0)
    top = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops or [0]]), F.col("bucket") + 1)
    mixed = F.xxhash64(F.col("doc_id"), F.lit(11))
    dealt = sized.withColumn("bucket", bucket).withColumns(
        {"padded_length": top, "_mix": mixed, "_share": F.pmod(mixed, F.lit(shares)).cast("int")}
    )
    sizes = dealt.groupBy("bucket", "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_share").orderBy("_mix", F.asc_nulls_first("doc_id"), "n_tokens")
    at = F.row_number().over(inside) - 1
    placed = dealt.withColumn("_at", at).join(offsets, ["bucket", "_share"]).withColumn("_at", F.col("_at") + F.col("_before"))
    fit = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_length", F.lit(1))), F.lit(1)).cast("long")
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        F.floor(F.col("_at") / fit).cast("long").alias("batch"), (F.col("_at") % fit).cast("long").alias("place"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, budget: int = 65_536, buckets: int = 12) -> DataFrame:
    """pack() over the token lengths of whole texts; a null or empty text has length 0. Other columns are not read."""
    return pack(materialize(lengths(docs, vocabulary, pattern), "lengths"), budget, buckets)
