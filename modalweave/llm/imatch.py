"""I-Match fingerprints over a band of inverse document frequency.

Built-in expressions only. A document's distinct terms inside the band, sorted,
are hashed once per randomised subset of the lexicon; two documents are as
alike as the share of subsets on which their hashes agree.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import hex_digest, pick

#: (share of the lexicon, number of randomised subsets that keep it). Large subsets tell short texts
#: apart, small ones survive changes in long texts.
SUBSETS = ((1 / 2, 1), (1 / 4, 2), (1 / 8, 5), (1 / 16, 8), (1 / 32, 8), (1 / 64, 12), (1 / 128, 14), (1 / 256, 14))
RATES = tuple(rate for rate, count in SUBSETS for _ in range(count))
#: A term of the lexicon occurs in at least one of RARE documents and at most the share COMMON of all.
RARE, COMMON = 5_000, 0.2
#: Terms of a lexicon that is broadcast at most; two longs each.
LEXICON = 1 << 21
#: Documents of a range that one task puts in order, about, and most quantiles that part the ranges.
SHARE, QUANTILES = 2_000, 1_024


def words(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes; terms are runs of letters and digits, lower-cased."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, column: str = "text", rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, df) of the terms inside the band, counted over every row of ``texts``.

    The band is relative, n / rare <= df <= common * n: as the frequencies of all
    terms sum to n times the mean number of distinct terms per document, at most
    ``rare`` times that mean can lie in it, whatever the size of the corpus.
    """
    n = texts.count()
    counted = texts.select(F.explode(words(F.col(column))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= n / rare) & (F.col("df") <= max(1.0, common * n)))


def subsets_of(term: Column) -> Column:
    """The subsets that keep a term as bits of a long; subset i with its rate, by a hash of term and i."""
    bits = F.lit(0).cast("long")
    for i, rate in enumerate(RATES):
        kept = F.pmod(F.xxhash64(term, F.lit(101 + i)), F.lit(1 << 20)) < int(rate * (1 << 20))
        bit = F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")
        bits = bits.bitwiseOR(F.when(kept, bit).otherwise(F.lit(0).cast("long")))
    return bits


def in_order(docs: DataFrame) -> DataFrame:
    """(_range, _row, doc_id, text, next_text, _own): every row with the text of the next by doc_id; the last meets the first.

    Ranges of doc_id come from approximate quantiles and steps between them, so
    they hold about SHARE rows each, and each is put in order by one task. The
    first row of a range is also handed to the range before (_own false).
    Rows of one doc_id follow by text; null ids come first.
    """
    held = pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_at")
    )
    n, low, high = held.select(F.count("*"), *[f(F.when(F.col("doc_id").isNotNull(), F.col("_at"))) for f in (F.min, F.max)]).first()
    parts = max(1, min(QUANTILES, n // SHARE))
    cuts = held.where("doc_id IS NOT NULL").approxQuantile("_at", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted(set(cuts))
    place = F.lit(0)
    if cuts:
        # between two quantiles, steps of equal width keep the ranges small in a table of any size
        steps = -(-(n // SHARE) // (len(cuts) + 1))
        bounds = F.array(*[F.lit(c) for c in [low, *cuts, max(high, cuts[-1]) + 1]])
        at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_at")))
        left, right = F.element_at(bounds, at + 1), F.element_at(bounds, at + 2)
        step = F.floor((F.col("_at") - left) / F.nullif(right - left, F.lit(0.0)) * steps)
        place = at * steps + F.coalesce(F.greatest(F.lit(0), F.least(F.lit(steps - 1), step)), F.lit(0))
    ranged = held.withColumn("_range", place.cast("int"))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id"), F.col("text"))).alias("_f"))
    # one row a range; each goes to the nearest range before that holds rows, the very first to the last
    line = Window.orderBy("_range")
    before = firsts.select("_f", F.lag("_range").over(line).alias("_b"), F.max("_range").over(Window.partitionBy()).alias("_last"))
    guests = before.select(
        F.coalesce("_b", "_last").cast("int").alias("_range"), F.col("_f.doc_id").alias("doc_id"), F.col("_f.text").alias("text"),
        F.lit(False).alias("_own"), F.col("_b").isNull().alias("_wrap"),
    )
    own = ranged.select("_range", "doc_id", "text", F.lit(True).alias("_own"), F.lit(False).alias("_wrap"))
    both = own.unionByName(guests)
    order = Window.partitionBy("_range").orderBy(F.desc("_own"), F.asc_nulls_first("doc_id"), F.asc("text"))
    return both.select(
        "_range", F.row_number().over(order).alias("_row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "_own"
    )


def signature(entries: Column) -> Column:
    """One hash per subset over its terms in order; null for a subset without terms. entries: sorted (which, term, mask).

    Subsets of one rate first share a list of the terms that any of them keeps:
    most terms are in no small subset. Lists pass through a lambda variable, so
    that each is made once and not anew for every subset.
    """

    def of_rate(bits: list[int]) -> Column:
        any_of, each = F.lit(sum(bits)).cast("long"), F.array(*[F.lit(x).cast("long") for x in bits])
        mine = F.filter(entries, lambda e: e["mask"].bitwiseAND(any_of) != 0)

        def hashes(held: Column) -> Column:
            lists = F.transform(each, lambda x: F.filter(held, lambda e: e["mask"].bitwiseAND(x) != 0))
            return F.transform(lists, lambda m: F.when(F.size(m) > 0, F.xxhash64(F.transform(m, lambda e: e["term"]))))

        return F.transform(F.array(mine), hashes)[0]

    bits = [1 << i if i < 63 else -(1 << 63) for i in range(len(RATES))]
    stops = list(accumulate(count for _, count in SUBSETS))
    return F.concat(*[of_rate(bits[start:stop]) for start, stop in zip([0, *stops], stops)])


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes among those in which either document has terms; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    used = F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    same = F.filter(pairs, lambda p: p["a"] == p["b"])
    return F.when(F.size(used) == 0, 1.0).otherwise(F.size(same) / F.size(used))


def fingerprints(rows: DataFrame, key: list[str], texts: dict[str, Column], carry: Column, terms_in_band: DataFrame) -> DataFrame:
    """key, carried, and for each named text ``<name>``: one hash per subset over the sorted terms inside the band.

    A term brings the bits of its subsets along, so it is one row per text, and
    all hashes come from one sorted list per row of the key. The lexicon is
    broadcast while it has at most LEXICON terms; a larger one is joined by a
    shuffle, in which no term is in more than the band's share of all
    documents. Where rows are already partitioned by a part of the key nothing
    else is shuffled. ``carry`` travels in one entry per row, which also keeps
    rows without any term.
    """
    listed = terms_in_band.select("term", subsets_of(F.col("term")).alias("mask")).where("mask <> 0")
    nothing = F.lit(None)

    def entries(k: int, text: Column) -> Column:
        return F.transform(words(text), lambda w: F.struct(F.lit(k).alias("which"), w.alias("term"), nothing.alias("carry")))

    each = [entries(k, t) for k, t in enumerate(texts.values())]
    # this entry meets no term; its key is a hash of the row's, so that such entries spread
    held = F.array(F.struct(F.lit(-1).alias("which"), F.xxhash64(*key).alias("term"), carry.alias("carry")))
    spread = rows.select(*key, F.explode(F.concat(held, *each)).alias("_t")).select(*key, "_t.*")
    joined = spread.join(F.broadcast(listed) if terms_in_band.count() <= LEXICON else listed, "term", "left")
    kept = joined.where("mask IS NOT NULL OR which < 0")
    table = kept.groupBy(*key).agg(
        F.first("carry", True).alias("carried"),
        F.sort_array(F.collect_list(F.when(F.col("which") >= 0, F.struct("which", "term", "mask")))).alias("_terms"),
    )
    of = lambda k: F.filter("_terms", lambda e: e["which"] == k)
    lists = table.select(*key, "carried", *[of(k).alias(n) for k, n in enumerate(texts)])
    return lists.select(*key, "carried", *[signature(F.col(n)).alias(n) for n in texts])


def as_text(hashes: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits per subset, - for a subset without terms."""
    short = F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return F.concat_ws(".", F.transform(short, lambda h: F.coalesce(h, F.lit("-"))))


def match(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last half (rounded down) replaced by as
    many first code points of the next document, or all it has. A null text is
    the empty one; texts without a term in the band share one fingerprint.
    Repeated rows stay and are neighbours. Other columns are not read.
    """
    rows = in_order(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    start = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    edited = F.concat(start, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("_range", "_row", "doc_id", "text", edited.alias("edited"), "_own")
    terms = materialize(lexicon(pick(docs, "text").select(F.coalesce("text", F.lit("")).alias("text"))), "imatch-lexicon")
    carry = F.struct(
        "doc_id", F.length("text").cast("long").alias("n_chars"), hex_digest(F.col("edited")).alias("edited_sha256"), "_own"
    )
    texts = {"_a": F.col("text"), "_b": F.col("edited")}
    prints = fingerprints(rows, ["_range", "_row"], texts, carry, terms)
    follow = F.lead("_a").over(Window.partitionBy("_range").orderBy("_row"))
    return prints.withColumn("_next", follow).where("carried._own").select(
        "carried.doc_id", "carried.n_chars", "carried.edited_sha256",
        as_text(F.col("_a")).alias("fingerprint"), as_text(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.coalesce("_next", "_a")).alias("near_next"),
    )
