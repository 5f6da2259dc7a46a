"""Source divergence audit: how far the word use of each source is from the others of its language.

Terms are cut and counted by Arrow kernels inside tasks (lower case, split by a
pattern, dictionary codes, hash group-by), so a task hands on one row per
language, source and term. Spark merges these and keeps the frequent terms. The
merged counts are dealt into shards of (language, terms, two blocks of sources),
each an Arrow table in which all pairs of sources are compared at once; sums of
the shards are exact integers, so neither shards nor order change a result.

Nothing is broadcast by hand and nothing reaches the driver but the number of
merged rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import pick

#: What stands between terms; a term is a run of ASCII letters and non-ASCII characters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term counts for a language if it is in so many of its documents.
LEAST_DOCS = 10
#: Characters that are cut into terms at once, and partial rows a task holds before it merges or hands them on, about.
AT_ONCE, HELD = 1 << 22, 400_000
#: Merged rows of a shard and sources of a block, about; cells of a table that a shard compares at once.
SHARD, BLOCK, CELLS = 250_000, 256, 1 << 20
#: Shares of a language or source in a join of its terms.
SALTS = 64
#: Frequencies are in parts of this.
SCALE = 1_000_000_000

PARTIAL = "lang string, source string, term string, count bigint, docs bigint"


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents per (lang, source, term); a group's own row has a null term, no count and its rows as docs."""
    import pyarrow.compute as pc

    def codes(values):
        held = values.dictionary_encode()
        return held.indices, held.dictionary

    lang_code, langs = codes(lang)
    source_code, sources = codes(source)
    group = pc.add(pc.multiply(lang_code.cast(pa.int64()), len(sources)), source_code.cast(pa.int64()))
    words = pc.split_pattern_regex(pc.ascii_lower(text), GAP)
    doc, flat = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.greater(pc.binary_length(flat), 0)
    term, terms = codes(flat.filter(real))
    each = pa.table({"doc": doc.filter(real), "term": term}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    found = pa.table({"group": group.take(each["doc"]), "term": each["term"], "count": each["count_all"]})
    found = found.group_by(["group", "term"]).aggregate([("count", "sum"), ([], "count_all")])
    alone = pa.table({"group": group}).group_by(["group"]).aggregate([([], "count_all")])
    at = pa.chunked_array([*found["group"].chunks, *alone["group"].chunks], pa.int64())
    none = pa.nulls(alone.num_rows, pa.string())
    return pa.table(
        {
            "lang": langs.take(pc.divide(at, max(1, len(sources)))),
            "source": sources.take(pc.subtract(at, pc.multiply(pc.divide(at, max(1, len(sources))), len(sources)))),
            "term": pa.chunked_array([*pa.chunked_array([terms.take(c) for c in found["term"].chunks], pa.string()).chunks, none]),
            "count": pa.chunked_array([*found["count_sum"].chunks, pa.array([0] * alone.num_rows, pa.int64())], pa.int64()),
            "docs": pa.chunked_array([*found["count_all"].chunks, *alone["count_all"].chunks], pa.int64()),
        }
    )


def merged(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys).aggregate([("count", "sum"), ("docs", "sum")])
    return out.select([*keys, "count_sum", "docs_sum"]).rename_columns([*keys, "count", "docs"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """Counts per (lang, source, term) of parts of the documents; see count_terms."""
    given = pick(docs, "lang", "source", "text").na.fill("")

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + AT_ONCE, "right")))
            yield batch.slice(start, stop - start)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(count_terms(part.column("lang"), part.column("source"), part.column("text")))
                rows += held[-1].num_rows
                if rows < HELD:
                    continue
                held = [merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    held = []
                rows = sum(t.num_rows for t in held)
        if held:
            yield from merged(held).combine_chunks().to_batches(max_chunksize=1 << 16)

    return given.mapInArrow(run, PARTIAL)


def merged_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, count, lang_count) of the kept terms, and one row with a null term per (lang, source).

    lang_count is the term's count in its language. Parts of one term meet in
    one task after each task of the pass before has summed up its own, so a term
    that every document holds brings one row per source and task.
    """
    dealt = partial_counts(docs).repartition("lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    all_of = Window.partitionBy("lang", "term")
    wide = counted.withColumns({"_docs": F.sum("docs").over(all_of), "lang_count": F.sum("count").over(all_of)})
    return wide.where(F.col("term").isNull() | (F.col("_docs") >= least_docs)).select("lang", "source", "term", "count", "lang_count")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for totals under 9e15: three digits of the quotient at a time."""
    whole, rest, out = total + 2 * kept, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.floor(F.call_function("div", rest, whole))
        rest = rest % whole
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) in whole numbers; both are at most about SCALE, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def totals(counts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kept): one row per group, also of groups without a kept term."""
    groups = counts.where("term IS NULL").select("lang", "source")
    sums = counts.where("term IS NOT NULL").groupBy("lang", "source").agg(F.sum("count").alias("total"))
    # one row per term of a language carries the language's count
    first = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("lang_count").alias("n"))
    langs = first.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    return (
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")])
    )


def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join term rows with one row per key, with each key in SALTS shares: a key with most rows is as many tasks."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("term", F.lit(13)), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def top_terms(counts: DataFrame, groups: DataFrame, ranks: int = 10) -> DataFrame:
    """The ``ranks`` kept terms of each group that are over the language's share most; ties by term."""
    given = beside(counts.where("term IS NOT NULL AND count > 0"), groups, ["lang", "source"])
    p = share(F.col("count"), F.col("total"), F.col("kept"))
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
    over = given.select("lang", "source", F.col("term").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    valued = over.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("_p"), F.col("_q")).alias("value"))
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


PAIRS = "lang string, a string, b string, part_sum bigint, seen bigint, idle bigint, kept bigint"


def compare_shard(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of a shard for all pairs of its sources: from one block, or across two.

    A row per pair a < b: part_sum over the terms seen in the shard, their
    number, and idle, the value of a term that neither source has.
    """
    import numpy as np
    import pyarrow.compute as pc

    lang, _, i, j = (k.as_py() for k in key)
    names = groups["source"].combine_chunks()
    order = pc.array_sort_indices(names)
    names, own = names.take(order), groups["_own"].combine_chunks().take(order).to_numpy()
    total, kept = (groups[c].combine_chunks().take(order).to_numpy() for c in ("total", "kept"))
    n, whole = len(names), total + 2 * kept

    def shares(count, whole):
        rest, out = count + 2, np.zeros_like(count)
        for _ in range(3):
            rest = rest * 1000
            out = out * 1000 + rest // whole
            rest = rest % whole
        return out + 1

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    seen, sums = 0, np.zeros((n, n), dtype=np.int64)
    if counts.num_rows:
        at = pc.index_in(counts["source"].combine_chunks(), names).to_numpy(zero_copy_only=False)
        coded = counts["term"].combine_chunks().dictionary_encode()
        term, seen = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        value = counts["count"].to_numpy()
        by_term = np.argsort(term, kind="stable")
        term, at, value = term[by_term], at[by_term], value[by_term]
        step = max(1, CELLS // n)
        for low in range(0, seen, step):
            high = min(seen, low + step)
            rows = slice(*np.searchsorted(term, [low, high]))
            grid = np.zeros((n, high - low), dtype=np.int64)
            grid[at[rows], term[rows] - low] = value[rows]
            p = shares(grid, whole[:, None])
            for x in range(n - 1):
                later = np.arange(x + 1, n) if i == j else x + 1 + np.flatnonzero(own[x + 1 :] != own[x])
                if len(later):
                    sums[x, later] += apart(p[x], p[later]).sum(axis=1)
    left, right = np.triu_indices(n, 1)
    if i != j:
        across = own[left] != own[right]
        left, right = left[across], right[across]
    none = shares(np.zeros(n, dtype=np.int64), np.maximum(whole, 2))
    size = len(left)
    return pa.table(
        {
            "lang": pa.array([lang] * size, pa.string()), "a": names.take(pa.array(left)), "b": names.take(pa.array(right)),
            "part_sum": sums[left, right], "seen": np.full(size, seen, dtype=np.int64),
            "idle": apart(none[left], none[right]), "kept": kept[left],
        }
    )


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of each source from each other one of its language, over all kept terms.

    Shards hold about SHARD counts of one language and at most two blocks of
    about BLOCK sources, so a language or a source with a third of all rows is
    many shards. A term that a shard does not see, or that neither source has,
    adds the same ``idle`` value, whatever the term.
    """
    there = counts.where("term IS NOT NULL").select("lang", "source", "term", "count")
    sizes = there.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_shards"))
    spread = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    plan = spread.join(sizes, "lang", "left").select("lang", "_blocks", F.coalesce("_shards", F.lit(1)).alias("_shards"))

    def cells(df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("source", F.lit(5)), F.col("_blocks")).cast("int")
        held = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        return held.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})

    shard = F.pmod(F.xxhash64("term", F.lit(9)), F.col("_shards")).cast("int")
    left = cells(beside(there, plan, ["lang"]).withColumn("_shard", shard)).select("lang", "_shard", "_i", "_j", "source", "term", "count")
    every = groups.join(plan, "lang").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    right = cells(every).select("lang", "_shard", "_i", "_j", "_own", "source", "total", "kept")
    keys = ["lang", "_shard", "_i", "_j"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare_shard, PAIRS)
    summed = parts.groupBy("lang", "a", "b").agg(
        (F.sum("part_sum") + (F.max("kept") - F.sum("seen")) * F.max("idle")).alias("value")
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t"))))
    sides = summed.select("lang", both.alias("_p"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    named = sides.select("lang", F.col("_p.s").alias("source"), F.lit("pair").alias("part"), F.col("_p.t").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    A null lang, source or text is the empty one. Part ``pair``: each other
    source of the language and how far it is; part ``term``: the terms that set
    the source apart from its language, ``ranks`` at most. Repeated rows are
    documents of their own. A language without a kept term has pairs of value
    0; a language of one source has no pairs; an empty table gives an empty
    result. Other columns are not read.
    """
    counts = materialize(merged_counts(docs, least_docs), "audit-counts")
    groups = materialize(totals(counts), "audit-groups")
    return source_pairs(counts, groups).unionByName(top_terms(counts, groups, ranks))
