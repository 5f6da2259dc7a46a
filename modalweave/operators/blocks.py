"""Block score join: every query against every gallery row, reduced on the fly.

Similarities are computed tile by tile inside Arrow batches and only a
reduction per query leaves the task (top-k lists, counts, sums).  The
query x gallery pairs themselves are never rows of a DataFrame.

Three placements, picked by checked size:

* queries fit the broadcast bound  -> the gallery stays where it is, no shuffle;
* the gallery fits the bound       -> queries stream past it, no shuffle;
* neither fits                     -> both sides are hashed into bounded blocks
  and co-grouped on (query block, gallery block).

Reductions are merged in two levels. With broadcast queries a task first folds
all the gallery splits dealt to it into one state, so that the partial rows
grow with the tasks of the stage (``Limits.partials``) and not with the splits
of the gallery; these rows are then merged by one aggregate that knows a query
by its row number. Columns that are only carried along join its result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

SCORE_DECIMALS = 12  # scores closer than this are ties, broken by id
SLACK = 10.0**-SCORE_DECIMALS


def settle(scores):
    """Scores as they are compared: rounded, so that summation order cannot matter."""
    return np.round(scores, SCORE_DECIMALS)


@dataclass(frozen=True)
class Limits:
    """Size bounds of the block join."""

    broadcast_rows: int = 20_000
    broadcast_bytes: int = 128 << 20
    query_tile: int = 512
    gallery_tile: int = 8_192
    grid_rows: int = 65_536
    grid_bytes: int = 256 << 20
    #: tasks of a broadcast-query pass and so partial rows per query; None: four per core or shuffle partition
    partials: int | None = None


DEFAULT_LIMITS = Limits()


@dataclass(frozen=True)
class Space:
    """One scored modality: query column, gallery column, metric and scaling."""

    name: str
    q: str
    g: str
    metric: str = "cosine"
    tau: float = 1.0
    scale: float = 1.0
    factor: str | None = None  # gallery column whose value multiplies the scores of its row

    @property
    def gallery_columns(self) -> list[str]:
        return [self.g, self.factor] if self.factor else [self.g]

    def scores(self, q, g, known: dict | None = None) -> np.ndarray:
        """Scores of a tile; zero where a vector is missing (``gaps`` names the rows that then do not compete).

        ``known`` keeps the plain scores of the tile for spaces that differ in scaling only.
        """
        a, b = q[self.q], g[self.g]
        if a.shape[1] == 0 or b.shape[1] == 0:
            return np.zeros((len(a), len(b)))
        known = {} if known is None else known
        pair = (self.metric, self.q, self.g)
        if pair not in known:
            known[pair] = _metric(self.metric, a, b)
        s = self._scaled(known[pair])
        if self.factor:
            s = s * g[self.factor][None, :]
        empty_q, empty_g = q.get(f"_null_{self.q}"), g.get(f"_null_{self.g}")
        if s is known[pair] and not (empty_q is None and empty_g is None):
            s = s.copy()
        if empty_q is not None:
            s[empty_q] = 0.0
        if empty_g is not None:
            s[:, empty_g] = 0.0
        return s

    def truth(self, q) -> np.ndarray:
        """Score of each query's truth, whose vectors are in the gt_* columns."""
        a, b = q[self.q], q[f"gt_{self.g}"]
        if a.shape[1] == 0 or b.shape[1] == 0:
            return np.zeros(len(a))
        s = self.paired(a, b)
        if self.factor:
            s = s * q[f"gt_{self.factor}"]
        for name in (self.q, f"gt_{self.g}"):
            if f"_null_{name}" in q:
                s[q[f"_null_{name}"]] = 0.0
        return s

    def gap(self, q, g):
        """Pairs of a tile whose gallery row lacks the vector that the query asks for; None if there is none."""
        lacking = g.get(f"_null_{self.g}")
        if lacking is None or not lacking.any():
            return None
        return self._asks(q)[:, None] & lacking[None, :]

    def truth_gap(self, q):
        """Queries whose truth lacks the vector that they ask for; None if there is none."""
        lacking = q.get(f"_null_gt_{self.g}")
        return None if lacking is None or not lacking.any() else self._asks(q) & lacking

    def _asks(self, q):
        empty = q.get(f"_null_{self.q}")
        return np.ones(q["_n"], dtype=bool) if empty is None else ~empty

    def paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row-wise scores of two equally long matrices."""
        if self.metric == "neg_manhattan":
            s = -np.abs(a - b).sum(axis=1)
        elif self.metric == "neg_euclidean":
            sq = (a**2).sum(1) + (b**2).sum(1) - 2.0 * np.einsum("ij,ij->i", a, b)
            s = -np.sqrt(np.maximum(sq, 0.0))
        else:
            s = np.einsum("ij,ij->i", a, b)
            if self.metric == "angular":
                s = 1.0 - np.arccos(np.clip(s, -1.0, 1.0)) / np.pi
        return self._scaled(s)

    def _scaled(self, s):
        if self.tau != 1.0:
            s = s / self.tau
        return s * self.scale if self.scale != 1.0 else s


def _metric(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if name == "neg_manhattan":
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            out -= np.abs(a[:, k, None] - b[None, :, k])
        return out
    if name == "neg_euclidean":
        sq = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T)
        return -np.sqrt(np.maximum(sq, 0.0))
    s = a @ b.T
    if name == "angular":
        return 1.0 - np.arccos(np.clip(s, -1.0, 1.0)) / np.pi
    if name != "cosine":
        raise ValueError(f"unknown metric {name!r}")
    return s


CLIP_CLAP = (
    Space("v", "q_clip", "visual"),
    Space("t", "q_clip", "caption"),
    Space("a", "q_clap", "audio"),
)


def angular_spaces(tau_a: float = 0.5, scale_a: float = 1.0) -> tuple[Space, ...]:
    v, t, a = CLIP_CLAP
    return (
        replace(v, metric="angular"),
        replace(t, metric="angular"),
        replace(a, metric="angular", tau=tau_a, scale=scale_a),
    )


@dataclass(frozen=True)
class System:
    """A fused score: one weight per space, a number or a query column name."""

    name: str
    weights: tuple
    #: a weighted sum, whose error is the weighted sum of those of its scores
    sums = True

    def columns(self) -> list[str]:
        return [w for w in self.weights if isinstance(w, str)]

    def bars(self, spaces, q, sims, truth):
        """Per space and query: the score that a row ahead of the truth reaches in one space at least.

        A weighted sum with weights from zero on cannot reach another one without a
        part that does. None if a weight is below zero or not a number.
        """
        n = q["_n"]
        out = np.full((len(spaces), n), np.inf)
        for i, (w, space, s) in enumerate(zip(self.weights, spaces, sims)):
            w = q[w] if isinstance(w, str) else np.full(n, float(w))
            if w.dtype == object or not (w >= 0).all():
                return None
            used = (w > 0) & space._asks(q)
            out[i, used] = s[used] - 4 * SLACK / w[used]
        # all rows tie if nothing counts, and all may be ahead of a truth that does not compete
        out[0, (out == np.inf).all(axis=0) | ~np.isfinite(truth)] = -np.inf
        return out

    def pair_columns(self, q, rows) -> dict:
        """The query columns that ``fuse`` reads, for pairs of these queries."""
        return {w: q[w][rows] for w in self.weights if isinstance(w, str)}

    def slip(self, q, slips):
        """Bound of the error of a fused score, given those of its scores."""
        return sum((q[w] if isinstance(w, str) else w) * e for w, e in zip(self.weights, slips))

    def fuse(self, q, sims, gaps=()) -> np.ndarray:
        """Weighted sum of the scores.

        A gallery row without a vector that the query asks for with a weight
        other than zero does not compete: its score is -inf, whatever the
        metric. A query without a vector gives zero in that space to all rows.
        """
        total = None
        for w, s in zip(self.weights, sims):
            if not isinstance(w, str) and w == 0:
                continue
            if isinstance(w, str):
                w = q[w] if s.ndim == 1 else q[w][:, None]
            part = s if isinstance(w, (int, float)) and w == 1 else w * s
            total = part if total is None else total + part
        total = np.zeros_like(sims[0]) if total is None else total
        for w, gap in zip(self.weights, gaps):
            if gap is None or (not isinstance(w, str) and w == 0):
                continue
            if isinstance(w, str):
                gap = gap & ((q[w] if gap.ndim == 1 else q[w][:, None]) != 0)
            total = np.where(gap, -np.inf, total)
        return total


# ---------------------------------------------------------------- Arrow blocks


def to_block(table) -> dict:
    """Arrow columns as numpy: vectors become matrices, NULL vectors zero rows."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    block = {"_n": table.num_rows}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = (
                pa.concat_arrays(column.chunks)
                if column.num_chunks
                else pa.array([], column.type)
            )
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            block[name] = _matrix(column)
            if column.null_count:
                block[f"_null_{name}"] = ~np.asarray(column.is_valid())
        else:
            block[name] = column.to_numpy(zero_copy_only=False)
    return block


def _matrix(column) -> np.ndarray:
    valid = np.asarray(column.is_valid())
    kept = column.drop_null() if column.null_count else column
    if len(kept) == 0:
        return np.zeros((len(column), 0))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = flat.reshape(len(kept), -1)
    if len(kept) == len(column):
        return rows
    out = np.zeros((len(column), rows.shape[1]))
    out[valid] = rows
    return out


def split_block(block: dict, size: int) -> list[dict]:
    n = block["_n"]
    if n <= size:
        return [block] if n else []
    parts = []
    for lo in range(0, n, size):
        part = {k: v[lo : lo + size] for k, v in block.items() if k != "_n"}
        part["_n"] = min(size, n - lo)
        parts.append(part)
    return parts


def _collect_bounded(df: DataFrame, limits: Limits):
    """The rows of ``df`` as an Arrow table if they prove to fit the bound, else None."""
    if limits.broadcast_rows <= 0:
        return None
    table = df.limit(limits.broadcast_rows + 1).toArrow()
    if table.num_rows > limits.broadcast_rows or table.nbytes > limits.broadcast_bytes:
        return None
    return table


def truth_columns(columns) -> list[str]:
    return [f"gt_{c}" for c in columns]


def with_truth(queries: DataFrame, gallery: DataFrame, columns) -> DataFrame:
    """Queries with gt_* columns: the gallery columns of their truth (equi-join)."""
    truth = gallery.select(
        F.col("id").alias("truth"),
        *[F.col(c).alias(n) for c, n in zip(columns, truth_columns(columns))],
    )
    return queries.join(truth, "truth")


def _attach_truth(block: dict, table, gallery: DataFrame, columns) -> dict:
    """The same for queries already at hand.

    Only their ids go out, broadcast, so the gallery is read but not shuffled.
    """
    ids = pa.table({"id": table.column("truth").unique()})
    wanted = F.broadcast(gallery.sparkSession.createDataFrame(ids))
    found = to_block(gallery.select("id", *columns).join(wanted, "id").toArrow())
    order = np.argsort(found["id"], kind="stable")
    place = np.searchsorted(found["id"][order], block["truth"])
    hit = place < found["_n"]
    hit[hit] = found["id"][order][place[hit]] == block["truth"][hit]
    out = {k: v[hit] for k, v in block.items() if k != "_n"}
    for c, n in zip(columns, truth_columns(columns)):
        out[n] = found[c][order][place[hit]]
        if f"_null_{c}" in found:
            out[f"_null_{n}"] = found[f"_null_{c}"][order][place[hit]]
    out["_n"] = int(hit.sum())
    return out


def fits_broadcast(df: DataFrame, rows: int = 1_000_000) -> bool:
    """Does a narrow table prove to have no more rows than the bound?"""
    return df.limit(rows + 1).count() <= rows


def _cell_keys(spark, n: int) -> list[int]:
    """A key for each of ``n`` cells that hashing deals to a partition of its own."""
    place = F.pmod(F.hash("id"), F.lit(n)).alias("place")
    numbers = spark.range(0, 16 * n * (n.bit_length() + 1), 1, 1)
    found = {r["place"]: r["key"] for r in numbers.groupBy(place).agg(F.min("id").alias("key")).collect()}
    spare = (-1 - i for i in range(n))
    return [found[i] if i in found else next(spare) for i in range(n)]


def _cell_of(spark, n: int, number):
    """The key of the cell with that number; a long, as the keys were dealt: an int hashes to another partition."""
    return F.element_at(F.lit(_cell_keys(spark, n)).cast("array<bigint>"), number + 1)


def _grid(queries: DataFrame, gallery: DataFrame, limits: Limits) -> tuple[int, int]:
    """Blocks per side so that one holds at most ``grid_rows`` rows and ``grid_bytes``.

    A row is shuffled once per block of the other side, so blocks are as large
    as a task's memory allows; more are cut only to give every core a cell.
    """
    counts, blocks = [], []
    for df in (queries, gallery):
        row_bytes = max(1, df.limit(1).toArrow().nbytes)
        rows = max(1, min(limits.grid_rows, limits.grid_bytes // row_bytes))
        counts.append(df.count())
        blocks.append(max(1, math.ceil(counts[-1] / rows)))
    cells = 2 * queries.sparkSession.sparkContext.defaultParallelism
    while blocks[0] * blocks[1] < cells:
        larger = 0 if counts[0] / blocks[0] > counts[1] / blocks[1] else 1
        if counts[larger] / blocks[larger] < 2 * limits.query_tile:
            break
        blocks[larger] *= 2
    return blocks[0], blocks[1]


ROW = "_row"  # place of a query in the broadcast table


@dataclass(frozen=True)
class Merge:
    """How the partial rows of a query become one: an aggregate per value column.

    ``groups`` are columns that the kernel adds (system, space), ``keyed`` are
    columns of the queries that it hands on (the id first), ``values`` maps
    every other column to "sum", "min" or "max".
    """

    groups: tuple
    keyed: tuple
    values: dict

    def partial(self, schema: StructType) -> StructType:
        """What leaves a task if queries are known by their row number."""
        kept = [f for f in schema if f.name not in self.keyed]
        return StructType([*kept, StructField(ROW, LongType())])

    def aggregate(self, partial: DataFrame, by) -> DataFrame:
        return partial.groupBy(*by).agg(*[getattr(F, how)(c).alias(c) for c, how in self.values.items()])


def _tasks(sc, queries: DataFrame, limits: Limits) -> int:
    """Tasks of a broadcast-query pass.

    Shuffle partitions count as well as cores, for a cluster may still be
    adding executors when the plan is made.
    """
    if limits.partials:
        return limits.partials
    shuffle = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 4 * max(sc.defaultParallelism, shuffle)


def block_join(
    queries: DataFrame,
    gallery: DataFrame,
    kernel,
    schema: StructType,
    *,
    q_key: list[str],
    g_key: list[str],
    truth=(),
    merge: Merge | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """Run ``kernel`` over all query/gallery tiles; returns its rows.

    ``kernel`` offers ``start(q)``, ``update(state, q, g)`` and
    ``finish(state, q) -> dict``.  Without ``merge`` partial rows of one query
    may come from several tasks and the caller has to merge them; with it every
    query has one row per group, as ``Merge`` says.  ``truth`` names gallery
    columns the kernel needs of each query's truth, as gt_* columns; queries
    whose truth is not in the gallery then drop out.
    """
    limits = limits or DEFAULT_LIMITS
    arrow_schema = to_arrow_schema(schema)

    def emit(kernel_out, arrow_schema=arrow_schema):
        arrays = [
            pa.array(kernel_out[f.name], type=f.type, from_pandas=False)
            for f in arrow_schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    sc = queries.sparkSession.sparkContext
    small = _collect_bounded(queries, limits)
    if small is not None:
        block = to_block(small)
        if merge:
            block[ROW] = np.arange(block["_n"], dtype=np.int64)
        if truth and block["_n"]:
            block = _attach_truth(block, small, gallery, truth)
        q_blocks = sc.broadcast(split_block(block, limits.query_tile))
        partial_schema = merge.partial(schema) if merge else schema
        partial_arrow = to_arrow_schema(partial_schema)

        def past_gallery(batches):
            blocks = q_blocks.value
            states = [kernel.start(q) for q in blocks]
            seen = False
            for batch in batches:
                for g in split_block(to_block(batch), limits.gallery_tile):
                    seen = True
                    for i, q in enumerate(blocks):
                        states[i] = kernel.update(states[i], q, g)
            if seen:
                for state, q in zip(states, blocks):
                    yield emit(kernel.finish(state, q), partial_arrow)

        partial = gallery.coalesce(_tasks(sc, queries, limits)).mapInArrow(past_gallery, partial_schema)
        if merge is None:
            return partial
        merged = merge.aggregate(partial, [*merge.groups, ROW])
        columns = pa.table({ROW: np.arange(small.num_rows, dtype=np.int64)} | {c: small.column(c) for c in merge.keyed})
        typed = StructType([StructField(ROW, LongType()), *[queries.schema[c] for c in merge.keyed]])
        # a selection of the columns that were just proven to fit the bound
        columns = F.broadcast(queries.sparkSession.createDataFrame(columns, typed))
        return merged.join(columns, ROW).select(*schema.names)

    if truth:
        queries = with_truth(queries, gallery, truth)
    small = _collect_bounded(gallery, limits)
    if small is not None:
        g_blocks = sc.broadcast(split_block(to_block(small), limits.gallery_tile))

        def past_queries(batches):
            for batch in batches:
                for q in split_block(to_block(batch), limits.query_tile):
                    state = kernel.start(q)
                    for g in g_blocks.value:
                        state = kernel.update(state, q, g)
                    yield emit(kernel.finish(state, q))

        # a query meets the whole gallery in one task, its rows need no merge
        return queries.mapInArrow(past_queries, schema)

    n_q, n_g = _grid(queries, gallery, limits)

    def block_of(keys, n):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # cells are heavy and their rows few, so each gets a task of its own: by size some tasks would get several
    cell = _cell_of(queries.sparkSession, n_q * n_g, F.col("_bq") * n_g + F.col("_bg"))

    def dealt(df):
        return df.withColumn("_cell", cell).drop("_bq", "_bg").repartition(n_q * n_g, "_cell")

    left = dealt(queries.withColumn("_bq", block_of(q_key, n_q)).withColumn("_bg", every(n_g)))
    right = dealt(gallery.withColumn("_bg", block_of(g_key, n_g)).withColumn("_bq", every(n_q)))

    def one_cell(q_table, g_table):
        out = []
        if q_table.num_rows and g_table.num_rows:
            g_tiles = split_block(to_block(g_table), limits.gallery_tile)
            for q in split_block(to_block(q_table), limits.query_tile):
                state = kernel.start(q)
                for g in g_tiles:
                    state = kernel.update(state, q, g)
                out.append(emit(kernel.finish(state, q)))
        return pa.Table.from_batches(out, schema=arrow_schema)

    # fresh column identities: both sides may stem from the same table
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    partial = (
        left.groupBy("_cell")
        .cogroup(right.groupBy("_cell"))
        .applyInArrow(one_cell, schema)
    )
    if merge is None:
        return partial
    return merge.aggregate(partial, [*merge.groups, *merge.keyed]).select(*schema.names)
