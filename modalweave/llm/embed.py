"""Embedding near-duplicates through randomised-rotation binary codes.

A vector is rotated at random and kept as the signs of its coordinates with one
correction factor, the inner product of the unit vector and its code. From two
of these an unbiased estimate of a cosine follows, with a bound on its error;
only pairs whose upper bound reaches the threshold are computed exactly.
"""

from __future__ import annotations

from math import acos, ceil, log, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import pair_cells, pick
from .components import connected
from .simhash import candidates, grouped, stars

#: Width of the bound in standard errors.
EPSILON = 4.0
#: Vectors of the largest label that would share a key if they fell evenly.
SHARE = 32
#: Chance that a pair just at the threshold shares no key in any table.
MISS = 0.002
CHUNK = 1024


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables): keys as long as rows demand, tables so that a pair at the threshold is missed with MISS."""
    bits = max(4, min(30, ceil(log(max(2, rows / SHARE), 2))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(MISS) / log(1 - meet))


def rotations(dim: int, count: int, seed: int = 8):
    import numpy as np

    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)]


def code(unit, turns):
    """(signs as bytes, correction factor, coordinates in 255 steps as bytes, their scale) of unit vectors.

    The factor is the inner product of a vector and its unit code sign / sqrt(dim).
    """
    import numpy as np

    turned = unit @ turns[0]
    factor = np.abs(turned).sum(axis=1) / sqrt(unit.shape[1])
    scale = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned > 0, axis=1), factor, np.rint(turned / scale[:, None]).astype(np.int8), scale


def keys_of(unit, turns, bits: int, tables: int):
    """Table keys: each is ``bits`` signs under further rotations."""
    import numpy as np

    signs = np.concatenate([unit @ t for t in turns[1:]], axis=1)[:, : bits * tables] > 0
    return (signs.reshape(len(unit), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def upper_bound(signs, factor, steps, scale):
    """Upper confidence bound of the cosine of each pair: code of the one side, coordinates of the other.

    <code, y> / factor estimates <x, y> without bias; its error is at most
    EPSILON * sqrt(1 - factor^2) / factor / sqrt(dim - 1) with high confidence,
    and rounding y to steps moves <code, y> by half a step per coordinate at most.
    """
    import numpy as np

    dim = steps.shape[1]
    inner = np.einsum("ij,ij->i", signs, steps.astype(np.float32)) * scale / sqrt(dim)
    error = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0)) / sqrt(max(dim - 1, 1)) + scale * sqrt(dim) / 2
    return (inner + error) / factor


def _unit(vectors):
    import numpy as np

    x = np.stack(vectors).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(frame, by):
    import numpy as np

    group = frame[by].to_numpy()
    fresh = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    return fresh, np.diff(np.r_[fresh, len(frame)])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors link if their labels are equal and not null and the cosine in double
    precision is at least ``threshold``; every reported link is computed
    exactly. Null and zero vectors and vectors with null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal
    vectors of a label are one class, compared once, and count with the class's
    size. component_id is the least vec_id reachable, kept marks it. Columns
    other than vec_id, embedding and label are not read.

    Candidates share a key in one of several sign tables (see tables_for; recall
    is measured in the tests). Codes alone decide which pairs of a key are worth
    computing; full vectors travel only for rows with such a pair. A key shared
    by many vectors is cut into cells. A pair that meets in several tables
    counts in the first.
    """
    rows = pick(vectors, "vec_id", "embedding", "label")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(numbers, lambda x: x != 0)
    )
    rows = rows.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    classes = (
        rows.where("_ok").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.xxhash64("label", "embedding", "least")).withColumn("dim", F.size("embedding"))
    )
    classes = materialize(classes, "embed-classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    if most is None:
        most = 0
    bits, tables = tables_for(most, threshold)

    def turns_for(dim, memo={}):
        if dim not in memo:
            memo[dim] = rotations(dim, 1 + ceil(bits * tables / dim))
        return memo[dim]

    def coded(frames):
        import pandas as pd

        for frame in frames:
            for dim, part in frame.groupby("dim"):
                unit, turns = _unit(part["embedding"].tolist()), turns_for(dim)
                signs, factor, steps, scale = code(unit, turns)
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "factor": factor, "scale": scale,
                    "signs": [s.tobytes() for s in signs], "steps": [s.tobytes() for s in steps], "keys": keys_of(unit, turns, bits, tables).tolist(),
                })

    label = rows.schema["label"].dataType.simpleString()
    codes = classes.select("node", "label", "dim", "embedding").mapInPandas(
        coded, f"node bigint, label {label}, dim int, factor double, scale double, signs binary, steps binary, keys array<bigint>"
    )
    keyed = materialize(codes, "embed-codes").select(
        "node", "label", "dim", "factor", "scale", "signs", "steps", F.posexplode("keys").alias("table", "key")
    )
    by = ["label", "dim", "table", "key", "_i", "_j"]
    cells = pair_cells(keyed, ["label", "dim", "table", "key"], "node", CHUNK)

    def worth(frames):
        import numpy as np
        import pandas as pd

        for frame in grouped(frames, ["dim", *(b for b in by if b != "dim")]):
            for dim, part in frame.groupby("dim"):
                part = part.reset_index(drop=True)
                steps = np.frombuffer(b"".join(part["steps"]), np.int8).reshape(len(part), dim)
                packed = np.frombuffer(b"".join(part["signs"]), np.uint8).reshape(len(part), -1)
                signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
                factor, scale = part["factor"].to_numpy(), part["scale"].to_numpy()
                own, i, j = (part[c].to_numpy() for c in ("_own", "_i", "_j"))
                hit = np.zeros(len(part), bool)
                for a, b in candidates(*_groups(part, by), own, i, j, block=32):
                    near = upper_bound(signs[a], factor[a], steps[b], scale[b]) >= threshold
                    hit[a[near]] = True
                    hit[b[near]] = True
                yield pd.DataFrame({c: part[c][hit] for c in ("node", *by, "_own")})

    order = ["dim", *(b for b in by if b != "dim")]
    alive = cells.repartition(*by).sortWithinPartitions(*order).mapInPandas(
        worth, f"node bigint, label {label}, dim int, table int, key bigint, _i int, _j int, _own int"
    )
    full = alive.join(classes.select("node", "least", "copies", "embedding"), "node")

    def exact(frames):
        import numpy as np
        import pandas as pd

        for frame in grouped(frames, order):
            for dim, part in frame.groupby("dim"):
                part = part.reset_index(drop=True)
                unit = _unit(part["embedding"].tolist())
                keys = keys_of(unit, turns_for(dim), bits, tables)
                table = part["table"].to_numpy()
                own, i, j = (part[c].to_numpy() for c in ("_own", "_i", "_j"))
                copies, n_links = part["copies"].to_numpy(), np.zeros(len(part), np.int64)
                found = []
                for a, b in candidates(*_groups(part, by), own, i, j, block=32):
                    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                    a, b = a[near], b[near]
                    earlier = ((keys[a] == keys[b]) & (np.arange(tables)[None, :] < table[a][:, None])).any(axis=1)
                    a, b = a[~earlier], b[~earlier]
                    n_links += np.bincount(a, copies[b], len(part)).astype(np.int64) + np.bincount(b, copies[a], len(part)).astype(np.int64)
                    found.append((a, b))
                left, right = (np.concatenate([pair[k] for pair in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
                root = stars(left, right, part["node"].to_numpy())
                ids = part["node"].to_numpy()
                linked = n_links > 0
                yield pd.DataFrame({"a": ids[linked], "b": ids[root][linked], "links": n_links[linked]})

    met = full.repartition(*by).sortWithinPartitions(*order).mapInPandas(exact, "a bigint, b bigint, links bigint")
    met = materialize(met, "embed-links")
    counts = met.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = connected(met.select("a", "b"), "embed-edges")
    known = classes.select("label", "embedding", "node", "least", "copies").join(counts, "node", "left").join(found, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = rows.where("_ok").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
