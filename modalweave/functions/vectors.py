"""Vector expressions over ARRAY<DOUBLE> columns; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``.

    A sub-expression inside a lambda is evaluated per array element, so any
    per-row scalar is bound through a one-element transform first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v) -> Column:
    return col_of(v).cast("array<double>")


def vsum(v) -> Column:
    return F.aggregate(col_of(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col_of(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v) -> Column:
    """x / max(|x|, 1e-12): a zero vector stays zero."""
    v = col_of(v)
    return let(
        F.greatest(norm(v), F.lit(EPS)),
        lambda n: F.transform(v, lambda x: x / n),
    )


def add(a, b, scale_a: float = 1.0, scale_b: float = 1.0) -> Column:
    return F.zip_with(
        col_of(a), col_of(b), lambda x, y: x * F.lit(scale_a) + y * F.lit(scale_b)
    )


def scale(v, factor) -> Column:
    return F.transform(col_of(v), lambda x: x * factor)


def cosine(a, b) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def to_angular(cos: Column, tau: float = 1.0) -> Column:
    """1 - angle/pi of a cosine, divided by a temperature."""
    return (F.lit(1.0) - F.acos(clamp(cos, -1.0, 1.0)) / F.pi()) / F.lit(tau)


def angular(a, b, tau: float = 1.0) -> Column:
    return to_angular(dot(a, b), tau)


def neg_manhattan(a, b) -> Column:
    return -vsum(F.zip_with(col_of(a), col_of(b), lambda x, y: F.abs(x - y)))


def neg_euclidean(a, b) -> Column:
    return -F.sqrt(
        vsum(F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y) * (x - y)))
    )


def safe_cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


# Similarity registry: name -> Column x Column -> Column.
SIMILARITIES = {
    "cosine": cosine,
    "dot": dot,
    "angular": angular,
    "neg_manhattan": neg_manhattan,
    "neg_euclidean": neg_euclidean,
    "safe_cosine": safe_cosine,
}


def similarity(name: str, a, b) -> Column:
    try:
        return SIMILARITIES[name](a, b)
    except KeyError:
        raise ValueError(f"unknown similarity {name!r}") from None


def vmean(v) -> Column:
    return vsum(v) / F.size(col_of(v))


def zscore(v) -> Column:
    """(x - mean) / (sample std + 1e-8), over the components of one vector."""
    v = col_of(v)

    def centred(m):
        var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (
            F.size(v) - 1
        )
        return let(
            F.sqrt(var) + F.lit(1e-8),
            lambda sd: F.transform(v, lambda x: (x - m) / sd),
        )

    return let(vmean(v), centred)


def minmax(v) -> Column:
    v = col_of(v)
    return let(
        F.struct(
            F.array_min(v).alias("lo"),
            (F.array_max(v) - F.array_min(v) + F.lit(1e-8)).alias("width"),
        ),
        lambda b: F.transform(v, lambda x: (x - b["lo"]) / b["width"]),
    )


def power_normalize(v) -> Column:
    """Signed square root, then L2."""
    return l2_normalize(
        F.transform(col_of(v), lambda x: F.signum(x) * F.sqrt(F.abs(x)))
    )


def blend(a, b, alpha: float = 0.5) -> Column:
    """normalize(alpha*a + (1-alpha)*b); falls back to the part that exists."""
    a, b = col_of(a), col_of(b)
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .otherwise(l2_normalize(add(a, b, alpha, 1.0 - alpha)))
    )


def mean_of_present(parts) -> Column:
    """Normalised mean of the non-null vectors among ``parts``."""
    present = F.filter(F.array(*[col_of(p) for p in parts]), lambda p: p.isNotNull())
    total = F.aggregate(
        F.slice(present, 2, len(parts)),
        F.element_at(present, 1),
        lambda acc, p: F.zip_with(acc, p, lambda x, y: x + y),
    )
    return F.when(F.size(present) > 0, l2_normalize(scale(total, 1.0 / F.size(present))))


def pad(v, width: int) -> Column:
    v = col_of(v)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))


def checksum(v) -> Column:
    """Position-weighted sum; one number that changes with any component."""
    return vsum(F.transform(col_of(v), lambda x, i: x * (i + 1)))


def is_non_finite(v) -> Column:
    return F.exists(
        col_of(v), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )


def softmax(logits) -> list[Column]:
    """Stable softmax over a short fixed list of columns."""
    logits = [col_of(c) for c in logits]
    top = F.greatest(*logits)
    exps = [F.exp(c - top) for c in logits]
    total = reduce(lambda a, b: a + b, exps)
    return [e / total for e in exps]
