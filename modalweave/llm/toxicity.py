"""Toxicity by weak supervision.

Voters are words and word beginnings that occur significantly more often in
toxic training documents, and a few written patterns. Voters that nearly always
agree are joined. A generative model of the votes, fitted by EM, has a latent
class, a rate per voter and class, and correlations: given the class a voter
depends on at most one other, along the tree of the strongest significant
dependences. Its posterior labels train a linear classifier that scores all
documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import aside, documents, per_document, pick

WORDS = re.compile(r"[^\W_]+")
#: Lengths of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)

#: Patterns that vote whatever the labels say.
PATTERNS = {
    "#shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),
    "#insult": re.compile(r"\b(?:you|you're|u r)\s+(?:are\s+)?(?:an?\s+|such an?\s+)?(?:idiot|moron|loser|scum|trash|pathetic|stupid)", re.I),
    "#threat": re.compile(r"\b(?:kill|hurt|beat)\s+(?:you|yourself|them all)\b", re.I),
    "#marks": re.compile(r"[!?]{4}"),
}


def terms(word: str) -> tuple[str, ...]:
    """A lower-cased word and its beginnings (marked by a star)."""
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n))


def features(text: str, cache: dict | None = None) -> set[str]:
    """All distinct terms and patterns of a whole text."""
    found = {name for name, p in PATTERNS.items() if p.search(text)}
    for word in set(WORDS.findall(text.lower())):
        found.update(terms(word))
    return found


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 when divided by five."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


@dataclass
class Model:
    """Weights of features; score = sigmoid(bias + sum of the weights of those present)."""

    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)
    voters: list[list[str]] = field(default_factory=list)
    rates: list[tuple[float, float]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)

    def scorer(self):
        from math import exp

        whole = {k: v for k, v in self.weights.items() if k[0] != "#"}
        marks = {k: v for k, v in self.weights.items() if k[0] == "#" and v}

        class Known(dict):
            """Terms with a weight of each word seen; most words have none."""

            def __missing__(self, word):
                if len(self) > 1 << 18:
                    self.clear()
                self[word] = out = tuple(t for t in terms(word) if t in whole)
                return out

        known = Known()

        def score(text):
            hit = set()
            for word in set(WORDS.findall(text.lower())):
                hit.update(known[word])
            total = self.bias + sum(whole[t] for t in sorted(hit))
            total += sum(w for k, w in marks.items() if PATTERNS[k].search(text))
            return 1 / (1 + exp(-max(-30.0, min(30.0, total))))

        return score


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out fold, at most ``max_rows`` by hash of the id."""
    marked = pick(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows)
    return documents(docs).join(F.broadcast(chosen), "doc_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, in toxic, in clean documents), counted inside each task first."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts = {0: Counter(), 1: Counter()}

        def flush():
            seen = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_pydict(
                {"term": pa.array(seen, pa.string()), "toxic": pa.array([counts[1][t] for t in seen], pa.int64()), "clean": pa.array([counts[0][t] for t in seen], pa.int64())}
            )
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[1 if toxic else 0].update(features(text))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield flush()
        yield flush()

    parts = rows.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def independent(votes, limit: float = 0.5) -> list[list[int]]:
    """Voters in groups: those whose votes overlap by ``limit`` (Jaccard) or more count as one."""
    import numpy as np

    both = votes.T @ votes
    ones = np.diag(both)
    overlap = both / np.maximum(ones[:, None] + ones[None, :] - both, 1)
    left, groups = list(range(len(ones))), []
    while left:
        group, edge = {left[0]}, [left[0]]
        while edge:
            near = [j for j in left if j not in group and overlap[edge[-1], j] >= limit]
            edge.pop()
            group.update(near)
            edge += near
        groups.append(sorted(group))
        left = [j for j in left if j not in group]
    return groups


def label_model(votes, start, prior: float, rounds: int = 50, weight=None):
    """EM over a latent class with independent voters: (posterior of each row, rates per voter given toxic and clean).

    weight: how many training rows each row of votes stands for (one by default).
    """
    import numpy as np

    weight = np.ones(len(votes)) if weight is None else weight
    n = weight.sum()
    rates, posterior = np.clip(start, 1e-4, 1 - 1e-4), None
    for _ in range(rounds):
        on = np.log(rates[:, 0] / rates[:, 1])
        off = np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))
        odds = np.log(prior / (1 - prior)) + votes @ (on - off) + off.sum()
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if posterior is not None and np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
        toxic, clean = weight * new, weight * (1 - new)
        prior = float(np.clip(toxic.sum() / n, 1 / (n + 2), 1 - 1 / (n + 2)))
        rates = np.stack([(votes.T @ toxic + 0.1) / (toxic.sum() + 1), (votes.T @ clean + 0.1) / (clean.sum() + 1)], axis=1)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
    return posterior, rates


def dependence(votes, posterior, weight):
    """2 n x the mutual information of each two voters given the class: about chi-square with two degrees of freedom if they are independent."""
    import numpy as np

    found = np.zeros((votes.shape[1],) * 2)
    for share in (weight * posterior, weight * (1 - posterior)):
        n, ones = share.sum(), votes.T @ share
        both = votes.T @ (votes * share[:, None])
        for seen, one, two in (
            (both, ones[:, None], ones[None, :]),
            (ones[:, None] - both, ones[:, None], n - ones[None, :]),
            (ones[None, :] - both, n - ones[:, None], ones[None, :]),
            (n - ones[:, None] - ones[None, :] + both, n - ones[:, None], n - ones[None, :]),
        ):
            seen = np.maximum(seen, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                found += 2 * np.nan_to_num(seen * np.log(seen * n / (one * two)), nan=0.0, posinf=0.0, neginf=0.0)
    np.fill_diagonal(found, 0)
    return found


def strongest_tree(strength, level: float = 0.05) -> list[int]:
    """The parent of each voter (-1: none) in the forest of greatest total strength over the significant pairs.

    A pair is significant if chance reaches its strength with probability below
    level / number of pairs (exp(-x / 2) for two degrees of freedom). Equal
    strengths go to the first voter.
    """
    import numpy as np

    n = len(strength)
    least = 2 * np.log(max(1, n * (n - 1) // 2) / level)
    usable = np.where(strength >= least, strength, 0.0)
    parent, best, left = np.full(n, -1), np.zeros(n), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -1.0)))
        left[at] = False
        closer = left & (usable[at] > best)
        best[closer], parent[closer] = usable[at][closer], at
    return parent.tolist()


def log_loss(posterior, marked, weight) -> float:
    import numpy as np

    p = np.clip(posterior, 1e-9, 1 - 1e-9)
    return float(-(weight * (marked * np.log(p) + (1 - marked) * np.log(1 - p))).sum())


def correlated_model(votes, posterior, parents, weight=None, rounds: int = 50, marked=None):
    """EM over a latent class in which a voter depends on its parent as well, from the given posterior.

    marked: the labels of the training rows, where known. Rounds then end with
    the last one that brought the posterior nearer to them (log loss), as a latent
    class with free correlations may turn into some other grouping of the texts.

    (posterior of each row, rates[class, vote of the parent, voter]; class 0 is
    toxic). A rate given a vote of the parent is drawn to the rate without it by
    the weight of one row, as few rows may show that vote.
    """
    import numpy as np

    weight = np.ones(len(votes)) if weight is None else weight
    parents = np.asarray(parents)
    led = np.where(parents >= 0, votes[:, parents], 0)
    rates = np.empty((2, 2, votes.shape[1]))
    for _ in range(rounds):
        odds, n = 0.0, weight.sum()
        for c, share in enumerate((weight * posterior, weight * (1 - posterior))):
            total, ones = share.sum(), votes.T @ share
            alone = (ones + 0.1) / (total + 1)
            with_parent, both = led.T @ share, (votes * led).T @ share
            rates[c, 0] = (ones - both + alone) / (total - with_parent + 1)
            rates[c, 1] = (both + alone) / (with_parent + 1)
            low, high = np.clip(rates[c], 1e-5, 1 - 1e-5)
            fact = (
                np.log(1 - low).sum() + votes @ (np.log(low) - np.log(1 - low)) + led @ (np.log(1 - high) - np.log(1 - low))
                + (votes * led) @ (np.log(high) - np.log(1 - high) - np.log(low) + np.log(1 - low))
            )
            odds = odds + (1 - 2 * c) * (np.log(np.clip(total / n, 1 / (n + 2), 1)) + fact)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if marked is not None and log_loss(new, marked, weight) >= log_loss(posterior, marked, weight):
            break
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-6:
            break
    return posterior, rates


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_voters: int = 400) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, with at most ``max_voters`` mined voters.

    labels (doc_id, toxic): null labels are left out, of several labels of one
    document the highest counts. Without toxic or without clean rows the model
    has no voters and every score is below one half. What reaches the driver is
    bounded by the two parameters: the voters and, per training row, the numbers of
    its voters.
    """
    import numpy as np

    rows = materialize(training_rows(docs, labels, max_rows), "toxicity-rows")
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model()
    counted = materialize(term_counts(rows).where("toxic >= 3"), "toxicity-terms")
    tested = max(1, counted.count())
    # a term in k toxic of n documents by chance: k log(k / expected) - (k - expected) bounds -log p (Chernoff)
    expected = (F.col("toxic") + F.col("clean")) * (toxic / (toxic + clean))
    gain = F.col("toxic") * F.log(F.col("toxic") / expected) - (F.col("toxic") - expected)
    lift = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    sure = (gain >= float(np.log(tested * 20))) & (lift >= 4)
    mined = counted.where(sure | F.col("term").startswith("#")).withColumn("gain", gain)
    voters = mined.orderBy(F.desc("gain"), "term").limit(max_voters).collect()
    if not voters:
        return Model()
    names = [v["term"] for v in voters]
    place = {t: i for i, t in enumerate(names)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hits = [sorted(place[t] for t in features(x) if t in place) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"hits": pa.array(hits, pa.list_(pa.int32())), "toxic": batch.column("toxic")})

    patterns = rows.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(run, "hits array<int>, toxic boolean")
    hit = patterns.groupBy("hits", "toxic").count().collect()
    table = np.zeros((len(hit), len(names)))
    for i, h in enumerate(hit):
        table[i, h["hits"]] = 1
    weight = np.array([h["count"] for h in hit], dtype=float)
    marked = np.array([h["toxic"] for h in hit], dtype=float)
    groups = independent(table * np.sqrt(weight)[:, None])
    joint = np.stack([table[:, g].max(axis=1) for g in groups], axis=1)
    mined_rate = np.array([[v["toxic"] / toxic, (v["clean"] + 0.1) / clean] for v in voters])
    start = np.stack([mined_rate[g].max(axis=0) for g in groups])
    # dependence is judged given the labels: a free latent class would take two dependent voters for the class itself
    parents = strongest_tree(dependence(joint, marked, weight))
    first, _ = label_model(joint, start, toxic / (toxic + clean), rounds=1, weight=weight)
    soft, _ = correlated_model(joint, first, parents, weight, marked=marked)
    rates = np.stack([joint.T @ (weight * w) / max((weight * w).sum(), 1e-9) for w in (soft, 1 - soft)], axis=1)
    bias, learnt = linear(table, soft, weight)
    return Model(
        bias, dict(zip(names, learnt.tolist())), [[names[j] for j in g] for g in groups], [tuple(r) for r in rates.tolist()], parents
    )


def linear(table, target, weight, penalty: float = 0.02, rounds: int = 60):
    """Logistic regression on soft labels by Newton steps: (bias, weights)."""
    import numpy as np

    x = np.c_[np.ones(len(table)), table]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, a null text as the empty one; only texts are read."""
    return per_document(documents(docs), "score double", lambda: (lambda f: lambda text: (f(text),))(model.scorer()))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns as they are."""
    held, back = aside(docs, "text")

    def run(batches):
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            keep = [score(t or "") < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return back(held.mapInArrow(run, held.schema))
