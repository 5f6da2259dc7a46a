"""Operators across documents against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_helpers import texts_of
from pyspark.sql import functions as F

from modalweave.llm import chat, components, embed, imatch, packing, simhash, suffix


def mutated(n, seed, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta")):
    """Texts, copies, near copies and shared passages."""
    rng = random.Random(seed)
    made = []
    passage = " ".join(rng.choice(words) for _ in range(30))
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not made:
            t = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 60)))
        elif kind < 0.6:
            t = rng.choice(made)
        elif kind < 0.8:
            t = rng.choice(made)
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(["é", "", " more words", "X"]) + t[at + rng.randint(0, 3) :]
        else:
            t = rng.choice(made)[:40] + passage[rng.randint(0, 40) :] + rng.choice(made)[-30:]
        made.append(t)
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, made))


# ------------------------------------------------------------------ components


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)] + edges[:10]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ simhash


def print_of(t):
    w = t.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_brute(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(print_of(t), []).append(i)
    keys = list(prints)
    linked = [(x, y) for k, x in enumerate(keys) for y in keys[:k] if (x ^ y).bit_count() <= 3]
    root = roots(keys, linked)
    least = {}
    for f, r in root.items():
        ids = [i for i in prints[f] if i is not None]
        if ids:
            least[r] = min([least.get(r, ids[0]), *ids])
    return Counter((i, f, least.get(root[f])) for f, ids in prints.items() for i in ids)


def test_simhash_equals_brute_force(spark, docs, odd, none):
    made = spark.createDataFrame(mutated(250, 3), "doc_id long, text string")
    for df in (docs, odd, made):
        rows = texts_of(df)
        got = Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == simhash_brute(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_hot_keys_and_chunks(spark):
    """Many fingerprints around a few centres: every chunk size connects the same."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(120)})
    brute = roots(prints, [(x, y) for k, x in enumerate(prints) for y in prints[:k] if (x ^ y).bit_count() <= 3])
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fingerprint long")
    at = {p: i for i, p in enumerate(prints)}
    for chunk in (2048, 40, 7):
        edges = [tuple(r) for r in simhash.links(df, chunk=chunk).collect()]
        got = roots(range(len(prints)), edges)
        assert got == {at[p]: at[r] for p, r in brute.items()}


def test_one_of_each_class_stays(spark):
    rows = [(3, "same words in here", "a"), (1, "same words in here", "b"), (2, "something else entirely now", "c"), (9, None, "d"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.keep_first(df, simhash.near_duplicates(df), simhash.fingerprints)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 8]


@pytest.mark.parametrize("classes, marks", [(simhash.near_duplicates, simhash.fingerprints), (simhash.similar_documents, simhash.words_digest)])
def test_rows_of_one_id_are_told_apart(spark, odd, none, classes, marks):
    """Of each class one row stays; a repeated id neither saves nor takes along its other rows."""
    a, b, c = ("%s one two three four five six seven" % w for w in ("alpha", "beta beta beta", "gamma delta"))
    rows = [(3, a), (14, a), (14, b), (30, c), (30, c), (None, "no id at all here"), (None, "no id at all here"), (None, "another lone one of its own"), (None, a)]
    df = spark.createDataFrame([(i, t, [1], {"k": 2}) for i, t in rows], "doc_id long, text string, Text array<int>, _row map<string,int>")
    kept = simhash.keep_first(df, classes(df), marks)
    wanted = [(3, a), (14, b), (30, c), (None, "no id at all here"), (None, "another lone one of its own")]
    assert kept.columns == df.columns and kept.schema == df.schema
    assert Counter((r[0], r[1]) for r in kept.collect()) == Counter(wanted)
    assert all(r[2] == [1] and r[3] == {"k": 2} for r in kept.collect())
    assert simhash.keep_first(none, classes(none), marks).count() == 0
    found = classes(odd)
    assert simhash.keep_first(odd, found, marks).count() == found.select("component").distinct().count()


def similar_brute(rows, words=5, similarity=0.8):
    """(doc_id, component) by all pairs of distinct word sequences; spacing and the case of A-Z do not matter."""
    nodes = {}
    for i, t in rows:
        nodes.setdefault(tuple(t.encode().lower().split()), []).append(i)
    keys = list(nodes)
    sets = [{w[k : k + words] for k in range(max(1, len(w) - words + 1))} if w else set() for w in keys]
    holders = {}
    for n, one in enumerate(sets):
        for x in one:
            holders.setdefault(x, []).append(n)
    linked = []
    for n, one in enumerate(sets):
        shared = Counter(m for x in one for m in holders[x] if m < n)
        linked += [(n, m) for m, k in shared.items() if k / (len(one) + len(sets[m]) - k) >= similarity]
    root = roots(range(len(keys)), linked)
    least = {}
    for n, r in root.items():
        ids = [i for i in nodes[keys[n]] if i is not None]
        if ids:
            least[r] = min([least.get(r, ids[0]), *ids])
    return Counter((i, least.get(root[n])) for n, w in enumerate(keys) for i in nodes[w])


def edited(groups, seed):
    """Texts in groups of edited copies, from a few changed words to half of them; some in other case and spacing."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((3, 5, 9, 40, 200)))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows), rng.choice((" ", "  ", "\n")).join(words)))
            if rng.random() < 0.1:
                rows.append((len(rows), rows[-1][1].upper()))
    return rows


def test_similar_texts_equal_brute_force(spark, docs, odd, none):
    made = spark.createDataFrame(edited(60, 8), "doc_id long, text string")
    for df in (docs, odd, made):
        got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect())
        assert got == similar_brute(texts_of(df))
    assert simhash.similar_documents(none).count() == 0
    with pytest.raises(ValueError):
        simhash.similar_documents(docs, similarity=0.5)


def test_similar_short_texts_with_distant_fingerprints(spark):
    """Texts of eight and nine words (similarity 0.8) whose fingerprints differ in more than 20 of 64 bits."""
    words = {k: [f"w{k}x{i}" for i in range(9)] for k in (294, 308, 357, 895, 928, 995, 1079, 1332, 1400, 1511)}
    rows = [(2 * k + n, " ".join(w[: 9 - n])) for k, w in words.items() for n in (0, 1)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {2 * k + n: 2 * k for k in words for n in (0, 1)}


def test_near_fingerprints_are_searched_before_the_bands(spark, monkeypatch):
    """Classes of fingerprints within three bits give their links without any band, and leave settled bands out of the second search."""
    rng, rows = random.Random(11), []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(400)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            words = list(words)
            words[rng.randrange(400)] = "x"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, left = simhash.similar_links, []

    def no_bands(texts, sets, similarity, **given):
        left.append(plain(texts, sets, similarity, **given).count())
        return texts.selectExpr("node AS a", "node AS b").limit(0)

    monkeypatch.setattr(simhash, "similar_links", no_bands)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(df, 5).collect()}
    root = roots(prints, [(x, y) for x in prints for y in range(x) if ((prints[x] ^ prints[y]) & (1 << 64) - 1).bit_count() <= 3])
    assert got == root and len(set(root.values())) < 40
    # a group that is one class by its fingerprints has no band left to search
    whole = [4 * k for k in range(12) if len({root[4 * k + n] for n in range(4)}) == 1]
    assert whole
    one = df.where(F.col("doc_id").between(whole[0], whole[0] + 3))
    assert {r["component_id"] for r in simhash.similar_documents(one).collect()} == {whole[0]} and left[1] == 0 < left[0]


def test_similar_texts_in_hot_keys_and_chunks(spark):
    """One large group of near copies in which many pairs are below the similarity: every chunk size connects the same."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(words)))
    wanted = similar_brute(rows)
    table = simhash.sketches(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["node"]).cache()
    node = {r["node"]: r["doc_id"] for r in table.select("node", "doc_id").collect()}
    for chunk in (512, 40, 7):
        edges = [(node[a], node[b]) for a, b in simhash.similar_links(table, table.select("node", "shingles"), 0.8, chunk).collect()]
        root = roots(node.values(), edges)
        least = {}
        for i, r in root.items():
            least[r] = min(least.get(r, i), i)
        same = {rows[i][1]: least[r] for i, r in root.items()}
        groups = {}
        for i, t in rows:
            groups.setdefault(same[t], []).append(i)
        assert Counter((i, min(g)) for g in groups.values() for i in g) == wanted, chunk
    assert len(node) > 100


# ------------------------------------------------------------------ suffix arrays


def repeats_brute(rows, window=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = t.encode()
            for s in range(len(b) - window + 1):
                w = b[s : s + window]
                first[w] = min(i, first.get(w, i))
    out = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for s in range(len(b) - window + 1):
                if first[b[s : s + window]] < i:
                    gone[s : s + window] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeats_of(df):
    return Counter(
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in suffix.deduplicate(df).collect()
    )


def test_repeats_equal_brute_force(spark, docs, odd, none):
    made = spark.createDataFrame(mutated(300, 5), "doc_id long, text string")
    few = spark.createDataFrame([(i, "".join(random.Random(i % 7).choice("ab") for _ in range(200 + i))) for i in range(40)], "doc_id long, text string")
    for df in (docs, odd, made, few):
        assert repeats_of(df) == repeats_brute(texts_of(df))
    assert suffix.deduplicate(none).count() == 0


def test_repeats_with_crowded_anchors_slices_and_many_groups(spark, monkeypatch):
    rows = mutated(200, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats_brute(rows)
    for name, value in (("CROWD", 1), ("SLICE", 300), ("ARRAY_BYTES", 500), ("BUCKET_BYTES", 2000), ("GROUP_BYTES", 500)):
        monkeypatch.setattr(suffix, name, value)
        assert repeats_of(df) == want


def test_bwt_levels_equal_sorted_prefixes():
    rng = random.Random(7)
    for alphabet in ("ab", "abcdefgh", "a"):
        data = np.frombuffer("".join(rng.choice(alphabet) for _ in range(400)).encode() + b"\xff", np.uint8)
        raw = data.tobytes()
        order, boundary = suffix.repeated_prefixes(data, 12)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :][:12], raw[order[k] :][:12]
            if b"\xff" not in a and b"\xff" not in b and len(a) == len(b) == 12:
                assert boundary[k] == (a != b)


def test_texts_without_repeats_keep_columns_and_nulls(spark):
    line = "this very passage stands in more than one of the documents, é included"
    rows = [(1, line, "en", 1), (2, "before " + line + " after", "fr", 2), (3, None, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = suffix.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, line, "en", 1), (2, "before  after", "fr", 13), (3, None, "de", None)]


# ------------------------------------------------------------------ embeddings


def links_brute(rows, threshold=0.93):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    u = [unit(r[1]) for r in rows]
    links = [0] * len(rows)
    edges = []
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is None or u[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(u[i]) != len(u[j]):
                continue
            if u[i] @ u[j] >= threshold:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    root = roots(range(len(rows)), edges)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], links[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


def vectors(seed, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i < 40 or rng.random() < 0.2:
            v = rng.normal(size=dim)
        else:
            base = np.array(rows[rng.integers(0, len(rows))][1])
            v = base * rng.choice([1, 1, 3]) + rng.choice([0, 0, 0.02, 0.25]) * np.linalg.norm(base) * rng.normal(size=dim) / np.sqrt(dim)
        rows.append([int(i * 7 % n), [float(np.float32(x)) for x in v], int(i % 3)])
    return rows


def test_embedding_links_equal_brute_force(spark):
    schema = "vec_id long, embedding array<float>, label int"
    odd = [
        (900, None, 1), (901, [0.0] * 24, 1), (902, [1.0, None] + [0.0] * 22, 1), (903, [float("nan")] * 24, 1), (904, [float("inf")] * 24, 1),
        (905, [1.0] * 24, None), (906, [1.0] * 24, None), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [], 1), (910, [1.0], 1), (911, [-1.0], 1),
    ]
    found = want = 0
    for seed in (1, 2):
        rows = vectors(seed) + [list(r) for r in odd]
        df = spark.createDataFrame([tuple(r) + ("x",) for r in rows], schema + ", n_links string")
        got = Counter(tuple(r) for r in embed.near_duplicates(df).collect())
        brute = links_brute(rows)
        found += sum(k[1] * n for k, n in got.items())
        want += sum(k[1] * n for k, n in brute.items())
        assert {k[0] for k in got} == {k[0] for k in brute}
    assert found <= want and found >= 0.99 * want, (found, want)
    assert embed.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embedding_cells_agree(spark, monkeypatch):
    rows = vectors(3, 400)
    df = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<float>, label int")
    one = Counter(tuple(r) for r in embed.near_duplicates(df).collect())
    monkeypatch.setattr(embed, "CHUNK", 9)
    assert Counter(tuple(r) for r in embed.near_duplicates(df).collect()) == one


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 4000, 64)))
    y = y + x * rng.uniform(0, 3, size=(4000, 1))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turns = embed.rotations(64, 1)
    (signs, factor, _, _), (_, _, steps, scale) = embed.code(x, turns), embed.code(y, turns)
    bits = np.unpackbits(signs, axis=1, count=64).astype(np.float32) * 2 - 1
    true = (x * y).sum(axis=1)
    inner = np.einsum("ij,ij->i", bits, steps.astype(np.float32)) * scale / 8 / factor
    assert abs((inner - true).mean()) < 0.01
    assert (embed.upper_bound(bits, factor, steps, scale) >= true).mean() > 0.999


# ------------------------------------------------------------------ packing


def test_borders_are_optimal():
    from itertools import combinations

    rng = random.Random(8)
    for _ in range(60):
        tops = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        rows = [(t, n := rng.randint(1, 9), n * t - rng.randint(0, n - 1)) for t in tops]
        for k in (1, 2, 3, 12):
            got = packing.borders(rng.sample(rows, len(rows)), k)

            def waste(cut):
                return sum(n * min(c for c in cut if c >= t) - s for t, n, s in rows)

            best = min(waste([*c, tops[-1]]) for c in combinations(tops[:-1], min(k, len(tops)) - 1))
            assert got[-1] == tops[-1] and len(got) <= k and waste(got) == best
    assert packing.borders([], 4) == []


def test_borders_of_many_lengths_equal_the_plain_recurrence():
    """Lengths far apart and in the thousands, against the quadratic recurrence."""
    rng = np.random.default_rng(9)
    for m, k in ((700, 12), (300, 2), (5, 9)):
        top = np.sort(rng.choice(np.unique((rng.lognormal(6, 2, 5000)).astype(np.int64)), m, replace=False))
        n = rng.integers(1, 10**6, m)
        rows = np.stack([top, n, n * top], axis=1)
        cost = [0] + [None] * m
        for _ in range(min(k, m)):
            new = [None] * (m + 1)
            for j in range(1, m + 1):
                took = [cost[i] + int((n[i:j] * (top[j - 1] - top[i:j])).sum()) for i in range(j) if cost[i] is not None]
                new[j] = min(took, default=None)
            cost = new
        got = np.array(packing.borders(rng.permutation(rows), k))
        assert int((n * (got[np.searchsorted(got, top)] - top)).sum()) == cost[m]


def test_long_lengths_are_packed_exactly(spark):
    """Lengths beyond the grid's exact part: no padding where there are as many buckets as lengths."""
    rows = [(i, n) for i, n in enumerate([70_001, 70_003, 9_999, 5_000_001, None, 0, 4_097])]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    exact = packing.pack(sized, buckets=7).collect()
    assert len(exact) == 7 and all(r["padded_length"] == (r["n_tokens"] or 0) for r in exact)
    assert all(r["padded_length"] >= (r["n_tokens"] or 0) for r in packing.pack(sized, buckets=7, grid=True).collect())


def test_batches_hold_every_row_within_budget(spark, odd, docs, none, tokens, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 5)
    for df in (odd, docs):
        for budget in (300, 100_000):
            out = packing.pack_documents(df, *tokens, budget=budget, buckets=4).collect()
            assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in texts_of(df))
            batches = {}
            for r in out:
                assert r["n_tokens"] <= r["padded_length"]
                batches.setdefault((r["bucket"], r["batch"]), []).append(r)
            for (bucket, batch), rows in batches.items():
                fit = max(1, budget // max(1, rows[0]["padded_length"]))
                assert sorted(r["place"] for r in rows) == list(range(len(rows))) and len(rows) <= fit
                if (bucket, batch + 1) in batches:
                    assert len(rows) == fit
    assert packing.pack_documents(none, *tokens).count() == 0


def test_grid_is_exact_then_relative(spark):
    df = spark.range(1, 400).select((F.col("id") * F.col("id")).alias("n")).withColumn("s", packing.slot(F.col("n")))
    for r in df.collect():
        assert r["s"] == r["n"] if r["n"] <= 4096 else r["n"] <= r["s"] <= r["n"] * (1 + 1 / 256)


# ------------------------------------------------------------------ chat


def chat_brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def conversations(seed):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "\\", "|>", "\n", "hello ", "é😀", "assistant\n", "%0A", "%", "ok "]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 60) if c else 400):
            role = rng.choice(["user", "assistant", "system" if t < 3 else "user", None, "to\nol", "<|im_end|>%"])
            rows.append((c if c != 5 else None, t if rng.random() > 0.05 else None, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))])))
    return rows + rows[:5]


def test_conversations_read_back_whole(spark, tokens, monkeypatch):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    want = chat_brute(rows)
    for share, block in ((4096, 32), (7, 2)):
        monkeypatch.setattr(chat, "SHARE", share)
        monkeypatch.setattr(chat, "BLOCK", block)
        for budget, history in ((100, 30), (2048, 256)):
            out = chat.windows(df, *tokens, budget=budget, history=history)
            got = {r["conv_id"]: tuple(r)[1:5] for r in chat.summary(out).collect()}
            assert got == want
            for r in out.collect():
                assert r["over_budget"] == (r["n_tokens"] > budget)
                if r["over_budget"]:
                    assert r["n_turns"] - r["n_repeated"] == 1
                turns = chat.read_turns(r["formatted"])
                assert len(turns) == r["n_turns"]
                spoken = [t for role, t in turns[r["n_repeated"] :] if role == "assistant"]
                assert [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]] == spoken
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(empty, *tokens).count() == 0


def test_windows_repeat_system_and_history(spark, tokens):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2 == 0], f"turn number {t} says a few words") for t in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, *tokens, budget=120, history=40).orderBy("block", "window").collect()
    assert len(out) > 3
    for r in out[1:]:
        turns = chat.read_turns(r["formatted"])
        assert turns[0] == ("system", "be kind") and r["n_repeated"] >= 1 and not r["over_budget"]
    assert any(r["n_repeated"] > 1 for r in out)


# ------------------------------------------------------------------ I-Match


def test_imatch_neighbours_and_likeness(spark, docs, odd, none):
    for df in (docs, odd):
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        got = imatch.match(df).collect()
        want = Counter()
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        by_text = {}
        of = {}
        for r in got:
            of.setdefault(r["doc_id"], []).append(r["fingerprint"])
        for i, t in rows:
            if len(of[i]) == 1:
                by_text.setdefault(t, set()).update(of[i])
        assert all(len(v) == 1 for v in by_text.values())
    assert imatch.match(none).count() == 0


@pytest.mark.parametrize("quantiles", [1024, 4])
def test_imatch_order_over_many_ranges(spark, monkeypatch, quantiles):
    monkeypatch.setattr(imatch, "SHARE", 3)
    monkeypatch.setattr(imatch, "QUANTILES", quantiles)
    ids = random.Random(9).sample(range(-(1 << 60), 1 << 60), 90)
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = imatch.in_order(df).where("_own").collect()
    line = sorted(ids)
    text = {i: f"text {k}" for k, i in enumerate(ids)}
    assert {r["doc_id"]: r["next_text"] for r in rows} == {i: text[line[(k + 1) % len(line)]] for k, i in enumerate(line)}


def test_imatch_hashes_follow_the_band(spark):
    texts = ["common rare%d word%d" % (i, i % 5) for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = {r["term"]: r["df"] for r in imatch.lexicon(df, rare=10, common=0.2).collect()}
    assert sorted(kept.values()) == [8] * 5


def xx(value, seed):
    """Spark's 64-bit hash of a string, or of a whole number of the given width."""
    data = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64(data, seed=seed).intdigest()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def imatch_brute(rows, rare=5_000, common=0.2):
    """(doc_id, fingerprint, edited fingerprint, likeness to it, likeness to the next) by plain Python."""
    import regex

    def words(text):
        return {signed(xx(w, 42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    df = Counter(w for _, t in rows for w in words(t))
    n, mask = len(rows), (1 << 64) - 1
    band = {w for w, k in df.items() if n / rare <= k <= max(1.0, common * n)}
    pack = lambda x: (x & mask).to_bytes(8, "little")
    subsets = {
        w: {i for i, rate in enumerate(imatch.RATES) if signed(xx((101 + i).to_bytes(4, "little"), xx(pack(w), 42))) % (1 << 20) < int(rate * (1 << 20))}
        for w in band
    }

    def hashes(text):
        kept = sorted(words(text) & band)
        out = []
        for i in range(len(imatch.RATES)):
            h, mine = 42, [w for w in kept if i in subsets[w]]
            for w in mine:
                h = xx(pack(w), h)
            out.append(h if mine else None)
        return out

    def alike(a, b):
        used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    show = lambda hs: ".".join("-" if h is None else f"{h & 0xFFFFFFFF:08x}" for h in hs)
    prints = [hashes(t) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % n][1], len(t) // 2
        edited = hashes(t[: len(t) - half] + after[:half])
        yield i, show(prints[k]), show(edited), alike(prints[k], edited), alike(prints[k], prints[(k + 1) % n])


@pytest.mark.parametrize("lexicon", [1 << 21, 0])
def test_imatch_equals_brute_force(spark, docs, monkeypatch, lexicon):
    """Every hash and likeness, with the lexicon broadcast and with it joined by a shuffle."""
    monkeypatch.setattr(imatch, "LEXICON", lexicon)
    monkeypatch.setattr(imatch, "SHARE", 30)
    got = sorted(
        (r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12), round(r["near_next"], 12))
        for r in imatch.match(docs).collect()
    )
    want = sorted((*x[:3], round(x[3], 12), round(x[4], 12)) for x in imatch_brute(sorted(texts_of(docs))))
    assert got == want
