"""The divergence audit against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_helpers import SF

from modalweave.llm import audit
from modalweave.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, least=10, ranks=10):
    docs, count, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + (10**9 * (c[w] + 2)) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(n, seed, langs, sources):
    rng = random.Random(seed)
    words = ["alpha", "BETA", "gamma", "Délta", "İota", "ſigma", "K", "word", "日本", "😀", "x1y", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    pick = lambda s: words[min(int(rng.expovariate(0.15 + 0.03 * (s % 5))), len(words) - 1)]
    out = []
    for _ in range(n):
        s = min(int(rng.expovariate(0.3)), sources - 1)
        out.append((rng.choice(langs), f"s{s}", rng.choice([" ", ",", "_", "\x00", "0"]).join(pick(s) for _ in range(rng.randint(0, 25)))))
    return out


SCHEMA = "lang string, source string, text string"


def test_equals_plain_integers(spark):
    rows = corpus(500, 1, ["en", "fr"], 9) + [("xx", "only", "rare words"), ("xx", "other", None), (None, None, None), ("", "", "A b"), ("en", None, "alpha beta")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(audit.audit(df)) == brute(rows)
    assert result(audit.audit(df, least_docs=1, ranks=3)) == brute(rows, 1, 3)


@pytest.mark.parametrize("shard, block, cells", [(40, 3, 50), (10**6, 2, 1), (60, 256, 10**6)])
def test_shards_and_blocks_change_nothing(spark, shard, block, cells, monkeypatch):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("CELLS", cells), ("AT_ONCE", 300), ("HELD", 50)):
        monkeypatch.setattr(audit, name, value)
    rows = corpus(600, 2, ["en"] * 5 + ["de"], 14)
    assert result(audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_tables(spark, none):
    assert audit.audit(none).count() == 0
    rows = [(None, None, "x" * 100_000 + " y")] * 12 + [("a", "b", "")]
    extra = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA + ", count int, Text string")
    assert result(audit.audit(extra)) == brute(rows)


def test_query_equals_its_sql_and_plain_integers(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = result(QUERIES["op13_audit"](spark, SF))
    assert got == sorted(con.execute(ORACLES["op13_audit"]).fetchall())
    assert got == brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()])


def test_shares_stay_exact_for_huge_counts(spark):
    rows = [(3, 10**14, 10**6), (10**14, 10**14, 0), (0, 0, 1), (8 * 10**14, 8 * 10**15, 10**7)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
