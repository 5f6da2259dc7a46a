"""Token counts and cross-tokenizer alignment against the libraries and brute force."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from llm_helpers import ODD_TEXTS, texts_of

from modalweave.llm import counts, crosstok

BITS = ["it's", "'re", "'ll", "'l", "'v", " ", "  ", "\n", "\t", "a", "ing", "the", " the", "<|endoftext|>", "<|endo", "é", "😀", "日本語", "123", "!!", "'", "x" * 50, "\x1c", "\x85", "　", "#", "<", "|>", "\r\n", "▁", " \n ", "  \t \t", "\n\n ", "<0x41>", "<s>", "\x00", "ſ"]


def made(n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))) for i in range(n)]


@pytest.fixture(scope="module")
def files():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(files):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(files[0])
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(files):
    return counts.TokenCounter(counts.Vocabulary(files[0]), files[2])


# ------------------------------------------------------------------ counts


def test_every_token_is_made_from_its_bytes(counter):
    assert all(map(counter.whole, counter.words.bytes_of))


def test_every_prefix_has_the_count_of_the_library(counter, library):
    for _, text in made(500, 1):
        held = counts.Prefixes(counter, text)
        want = [library(text[:k]) for k in range(len(text) + 1)]
        assert [held.at(k) for k in range(len(text) + 1)] == want, text
        assert held.total == counter.count(text) == want[-1]
        for budget in (0, 1, 2, 3, 5, 9):
            assert held.longest(budget) == max(k for k, n in enumerate(want) if n <= budget), (text, budget)


def test_memories_that_overflow_change_nothing(counter, library, files, monkeypatch):
    monkeypatch.setattr(counts, "MEMO", 3)
    small = counts.TokenCounter(counter.words, files[2])
    for _, text in made(100, 2):
        assert small.count(text) == library(text)


def test_counts_of_documents(spark, docs, odd, none, files, library):
    for df in (docs, odd, spark.createDataFrame(made(300, 3), "doc_id long, text string")):
        got = Counter(map(tuple, counts.token_counts(df, files[0], files[2]).collect()))
        assert got == Counter((i, len(t.encode()), library(t)) for i, t in texts_of(df))
    assert counts.token_counts(none, files[0], files[2]).count() == 0


def test_truncation_and_counts_at_ends(spark, odd, none, files, library):
    for budget in (0, 7, 1000):
        got = {(r["doc_id"], r["text"], r["n_tokens"]) for r in counts.truncate(odd, files[0], files[2], budget).collect()}
        assert len(got) <= len(ODD_TEXTS) and {g[0] for g in got} == {i for i, _ in ODD_TEXTS}
        for i, text, n in got:
            assert library(text) == n <= max(0, budget) or not text
            assert any(j == i and t.startswith(text) and (len(t) == len(text) or n <= budget) for j, t in ODD_TEXTS)
    ends = [0, 1, 5, 17, 10**6]
    got = Counter((r["doc_id"], tuple(r["counts"])) for r in counts.counts_at(odd, files[0], files[2], ends).collect())
    assert got == Counter((i, tuple(library(t[:e]) for e in ends)) for i, t in ODD_TEXTS)
    assert counts.truncate(none, files[0], files[2], 5).count() == 0


# ------------------------------------------------------------------ alignment


def brute_alignment(texts, files):
    """Rows of align_documents by spans of all tokens, without windows."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    one.encode_special_tokens = True
    letter = counts.byte_letters()

    def ends(parts):
        out = [0]
        for p in parts:
            out.append(out[-1] + len(p))
        return out

    held, pairs = [], Counter()
    for i, text in texts:
        a, b, whole = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text), (" " + text).encode()
        a_bytes = [bytes(letter[c] for c in one.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            held.append((i, [], [], [], [], ""))
            continue
        a_end, b_end = ends(a_bytes), ends(b_bytes)
        links, at = [], 0
        for k in range(len(a)):
            while b_end[at + 1] <= a_end[k]:
                at += 1
            links += [(a[k], b[j]) for j in range(at, bisect_left(b_end, a_end[k + 1]))]
        cut = sorted(set(a_end[1:]) & set(b_end[1:]))
        sides = defaultdict(lambda: ([], []))
        for side, ids, bounds in ((0, a, a_end), (1, b, b_end)):
            for x, e in zip(ids, bounds[1:]):
                sides[bisect_left(cut, e)][side].append(str(x))
        groups = ";".join(",".join(sides[g][0]) + "|" + ",".join(sides[g][1]) for g in range(len(cut)))
        held.append((i, a, b, cut, links, hashlib.sha256(groups.encode()).hexdigest()))
        pairs.update(set(links))
    best = defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    return Counter(
        (i, len(a), len(b), len(cut), len(links), sum(pairs[p] == best[p[0]] for p in links), sum(pairs[p] for p in links), sha)
        for i, a, b, cut, links, sha in held
    )


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return Counter(map(tuple, df.select(*NAMES).collect()))


def test_alignment_equals_brute_force(spark, docs, odd, none, files):
    for df in (docs, odd, spark.createDataFrame(made(300, 4), "doc_id long, text string")):
        assert rows(crosstok.align_documents(df, *files)) == brute_alignment(texts_of(df), files)
    assert crosstok.align_documents(none, *files).count() == 0


@pytest.mark.parametrize("frequent", [1, 40])
def test_rare_and_frequent_pairs_meet_their_counts(spark, docs, files, frequent, monkeypatch):
    """Few or no pairs are broadcast; memories and slices are small."""
    for name, value in (("FREQUENT", frequent), ("MEMO", 5), ("AT_ONCE", 500)):
        monkeypatch.setattr(crosstok, name, value)
    some = docs.limit(60).cache()
    assert rows(crosstok.align_documents(some, *files)) == brute_alignment(texts_of(some), files)


def test_windows_are_cut_at_shared_ends_before_spaces(files):
    tokens = crosstok.Tokens(*files)
    windows = crosstok.Windows(tokens)
    (a, b), = tokens.encode(["one two  three\nfour"])
    left, right = crosstok.anchors(tokens, a, b)
    assert len(left) == len(right) >= 2
    for i, j in zip(left, right):
        assert b"".join(tokens.a_bytes[x] for x in a[:i]) == b"".join(tokens.b_bytes[x] for x in b[:j])
        assert tokens.a_bytes[a[i]][:1] == tokens.b_bytes[b[j]][:1] == b" "
    before, = crosstok.align(tokens, windows, [(a, b)])
    after, = crosstok.align(tokens, windows, [(a, b)])
    assert len(windows.memory.known) == len(left) + 1 and before[:2] == after[:2] and (before[2] == after[2]).all()


def test_ids_are_those_of_the_library(files):
    """Ids of both sides against the libraries on whole texts, over code points and odd strings."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(files[0])
    own.encode_special_tokens = True
    tokens = crosstok.Tokens(*files)
    rng = random.Random(6)
    texts = [t for _, t in made(1500, 5)] + ["".join(rng.choices("ab ", k=rng.randint(1, 200))) for _ in range(300)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(texts), 10_000):
        part = texts[start : start + 10_000]
        for text, want in zip(part, own.encode_batch(part, add_special_tokens=False)):
            assert tokens.a.encode_ordinary(text) == want.ids, text
    plain = [t for t in texts if t and "▁" not in t]
    for start in range(0, len(plain), 10_000):
        part = plain[start : start + 10_000]
        for (a, b), t, want in zip(tokens.encode(part), part, own.encode_batch([" " + t for t in part], add_special_tokens=False)):
            assert a.tolist() == want.ids and b.tolist() == tokens.b.encode(t), t
