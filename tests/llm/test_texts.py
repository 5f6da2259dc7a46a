"""Per-document operators against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from llm_helpers import ODD_TEXTS, texts_of  # noqa: F401
from pyspark.sql import functions as F

from modalweave.llm import bpe, pii, secrets
from modalweave.llm.common import pick

ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m)) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def scattered(pieces, n, seed):
    rng = random.Random(seed)
    return [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for i in range(n)]


def spans_of(df, kinds):
    got = Counter()
    for r in df.collect():
        got[r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in kinds)] += 1
    return got


SECRET_BITS = ["password", "PASSWD", "token", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef01234567", "é", "😀", "abcdefghijkl", "secret", "ſecret", "x", "-", "."]
PII_BITS = ["a", "b_c", "@", ".", "com", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "-", " ", "+", "+1 (555) 010-9999", "(", ")", "😀", "é", "12.34.56.78", "0", "000", "%"]


def test_base_secrets_as_specified(spark, docs, odd, tokens):
    made = spark.createDataFrame(scattered(SECRET_BITS, 400, 1), "doc_id long, text string")
    for df in (docs, odd, made):
        got = spans_of(secrets.scan(df, *tokens), secrets.BASE_KINDS)
        assert got == Counter((i, tuple(base_secrets(t))) for i, t in texts_of(df))


def test_random_strings_are_found_and_known_forms_left(spark, none, tokens):
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    kept = ["D41D8CD98F00B204E9800998ECF8427E", "6F9619FF-8B86-D011-B42D-00CF4FC964FF", "InternationalizationProviderFactory2024", "the-quick-brown-fox-jumps", "20240101-20250101-2026"]
    df = spark.createDataFrame([(0, f"see {key} here")] + [(i + 1, f"see {k} here") for i, k in enumerate(kept)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(df, *tokens).collect()}
    assert found[0] == [("random", 4, 44)]
    assert not any(found[i + 1] for i in range(len(kept)))
    assert secrets.scan(none, *tokens).count() == 0


def test_random_strings_of_one_case_are_found(spark, tokens):
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = [draw(letters, 40) for letters in (lower, upper) for _ in range(100)]
    keys += [draw(lower, 36) + "2024" for _ in range(20)] + ["-".join(draw(upper, 12) for _ in range(4)) for _ in range(20)]
    kept = ["CONFIGURATION_DIRECTORY_PATH_NAME", "my_list-of-items-in-order", "HTTPServerConnectionFactory", "donaudampfschifffahrtsgesellschaft"]
    df = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys + kept)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(df, *tokens).collect()}
    assert all(found[i] == [("random", 4, 4 + len(k))] for i, k in enumerate(keys))
    assert not any(found[len(keys) + i] for i in range(len(kept)))


def test_base_pii_as_specified(spark, docs, odd):
    made = spark.createDataFrame(scattered(PII_BITS, 600, 2), "doc_id long, text string")
    for df in (docs, odd, made):
        got = spans_of(pii.scan(df), pii.BASE_KINDS)
        assert got == Counter((i, tuple(base_pii(t))) for i, t in texts_of(df))


def test_checksums_and_context_add_spans(spark, none):
    rows = [
        (1, "pay to IBAN DE89 3704 0044 0532 0130 00 soon"), (2, "pay to IBAN DE89 3704 0044 0532 0130 01 soon"),
        (3, "her social security number 078-05-1120."), (4, "part 078-05-1120 in stock"), (5, "ssn 000-12-3456"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("iban", "ssn")] for r in pii.scan(df).collect()}
    assert got == {1: [("iban", 12, 39)], 2: [], 3: [("ssn", 27, 38)], 4: [], 5: []}
    assert pii.scan(none).count() == 0


def test_context_counts_on_both_sides(spark):
    cases = [
        ("078-05-1120 (SSN)", 1), ("é😀 078-05-1120 is my social security number", 1), ("SSN 078-05-1120", 1),
        ("078-05-1120 in stock", 0), ("078-05-1120" + " " * 60 + "ssn", 0), ("social 078-05-1120 security", 0),
    ]
    df = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: sum(s["kind"] == "ssn" for s in r["spans"]) for r in pii.scan(df).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[0] == "<SSN> (SSN)"
    mail = spark.createDataFrame([(1, "x@mail.com"), (2, "x@here.com is my mail")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"][0]["score"] for r in pii.scan(mail).collect()} == {1: 0.9, 2: 1.0}


def test_ibans_end_where_their_country_says(spark):
    cases = [
        ("DE89370400440532013000 The rest", ["DE89370400440532013000"]),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("to GB82 WEST 1234 5698 7654 32 USD 500", ["GB82 WEST 1234 5698 7654 32"]),
        ("DE89370400440532013000 12.50 EUR", ["DE89370400440532013000"]),
        ("NO93 8601 1117 947 NOK 7 AND MT84 MALT 0110 0001 2345 MTLC AST0 01S", ["NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
        ("REF AB12 DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
        ("DE89370400440532013000", ["DE89370400440532013000"]), ("é😀 DE89370400440532013000😀", ["DE89370400440532013000"]),
        ("DE89370400440532013000The", []), ("XDE89370400440532013000 EUR", []), ("DE89 3704 0044 0532 0130 01 EUR", []),
        ("ZZ59 1234 5678 9012 3456 THE", ["ZZ59 1234 5678 9012 3456"]),
    ]
    df = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: [cases[r["doc_id"]][0][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in pii.scan(df).collect()}
    assert got == {i: found for i, (_, found) in enumerate(cases)}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[1] == "IBAN <IBAN> BIC COBADEFFXXX" and masked[3] == "<IBAN> 12.50 EUR"


def test_redaction_masks_spans_and_nothing_else(spark, docs, none):
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    for r in docs.collect():
        want, at = [], 0
        spans = base_pii(r["text"])
        for k, s, e in spans:
            if s >= at:
                want += [r["text"][at:s], f"<{k.upper()}>"]
            at = max(at, e)
        want = "".join(want) + r["text"][at:]
        assert out[r["doc_id"]]["text"] == want
        assert out[r["doc_id"]]["n_chars"] == (len(want) if spans else r["n_chars"])
    assert pii.redact(docs).columns == docs.columns and pii.redact(none).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "mail a@b.co", 5)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.redact(odd).collect())) == [(1, None, None), (2, "mail <EMAIL>", 12)]


@pytest.fixture(scope="module")
def own(tokens):
    import tiktoken

    path, pattern = tokens
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(docs, odd, none, tokens, own):
    import numpy as np

    for df in (docs, odd):
        got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["data"])) for r in bpe.round_trip(df, *tokens).collect())
        want = Counter((i, np.array(own.encode_ordinary(t), dtype="<u4").tobytes(), t.encode()) for i, t in texts_of(df))
        assert got == want
    assert bpe.round_trip(none, *tokens).count() == 0


def test_bpe_pieces_of_random_bytes(tokens, own):
    codec = bpe.Codec(bpe.load_ranks(tokens[0]), tokens[1])
    rng = random.Random(5)
    for alphabet in ("ab", "the ", "aeiounrst", "éàüß", "中文字", "0123456789", " \n\t", "!?.-"):
        for _ in range(60):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            assert list(codec.encode(t)) == own.encode_ordinary(t)
    assert bpe.decode is not None


def test_edits_encode_only_what_they_touch(tokens, own):
    codec = bpe.Codec(bpe.load_ranks(tokens[0]), tokens[1])
    rng = random.Random(6)
    text = "The quick brown fox, it's 12 o'clock.\n\n  Ends here " * 40
    buffer = bpe.Buffer(codec, text)
    assert buffer.ids() == own.encode_ordinary(text)
    for _ in range(150):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 1, 5]))
        new = "".join(rng.choice("ab 1'\n.é") for _ in range(rng.randint(0, 6)))
        before = buffer.encoded_bytes
        buffer.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert buffer.text == text and buffer.ids() == own.encode_ordinary(text)
        assert buffer.encoded_bytes - before < 200
    buffer.append("more")
    assert buffer.ids() == own.encode_ordinary(text + "more")


def test_columns_are_picked_by_exact_name(odd):
    assert {r["text"] for r in pick(odd, "text").collect()} != {"y"}
    assert {r["Text"] for r in pick(odd, "Text").collect()} == {"y"}


def test_long_runs_stay_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 100_000, "a.b" * 100_000, "A" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans_of(pii.scan(df), pii.BASE_KINDS)
    assert sum(got.values()) == len(texts)
    assert hashlib.sha256(b"").hexdigest() and F.lit(1) is not None
