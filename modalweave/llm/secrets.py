"""Secrets in texts: fixed forms, and strings that a tokenizer finds inefficient.

Natural words and names cost few tokens per character under a BPE vocabulary;
random keys cost many. A candidate string with few characters per token is
reported unless it is a known digest or an identifier made of parts that are
natural by the same measure.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import documents, per_document

#: Kinds in the order that breaks ties between spans with one start.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "random"]

SCHEMA = "spans array<struct<kind:string,start:int,end:int,chars_per_token:double>>"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
NUMBER = re.compile(r"[0-9+/=_-]+")
#: Letters joined by -, _ or /, perhaps with a short number at the end.
NAME = re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*(?:[-_]?[0-9]{1,4})?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def natural(part: str, tokens: Callable[[str], int], max_ratio: float) -> bool:
    """One token, or more than ``max_ratio`` characters per token; in lower case or after a space counts too, as in prose."""
    low = part.lower()
    fewest = min(map(tokens, (part, low, f" {low}")))
    return fewest == 1 or len(part) > max_ratio * fewest


def known(candidate: str, word_like: Callable[[str], bool]) -> bool:
    """A digest, a UUID, a number or an identifier (word-like parts of four letters and more on average)."""
    if HEXADECIMAL.fullmatch(candidate) and len(candidate) in DIGEST_CHARS:
        return True
    if UUID.fullmatch(candidate) or NUMBER.fullmatch(candidate):
        return True
    parts = WORD.findall(candidate) if NAME.fullmatch(candidate) else []
    return bool(parts) and len(candidate) >= 4 * len(parts) and all(map(word_like, parts))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed form, those that are long enough."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def scan(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float = 2.2, min_chars: int = 20) -> DataFrame:
    """(doc_id, spans): all secrets of each whole text, by start, then kind.

    Positions are code points, ends exclusive. A null or empty text has no
    spans; repeated rows give the same spans again; other columns are not read.
    A ``random`` span is a run of at least ``min_chars`` of [A-Za-z0-9+/=_-]
    with at most ``max_ratio`` characters per token that overlaps no fixed form.
    """
    candidates = re.compile(rf"[A-Za-z0-9+/=_-]{{{min_chars},}}")

    def row():
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})

        def tokens(value):
            return len(own.encode_ordinary(value))

        def word_like(part):
            return natural(part, tokens, max_ratio)

        def one(text):
            spans = [(k, s, e, None) for k, s, e in base_spans(text)]
            taken = sorted((s, e) for _, s, e, _ in spans)
            at = 0
            for m in candidates.finditer(text):
                s, e = m.span()
                while at < len(taken) and taken[at][1] <= s:
                    at += 1
                if any(a < e and b > s for a, b in taken[at : at + 3]):
                    continue
                ratio = (e - s) / max(1, tokens(m.group()))
                if ratio <= max_ratio and not known(m.group(), word_like):
                    spans.append(("random", s, e, ratio))
            spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            return ([{"kind": k, "start": s, "end": e, "chars_per_token": r} for k, s, e, r in spans],)

        return one

    return per_document(documents(docs), SCHEMA, row)
