"""Secrets in texts: fixed patterns, and password guess costs of values in credential contexts.

A value's cost is the least, over all ways to cut it into words, dates, repeats, keyboard walks and brute-force spans,
of the decimal logarithm of the guesses that the pieces need; dynamic programming finds it, in time linear in the length.

Repeats and walks may have any length, yet few starts need a look. Every piece costs at least 1 (ten guesses), and the cost
of a repeat or walk rises by log10 of its length only, so a piece that lies inside the same repeat or walk as the one after
it is better made a part of that one: log10((3 + w) / 3) < 1 for pieces of w <= LONGEST characters. So the piece before
begins outside, and as a word or date it ends within LONGEST characters of the start.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further names of credentials, and values that follow a scheme's or a user's name, of any length.
#: URL's scheme is read from the start of its run of characters only, so that long runs take linear time.
NAMED = re.compile(r"""(?<![A-Za-z0-9])(pwd|pass|passphrase|passcode|pin|auth|authorization|credential|credentials|access_?key|private_?key|client_?secret|bearer)["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""", re.IGNORECASE | re.ASCII)
BEARER = re.compile(r"(bearer|basic)\x20+([A-Za-z0-9+/_.=-]{6,})", re.IGNORECASE | re.ASCII)
URL = re.compile(r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s:/@]+:([^\s:/@]{6,})@", re.IGNORECASE | re.ASCII)
#: A text without any of these, in lower case, has no match of ASSIGN, NAMED, BEARER or URL.
HINTS = ("passw", "secret", "token", "api", "pwd", "pass", "pin", "auth", "credential", "key", "bearer", "basic ", "://")
#: The words most common in passwords, most common first; the words of a public vocabulary come after them.
COMMON = (
    "password love admin welcome hello dragon monkey master qwerty sunshine princess shadow football baseball letmein secret "
    "summer winter michael jordan hunter ranger superman batman trustno killer pepper computer internet freedom whatever "
    "ginger diamond changeme iloveyou abc test testing user guest root login default access server system database"
).split()
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Forms of dates, with the log10 of how many dates of the form there are in two centuries.
_Y, _M, _D, _S = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
DATES = [(re.compile(form, re.ASCII), cost) for form, cost in (
    (_Y, 2.3), (_Y + _S + _M, 3.4), (_Y + _S + _M + _S + _D, 4.9), (_D + _S + _M, 2.6), (_D + _S + _M + _S + r"\d\d", 4.6),
    (_D + _S + _M + _S + _Y, 4.9), (_M + _S + _D, 2.6), (_M + _S + _D + _S + r"\d\d", 4.6), (_M + _S + _D + _S + _Y, 4.9),
)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@3105$7", "aaeiosst")
NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))} | {
    (chr(c), chr(c + d)) for c in range(97, 123) for d in (1, -1) if 97 <= c + d < 123
}
#: The longest word that is looked up; words of 3 to so many letters count.
LONGEST = 20
THRESHOLD = 8.0


@functools.cache
def ranks(vocabulary: str | None) -> dict[str, int]:
    """Words by rank: ``COMMON``, then the whole words of a vocabulary file in its order, which is about that of frequency."""
    words = list(COMMON)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>"))
        words += [w for w in whole if 3 <= len(w) <= LONGEST and w.isalpha()]
    return {w: k for k, w in reversed(list(enumerate(words, 1)))}


def brute(c: str) -> float:
    """log10 of the characters that ``c`` is one of."""
    return math.log10(10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def word_cost(piece: str, low: str, plain: str, rank: dict[str, int]) -> float:
    """The cost of ``piece`` as a word, with its forms in lower case and without look-alike digits; inf if it is none."""
    at, turns = rank.get(low), 0.0
    if at is None:
        at, turns = rank.get(plain), 0.5
    if at is None:
        return math.inf
    return math.log10(at + 9) + turns + 0.3 * (piece != low)


def long_cost(kind: str, c: str, size: int) -> float:
    """The cost of a repeat of ``c``, or of a walk, of ``size`` characters."""
    return (brute(c) if kind == "repeat" else 2.0) + math.log10(size)


def guess_cost(value: str, rank: dict[str, int]) -> float:
    """log10 of the guesses that ``value`` needs: the least over all ways to cut it."""
    n, low = len(value), value.translate(LOWER)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    same = walk = 0  # where the repeat and the walk that hold the last character start
    dates: dict[int, list[tuple[int, float]]] = {}
    for i, c in enumerate(value):
        if "0" <= c <= "9":
            for form, cost in DATES:
                if m := form.match(value, i):
                    dates.setdefault(m.end(), []).append((i, cost))
    for end in range(1, n + 1):
        i = end - 1
        c = value[i]
        cost = best[i] + brute(c)
        if i and c != value[i - 1]:
            same = i
        if i and (low[i - 1], low[i]) not in NEXT:
            walk = i
        for kind, start in (("repeat", same), ("walk", walk)):
            for begin in range(start, min(start + LONGEST, end - 3) + 1):
                cost = min(cost, best[begin] + long_cost(kind, c, end - begin))
        for begin, price in dates.get(end, ()):
            cost = min(cost, best[begin] + price)
        for begin in range(max(0, end - LONGEST), end - 2):
            cost = min(cost, best[begin] + word_cost(value[begin:end], low[begin:end], plain[begin:end], rank))
        best[end] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: kind 0 assign, 1 access, 2 hex."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(h in text.lower() for h in HINTS[:4]) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def value_spans(text: str, threshold: float, rank: dict[str, int]) -> list[tuple[int, int, int, float]]:
    """(start, 3, end, cost) of values in credential contexts that take at least 10**threshold guesses."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found = {(m.start(g), m.end(g)) for rx, g in ((ASSIGN, 2), (NAMED, 2), (BEARER, 2), (URL, 1)) for m in rx.finditer(text)}
    costs = [(a, b, guess_cost(text[a:b], rank)) for a, b in sorted(found) if b - a >= 6]
    return [(a, 3, b, cost) for a, b, cost in costs if cost >= threshold]


KINDS = ("assign", "access", "hex", "value")


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_value and max_cost of every row.

    ``spans`` lists kind:start:end in code points, end exclusive, by start, then kind: the matches of the base patterns and
    the ``value`` spans that the guess cost adds. Null texts are empty: no spans, the digest of an empty string. Rows with
    null or repeated doc_ids are rows of their own; other columns are not read; an empty table gives no rows. Whole texts
    are scanned; a text is one row, so the work needs no exchange. ``vocabulary``: the place of a public vocabulary file whose
    words count as guessable; without it only ``COMMON`` does.
    """

    def scan(batches):
        rank = ranks(vocabulary)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                text = text if isinstance(text, str) else ""
                base, more = base_spans(text), value_spans(text, threshold, rank)
                write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                every = write(sorted(base + [x[:3] for x in more]))
                rows.append((doc_id, *counts, hashlib.sha256(write(base).encode()).hexdigest(), every, len(more), max((x[3] for x in more), default=0.0)))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_value", "max_cost"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_value long, max_cost double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, schema)
