"""Secret scans: three base patterns, and values in a credential's context that would be dear to guess.

The guess cost of a value is the cheapest way to spell it as common words, dates, repeats, keyboard walks or alphabet
runs and brute-force characters, found by dynamic programming over its positions; costs are in bits (the binary logarithm of
the guesses). A value that follows a credential's name, with or without an assignment sign, and costs ``MIN_BITS`` or more
is a secret of kind ``guess``, unless a base span overlaps it. So "password is required" stays and a random value goes.

Words are those of the corpus besides a fixed list, each at the bits of its frequency. Only words outside the values in context
count, so a leaked password does not become a word however often it is repeated. A word is known if its rows are
``LEAST_ROWS`` and a share ``SHARE`` of all rows more; so the list's length is bounded by the words a text has, not by the rows.

Scale: two passes over whole texts. The first counts a batch's words before anything is shuffled; the second has no shuffle. The
dynamic programming sees only the few values in context, and looks back at most ``MAX_PART`` characters but for repeats and
walks, which it takes as whole runs.

Defined cases: null or empty texts have no spans. Extra columns pass through. Rows with equal ids each keep their row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import add_columns, column
from foliospark.operators.shared import materialise

KINDS = ("assign", "access", "hex", "guess")
# Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Names after which a value may be a credential, and what may stand between.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "login")
#: A name may be a part of a longer one (``DB_PWD``, ``accessKeyId``); its value starts at group ``at``, so that a name there is still seen.
REST = r"(?:[0-9_-]|(?<=[a-z])(?=[A-Z]))[A-Za-z0-9_-]*+"
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?ai:password|passphrase|passwd|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth|login)"""
    rf"""(?:(?:{REST})?(?![A-Za-z0-9_])"""
    r"""["']?(?:[\x20\t]*(?:[:=]|=>|->)[\x20\t]*|[\x20\t]+(?ai:is|was|of|to)[\x20\t]+|[\x20\t]+)["'`(<]?(?=[^\s"'`<>()\[\]{},;]{6})(?P<at>)"""
    rf"""|{REST})?"""
)
VALUE = re.compile(r"""[^\s"'`<>()\[\]{},;]+""")
MIN_BITS, MAX_PART = 36.0, 24
#: Which of the corpus's own words prose is spelt with.
LEAST_ROWS, SHARE = 5, 2e-5
LETTERS = re.compile(r"[^\W\d_]{3,%d}" % MAX_PART)

#: Common words and passwords, the commonest first; a caller may pass another list.
WORDS = (
    "password", "the", "and", "you", "that", "for", "are", "with", "this", "have", "from", "not", "was", "love", "admin",
    "welcome", "login", "master", "hello", "monkey", "dragon", "secret", "token", "test", "user", "root", "pass", "data",
    "server", "home", "summer", "winter", "spring", "autumn", "monday", "friday", "sunday", "january", "march", "april",
    "june", "july", "august", "october", "football", "baseball", "shadow", "sunshine", "princess", "letmein", "access",
    "super", "power", "money", "happy", "angel", "star", "king", "queen", "tiger", "house", "green", "black", "white",
    "blue", "red", "work", "time", "name", "your", "what", "when", "there", "their", "which", "would", "about", "other",
    "service", "account", "email", "config", "value", "string", "example", "sample", "default", "change", "required",
    "please", "enter", "reset", "forgot", "number", "system", "public", "private", "client", "local", "world", "people",
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d"
)


@lru_cache(maxsize=1)
def _steps() -> frozenset[tuple[str, str]]:
    """Neighbours on a row of keys or in the alphabet, both ways."""
    pairs = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
    return frozenset(pairs | {(b, a) for a, b in pairs})


def _char_bits(c: str) -> float:
    """A brute-force character."""
    if c.isdigit():
        return log2(10)
    if c.isalpha():
        return log2(26)
    return log2(33)


def _word_bits(part: str, known: dict[str, float]) -> float | None:
    low = part.lower()
    bits, leet = known.get(low), 0
    if bits is None:
        bits, leet = known.get(low.translate(LEET)), 2
    if bits is None:
        return None
    upper = sum(c.isupper() for c in part)
    return bits + leet + (0 if not upper else 1 if upper in (1, len(part)) and (part[0].isupper() or upper == len(part)) else upper)


def guess_bits(value: str, words: dict[str, float] | None = None) -> float:
    """Bits of the cheapest segmentation of a value; each segment costs one bit more, for where it ends. ``words`` has the
    bits of each known word, of ``MAX_PART`` characters at most."""
    known = ranked(WORDS) if words is None else words
    low, n = value.lower(), len(value)
    best = [0.0] + [float("inf")] * n
    run = walk = 0  # where the repeat and the walk that end here began
    dates = {}
    for i in range(n):
        if (m := DATE.match(value, i)) is not None:
            dates.setdefault(m.end(), []).append(i)
    for end in range(1, n + 1):
        best[end] = best[end - 1] + _char_bits(value[end - 1])
        if end > 1:
            if low[end - 1] != low[end - 2]:
                run = end - 1
            if (low[end - 2], low[end - 1]) not in _steps():
                walk = end - 1
        if end - run >= 3:
            best[end] = min(best[end], best[run] + 1 + _char_bits(value[run]) + log2(end - run))
        if end - walk >= 3:
            best[end] = min(best[end], best[walk] + 1 + log2(47) + log2(end - walk) + 1)
        for start in dates.get(end, ()):
            best[end] = min(best[end], best[start] + 1 + (log2(120) if end - start <= 4 else log2(120 * 365) + 2))
        for start in range(max(0, end - MAX_PART), end - 2):
            bits = _word_bits(value[start:end], known)
            if bits is not None:
                best[end] = min(best[end], best[start] + 1 + bits)
        if end >= 4:  # a block said twice
            for size in range(2, min(end // 2, MAX_PART) + 1):
                if low[end - size:end] == low[end - 2 * size:end - size]:
                    best[end] = min(best[end], best[end - size] + 2)
    return best[n]


@lru_cache(maxsize=4)
def ranked(words: tuple[str, ...]) -> dict[str, float]:
    """Bits of words in the order of their frequency."""
    return {w: log2(i + 2) for i, w in reversed(list(enumerate(words)))}


def corpus_words(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Bits of ``WORDS`` and of the words that enough rows have outside the values in context."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = Counter(), 0
            for x in batch.column(0):
                held.update(set(LETTERS.findall(outside(x.as_py() or "").lower())))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(["", *held], pa.string()), pa.array([n, *held.values()], pa.int64())], ["w", "n"])

    counts = docs.select(column(text_col).alias("text")).mapInArrow(counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    rows = counts.where("w = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    listed = counts.where((F.col("w") != "") & (F.col("n") >= LEAST_ROWS + SHARE * rows)).collect()
    total = sum(r["n"] for r in listed)
    found = {r["w"]: log2(total / r["n"]) + 1 for r in listed}
    return found | {w: min(bits, found.get(w, bits)) for w, bits in ranked(WORDS).items()}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values after credential names are, without what ends a sentence."""
    low, seen = text.lower(), 0
    for m in CONTEXT.finditer(text) if any(w in low for w in CONTEXT_WORDS) else ():
        if m["at"] is not None and m.end() >= seen:  # there is a value, and not inside one that was judged as a whole
            whole = VALUE.match(text, m.end())
            seen = whole.end()
            yield m.end(), m.end() + len(whole[0].rstrip(".:!?"))


def outside(text: str) -> str:
    """A text without base spans and values in context."""
    spans = sorted([(a, b) for a, _, b in base_spans(text)] + list(context_values(text)))
    parts, done = [], 0
    for a, b in spans:
        parts.append(text[done:max(a, done)])
        done = max(done, b)
    return " ".join([*parts, text[done:]]) if spans else text


def guess_spans(text: str, base: list[tuple[int, str, int]], words: dict[str, float] | None = None,
                min_bits: float = MIN_BITS) -> list[tuple[int, str, int]]:
    return [
        (start, "guess", end) for start, end in context_values(text)
        if end - start >= 6 and not any(a < end and start < b for a, _, b in base) and guess_bits(text[start:end], words) >= min_bits
    ]


def scan(docs: DataFrame, text_col: str = "text", name: str = "spans", words: dict[str, float] | None = None,
         min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with all spans, by start and then kind, as ``array<struct<start, kind, end>>`` under ``name``; ``words`` are
    known words and their bits, by default those of ``docs``."""
    known = corpus_words(docs, text_col) if words is None else words
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def spans(texts: pa.Array) -> list[pa.Array]:
        out = []
        for x in texts:
            text = x.as_py() or ""
            base = base_spans(text)
            own = sorted(base + guess_spans(text, base, known, min_bits), key=lambda s: (s[0], KINDS.index(s[1])))
            out.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
        return [pa.array(out, kind)]

    return add_columns(docs, [text_col], [(name, "array<struct<start:int,kind:string,end:int>>")], spans)
