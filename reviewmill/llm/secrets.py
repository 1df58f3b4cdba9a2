"""Spans of secrets in whole texts: known shapes, and strings too random to be words.

Candidate strings are looked at through a window that slides by one character. Counts per
character and the sum of ``n log2 n`` change by two characters at a step, so the entropy of
every window costs a constant. Windows of one character class above its threshold merge into
a span. Placeholders, identifiers and plain words are on an allow list and leave no span. Where
they stand beside a random string, its windows are tested one by one and it is found alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from reviewmill.llm.words import bound_batches, freeing, sliced

# The shapes of known secrets, each with its least length.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least bits per character of a window, by the class that all its characters belong to.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 3.4),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.8),
)
#: Strings that look random but are not secret: UUIDs, placeholders, runs of the alphabet.
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ALLOWED = re.compile(
    r"example|sample|placeholder|dummy|your[_-]|"
    r"abcdefghij|0123456789|1234567890|xxxxxxxx",
    re.IGNORECASE,
)
#: A placeholder inside a random string speaks for so many characters on both sides.
REACH = 2 * WINDOW
SIGNS = re.compile(r"[+/_=-]")
_STEPS = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def windows_above(
    text: str, allowed: frozenset, least: float, width: int = WINDOW, keep: Callable[[int], bool] | None = None
) -> Iterator[tuple[int, int]]:
    """Merged ranges of ``text`` covered by windows of ``width`` allowed characters whose Shannon
    entropy is at least ``least`` bits per character; with ``keep``, by those whose start it keeps."""
    counts: dict[str, int] = {}
    weighted, run, start, end = 0.0, 0, -1, -1
    for i, c in enumerate(text):
        if c not in allowed:
            counts, weighted, run = {}, 0.0, 0
            continue
        if run == width:
            old = text[i - width]
            n = counts[old]
            weighted -= _STEPS[n] - _STEPS[n - 1]
            counts[old] = n - 1
        else:
            run += 1
        n = counts.get(c, 0)
        weighted += _STEPS[n + 1] - _STEPS[n]
        counts[c] = n + 1
        if run == width and math.log2(width) - weighted / width >= least - 1e-9:
            first = i - width + 1
            if keep is not None and not keep(first):
                continue
            if start >= 0 and first > end:
                yield start, end
                start = -1
            if start < 0:
                start = first
            end = i + 1
    if start >= 0:
        yield start, end


def _plain(part: str) -> bool:
    return part.isalpha() and (part.islower() or part.istitle() or part.isupper()) or part.isdigit()


def _looks_random(candidate: str) -> bool:
    """Letters and digits mixed, and no plain words joined by signs."""
    if not any(c.isdigit() for c in candidate) or not any(c.isalpha() for c in candidate):
        return False
    return sum(len(p) for p in SIGNS.split(candidate) if _plain(p)) * 2 < len(candidate)


def _placeholders(candidate: str) -> list[tuple[int, int]]:
    """Ranges whose windows are no secrets: placeholders, with REACH characters on both sides where
    one stands inside a random string and not as a word of its own."""
    ranges = []
    for match in ALLOWED.finditer(candidate):
        before = SIGNS.split(candidate[max(0, match.start() - REACH) : match.start()])[-1]
        after = SIGNS.split(candidate[match.end() : match.end() + REACH])[0] if match.group()[-1] not in "_-" else ""
        rest = (before + after).strip("0123456789")
        reach = 0 if not rest or _plain(rest) else REACH
        ranges.append((match.start() - reach, match.end() + reach))
    return sorted(ranges)


def _near(ranges: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of ``_placeholders`` that can meet a span: none is longer than three REACH."""
    return ranges[bisect_left(ranges, start - 3 * REACH, key=itemgetter(0)) : bisect_right(ranges, end + REACH, key=itemgetter(0))]


def _random_windows(candidate: str, start: int, end: int, allowed: frozenset, least: float, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a range of windows that look random by themselves, without words at their ends."""
    blocked, far = bytearray(end - start), [(a, b) for a, b in known if b - a > REACH]
    for a, b in known:
        reached = b - a > REACH
        # A window inside the reach is blocked, or one that overlaps a word.
        for first in range(max(start, a if reached else a - WINDOW + 1), min(end, b - WINDOW + 1 if reached else b)):
            blocked[first - start] = 1

    def keep(first: int) -> bool:
        return not blocked[first] and _looks_random(candidate[start + first : start + first + WINDOW])

    for a, b in windows_above(candidate[start:end], allowed, least, keep=keep):
        a, b = a + start, b + start
        while (sign := SIGNS.search(candidate, a, b)) and (sign.start() == a or sign.start() - a > 1 and _plain(candidate[a : sign.start()])):
            a = sign.end()
        signs = [m.start() for m in SIGNS.finditer(candidate, a, b)]
        while signs and b - signs[-1] > 2 and _plain(candidate[signs[-1] + 1 : b]):
            b = signs.pop()
        # A random string that goes on beyond the reach holds the placeholder by chance.
        for c, d in _near(far, a, b):
            if a <= d and b >= c:
                a, b = min(a, max(c, start)), max(b, min(d, end))
        yield a, b


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the text that the sliding windows find and the allow list leaves.

    A span is whole where it looks random as a whole and holds no placeholder; else its windows
    are looked at one by one.
    """
    found = []
    for match in CANDIDATE.finditer(text):
        candidate = match.group()
        if IDENTIFIER.fullmatch(candidate):
            continue
        known = _placeholders(candidate)
        spans: list[tuple[int, int]] = []
        for _, allowed, least in CLASSES:
            for start, end in windows_above(candidate, allowed, least):
                inside = [(a, b) for a, b in _near(known, start, end) if a < end and b > start]
                if not inside and _looks_random(candidate[start:end]):
                    spans.append((match.start() + start, match.start() + end))
                else:
                    spans += [(match.start() + a, match.start() + b) for a, b in _random_windows(candidate, start, end, allowed, least, inside)]
        spans.sort()
        for start, end in spans:
            if found and start <= found[-1][1] and found[-1][0] >= match.start():
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of known shapes, leftmost and without overlap within a kind."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``secrets``: an array of (kind, start, end) by start, then kind.

    Kinds are assign, access, hex and entropy; offsets are code points, the end is exclusive.
    Null and empty texts have an empty array. All columns of ``docs`` are kept as they are; one
    named ``secrets`` is replaced.
    """
    kept = [c for c in docs.columns if c != "secrets"]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for value in batch.column(kept.index(text)).to_pylist():
                value = value or ""
                spans = base_spans(value) + [(a, 3, b) for a, b in entropy_spans(value)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*kept, "secrets"])

    span = StructType().add("kind", "string").add("start", "long").add("end", "long")
    added = StructType([*schema]).add("secrets", ArrayType(span))
    return bound_batches(docs).select(*[f"`{c}`" for c in kept]).mapInArrow(freeing(scanned), added)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (with ``text`` and ``n_chars``) with every span replaced by ``mask``.

    Overlapping spans are one. Texts without a span, null among them, stay as they are, and so
    does their ``n_chars``; a changed text gets its new length.
    """
    columns, schema = docs.columns, docs.schema
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def redacted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            lengths = batch.column(chars).to_pylist() if chars is not None else []
            for i, value in enumerate(texts):
                spans = [(a, b) for a, _, b in base_spans(value or "")] + entropy_spans(value or "")
                if not spans:
                    continue
                out, done = [], 0
                for start, end in sorted(spans):
                    if start >= done:
                        out += [value[done:start], mask]
                    done = max(done, end)
                texts[i] = "".join(out) + value[done:]
                if chars is not None:
                    lengths[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                arrays[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return bound_batches(docs).mapInArrow(freeing(redacted), schema)
