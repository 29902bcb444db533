"""Secret scan: three fixed patterns, and strings whose characters are too evenly spread to be words.

A candidate string is a run of at least ``min_length`` token characters. A window of ``window``
characters slides over it. The Shannon entropy of the window follows from counts that each step changes
for one character that leaves and one that enters, so a step costs the same for any window. It is held
against the bound of the window's character class (hexadecimal, letters with digits, or these with
``+/=_-``); the windows over the bound make up the spans. Allow-listed candidates are suppressed: plain
words, UUIDs, paths and addresses, long repeats, and what the caller adds.

Offsets are code points, ends exclusive. A null or empty text has no spans; of finds that begin together the kind listed first
comes first; repeated rows are scanned each, with equal results; an empty table gives an empty one; other columns pass unchanged,
but one named ``spans`` is replaced. Every text is scanned whole
in time in proportion to its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
_KEYS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_\-]{20,}", re.ASCII)

#: Bits a character that a window must exceed, by character class.
ENTROPY_BOUNDS = {"hex": 3.0, "alnum": 3.7, "base64": 4.0}
ALLOWED = (
    r"[A-Za-z]+",  # words of any case
    r"[0-9_=+/\-]+",  # numbers, rules and separators
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"(?:[A-Za-z]+[0-9]{0,4}[_/\-]+)*[A-Za-z]+[0-9]{0,4}",  # paths, slugs, identifiers
)
_HEX_SET = frozenset("0123456789abcdefABCDEF")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns' matches, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _bound(candidate: str, bounds: dict[str, float]) -> float:
    if _HEX_SET.issuperset(candidate):
        return bounds["hex"]
    return bounds["alnum" if candidate.isalnum() else "base64"]


def dense_stretches(candidate: str, window: int, bound: float) -> Iterator[tuple[int, int]]:
    """Stretches covered by windows whose entropy is over ``bound`` bits, by incremental counts.

    The entropy of counts n_c with sum W is log2 W - (sum of n_c log2 n_c) / W, so only that sum is kept.
    """
    cost = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    most = (math.log2(window) - bound) * window  # the sum may be this at most
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if i >= window:
            old = candidate[i - window]
            n = counts[old]
            counts[old] = n - 1
            total -= cost[n] - cost[n - 1]
        if i >= window - 1 and total < most - 1e-9:
            first = i + 1 - window
            if first > end:
                if end >= 0:
                    yield start, end
                start = first
            end = i + 1
    if end >= 0:
        yield start, end


def entropy_spans(text: str, window: int, bounds: dict[str, float], allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, 3, end) of dense stretches of candidates that aren't on the allow list."""
    out = []
    for m in _CANDIDATE.finditer(text):
        candidate = m.group()
        if allowed.fullmatch(candidate):
            continue
        out += [(m.start() + a, 3, m.start() + b) for a, b in dense_stretches(candidate, window, _bound(candidate, bounds))]
    return out


def scan(docs: DataFrame, text_col: str = "text", window: int = 20, bounds: dict[str, float] | None = None, allow: Iterable[str] = ()) -> DataFrame:
    """Adds ``spans``, an array of (kind, start, end) ordered by start and kind, to every row of ``docs``.

    ``allow`` holds further regular expressions; a candidate that one of them matches whole is suppressed.
    An input column ``spans`` is replaced.
    """
    limits = ENTROPY_BOUNDS | (bounds or {})
    pattern = "|".join(f"(?:{p})" for p in (*ALLOWED, *allow))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*(f for f in docs.schema if f.name != "spans"), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern, re.ASCII)
        for batch in batches:
            found = []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                spans = base_spans(text) + entropy_spans(text, window, limits, allowed)
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            kept = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, kind)], [*kept, "spans"])

    return docs.mapInArrow(run, schema)
