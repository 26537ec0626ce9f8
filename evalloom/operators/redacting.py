"""Redaction of whole columns of texts: one scan for candidates, patterns only where a match can begin, overlaps in one sweep.

Each category's matches are those of its pattern from left to right. Running eight patterns over every character is what costs;
most of them can only begin at a few places. Digit runs are found once: identity numbers begin at runs of nine or twelve, plates
at runs of two, tax numbers need one of ten. Mail addresses are tried once for every "@", names where an Aho-Corasick automaton
finds a form of address. A pattern that is not one of the fixed ones is run over the whole text.

Overlaps are settled longest first, then earliest, then by priority, on a map of taken characters: linear in the matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalloom.functions.redaction import DEFAULT, PATTERNS, Policy
from evalloom.session import ship

REDACTED = "struct<text:string,spans:array<struct<type:string,start:int,end:int,original_hash:string,action:string>>,span_count_by_type:map<string,bigint>,total:bigint>"
Span = tuple[int, int]

_RUNS = re.compile(r"\d+")
_VIN_LIKE = re.compile(r"[A-HJ-NPR-Z0-9]{17}")
#: Classes of the first 128 code points: 1 digits, 2 other signs of a vehicle number.
_CLASS = np.zeros(129, np.uint8)
_CLASS[[ord(c) for c in "0123456789"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHJKLMNPRSTUVWXYZ"]] = 2
#: Below this code point (Arabic-Indic zero) only 0 to 9 are digits; below SHORT characters numpy does not pay.
_MORE_DIGITS, SHORT = 0x660, 400
_LOCAL = re.compile(r"\b[A-Za-z0-9._%+\-]")
# Characters before the "@" of an address, and the first words of forms of address.
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ADDRESSES = ("ông", "bà", "anh", "chị", "cô", "chú", "bác", "em", "khách", "người", "đại", "buyer", "seller", "representative")


def _at(pattern: re.Pattern, text: str, starts: Iterable[int]) -> Iterator[Span]:
    """Matches that begin at one of the places, from left to right, none inside the one before."""
    done = 0
    for start in starts:
        if start >= done and (m := pattern.match(text, start)):
            yield m.span()
            done = m.end()


def _stretches(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the stretches of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edges.reshape(-1, 2)


def _landmarks(text: str) -> tuple[list[Span], bool]:
    """(runs of digits, whether 17 signs of a vehicle number stand side by side)."""
    if len(text) >= max(1, SHORT):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if codes.max() < _MORE_DIGITS:
            classes = _CLASS[np.minimum(codes, 128)]
            vin = _stretches(classes > 0)
            return _stretches(classes == 1).tolist(), bool((vin[:, 1] - vin[:, 0] >= 17).any())
    return [m.span() for m in _RUNS.finditer(text)], _VIN_LIKE.search(text) is not None


def _addresses(pattern: re.Pattern, text: str) -> Iterator[Span]:
    """An address has one "@": its first possible start decides, for what follows the "@" is the same for all."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL_SIGNS:
            low -= 1
        first = _LOCAL.search(text, low, at)
        if first and (m := pattern.match(text, first.start())):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


@lru_cache(maxsize=1)
def _automaton():  # noqa: ANN202
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in _ADDRESSES:
        words.add_word(w, len(w))
    words.make_automaton()
    return words


class Scanner:
    """Accepted spans of texts under a policy. ``patterns`` are in order of priority."""

    def __init__(self, policy: Policy = DEFAULT, patterns: dict[str, str] = PATTERNS):
        self.policy = policy
        self.names = [n for n in patterns if n in policy.categories]
        self.rank = {n: k for k, n in enumerate(patterns)}
        self.compiled = {n: re.compile(patterns[n]) for n in self.names}
        fixed = {n for n in self.names if patterns[n] == PATTERNS.get(n)}
        self.find: dict[str, Callable[[str, tuple[list[Span], bool]], Iterable[Span]]] = {n: self._finder(n, n in fixed) for n in self.names}

    def _finder(self, name: str, fixed: bool) -> Callable[[str, tuple[list[Span], bool]], Iterable[Span]]:
        rx = self.compiled[name]
        every = lambda text: (m.span() for m in rx.finditer(text))
        special = {
            "cccd": lambda text, marks: _at(rx, text, (a for a, b in marks[0] if b - a in (9, 12))),
            "license_plate": lambda text, marks: _at(rx, text, (a for a, b in marks[0] if b - a == 2)),
            "tax_id": lambda text, marks: every(text) if any(b - a >= 10 for a, b in marks[0]) else (),
            "bank_account": lambda text, marks: every(text) if marks[0] else (),
            "vin": lambda text, marks: every(text) if marks[1] else (),
            "email": lambda text, marks: _addresses(rx, text),
            "person_name": lambda text, marks: _at(rx, text, sorted(end - n + 1 for end, n in _automaton().iter(text))),
        }
        return special[name] if fixed and name in special else lambda text, marks: every(text)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, category) of the accepted spans, by start."""
        marks = _landmarks(text)
        found = [(a - b, a, self.rank[n], b, n) for n in self.names for a, b in self.find[n](text, marks)]
        if not found:
            return []
        taken, out = bytearray(len(text)), []
        for _, a, _, b, n in sorted(found):
            if b > a and taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, n))
        return sorted(out)

    def redact(self, text: str | None) -> dict:
        text = text or ""
        accepted, out, done, counts = self.spans(text), [], 0, {}
        spans = []
        for a, b, n in accepted:
            category, value = self.policy.categories[n], text[a:b]
            digest = hashlib.sha256(value.encode()).hexdigest()
            spans.append({"type": n, "start": a, "end": b, "original_hash": digest[:12], "action": category.action})
            if category.action == "keep_token":
                continue
            counts[n] = counts.get(n, 0) + 1
            out += [text[done:a], f"[HASH:{digest[:8]}]" if category.action == "hash" else category.mask]
            done = b
        return {"text": "".join([*out, text[done:]]), "spans": spans, "span_count_by_type": list(counts.items()), "total": sum(counts.values())}


def redact_texts(rows: DataFrame, text: str, policy: Policy = DEFAULT, patterns: dict[str, str] = PATTERNS, into: str = "redacted") -> DataFrame:
    """Add a struct (text, spans, span_count_by_type, total) with the redacted text. A null text counts as empty.

    The same results as ``functions.redaction.redact``, which works inside expressions (blocks, cells), for columns of texts of
    any length; positions count code points.
    """
    ship(rows.sparkSession)
    rows = rows.drop(*[c for c in rows.columns if c.lower() == into.lower() and c != text])
    added = StructType.fromDDL(f"`{into}` {REDACTED}")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(policy, patterns), to_arrow_schema(added).field(0).type
        for batch in batches:
            found = pa.array([scanner.redact(t) for t in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
