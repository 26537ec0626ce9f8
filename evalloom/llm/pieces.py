"""Subword pieces of whole texts under a sentencepiece BPE model, with the bytes of the text that each piece stands for.

The model file is read here; the sentencepiece library is what tests compare with. Steps, for every text:

1. Normalisation. At each place the longest prefix that the compiled character map knows is replaced, else one character is
   copied; spaces become U+2581, and the model's flags say whether one is put in front and repeated ones are dropped. Each
   normalised byte records the source byte that it came from (its alignment).
2. Merging. Neighbouring symbols join in the order of the scores of the pieces that they make, leftmost first. No piece holds
   a space sign behind another character, and none a character outside the model's alphabet, so what lies between such
   places merges apart: it is looked up in a bounded cache, and merged with a heap where it is new.
3. Projection. The ends of the pieces in the normalised text, taken through the alignment, are spans of source bytes. A
   character without a piece falls to its bytes: the last of them holds its span, the others are empty.
4. Decoding goes from the ids alone: bytes are put together again, bytes that are not UTF-8 become U+FFFD one by one.

Texts are independent: no shuffle. Vocabulary files are named by parameter and found on every node by
``public_tokenizers.path``.

Defined results: null texts count as empty; an empty text has no pieces and decodes to ''. Repeated rows and ids are
documents apart, other columns stay, a column named like a result is replaced, an empty table gives an empty result. A very
long text is worked through in parts of about a million characters, cut where pieces cannot reach across; its ids, spans and
alignment (some 20 bytes a byte of text) are held by its task. Models other than BPE with byte fallback, with user-defined
or unused pieces, or with spaces behind words raise ValueError.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalloom.session import ship

SPACE = "▁"
PART = 1 << 20
#: Stretches up to this many characters are remembered; up to FEW they are merged without a heap.
LONGEST, FEW = 64, 40
NONE = float("inf")
RESULTS = "ids array<int>, span_starts array<int>, span_ends array<int>, decoded string"
# Kinds of pieces and numbers of fields of a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of an encoded message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
            continue
        size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double array over the bytes of prefixes, whose leaves point into a block of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest known prefix of data[at:]."""
        units = self.units
        if not units:
            return None
        node, found = self._child(0, units[0]), None
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Normalizer:
    def __init__(self, spec: dict[int, int | bytes]):
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE.encode() if self.escape else b" "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each of its bytes and, last, where the source that counts ends)."""
        if self.map.units or self.squeeze:
            return self._by_map(text.encode())
        if not text:
            return "", np.zeros(1, np.int32)
        source = np.frombuffer(text.encode(), np.uint8)
        wide = len(self.space)
        places = np.repeat(np.arange(len(source), dtype=np.int32), np.where(source == 32, wide, 1) if wide > 1 else 1)
        front = np.zeros(wide * self.prefix, np.int32)
        out = text.replace(" ", SPACE) if self.escape else text
        return self.space.decode() * self.prefix + out, np.concatenate([front, places, np.array([len(source)], np.int32)])

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        known = self.map.longest(data, at)
        if known:
            return known
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    def _by_map(self, data: bytes) -> tuple[str, np.ndarray]:
        at, n = 0, len(data)
        while self.squeeze and at < n:
            new, size = self._prefix(data, at)
            if new != b" ":
                break
            at += size
        if at == n:
            return "", np.zeros(1, np.int32)
        out, places = bytearray(), []

        def put(new: bytes, source: int) -> None:
            new = new.replace(b" ", self.space)
            out.extend(new)
            places.extend([source] * len(new))

        if self.prefix:
            put(b" ", at)
        after_space = self.squeeze
        while at < n:
            new, size = self._prefix(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new, at)
                after_space = self.squeeze and new.endswith(b" ")
            at += size
        end = n
        while self.squeeze and out.endswith(self.space):
            end = places[len(out) - len(self.space)]
            del out[-len(self.space) :], places[-len(self.space) :]
        return out.decode(), np.array([*places, end], np.int32)


class _Known(dict):
    """Stretches and their ids; a new one is merged when it is first looked up. Cleared when it is full."""

    def __init__(self, model: PieceModel, most: int):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, stretch: str) -> bytes:
        ids = self.model.merged(stretch)
        if len(stretch) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[stretch] = ids
        return ids


class PieceModel:
    """Pieces of texts under a model file; what is remembered of merged stretches is bounded by ``most``."""

    def __init__(self, data: bytes, most: int = 1_000_000):
        pieces, trainer, spec = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                pieces.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        self.names = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or not trainer.get(35) or trainer.get(24) or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are read")
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.normalize = Normalizer(spec)
        scores = [float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]) for p in pieces]
        self.id_of = {w: i for i, (w, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.order = {w: -scores[i] for w, i in self.id_of.items()}
        four = lambda i: i.to_bytes(4, "little")
        self.bytes_of = {w: four(i) for w, i in self.id_of.items()}
        byte_id = {int(w[3:-1], 16): i for i, (w, kind) in enumerate(zip(self.names, self.kinds)) if kind == BYTE}
        self.byte_bytes = {byte: four(i) for byte, i in byte_id.items()}
        self.byte_of = np.full(len(pieces), -1, np.int16)
        for byte, i in byte_id.items():
            self.byte_of[i] = byte
        self.size = np.array([len(w.encode()) for w in self.names], np.int32)
        self.surface = [{UNKNOWN: self.unknown, CONTROL: b"", BYTE: bytes([max(0, int(self.byte_of[i]))])}.get(kind, w.replace(SPACE, " ").encode()) for i, (w, kind) in enumerate(zip(self.names, self.kinds))]
        if any(SPACE in w.lstrip(SPACE) for w in self.id_of):
            raise ValueError("a piece holds a space behind another character")
        alphabet = "".join(sorted(set("".join(self.id_of)) - {SPACE}))
        inside = f"[{re.escape(alphabet)}]" if alphabet else "(?!)"
        self.stretch = re.compile(f"{SPACE}+{inside}*|{inside}+|.", re.DOTALL)
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.known = _Known(self, most)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, end byte) of the pieces of a text; bytes count in its UTF-8 form."""
        normal, source = self.normalize(text)
        parts, at = [], 0
        while at < len(normal):
            found = self.cut.search(normal, at + PART)
            end = found.start() if found else len(normal)
            parts.append(self._ids(normal[at:end]))
            at = end
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = self.size[ids]
        byte = self.byte_of[ids]
        rest = np.flatnonzero(byte >= 0)
        if len(rest):
            size[rest] = 0
            lead = rest[(byte[rest] < 0x80) | (byte[rest] >= 0xC0)]
            first = byte[lead]
            wide = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            size[lead + wide - 1] = wide
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, source[ends[:-1]], source[ends[1:]]

    def _ids(self, normal: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.stretch.findall(normal))), "<i4")

    def merged(self, stretch: str) -> bytes:
        """The ids of a stretch, four bytes each."""
        symbols = self._few(list(stretch)) if len(stretch) <= FEW else self._many(list(stretch))
        found = [self.bytes_of.get(s) or b"".join([self.byte_bytes[b] for b in s.encode()]) for s in symbols]
        return b"".join(found)

    def _few(self, symbols: list[str]) -> list[str]:
        """Join the pair that comes first in the order, leftmost of equal ones, until none is known: short stretches."""
        at = self.order.get
        places = [at(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while places:
            best = min(places)
            if best is NONE:
                break
            k = places.index(best)
            symbols[k] += symbols.pop(k + 1)
            del places[k]
            if k:
                places[k - 1] = at(symbols[k - 1] + symbols[k], NONE)
            if k < len(places):
                places[k] = at(symbols[k] + symbols[k + 1], NONE)
        return symbols

    def _many(self, symbols: list[str]) -> list[str]:
        """The same with a heap and links between neighbours: n log n in the length of the stretch."""
        order = self.order
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joined = symbols[a] + symbols[b]
                at = order.get(joined)
                if at is not None:
                    heapq.heappush(heap, (at, a, b, len(joined)))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = list(ids) if isinstance(ids, list) else ids.tolist()
        found = [self.surface[i] for i in ids]
        if self.normalize.prefix or self.normalize.squeeze:
            for k, i in enumerate(ids):  # the space that normalisation put in front
                spaced = self.kinds[i] == NORMAL and found[k].startswith(b" ")
                found[k] = found[k][spaced:]
                if found[k] or (spaced and not self.normalize.squeeze):
                    break
        try:
            return b"".join(found).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for i, s in zip([*ids, -1], [*found, b""]):
            if i >= 0 and self.kinds[i] == BYTE:
                run += s
                continue
            out += [_repaired(run), s.decode()]
            run = b""
        return "".join(out)


def _repaired(run: bytes) -> str:
    """Bytes as UTF-8; each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def piece_model(vocabulary: str = "piece_bpe_32k.model") -> PieceModel:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return PieceModel(f.read())


def with_pieces(docs: DataFrame, text: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Add ids, span_starts and span_ends (bytes of the text) of all pieces, and ``decoded``, the text that the ids give."""
    ship(docs.sparkSession)
    added = StructType.fromDDL(RESULTS)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in set(added.names) and c != text])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        schema = to_arrow_schema(added)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                found, high, held = [], low, 0
                while high < batch.num_rows and held < PART:  # lists of a few million pieces at a time
                    value = batch.column(at)[high].as_py() or ""
                    ids, starts, ends = model.encode(value)
                    found.append((ids, starts, ends, model.decode(ids)))
                    held += len(value)
                    high += 1
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]), pa.int32())).cast(schema.field(k).type) for k in range(3)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array([f[3] for f in found], pa.string())], names=[*part.schema.names, *added.names])
                low = high

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))
