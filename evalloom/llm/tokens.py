"""Token ids of whole texts under the public tokenizers, in batches on the executors.

Vocabulary files are named by parameter and found on every node by ``public_tokenizers.path``; nothing is copied.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def byte_level_encoder(vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> Callable[[str], np.ndarray]:
    """text -> uint32 ids. With ``ranks`` the same vocabulary runs in tiktoken (the same ids, five times faster).

    Special tokens in a text get their ids, as the tokenizers library gives them; none is added.
    """
    import public_tokenizers

    @lru_cache(maxsize=1)
    def plain():  # noqa: ANN202  loaded where a text needs it only
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(vocabulary))

    if ranks is None:
        return lambda text: np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    return encode


class WordCache:
    """ids of whole texts by a vocabulary that drops white space and case (word_bpe_49k.json), from its distinct parts.

    The vocabulary's own split cuts a text into runs of letters, single digits, runs of other signs and the English
    endings 's 't 're 've 'm 'll 'd, which are encoded apart from each other, so a text's ids are those of its parts in
    turn. Texts of the first 256 code points, which its normalization leaves alone but for case, are split here with numpy
    over their bytes; a part is known by a 64-bit hash, and the tokenizers library encodes each new one once, many at a
    time. Their last ids tell the parts apart: only these end a word. All other texts, and those that may hold special
    tokens, the library encodes whole. What is remembered is bounded by ``most`` parts.
    """

    def __init__(self, vocabulary: str = "word_bpe_49k.json", most: int = 1_500_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.most, self.bits = most, 22
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.first = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint16)
        self.n = self.room = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian uint16 bytes."""
        texts = list(texts)
        plain: list[int] = []
        other: list[int] = []
        for k, t in enumerate(texts):
            try:
                t.encode("latin-1")
                (other if "<|" in t else plain).append(k)
            except UnicodeEncodeError:
                other.append(k)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(other, self._whole([texts[k] for k in other]), strict=True):
            out[k] = ids
        at = 0
        while at < len(plain):  # slices of about a million characters
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(texts[plain[end]]) < 1 << 20):
                size += len(texts[plain[end]])
                end += 1
            for k, ids in zip(plain[at:end], self._slice([texts[k] for k in plain[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        # one space between texts; a byte is a character
        data = _LOWER[np.frombuffer("".join([" ", *(t + " " for t in texts)]).encode("latin-1"), np.uint8)]
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        starts, ends = _parts(data)
        h = _part_hashes(data, starts, ends)
        index = self._find(h)
        new = np.flatnonzero(index < 0)
        if len(new):
            try:
                self._add(data, starts[new], ends[new], h[new])
            except _Full:
                self.forget()
                new = np.arange(len(h))
                self._add(data, starts, ends, h)
            index[new] = self._find(h[new], sure=True)
        size = self.size.take(index)
        total = np.cumsum(size, dtype=np.int64)
        count = int(total[-1]) if len(total) else 0
        places = np.repeat(self.first.take(index) - (total - size), size) + np.arange(count)
        ids = self.pool.take(places)
        cuts = np.concatenate([[0], total])[np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])]
        raw = ids.astype("<u2").tobytes()
        return [raw[2 * a : 2 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _find(self, h: np.ndarray, sure: bool = False) -> np.ndarray:
        """Entries of the hashes, -1 where there is none. A hash has two places in the table."""
        a = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys.take(a) == h, self.entry.take(a), -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            own = h[rest]
            b = (own & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            out[rest] = np.where(self.keys.take(b) == own, self.entry.take(b), -1)
        if sure and len(lost := np.flatnonzero(out < 0)):  # pushed out of both its places by others of this slice
            out[lost] = [self.spare[x] for x in h[lost].tolist()]
        return out

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        unique, at = np.unique(h, return_index=True)
        if self.n and self.n + len(unique) > self.most:
            raise _Full
        text = data.tobytes().decode("latin-1")
        words = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        size = np.diff(np.concatenate([[-1], last]))
        n, room = self.n + len(words), self.room + len(ids)
        if n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.first, self.size))
        if room > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(room, np.uint16)])
        self.first[self.n : n] = self.room + last - size + 1
        self.size[self.n : n] = size
        self.pool[self.room : room] = ids
        entry = np.arange(self.n, n, dtype=np.int32)
        self.spare = dict(zip(unique.tolist(), entry.tolist(), strict=True))
        a = (unique >> np.uint64(64 - self.bits)).astype(np.int64)
        b = (unique & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        place = np.where(self.keys[a] == 0, a, b)
        self.keys[place], self.entry[place] = unique, entry
        self.n, self.room = n, room


class _Full(Exception):
    """The cache holds as much as it may."""


# Classes of the first 256 code points in the split: 0 white space, 1 letter, 2 number, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
_CLASS[[*range(97, 123), *range(65, 91), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32


def _parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the parts of small-letter Latin-1 bytes that begin and end with a space."""
    kind = _CLASS[data]
    begin = np.empty(len(data), bool)
    begin[:1] = False
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero((data[:-1] == 39) & begin[:-1] & (kind[1:] == 1))
    if len(quotes):  # the English endings come before all else where a part begins
        one = np.isin(data[quotes + 1], np.frombuffer(b"stmd", np.uint8))
        pair = data[quotes + 1].astype(np.int32) * 256 + data[np.minimum(quotes + 2, len(data) - 1)]
        two = ~one & np.isin(pair, [ord(x[0]) * 256 + ord(x[1]) for x in ("re", "ve", "ll")])
        for hit, n in ((quotes[one], 1), (quotes[two], 2)):
            begin[hit + 1] = False
            after = hit + n + 1
            begin[after] |= kind[after] != 0
    starts = np.flatnonzero(begin & (kind != 0))
    # a part ends where the next begins or at white space
    stop = begin | (kind == 0)
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, "right")]


def _part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from evalloom.llm.vector_text import Words

    h = Words(data, np.array([0, len(data)]), starts, ends, np.array([0, len(starts)])).hashes()
    return np.where(h == 0, np.uint64(1), h)


@lru_cache(maxsize=2)
def word_cache(vocabulary: str) -> WordCache:
    """One for each Python worker: what one task has learned serves the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    return WordCache(vocabulary)
