"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt into islands of about ``island_rows`` pieces by a hash. An island evolves packings
of its own pieces: crossover injects whole well-filled bins of one parent into another, drops the bins that hold the same
pieces, and best-fits the pieces so displaced. Between epochs the elite bins of an island (as patterns of lengths) migrate
to the next island, whose crossover injects them as far as it has pieces of those lengths. An island at its lower bound
has nothing to gain and rests. When the islands are done, the least filled tenth of each one's bins
is opened and those pieces meet again on fewer islands, until one is left: what an island could not match, others can.

Everything is keyed by hashes of row numbers: copies, hot sources and equal lengths spread evenly. An island holds a
bounded number of small integers; no text and no ids pass through a shuffle.

Defined results
* null or empty text: one piece, the end id alone. Longer documents: full pieces, only the first may be shorter.
* equal rows (same id too) are packed as separate documents. Ties are broken by row number.
* an empty table gives an empty result; only the columns named are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.llm.tokens import byte_level_encoder
from evalloom.session import ship

Bins = list[list[int]]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of ``size`` but the first."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int, end_id: int, vocabulary: str, ranks: str | None, with_ids: bool = False) -> DataFrame:
    """One row a piece of every whole document: doc_id, piece, start, length, ids_crc32, item (a row number)[, ids]."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("item", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(vocabulary, ranks)
        end = np.array([end_id], np.uint32)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for k in range(batch.num_rows):
                ids = np.concatenate([encode(texts[k].as_py() or ""), end]).astype("<u4", copy=False)
                doc = ids_of[k].as_py()
                for p, (s, n) in enumerate(cut(len(ids), size)):
                    raw = ids[s : s + n].tobytes()
                    out.append((doc, p, s, n, zlib.crc32(raw), item) + ((raw,) if with_ids else ()))
                    item += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [()] * len(fields), fields, strict=True)], schema=schema)

    ship(docs.sparkSession)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, item long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


class Island:
    """Packings of one set of pieces. Pieces are known by their place in ``lengths``."""

    def __init__(self, lengths: list[int], size: int, seed: int, population: int, generations: int, patience: int):
        self.lengths, self.size = lengths, size
        self.least = -(-sum(lengths) // size)
        self.random = random.Random(seed)
        self.population, self.generations, self.patience = population, generations, patience

    def fill(self, b: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, b))

    def best_fit(self, bins: Bins, loose: list[int]) -> Bins:
        """Put each loose piece into the bin that it fills best. Free spaces are the bits of one integer."""
        by_space: dict[int, list[int]] = defaultdict(list)
        free = 0
        for k, b in enumerate(bins):
            space = self.size - self.fill(b)
            by_space[space].append(k)
            free |= 1 << space
        for i in loose:
            n = self.lengths[i]
            wide = free >> n
            if wide:
                space = n + (wide & -wide).bit_length() - 1
                k = by_space[space].pop()
                if not by_space[space]:
                    free &= ~(1 << space)
                bins[k].append(i)
            else:
                space, k = self.size, len(bins)
                bins.append([i])
            by_space[space - n].append(k)
            free |= 1 << (space - n)
        return bins

    def fitness(self, bins: Bins) -> tuple[int, int]:
        return len(bins), -sum(self.fill(b) ** 2 for b in bins)

    def founders(self) -> list[Bins]:
        """Best fit of the pieces by falling length, and of orders disturbed a little."""
        order = sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i])
        out = [self.best_fit([], order)]
        while len(out) < self.population and len(out[0]) > self.least:
            noise = [self.lengths[i] * (1 + 0.3 * self.random.random()) for i in range(len(self.lengths))]
            out.append(self.best_fit([], sorted(order, key=lambda i: -noise[i])))
        return out

    def cross(self, host: Bins, gift: Bins) -> Bins:
        """Inject the whole bins of ``gift``; bins of ``host`` that share a piece go, their other pieces are best-fitted."""
        taken = {i for b in gift for i in b}
        kept, loose = [], []
        for b in host:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                loose += [i for i in b if i not in taken]
        # open the worst-filled bins too: displaced pieces alone rarely leave room to improve
        kept.sort(key=self.fill)
        few = min(len(kept), 1 + self.random.randrange(4))
        loose += [i for b in kept[:few] for i in b]
        loose.sort(key=lambda i: -self.lengths[i])
        return self.best_fit([*kept[few:], *map(list, gift)], loose)

    def well_filled(self, bins: Bins) -> Bins:
        full = [b for b in bins if self.fill(b) >= self.size - 2]
        return self.random.sample(full, min(len(full), max(1, len(full) // 2))) if full else []

    def gift_of(self, patterns: list[list[int]]) -> Bins:
        """Migrant bins, made of this island's pieces of the same lengths."""
        have: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.lengths):
            have[n].append(i)
        out = []
        for p in patterns:
            got = [have[n].pop() for n in p if have[n]]
            if len(got) == len(p):
                out.append(got)
            else:
                for i in got:
                    have[self.lengths[i]].append(i)
        return out

    def evolve(self, founders: list[Bins], migrants: list[list[int]]) -> Bins:
        people = sorted(founders, key=self.fitness)[: self.population]
        if migrants and len(people[0]) > self.least:
            people.append(self.cross(people[0], self.gift_of(migrants)))
            people.sort(key=self.fitness)
        idle = 0
        for _ in range(self.generations):
            if len(people[0]) <= self.least or idle >= self.patience or len(people) < 2:
                break
            host, other = self.random.sample(range(len(people)), 2)
            child = self.cross(people[host], self.well_filled(people[other]))
            idle = 0 if self.fitness(child) < self.fitness(people[0]) else idle + 1
            people = sorted([*people, child], key=self.fitness)[: self.population]
        return people[0]


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, item long, island long, bin int, offset long, fill long, bins int, least int, opened boolean"


def pack(
    docs: DataFrame,
    *,
    size: int = 1024,
    end_id: int = 2,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    island_rows: int = 8192,
    opened: float = 0.1,
    population: int = 6,
    generations: int = 24,
    patience: int = 8,
    epochs: int = 2,
    elites: int = 64,
    seed: int = 11,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    all_pieces = materialize(pieces(docs, size, end_id, vocabulary, ranks), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = all_pieces.filter(F.col("length") == size).select(*columns, (F.col("item") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    options = (size, seed, population, generations, patience, opened)
    done, level = [full], 0
    open_ = all_pieces.filter(F.col("length") < size)
    while True:
        count = open_.count()
        if not count:
            break
        islands = max(1, -(-count // island_rows))
        dealt = open_.select(*columns, "item", F.pmod(F.xxhash64("item", F.lit(seed + level)), F.lit(islands)).alias("island"))
        placed = materialize(dealt.groupBy("island").applyInPandas(_first_epoch(*options), PLACED), "packed")
        for epoch in range(1, epochs):
            behind = placed.filter("bins > least")
            if islands == 1 or behind.isEmpty():
                break
            migrants = _migrants(placed, islands, size, elites)
            moved = behind.groupBy("island").cogroup(migrants.groupBy("island")).applyInPandas(_next_epoch(size, seed + epoch, population, generations, patience, opened), PLACED)
            placed = materialize(placed.filter("bins <= least").unionByName(moved), "packed")
        if islands > 1:
            open_ = materialize(placed.filter("opened").select(*columns, "item"), "opened")
            placed = placed.filter(~F.col("opened"))
        number = F.shiftleft(F.lit(level + 1).cast("long"), 52) + F.shiftleft(F.col("island"), 16) + F.col("bin")
        done.append(placed.select(*columns, number.alias("sequence_id"), "offset"))
        if islands == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _rows(pdf: pd.DataFrame, island: Island, bins: Bins, opened: float) -> pd.DataFrame:
    """opened: the share of the bins, the least filled first, whose pieces another level may pack again."""
    n = len(pdf)
    worst = sorted((island.fill(b), k) for k, b in enumerate(bins))[: max(1, int(opened * len(bins)))]
    again = [k for f, k in worst if f < island.size]
    bin_, offset, fill = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            bin_[i], offset[i] = k, at
            at += island.lengths[i]
        fill[b] = at
    return pdf.assign(bin=bin_, offset=offset, fill=fill, bins=np.int32(len(bins)), least=np.int32(island.least), opened=np.isin(bin_, again))


_COLUMNS = [c.strip().split(" ")[0] for c in PLACED.split(",")]


def _first_epoch(size: int, seed: int, population: int, generations: int, patience: int, opened: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        island = Island(pdf["length"].tolist(), size, seed + int(pdf["island"].iloc[0]), population, generations, patience)
        return _rows(pdf, island, island.evolve(island.founders(), []), opened)[_COLUMNS]

    return run


def _next_epoch(size: int, seed: int, population: int, generations: int, patience: int, opened: float):
    def run(pdf: pd.DataFrame, migrants: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pdf[_COLUMNS]
        pdf = pdf.sort_values("item", ignore_index=True)
        island = Island(pdf["length"].tolist(), size, seed + int(pdf["island"].iloc[0]), population, generations, patience)
        before = [list(v) for v in pdf.groupby("bin", sort=True).indices.values()]
        patterns = sorted(list(map(int, p)) for p in migrants["pattern"])
        best = island.evolve([before, *island.founders()], patterns)
        return _rows(pdf, island, best, opened)[_COLUMNS]

    return run


def _migrants(placed: DataFrame, islands: int, size: int, elites: int) -> DataFrame:
    """The fullest bins of each island, as patterns of lengths, addressed to the next island of the ring."""
    bins = placed.filter(F.col("fill") >= size - 2).groupBy("island", "bin").agg(F.array_sort(F.collect_list(F.col("length"))).alias("pattern"))
    few = bins.groupBy("island").agg(F.slice(F.array_sort(F.collect_list(F.struct("bin", "pattern"))), 1, elites).alias("some"))
    return few.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.explode("some").alias("one")).select("island", "one.pattern")
