"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every document has a place on the token line of its source's shard; the line is cut into blocks of ``block`` tokens. Sources
get blocks by highest quotients target / (2k + 1), a source's blocks go to its shards the same way, and a seeded systematic
draw picks the blocks inside a shard. What a document gives is the part of it that chosen blocks cover.

A source is dealt into cells of about ``cell_rows`` documents by a seeded hash, so one source with a third of all rows is
many cells; only cell totals meet in a window of a shard, and only (source, shard) totals, at most ``max_shards`` a source,
reach the driver. Prefix sums inside a shard = cell offset + offset within the cell.

Defined results
* null text: size 0; its document gets 0. Null source: a source of its own, last in order.
* a source of size 0 has target 0. With no words at all every target is 0. An empty table gives an empty result.
* repeated rows are documents of their own; ties in the seeded order are broken by id and text hash, and rows equal in
  those are interchangeable. Reruns agree, whatever the partitioning.
* extra columns pass through; clashing names are avoided. A shard holds at most 2 ** 62 words.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import materialize, private, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Largest per-source or per-shard table (about 100 bytes a row) that is broadcast.
BROADCAST_ROWS = 20_000
#: From so many blocks a shard on, products of block numbers are decimals.
WIDE = 1 << 31


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Share ``share`` x all sizes by weight; no target above ``most`` x its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    left = share * sum(sizes)
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            free.discard(i)
        left = max(left, 0.0)
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), none above its cap. Equal quotients: the earlier party first.

    The first guess rounds votes / divisor (the same apportionment by Webster's divisor); a heap of quotients then adds or
    takes back what is over, so the work depends on the parties, not on the seats.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))
    won = [min(c, int(v * seats / total + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    count = sum(won)
    if count < seats:
        heap = [(-votes[i] / (2 * w + 1), i) for i, w in enumerate(won) if votes[i] > 0 and w < caps[i]]
        heapq.heapify(heap)
        while count < seats:
            _, i = heapq.heappop(heap)
            won[i] += 1
            count += 1
            if won[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    elif count > seats:
        heap = [(votes[i] / (2 * w - 1), -i) for i, w in enumerate(won) if w > 0]
        heapq.heapify(heap)
        while count > seats:
            _, j = heapq.heappop(heap)
            won[-j] -= 1
            count -= 1
            if won[-j] > 0:
                heapq.heappush(heap, (votes[-j] / (2 * won[-j] - 1), j))
    return won


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    max_block: int = 1024,
    cell_rows: int = 500,
    max_shards: int = 64,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Add size, source_size, target, taken (tokens) and copies (whole-document form of the same draw) to ``docs``."""
    names = private(docs, "size", "source_size", "target", "taken", "copies")
    size_, source_size_, target_, taken_, copies_ = names
    src, key, cell, start, n_cells, n_shards, shard, tokens_, before_, n_, q_, u_ = private(docs, *(f"mix_{x}" for x in ("source", "key", "cell", "start", "cells", "shards", "shard", "tokens", "before", "n", "q", "u")))
    sized = docs.withColumns(
        {
            size_: word_count(text_or_empty(f"`{text}`")),
            key: F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")),
            src: F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("name")),
        }
    )
    light = materialize(sized.select(src, key, size_), "mix-sizes")
    found = sorted((r["none"], r["name"], r["n"], r["s"]) for r in light.groupBy(src).agg(F.count("*").alias("n"), F.sum(size_).alias("s")).select(f"{src}.*", "n", "s").collect())
    spark = docs.sparkSession
    goal = targets([s for *_, s in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    cells = {f[:2]: max(1, -(-f[2] // cell_rows)) for f in found}
    shards = {k: min(max_shards, -(-n // 8)) for k, n in cells.items()}
    block = int(max(1, min([max_block, *(t // 256 for t in goal if t > 0)])))
    plan_schema = T.StructType([T.StructField("none", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("cells", T.LongType()), T.StructField("shards", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    plan = spark.createDataFrame([(f[0], f[1], cells[f[:2]], shards[f[:2]], f[3], t) for f, t in zip(found, goal, strict=True)], plan_schema).select(F.struct("none", "name").alias(src), F.col("cells").alias(n_cells), F.col("shards").alias(n_shards), F.col("source_size").alias(source_size_), F.col("target").alias(target_))
    if len(found) <= BROADCAST_ROWS:  # hot sources then need no shuffle; with more sources none is hot enough to matter
        plan = F.broadcast(plan)
    # one row a cell: its tokens, and where it begins in its shard
    in_cell = light.join(plan.select(src, n_cells, n_shards), src).withColumn(cell, F.pmod(F.col(key), F.col(n_cells)))
    totals = in_cell.groupBy(src, cell, F.pmod(F.col(cell), F.col(n_shards)).alias(shard)).agg(F.sum(size_).alias(tokens_))
    totals = materialize(totals, "mix-cells")
    shard_sizes: dict[tuple, list[tuple[int, int]]] = {f[:2]: [] for f in found}
    for r in totals.groupBy(src, shard).agg(F.sum(tokens_).alias("s")).select(f"{src}.*", F.col(shard).alias("shard"), "s").collect():
        shard_sizes[r["none"], r["name"]].append((r["shard"], r["s"]))
    blocks = {k: sum(-(-s // block) for _, s in v) for k, v in shard_sizes.items()}
    most_copies = int(most)
    won = sainte_lague(goal, round(sum(goal) / block), [most_copies * blocks[f[:2]] for f in found])
    rows = []
    for f, goal_i, seats in zip(found, goal, won, strict=True):
        own = sorted(shard_sizes[f[:2]])
        density = goal_i / f[3] if f[3] else 0.0
        quotas = sainte_lague([s * density for _, s in own], seats, [most_copies * -(-s // block) for _, s in own])
        rows += [(f[0], f[1], j, -(-s // block), q, (seed * 1_000_003 + j * 7919) % max(1, -(-s // block))) for (j, s), q in zip(own, quotas, strict=True)]
    quota_schema = "none boolean, name string, shard long, n long, q long, u long"
    quota = spark.createDataFrame(rows, quota_schema).select(F.struct("none", "name").alias(src), *[F.col(x).alias(y) for x, y in (("shard", shard), ("n", n_), ("q", q_), ("u", u_))])
    quota = F.broadcast(quota) if len(rows) <= BROADCAST_ROWS else quota
    before = Window.partitionBy(src, shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(before_, F.coalesce(F.sum(tokens_).over(before), F.lit(0))).join(quota, [src, shard]).select(src, cell, before_, n_, q_, u_)

    rest = [F.col(f"`{c}`") for c in docs.columns]
    placed = sized.join(plan, src).withColumn(cell, F.pmod(F.col(key), F.col(n_cells)))
    within = Window.partitionBy(src, cell).orderBy(F.col(key), F.col(f"`{doc_id}`"), F.col(size_)).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(start, F.coalesce(F.sum(size_).over(within), F.lit(0))).join(offsets, [src, cell])
    n = F.greatest(F.col(n_), F.lit(1))  # a shard without words has no blocks and no quota
    r, base, u = F.col(q_) % n, F.call_function("div", F.col(q_), n), F.col(u_)
    div = lambda x, y: F.call_function("div", x, y)  # noqa: E731  of whole numbers, exact
    number = T.DecimalType(19, 0) if max((row[3] for row in rows), default=0) >= WIDE else T.LongType()  # a product of two fits
    ahead = lambda x: div(x, n) * r + div((x % n).cast(number) * r.cast(number), n.cast(number))  # noqa: E731  blocks chosen among the first x, before the shift
    chosen = lambda k: ahead(k + u) - ahead(u)
    at = lambda p: div(p, F.lit(block).cast("long"))
    tokens = lambda p: block * chosen(at(p)) + (p - block * at(p)) * (chosen(at(p) + 1) - chosen(at(p)))
    first = F.col(before_) + F.col(start)
    middle = at(first + F.floor(F.col(size_) / 2).cast("long"))
    return placed.select(
        *rest,
        size_,
        source_size_,
        target_,
        (base * F.col(size_) + tokens(first + F.col(size_)) - tokens(first)).cast("long").alias(taken_),
        F.when(F.col(size_) == 0, 0).otherwise(base + chosen(middle + 1) - chosen(middle)).cast("int").alias(copies_),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each whole document as often as the draw takes it (0 to ``most`` times), with the columns of ``docs``."""
    out = mix(docs, **options)
    copies = out.columns[-1]
    (copy,) = private(docs, "copy")
    repeated = F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)
    return out.filter(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], repeated).drop(copy)
