"""N-gram Jaccard self-join by signature trees.

Documents link when their sets of word shingles have a Jaccard similarity of ``percent`` or more. The join has three parts:

1. Buckets. Documents with equal sets become one node first. A node goes to the buckets of its min-hashes; shingles that a
   large share of the documents have (a bounded list found in a first pass) are left out of these, so a common passage fills
   no bucket. The number of min-hashes grows with the share of a document that is left out, so that a pair that links
   misses all common buckets with a probability of a few billionths. Documents made of common shingles also use min-hashes
   of the whole set. What fills buckets beyond ``bucket_rows`` nodes all the same, passages too rare for the first pass, is
   looked up there, joins the list, and all keys are taken anew. With ``keys="prefix"`` buckets are exact instead: a node
   goes to those of its rarest shingles, as many as a linked partner cannot all lack (a quarter of the set, some ten times
   the keys). Buckets that hold the same nodes are one.
2. Signature trees in each bucket: leaves are bitmaps of the nodes' shingles, inner nodes OR them and keep the range of set
   sizes; the dual traversal drops a pair of tree nodes whose largest possible overlap cannot reach the similarity. What is
   left connects nodes into groups; a bucket beyond ``bucket_rows`` connects all its nodes without looking.
3. Exact sets. Each node's set goes to its group once. Groups are dealt into blocks of about ``block_rows``; a block is
   joined by its own signature tree and pairs that already hang together are not compared. Classes of different blocks meet
   through one member each, and where a group still has several classes, all pairs of blocks that hold different classes
   are joined too. So no link between different texts is lost, and no block, bucket or group is cut.

Components of the links found are the classes (see ``connected``). No link, bitmap or set reaches the driver; the list of
common shingles is broadcast and bounded (``most_common``).

Defined results
* null or empty text, or one of white space: no shingles, linked with nothing, its own component.
* fewer words than ``size``: the whole sequence is the one shingle.
* rows that share a doc_id are one node. A null doc_id: component null, unless its set equals that of a row with an id.
* repeated rows: one result row each. An empty table gives an empty result. Extra columns are not read.
* shingles are compared by 48-bit hashes of their words (A-Z as a-z).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.llm.connected import Union, components
from evalloom.llm.screens import screened, without
from evalloom.llm.vector_text import SET_BITS, mix64, shingle_hashes, shingles, slices
from evalloom.session import ship

_ODD = (mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
#: (largest share f of common shingles, min-hashes): without its common shingles a linked pair keeps a similarity of
#: (0.75 - f) / (1 - f) at least, and so many min-hashes all differ with a probability of a few billionths.
STEPS = ((0.02, 14), (0.1, 15), (0.25, 18), (0.5, 28), (1.0, 42))
#: Beyond this share min-hashes of the whole set serve as well: linked pairs below it miss 42 buckets with 0.625 ** 42.
MOSTLY = 0.6
MANY, WHOLE = STEPS[-1][1], 16
#: Bits of a screen for each wanted text.
TEXT_BITS = 32


def common_shingles(docs: DataFrame, size: int, share: float, least: int, most: int, chunk: int = 16 << 20) -> np.ndarray:
    """Hashes of shingles found often, ascending: those frequent in some chunk of the texts and ``least`` times in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts = room = 0

        def often() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(values)))
            keep = n >= max(8, share * texts)
            return pa.RecordBatch.from_pydict({"h": values[at[keep]].astype(np.int64), "n": n[keep].astype(np.int64)})

        for batch in batches:
            for _, w in slices(batch.column(0)):
                held.append(shingle_hashes(w, size)[0])
                texts += len(w.counts)
                room += len(w.data)
                if room > chunk:
                    yield often()
                    held, texts, room = [], 0, 0
        yield often()

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.uint64))


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap for ``n`` shingles: a power of two, at least twice as many."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(values: np.ndarray, bits: int) -> int:
    """Bit h mod ``bits`` of each hash; a bitmap folds to half its bits by OR of its halves."""
    flags = np.zeros(bits, np.uint8)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits >>= 1
        x = (x & ((1 << bits) - 1)) | (x >> bits)
    return x


class Tree:
    """A signature tree over (size, bitmap, bits) of some nodes."""

    FAN = 6

    def __init__(self, sizes: list[int], maps: list[int], bits: list[int], percent: int):
        self.percent = percent
        self.order = sorted(range(len(sizes)), key=lambda i: (sizes[i], maps[i]))
        self.sizes, self.maps, self.bits = sizes, maps, bits
        # a node: (least size, largest size, bits, OR of bitmaps, most shingles that share a bit with another, children or leaf)
        level = [(sizes[i], sizes[i], bits[i], maps[i], sizes[i] - maps[i].bit_count(), i) for i in self.order]
        while len(level) > 1:
            level = [self.above(level[k : k + self.FAN]) for k in range(0, len(level), self.FAN)]
        self.root = level[0] if level else None

    @staticmethod
    def above(nodes: list[tuple]) -> tuple:
        if len(nodes) == 1:
            return nodes[0]
        bits = min(n[2] for n in nodes)
        x = 0
        for n in nodes:
            x |= fold(n[3], n[2], bits)
        # a folded bitmap no longer tells how many shingles share bits: all of them may
        lost = max(n[4] if n[2] == bits else n[1] for n in nodes)
        return min(n[0] for n in nodes), max(n[1] for n in nodes), bits, x, lost, nodes

    def possible(self, a: tuple, b: tuple) -> bool:
        """Whether some pair below ``a`` and ``b`` may be similar enough."""
        p = self.percent
        if 100 * a[1] < p * b[0] or 100 * b[1] < p * a[0]:
            return False
        bits = min(a[2], b[2])
        common = (fold(a[3], a[2], bits) & fold(b[3], b[2], bits)).bit_count()
        # a shared shingle sets a common bit; more than one may set the same, at most those lost by either side
        lost = min(a[4] if a[2] == bits else a[1], b[4] if b[2] == bits else b[1])
        most = min(common + lost, a[1], b[1])
        # |A and B| >= p / (100 + p) (|A| + |B|)
        return most * (100 + p) >= p * (a[0] + b[0])

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that no bound rules out, each once."""
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            a, b = stack.pop()
            below_a, below_b = a[5], b[5]
            if a is b:
                if isinstance(below_a, int):
                    continue
                for k, x in enumerate(below_a):
                    stack.append((x, x))
                    stack += [(x, y) for y in below_a[k + 1 :] if self.possible(x, y)]
            elif isinstance(below_a, int) and isinstance(below_b, int):
                yield below_a, below_b
            elif isinstance(below_b, int) or not isinstance(below_a, int) and a[1] - a[0] >= b[1] - b[0]:
                stack += [(x, b) for x in below_a if self.possible(x, b)]
            else:
                stack += [(a, y) for y in below_b if self.possible(a, y)]


def signatures(docs: DataFrame, size: int, common: np.ndarray, percent: int = 75, keys: str = "minima") -> DataFrame:
    """doc_id, n, two numbers that identify the set, keys (buckets) and bitmap of every document."""
    if keys not in ("minima", "prefix"):
        raise ValueError(f"keys are minima or prefix, not {keys}")
    prefixed = keys == "prefix"
    shared = docs.sparkSession.sparkContext.broadcast(common)
    kinds = "doc_id long, n long, id1 long, id2 long, keys array<long>, map binary"
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("keys", pa.list_(pa.int64())), ("map", pa.binary())])

    def minima(values: np.ndarray, first: np.ndarray, has: np.ndarray, functions: range) -> np.ndarray:
        """The min-hash of each text that ``has`` shingles, a column for each function."""
        out = np.zeros((len(has), len(functions)), np.int64)
        shifted = values << np.uint64(64 - SET_BITS)
        for k, f in enumerate(functions):
            least = np.minimum.reduceat(shifted * _ODD[f], first[has]) if len(has) else np.zeros(0, np.uint64)
            out[:, k] = mix64(least ^ _ODD[63 - f]).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        screen = np.zeros(1 << 16, bool)
        screen[(often >> np.uint64(SET_BITS - 16)).astype(np.int64)] = True
        for batch in batches:
            for at, w in slices(batch.column(1)):
                values, first = shingles(w, size)
                n = np.diff(first)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                ids = [(s[first[1:]] - s[first[:-1]]).astype(np.int64) for s in sums]
                warm = np.zeros(len(values), bool)
                maybe = np.flatnonzero(screen[(values >> np.uint64(SET_BITS - 16)).astype(np.int64)]) if len(often) else np.zeros(0, np.int64)
                if len(maybe):
                    warm[maybe] = often[np.minimum(np.searchsorted(often, values[maybe]), len(often) - 1)] == values[maybe]
                doc = np.repeat(np.arange(len(n)), n)
                maps = [_packed(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(at, len(n)), pa.array(n), pa.array(ids[0]), pa.array(ids[1])]
                if prefixed:
                    yield pa.RecordBatch.from_arrays([*columns, _rarest(values, warm, doc, first, percent), pa.array(maps, pa.binary())], schema=schema)
                    continue
                cold, cold_n = values[~warm], np.bincount(doc[~warm], minlength=len(n))
                share = 1 - cold_n / np.maximum(n, 1)
                has = np.flatnonzero(cold_n > 0)
                keys: list = [None] * len(n)
                done = 0
                for top, many in STEPS:  # the functions each step adds, for the texts that need them
                    own = has if not done else has[share[has] > least]
                    if len(own):
                        mask = np.isin(doc[~warm], own) if done else slice(None)
                        own_first = np.concatenate([[0], np.cumsum(cold_n[own])])
                        for d, row in zip(own.tolist(), minima(cold[mask], own_first, np.arange(len(own)), range(done, many)).tolist(), strict=True):
                            keys[d] = (keys[d] or []) + row
                    done, least = many, top
                mostly = np.flatnonzero((share > MOSTLY) & (n > 0))
                if len(mostly):
                    mask = np.isin(doc, mostly)
                    whole = minima(values[mask], np.concatenate([[0], np.cumsum(n[mostly])]), np.arange(len(mostly)), range(MANY, MANY + WHOLE))
                    for d, row in zip(mostly.tolist(), whole.tolist(), strict=True):
                        keys[d] = (keys[d] or []) + row
                yield pa.RecordBatch.from_arrays([*columns, pa.array([k or [] for k in keys], pa.list_(pa.int64())), pa.array(maps, pa.binary())], schema=schema)

    return docs.mapInArrow(run, kinds)


def _rarest(values: np.ndarray, warm: np.ndarray, doc: np.ndarray, first: np.ndarray, percent: int) -> pa.Array:
    """The first n - ceil(percent n / 100) + 1 shingles of each set, common ones last, else in the order of scrambled hashes.

    Two sets that link overlap in ceil(percent n / 100) shingles at the least, so under one order of all shingles the first
    shingle that both have is among these of either.
    """
    scrambled = mix64(values * _ODD[0])
    order = np.lexsort((scrambled, warm, doc))
    n = np.diff(first)
    many = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
    rank = np.arange(len(values)) - np.repeat(first[:-1], n)
    kept = scrambled[order][rank < np.repeat(many, n)].view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pa.array(kept))


def _packed(values: np.ndarray) -> bytes:
    bits = bitmap_bits(len(values))
    flags = np.zeros(bits, np.uint8)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from batches sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if held and row[:keys] != held[0][:keys]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _pair_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in rows], pa.int64()), "b": pa.array([b for _, b in rows], pa.int64())})


def bucket_sizes(nodes: DataFrame) -> DataFrame:
    """(key, rows, least): the buckets of several nodes, their numbers of nodes and their smallest nodes."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    return materialize(keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("least")).filter(F.col("rows") > 1), "buckets")


def crowded_shingles(docs: DataFrame, nodes: DataFrame, size: int, bucket_rows: int, most: int, a_task: int = 2_000) -> np.ndarray:
    """Hashes of the shingles that fill the buckets of more than ``bucket_rows`` nodes, ascending: those that half as many of
    the nodes of such buckets have. Each of these nodes is looked at beside others of one of its buckets, so a passage that is
    rare in the table is found here however large the table is."""
    wide = materialize(bucket_sizes(nodes).filter(F.col("rows") > bucket_rows).select("key", "rows"), "wide-buckets")
    if wide.isEmpty():
        return np.zeros(0, np.uint64)
    keyed = screened(nodes.select(F.explode("keys").alias("key"), "node"), "key", wide.select("key")).join(wide, "key")
    one = materialize(keyed.groupBy("node").agg(F.min(F.struct("key", "rows")).alias("in_")).select(F.col("node").alias("doc_id"), "in_.*"), "crowded")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("rows") / a_task))
    texts = screened(docs.filter("doc_id is not null"), "doc_id", one.select("doc_id"), TEXT_BITS).join(one.withColumn("part", part), "doc_id")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    beside = texts.select("key", "part", "text").repartition(parts, "key", "part").sortWithinPartitions("key", "part")
    return common_shingles(beside, size, 0.0, max(2, bucket_rows // 2), most)


def coarse_links(nodes: DataFrame, percent: int, bucket_rows: int) -> DataFrame:
    """(a, b): links enough to connect all nodes that may be similar."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    counts = bucket_sizes(nodes)
    shared = materialize(screened(keyed, "key", counts.select("key")).join(counts, "key"), "shared")
    wide = shared.filter(F.col("rows") > bucket_rows).select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b")
    # near copies meet in many buckets, which mostly hold the same nodes: one of these is enough
    who = F.xxhash64("node")
    small = shared.filter(F.col("rows") <= bucket_rows)
    prints = small.groupBy("key").agg(F.count("*").alias("n_"), F.min("node").alias("lo_"), F.max("node").alias("hi_"), F.bit_xor(who).alias("xor_"), F.sum(F.shiftright(who, 16)).alias("sum_"))
    buckets = materialize(prints.groupBy("n_", "lo_", "hi_", "xor_", "sum_").agg(F.min("key").alias("key")).select("key"), "bucket-keys")
    small = materialize(screened(small, "key", buckets).join(buckets, "key").select("key", "node"), "bucket-nodes")
    placed = small.join(screened(nodes.select("node", "n", "map"), "node", small.select("node").distinct()), "node").select("key", "node", "n", "map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in groups_of(batches, 1):
            if len(rows) < 2:
                continue
            maps = [int.from_bytes(r[3], "little") for r in rows]
            tree = Tree([r[2] for r in rows], maps, [8 * len(r[3]) for r in rows], percent)
            union = Union(len(rows))
            for i, j in tree.pairs():
                union.join(i, j)
            out += [(rows[i][1], rows[union.find(i)][1]) for i in range(len(rows)) if union.find(i) != i]
            if len(out) > 10_000:
                yield _pair_batch(out)
                out = []
        yield _pair_batch(out)

    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = placed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return near.unionByName(wide)


SETS = "grp long, blk long, node long, n long, values binary"
JOINED = "grp long, blk long, node long, n long, values binary, root long"


def pack48(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _join_block(rows: list[tuple], percent: int, classes: list[int] | None = None) -> Union:
    """Exact links of a block's rows (grp, blk, node, n, values); rows of one class count as joined."""
    arrays = [unpack48(r[4]) for r in rows]
    bits = [bitmap_bits(len(a)) for a in arrays]
    union = Union(len(rows))
    if classes:
        seen: dict[int, int] = {}
        for i, c in enumerate(classes):
            union.join(i, seen.setdefault(c, i))
    tree = Tree([len(a) for a in arrays], [bitmap(a, b) for a, b in zip(arrays, bits, strict=True)], bits, percent)
    for i, j in tree.pairs():
        if union.find(i) == union.find(j):
            continue
        a, b = arrays[i], arrays[j]
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if 100 * same >= percent * (len(a) + len(b) - same):
            union.join(i, j)
    return union


def _join_blocks(percent: int):
    kinds = pa.schema([("grp", pa.int64()), ("blk", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("values", pa.binary()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, 2):
            union = _join_block(rows, percent)
            roots = [rows[union.find(i)][2] for i in range(len(rows))]
            # sets of the roots only: the next level compares nothing else
            sets = [r[4] if r[2] == root else None for r, root in zip(rows, roots, strict=True)]
            columns = [[r[k] for r in rows] for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sets, pa.binary()), pa.array(roots, pa.int64())], schema=kinds)

    return run


def _sets(size: int):
    schema = pa.schema([("grp", pa.int64()), ("blk", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in slices(batch.column(3)):
                values, first = shingles(w, size)
                raw = [pack48(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                k = len(raw)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, k) for c in range(3)), pa.array(np.diff(first)), pa.array(raw, pa.binary())], schema=schema)

    return run


def _dealt(nodes: DataFrame, block_rows: int, level: int) -> DataFrame:
    """``nodes`` with a block ``blk`` of their group each; a group has one for each ``block_rows`` of its nodes."""
    blocks = nodes.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    return nodes.join(blocks, "grp").withColumn("blk", F.pmod(F.xxhash64("node", F.lit(level)), F.col("blocks"))).drop("blocks")


def exact_classes(docs: DataFrame, groups: DataFrame, size: int, percent: int, block_rows: int) -> DataFrame:
    """(id, component): the classes of similar nodes of each group (node, grp)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # blocks are dealt before texts are read: sets are written where their texts are, and shuffled only to their blocks
    wanted = materialize(_dealt(groups, block_rows, 0).select(F.col("node").alias("doc_id"), "grp", "blk"), "wanted")
    texts = screened(docs.filter("doc_id is not null"), "doc_id", wanted.select("doc_id"), TEXT_BITS).join(wanted, "doc_id")
    sets = materialize(texts.select("grp", "blk", F.col("doc_id").alias("node"), "text").mapInArrow(_sets(size), SETS), "sets")
    dealt = sets
    links, level = [], 0
    while True:
        joined = dealt.repartition(parts, "grp", "blk").sortWithinPartitions("grp", "blk").mapInArrow(_join_blocks(percent), JOINED)
        joined = materialize(joined, "joined")
        links.append(joined.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        several = joined.groupBy("grp").agg(F.max("blk").alias("last"), F.count("*").alias("rows"), F.count(F.when(F.col("node") == F.col("root"), 1)).alias("roots")).filter("last > 0")
        going = materialize(several.filter(F.col("roots") <= 0.75 * F.col("rows")).select("grp"), "going")
        if level >= 8 or going.isEmpty():
            break
        items = materialize(joined.filter("node = root").join(going, "grp").select("grp", "node", "n", "values"), "roots")
        level += 1
        dealt = _dealt(items, block_rows, level).select("grp", "blk", "node", "n", "values")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    found = materialize(found, "links")
    class_of = components(found)
    rest = _between_blocks(sets, class_of, percent, block_rows, parts)
    return class_of if rest is None else components(class_of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))


def _between_blocks(sets: DataFrame, class_of: DataFrame, percent: int, block_rows: int, parts: int) -> DataFrame | None:
    """Links between nodes of different classes in groups of more than one block, or None where no such group is left.

    A large class has blocks of its own, small ones share blocks; pairs of blocks that hold one and the same class are left
    out, for their nodes hang together already.
    """
    wide = materialize(sets.filter("blk > 0").select("grp").distinct(), "wide")
    if wide.isEmpty():
        return None
    light = sets.select("grp", "node").join(wide, "grp", "left_semi").join(class_of.select(F.col("id").alias("node"), "component"), "node", "left")
    light = materialize(light.select("grp", "node", F.coalesce("component", "node").alias("cls")), "classes")
    mixed = light.groupBy("grp").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("grp")
    light = materialize(light.join(mixed, "grp", "left_semi"), "mixed")
    if light.isEmpty():
        return None
    by_class = light.groupBy("grp", "cls").agg(F.count("*").alias("rows"))
    small = by_class.filter(F.col("rows") < block_rows).groupBy("grp").agg(F.ceil(F.sum("rows") / block_rows).alias("shared"))
    plan = by_class.join(small, "grp", "left").select("grp", "cls", "rows", F.coalesce("shared", F.lit(1)).alias("shared"))
    pure = F.col("rows") >= block_rows
    blk = F.when(pure, F.xxhash64("cls", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / block_rows)))).otherwise(F.pmod(F.xxhash64("cls"), F.col("shared")))
    light = materialize(light.join(plan, ["grp", "cls"]).select("grp", "node", "cls", blk.alias("blk"), F.when(pure, F.col("cls")).alias("only")), "dealt")
    blocks = light.groupBy("grp", "blk").agg(F.min("only").alias("only"))
    pairs = blocks.alias("x").join(blocks.select("grp", F.col("blk").alias("other"), F.col("only").alias("other_only")).alias("y"), "grp")
    pairs = pairs.filter("blk <= other and not (only is not null and only <=> other_only)").select("grp", "blk", "other")
    sides = pairs.select("grp", "blk", F.struct("blk", "other").alias("pair")).unionByName(pairs.filter("blk <> other").select("grp", F.col("other").alias("blk"), F.struct("blk", "other").alias("pair")))
    own = screened(sets.select("node", "n", "values"), "node", light.select("node"))
    rows = light.join(sides, ["grp", "blk"]).join(own, "node").select("grp", F.col("pair.blk").alias("p"), F.col("pair.other").alias("q"), "node", "n", "values", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups_of(batches, 3):
            union = _join_block([(r[0], 0, r[3], r[4], r[5]) for r in own], percent, [r[6] for r in own])
            yield _pair_batch([(own[i][3], own[union.find(i)][3]) for i in range(len(own)) if union.find(i) != i])

    return materialize(rows.repartition(parts, "grp", "p", "q").sortWithinPartitions("grp", "p", "q").mapInArrow(run, "a long, b long"), "between")


def classes(docs: DataFrame, *, size: int = 5, percent: int = 75, keys: str = "minima", share: float = 0.005, least_common: int = 200, most_common: int = 200_000, bucket_rows: int = 256, block_rows: int = 200) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = common_shingles(docs, size, share, least_common, most_common)
    known = materialize(signatures(docs, size, common, percent, keys), "signatures")
    identity = ["n", "id1", "id2"]
    light = known.select("doc_id", *identity)
    same = light.filter("n > 0").groupBy(*identity).agg(F.min("doc_id").alias("node"))
    member = materialize(light.join(same, identity, "left").select("doc_id", "n", "id1", "node"), "members")
    # bitmaps and keys of copies are left where they are: one document stands for all with its set
    copies = materialize(member.filter("n > 0 and doc_id <> node").select(F.xxhash64("doc_id", "id1").alias("copy")).distinct(), "copies")

    def nodes_of(known: DataFrame) -> DataFrame:
        there = known.filter("n > 0 and doc_id is not null").withColumn("copy", F.xxhash64("doc_id", "id1"))
        return without(there, "copy", copies).select(F.col("doc_id").alias("node"), "n", "keys", "map")

    nodes = nodes_of(known)
    crowded = crowded_shingles(docs, nodes, size, bucket_rows, most_common)
    if len(np.setdiff1d(crowded, common)):
        nodes = nodes_of(materialize(signatures(docs, size, np.union1d(common, crowded), percent, keys), "signatures"))
    near = components(coarse_links(nodes, percent, bucket_rows))
    groups = near.select(F.col("id").alias("node"), F.col("component").alias("grp"))
    found = exact_classes(docs, groups, size, percent, block_rows)
    out = member.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with the columns of ``docs``; documents without words all stay."""
    found = classes(docs.select("doc_id", "text"), **options)
    found = materialize(found, "jaccard-classes")
    # ids clash with no column: the struct holds the row
    rows = docs.select(F.col("doc_id").cast("long").alias("id_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    dropped = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    kept = without(rows, "id_", dropped).select("row_.*")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id"])
