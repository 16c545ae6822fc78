"""Operator 6: exact Jaccard join on word n-grams with adaptive multi-match prefixes.

Sets are put into one global order: members from rare to frequent, by a sketch of counts
over the whole table, ties by their hash. Of two sets that are linked, the first
``n - a + m`` members in that order (n members, a the overlap needed) share at least m. Each
set picks its own m: the one with the lowest estimated cost, longer postings against
fewer candidates. A pair needs as many shared prefix members as the smaller of its two m,
and as many as its two sizes ask for beyond what can stand behind the prefixes
(:func:`needed_matches`), before it is verified on the whole sets.

1. One pass makes each text's set digest and the sketch; equal sets are one class from here on.
2. A second pass writes the prefixes; members that one class alone has are dropped.
3. Members of at most ``light`` classes give pairs of compatible sizes, counted per pair; those
   whose signatures are near enough (:func:`difference`) are verified by set intersection.
4. Members of more classes (large groups of near copies) give no pairs: their classes are
   dealt into blocks of at most ``BLOCK_MEMBERS`` set members and ``BLOCK_CLASSES`` classes, by
   bands of sizes, of which only equal and adjacent ones can hold links. Every two such blocks
   of one member meet in one task, which tells by sizes and signatures which classes may have links,
   and in one with these classes' sets, which counts each class's links and returns a spanning
   forest of them. A pair belongs to the least common prefix member of this kind alone
   (or, without one, to step 3), so it is verified and counted once; sets are fetched only for
   classes that have such pairs. No key makes a task larger than two blocks, and no
   group emits its square.
5. Connected components by large-star and small-star steps on the links.

Words have hashes of 128 bits, members of 64 and classes of 128 (of which the first half alone
finds candidates; what is verified carries both). Sets are compared by their members' hashes.
Defined results: a null or empty text, or one of white space, has no members, no links and is
in a component of its own; a null doc_id takes part, but never names a component unless no
other id is in it (then the component is null); rows that repeat are linked as equal
sets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_1, Words, checkpointed, chunks, mixed, release, sequence_hashes, stored
from ledgerline.llm.components import connected_components
from ledgerline.shipping import shipped

SHINGLE = 3
PERCENT = 90
#: Bits of the sketch for small and for large tables: 2**23 cells of 5 bytes are broadcast at most.
SKETCH_BITS = (20, 23)
#: Least number of a signature's counts; larger sets have one for about every 4 to 8 members.
SIGNATURE = 64
MOST_MATCHES = 8
#: Expected candidates of a member that the sketch knows nothing of.
PRIOR = 0.05
LIGHT = 64
BLOCK_MEMBERS = 1 << 19
BLOCK_CLASSES = 1024
HOT = 512
#: Largest filter of the classes whose members are fetched: 32 MB, whatever the table's size.
FILTER_BITS = 28
_CELLS = 14
_MARKS = 17


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams; of fewer words the whole sequence is the one member."""
    words = Words(texts, lower=True)
    at, hashes = words.windows(shingle)
    bounds = np.searchsorted(words.owner[at], np.arange(len(texts) + 1)) if len(at) else np.zeros(len(texts) + 1, dtype=np.int64)
    out = []
    for i in range(len(texts)):
        n = int(words.counts[i])
        if n >= shingle:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif n:
            out.append(sequence_hashes(*words.hashes, words.first[i : i + 1], n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Members that a set of n shares at least with any set that it is linked to."""
    return -(-n * percent // 100)


def prefix(members: np.ndarray, levels: np.ndarray, frequent: np.ndarray, percent: int = PERCENT, most: int = MOST_MATCHES) -> tuple[np.ndarray, int]:
    """The set's prefix in the global order, and how many of its members a partner must share.

    levels: the order's first key of each sketch cell; frequent: estimated candidates of a member of the cell.
    """
    n = len(members)
    cells = (members >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)
    order = np.lexsort((members, levels[cells]))
    needed = least_overlap(n, percent)
    base = n - needed
    most = min(most, needed)
    cost = np.cumsum(frequent[cells[order[: base + most]]])[base:]
    matches = np.arange(1, len(cost) + 1)
    # Posting entries to write and read, and sets to fetch for candidates, which fall off with the matches asked for.
    total = base + matches + cost + n * cost / (matches * matches)
    ell = int(np.argmin(total)) + 1
    return members[order[: base + ell]], ell


def needed_matches(percent: int = PERCENT) -> Column:
    """Prefix members that a pair of sets (n_x, matches_x, n_y, matches_y) must share to be linked.

    At least the smaller of the two ``matches``. And of the set whose prefix ends earlier in
    the order, prefix members that the other has are all in the other's prefix, so the whole
    overlap is at most the shared ones and what stands behind that prefix.
    """
    overlap = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent))
    behind = [F.ceil(percent * F.col(f"n_{k}") / F.lit(100)) - F.col(f"matches_{k}") for k in "xy"]
    return F.greatest(F.least("matches_x", "matches_y"), overlap - F.greatest(*behind))


def set_digest(members: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the set."""
    n = np.uint64(len(members))
    with np.errstate(over="ignore"):
        a = mixed(np.array([members.sum(dtype=np.uint64) + n * MIX_1]))[0]
        b = mixed(np.array([np.bitwise_xor.reduce(mixed(members + MIX_1)) ^ n]))[0] if len(members) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signature(members: np.ndarray) -> np.ndarray:
    """How many members end in each number, modulo 256."""
    size = max(SIGNATURE, 1 << (len(members) // 8).bit_length())
    return np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8)


def _folded(signatures: np.ndarray, size: int) -> np.ndarray:
    """The shorter signatures that the same sets would have, of those along the last axis."""
    return signatures.reshape(*signatures.shape[:-1], -1, size).sum(axis=-2, dtype=np.uint8)


def difference(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of how many members at least a set differs from each of some others, by their signatures (rows of one length)."""
    size = min(len(own), others.shape[1])
    apart = _folded(others, size) - _folded(own, size)
    return np.minimum(apart, -apart).sum(axis=1, dtype=np.int64)


def most_difference(n: int, others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of how many members at most a set of n differs from linked ones of the given sizes."""
    return n + others - 2 * -(-percent * (n + others) // (100 + percent))


def _packed(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """Blocks of cells that are not all zero, compressed."""
    blocks = counts.reshape(-1, min(1 << _CELLS, len(counts)))
    return [(int(i), zlib.compress(blocks[i].astype("<i8").tobytes(), 1)) for i in np.flatnonzero(blocks.any(axis=1))]


def _merged(packed: DataFrame, kind: str, join: Callable) -> Iterator[tuple[int, np.ndarray]]:
    """Each block (block, cells) merged over all rows; as many as the blocks, whatever the number of rows."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(cells.as_py()), kind)
                held[block] = join(held[block], own) if block in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["block", "cells"])

    # Two levels, so that a block's sum doesn't wait for one task to read all of its parts.
    salted = packed.withColumn("salt", F.spark_partition_id() % 16)
    for r in salted.repartition("block", "salt").select("block", "cells").mapInArrow(run, "block int, cells binary").repartition("block").mapInArrow(run, "block int, cells binary").collect():
        yield r["block"], np.frombuffer(zlib.decompress(bytes(r["cells"])), kind)


def _sets(docs: DataFrame, shingle: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, a, b and signature of every row, and the counts of the sketch's cells."""
    names = ["doc_id", "n", "a", "b", "signature", "block", "cells"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (2 * docs.count()).bit_length()))

    def run(batches):
        release()
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for start, texts in chunks(x.as_py() or "" for x in batch.column(1)):
                sets = shingle_sets(texts, shingle)
                found = np.concatenate(sets)
                cells, times = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                counts[cells.astype(np.int64)] += times
                digests = [set_digest(x) for x in sets]
                nothing = [pa.nulls(len(texts), k) for k in kinds[5:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([len(x) for x in sets], kinds[1]), *[pa.array([d[i] for d in digests], pa.int64()) for i in range(2)], pa.array([signature(x).tobytes() for x in sets], pa.binary()), *nothing], names)
        packed = _packed(counts)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(packed), k) for k in kinds[:5]], *[pa.array([x[i] for x in packed], kinds[5 + i]) for i in range(2)]], names)

    both = checkpointed(shipped(docs).mapInArrow(run, "doc_id long, n int, a long, b long, signature binary, block int, cells binary"))
    counts = np.zeros((-(-(1 << bits) // (1 << _CELLS)), min(1 << _CELLS, 1 << bits)), dtype=np.int64)
    for block, own in _merged(both.where("block is not null").select("block", "cells"), "<i8", np.add):
        counts[block] = own
    return both.where("block is null").select("doc_id", "n", "a", "b", "signature"), counts.reshape(-1)


def _postings(docs: DataFrame, counts: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """member, a, n and matches: the prefix of each set, once a task."""
    mean = counts.mean()
    levels = np.floor(2 * np.log2(1 + np.maximum(0, counts - mean))).astype(np.uint8)
    frequent = np.maximum(PRIOR, counts - mean - 3 * np.sqrt(mean)).astype(np.float32)
    # 5 bytes a cell.
    shared = docs.sparkSession.sparkContext.broadcast((levels, frequent))

    def run(batches):
        levels, frequent = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in chunks(x.as_py() or "" for x in batch.column(1)):
                rows = []
                for members in shingle_sets(texts, shingle):
                    if len(members) and (digest := set_digest(members)) not in seen:
                        seen.add(digest)
                        rows.append((digest[0], len(members), *prefix(members, levels, frequent, percent)))
                if rows:
                    sizes = [len(x[2]) for x in rows]
                    columns = [np.concatenate([x[2] for x in rows]).view(np.int64), *[np.repeat(np.array([x[i] for x in rows], dtype=kind), sizes) for i, kind in ((0, np.int64), (1, np.int32), (3, np.int32))]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["member", "a", "n", "matches"])

    return docs.mapInArrow(run, "member long, a long, n int, matches int")


def _marks(wanted: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, eight a byte: those set that the first bits of the numbers ``a`` name."""
    width = min(_MARKS, bits)

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for own in np.split(at, np.flatnonzero(np.diff(at >> width)) + 1):
                if len(own):
                    marked = np.zeros(1 << width, dtype=bool)
                    marked[own & (1 << width) - 1] = True
                    held[int(own[0] >> width)] = np.packbits(marked) | held.get(int(own[0] >> width), np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["block", "cells"])

    out = np.zeros((1 << bits - width, 1 << width - 3), dtype=np.uint8)
    for block, own in _merged(wanted.mapInArrow(mark, "block int, cells binary"), "u1", np.bitwise_or):
        out[block] = own
    return out.reshape(-1)


def _members(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """a, b and members of the classes in ``wanted`` (and of some others that the filter lets pass), once a task."""
    bits = min(FILTER_BITS, max(10, (16 * wanted.count()).bit_length()))
    marked = docs.sparkSession.sparkContext.broadcast(_marks(wanted, bits))

    def run(batches):
        marks, seen = marked.value, set()
        for batch in batches:
            for _, texts in chunks(x.as_py() or "" for x in batch.column(1)):
                found = []
                for members in shingle_sets(texts, shingle):
                    if len(members):
                        a, b = set_digest(members)
                        at = (a & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                        if marks[at >> 3] >> (7 - (at & 7)) & 1 and (a, b) not in seen:
                            seen.add((a, b))
                            found.append((a, b, members.view(np.int64)))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["a", "b", "members"])

    return docs.mapInArrow(run, "a long, b long, members array<long>")


class _Counter:
    """How many members each of some sets shares with a given one, by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        order = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.starts = np.unique(self.flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def shared(self, own: np.ndarray) -> np.ndarray:
        """With each of the sets."""
        if not len(own) or not len(self.keys):
            return np.zeros(len(self.sizes), dtype=np.int64)
        k = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        k = k[self.keys[k] == own]
        lengths = self.ends[k] - self.starts[k]
        at = np.repeat(self.starts[k] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def shared_with(self, own: np.ndarray, some: np.ndarray) -> np.ndarray:
        """With the sets of the given numbers, which are a few of all; ``own`` is sorted."""
        lengths = self.sizes[some]
        before = np.cumsum(lengths) - lengths
        theirs = self.flat[np.repeat(self.first[some] - before, lengths) + np.arange(int(lengths.sum()))]
        k = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        return np.add.reduceat((own[k] == theirs).astype(np.int64), before)


def block_pairs(left: tuple[np.ndarray, list[np.ndarray]], right: tuple[np.ndarray, list[np.ndarray]] | None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """Every i of left with the j of right (of left itself, j < i, where right is None) that are the block's to compare.

    Either side: sizes of sets, and the heavy prefix members of each that stand before the
    block's own. Pairs that share one of those are another block's.
    """
    sizes, before = right or left
    counter, apart = _Counter(before), {}
    for i, (n, earlier) in enumerate(zip(left[0].tolist(), left[1], strict=True)):
        if (key := earlier.tobytes()) not in apart:
            apart[key] = counter.shared(earlier) == 0
        theirs = sizes if right else sizes[:i]
        some = np.flatnonzero(apart[key][: len(theirs)] & (100 * theirs >= percent * n) & (100 * n >= percent * theirs))
        if len(some):
            yield i, some


def block_links(left: tuple[list[np.ndarray], list[np.ndarray]], right: tuple[list[np.ndarray], list[np.ndarray]] | None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """Every i of left with the j of right (of left itself, j < i, where right is None) that it is linked to.

    Either side: sorted sets, and their earlier heavy members as for :func:`block_pairs`.
    """

    def sized(side):
        return side and (np.fromiter(map(len, side[0]), dtype=np.int64, count=len(side[0])), side[1])

    members = _Counter((right or left)[0])
    for i, some in block_pairs(sized(left), sized(right), percent):
        own = left[0][i]
        shared = members.shared_with(own, some) if 8 * len(some) < len(members.sizes) else members.shared(own)[some]
        linked = some[100 * shared >= percent * (len(own) + members.sizes[some] - shared)]
        if len(linked):
            yield i, linked


def forest_and_counts(links: Iterator[tuple[int, np.ndarray]], rows: np.ndarray, offset: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links, and for each node the sum of ``rows`` over those that it is linked to.

    Nodes are the left ones and then, from ``offset`` on, the right ones (``offset`` 0: the same ones).
    """
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest, counts = [], np.zeros(len(rows), dtype=np.int64)
    for i, linked in links:
        linked = linked + offset
        counts[i] += rows[linked].sum()
        counts[linked] += rows[i]
        for j in linked.tolist():
            if (x := root(i)) != (y := root(j)):
                parent[x] = y
                forest.append((i, j))
    return forest, counts


def _near(signatures: list[np.ndarray], sizes: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of i and some others' numbers that gives those of them whose signatures don't rule a link out."""
    lengths = np.fromiter(map(len, signatures), dtype=np.int64, count=len(signatures))
    at, rows = np.zeros(len(lengths), dtype=np.int64), {}
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        at[own], rows[length] = np.arange(len(own)), np.array([signatures[k] for k in own])

    def near(i: int, some: np.ndarray) -> np.ndarray:
        most, kept = most_difference(int(sizes[i]), sizes[some], percent), np.zeros(len(some), dtype=bool)
        for length, own in rows.items():
            mine = np.flatnonzero(lengths[some] == length)
            if len(mine):
                kept[mine] = difference(signatures[i], own[at[some[mine]]]) <= most[mine]
        return some[kept]

    return near


def _near_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a_x, a_y, n_x, n_y) whose signatures don't rule a link out."""

    def run(batches):
        for batch in batches:
            n_x, n_y = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = ([np.frombuffer(s.as_py(), np.uint8) for s in batch.column(k)] for k in (4, 5))
            most = most_difference(n_x, n_y, percent)
            kept = np.fromiter((difference(s, t[None, :])[0] <= m for s, t, m in zip(x, y, most, strict=True)), dtype=bool, count=len(x))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(kept)) for k in (0, 1)], ["a_x", "a_y"])

    # Sets that share the first half of their key may have several signatures; a pair stays if any of them lets it.
    for k in "xy":
        pairs = pairs.join(signatures.select(F.col("a").alias(f"a_{k}"), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"signature_{k}")), [f"a_{k}", f"n_{k}"])
    return pairs.select("a_x", "a_y", "n_x", "n_y", "signature_x", "signature_y").mapInArrow(run, "a_x long, a_y long").distinct()


def _tasks(heavy: DataFrame, percent: int) -> DataFrame:
    """member, a, n, is_left and task (two blocks) of each class and each two blocks that may hold links of it.

    A block is a band of sizes and a number; a member that fits one block has no bands.
    """
    # Sizes of linked sets differ by at most one band; the small surplus is above any rounding.
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    heavy = heavy.withColumn("band", F.floor(F.log("n") / width)) if percent < 100 else heavy.withColumn("band", F.col("n").cast("long") * 2)
    bands = heavy.groupBy("member", "band").agg(F.sum("n").alias("size"), F.count("*").alias("classes"))
    # A member has as many bands as different sizes' logarithms, some hundred.
    own = Window.partitionBy("member")
    bands = bands.withColumn("fits", (F.sum("size").over(own) <= BLOCK_MEMBERS) & (F.sum("classes").over(own) <= BLOCK_CLASSES)).withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("classes") / BLOCK_CLASSES)))
    order = own.orderBy("band")
    beside = [F.when(step("band", 1).over(order) == F.col("band") + by, step("blocks", 1).over(order)).otherwise(F.lit(0)).alias(name) for name, step, by in (("above", F.lead, 1), ("below", F.lag, -1))]
    bands = bands.select("member", "band", "fits", "blocks", *beside)
    rows = heavy.join(bands, ["member", "band"]).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))

    def task(is_left: Column, *of: Column) -> Column:
        return F.struct(is_left.alias("is_left"), *[x.cast("long").alias(name) for x, name in zip(of, ("band_x", "block_x", "band_y", "block_y"), strict=True)])

    def each(blocks: str, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col(blocks)), lambda j: j < F.col(blocks)), make)

    band, at = F.col("band"), F.col("own")
    alone = F.array(task(F.lit(True), *[F.lit(0)] * 4))
    same = each("blocks", lambda j: task(at <= j, band, F.least(at, j), band, F.greatest(at, j)))
    higher, lower = each("above", lambda j: task(F.lit(True), band, at, band + 1, j)), each("below", lambda j: task(F.lit(False), band - 1, j, band, at))
    return rows.select("member", "a", "n", F.explode(F.when(F.col("fits"), alone).otherwise(F.concat(same, higher, lower))).alias("task")).select("member", "a", "n", "task.*")


_KEYS = ("member", "band_x", "block_x", "band_y", "block_y")


def _sides(table: pa.Table) -> tuple[np.ndarray, int, bool]:
    """The rows with the left ones first, how many these are, and whether both sides are one block."""
    is_left = table.column("is_left").to_numpy(zero_copy_only=False)
    return np.concatenate((np.flatnonzero(is_left), np.flatnonzero(~is_left))), int(is_left.sum()), all(table.column(f"{c}_x")[0] == table.column(f"{c}_y")[0] for c in ("band", "block"))


def _lists(table: pa.Table, column: str, order: np.ndarray) -> list[np.ndarray]:
    return [np.sort(table.column(column)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i in order.tolist()]


def _asked(heavy: DataFrame, theirs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The rows of :func:`_tasks`, with the earlier heavy members, that have a pair there that may be linked.

    Near copies share most of their heavy members, and nearly all of their pairs are the first few's. So it is told
    first, without the sets, which classes a block has pairs of, and their sets alone are sent there.
    """

    def asked(table: pa.Table) -> pa.Table:
        order, n, one_block = _sides(table)
        sizes, before = table.column("n").to_numpy()[order].astype(np.int64), _lists(table, "before", order)
        near = _near([np.frombuffer(table.column("signature")[i].as_py(), np.uint8) for i in order.tolist()], sizes, percent)
        wanted = np.zeros(len(order), dtype=bool)
        for i, some in block_pairs((sizes[:n], before[:n]), None if one_block else (sizes[n:], before[n:]), percent):
            some = near(i, some if one_block else some + n)
            wanted[i] |= len(some) > 0
            wanted[some] = True
        return table.take(pa.array(np.sort(order[wanted]))).drop_columns(["signature"])

    tasks = _tasks(heavy, percent).join(theirs, "a").withColumn("before", F.expr("filter(heavy, h -> h < member)")).select(*_KEYS, "is_left", "a", "n", "before")
    return tasks.join(signatures, ["a", "n"]).select(*tasks.columns, "signature").groupBy(*_KEYS).applyInArrow(asked, tasks.schema).distinct()


def links(docs: DataFrame, sets: DataFrame, classes: DataFrame, counts: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT, light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """Links (x_a, x_b, y_a, y_b) that connect all linked classes, and (a, b, n_links) of every linked class.

    sets: a, n and signature of every row; classes: a, b and rows. n_links counts the rows of the other classes that a class is linked to.
    """
    postings = stored(_postings(docs, counts, shingle, percent))
    shared = postings.groupBy("member").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least != most").select("member")
    kept = checkpointed(postings.join(shared, "member", "left_semi").dropDuplicates(["member", "a", "n", "matches"]))
    sizes = kept.groupBy("member").agg(F.count("*").alias("classes"))
    rare = kept.join(sizes.where(F.col("classes") <= light), "member")
    one, two = (rare.select("member", *[F.col(c).alias(f"{c}_{k}") for c in ("a", "n", "matches")]) for k in "xy")
    compatible = (F.col("a_x") < F.col("a_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    pairs = one.join(two, "member").where(compatible).groupBy("a_x", "a_y", "n_x", "n_y", "matches_x", "matches_y").agg(F.count("*").alias("both"))
    pairs = checkpointed(pairs.where(F.col("both") >= needed_matches(percent)).select("a_x", "a_y", "n_x", "n_y").distinct())
    heavy = checkpointed(kept.join(sizes.where(F.col("classes") > light), "member", "left_semi").select("member", "a", "n").distinct())
    # Most candidates of a large table are chance ones, and more so the larger it is. Signatures tell them apart
    # at a few hundredths of the bytes of their sets, so that what is fetched and sent grows with the links.
    met = pairs.select(F.col("a_x").alias("a")).unionByName(pairs.select(F.col("a_y").alias("a"))).unionByName(heavy.select("a")).distinct()
    of_a = sets.groupBy("a").agg(F.collect_set(F.struct("n", "signature")).alias("own"))
    signatures = checkpointed(of_a.join(met, "a", "left_semi").select("a", F.explode("own").alias("own")).select("a", "own.*"))
    pairs = checkpointed(_near_pairs(pairs, signatures, percent))
    theirs = heavy.groupBy("a").agg(F.sort_array(F.collect_set("member")).alias("heavy"))
    tasks = checkpointed(_asked(heavy, theirs, signatures, percent))
    wanted = checkpointed(pairs.select(F.col("a_x").alias("a")).unionByName(pairs.select(F.col("a_y").alias("a"))).unionByName(tasks.select("a")).distinct())
    # All by the one key a, so that the members are shuffled once; the second half of a class's key is compared beside it.
    about = classes.select("a", F.col("b").alias("own_b"), "rows").join(wanted, "a", "left_semi").join(theirs, "a", "left")
    found = _members(docs, wanted, shingle).repartition("a").dropDuplicates(["a", "b"]).join(about, "a").where(F.col("b").bitwiseXOR(F.col("own_b")) == 0)
    members = checkpointed(found.select("a", "b", "members", "rows", F.coalesce("heavy", F.array().cast("array<long>")).alias("heavy")))

    first, second = (members.select(*[F.col(c).alias(f"{c}_{k}") for c in members.columns]) for k in "xy")
    overlap = F.size(F.array_intersect("members_x", "members_y"))
    verified = pairs.join(first, "a_x").join(second, "a_y").withColumn("overlap", overlap).where(F.col("overlap") * 100 >= percent * (F.size("members_x") + F.size("members_y") - F.col("overlap")))
    # Pairs with a common heavy member are that member's.
    verified = checkpointed(verified.where(~F.arrays_overlap("heavy_x", "heavy_y")).select("a_x", "b_x", "a_y", "b_y", "rows_x", "rows_y"))

    names = ["a_x", "b_x", "a_y", "b_y", "n_links"]

    def compare(table: pa.Table) -> pa.Table:
        order, n, one_block = _sides(table)
        a, b, rows = (table.column(c).to_numpy()[order] for c in ("a", "b", "rows"))
        sets, before = (_lists(table, c, order) for c in ("members", "before"))
        found = block_links((sets[:n], before[:n]), None if one_block else (sets[n:], before[n:]), percent)
        forest, counts = forest_and_counts(found, rows, 0 if one_block else n)
        x, y = (np.array([p[i] for p in forest], dtype=np.int64) for i in range(2))
        some = np.flatnonzero(counts)
        edges = [a[x], b[x], a[y], b[y]]
        parts = [pa.array(np.concatenate((edges[0], a[some])), pa.int64()), pa.array(np.concatenate((edges[1], b[some])), pa.int64()), *[pa.array([*e.tolist(), *[None] * len(some)], pa.int64()) for e in edges[2:]], pa.array([*[None] * len(x), *counts[some].tolist()], pa.int64())]
        return pa.table(parts, names)

    tasks = tasks.join(members, "a").where(F.size("members") == F.col("n"))
    dense = checkpointed(tasks.select(*_KEYS, "is_left", "a", "b", "rows", "members", "before").groupBy(*_KEYS).applyInArrow(compare, ", ".join(f"{c} long" for c in names)))
    pairs = verified.select(*names[:4]).unionByName(dense.where("n_links is null").select(*names[:4]))
    ends = [verified.select(F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b"), F.col(f"rows_{other}").alias("n_links")) for k, other in ("xy", "yx")]
    ends.append(dense.where("n_links is not null").select(F.col("a_x").alias("a"), F.col("b_x").alias("b"), "n_links"))
    return pairs, ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("a", "b").agg(F.sum("n_links").alias("n_links"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, light: int = LIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and n_links (other rows linked to it) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sets, counts = _sets(texts, shingle)
    classes = checkpointed(sets.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    pairs, partners = links(texts, sets.where("n > 0"), classes, counts, shingle, percent, light)
    pairs = checkpointed(pairs)
    sets = sets.drop("signature")
    # Linked classes get numbers for the contraction; they are written down, so they stay as they are.
    ends = pairs.select(F.col("a_x").alias("a"), F.col("b_x").alias("b")).unionByName(pairs.select(F.col("a_y").alias("a"), F.col("b_y").alias("b"))).distinct()
    nodes = checkpointed(ends.withColumn("node", F.monotonically_increasing_id()))
    numbered = pairs
    for k in "xy":
        numbered = numbered.join(nodes.select(F.col("a").alias(f"a_{k}"), F.col("b").alias(f"b_{k}"), F.col("node").alias(k)), [f"a_{k}", f"b_{k}"])
    roots = nodes.join(connected_components(numbered.select("x", "y"), "x", "y"), "node").select("a", "b", "root").join(partners, ["a", "b"])
    linked = checkpointed(classes.join(roots, ["a", "b"]).select("a", "b", "root", "least", "n_links"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("a", "b", "component_id", "n_links")
    named = checkpointed(classes.join(of_linked, ["a", "b"], "left").select("a", "b", "rows", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    # Fewer than HOT classes can each have more than a HOT-th of the rows; theirs don't meet at one key.
    hot = F.col("rows") * HOT > docs.count()
    rows = sets.where("n > 0").join(F.broadcast(named.where(hot).drop("rows")), ["a", "b"], "left")
    others = rows.where("n_links is null").select("doc_id", "n", "a", "b").join(named.where(~hot).drop("rows"), ["a", "b"])
    with_members = rows.where("n_links is not null").unionByName(others).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    none = F.lit(0).cast("long")
    return with_members.unionByName(sets.where("n = 0").select("doc_id", none.alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("n_links")))
