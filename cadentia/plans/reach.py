"""Sources that reach a target in one or two steps, counted without storing a pair of the two.

The links are kept twice, packed as arrays: in blocks of targets with the nodes that lead to them, and in blocks of
sources with the nodes they lead to. Every block of targets meets every block of sources by a cartesian product of the
two tables, which reads them again instead of shuffling them. A pair of blocks forms its pairs in batches, marks them
and returns counts, so disk grows with the links and a task holds two blocks and a batch, whatever the degrees are.

A block is a run of at most ``LINKS`` links in order, so it cuts at most its first and its last key. What such a key
has in common with the other side is returned one row each, and made distinct behind the product; all other keys lie
in one block and are counted in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.session import materialise

# Links in a block, pairs formed at a time, and marks held at a time, at most.
LINKS, PAIRS, MARKS = 4_000_000, 250_000, 8_000_000
FOUND = "account long, source long, n long"


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key and node of the links ``(slot, key, node)``, in runs of at most ``most`` links of one slot."""
    held, size, slot = [], 0, None
    for batch in batches:
        slots, keys, nodes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for begin, end in pairwise([0, *(np.flatnonzero(np.diff(slots)) + 1), len(slots)]):
            while begin < end:
                if held and (size == most or slots[begin] != slot):
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
                slot, upto = slots[begin], min(end, begin + most - size)
                held.append((keys[begin:upto], nodes[begin:upto]))
                size, begin = size + upto - begin, upto
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a run in its order, and where each begins; one more entry says where the last ends."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]).astype(np.int64)
    return keys[starts], np.append(starts, len(keys))


def _target_block(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    targets, starts = _grouped(keys)
    # Who pays the target itself reaches it too, so it is one of the nodes that lead to it.
    nodes = np.insert(nodes, starts[1:], targets)
    mids, codes = np.unique(nodes, return_inverse=True)
    return targets, starts + np.arange(len(starts)), mids, codes.astype(np.int32)


def _source_block(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    sources, starts = _grouped(keys)
    mids, codes = np.unique(nodes, return_inverse=True)
    places = np.repeat(np.arange(len(sources), dtype=np.int32), np.diff(starts))[np.argsort(codes, kind="stable")]
    return sources, np.concatenate([[0], np.cumsum(np.bincount(codes))]), mids, places


def _packed(links: DataFrame, key: str, node: str, order: Sequence[str], block, prefix: str) -> DataFrame:
    """Blocks of the links in ``order``, which begins with what stands for the key; stored."""
    names, most = [f"{prefix}{i}" for i in range(4)], LINKS
    placed = links.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = placed.select(F.spark_partition_id().alias("slot"), F.col(key).alias("key"), F.col(node).alias("node"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, most):
            yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in block(*run)], names)

    return materialise(rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)), prefix)


class _Batch:
    """Pairs of a stretch of targets with the sources of a block, each distinct pair marked once."""

    def __init__(self, n: np.ndarray, first: np.ndarray, owner: np.ndarray, places: np.ndarray, width: int, marks: np.ndarray | None):
        ends = np.cumsum(n)
        kind = np.int64 if marks is None else np.int32
        at = np.arange(ends[-1], dtype=kind)
        key = places[at + np.repeat((first - ends + n).astype(kind), n)] + np.repeat(owner.astype(kind) * kind(width), n)
        self.width = width
        if marks is None:
            self.keys = np.unique(key)
        else:
            # The last to write its number is the one that counts; what stood there before does not matter.
            marks[key] = at
            self.keys = key[marks[key] == at]
        self.marks, self.at, self.key = marks, at, key

    def counts(self, targets: int) -> np.ndarray:
        return np.bincount(self.keys // self.width, minlength=targets)

    def has(self, wanted: np.ndarray) -> np.ndarray:
        if self.marks is None:
            return np.isin(wanted, self.keys)
        at = self.marks[wanted]
        inside = (at >= 0) & (at < len(self.key))
        return inside & (self.key[np.where(inside, at, 0)] == wanted)

    def of(self, target: int) -> np.ndarray:
        mine = self.keys[self.keys // self.width == target]
        return mine - target * self.width


def _heavy(n: np.ndarray, first: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Places of the sources of one target that has very many pairs."""
    seen = np.zeros(width, bool)
    for begin, end in zip(first, first + n, strict=True):
        seen[places[begin:end]] = True
    return np.flatnonzero(seen)


def _meet(targets, starts, mids, codes, sources, begins, nodes, places, marks) -> Iterator[tuple[np.ndarray, ...]]:
    """``account, source, n`` of a pair of blocks: counts without a source, and rows for the keys that may be cut."""
    at = np.minimum(np.searchsorted(nodes, mids), len(nodes) - 1)
    length = np.where(nodes[at] == mids, begins[at + 1] - begins[at], 0)
    if not length.any():
        return
    first, width, count = begins[at], len(sources), len(targets)
    upto = np.concatenate([[0], np.cumsum(np.add.reduceat(length[codes], starts[:-1]))])
    # Where a target is a source of this block: it does not reach itself.
    by_id = np.argsort(sources)
    place = np.minimum(np.searchsorted(sources, targets, sorter=by_id), width - 1)
    itself = np.where(sources[by_id[place]] == targets, by_id[place], -1)
    rows, cut_sources, d = max(1, MARKS // width), np.unique([0, width - 1]), 0
    while d < count:
        e = min(count, max(d + 1, int(np.searchsorted(upto, upto[d] + PAIRS, "right")) - 1))
        narrow = min(e, d + rows)
        # Where marks would hold few pairs at a time, sorting them costs less.
        marked = narrow == e or upto[narrow] - upto[d] >= PAIRS // 64
        e = narrow if marked else e
        if upto[e] == upto[d]:
            d = e
            continue
        links = codes[starts[d]:starts[e]]
        n, owner = length[links], np.repeat(np.arange(e - d), np.diff(starts[d:e + 1]))
        some = n > 0
        n, begin, owner = n[some], first[links[some]], owner[some]
        own = itself[d:e]
        if upto[e] - upto[d] > PAIRS:
            found = _heavy(n, begin, places, width)
            found = found[found != own[0]]
            listed = found if d in (0, count - 1) else np.intersect1d(found, cut_sources)
            numbers = np.array([len(found) - len(listed)])
            yield np.full(len(listed), targets[d]), sources[listed], None
        else:
            batch = _Batch(n, begin, owner, places, width, marks if marked else None)
            numbers = batch.counts(e - d)
            back = np.flatnonzero(own >= 0)
            numbers[back] -= batch.has(back * width + own[back])
            for i in cut_sources:
                hit = np.flatnonzero(batch.has(np.arange(e - d) * width + i))
                hit = hit[own[hit] != i]
                numbers[hit] -= 1
                yield targets[d:e][hit], np.full(len(hit), sources[i]), None
            for i in {0, count - 1} & set(range(d, e)):
                found = batch.of(i - d)
                numbers[i - d] = 0
                found = found[found != own[i - d]]
                yield np.full(len(found), targets[i]), sources[found], None
        some = numbers > 0
        yield targets[d:e][some], None, numbers[some]
        d = e


def reach_counts(edge: DataFrame, numbers: DataFrame) -> DataFrame:
    """``account, n``: distinct sources other than itself that reach an account over one or two links.

    ``edge(src, dst)`` holds every link once and no link of a node to itself. ``numbers(src, num)`` orders the sources:
    those with neighbouring numbers share blocks, so the more they have in common, the fewer blocks have work together.
    """
    into = _packed(edge, "dst", "src", ["dst", "src"], _target_block, "targets")
    out = _packed(edge.join(numbers, "src"), "src", "dst", ["num", "dst"], _source_block, "sources")
    # Arrays of eight bytes but for the last of a block.
    kinds = [np.int64, np.int64, np.int64, np.int32] * 2

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(MARKS, np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, kinds, strict=True)]
                for account, source, n in _meet(*arrays, marks):
                    null = pa.nulls(len(account), pa.int64())
                    yield pa.record_batch([
                        pa.array(account, pa.int64()), null if source is None else pa.array(source, pa.int64()),
                        null if n is None else pa.array(n, pa.int64()),
                    ], ["account", "source", "n"])

    found = into.crossJoin(out).mapInArrow(meet, FOUND)
    each = found.groupBy("account", "source").agg(F.sum("n").alias("n"))
    return each.groupBy("account").agg(F.sum(F.when(F.col("source").isNull(), F.col("n")).otherwise(1)).alias("n"))
