"""Top N items within every group: bounded heaps built before the shuffle and merged after it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups held by one task before their heaps are emitted; a group emitted twice is merged later.
FLUSH_GROUPS = 50_000
_NO_RANK = 1 << 40


class _Worse:
    """Turns heapq's smallest-first heap into one whose root is the worst entry."""

    __slots__ = ("key",)

    def __init__(self, key: tuple) -> None:
        self.key = key

    def __lt__(self, other: "_Worse") -> bool:
        return self.key > other.key


class BoundedHeap:
    """The n best entries (-score, rank, id) of one group; mergeable, each id once with its best entry."""

    __slots__ = ("n", "entries")

    def __init__(self, n: int) -> None:
        self.n, self.entries = n, []

    def push(self, key: tuple) -> None:
        e = self.entries
        if len(e) >= self.n and key >= e[0].key:
            return
        for i, x in enumerate(e):
            if x.key[2] == key[2]:
                if key < x.key:
                    e[i] = _Worse(key)
                    heapq.heapify(e)
                return
        if len(e) < self.n:
            heapq.heappush(e, _Worse(key))
        else:
            heapq.heapreplace(e, _Worse(key))

    def best(self) -> list[tuple]:
        return sorted(x.key for x in self.entries)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    g, i, s, r = (batch.column(k).to_pylist() for k in range(4))
    return zip(g, i, s, r)


def _emit(heaps: dict) -> pa.RecordBatch:
    g, i, s, r = [], [], [], []
    for group, heap in heaps.items():
        for entry in heap.entries:
            neg, rank, item = entry.key
            g.append(group)
            i.append(item)
            s.append(-neg)
            r.append(None if rank == _NO_RANK else rank)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64()), pa.array(r, pa.int64())], names=["g", "i", "s", "r"])


def top_n(df: DataFrame, group: str, item: str, score: str, rank: str, n: int = 5) -> DataFrame:
    """(group, place, item, score) of the n best items of each group.

    Order: higher score, then smaller rank (null last), then smaller item. Rows with a null group,
    null item, or null or NaN score don't count; a repeated (group, item) counts once, with its
    best row. An empty table gives no rows. Tasks keep at most n entries a group, so a group with
    a third of all rows sends n rows from each task, and the merge streams over sorted groups.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, BoundedHeap] = {}
        for batch in batches:
            for g, i, s, r in _rows(batch):
                h = heaps.get(g)
                if h is None:
                    h = heaps[g] = BoundedHeap(n)
                h.push((-s, _NO_RANK if r is None else r, i))
            if len(heaps) >= FLUSH_GROUPS:
                yield _emit(heaps)
                heaps = {}
        yield _emit(heaps)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, None
        out: list[list] = [[], [], [], []]

        def close() -> None:
            for place, (neg, _, item) in enumerate(heap.best(), 1):
                for c, v in zip(out, (now, place, item, -neg)):
                    c.append(v)

        def drain() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.float64()))], names=["g", "place", "i", "s"])
            for c in out:
                c.clear()
            return b

        for batch in batches:
            for g, i, s, r in _rows(batch):
                if heap is None or g != now:
                    if heap is not None:
                        close()
                    now, heap = g, BoundedHeap(n)
                heap.push((-s, _NO_RANK if r is None else r, i))
            yield drain()
        if heap is not None:
            close()
        yield drain()

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"), F.col(rank).cast("long").alias("r")).where("g is not null and i is not null and s is not null and not isnan(s)")
    heaps = rows.mapInArrow(partial, "g string, i string, s double, r long")
    done = heaps.repartition("g").sortWithinPartitions("g").mapInArrow(merge, "g string, place int, i string, s double")
    return done.select(F.col("g").alias(group), "place", F.col("i").alias(item), F.col("s").alias(score))
