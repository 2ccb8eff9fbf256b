"""Hierarchical multi-length packing of documents into token sequences (operator 2).

Every document is encoded and closed by an end id. Whole windows of the longest tier are
cut off it; the rest is routed to the shortest tier that holds it. Tiers are packed
from the longest to the shortest: a window opens with the longest piece of its tier,
its gap is filled by the longest piece of any tier that fits, and where none does, by the
head of the shortest one that is longer; the tail goes back to the tier of its length.
So a window is full, and only a task's very last ids need padding.
Windows of one tier make step groups of equally many tokens, and so of equal cost.

All of it runs in the task that reads the documents: nothing is shuffled. A task holds one
pool of pieces at a time (``pool_ids``); what is left of a pool goes on in the next.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from pagetrawl.llm.common import encoder, slices, strings

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
TIERS = (256, 512, 1024)
#: Ids of sequences and groups hold the task's number above this many bits.
LOCAL_BITS = 36


class Pool:
    """Pieces by length; the longest or shortest length in a range is found in a bit mask."""

    def __init__(self):
        self.by_length, self.mask, self.ids = defaultdict(list), 0, 0

    def put(self, piece) -> None:
        length = piece[2]
        self.by_length[length].append(piece)
        self.mask |= 1 << length
        self.ids += length

    def take(self, length: int):
        found = self.by_length[length]
        piece = found.pop()
        self.ids -= length
        if not found:
            self.mask &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to ``most``, 0 if there is none."""
        return (self.mask & ((1 << most + 1) - 1)).bit_length() - 1 if self.mask & ((1 << most + 1) - 1) else 0

    def shortest(self, least: int) -> int:
        """The shortest length from ``least`` on, 0 if there is none."""
        rest = self.mask >> least
        return least + (rest & -rest).bit_length() - 1 if rest else 0


def fill(pool: Pool, size: int) -> list:
    """A window of ``size`` ids from a pool that holds as many."""
    window, gap = [], size
    while gap:
        if length := pool.longest(gap):
            piece = pool.take(length)
        else:
            document, start, length = pool.take(pool.shortest(gap))
            piece = (document, start, gap)
            pool.put((document, start + gap, length - gap))
        window.append(piece)
        gap -= piece[2]
    return window


def pack_pool(pool: Pool, tiers, last: bool):
    """Windows ``(tier, pieces)`` of a pool; with ``last`` nothing is left in it."""
    for size, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while pool.mask >> below + 1 and pool.ids >= size:
            yield size, fill(pool, size)
    while last and pool.ids:
        rest = pool.ids
        whole = 1 << rest.bit_length() - 1
        # one sequence up to the next power of two if that pads little, else a full one and go on
        size = rest if rest == whole or (whole * 2 - rest) * 8 <= rest and whole * 2 == tiers[-1] else min(whole, tiers[-1])
        yield next(t for t in tiers if t >= size), fill(pool, size)


def pack(
    docs: DataFrame, vocabulary: str, keeps_space: bool = True, end_id: int = 0,
    tiers: tuple[int, ...] = TIERS, step_ids: int = 8192, pool_ids: int = 1 << 20,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and where they lie, a row a piece; ``ids`` are its 32-bit ids.

    Tiers are powers of two, and ``step_ids`` is what a step group holds. Null or empty text is the
    end id alone. Repeated and null ids are packed like others, ``start`` counts in the row's own text. Other
    columns are ignored. Sequence ids are unique in the frame and the same in a repeated task.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, end = encoder(vocabulary, keeps_space), end_id.to_bytes(4, "little")
        base, most = TaskContext.get().partitionId() << LOCAL_BITS, tiers[-1]
        pool, rows, n_windows, groups, n_groups = Pool(), [], 0, {}, 0

        def place(tier, pieces):
            nonlocal n_windows, n_groups
            group, left = groups.get(tier, (0, 0))
            if left < tier:
                group, left = n_groups, step_ids
                n_groups += 1
            groups[tier] = group, left - tier
            offset = 0
            for (doc_id, ids), start, length in pieces:
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, part, len(ids) // 4, base + n_windows, offset, tier, base + group))
                offset += length
            n_windows += 1

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                ids = encode(text) + end
                n = len(ids) // 4
                document = (doc_id, ids)
                for start in range(0, n - most + 1, most):
                    place(most, [(document, start, most)])
                if rest := n % most:
                    pool.put((document, n - rest, rest))
                if pool.ids >= pool_ids:
                    for window in pack_pool(pool, tiers, False):
                        place(*window)
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
        for window in pack_pool(pool, tiers, True):
            place(*window)
        yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    long, names = pa.int64(), [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [long, long, long, pa.binary(), long, long, long, pa.int32(), long]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], names)
