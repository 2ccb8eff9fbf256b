"""Benchmark items within documents, up to a share of edits (operator 6).

Texts are normalised (lower case, no ASCII marks, single spaces) and taken as bytes. A window of a
document begins at each word; a window of an item does so too. A window is embedded by a CGK random
walk: step j writes the byte under the pointer and moves the pointer on if a random bit of (j, byte)
says so. Two windows at a small edit distance fall into step again after an edit, so
that their walks are at a small Hamming distance. Sampled steps of the walk make the key of a hash
table (bit sampling), and several walks make several tables.

Every word of an item is an anchor. Walks read about 18 bytes, so that an item with many words has many
chances, but a short item few. Items that may have edits are so cut into one piece more than their
edits as well: one piece of 6 to 13 bytes stays as it is, and is looked for at every byte, so that no leak within
the edits is missed. A hit aligns the whole item with the document, and the exact edit
distance between the item and the best substring there decides (Myers' bit-parallel columns).

Documents are read in one narrow pass. Items are sent along in blocks of a bounded size,
one pass a block; a benchmark of a few MB is one block.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import release, slices, strings
from pagetrawl.llm.learn import only

#: Share of an item's length that edits may take.
MOST_EDITS = 0.08
STEPS, TABLES, EARLY = 36, 2, 18
SAMPLED = 0.7
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"

_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c\x00", b"      ")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES, _MARKS).split())


def word_starts(buffer: np.ndarray) -> np.ndarray:
    """Where a word begins in bytes of texts, each closed by zero bytes."""
    gap = (buffer == 32) | (buffer == 0)
    first = np.ones(len(buffer), bool)
    first[1:] = gap[:-1]
    return np.flatnonzero(first & ~gap)


class Walk:
    """One random walk: its moves by step and byte, and the steps that are sampled."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.moves = draw.integers(0, 2, (STEPS, 256)).astype(np.int64)
        self.sampled = draw.random(STEPS) < SAMPLED

    def go(self, buffer, at, key, steps):
        """Pointers and keys after some steps."""
        for j in steps:
            c = buffer[at]
            if self.sampled[j]:
                key = (key ^ c) * _PRIME
                key ^= key >> np.uint64(29)
            at = at + self.moves[j][c]
        return at, key


WALKS = tuple(Walk(seed) for seed in range(1, TABLES + 1))


class Filter:
    """Sorted keys with a bit map in front of them."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that are in the set."""
        some = np.flatnonzero(self.map[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(self.keys) or not len(some):
            return some[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        return some[self.keys[place] == keys[some]]


def most_edits(item: bytes) -> int:
    return int(MOST_EDITS * len(item))


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as numbers; their first byte is the lowest."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))


def scattered(keys: np.ndarray) -> np.ndarray:
    keys = keys * _PRIME
    return (keys ^ (keys >> np.uint64(29))) * _PRIME


class Pieces:
    """Pieces of items, found at every byte by their first eight bytes at most and then as a whole."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.places: dict[bytes, list] = {}
        for k, item in items:
            n = most_edits(item) + 1
            cuts = [i * len(item) // n for i in range(n + 1)]
            for low, high in zip(cuts, cuts[1:]):
                self.places.setdefault(item[low:high], []).append((k, low))
        self.filters: dict[int, tuple[Filter, dict[int, Filter]]] = {}
        for q in {min(len(x), 8) for x in self.places}:
            own = [x for x in self.places if min(len(x), 8) == q]
            wholes = {}
            for n in {len(x) for x in own}:
                same = b"".join(x + bytes(8) for x in own if len(x) == n)
                at = np.arange(0, len(same), n + 8)
                wholes[n] = Filter(self.whole(eights(same), at, n))
            heads = np.array([int.from_bytes(x[:q], "little") for x in own], np.uint64)
            self.filters[q] = Filter(scattered(heads)), wholes

    @staticmethod
    def whole(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Keys of the ``n`` bytes from some positions on."""
        key, step = np.zeros(len(at), np.uint64), 0
        while step < n:
            part = numbers[at + step] & np.uint64((1 << 8 * min(n - step, 8)) - 1) if step == 0 or n - step >= 8 else numbers[at + n - 8]
            key, step = scattered(key ^ part), step + 8
        return key

    def hits(self, data: bytes):
        """``(position, item, offset)`` of the pieces in ``data``, which ends in eight zero bytes at least."""
        numbers = eights(data)
        for q, (heads, wholes) in self.filters.items():
            some = heads.holds(scattered(numbers & np.uint64((1 << 8 * q) - 1)))
            for n, keys in wholes.items():
                inside = some[some + n + 8 <= len(data)]
                for at in inside[keys.holds(self.whole(numbers, inside, n))].tolist():
                    for item, offset in self.places.get(data[at : at + n], ()):
                        yield at, item, offset


class Items:
    """The tables over all anchors and pieces of some items; ``short`` ones have neither and are searched as they are."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.texts = [(i, t) for i, t in ((i, normal(t or "")) for i, t in rows) if t]
        self.peq = [None] * len(self.texts)
        buffer = np.frombuffer(b"".join(t + bytes(STEPS + 1) for _, t in self.texts) + bytes(STEPS + 1), np.uint8)
        bases = np.cumsum([0] + [len(t) + STEPS + 1 for _, t in self.texts])
        starts = word_starts(buffer)
        owner = np.searchsorted(bases, starts, side="right") - 1
        self.tables, anchored = [], set()
        for walk in WALKS:
            at, early = walk.go(buffer, starts, np.zeros(len(starts), np.uint64), range(EARLY))
            at, key = walk.go(buffer, at, early, range(EARLY, STEPS))
            inside = buffer[np.maximum(at - 1, 0)] != 0
            table: dict[int, list] = {}
            for k, o, s in zip(key[inside].tolist(), owner[inside].tolist(), (starts - bases[owner])[inside].tolist()):
                table.setdefault(k, []).append((o, s))
                anchored.add(o)
            self.tables.append((Filter(early[inside]), Filter(key[inside]), table))
        cut = [(k, t) for k, (_, t) in enumerate(self.texts) if most_edits(t)]
        self.pieces = Pieces(cut)
        anchored.update(k for k, _ in cut)
        self.short = [k for k in range(len(self.texts)) if k not in anchored]

    def distance(self, k: int, text: bytes) -> tuple[int, int]:
        """The least edit distance of item ``k`` to a substring of ``text``, and where that ends."""
        item = self.texts[k][1]
        if self.peq[k] is None:
            peq: dict[int, int] = {}
            for i, c in enumerate(item):
                peq[c] = peq.get(c, 0) | 1 << i
            self.peq[k] = peq
        peq, m = self.peq[k], len(item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (~(xh | plus) & full), plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (~(xv | up) & full), up & xv
            if score < best:
                best, end = score, j + 1
        return best, end


def find(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, distance)`` of the best place of each item in each text that holds it."""
    pad = bytes(STEPS + 1)
    data = b"".join(t + pad for t in texts) + pad
    buffer = np.frombuffer(data, np.uint8)
    bases = np.cumsum([0] + [len(t) + len(pad) for t in texts])
    places = bases.tolist()
    starts = word_starts(buffer)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried = set()

    def attempt(text: int, item: int, at: int) -> None:
        body, item_text = texts[text], items.texts[item][1]
        most = most_edits(item_text)
        # hits of one leak lie within a few bytes of each other, and one attempt covers them all
        slot = at // (most + 1)
        if (text, item, slot) in tried:
            return
        tried.add((text, item, slot))
        if body.startswith(item_text, max(at, 0)):
            best, start, end = 0, max(at, 0), max(at, 0) + len(item_text)
        else:
            low = max((slot - 1) * (most + 1) - most, 0)
            best, stop = items.distance(item, body[low : low + len(item_text) + 5 * (most + 1)])
            end = low + stop
            start = max(end - len(item_text), 0)
        if best <= most and best < found.get((text, item), (best + 1,))[0]:
            found[text, item] = best, start, end

    for walk, (early_keys, keys, table) in zip(WALKS, items.tables):
        at, key = walk.go(buffer, starts, np.zeros(len(starts), np.uint64), range(EARLY))
        some = early_keys.holds(key)
        at, key = walk.go(buffer, at[some], key[some], range(EARLY, STEPS))
        hits = keys.holds(key)
        where = starts[some[hits]]
        owners = np.searchsorted(bases, where, side="right") - 1
        for k, text, local in zip(key[hits].tolist(), owners.tolist(), (where - bases[owners]).tolist()):
            for item, offset in table[k]:
                attempt(text, item, local - offset)
    for at, item, offset in items.pieces.hits(data):
        text = bisect.bisect_right(places, at) - 1
        attempt(text, item, at - places[text] - offset)
    for item in items.short:
        for text, body in enumerate(texts):
            at = (b" " + body + b" ").find(b" " + items.texts[item][1] + b" ")
            if at >= 0:
                found[text, item] = 0, at, at + len(items.texts[item][1])
    return [(t, i, start, end, best) for (t, i), (best, start, end) in found.items()]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items with a text, in blocks of about ``block_bytes`` at most: what goes with a task has a bound."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted(((r.item_id, r.text) for r in mine.collect()), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each item of ``benchmark`` (item_id, text) that a row of ``docs`` (doc_id, text) holds.

    ``start`` and ``end`` are bytes of the normalised text, ``distance`` is the least number of byte edits, at
    most ``MOST_EDITS`` of the item's length. Items too short for an edit (up to 12 bytes) count where they stand
    as whole words. Null and empty texts and items hold and match nothing. Repeated rows and items are all
    told. Other columns are ignored.
    """
    found = None
    for rows in item_blocks(benchmark):

        def run(batches, rows=rows):
            release()
            items = Items(rows)
            for batch in slices(batches, 256, 1):
                ids = batch.column(0).to_pylist()
                hits = find(items, [normal(t) for t in strings(batch.column(1))])
                columns = [[ids[h[0]] for h in hits], [items.texts[h[1]][0] for h in hits], *([h[k] for h in hits] for k in (2, 3, 4))]
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "distance"]
                )

        one = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


class Clean:
    """Which texts hold none of some items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows, self.items = rows, None

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.items is None:
            self.items = Items(self.rows)
        clean = np.ones(len(texts), bool)
        clean[[hit[0] for hit in find(self.items, [normal(t) for t in texts])]] = False
        return clean

    def __reduce__(self):
        return Clean, (self.rows,)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, by ``leaks``'s measure, with all their columns."""
    for rows in item_blocks(benchmark):
        docs = only(docs, Clean(rows))
    return docs


def contaminated(found: DataFrame) -> DataFrame:
    """A row a document that holds items: doc_id, n_items, item_ids in order, least distance."""
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.min("distance").alias("distance"),
    )
