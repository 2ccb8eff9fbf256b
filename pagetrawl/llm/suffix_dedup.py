"""Repeated passages by a column-wise suffix construction over many documents (operator 5).

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier (at a smaller id, or
earlier in the same document). The work is dealt out by content:

1. Each string of ``SPAN`` bytes has an anchor, its ``GRAM``-byte substring of the least hash. Equal strings
   have equal anchors, so only occurrences of one anchor have to meet. An anchor stands for a run of
   neighbouring strings; their bytes together are its context. Equal contexts within a task's chunk
   become one before anything is shuffled.
2. Anchors are shuffled by their hash and read in order. Further occurrences of a context are repeats
   as a whole. Where one anchor has several contexts, the first occurrence of each goes on.
3. Contexts are fetched from the documents and collected by anchor, in bounded collections. A collection's
   Burrows-Wheeler transform and common prefixes are built column by column: each round
   inserts one symbol of every context, from the last to the first, at the place that the transform so far
   gives it, and updates the common prefixes next to the new rows. Rows that share ``SPAN`` bytes
   are occurrences of one string; all but the earliest are repeats.
4. Repeats are brought back to their documents as ranges.

An anchor with more contexts than a collection may hold is dealt out by document to several
collections; the strings that each has for the first time then meet by their own hashes. Tables
between the steps are settled; what a task holds does not grow with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import partitions, slices
from pagetrawl.session import settle

SPAN, GRAM = 100, 24
REACH = SPAN - GRAM + 1
#: Texts are hashed in parts of this many bytes; strings across two parts belong to the first.
PART = 1 << 22
#: Anchors are collected until they have so many contexts together; a single one is split from ``LARGEST`` on.
COLLECTION, LARGEST = 1 << 12, 1 << 15
#: Bytes of texts in which equal contexts become one before the shuffle.
CHUNK_BYTES = 1 << 23

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 to the 64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, 1 << 17).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(text: np.ndarray):
    """Of a text's anchors in turn: hash, hash of the context, first and last string that they stand for."""
    n = len(text)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(text.astype(np.uint64) * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the least hash of each window, the leftmost of equals: hash above, position below
    low = np.uint64(24)
    valued = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.append(valued, np.full(-len(grams) % REACH, ~np.uint64(0))).reshape(-1, REACH)
    heads = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(grams) - REACH + 1
    at = (np.minimum(tails[:count], heads[REACH - 1 : REACH - 1 + count]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:] - 1, count - 1)
    place = at[first]
    shape = ((last - first) * SPAN + place - first).astype(np.uint64)
    context = mix(mix((sums[last + SPAN] - sums[first]) * down[first]) + shape * _BASE)
    return grams[place], context, first, last


def _chunks(batches):
    """Rows of batches, gathered until their texts are ``CHUNK_BYTES`` long."""
    held, size = [], 0
    for batch in slices(batches, 256):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc_id is None or not text:
                continue
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            held.append((doc_id, raw))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


ANCHORS = "done boolean, h long, context long, doc long, a long, b long"


def _anchored(batches):
    """Anchors, a row for each context of a chunk (its earliest place), and ranges of strings that are repeats for sure."""
    for chunk in _chunks(batches):
        found = []
        for doc_id, raw in chunk:
            for at in range(0, max(len(raw) - SPAN + 1, 0), PART):
                part = raw[at : at + PART + SPAN - 1]
                if len(part) >= SPAN:
                    h, context, first, last = anchors(part)
                    found.append((h, context, np.full(len(h), doc_id, np.int64), first + at, last + at))
        if not found:
            continue
        h, context, doc, first, last = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((first, doc, context, h))
        again = (h[order][1:] == h[order][:-1]) & (context[order][1:] == context[order][:-1])
        # the same place of a repeated row is not earlier than itself
        start = np.append(True, ~again)
        lead = order[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
        repeat = np.zeros(len(h), bool)
        repeat[order] = (doc[order] != doc[lead]) | (first[order] != first[lead])
        keep = np.zeros(len(h), bool)
        keep[order[start]] = True
        rows = [h[keep], context[keep], doc[keep], first[keep], last[keep]]
        # neighbouring repeats of one document make one range
        d, a, b = doc[repeat], first[repeat], last[repeat]
        if len(d):
            sort = np.lexsort((a, d))
            d, a, b = d[sort], a[sort], b[sort]
            new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != b[:-1] + 1)))
            d, a, b = d[new], a[new], b[np.append(new[1:] - 1, len(b) - 1)]
        n, spread = len(rows[0]), mix(d.astype(np.uint64) * _BASE + a.astype(np.uint64))
        columns = [np.concatenate(x) for x in zip(rows, [spread, np.zeros(len(d), np.uint64), d, a, b])]
        done = pa.array(np.arange(n + len(d)) >= n)
        yield pa.RecordBatch.from_arrays([done, *map(_signed, columns)], ["done", "h", "context", "doc", "a", "b"])


def _repeats(batches):
    """Of anchors in order: ranges that are repeats as a whole (done), and the first places of contexts that need the construction."""
    last = held = None  # the last row; the first row of the last anchor while it has one context
    for batch in batches:
        done = batch.column(0).to_numpy(zero_copy_only=False)
        h, context, doc, a, b = (batch.column(k).to_numpy() for k in range(1, 6))
        n = len(h)
        if not n:
            continue
        if last is None:
            last = (False, h[0] ^ 1, 0, 0, 0, 0)
        # lead: the first place of the row's context, which may lie in an earlier batch
        same_h = (h == np.append(last[1], h[:-1])) & ~done & ~np.append(last[0], done[:-1])
        same = same_h & (context == np.append(last[2], context[:-1]))
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        lead_doc, lead_a = (np.where(lead >= 0, x[np.maximum(lead, 0)], y) for x, y in ((doc, last[3]), (a, last[4])))
        repeat = same & ((doc != lead_doc) | (a != lead_a))
        fresh = ~done & ~same
        further = fresh & same_h
        # the first context of an anchor goes on if a further one follows
        opens = np.flatnonzero(fresh & ~same_h)
        counts = np.add.reduceat(further, opens) if len(opens) else np.zeros(0, int)
        before = further[: opens[0]].any() if len(opens) else further.any()
        multiple = further.copy()
        multiple[opens[counts > 0]] = True
        out = [(np.zeros(0, bool), *[np.zeros(0, np.int64)] * 4)]
        if held is not None and before:
            out.append((np.array([False]), *(np.array([x]) for x in held)))
            held = None
        if len(opens):
            k = opens[-1]
            held = None if counts[-1] else (h[k], doc[k], a[k], b[k])
        chosen = np.flatnonzero(repeat | done | multiple)
        out.append(((repeat | done)[chosen], h[chosen], doc[chosen], a[chosen], b[chosen]))
        k = lead[-1]
        last = (done[-1], h[-1], context[-1], *((doc[k], a[k], b[k]) if k >= 0 else last[3:]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["done", "h", "doc", "a", "b"])


def construct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform, common prefixes (up to ``SPAN``) and the row of each whole text.

    Rows are the suffixes of all texts in order, at first the empty ones; 0 in the transform stands for a
    text's end. Texts are aligned at their fronts, so that all end with the last round.
    """
    m, longest = len(texts), max(map(len, texts))
    lengths = np.array([len(t) for t in texts])
    table = np.zeros((longest, m), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)
    owner = np.repeat(np.arange(m), lengths)
    table[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), owner] = code[flat]
    bwt, lcp, rows = np.zeros(m, np.uint8), np.zeros(m, np.uint8), np.arange(m)
    # rows by symbol, but for the ends, and how many of each symbol: kept from round to round instead of sorted anew
    order, counts = np.zeros(0, np.int32), np.zeros(256, np.int64)
    for column in range(longest - 1, -1, -1):
        active = np.flatnonzero(lengths > column)
        at = rows[active]
        bwt[at] = table[column, active]
        n, size = len(bwt), len(bwt) + len(active)
        sort = np.argsort(at)
        new_at = at[sort].astype(np.int32)
        symbol = bwt[new_at]
        by = np.argsort(symbol, kind="stable")
        ascending = gaps(order, counts, symbol, new_at, by) + np.arange(len(by))
        own = np.empty(len(by), np.int64)
        own[by] = ascending
        counts += np.bincount(symbol, minlength=256)
        stays = np.ones(len(order) + len(by), bool)
        stays[ascending] = False
        order, old = np.empty(len(stays), np.int32), order
        order[stays], order[ascending] = old, new_at[by]
        new_place = own + m  # the ends come first in the new table
        rows[active[sort]] = new_place
        # the common prefix of two new neighbours is one more than the least between their old rows
        before = order[np.maximum(own - 1, 0)]
        joined = (own > 0) & (bwt[before] == symbol)
        after = order[np.minimum(own + 1, len(order) - 1)]
        follows = (own + 1 < len(order)) & (bwt[after] == symbol)
        stays = np.ones(size, bool)
        stays[new_place] = False
        grown, prefixes = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        grown[stays], prefixes[stays] = bwt, lcp
        for some, low, high, target in (
            (joined, before + 1, new_at + 1, new_place), (follows, new_at + 1, after + 1, new_place + 1),
        ):
            if some.any():
                prefixes[target[some]] = np.minimum(range_minima(lcp, low[some], high[some]) + 1, SPAN)
        # the rows of the old table move down by the new ones above them
        moved = np.diff(ascending + m - np.arange(len(by)), prepend=0, append=n)
        order = (np.arange(n, dtype=np.int32) + np.repeat(np.arange(len(moved), dtype=np.int32), moved))[order]
        bwt, lcp = grown, prefixes
    return bwt, lcp, rows


def gaps(order: np.ndarray, counts: np.ndarray, symbol: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Where new rows ``at`` of some symbols, taken in the order ``by`` of symbol and row, come in ``order`` (``counts`` by symbol)."""
    firsts = np.cumsum(counts) - counts
    edges = np.cumsum(np.bincount(symbol, minlength=len(counts)))
    found = np.empty(len(by), np.int64)
    for c in np.flatnonzero(np.diff(edges, prepend=0)).tolist():
        some = slice(edges[c - 1] if c else 0, edges[c])
        found[some] = firsts[c] + np.searchsorted(order[firsts[c] : firsts[c] + counts[c]], at[by[some]])
    return found


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each non-empty range."""
    order = np.argsort(low, kind="stable")
    pairs = np.empty(2 * len(low), np.int64)
    pairs[0::2], pairs[1::2] = low[order], high[order]
    found = np.empty(len(low), values.dtype)
    found[order] = np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), pairs)[0::2]
    return found


def classes(texts: list[bytes]):
    """``(text, start, group)`` of every string of ``SPAN`` bytes in the texts; equal strings have one group."""
    bwt, lcp, rows = construct(texts)
    order = np.argsort(bwt, kind="stable")  # from a suffix's row to that of the next shorter one
    group = np.cumsum(lcp < SPAN)
    count = np.array([len(t) for t in texts]) - SPAN + 1
    found, now = [], rows.copy()
    for start in range(count.max()):
        own = np.flatnonzero(count > start)
        found.append((own, np.full(len(own), start), group[now[own]]))
        now[own] = order[now[own]]
    return tuple(np.concatenate(x) for x in zip(*found))


CONTEXTS = "h long, salt int, doc long, a long, text binary"
RANGES = "h long, w1 long, w2 long, doc long, a long, b long"


def _fetched(batches):
    """The contexts that were asked for, cut from their documents."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, 64):
        rows = []
        for doc, packed, asked in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = unpack(packed)
            rows.extend((q["h"], q["salt"], doc, q["a"], raw[q["a"] : q["b"] + SPAN]) for q in asked)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "salt", "doc", "a", "text"])


def _constructed(batches):
    """Ranges of repeats in collections of whole anchors; from split anchors also the strings that come first, with their hashes."""
    held: list[tuple] = []

    def flush(rows):
        texts = [r[4] for r in rows]
        text, start, group = classes(texts)
        doc, first, salt = (np.array([r[k] for r in rows]) for k in (2, 3, 1))
        h = np.array([r[0] for r in rows])
        # a string that is alone here is no repeat, and told only for split anchors
        some = (np.bincount(group)[group] > 1) | (salt[text] >= 0)
        text, start, group = text[some], start[some], group[some]
        order = np.lexsort((first[text] + start, doc[text], group))
        earliest = np.append(True, group[order][1:] != group[order][:-1])
        lead = order[np.maximum.accumulate(np.where(earliest, np.arange(len(order)), 0))]
        repeat = np.empty(len(text), bool)  # a repeated row brings the same place again, which is not earlier
        repeat[order] = (doc[text[order]] != doc[text[lead]]) | ((first[text] + start)[order] != (first[text] + start)[lead])
        split = ~repeat & (salt[text] >= 0)
        cut = np.flatnonzero(repeat)
        cut = cut[np.lexsort((start[cut], text[cut]))]
        t, s = text[cut], start[cut]
        new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))) if len(cut) else cut
        ends = np.append(new[1:] - 1, len(cut) - 1) if len(cut) else cut
        zero = np.zeros(len(new), np.int64)
        columns = [[zero, zero, zero, doc[t[new]], first[t[new]] + s[new], first[t[ends]] + s[ends]]]
        if split.any():
            own, at = text[split], start[split]
            digests = np.array([np.frombuffer(hashlib.blake2b(texts[i][k : k + SPAN], digest_size=16).digest(), "<i8") for i, k in zip(own, at)])
            columns.append([h[own], digests[:, 0], digests[:, 1], doc[own], first[own] + at, first[own] + at])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*columns)], ["h", "w1", "w2", "doc", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if len(held) >= COLLECTION and row[:2] != held[-1][:2]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _packed(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, 512):
        texts = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "packed"])


def repeats(docs: DataFrame) -> DataFrame:
    """Ranges ``(doc, a, b)`` of starts of strings in ``docs (doc_id, text)`` that also start earlier."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = docs.mapInArrow(_anchored, ANCHORS)
    dealt = found.repartition(n, "h").sortWithinPartitions("done", "h", "context", "doc", "a")
    told = settle(dealt.mapInArrow(_repeats, "done boolean, h long, doc long, a long, b long"), "anchor-repeats")
    asked = told.where("not done")
    # anchors of more contexts than a collection may hold are split by document
    large = asked.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST)
    parts = F.ceil(2 * F.col("n") / LARGEST)
    salt = F.coalesce(F.pmod(F.xxhash64("doc"), parts), F.lit(-1)).cast("int")
    asked = asked.join(large, "h", "left").select("h", salt.alias("salt"), "doc", "a", "b")
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "salt", "a", "b")).alias("asked"))
    packed = docs.where("doc_id is not null").mapInArrow(_packed, "doc_id long, packed binary")
    fetched = packed.join(by_doc, F.col("doc_id") == F.col("doc")).select("doc_id", "packed", "asked").mapInArrow(_fetched, CONTEXTS)
    fetched = fetched.repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "doc", "a")
    cut = settle(fetched.mapInArrow(_constructed, RANGES), "constructed")
    place = F.struct("doc", "a")
    first = cut.where("w1 <> 0 or w2 <> 0").groupBy("h", "w1", "w2").agg(F.min(place).alias("least"))
    later = cut.join(first, ["h", "w1", "w2"]).where(place != F.col("least")).select("doc", "a", "b")
    return told.where("done").select("doc", "a", "b").unionByName(cut.where("w1 = 0 and w2 = 0").select("doc", "a", "b")).unionByName(later)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as UTF-8 bytes: doc_id, n_bytes, spans (removed, joined), kept (bytes that stay).

    Null and empty texts have no bytes. Ids name one text: a repeated row is not an earlier place of itself and
    has the same result. Rows without an id keep all bytes and are not compared. Other columns are ignored.
    """

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 64):
            rows = []
            for doc, packed, ranges in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw, spans, parts, at = unpack(packed), [], [], 0
                for r in sorted((r["a"], r["b"] + SPAN) for r in ranges or ()):
                    if spans and r[0] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r[1])
                    else:
                        spans.append({"start": r[0], "end": r[1]})
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                rows.append((doc, len(raw), spans, b"".join([*parts, raw[at:]])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeats(texts).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    packed = texts.mapInArrow(_packed, "doc_id long, packed binary")
    return packed.join(ranges, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "packed", "ranges").mapInArrow(cut, KEPT)
