"""Near-duplicates of texts by SuperMinHash (operator 4).

A document is its set of distinct five-word shingles. Its signature has, for each of
``SLOTS`` slots, the least ``rank + fraction`` that an element gives it; an element's ranks are a
random permutation of the slots, so that they are correlated and the estimate varies less than with
independent hashes. Elements are taken rank by rank, and a document stops as soon as every slot
holds a smaller rank than the next: long texts need two or three ranks.

Documents of one set are one class, represented by the smallest id. Slots make bands of four,
and equal bands make buckets. In a bucket members are compared with one leader, not with each other;
links join components. Buckets that still hold several components go on: the few members outside
the largest component meet all of the bucket. Where many documents share no more than a common
line, all of them meet by their rarest shingles, which loses no pair. Pairs that share one band of 32
or a rare shingle are confirmed on their full sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrawl.llm.common import kept, slices, strings
from pagetrawl.llm.graph import components
from pagetrawl.session import settle, text_batches

SHINGLE, SLOTS, BAND = 5, 128, 4
#: Links need 100 * intersection >= LEAST_PERCENT * union.
LEAST_PERCENT = 75
#: Rounds in which a bucket's members meet one leader each.
STAR_ROUNDS = 3
#: Bands that a pair of a bucket must share: at a similarity of 0.75 none of 32 is shared in 5 of a million cases. More would lose pairs.
LEAST_BANDS = 1
#: Up to so many members outside a bucket's largest component are compared with all of the bucket.
FEW = 16
#: Documents with more bands in undecided large buckets meet by their rarest shingles. Any other number than 0 loses pairs.
SPARE_BANDS = 0
PRIME, GOLDEN = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for at most ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    lists = [words_of(t) for t in texts]
    counts = [len(x) for x in lists]
    hashed = np.fromiter(map(kept("word hashes", WordHashes).__getitem__, itertools.chain.from_iterable(lists)), np.uint64, sum(counts))
    total = max(len(hashed) - SHINGLE + 1, 0)
    rolled = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * PRIME + hashed[k : k + total]
    rolled, sets, at = mix(rolled), [], 0
    for n in counts:
        if n >= SHINGLE:
            sets.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            value = np.array([n], np.uint64)
            for h in hashed[at : at + n]:
                value = value * PRIME + h
            sets.append(mix(value))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 32-bit values per set: rank in the upper 8 bits, fraction in the lower 24."""
    found = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    items = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for rank in range(slots):
        if not len(items):
            break
        x = mix(items + np.uint64((rank + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        swap = (rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot = swap.copy()
        for k in range(rank - 1, -1, -1):  # where the earlier swaps have put this slot
            slot[slot == swaps[k]] = k
        value = (np.uint32(rank) << np.uint32(24)) | (x >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(found.reshape(-1), owner * slots + slot, value)
        open_ = found.max(axis=1) >= np.uint32((rank + 1) << 24) if rank + 1 < slots else np.zeros(len(sets), bool)
        on = open_[owner]
        swaps.append(swap)
        if not on.all():
            items, owner, swaps = items[on], owner[on], [s[on] for s in swaps]
    return found


def bands(found: np.ndarray, width: int = BAND) -> np.ndarray:
    """A 64-bit key per band, of ``width`` slots each."""
    parts = found.astype(np.uint64).reshape(len(found), -1, width)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(width):
        keys = mix(keys * PRIME + parts[:, :, k])
    return keys.view(np.int64)


def _sign(batches):
    for batch in slices(batches, 512, 1):
        sets = shingle_sets(strings(batch.column(1)))
        keys = bands(signatures(sets))
        first = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        second = np.array([np.bitwise_xor.reduce(mix(s ^ GOLDEN)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
            ["doc_id", "n_shingles", "h1", "h2", "bands"],
        )


def _confirm(batches, least_bands=LEAST_BANDS):
    """Pairs that share enough bands and whose sets are as similar as asked; rows of one leader mostly follow each other."""
    last, leader_set = None, None
    for batch in slices(batches, 256, 2):
        if not batch.num_rows:
            continue
        one, two = (batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (4, 5))
        batch = batch.filter(pa.array((one == two).sum(1) >= least_bands))
        ids, leaders = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sets = shingle_sets(strings(batch.column(2)))
        kept = []
        for k, leader in enumerate(leaders):
            if leader != last:
                last, leader_set = leader, shingle_sets([batch.column(3)[k].as_py() or ""])[0]
            own = sets[k]
            if 100 * min(len(own), len(leader_set)) >= LEAST_PERCENT * max(len(own), len(leader_set)):
                shared = len(np.intersect1d(own, leader_set, assume_unique=True))
                if shared and 100 * shared >= LEAST_PERCENT * (len(own) + len(leader_set) - shared):
                    kept.append((ids[k], leader))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, least_bands: int = LEAST_BANDS) -> DataFrame:
    """The pairs ``(a, b)`` that share ``least_bands`` and are links, by the full sets of their ``texts (doc_id, text, bands)``."""
    own, other = (texts.toDF(k, f"text_{k}", f"bands_{k}") for k in ("a", "b"))
    joined = pairs.join(own, "a").join(other, "b").select("a", "b", "text_a", "text_b", "bands_a", "bands_b")
    return joined.mapInArrow(lambda batches: _confirm(batches, least_bands), "a long, b long")


def _turn(round_: int) -> Column:
    """What the leader of a bucket has least of: in the first round its size, then its id, later a hash."""
    return F.struct("n", "doc_id") if round_ == 0 else F.struct(F.xxhash64("doc_id", F.lit(round_)), "doc_id")


def _enough(shared: Column, both: Column) -> Column:
    """Whether sets of ``both`` elements in all can be similar with so many ``shared`` at most."""
    return (100 + LEAST_PERCENT) * shared >= LEAST_PERCENT * both


class Links:
    """Links found so far and the components that they make; ``texts`` has doc_id, text and bands."""

    def __init__(self, texts: DataFrame):
        self.texts, self.links, self.labels, self.least_bands = texts, None, None, LEAST_BANDS

    def members(self, banded: DataFrame) -> DataFrame:
        """``banded`` with each document's component so far."""
        if self.labels is None:
            return banded.withColumn("component", F.col("doc_id"))
        own = self.labels.withColumnRenamed("id", "doc_id")
        return banded.join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def mixed(self, banded: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components; ``largest`` is the one of most members, of ``most``."""
        mine = self.members(banded)
        parts = mine.groupBy("key", "component").agg(F.count("*").alias("own"))
        whole = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("own").alias("size"), F.max(F.struct("own", "component")).alias("top"))
        whole = whole.where("parts > 1").select("key", "size", F.col("top.own").alias("most"), F.col("top.component").alias("largest"))
        return settle(mine.join(whole, "key"), "mixed-buckets")

    def stars(self, members: DataFrame, round_: int) -> None:
        """Compares members with the leader of their bucket."""
        least = members.groupBy("key").agg(F.min(_turn(round_)).alias("turn"))
        lead = members.join(least, "key").where(_turn(round_) == F.col("turn"))
        self.compare(members, lead)

    def compare(self, members: DataFrame, others: DataFrame) -> None:
        """Looks for links between members and others of their buckets that are of different components."""
        other = others.select(
            "key", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("tail").alias("t_b"), F.col("component").alias("c_b")
        )
        fits = 100 * F.least("n", "n_b") >= LEAST_PERCENT * F.greatest("n", "n_b")
        pairs = members.join(other, "key").where((F.col("component") != F.col("c_b")) & fits & _enough(F.least("tail", "t_b"), F.col("n") + F.col("n_b")))
        pairs = pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
        fresh = settle(confirmed(pairs, self.texts, self.least_bands), "near-links")
        if fresh.isEmpty():
            return
        self.links = fresh if self.links is None else self.links.unionByName(fresh)
        self.labels = components(self.links)


def near_links(banded: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``(id, component)`` of the linked representatives; ``banded`` has doc_id, n, key and tail (n) of buckets with company."""
    found = Links(texts)
    found.stars(found.members(banded), 0)
    _dominated(found, banded)
    # what one large component doesn't dominate mostly shares a common line, and meets by its rarest shingles: what two
    # documents share besides is less alike than they are, so that their other bands alone would miss pairs
    mixed = found.mixed(banded)
    few = F.col("size") - F.col("most") <= FEW
    rest = mixed.where(few & (F.col("component") != F.col("largest")))
    found.compare(rest, mixed.where(few))
    busy = mixed.where(~few).groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > SPARE_BANDS).select("doc_id")
    busy = settle(busy, "busy")
    if not busy.isEmpty():
        rare = settle(_rarest(texts.join(busy, "doc_id")), "rarest")
        found.least_bands = 0
        found.stars(found.members(rare), 0)
        _dominated(found, rare)
        mixed = found.mixed(rare)
        found.compare(mixed.where("component <> largest"), mixed)
    return found.labels


def _shingles(batches):
    for batch in slices(batches, 128, 1):
        sets = shingle_sets(strings(batch.column(1)))
        sizes = [len(s) for s in sets]
        ids = np.repeat(batch.column(0).to_numpy(), sizes)
        keys = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(keys)], ["doc_id", "n", "key"])


def _rarest(texts: DataFrame) -> DataFrame:
    """The rarest shingles of each text, as buckets (doc_id, n, key, tail); ``tail`` counts the shingle and all less rare ones.

    Of two sets as similar as asked, each has a share of the other that leaves out fewer than ``n - needed + 1``
    shingles; in any common order of all shingles their heads of that length so have one in common. The
    order by rarity keeps common lines out of the heads, and two sets share no more than their shorter tails from
    the first shingle that they share.
    """
    every = settle(texts.select("doc_id", "text").mapInArrow(_shingles, "doc_id long, n long, key long"), "shingles")
    seen = every.groupBy("key").agg(F.count("*").alias("seen"))
    ranked = every.join(seen, "key").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("seen", "key")))
    needed = F.ceil(F.col("n") * LEAST_PERCENT / 100)
    head = ranked.where((F.col("rank") <= F.col("n") - needed + 1) & (F.col("seen") > 1))
    head = head.select("doc_id", "n", "key", (F.col("n") - F.col("rank") + 1).alias("tail"))
    # a bucket keeps those that could be similar to its smallest set, were they to share all that follows
    best = head.groupBy("key").agg(F.min("n").alias("low"), F.max("tail").alias("long"))
    fits = _enough(F.least("tail", "long"), F.col("n") + F.col("low"))
    return head.join(best, "key").where(fits).select("doc_id", "n", "key", "tail")


def _dominated(found: Links, banded: DataFrame) -> None:
    """Further stars in the buckets of which one component has more than half."""
    for round_ in range(1, STAR_ROUNDS):
        members = found.mixed(banded).where("2 * most > size and size > 2")
        if members.isEmpty():
            break
        found.stars(members, round_)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Texts without words (null, empty) are linked with nothing. Rows of one id count as one document with the
    links of all of them; a row without an id is linked with nothing and kept, its component is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    signed = settle(texts.mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "signatures")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(linked.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    sole = linked.join(classes, ["n_shingles", "h1", "h2"]).where("doc_id = rep")
    banded = sole.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    company = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    banded = settle(banded.join(company, "key").distinct().withColumn("tail", F.col("n")), "buckets")
    needed = banded.select("doc_id").distinct()
    marked = sole.select("doc_id", "bands").join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    candidates = texts.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    candidates = settle(candidates.join(marked, "doc_id"), "candidates")
    labels = near_links(banded, candidates)
    # the same id with several texts: its classes are one component as well
    member = linked.join(classes, ["n_shingles", "h1", "h2"]).select("doc_id", "rep").where("doc_id <> rep").distinct()
    within = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if labels is not None:
        within = within.unionByName(labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    final = components(within)
    own = final.select(F.col("id").alias("doc_id"), "component")
    found = signed.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
