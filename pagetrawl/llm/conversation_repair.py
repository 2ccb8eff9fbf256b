"""Repair of conversation structure: the cheapest edits that give roles ``(s?(ua)+)?``.

Method: a Viterbi pass over each conversation's rows with survivor coalescence. States are where
the roles so far leave the grammar (nothing yet, after system, after user, after assistant). At a
row every state keeps one survivor: its cost and a node of a backpointer tree that holds the edits
of that row (an insert before it, then keep, rerole or delete) and the repaired lines they give.
Nodes count their live children; a node that no survivor reaches any more is freed at once. When
the oldest node has a single live child, every survivor shares it: its edits are emitted (audit
letters appended, lines fed to the running SHA-256) and it is freed. Memory is the unresolved part
of the tree, not the conversation. Ties of cost go to the audit that is least in ASCII: the two
paths are compared over their complete unresolved suffixes (from their common ancestor); every row
adds a string that ends in its own edit, so one such suffix is never a proper prefix of another and
the first difference decides for every continuation. A survivor dearer than the cheapest one by
more than ``BOUND`` (what any state pays at most to do whatever another does) can't win and is let
go; without that the branch that deletes every row would keep the tree from coalescing.

Edits: keep 0; rerole to user or assistant 3; delete 4 (the only edit of a blank or duplicate row);
insert an empty user or assistant row 3, before any row or at the end; a truncated row that stays
adds 3. Audit letters: ``D`` delete, ``I`` insert, ``K`` keep, ``R`` rerole.

Spark: rows are damaged and their faults found with column expressions; whether a row's role and
text were seen earlier comes from the first position of each (conversation, role, text), an
aggregate joined back (broadcast when counted small, else salted). Conversations are hash
partitioned and sorted, and one streaming pass per partition runs the Viterbi, so a conversation
is never gathered into one batch. Counts of turns come from an aggregate.

Cases: null role or text count as one space; a null conv_id or turn is a space in the damage key; a
null conv_id is one conversation; rows order by turn (nulls first), then role, text and copy.
Conversations left without rows get zeros, an empty audit and the digest of the empty string.
Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = "[\\x20\\x09-\\x0D]"
NAMES = {"u": "user", "a": "assistant"}

BROADCAST_KEYS = 500_000
SALTS = 32

# grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTS = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role an insert or a rerole gives
DONE = {0: ("", ()), 3: ("", ()), 2: ("I", ("a",)), 1: ("II", ("u", "a"))}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: From any state the grammar is caught up for at most this much: inserts to after-assistant (6 at
#: most) and the delete of a system row that the nothing-yet state could keep (4). A survivor dearer
#: than the cheapest by more can never win, nor tie, and is let go, so its branch is freed.
BOUND = 10


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by ``crc32('conv_id:turn') % 20``, with ``copy`` (0, or 1 for a repeat)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(d == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    copies = F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"), (d == 0).alias("gone"))
    return rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))


def _attach(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    if table.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS))).join(salted, [key, "_salt"]).drop("_salt")


def with_faults(rows: DataFrame) -> DataFrame:
    """``blank``, ``later`` (role and text first met at an earlier turn or copy) and ``cut`` (truncated)."""
    conv = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = rows.withColumn("_k", F.concat(conv, F.lit("|"), said))
    place = F.struct(F.col("turn").alias("t"), F.col("copy").alias("c"))
    firsts = keyed.groupBy("_k").agg(F.min(place).alias("_first"))
    joined = _attach(keyed, firsts, "_k", F.xxhash64("turn", "copy"))
    same = F.col("_first.t").eqNullSafe(F.col("turn")) & (F.col("_first.c") == F.col("copy"))
    last = F.regexp_extract("text", f"([^\\x20\\x09-\\x0D]){SPACE}*$", 1)
    return joined.select(
        "conv_id", "turn", "role", "text", "copy",
        (~F.col("text").rlike(f"[^\\x20\\x09-\\x0D]")).alias("blank"),
        (~same).alias("later"),
        (~last.rlike("[.!?]")).alias("cut"),
    )


class Node:
    __slots__ = ("letters", "lines", "parent", "kids", "refs")

    def __init__(self, letters: str, lines: tuple, parent: Node | None):
        self.letters, self.lines, self.parent, self.kids, self.refs = letters, lines, parent, [], 0
        if parent is not None:
            parent.kids.append(self)


class Viterbi:
    """One conversation, row by row; ``finish`` gives cost, audit and the SHA-256 of the repaired rows.

    ``live`` is the number of nodes held: the unresolved part of the tree.
    """

    def __init__(self):
        self.root = Node("", (), None)
        self.root.refs = 1
        self.survivors = {0: (0, self.root)}
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.lines_out = 0
        self.live = 1

    # --- the tree
    def _drop(self, node: Node):
        """A survivor lets go of ``node``; nodes that nothing reaches any more are freed upwards."""
        node.refs -= 1
        while node is not self.root and node.refs == 0 and not node.kids:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = None
            self.live -= 1
            node = parent

    def _emit(self, node: Node):
        self.audit.append(node.letters)
        for role, text in node.lines:
            self.sha.update(("\n" if self.lines_out else "").encode() + f"{role}:{text}".encode())
            self.lines_out += 1

    def _coalesce(self):
        """Emits the oldest node's one child while every survivor passes through it."""
        while self.root.refs == 0 and len(self.root.kids) == 1:
            child = self.root.kids[0]
            self._emit(child)
            child.parent = None
            self.root.kids = []
            self.root = child
            self.live -= 1

    @staticmethod
    def _suffix(node: Node, stop: Node) -> list[str]:
        out = []
        while node is not stop:
            out.append(node.letters)
            node = node.parent
        return out[::-1]

    def _less(self, a: tuple, b: tuple) -> bool:
        """Whether path ``a`` (node, letters) reads less than ``b``, both at the same row."""
        (na, la), (nb, lb) = a, b
        x, y = na, nb
        while x is not y:  # same depth: climb together to the common ancestor
            x, y = x.parent, y.parent
        return "".join(self._suffix(na, x)) + la < "".join(self._suffix(nb, y)) + lb

    # --- rows
    def row(self, role: str, text: str, fault: str):
        best: dict[int, tuple] = {}
        initial = role[:1]
        for state, (cost, node) in self.survivors.items():
            options = [(state, DELETE, "D", ())]
            if fault not in ("b", "d"):
                extra = TRUNCATED if fault == "t" else 0
                if (state, initial) in NEXT:
                    options.append((NEXT[state, initial], KEEP + extra, "K", ((role, text),)))
                want = WANTS[state]
                options.append((NEXT[state, want], REROLE + extra, "R", ((NAMES[want], text),)))
                # an insert first, then keep or rerole from there
                mid = NEXT[state, WANTS[state]]
                ins = (NAMES[WANTS[state]], "")
                if (mid, initial) in NEXT:
                    options.append((NEXT[mid, initial], INSERT + KEEP + extra, "IK", (ins, (role, text))))
                options.append((NEXT[mid, WANTS[mid]], INSERT + REROLE + extra, "IR", (ins, (NAMES[WANTS[mid]], text))))
            for to, add, letters, lines in options:
                cand = (cost + add, node, letters, lines)
                have = best.get(to)
                if have is None or cand[0] < have[0] or (cand[0] == have[0] and self._less(cand[1:3], have[1:3])):
                    best[to] = cand
        least = min(cand[0] for cand in best.values())
        new = {}
        for to, (cost, parent, letters, lines) in best.items():
            if cost > least + BOUND:
                continue  # beaten by the cheapest survivor whatever follows
            node = Node(letters, lines, parent)
            self.live += 1
            node.refs += 1
            new[to] = (cost, node)
        for _, node in self.survivors.values():
            self._drop(node)
        self.survivors = new
        self._coalesce()

    def finish(self) -> tuple[int, str, str]:
        best = None
        for state, (cost, node) in self.survivors.items():
            letters, roles = DONE[state]
            cand = (cost + INSERT * len(roles), node, letters, roles)
            if best is None or cand[0] < best[0] or (cand[0] == best[0] and self._less(cand[1:3], best[1:3])):
                best = cand
        cost, node, letters, roles = best
        for n in self._suffix_nodes(node):
            self._emit(n)
        self._emit(Node(letters, tuple((NAMES[r], "") for r in roles), None))
        return cost, "".join(self.audit), self.sha.hexdigest() if self.lines_out else EMPTY_SHA

    def _suffix_nodes(self, node: Node) -> list[Node]:
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]


def repair_rows(rows) -> tuple:
    """Plain entry for one conversation: ``rows`` as (role, text, fault); gives (cost, audit, sha, illegal)."""
    v, illegal, before = Viterbi(), 0, None
    for role, text, fault in rows:
        if before is not None and (before + role[:1]) not in ("su", "ua", "au"):
            illegal += 1
        before = role[:1]
        v.row(role, text, fault)
    return (*v.finish(), illegal)


OUT = "conv_id long, n_rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, most_live long"


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in OUT.split(", "))])


SCHEMA = _schema()


def _stream(batches):
    """Conversations of one sorted partition, streamed: one result row per conversation."""
    out = {k: [] for k in ("conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "most_live")}
    current, v = object(), None
    counts, previous = None, None

    def close():
        cost, audit, sha = v.finish()
        for k, x in zip(out, (current, *counts, cost, audit, sha, v_most[0])):
            out[k].append(x)

    v_most = [0]
    for batch in batches:
        cols = batch.to_pydict()
        for conv, role, text, blank, later, cut in zip(cols["conv_id"], cols["role"], cols["text"], cols["blank"], cols["later"], cols["cut"]):
            if conv != current or v is None:
                if v is not None:
                    close()
                current, v, counts, previous, v_most[0] = conv, Viterbi(), [0, 0, 0, 0, 0], None, 0
            # rows equal to the one before (same turn, role, text, copy) were not told apart by the join
            same = previous is not None and previous == (role, text)
            fault = "b" if blank else "d" if (later or same) else "t" if cut else ""
            counts[0] += 1
            if fault:
                counts["bdt".index(fault) + 1] += 1
            if previous is not None and (previous[0][:1] + role[:1]) not in ("su", "ua", "au"):
                counts[4] += 1
            previous = (role, text)
            v.row(role, text, fault)
            v_most[0] = max(v_most[0], v.live)
        if len(out["conv_id"]) >= 256:
            yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)
            out = {k: [] for k in out}
    if v is not None:
        close()
    yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("_ck", F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))))


def repair(conversations: DataFrame) -> DataFrame:
    """Per original conversation: gaps, fault counts, illegal role pairs, cost, audit and repaired digest."""
    from pagetrawl.session import settle

    spark = conversations.sparkSession
    rows = settle(damaged(conversations.select("conv_id", "turn", "role", "text")), "conversations-damaged")
    faults = with_faults(rows)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = faults.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    found = ordered.select("conv_id", "role", "text", "blank", "later", "cut").mapInArrow(_stream, OUT)
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    every = _key(conversations.select("conv_id").distinct())
    joined = every.join(_key(found).drop("conv_id"), "_ck", "left").join(_key(gaps).drop("conv_id"), "_ck", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "conv_id",
        F.coalesce("gaps", zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
        F.coalesce("n_rows", zero).alias("n_rows"),
        F.coalesce("most_live", zero).alias("most_live"),
    )
