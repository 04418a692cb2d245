"""The prefix trie of conversations, in balanced parentheses.

A node is a distinct sequence of first turns (role and text); its members are
the conversations that begin with it. The trie says what a cache of shared
prefixes would save.

1. *Steps.* Turns become 16-byte marks first, so texts stay where they are. A
   stream over each conversation's turns, sorted inside partitions, chains the
   marks: one step per turn with the name of its node (a hash of all turns so far).
2. *Counts.* Partial aggregates give each node's members.
3. *Runs.* Nodes above each other with the same members are one run. Counts
   fall from run to run, so the runs of a conversation are at most the root of
   twice all turns, however long it is, and one conversation of millions of
   turns beside the others is one run. A conversation's path is the names of
   its runs; conversations that end at one node have one path, that of the
   least of them.
4. *Shards.* Paths are range-partitioned and sorted, so a node's members lie
   side by side, however many there are. Each partition writes its trie of runs
   as balanced parentheses: findclose (range min-max tree) delimits subtrees,
   ranks of ``()`` count leaves, a cumulative array over preorder gives savings.
5. *Spines.* Only nodes on the first and the last path of a shard can go on in
   a neighbour. Their sums leave out what the first path opens; each shard's
   first path is compared with the last one of the shard before, which says
   what of it is new, and then the sums of equal names are added up.
6. Runs are spread over their nodes again.

Defined results: turns are ordered by turn (null first), equal ones by their
mark; null role or text is empty; repeated rows are repeated turns; rows with a
null conversation id belong to no conversation and are left out; a conversation
all of whose rows have a null mark (see :func:`rebuilt`) has no turn and is a
member of the root alone; an empty table gives no rows. Other columns are never
read. A text is held whole by one task, a conversation is not. Nodes are told
apart by 128 bits of cryptographic hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm.common import materialise, workers_ready
from sylvan.llm.parens import BalancedParentheses

ROOT = bytes(16)
#: Runs that one shard's paths hold, about.
SHARD_RUNS = 400_000
#: Nodes sent to every task at most: those with more than this share of all steps.
HOT_NODES = 10_000


# --- turns -------------------------------------------------------------------

def turn_marks(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv, turn, mark (16 bytes), bytes (of the text)."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # the role's length goes before it, so no two turns are written alike
    mark = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 32))
    return (conversations.where(F.col(conv).isNotNull())
            .select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), mark.alias("mark"),
                    F.octet_length(t).cast("long").alias("bytes")))


def rebuilt(spark: SparkSession, marks: DataFrame, group: int, first: Column, most: int) -> DataFrame:
    """Every conversation c with its first ``first`` (a column of ``conv``, below ``most``) turns taken from c - c % group.

    conv, part, turn, mark, bytes; turns that are taken away stay as rows with
    a null mark, so a conversation left without turns is still there.
    """
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "mark")) - 1
    own = materialise(spark, marks.withColumn("place", place).select("conv", "place", "mark", "bytes"), "trie-turns")
    lead = own.where((F.col("conv") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    convs = own.where("place = 0").select("conv", (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"), first.alias("h"))
    given = convs.join(lead, "base").where("place < h").select("conv", F.lit(0).alias("part"), "place", "mark", "bytes")
    rest = own.select("conv", F.lit(1).alias("part"), "place", F.when(F.col("place") >= first, F.col("mark")).alias("mark"), "bytes")
    return given.union(rest).withColumnRenamed("place", "turn")


# --- 1, 2: steps and counts ----------------------------------------------------

def _chain(node: bytes, mark: bytes) -> bytes:
    return hashlib.blake2b(node + mark, digest_size=16).digest()


_STEPS = ["conv", "depth", "node", "bytes", "ends"]


def _step_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None  # the step that waits for the next row to say whether its conversation ends there
    for pdf in batches:
        out = []
        for conv, mark, size in zip(pdf["conv"].tolist(), pdf["mark"], pdf["bytes"].tolist()):
            if last is None or last[0] != conv:
                if last is not None:
                    out.append((*last, True))
                last = (conv, 0, ROOT, 0)
            if mark is not None:
                out.append((*last, False))
                last = (conv, last[1] + 1, _chain(last[2], mark), size)
        yield pd.DataFrame(out, columns=_STEPS)
    if last is not None:
        yield pd.DataFrame([(*last, True)], columns=_STEPS)


def steps_of(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Written: one row per conversation and depth, the root's included."""
    workers_ready(spark)
    order = [F.col(c).asc_nulls_first() for c in turns.columns if c in ("part", "turn")]
    lying = turns.repartition("conv").sortWithinPartitions("conv", *order, "mark")
    return materialise(spark, lying.select("conv", "mark", "bytes")
                       .mapInPandas(_step_batches, "conv long, depth long, node binary, bytes long, ends boolean"), "trie-steps")


def _counted(steps: DataFrame, *by: str) -> DataFrame:
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"),
                                  F.min(F.when(F.col("ends"), F.col("conv"))).alias("least_end"), F.count_if("ends").alias("n_ends"))


# --- 3: runs and paths ---------------------------------------------------------

_RUNS = ("conv long, depth long, n long, head binary, before long, last boolean, parent long, end_node binary, "
         "path binary, ns array<long>, weights array<long>, leaf boolean")
_RUN_COLUMNS = [c.split()[0] for c in _RUNS.split(", ")]


def _run_batches(root: dict):
    """Steps with their node's counts, sorted by (conv, depth) -> node rows, each by the least member, and path rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            out = []
            for s in pdf.itertuples(index=False):
                if now is None or now.conv != s.conv:
                    if now is not None:
                        now.end(out)
                    now = _Conversation(s.conv, root)
                now.step(s, out)
            yield _run_frame(out)
        if now is not None:
            now.end(out := [])
            yield _run_frame(out)
    return run


def _run_frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_RUN_COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in ("depth", "n", "before", "parent")} | {c: "boolean" for c in ("last", "leaf")})


class _Conversation:
    """The runs of one conversation while its steps pass by."""

    def __init__(self, conv: int, root: dict):
        self.conv, self.waits = conv, None
        self.heads, self.ns, self.weights = [ROOT], [root["n"]], [0]
        self.before, self.parent = 0, None
        # the root is no step of its own: its counts are the same for all conversations
        self.at_root = _Step(0, ROOT, 0, root["n"], root["least"], root["least_end"], root["n_ends"])

    def step(self, s, out: list) -> None:
        if self.waits is None:
            self.waits = self.at_root
        if s.depth > 0:
            self.move(_Step(s.depth, s.node, s.bytes, s.n, s.least, None if pd.isna(s.least_end) else int(s.least_end), s.n_ends), out)

    def move(self, nxt: "_Step", out: list) -> None:
        self.tell(nxt.n != self.waits.n, out)
        self.parent = self.waits.least
        if nxt.n == self.waits.n:
            self.before += self.waits.bytes
        else:
            self.heads.append(nxt.node)
            self.ns.append(nxt.n)
            self.weights.append(0)
            self.before = 0
        self.weights[-1] += (nxt.n - 1) * nxt.bytes
        self.waits = nxt

    def tell(self, last: bool, out: list) -> None:
        w = self.waits
        if w.least == self.conv:
            out.append((self.conv, w.depth, w.n, self.heads[-1], self.before, last, self.parent, w.node if w.n_ends else None,
                        None, None, None, None))

    def end(self, out: list) -> None:
        w = self.waits
        # members that all end here leave no child; otherwise the node goes on in others
        self.tell(True, out)
        if w.least_end == self.conv:
            out.append((self.conv, None, None, None, None, None, None, None,
                        b"".join(self.heads[1:]), self.ns, self.weights, w.n_ends == w.n))


class _Step:
    def __init__(self, depth, node, size, n, least, least_end, n_ends):
        self.depth, self.node, self.bytes, self.n = depth, node, size, n
        self.least, self.least_end, self.n_ends = least, least_end, n_ends


def runs_of(spark: SparkSession, steps: DataFrame, root: dict) -> DataFrame:
    """Written: node rows (path null) and path rows (path not null)."""
    workers_ready(spark)
    inner = steps.where("depth > 0")
    counts = materialise(spark, _counted(inner, "node"), "trie-counts")
    # a node with a share of all steps would be one hot join key: nodes with more than a 10,000th of them, 10,000 at
    # most, go to every task, and only the steps at other nodes are shuffled
    many = inner.count() // HOT_NODES
    hot, other = counts.where(F.col("n") > many), counts.where(F.col("n") <= many)
    inner = inner.select("conv", "depth", "node", "bytes")
    met = inner.join(F.broadcast(hot), "node").unionByName(
        inner.join(F.broadcast(hot.select("node")), "node", "left_anti").join(other, "node"))
    # the root would be one join key for every conversation; it comes as a step without counts
    none = [F.lit(None).cast("long").alias(c) for c in ("n", "least", "least_end", "n_ends")]
    at_root = steps.where("depth = 0").select("conv", "depth", "node", "bytes", *none)
    lying = at_root.unionByName(met).repartition("conv").sortWithinPartitions("conv", "depth")
    return materialise(spark, lying.mapInPandas(_run_batches(root), _RUNS), "trie-runs")


# --- 4: shards -------------------------------------------------------------------

_PARTS = ("kind string, shard int, at int, head binary, n_leaves long, saved long, n_children long, "
          "first binary, last binary, own array<long>, bits binary")
_PART_COLUMNS = [c.split()[0] for c in _PARTS.split(", ")]


def split_path(path: bytes) -> list[bytes]:
    return [path[i:i + 16] for i in range(0, len(path), 16)]


class Shard:
    """The trie of a sorted list of paths, as balanced parentheses with arrays in preorder."""

    def __init__(self):
        self.bits: list[int] = []
        self.heads, self.ns, self.weights, self.parents = [], [], [], []
        self.stack: list[int] = []
        self.path: list[bytes] = []
        self.first: list[bytes] | None = None
        self.leaf = True

    def add(self, path: bytes, ns, weights, leaf: bool) -> None:
        heads = [ROOT, *split_path(path)]
        same = 0
        for a, b in zip(heads, self.path):
            if a != b:
                break
            same += 1
        self.bits += [0] * (len(self.stack) - same)
        del self.stack[same:]
        for i in range(same, len(heads)):
            self.parents.append(self.stack[-1] if self.stack else -1)
            self.stack.append(len(self.heads))
            self.heads.append(heads[i])
            self.ns.append(int(ns[i]))
            self.weights.append(int(weights[i]))
            self.bits.append(1)
        self.path, self.leaf = heads, bool(leaf)
        if self.first is None:
            self.first = heads

    def rows(self, shard: int) -> Iterator[tuple]:
        left, right = len(self.first), set(self.stack)
        bits = np.asarray(self.bits + [0] * len(self.stack), dtype=bool)
        tree = BalancedParentheses(bits)
        at = np.flatnonzero(bits)
        close = tree.find_close(at)
        if not self.leaf:
            # the last path's end goes on in a later shard: its "()" is no leaf
            tree.pairs[at[-1] + 1:] -= 1
        leaves = tree.pairs[close] - tree.pairs[at]
        size = (close - at + 1) // 2
        weights = np.asarray(self.weights, dtype=np.int64)
        own = weights[:left].copy()
        weights[:left] = 0  # whether the first path is new here is seen when spines merge
        total = np.append(0, np.cumsum(weights))
        node = np.arange(len(at))
        saved = total[node + size] - total[node]
        children = np.bincount(np.asarray(self.parents[left:], dtype=np.int64), minlength=len(at))
        for i in range(len(at)):
            if i < left:
                yield "left", shard, i, self.heads[i], leaves[i], saved[i], children[i], None, None, None, None
            elif self.ns[i] > 1:
                yield "part" if i in right else "inner", shard, i, self.heads[i], leaves[i], saved[i], children[i], None, None, None, None
        suffix = np.append(np.cumsum(own[::-1])[::-1], 0)
        yield ("edge", shard, left, None, None, None, None, b"".join(self.first[1:]), b"".join(self.path[1:]), suffix.tolist(),
               np.packbits(bits).tobytes())


def _shard_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shard = Shard()
    for pdf in batches:
        for row in zip(pdf["path"], pdf["ns"], pdf["weights"], pdf["leaf"]):
            shard.add(*row)
    if shard.first is None:
        return
    rows = list(shard.rows(TaskContext.get().partitionId()))
    for lo in range(0, len(rows), 20_000):
        out = pd.DataFrame(rows[lo:lo + 20_000], columns=_PART_COLUMNS, dtype=object)
        yield out.astype({c: "Int64" for c in ("n_leaves", "saved", "n_children")})


def shards_of(spark: SparkSession, paths: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Written: per shard its nodes' sums (inner, part, left) and one edge row with the first and last path and the parentheses."""
    workers_ready(spark)
    runs = paths.agg(F.sum(F.size("ns"))).first()[0] or 0
    lying = paths.select("path", "ns", "weights", "leaf").repartitionByRange(max(1, -(-runs // shard_runs)), "path").sortWithinPartitions("path")
    return materialise(spark, lying.mapInPandas(_shard_batches, _PARTS), "trie-shards")


# --- 5: spines -------------------------------------------------------------------

def _common_runs(first: pd.Series, before: pd.Series) -> pd.Series:
    """How many nodes of ``first``, the root among them, the path before it has too; 0 without a path before it."""
    out = []
    for a, b in zip(first, before):
        k = 0
        if b is not None:
            k = 1
            for x, y in zip(split_path(a), split_path(b)):
                if x != y:
                    break
                k += 1
        out.append(k)
    return pd.Series(out)


def merged(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """head, n_leaves, saved, n_children of every run with two members or more."""
    workers_ready(spark)
    common = F.pandas_udf(_common_runs, "int")
    # one row a shard, so the window without partitions is small
    edges = shards.where("kind = 'edge'").select("shard", F.col("at").alias("size"), "first", "own", F.lag("last").over(W.orderBy("shard")).alias("prior"))
    known = materialise(spark, edges.select("shard", "size", "own", common("first", "prior").alias("known")), "trie-edges")
    new_child = (F.col("at") + 1 < F.col("size")) & (F.col("at") + 1 >= F.col("known"))
    left = shards.where("kind = 'left'").drop("own").join(known, "shard").select(
        "head", "n_leaves", (F.col("saved") + F.get("own", F.greatest("at", "known"))).alias("saved"),
        (F.col("n_children") + new_child.cast("long")).alias("n_children"))
    sums = ["n_leaves", "saved", "n_children"]
    spine = left.union(shards.where("kind = 'part'").select("head", *sums)).groupBy("head").agg(*[F.sum(c).alias(c) for c in sums])
    return spine.union(shards.where("kind = 'inner'").select("head", *sums))


# --- the operator ------------------------------------------------------------------

def end_hashes(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """node, sha256 over the ascending ids, comma-joined, of the conversations that end there (a stream: any number of them)."""
    def add(batches):
        node, h = None, None
        for pdf in batches:
            out = []
            for nd, conv in zip(pdf["node"], pdf["conv"].tolist()):
                if nd != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = nd, hashlib.sha256(str(conv).encode())
                else:
                    h.update(f",{conv}".encode())
            yield pd.DataFrame(out, columns=["node", "sha"])
        if node is not None:
            yield pd.DataFrame([(node, h.hexdigest())], columns=["node", "sha"])

    workers_ready(spark)
    ends = steps.where("ends").select("node", "conv").repartition("node").sortWithinPartitions("node", "conv")
    return ends.mapInPandas(add, "node binary, sha string")


def prefix_trie(spark: SparkSession, turns: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """turns (conv, part and turn or one of them, mark, bytes) -> one row per node.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    steps = steps_of(spark, turns)
    root = _counted(steps.where("depth = 0"), "depth").first()
    root = root.asDict() if root else {"n": 0, "least": None, "least_end": None, "n_ends": 0}
    runs = runs_of(spark, steps, root)
    shards = shards_of(spark, runs.where("path is not null"), shard_runs)
    nodes = runs.where("path is null").select("conv", "depth", "n", "head", "before", "last", "parent", "end_node")
    alone = nodes.where("n = 1").select("*", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
                                        F.lit(0).cast("long").alias("n_children"))
    shared = nodes.where("n > 1").join(merged(spark, shards), "head").select(*alone.columns)
    found = alone.unionByName(shared).join(end_hashes(spark, steps).withColumnRenamed("node", "end_node"), "end_node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("last"), F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))
