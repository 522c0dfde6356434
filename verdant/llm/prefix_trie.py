"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node stands for a sequence of first turns; it is named by its depth and the
xor of its turns' hashes, each taken with the turn's place (two 64-bit words).
A conversation's turns are brought in order by a sort over ranges, so that a long
conversation lies over many tasks, and running xors of the ranges are joined.

The trie is cut into shards.  A shard's root is a node whose members drop to a
lower power of ``MEMBERS`` than its parent's, or one at the start of a band of
``BAND`` levels; its shard is what hangs below it down to the next roots.  So a
shard has at most MEMBERS nodes on a level and BAND levels.

Subtree totals are passed upwards (time-forward processing).  Within a shard,
nodes come sorted in reverse level order (Spark's external sort), and a priority
queue holds the totals on their way to parents.  First every shard is summed up,
and the sums go from shard root to shard root; then each shard is processed
with what reaches its nodes from the shards below.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.shared import stage

#: Conversations whose heads are shared, and the most turns shared.
PERIOD, HEADS = 100, 5
#: Nodes on a level of a shard, and levels of a shard, at most.
MEMBERS, BAND = 256, 4096
#: Messages that a queue holds in its heap; more are packed into sorted runs.
HEAP = 50_000
#: Bytes of conversation ids that one row of a node's ends holds.
CHUNK = 1 << 16


def own_head(conv_id: str) -> Column:
    """How many first turns a conversation takes from its base: crc32 of the decimal id, modulo 6."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % (HEADS + 1)


def _words(*of) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *of) for seed in ("one", "two")]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """One row for each depth of each rebuilt conversation, the root included:
    conv_id, depth, p1, p2 (name of the prefix), q1, q2 (name of its parent),
    chars (code points of the last text), ends (whether the conversation does)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x1, x2 = _words(role, text)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("tie"), x1.alias("x1"), x2.alias("x2"), F.length(text).cast("long").alias("chars"))
    turns = stage(turns, "turns")
    in_turn = ["turn", "role", "tie"]
    heads = turns.where(F.col("conv_id") % PERIOD == 0).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy(*in_turn))).where(F.col("i") <= HEADS)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "x1", "x2", "chars"))).alias("head"))
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % PERIOD).alias("base"), own_head("conv_id").alias("h"))
    lent = convs.join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t"))
    none = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("tie")]
    zero = F.lit(0).cast("long")
    rows = (convs.select("conv_id", F.lit(0).alias("side"), F.lit(0).alias("i"), *none, zero.alias("x1"), zero.alias("x2"), zero.alias("chars"))
            .unionByName(lent.select("conv_id", F.lit(1).alias("side"), "t.i", *none, "t.x1", "t.x2", "t.chars"))
            .unionByName(turns.select("conv_id", F.lit(2).alias("side"), F.lit(0).alias("i"), *in_turn, "x1", "x2", "chars")))
    order = ["side", "i", *in_turn]
    dealt = stage(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    here = Window.partitionBy("conv_id", "part").orderBy(*order)
    parts = Window.partitionBy("conv_id").orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("lent"))
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "lent": F.sum("lent").over(Window.partitionBy("conv_id")), "all": F.sum("n").over(Window.partitionBy("conv_id"))}).drop("n")
    place = F.col("before") + F.row_number().over(here) - 1  # the root is 0
    told = dealt.join(sizes, ["conv_id", "part"]).withColumns({"place": place, "h": own_head("conv_id").cast("long")})
    own = F.col("place") - F.col("lent") - 1  # place among its own turns
    told = told.where((F.col("side") < 2) | (own >= F.col("h"))).withColumn("depth", F.when(F.col("side") < 2, F.col("place")).otherwise(F.col("lent") + own - F.col("h") + 1))
    last = F.col("lent") + F.greatest(F.col("all") - F.col("lent") - 1 - F.col("h"), zero)
    y = _words("x1", "x2", "depth")
    told = stage(told.select("conv_id", "part", "depth", "chars", (F.col("depth") == last).alias("ends"), *[F.when(F.col("depth") > 0, y[k]).otherwise(zero).alias(f"y{k + 1}") for k in (0, 1)]), "hashed")
    sums = told.groupBy("conv_id", "part").agg(F.bit_xor("y1").alias("z1"), F.bit_xor("y2").alias("z2"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"z{k}").over(before), zero).alias(f"z{k}") for k in (1, 2)])
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = told.join(sums, ["conv_id", "part"]).withColumns({f"p{k}": F.col(f"z{k}").bitwiseXOR(F.bit_xor(f"y{k}").over(so_far)) for k in (1, 2)})
    return named.select("conv_id", "depth", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"y{k}")).alias(f"q{k}") for k in (1, 2)], "chars", "ends")


NODE = ["depth", "p1", "p2"]


class MessageQueue:
    """Totals on their way to parents, smallest key first.  Beyond ``HEAP``
    messages the heap is packed into a sorted run of arrays, 40 bytes a message;
    a shard's bounds bound the runs too, so that they stay in the task's memory
    and nothing is written to a machine's own folder."""

    def __init__(self, most: int = HEAP):
        self.most, self.heap, self.runs = most, [], []

    def push(self, key: tuple[int, int, int], leaves: int, saved: int) -> None:
        if len(self.heap) >= self.most:
            self.heap.sort()
            self.runs.append([0, np.array(self.heap, np.int64)])
            self.heap = []
        heapq.heappush(self.heap, (*key, leaves, saved))

    def take(self, key: tuple[int, int, int]) -> tuple[int, int]:
        """The sum of the messages under ``key``; none may wait under a smaller one."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] <= key:
            x = heapq.heappop(self.heap)
            assert x[:3] == key, "a message to no node"
            leaves, saved = leaves + x[3], saved + x[4]
        for run in self.runs:
            at, rows = run
            while at < len(rows) and tuple(rows[at, :3].tolist()) <= key:
                leaves, saved, at = leaves + int(rows[at, 3]), saved + int(rows[at, 4]), at + 1
            run[0] = at
        if self.runs and all(at == len(rows) for at, rows in self.runs):
            self.runs = []
        return leaves, saved


def _forward(batches):
    """mapInArrow: (g, up, side, p1, p2, q1, q2, leaf, saved, inner, row) by shard, in
    reverse level order, messages (side 0) before nodes -> (row, n_leaves, saved_tokens)."""
    queue, shard = MessageQueue(), None
    for batch in batches:
        g, up, side, p1, p2, q1, q2, leaf, saved, inner = (batch.column(k).to_pylist() for k in range(10))
        leaves_out, saved_out, rows = [], [], []
        for i in range(batch.num_rows):
            if g[i] != shard:
                queue, shard = MessageQueue(), g[i]
            key = (up[i], p1[i], p2[i])
            if side[i] == 0:
                queue.push(key, leaf[i], saved[i])
                continue
            more, tokens = queue.take(key)
            more, tokens = more + leaf[i], tokens + saved[i]
            leaves_out.append(more)
            saved_out.append(tokens)
            rows.append(i)
            if inner[i]:
                queue.push((up[i] + 1, q1[i], q2[i]), more, tokens)
        yield pa.RecordBatch.from_arrays([batch.column(10).take(pa.array(rows, pa.int64())), pa.array(leaves_out, pa.int64()), pa.array(saved_out, pa.int64())], ["row", "n_leaves", "saved_tokens"])


def _level(n: str) -> Column:
    """How many powers of MEMBERS a node's members exceed."""
    return sum((F.col(n) > MEMBERS ** k).cast("int") for k in range(1, 64) if MEMBERS ** k < 1 << 62)


def sharded(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the root of their shard: s0 (depth), s1, s2, and the root's level.

    Read off the smallest member's path: the last node at or before, within its
    band, at which the level drops or the band begins."""
    on_path = path.select("conv_id", *NODE).join(nodes.select(*NODE, F.col("conv_id").alias("owner"), _level("n_convs").alias("level")), NODE)
    band = F.floor(F.col("depth") / BAND)
    w = Window.partitionBy("conv_id", "band").orderBy("depth")
    root = F.when(F.coalesce(F.col("level") < F.lag("level").over(w), F.lit(True)), F.struct(F.col("depth").alias("s0"), F.col("p1").alias("s1"), F.col("p2").alias("s2")))
    told = on_path.withColumn("band", band).withColumn("root", root).withColumn("root", F.last("root", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return nodes.join(told.where("conv_id = owner").select(*NODE, "root.*", "level", "band"), NODE)


SHARD = ["s0", "s1", "s2"]


def _totals_of_shards(nodes: DataFrame) -> DataFrame:
    """(depth, p1, p2, leaves, saved): what reaches each node from shards below,
    by rounds over shard roots: lower levels first, later bands before earlier ones."""
    own = nodes.groupBy(*SHARD).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.first("level").alias("level"), F.first("band").alias("band"))
    roots = nodes.where((F.col("depth") == F.col("s0")) & (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.struct(*SHARD).alias("above"))
    told = roots.select(*SHARD, "depth", "q1", "q2").join(above, ["depth", "q1", "q2"], "left").select(*SHARD, "depth", "q1", "q2", "above")
    shards = stage(own.join(told, SHARD), "shards")
    rounds = sorted((r["level"], -r["band"]) for r in shards.select("level", "band").distinct().collect())
    sent = None
    for level, band in rounds[:-1]:  # the last round is the root's shard, which sends nothing
        here = shards.where((F.col("level") == level) & (F.col("band") == -band))
        if sent is not None:
            got = sent.groupBy(*[F.col(f"above.{c}").alias(c) for c in SHARD]).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("tokens"))
            here = here.join(got, SHARD, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("tokens", F.lit(0))})
        now = stage(here.select("above", (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "leaves", "saved"), "round")
        sent = now if sent is None else sent.unionByName(now)
    if sent is None:
        return None
    return sent.where("above is not null").groupBy("above", *NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(path: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes at which conversations end.  The ids of
    a node are sorted over ranges, joined to chunks there, and the chunks hashed in
    order as they stream by."""
    def chunks(batches):
        node, first, held, size = None, 0, [], 0

        def told():
            return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "p1": pa.array([node[1]], pa.int64()), "p2": pa.array([node[2]], pa.int64()), "first": pa.array([first], pa.int64()), "ids": [",".join(held)]})
        for batch in batches:
            for *now, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (now != node or size > CHUNK):
                    yield told()
                    held, size = [], 0
                if not held:
                    node, first = now, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield told()

    def digests(batches):
        node, digest = None, None

        def told():
            return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "p1": pa.array([node[1]], pa.int64()), "p2": pa.array([node[2]], pa.int64()), "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for *now, _, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now != node:
                    if node:
                        yield told()
                    node, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if node:
            yield told()

    ids = path.where("ends").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    runs = ids.mapInArrow(chunks, "depth long, p1 long, p2 long, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations.

    ``conversations`` has conv_id, turn, role, text; turns are ordered by number
    (null first; equal numbers by role and md5 of the text), null roles and texts
    are empty.  A conversation c takes the first h turns of c - c % 100 (all if
    fewer, none if absent) and its own after its first h, h = crc32(c) % 6.
    Returns, per node: conv_id (smallest member), depth, parent_conv_id (root:
    null), n_convs, n_children, n_leaves and saved_tokens of its subtree, and
    ends_sha256 of the ids that end there.  Rows that repeat are turns each; rows
    with a null id are left out; without rows there are no nodes, not even a root.
    Other columns are not read.
    """
    path = stage(rebuilt(conversations), "path")
    nodes = path.groupBy(*NODE).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("chars").alias("chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stage(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = stage(sharded(path, nodes), "sharded")
    g = lambda of: F.xxhash64(*[F.col(c) for c in of])
    inner = (F.col("depth") > 0) & ~((F.col("depth") == F.col("s0")) & (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2")))
    row = F.struct("conv_id", "depth", "p1", "p2", "q1", "q2", "n_convs", "n_children")
    stream = nodes.select(g(SHARD).alias("g"), (-F.col("depth")).alias("up"), F.lit(1).alias("side"), "p1", "p2", "q1", "q2", "leaf", "saved", inner.alias("inner"), row.alias("row"))
    below = _totals_of_shards(nodes)
    if below is not None:
        nothing = F.lit(None)
        stream = stream.unionByName(below.select(g([f"above.{c}" for c in SHARD]).alias("g"), (-F.col("depth")).alias("up"), F.lit(0).alias("side"), "p1", "p2", F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2"), F.col("leaves").alias("leaf"), "saved", F.lit(False).alias("inner"), nothing.cast(stream.schema["row"].dataType).alias("row")))
    stream = stream.repartition("g").sortWithinPartitions("g", "up", "p1", "p2", "side")
    told = stream.mapInArrow(_forward, "row struct<conv_id:long,depth:long,p1:long,p2:long,q1:long,q2:long,n_convs:long,n_children:long>, n_leaves long, saved_tokens long").select("row.*", "n_leaves", "saved_tokens")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    told = told.join(parents, ["depth", "q1", "q2"], "left").join(_ends(path), NODE, "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
