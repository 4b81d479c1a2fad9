"""The trie of conversation prefixes: ternary search trees over turn ids, one per range shard.

A turn is told by 128 bits of its SHA-256, so that texts are read once and never move. Conversations are dealt out
by ranges of their sequence of turns, ties by id, so that a prefix's members stand together, in one shard
or in several that follow each other, however many there are. A task numbers the turns of its shard by
a dictionary, inserts the distinct sequences median first, which balances the tree at every depth, and
goes over its nodes once, without recursion, from the last to the first, adding up members, leaves and savings.

Only a prefix of a shard's first or last sequence can have members elsewhere. These boundary nodes are
emitted as parts and merged: counts are summed, and what neighbours both counted is taken off. There are as many
as a shard's first and last sequence have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticelake.llm.common import prepare, release
from noticelake.storage import cut

#: Turns that a shard holds, on average. A node takes about 300 bytes of a task.
SHARD = 200_000
#: Bytes of ids in one row, where a boundary node has more.
PIECE = 1 << 18
DIGEST = 16
_ROOT = b"\x00" * DIGEST


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``c``, its id, and ``turns``, an array of struct(id, n): what tells a turn, and its length.

    Turns are ordered by number, null first; those of one number by their ids, so that equal rows in any order give
    equal sequences, and repeated rows are turns of their own. A null role or text counts as empty. Turns without a
    conversation are left out. A conversation's turns are gathered in one row at 24 bytes each; their texts are not.
    """
    who, said = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    told = F.substring(F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)), 1, DIGEST)
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("c"), F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), told.alias("id"), F.length(said).alias("n")).alias("t"))
    return rows.where("c is not null").groupBy("c").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"], t["n"])).alias("turns"))


def rebased(found: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Replaces every sequence's first ``head`` turns, ``most`` of them at most, by those of the sequence whose id is ``base``.

    A base's own base must be itself. It gives all its turns if it has fewer, and none if there is no such sequence.
    One shuffle by ``base`` puts a conversation beside those that are rebuilt on it.
    """
    given = F.max(F.when(F.col("c") == F.col("__base"), F.slice("turns", 1, most))).over(W.partitionBy("__base"))
    beside = found.withColumn("__base", base).withColumn("__head", head).withColumn("__given", given)
    rest = F.slice("turns", F.col("__head") + 1, F.greatest(F.size("turns") - F.col("__head"), F.lit(0)))
    lent = F.when(F.col("__given").isNotNull(), F.slice("__given", 1, F.col("__head"))).otherwise(F.slice("turns", 1, 0))
    return beside.select("c", F.concat(lent, rest).alias("turns"))


_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, shard int, path binary, parent_path binary, size long, own long, at_end boolean, closing boolean, piece int, ids string"


class _Tree:
    """A ternary search tree: a node's ``low`` and ``high`` are its siblings by symbol, ``down`` its children."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down, self.up, self.depth = [-1], [0], [0], [0], [0], [0]

    def insert(self, word: list[int]) -> int:
        """The node of ``word``; new ones come after all others, so a child has a larger number than its parent."""
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        at = 0
        for depth, s in enumerate(word, 1):
            side, came = down, at
            node = down[at]
            while node and symbol[node] != s:
                side = low if s < symbol[node] else high
                came, node = node, side[node]
            if not node:
                node = side[came] = len(symbol)
                symbol.append(s)
                for links in (low, high, down):
                    links.append(0)
                self.up.append(at)
                self.depth.append(depth)
            at = node
        return at


def _medians(n: int) -> Iterator[int]:
    """0 to n-1, every middle before the halves beside it."""
    open_ = [(0, n)]
    while open_:
        a, b = open_.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            open_ += [(m + 1, b), (a, m)]


def _chain(ids: list[bytes]) -> list[bytes]:
    """What tells each prefix of a sequence, from the root on."""
    out = [_ROOT]
    for x in ids:
        out.append(hashlib.sha256(out[-1] + x).digest()[:DIGEST])
    return out


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _pieces(ids: list[int]) -> Iterator[str]:
    """The ids comma-joined, in pieces of a bounded size that end before a comma."""
    at, width = 0, PIECE // 20
    while at < len(ids):
        yield ",".join(map(str, ids[at : at + width]))
        at += width


def _shard(shard: int, convs: list[int], turns: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard of ordered sequences: complete ones, and parts of those at its boundaries."""
    stops = turns.offsets.to_numpy()
    stops = (stops - stops[0]).tolist()
    flat = turns.flatten()
    coded = flat.field("id").dictionary_encode()
    order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable") if len(coded.dictionary) else np.zeros(0, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # numbers in the order of the ids
    numbers = rank[coded.indices.to_numpy(zero_copy_only=False)].tolist() if len(flat) else []
    sizes = flat.field("n").to_numpy(zero_copy_only=False).tolist()
    words = [numbers[a:b] for a, b in zip(stops, stops[1:], strict=False)]
    starts = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
    bounds = [*starts, len(words)]
    tree = _Tree()
    ending: dict[int, tuple[int, int]] = {}
    length = [0]
    for k in _medians(len(starts)):
        i = bounds[k]
        node = tree.insert(words[i])
        ending[node] = (i, bounds[k + 1])
        new = len(tree.symbol) - len(length)
        if new:
            length += sizes[stops[i + 1] - new : stops[i + 1]]
    n, up, depth = len(tree.symbol), tree.up, tree.depth
    members, first, children, leaves, used, own = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, list(length)
    for node, (a, b) in ending.items():
        members[node], first[node] = b - a, min(convs[a:b])
    for node in range(n - 1, -1, -1):  # used: members times length, own: length once, over the subtree
        leaves[node] = leaves[node] or 1
        used[node] += members[node] * length[node]
        if node:
            p = up[node]
            members[p] += members[node]
            children[p] += 1
            leaves[p] += leaves[node]
            used[p] += used[node]
            own[p] += own[node]
            if first[p] is None or first[node] < first[p]:
                first[p] = first[node]
    # nodes on the way to the first and to the last sequence
    path: dict[int, bytes] = {}
    closing: set[int] = set()
    for i in (0, len(words) - 1):
        ids = coded.dictionary.take(coded.indices.slice(stops[i], stops[i + 1] - stops[i])).to_pylist()
        way, node = [0], 0
        for s in words[i]:
            node = tree.down[node]
            while tree.symbol[node] != s:
                node = tree.low[node] if s < tree.symbol[node] else tree.high[node]
            way.append(node)
        path |= zip(way, _chain(ids), strict=True)
        if i == len(words) - 1:
            closing = set(way)
            last = way[-1]
    rows: list[tuple] = []
    for node in range(n):
        a, b = ending.get(node, (0, 0))
        p = up[node]
        told = path.get(node)
        rows.append((
            first[node], depth[node], first[p] if node else None, members[node], children[node], leaves[node], used[node] - own[node], _sha(convs[a:b]) if told is None else None, shard, told,
            path.get(p) if node else None, length[node], own[node], node == last if told is not None else None, node in closing if told is not None else None, None, None,
        ))
        if told is not None and b > a:
            rows += [(None, None, None, None, None, None, None, None, shard, told, None, None, None, None, None, k, x) for k, x in enumerate(_pieces(convs[a:b]))]
        if len(rows) >= 8192:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _NODE.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table["shard"][0].as_py()
        turns = table["turns"].combine_chunks()
        yield from _shard(shard, table["c"].to_pylist(), turns if isinstance(turns, pa.Array) else turns.chunk(0))
    release()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per path over all its pieces, which come in order and may span batches; a piece is held at a time."""
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])
    now, sha = None, None
    for batch in batches:
        done = []
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids"), strict=True):
            if path != now:
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = path, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], schema=schema)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], schema=schema)


def trie(found: DataFrame) -> DataFrame:
    """The nodes of all prefixes of sequences (``c``, ``turns``): the result's columns are those of the query.

    A node is told by its smallest member ``conv_id`` and its ``depth``. ``saved_tokens`` is what sharing saves in its subtree:
    members but one, times the length of the node's turn. No sequences, no nodes; sequences without turns end at the root.
    The sequences and the shards' nodes are written to the shared folder; parts of boundary nodes, twice the turns of a
    sequence per shard, are what is shuffled after that. A member list of any length is hashed piece by piece.
    """
    spark: SparkSession = found.sparkSession
    prepare(spark)
    held = cut(found, "sequences")
    total = held.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD), min(spark.sparkContext.defaultParallelism, total // 1000))
    ranged = held.select("c", "turns", F.col("turns.id").alias("__ids")).repartitionByRange(shards, "__ids", "c").sortWithinPartitions("__ids", "c")
    nodes = cut(ranged.select("c", "turns", F.spark_partition_id().alias("shard")).mapInArrow(_shards, _NODE), "trie")
    parts = nodes.where("path is not null and piece is null")
    # a boundary node that a later shard has as well was counted by both
    later = parts.withColumn("again", F.max("shard").over(W.partitionBy("path")) > F.col("shard"))
    below = W.partitionBy("shard", "closing").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    twice = F.col("closing") & F.col("again")
    off = (
        later.withColumn("off_size", F.sum(F.when(twice, F.col("size")).otherwise(0)).over(below))
        .withColumn("off_leaf", F.max(F.when(twice & F.col("at_end"), 1).otherwise(0)).over(below))
        .withColumn("deepest", F.max(F.when(twice, F.col("depth"))).over(W.partitionBy("shard", "closing")))
    )
    off = off.withColumn("on", F.col("closing") & (F.col("depth") <= F.coalesce("deepest", F.lit(-1))))
    only = lambda c, on=F.col("on"): F.when(on, c).otherwise(0)
    merged = off.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_path").alias("parent_path"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - only(F.lit(1), F.col("on") & (F.col("depth") < F.col("deepest")))).alias("n_children"),
        F.sum(F.col("n_leaves") - only(F.col("off_leaf"))).alias("n_leaves"), F.sum(F.col("saved") + only(F.col("off_size"))).alias("saved_tokens"),
    )
    merged = cut(merged, "boundaries")
    ids = nodes.where("ids is not null").select("path", "shard", "piece", "ids")
    ends = ids.repartition("path").sortWithinPartitions("path", "shard", "piece").select("path", "ids").mapInArrow(_digests, "path binary, ends_sha256 string")
    parent = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("__parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    joint = merged.join(ends, "path", "left").join(parent, "parent_path", "left").withColumn("parent_conv_id", F.col("__parent"))
    joint = joint.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha([])))).select(*columns)
    # the parents of a shard's own nodes, by shard: so many rows at most as the shard has
    known = parts.select("shard", F.col("path").alias("parent_path")).join(parent, "parent_path")
    own = nodes.where("path is null").withColumnRenamed("saved", "saved_tokens")
    hung = own.where("parent_path is not null").join(known, ["shard", "parent_path"]).withColumn("parent_conv_id", F.col("__parent"))
    every = joint.unionByName(own.where("parent_path is null").select(*columns)).unionByName(hung.select(*columns))
    return every.select(*[F.col(x) if x == "ends_sha256" else F.col(x).cast("long").alias(x) for x in columns])
