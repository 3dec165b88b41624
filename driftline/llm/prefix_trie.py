"""Prefix trie of conversations: how many begin with the same turns, and what sharing the common beginnings saves.

A node is a distinct sequence of first turns, named by a digest. Conversations are dealt over shards, whatever they begin
with, so no beginning is too common. Each shard keeps its part of the trie in flat numpy arrays, at the slots that a minimal
perfect hash gives its digests. A node that many shards have is merged from one row of each. Sums over subtrees run through
the slots of the parents, deepest nodes first; as every node's own value is held by one shard, the shards' sums add up.

Long conversations are cut into bands of BAND turns, so no task holds more than a band of any of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .components import look_up
from .perfect_hash import KeyTable

#: Turns of a conversation that one task holds at a time.
BAND = 4096
#: Rows of a shard, as a mean.
SHARD_ROWS = 50_000
#: Conversation identifiers that are written behind each other by one row.
LISTED = 10_000
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role, text):
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table (conv_id, pos, run, said, chars): each turn's place in its conversation, from 0, and its digest.

    Turns are in order of `turn`, null first, then of role and digest; null role and text are empty; turns without a
    conversation are left out. The rows are sorted over all partitions, so a conversation may spread over many; each
    partition numbers its part, and the counts of the parts before it are added. Only digests and lengths move.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), role_.alias("__role"), turn_digest(role_, text_).alias("said"),
        F.length(text_).cast("long").alias("chars"), F.rand(7).alias("__any"),
    )
    order = [F.col("conv_id"), F.col("__turn").asc_nulls_first(), F.col("__role"), F.col("said"), F.col("__any")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(place), pa.array(np.full(len(ids), run, np.int64)), batch.column("said"), batch.column("chars")],
                ["conv_id", "place", "run", "said", "chars"],
            )

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = staged(ordered.mapInArrow(number, "conv_id long, place long, run long, said binary, chars long"), "turn-pieces")
    # A conversation has a row for each partition that it reaches into.
    parts = pieces.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).filter("before > 0")
    placed = pieces.join(offsets.hint("shuffle_merge"), ["conv_id", "run"], "left")
    return staged(placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "run", "said", "chars"), "turns-placed")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, pos, run, said, chars, n) of rebuilt conversations; n is the number of their turns.

    Conversation c begins with the first h turns of conversation c - c % every, as far as there are any, and goes on with
    its own turns after its first h; h is the CRC-32 of the decimal c, modulo `most`. A conversation without turns has no row here.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("held"))
    # At most 2 * every conversations have the same base, and `most` turns of it are used.
    convs = convs.join(bases.hint("shuffle_merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    convs = convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    own = look_up(turns, convs.select("conv_id", "h", "taken", "n"), "conv_id").filter("pos >= h")
    heads = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "run", "said", "chars")
    heads = convs.select("conv_id", "base", "taken", "n").filter("taken > 0").join(heads.hint("shuffle_merge"), "base").filter("pos < taken")
    columns = ["conv_id", "pos", "run", "said", "chars", "n"]
    return own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*columns).union(heads.select(*columns))


def _chained(rows: DataFrame, *group: str) -> DataFrame:
    """(.., digest, before): digests of all the rows of a group up to each, and up to the one before it.

    The rows of a group come to one task in order and pass through it; no group is held.
    """
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, ROOT
        for batch in batches:
            found, before = [], []
            for key, said in zip(zip(*(batch.column(g).to_pylist() for g in group)), batch.column("said").to_pylist()):
                if key != last:
                    last, digest = key, ROOT
                before.append(digest)
                digest = hashlib.sha256(digest + said).digest()
                found.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(before, pa.binary())], [*batch.schema.names, "digest", "before"])

    spread = rows.repartition(*group).sortWithinPartitions(*group, "pos")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread.mapInArrow(chain, f"{fields}, digest binary, before binary")


def paths(turns: DataFrame) -> DataFrame:
    """A written table (conv_id, depth, band, digest, parent, said, chars, n) of all beginnings of all conversations.

    In the first band a digest chains the turns' digests. Beyond it, it is made of the digest of all bands before and of the
    chain within its own, so bands are chained independently.
    """
    rows = turns.select("conv_id", "pos", F.floor(F.col("pos") / BAND).alias("band"), "said", "chars", "n")
    chained = staged(_chained(rows, "conv_id", "band"), "chains")
    first = chained.filter("band = 0").withColumn("parent", F.col("before"))
    later = chained.filter("band > 0")
    columns = ["conv_id", (F.col("pos") + 1).alias("depth"), "band", "digest", "parent", "said", "chars", "n"]
    # Full bands of long conversations, and the digest of all of them up to each.
    full = chained.filter((F.col("pos") % BAND == BAND - 1) & (F.col("n") > BAND)).select("conv_id", F.col("band").alias("pos"), F.col("digest").alias("said"))
    bands = _chained(full, "conv_id").select("conv_id", (F.col("pos") + 1).alias("band"), "said", F.col("digest").alias("all"), F.col("before").alias("all_before"))
    joined = lambda all_, own: F.unhex(F.sha2(F.concat(all_, own), 256))
    # The last turn of the band before: in the first band its chain is its digest.
    last_before = F.when(F.col("band") == 1, F.col("b.said")).otherwise(joined(F.col("all_before"), F.col("b.said")))
    far = later.alias("l").join(bands.alias("b").hint("shuffle_merge"), ["conv_id", "band"]).select(
        "conv_id", "pos", "band", joined(F.col("all"), F.col("l.digest")).alias("digest"),
        F.when(F.col("pos") % BAND == 0, last_before).otherwise(joined(F.col("all"), F.col("l.before"))).alias("parent"),
        F.col("l.said").alias("said"), F.col("l.chars").alias("chars"), F.col("l.n").alias("n"),
    )
    return staged(first.select(*columns).union(far.select(*columns)), "paths")


def _words(digests: pa.Array) -> np.ndarray:
    """32-byte digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


class ShardTable:
    """The nodes of one band of one shard, at the slots of their digests."""

    def __init__(self, rows: pa.Table):
        words = _words(rows.column("digest").combine_chunks())
        distinct, first = np.unique(words, axis=0, return_index=True)
        self.nodes = KeyTable(distinct)
        self.slot = self.nodes.slots(words)
        #: One row of each node.
        self.row = np.zeros(len(self.nodes), np.int64)
        self.row[self.nodes.slots(distinct)] = first
        depth = rows.column("depth").to_numpy()
        above = _words(rows.column("parent").combine_chunks())
        said = _words(rows.column("said").combine_chunks())
        one = self.row[self.slot]
        if (self.slot < 0).any() or (depth != depth[one]).any() or (above != above[one]).any() or (said != said[one]).any():
            raise ValueError("two different beginnings have one digest")
        self.depth = depth[self.row]
        #: The slot of the parent; -1 for the nodes that begin the band.
        self.parent = self.nodes.slots(above[self.row])

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Each node's value with those of all nodes below it."""
        values = values.copy()
        order = np.argsort(-self.depth, kind="stable")
        levels = np.flatnonzero(np.diff(self.depth[order], prepend=self.depth[order[:1]] + 1))
        for level in np.split(order, levels[1:]):
            held = level[self.parent[level] >= 0]
            np.add.at(values, self.parent[held], values[held])
        return values


def _count_nodes(rows: pa.Table) -> pa.Table:
    shard = ShardTable(rows)
    members = np.zeros(len(shard.nodes), np.int64)
    np.add.at(members, shard.slot, 1)
    smallest = np.full(len(shard.nodes), np.iinfo(np.int64).max)
    np.minimum.at(smallest, shard.slot, rows.column("conv_id").to_numpy())
    held = rows.select(["digest", "parent", "said", "depth", "chars"]).take(pa.array(shard.row))
    return held.append_column("n_convs", pa.array(members)).append_column("conv_id", pa.array(smallest))


def _sum_subtrees(rows: pa.Table) -> pa.Table:
    shard = ShardTable(rows)
    sums = []
    for name in ("leaves", "saved"):
        own = np.zeros(len(shard.nodes), np.int64)
        np.add.at(own, shard.slot, rows.column(name).to_numpy())
        sums.append(pa.array(shard.summed(own)))
    return pa.table([rows.column("digest").take(pa.array(shard.row)), *sums], ["digest", "n_leaves", "saved_tokens"])


def _ends(ending: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the digest of the members that end at each node, in order, with commas between.

    Identifiers are sorted over all partitions and listed piece by piece; a node's pieces then pass through one task, as
    SHA-256 takes its bytes in order, without being held.
    """
    order = ["digest", "conv_id"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            digests, ids = batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()
            starts = [i for i in range(len(ids)) if not i or digests[i] != digests[i - 1]]
            cuts = [c for s, e in zip(starts, [*starts[1:], len(ids)]) for c in range(s, e, LISTED)]
            pieces = [",".join(map(str, ids[s:e])) for s, e in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_pydict({"digest": [digests[c] for c in cuts], "run": [run] * len(cuts), "no": [*range(no, no + len(cuts))], "ids": pieces})
            no += len(cuts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, sha.hexdigest()))
                last, sha = digest, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["digest", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["digest", "ends_sha256"])

    pieces = ending.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(listed, "digest binary, run long, no long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "run", "no").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _with_later_bands(valued: DataFrame, long_ones: DataFrame) -> DataFrame:
    """What later bands of a conversation hold lies below its last turn in each band, so it is added there."""
    after = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = valued.join(long_ones.hint("shuffle_merge"), "conv_id", "left_semi").groupBy("conv_id", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    carried = bands.select(
        "conv_id", ((F.col("band") + 1) * BAND).alias("depth"), F.sum("leaves").over(after).alias("more_leaves"), F.sum("saved").over(after).alias("more_saved")
    ).filter("more_leaves IS NOT NULL")
    joined = valued.join(carried.hint("shuffle_merge"), ["conv_id", "depth"], "left").fillna(0, ["more_leaves", "more_saved"])
    return joined.withColumns({x: F.col(x) + F.col(f"more_{x}") for x in ("leaves", "saved")}).drop("more_leaves", "more_saved")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest.

    `turns` is (conv_id, pos, run, said, chars, n) with places from 0 to n - 1, and `conversations` has a row (conv_id, n) for
    each conversation, with n = 0 where it has no turns: it belongs to the root only. A node is named by its smallest member
    and its depth. `saved_tokens` sums, over the subtree, what is saved by keeping the last turn of a node once instead of
    once per member, in code points. Without conversations there is no node.
    """
    walked = paths(turns)
    root = conversations.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("band"), F.lit(bytearray(ROOT)).alias("digest"),
        F.lit(bytearray(32)).alias("parent"), F.lit(bytearray(ROOT)).alias("said"), F.lit(0).cast("long").alias("chars"), "n",
    )
    all_rows = walked.union(root)
    total = walked.count()
    shards = max(1, total // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(shards)).alias("shard")

    node = "digest binary, parent binary, said binary, depth long, chars long, n_convs long, conv_id long"
    parts = all_rows.select(shard, "band", "conv_id", "depth", "digest", "parent", "said", "chars").groupBy("shard", "band").applyInArrow(_count_nodes, node)
    merged = parts.groupBy("digest").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("depth").alias("depth2"),
        F.min("parent").alias("parent"), F.max("parent").alias("parent2"), F.min("said").alias("said"), F.max("said").alias("said2"), F.min("chars").alias("chars"),
    )
    same = (F.col("depth") == F.col("depth2")) & (F.col("parent") == F.col("parent2")) & (F.col("said") == F.col("said2"))
    checked = F.when(same, F.col("n_convs")).otherwise(F.raise_error(F.lit("two different beginnings have one digest")).cast("long"))
    nodes = staged(merged.select("digest", "parent", "depth", "chars", "conv_id", checked.alias("n_convs")), "trie-nodes")

    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children.hint("shuffle_merge"), "digest", "left").fillna(0, ["n_children"]), "trie-counted")

    # Every node's own value is held by its smallest member's row: (conversation, depth) is a key on both sides.
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    valued = all_rows.join(own.hint("shuffle_merge"), ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"])
    valued = valued.select(shard, "band", "conv_id", "depth", "digest", "parent", "said", "leaves", "saved")
    long_ones = conversations.filter(F.col("n") > BAND).select("conv_id")
    if not long_ones.isEmpty():
        valued = _with_later_bands(valued, long_ones)
    sums = valued.groupBy("shard", "band").applyInArrow(_sum_subtrees, "digest binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = _ends(all_rows.filter(F.col("depth") == F.col("n")).select("digest", "conv_id"))
    found = nodes.join(sums.hint("shuffle_merge"), "digest").join(ends.hint("shuffle_merge"), "digest", "left")
    # Many nodes may have one parent; each asks once with those of its run.
    names = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = look_up(found.withColumn("run", F.pmod(F.xxhash64("digest"), F.lit(max(1, shards)))), names, "parent")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest",
    )
