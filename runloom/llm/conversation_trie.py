"""A prefix trie of conversations by vertical bitmaps: who shares which first turns, and what that saves.

1. Turns: each turn becomes two 64-bit hashes of role and text; texts are not shuffled. Places are counted per
   conversation in chunks of its turn numbers, so that no conversation is numbered in one window.
2. Shards: a shard holds about BLOCK_CONVERSATIONS conversations, chosen by a hash of the id, and a band of 256 places
   of them, so a very long conversation is many shards. A band starts from the key of the prefix before it.
3. Index: within a shard each (place, turn) has a bitset of the conversations that have it. The depth-first walk intersects the
   bitset of a parent with the postings at the next place: each intersection is a child, its popcount the
   members, and the bitset of the conversations whose last place this is gives the end list.
4. Merge: a prefix has the same key in all shards, the exclusive or of the hashes of its (place, turn) pairs. Nodes of
   equal key are added up; the smallest member owns the node.
5. Subtrees: each node's own figures stand in the shard of its owner, once. Shards add them up from their deepest nodes to
   their top; what lies in later bands of a conversation comes in as one sum per conversation. The sums of all shards add up
   to the node's subtree.

Keys have 128 bits; two prefixes would have to collide in all of them to be taken for one.

Defined results: conversations are ordered by turn, null first, rows of the same turn by the hashes of role and text. Null roles and
texts are empty. Rows without conv_id belong to no conversation. Repeated rows are turns of their own. An empty table has no node,
not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import stored

BLOCK_CONVERSATIONS = 1024
#: A band has 2 ** BAND_BITS places.
BAND_BITS = 8
#: Turn numbers of one chunk while places are counted, and ids of one piece of an end list.
CHUNK_BITS, PIECE_BITS = 12, 12
#: Before all chunks: turns without a number.
_NO_TURN = -(1 << 62)


# --- Turns and places ---------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1, t2 (hashes of role and text), bytes (of the text in UTF-8)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = rows.withColumn("chunk", F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(_NO_TURN)))
    earlier = Window.partitionBy("_c").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("conv_id").alias("_c"), F.col("chunk").alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    joined = numbered.join(starts, (F.col("conv_id") == F.col("_c")) & (F.col("chunk") == F.col("_chunk")))
    return joined.select("conv_id", (F.col("_start") + F.col("_at")).alias("place"), "t1", "t2", "bytes")


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("place").alias("n"))


def branched(turns: DataFrame, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation c took its first `head` turns (at most `most`) from c - c % group.

    A conversation that is not there lends nothing, a shorter one all it has. The turns that follow are the
    conversation's own after its first `head`.
    """
    lengths = lengths_of(turns)
    base = F.col("conv_id") - F.col("conv_id") % group
    lent = lengths.select(F.col("conv_id").alias("_b"), F.col("n").alias("_lent"))
    plan = lengths.withColumn("base", base).withColumn("h", head.cast("long")).join(lent, F.col("base") == F.col("_b"), "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("_lent", F.lit(0)))).select(F.col("conv_id").alias("_c"), "base", "h", "taken", "n")
    plan = stored(plan, "trie-plan")
    # At most `group` conversations read from one, and only its first turns.
    first = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "_from")
    heads = plan.join(first, F.col("base") == F.col("_from")).where("place <= taken").select(F.col("_c").alias("conv_id"), "place", "t1", "t2", "bytes")
    own = turns.join(plan, F.col("conv_id") == F.col("_c")).where("place > h")
    tails = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "t1", "t2", "bytes")
    new = plan.select(F.col("_c").alias("conv_id"), (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return heads.union(tails), new


# --- Shards -------------------------------------------------------------------------


def _bands(turns: DataFrame, lengths: DataFrame, block_conversations: int, band_bits: int) -> DataFrame:
    """One row per conversation and band: its turns there, the key before it, and whether it ends there.

    Place 0 stands for the textless root, which all conversations have.
    """
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("place"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "bytes")])
    marks = [F.xxhash64(F.lit(seed), "t1", "t2", "place").alias(f"m{seed}") for seed in (1, 2)]
    placed = turns.select(*root.columns).union(root).select("conv_id", F.shiftright("place", band_bits).alias("band"), F.struct("place", *marks, "bytes").alias("turn"))
    packed = placed.groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.m1").alias("x1"), F.bit_xor("turn.m2").alias("x2")
    )
    packed = stored(packed, "trie-bands")
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    entry = [F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"e{k}") for k in (1, 2)]
    last = F.max("band").over(Window.partitionBy("conv_id")) == F.col("band")
    entries = packed.select(F.col("conv_id").alias("_c"), F.col("band").alias("_band"), *entry, last.alias("ends"))
    blocks = max(1, -(-lengths.count() // block_conversations))
    block = F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(blocks)).alias("block")
    joined = packed.join(entries, (F.col("conv_id") == F.col("_c")) & (F.col("band") == F.col("_band")))
    return joined.select(block, "band", "conv_id", "e1", "e2", "ends", "turns")


_LOCAL = "block long, band long, entry boolean, k1 long, k2 long, p1 long, p2 long, depth long, least long, n long, bytes long, ends array<long>, leaves array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 8, pa.list_(pa.int64()), pa.list_(pa.int64())]


def bitset(members: np.ndarray, size: int) -> int:
    """The members as bits of one number."""
    if len(members) == 1:
        return 1 << int(members[0])
    marks = np.zeros(size, np.uint8)
    marks[members] = 1
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def _members(bits: int, ids: np.ndarray) -> list[int]:
    """Ids of the set bits, ascending."""
    if not bits:
        return []
    octets = np.frombuffer(bits.to_bytes(-(-len(ids) // 8), "little"), np.uint8)
    return ids[np.flatnonzero(np.unpackbits(octets, bitorder="little")[: len(ids)])].tolist()


def _groups(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each row the number of its value, and the rows of each value."""
    _, at = np.unique(values, return_inverse=True)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at)) if len(at) else np.array([], int)
    return at, np.split(order, ends[:-1]) if len(at) else []


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.stack([left, right], 1)).view("V16").ravel()


def walk_shard(table: pa.Table, band_bits: int) -> pa.Table:
    """The nodes of one shard: the index of (place, turn), then the walk that intersects a parent's bitset with it."""
    block, band = (table.column(c)[0].as_py() for c in ("block", "band"))
    ids = table.column("conv_id").to_numpy()
    order = np.argsort(ids)
    table, ids = table.take(pa.array(order)), ids[order]
    lists = table.column("turns").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    turns = lists.flatten()
    m1, m2, size = (turns.field(c).to_numpy() for c in ("m1", "m2", "bytes"))
    owner = np.repeat(np.arange(len(ids)), sizes)
    starts = (np.cumsum(sizes) - sizes).tolist()

    posting_of, rows_of = _groups(_pairs(m1, m2))
    postings = [bitset(owner[rows], len(ids)) for rows in rows_of]
    posting_of = posting_of.tolist()
    # Bits of the conversations whose last place of the band is this one, by whether they end there or go on.
    ends = table.column("ends").to_numpy(zero_copy_only=False)
    _, stop_rows = _groups(sizes)
    stops = {int(sizes[r[0]]) - 1: bitset(r, len(ids)) for r in stop_rows}
    ended = bitset(np.flatnonzero(ends), len(ids)) if ends.any() else 0
    m1, m2, size = m1.tolist(), m2.tolist(), size.tolist()

    out: list[list] = [[] for _ in _KINDS]

    def add(*row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    first = band << band_bits
    e1, e2 = (table.column(c).to_numpy() for c in ("e1", "e2"))
    stack = []
    for rows in _groups(_pairs(e1, e2))[1]:
        bits, k1, k2 = bitset(rows, len(ids)), int(e1[rows[0]]), int(e2[rows[0]])
        stack.append((bits, -1, k1, k2))
        if band:
            add(block, band, True, k1, k2, None, None, first - 1, int(ids[rows[0]]), len(rows), 0, [], [])
    while stack:
        bits, level, p1, p2 = stack.pop()
        level += 1
        while bits:
            lowest = (bits & -bits).bit_length() - 1
            at = starts[lowest] + level
            posting = posting_of[at]
            child = bits & postings[posting]
            bits ^= child
            k1, k2 = p1 ^ m1[at], p2 ^ m2[at]
            stop = child & stops.get(level, 0)
            add(
                block, band, False, k1, k2, p1, p2, first + level, int(ids[lowest]), child.bit_count(), size[at],
                _members(stop & ended, ids), _members(stop & ~ended, ids),
            )
            if child != stop:
                stack.append((child ^ stop, level, k1, k2))
    names = [part.split()[0] for part in _LOCAL.split(", ")]
    return pa.table([pa.array(v, k) for v, k in zip(out, _KINDS, strict=True)], names=names)


# --- Merge and subtrees -------------------------------------------------------------


_SUMS = "k1 long, k2 long, saved long, n_leaves long, parent long"


def _add_up(table: pa.Table) -> pa.Table:
    """Subtree sums of one shard, from its deepest nodes to its top, and the owner of each node's parent."""
    columns = {c: table.column(c).to_pylist() for c in ("entry", "k1", "k2", "p1", "p2", "owner")}
    saved, leaves = (table.column(c).to_numpy().copy().tolist() for c in ("saved", "n_leaves"))
    row_of = {key: r for r, key in enumerate(zip(columns["k1"], columns["k2"], strict=True))}
    parents = [row_of.get(key) for key in zip(columns["p1"], columns["p2"], strict=True)]
    for r in np.argsort(-table.column("depth").to_numpy(), kind="stable").tolist():
        if (up := parents[r]) is not None:
            saved[up] += saved[r]
            leaves[up] += leaves[r]
    rows = [r for r, entry in enumerate(columns["entry"]) if not entry]
    owners = [None if parents[r] is None else columns["owner"][parents[r]] for r in rows]
    values = [[columns["k1"][r] for r in rows], [columns["k2"][r] for r in rows], [saved[r] for r in rows], [leaves[r] for r in rows], owners]
    return pa.table([pa.array(v, pa.int64()) for v in values], names=["k1", "k2", "saved", "n_leaves", "parent"])


def _same(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & (F.col(a) == F.col(b))
    return condition


def trie(turns: DataFrame, lengths: DataFrame, block_conversations: int = BLOCK_CONVERSATIONS, band_bits: int = BAND_BITS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and (k1, k2, conv_id) for each conversation at the node where it ends.

    Nodes have their key k1, k2; conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves and
    saved_bytes of the subtree: (n_convs - 1) times the bytes of the last text, for each node of it.
    """

    def walk(table: pa.Table) -> pa.Table:
        return walk_shard(table, band_bits)

    local = _bands(turns, lengths, block_conversations, band_bits).groupBy("block", "band").applyInArrow(walk, _LOCAL)
    local = stored(local, "trie-shards")
    real = local.where("NOT entry")
    merged = real.groupBy("k1", "k2").agg(
        F.min("least").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    merged = stored(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("_k1"), F.col("p2").alias("_k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, _same(("k1", "k2"), ("_k1", "_k2")), "left").select(
        "k1", "k2", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    nodes = stored(nodes, "trie-nodes")

    # What a conversation owns in later bands.
    leaf = (F.col("n_children") == 0).cast("long")
    band = F.shiftright("depth", band_bits)
    owned = nodes.groupBy(F.col("conv_id").alias("_c"), band.alias("_band")).agg(F.sum("saved").alias("_saved"), F.sum(leaf).alias("_leaves"))
    left_at = real.where(F.size("leaves") > 0).select("block", "band", "k1", "k2", F.explode("leaves").alias("conv_id"))
    later = left_at.select("conv_id").distinct().join(owned, F.col("conv_id") == F.col("_c"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, 0)
    later = later.select("conv_id", (F.col("_band") - 1).alias("_from"), F.sum("_saved").over(after).alias("_saved"), F.sum("_leaves").over(after).alias("_leaves"))
    # Bands that a conversation owns nothing of lie before those that it does: what it owns is the end of its path.
    first = later.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_from").alias("_first"), F.max_by("_saved", -F.col("_from")).alias("_all"), F.max_by("_leaves", -F.col("_from")).alias("_all_leaves"))
    named = later.select(F.col("conv_id").alias("_d"), "_from", "_saved", "_leaves")
    carried = left_at.join(first, F.col("conv_id") == F.col("_c")).join(named, _same(("conv_id", "band"), ("_d", "_from")), "left")
    early = F.col("band") < F.col("_first")
    carried = carried.groupBy(*[F.col(c).alias(f"_{c}") for c in ("block", "band", "k1", "k2")]).agg(
        F.sum(F.when(early, F.col("_all")).otherwise(F.coalesce("_saved", F.lit(0)))).alias("_later"),
        F.sum(F.when(early, F.col("_all_leaves")).otherwise(F.coalesce("_leaves", F.lit(0)))).alias("_later_leaves"),
    )

    known = nodes.select(F.col("k1").alias("_n1"), F.col("k2").alias("_n2"), F.col("conv_id").alias("owner"), F.col("saved").alias("_saved"), leaf.alias("_leaf"))
    slim = local.select("block", "band", "entry", "k1", "k2", "p1", "p2", "depth", "least").join(known, _same(("k1", "k2"), ("_n1", "_n2")))
    slim = slim.join(carried, _same(("block", "band", "k1", "k2"), ("_block", "_band", "_k1", "_k2")), "left")
    own = (F.col("least") == F.col("owner")) & ~F.col("entry")
    kept = lambda mine, later: (F.when(own, F.col(mine)).otherwise(F.lit(0)) + F.when(F.col("entry"), F.lit(0)).otherwise(F.coalesce(later, F.lit(0)))).cast("long")
    shards = slim.select("block", "band", "entry", "k1", "k2", "p1", "p2", "depth", "owner", kept("_saved", "_later").alias("saved"), kept("_leaf", "_later_leaves").alias("n_leaves"))
    sums = shards.groupBy("block", "band").applyInArrow(_add_up, _SUMS).groupBy(F.col("k1").alias("_s1"), F.col("k2").alias("_s2")).agg(
        F.sum("saved").alias("saved_bytes"), F.sum("n_leaves").alias("n_leaves"), F.max("parent").alias("parent_conv_id")
    )
    found = nodes.drop("saved").join(sums, _same(("k1", "k2"), ("_s1", "_s2"))).drop("_s1", "_s2")
    ends = real.where(F.size("ends") > 0).select("k1", "k2", F.explode("ends").alias("conv_id"))
    return found, ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: the digest of the ids that end at a node, in decimals, ascending, joined by commas.

    Ids are put together in pieces of neighbouring ids; the pieces of a node are hashed one after the other as a stream, so
    a node at which a large part of all conversations ends takes no more memory than others.
    """
    pieces = ends.groupBy("k1", "k2", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                if now == (k1, k2):
                    digest.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(text.encode())
            yield _digests(done)
        if now:
            yield _digests([(*now, digest.hexdigest())])

    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").mapInArrow(apply, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["k1", "k2", "ends_sha256"])


def described(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with the digest of their end lists; that of the empty text where nothing ends."""
    digests = ends_digest(ends).select(F.col("k1").alias("_e1"), F.col("k2").alias("_e2"), "ends_sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = nodes.join(digests, _same(("k1", "k2"), ("_e1", "_e2")), "left").drop("_e1", "_e2")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
