"""A Merkle manifest of a dataset: one leaf per row, one tree per group, one root, and a proof for every row.

1. Leaves: the SHA-256 of a row's fields, each written with its length in front, so that no two rows write the same.
2. Index: per group a compressed bitmap of the ids. Words of 64 ids that hold one are merged by a bitwise or; the words of a
   container (32,768 ids) lie in one row with the number of rows before each of them, containers with the number of rows
   before them in their group. The place of a leaf is a rank query: rows before the container, before the word, and the
   popcount of the lower bits. The rows themselves are never sorted.
3. Levels: a block of 16 ** 3 neighbouring nodes is an array of slots that its nodes fill by their place; three levels are
   reduced in it, and its top is a node of the next pass. A pass so divides the nodes by 4,096.
4. Groups: what remains of each group is a leaf of the tree over the groups, in their order.
5. Proofs go the other way: the siblings above a block, one row per block, meet the block's nodes again, and each
   node gets its own ones in front of them.

Blocks are dealt out by a hash, several to a bin, so that many small groups cost no more than few large ones.

Defined results: a null group is a group of its own, before all others; groups go by the bytes of their UTF-8. Rows without id come first in
their group; rows of equal id go by the bytes of their leaf, however many they are, and equal leaves are exchangeable. Null fields
are written as `-`. A lone node is its own root. An empty table has no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import stored

FANOUT, BLOCK_LEVELS = 16, 3
BLOCK = FANOUT**BLOCK_LEVELS
#: Nodes of a bin, about; ids of a word and words of a container, as powers of two.
BIN_NODES = 8192
WORD_BITS, CONTAINER_BITS = 6, 9
#: Rows of one cell where many rows share an id.
CELL_ROWS = 4096


# --- Leaves -------------------------------------------------------------------------


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields as 32 bytes."""
    texts = [field.cast("string") for field in fields]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*written), 256))


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- Places by rank -----------------------------------------------------------------


def containers(rows: DataFrame) -> DataFrame:
    """g, container, words (word, bits, before: the rows before it in the container), before: the rows of the group before the container."""
    word = F.shiftright("id", WORD_BITS)
    bit = F.expr(f"shiftleft(1L, CAST(id & {(1 << WORD_BITS) - 1} AS INT))")
    words = rows.where("id IS NOT NULL").groupBy("g", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = words.withColumn("container", F.shiftright("word", CONTAINER_BITS))
    inside = Window.partitionBy("g", "container").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    merged = words.groupBy("g", "container").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "before"))).alias("words"),
        F.sum("n").alias("n"),
        F.max(F.col("n") > F.bit_count("bits")).alias("repeats"),
    )
    earlier = Window.partitionBy("g").orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _ties(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Add `tie`, the place of a row among those of its group and id, for rows of repeated ids only.

    They are cut into cells by the first bytes of the leaf, and only the cells' counts are summed up in order.
    """
    many = repeated.select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.ceil(F.col("n") / CELL_ROWS).alias("_cells"))
    same = (F.col("g") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_id"))
    front = F.conv(F.hex(F.substring("leaf", 1, 4)), 16, 10).cast("long")
    cut = rows.join(many, same).withColumn("cell", F.shiftright(front * F.col("_cells"), 32)).drop("_g", "_id", "_cells")
    sizes = cut.groupBy(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g", "_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("g", "id", "cell").orderBy("leaf", *[c for c in rows.columns if c not in ("g", "id", "leaf")])
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, same & (F.col("cell") == F.col("_cell")))
    return joined.withColumn("tie", F.col("_start") + F.col("_at")).select(*rows.columns, "tie")


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (g, id, leaf, ...) with `at`, their place in the group from 0, and `n`, the rows of the group; and the largest n."""
    index = stored(containers(rows), "merkle-index")
    nameless = rows.where("id IS NULL").groupBy("g").agg(F.count(F.lit(1)).alias("nulls"))
    named = index.groupBy("g").agg(F.sum("n").alias("n"), F.max("repeats").alias("repeats"))
    sizes = named.join(nameless, "g", "full_outer").select(
        F.col("g").alias("_g"), F.coalesce("nulls", F.lit(0)).alias("nulls"), (F.coalesce("n", F.lit(0)) + F.coalesce("nulls", F.lit(0))).alias("n"), "repeats"
    )
    sizes = stored(sizes, "merkle-sizes")
    most, repeats, nulls = sizes.agg(F.max("n"), F.max("repeats"), F.max("nulls")).first()

    word, low = F.shiftright("id", WORD_BITS), F.expr(f"CAST(id & {(1 << WORD_BITS) - 1} AS INT)")
    if repeats or nulls:
        repeated = stored(rows.groupBy("g", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL"), "merkle-repeats")
        lone = rows.join(repeated.select(F.col("g").alias("_g"), F.col("id").alias("_id")), (F.col("g") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
        rows = lone.withColumn("tie", F.lit(0).cast("long")).union(_ties(rows, repeated))
        # At most 64 ids of a word are repeated.
        further = repeated.where("id IS NOT NULL").groupBy(F.col("g").alias("_rg"), word.alias("_rword")).agg(F.collect_list(F.struct("id", (F.col("n") - 1).alias("more"))).alias("further"))
        rows = rows.join(further, (F.col("g") == F.col("_rg")) & (word == F.col("_rword")), "left").drop("_rg", "_rword")
        lower = F.filter(F.coalesce("further", F.array().cast("array<struct<id:bigint,more:bigint>>")), lambda x: x["id"] < F.col("id"))
        extra = F.col("tie") + F.aggregate(lower, F.lit(0).cast("long"), lambda total, x: total + x["more"])
    else:
        extra = F.lit(0).cast("long")

    directory = index.select(F.col("g").alias("_ig"), F.col("container").alias("_container"), "words", F.col("before").alias("_before"))
    container = F.shiftright("id", WORD_BITS + CONTAINER_BITS)
    met = rows.join(directory, (F.col("g") == F.col("_ig")) & (container == F.col("_container")), "left")
    hit = F.try_element_at("words", F.nullif(F.array_position(F.col("words.word"), word), F.lit(0)).cast("int"))
    lower_bits = F.bit_count(hit["bits"].bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))))
    rank = F.when(F.col("id").isNull(), extra).otherwise(F.col("_before") + hit["before"] + lower_bits + extra)
    kept = [c for c in rows.columns if c not in ("tie", "further")]
    found = met.select(*kept, rank.alias("_rank"))
    with_size = found.join(sizes.drop("repeats"), F.col("g") == F.col("_g"))
    at = F.col("_rank") + F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("nulls"))
    return with_size.select(*kept, at.cast("long").alias("at"), "n"), most or 0


def in_order(groups: DataFrame) -> tuple[DataFrame, int]:
    """The rows with `at`, their place in the order of g, and their number `n`; numbered within sorted partitions."""
    parted = groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("part", F.spark_partition_id())
    parted = stored(parted, "merkle-groups")
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    total = parted.count()
    inside = Window.partitionBy("part").orderBy("g")
    numbered = parted.withColumn("_at", F.row_number().over(inside) - 1).join(starts, F.col("part") == F.col("_part"))
    at = (F.col("_start") + F.col("_at")).cast("long").alias("at")
    return numbered.select(*groups.columns, at, F.lit(total).cast("long").alias("n")), total


# --- Levels -------------------------------------------------------------------------


def parent(run: Sequence[bytes]) -> bytes:
    """The digest of a run of digests, written as hex text one after the other."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def levels_of(slots: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of one block, from its nodes to its top; n: the nodes of the group. Only a group that is one block ends early."""
    levels = [slots]
    while len(levels) <= BLOCK_LEVELS and (n > BLOCK or len(levels[-1]) > 1):
        levels.append([parent(levels[-1][k : k + FANOUT]) for k in range(0, len(levels[-1]), FANOUT)])
    return levels


def _blocks(table: pa.Table, digest: str) -> Iterator[tuple[tuple[str, int], int, list[int], list[bytes]]]:
    """(g, block), n, rows by slot and digests by slot of each block in a bin."""
    columns = [table.column(c).to_pylist() for c in ("g", "at", "n")]
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    sizes = {}
    for row, (g, at, n) in enumerate(zip(*columns, strict=True)):
        found.setdefault((g, at // BLOCK), []).append((at % BLOCK, row))
        sizes[g] = n
    nodes = table.column(digest).to_pylist()
    for key, members in found.items():
        rows = [0] * len(members)
        for slot, row in members:
            rows[slot] = row
        yield key, sizes[key[0]], rows, [nodes[row] for row in rows]


def _bin(block: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64("g", block), F.lit(bins)).alias("bin")


def _reduced(nodes: DataFrame, bins: int) -> DataFrame:
    """One pass: g, at, n, leaf (a digest) of the blocks."""

    def apply(table: pa.Table) -> pa.Table:
        rows = [(g, block, -(-n // BLOCK), levels_of(slots, n)[-1][0]) for (g, block), n, _, slots in _blocks(table, "leaf")]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "at", "n", "leaf"])

    dealt = nodes.select("g", "at", "n", "leaf", _bin(F.floor(F.col("at") / BLOCK), bins))
    return dealt.groupBy("bin").applyInArrow(apply, "g string, at long, n long, leaf binary")


def passes(nodes: DataFrame, most: int, total: int) -> list[DataFrame]:
    """The nodes of each pass, the first ones included; the last table has one row per group."""
    found = [nodes]
    while len(found) == 1 or most > 1:
        found.append(stored(_reduced(found[-1], max(1, total // BIN_NODES)), "merkle-pass"))
        most, total = -(-most // BLOCK), max(1, total // BLOCK)
    return found


# --- Proofs -------------------------------------------------------------------------


_PROOF = "places binary, runs binary, siblings binary"


def _proved(nodes: DataFrame, above: DataFrame, bins: int, carried: Sequence[str], schema: str) -> DataFrame:
    """Each node with the proof of its block behind its own. above: g, at (the block), places, runs, siblings, subroot."""
    kept = ["g", "at", *carried]
    names = [*kept, "places", "runs", "siblings", "subroot"]

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        over = {(r["g"], r["at"]): r for r in right.to_pylist()}
        rows_out, places_out, runs_out, siblings_out, subroots = [], [], [], [], []
        for key, n, rows, slots in _blocks(left, "leaf"):
            levels, top = levels_of(slots, n), over[key]
            joined = [[b"".join(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)] for level in levels[:-1]]
            for slot, row in enumerate(rows):
                places, runs, siblings = [], [], []
                for runs_here in joined:
                    run, place = runs_here[slot // FANOUT], slot % FANOUT
                    places.append(place)
                    runs.append(len(run) // 32)
                    siblings += (run[: 32 * place], run[32 * place + 32 :])
                    slot //= FANOUT
                rows_out.append(row)
                places_out.append(bytes(places) + top["places"])
                runs_out.append(bytes(runs) + top["runs"])
                siblings_out.append(b"".join(siblings) + top["siblings"])
                subroots.append(top["subroot"])
        own = left.select(kept).take(pa.array(rows_out, pa.int64()))
        made = [pa.array(v, pa.binary()) for v in (places_out, runs_out, siblings_out, subroots)]
        return pa.table([*own.columns, *made], names=names)

    left = nodes.select(*kept, *[c for c in ("n", "leaf") if c not in kept], _bin(F.floor(F.col("at") / BLOCK), bins))
    right = above.select("*", _bin(F.col("at"), bins))
    return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(apply, f"g string, at long, {schema}{_PROOF}, subroot binary")


def _down(found: list[DataFrame], above: DataFrame, total: int, carried: Sequence[str] = (), schema: str = "") -> DataFrame:
    """Proofs of the first nodes from those of the last ones."""
    for k in range(len(found) - 2, 0, -1):
        above = stored(_proved(found[k], above, max(1, total // BLOCK**k // BIN_NODES), (), ""), "merkle-proofs")
    return _proved(found[0], above, max(1, total // BIN_NODES), carried, schema)


def manifest(rows: DataFrame, carried: dict[str, str] | None = None) -> DataFrame:
    """Proofs of all rows (g, id, leaf and the carried columns, given with their types).

    g, at, id, leaf, the carried columns; places and runs (a byte per level: the place in the run, the size of the
    run), siblings (the run's other digests, 32 bytes each, level by level up to the root), subroot, root.
    """
    carried = carried or {}
    nodes, most = placed(rows)
    nodes, total = stored(nodes, "merkle-leaves"), rows.count()
    found = passes(nodes, most, total)
    groups, n_groups = in_order(found[-1].select("g", "leaf"))
    # The tree over the groups is a group of its own; the names go along as carried columns.
    tops = stored(groups.select(F.lit("").alias("g"), "at", "n", "leaf", F.col("g").alias("name")), "merkle-subroots")
    upper = passes(tops, n_groups, n_groups)
    root = upper[-1].first()
    nothing = F.lit(b"").cast("binary")
    above = upper[-1].select("g", "at", *[nothing.alias(c) for c in ("places", "runs", "siblings")], nothing.alias("subroot"))
    over_groups = _down(upper, above, n_groups, ["name", "leaf"], "name string, leaf binary, ")
    over_groups = stored(over_groups.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), "places", "runs", "siblings", F.col("leaf").alias("subroot")), "merkle-group-proofs")
    schema = "id long, leaf binary, " + "".join(f"`{name}` {kind}, " for name, kind in carried.items())
    proofs = _down(found, over_groups, total, ["id", "leaf", *carried], schema)
    return proofs.withColumn("root", F.lit(bytes(root["leaf"]) if root else b"").cast("binary"))


def fold(node: bytes, places: bytes, runs: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for place, run in zip(places, runs, strict=True):
        others = siblings[at : at + 32 * (run - 1)]
        node = parent([others[: 32 * place], node, others[32 * place :]])
        at += len(others)
    return node


def verified(proofs: DataFrame, claimed: str = "leaf") -> DataFrame:
    """The proofs' rows with folded_root, from the claimed leaf, verified, and proof_sha256, all digests as hex text; siblings are left out."""
    columns = ["g", "id", "leaf", "subroot", "root"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c).to_pylist() for c in ("claimed", "places", "runs", "siblings", "root")]
            folded, proofs, sound = [], [], []
            for node, places, runs, siblings, root in zip(*parts, strict=True):
                end = fold(node, places, runs, siblings)
                folded.append(end.hex())
                proofs.append(hashlib.sha256(siblings.hex().encode()).hexdigest())
                sound.append(end == root)
            named = [pa.array([d.hex() for d in batch.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot", "root")]
            made = [batch.column("g"), batch.column("id"), *named, pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(sound, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=[*columns, "proof_sha256", "folded_root", "verified"])

    slim = proofs.select(*columns, F.col(claimed).alias("claimed"), "places", "runs", "siblings")
    return slim.mapInArrow(apply, "g string, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
