"""Jaccard self-join of documents on sets of word n-grams, exact, down to connected components.

1. Sets: each text becomes a set of 64-bit hashes of its word n-grams. Documents with equal sets are one class
   from here on; copies cost nothing further.
2. Frequencies: the hashes of all classes are dealt out by value in packed blocks, so that each block
   counts in how many classes its hashes occur. Only hashes of two classes or more go back to their class.
3. Prefixes: two sets that reach the similarity share one of the rarest n - ceil(s * n) + 1 hashes of each. Hashes of
   one class alone come first in that order, so an unrelated document has no prefix left and drops out.
4. Stars: classes with the same least hash under a seed are likely similar. Each is compared with one centre of
   its groups, the one with the most similar signature, which joins near copies at linear cost; a few rounds of it.
5. Tiles: a tile holds the classes of a size band and of the band below that have one prefix hash in common. In tiles that
   still hold several components, all pairs of different components are compared, if their sizes and the bit
   counts of their signatures allow the similarity. This finds every link between components that the stars missed.
6. Every pair left is decided by intersecting the two sorted arrays.

A signature has a bit per hashed position, flipped by every hash that falls there; two signatures differ in at
most as many bits as the sets differ in hashes, so overlap <= (sizes - differing bits) / 2.

Hashes have 64 bits, of which 48 travel to a block and come back with the block's number.

Defined results: a text with fewer than n words is one n-gram of all its words; null texts and texts without words have an
empty set and are linked with nothing. A null doc_id is never the smallest unless a component has no other. Repeated rows are copies.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import WordHashes, lower_words, mixed, n_grams, sized, stored
from runloom.llm.components import components

NGRAM = 5
PERCENT = 75
#: Hashes per block while counting, and the least number of blocks.
BLOCK_HASHES, MIN_BLOCKS = 1_000_000, 64
SIGNATURE_WORDS = 16
STAR_ROUNDS, STAR_SEEDS = 3, 9
_SENT_HASHES = 500_000
_KEY = np.dtype("V16")


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = lower_words(text)
    if not words:
        return np.array([], np.uint64)
    return np.unique(n_grams(hashes.of(words), min(n, len(words))))


def class_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, class (null for an empty set)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), n, hashes) for t in batch.column(2)]
            sizes, keys = [len(f) for f in found], [class_key(f) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "text_key", "n_shingles", "class"])

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return slim.mapInArrow(apply, "doc_id long, text_key long, n_shingles long, class binary")


def _packed(block: np.ndarray, keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, columns: dict[str, np.ndarray], named: str) -> pa.RecordBatch:
    """One row per value of `block`: the owners' keys and sizes once each, how many entries each has, and the entries' columns."""
    order = np.lexsort((owner, block))
    block, owner = block[order], owner[order]
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.array([], int)
    ends = np.append(starts[1:], [len(block)] * min(1, len(block))).astype(int)
    out: dict[str, list] = {named: block[starts].tolist(), "keys": [], "sizes": [], "counts": []} | {c: [] for c in columns}
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        owners, counts = np.unique(owner[a:b], return_counts=True)
        out["keys"].append(keys[owners].tobytes())
        out["sizes"].append(sizes[owners].astype("<u4").tobytes())
        out["counts"].append(counts.astype("<u4").tobytes())
        for name, values in columns.items():
            out[name].append(values[order[a:b]].tobytes())
    kinds = {named: pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], names=list(out))


def _unpacked(table: pa.Table, columns: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Distinct keys, their sizes, the owner of each entry, and the entries' columns."""
    joined = {c: b"".join(x.as_py() for x in table.column(c)) for c in ("keys", "sizes", "counts", *columns)}
    keys, first, at = np.unique(np.frombuffer(joined["keys"], _KEY), return_index=True, return_inverse=True)
    sizes = np.frombuffer(joined["sizes"], "<u4")[first]
    owner = np.repeat(at, np.frombuffer(joined["counts"], "<u4"))
    return keys, sizes, owner, {c: np.frombuffer(joined[c], kind) for c, kind in columns.items()}


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _dealt(docs: DataFrame, n: int, blocks: int) -> DataFrame:
    """The hashes of each class in packed rows by block; 48 bits of a hash travel."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        held: list[np.ndarray] = []
        keys: list[bytes] = []

        def send() -> pa.RecordBatch:
            sizes = np.array([len(h) for h in held], np.int64)
            hashes = np.concatenate(held)
            short = np.ascontiguousarray((hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            return _packed(_block_of(hashes, blocks), np.frombuffer(b"".join(keys), _KEY), sizes, np.repeat(np.arange(len(held)), sizes), {"hashes": short}, "block")

        total = 0
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), n, words)
                key = class_key(found)
                # Copies within a task are sent once; the counts are of classes, so others do no harm.
                if not len(found) or key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                held.append(found)
                keys.append(key)
                total += len(found)
                if total >= _SENT_HASHES:
                    yield send()
                    held, keys, total = [], [], 0
        if held:
            yield send()

    schema = "block long, keys binary, sizes binary, counts binary, hashes binary"
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(apply, schema)


def _counted(parts: int):
    """Of one block: the hashes of two classes and more, packed for their classes."""

    def apply(table: pa.Table) -> pa.Table:
        keys, sizes, owner, columns = _unpacked(table, {"hashes": "u1"})
        wide = np.zeros((len(owner), 8), np.uint8)
        wide[:, 2:] = columns["hashes"].reshape(-1, 6)
        hashes = wide.view("<u8").ravel() | np.uint64(table.column("block")[0].as_py() & 0xFFFF)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
        hashes, owner = hashes[new], owner[new]
        values, counts = np.unique(hashes, return_counts=True)
        often = np.repeat(counts, counts)
        hashes, owner, often = hashes[often > 1], owner[often > 1], often[often > 1]
        # A step of the frequency, equal for all classes; it only orders the hashes.
        steps = np.minimum(255, 8 * np.log2(np.maximum(often, 1))).astype("u1")
        part = (keys.view("<u8").reshape(-1, 2)[:, 0] % np.uint64(parts)).astype(np.int64)[owner] if len(owner) else np.array([], np.int64)
        return pa.Table.from_batches([_packed(part, keys, sizes, owner, {"hashes": hashes, "steps": steps}, "part")])

    return apply


def signature(hashes: np.ndarray) -> np.ndarray:
    """SIGNATURE_WORDS 64-bit words; each hash flips one bit."""
    bits = np.bincount((mixed(hashes) % np.uint64(64 * SIGNATURE_WORDS)).astype(np.int64), minlength=64 * SIGNATURE_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(percent: int):
    """Per class that may have a partner: its shared hashes, sorted, its signature, its prefix and its least hash per seed."""
    seeds = mixed(np.arange(1, STAR_ROUNDS * STAR_SEEDS + 1, dtype=np.uint64))

    def apply(table: pa.Table) -> pa.Table:
        keys, sizes, owner, columns = _unpacked(table, {"hashes": "<u8", "steps": "u1"})
        order = np.lexsort((columns["hashes"], columns["steps"], owner))
        hashes = columns["hashes"][order]
        ends = np.cumsum(np.bincount(owner, minlength=len(keys)))
        out: dict[str, list] = {"class": [], "n": [], "shared": [], "sig": [], "prefix": [], "least": []}
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            own = hashes[(ends[k - 1] if k else 0) : end]
            # n - ceil(s * n) + 1 hashes, less those that only this class has and which come first.
            left = size - (percent * size + 99) // 100 + 1 - (size - len(own))
            if left > 0:
                out["class"].append(keys[k].tobytes())
                out["n"].append(size)
                out["shared"].append(np.sort(own).tobytes())
                out["sig"].append(signature(own))
                out["prefix"].append(own[:left].view("<i8"))
                out["least"].append(np.array([mixed(own ^ seed).min() for seed in seeds], "<u8").view("<i8"))
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return apply


def candidates(docs: DataFrame, total: int, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """class, n, shared, sig, prefix, least of the classes that share a prefix hash with another class."""
    blocks = max(MIN_BLOCKS, -(-total // BLOCK_HASHES))
    sized(docs, 8 * total)
    counted = _dealt(docs, n, blocks).groupBy("block").applyInArrow(_counted(blocks), "part long, keys binary, sizes binary, counts binary, hashes binary, steps binary")
    made = counted.groupBy("part").applyInArrow(_prefixes(percent), "class binary, n long, shared binary, sig array<long>, prefix array<long>, least array<long>")
    return stored(made, "join-sets")


def _band(n: Column, percent: int) -> Column:
    """Sizes that can reach the similarity lie in one band or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that reach the similarity, by intersecting their sorted hashes."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                common = len(np.intersect1d(np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8"), assume_unique=True))
                keep.append(100 * common >= percent * (na + nb - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(decide, "a binary, b binary")


def _with_component(classes: DataFrame, known: DataFrame | None, key: str = "class") -> DataFrame:
    if known is None:
        return classes.withColumn("comp", F.col(key))
    return classes.join(known, F.col(key) == F.col("node"), "left").withColumn("comp", F.coalesce("component", key)).drop("node", "component")


def _differ(left: str, right: str) -> Column:
    """Bits in which two signatures differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _star_pairs(sets: DataFrame, known: DataFrame | None, turn: int) -> DataFrame:
    """For each class one of another component.

    Classes with the same least hash under a seed form a group; its centre is a member of the component that has
    most members there. Of the centres that a class meets, the one whose signature differs least is taken.
    """
    least = F.explode(F.slice("least", turn * STAR_SEEDS + 1, STAR_SEEDS))
    signs = sets.select(F.col("class").alias("_c"), "sig")
    rows = _with_component(sets.select("class", least.alias("least")), known)
    members = rows.groupBy("least", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("class", "least"), "class")).alias("m"))
    centres = members.groupBy("least").agg(F.max(F.struct("n", "comp", F.col("m.class").alias("centre"))).alias("first"))
    centres = centres.select(F.col("least").alias("_l"), "first")
    met = rows.join(centres, F.col("least") == F.col("_l")).where(F.col("comp") != F.col("first.comp"))
    met = met.select("class", F.col("first.centre").alias("centre")).distinct()
    met = met.join(signs, F.col("class") == F.col("_c")).drop("_c").withColumnRenamed("sig", "own")
    met = met.join(signs, F.col("centre") == F.col("_c"))
    best = met.groupBy("class").agg(F.min(F.struct(_differ("own", "sig").alias("d"), "centre")).alias("best"))
    return best.select(F.col("class").alias("a"), F.col("best.centre").alias("b"))


def _tile_pairs(tokens: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a tile that sizes and signatures cannot exclude."""
    mixed_tiles = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("token").alias("_t"))
    open_rows = tokens.join(mixed_tiles, F.col("token") == F.col("_t")).drop("_t")
    signs = sets.select(F.col("class").alias("_c"), "n", F.octet_length("shared").alias("_bytes"), "sig")
    open_rows = stored(open_rows.join(signs, F.col("class") == F.col("_c")).drop("_c").withColumn("m", F.expr("_bytes div 8")).drop("_bytes"), "join-tiles")
    own = open_rows.select("token", F.col("band").alias("tile"), "band", *[F.col(c).alias(f"{c}_b") for c in ("class", "comp", "n", "m", "sig")])
    both = F.array("band", F.col("band") + 1)
    guests = open_rows.select("token", F.explode(both).alias("tile"), F.col("band").alias("band_a"), *[F.col(c).alias(f"{c}_a") for c in ("class", "comp", "n", "m", "sig")])
    met = guests.join(own, ["token", "tile"])
    most = (F.col("m_a") + F.col("m_b") - _differ("sig_a", "sig_b")) / 2
    fits = F.col("n_a") + F.col("n_b")
    met = met.where(
        (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("band_a") < F.col("band")) | (F.col("class_a") < F.col("class_b")))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (most * (100 + percent) >= fits * percent)
    )
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def linked_classes(sets: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame | None:
    """node (a class), component: the connected components among classes with a link to another; None without any."""
    bands = sets.select("class", _band(F.col("n"), percent).alias("band"), F.explode("prefix").alias("token"))
    found: DataFrame | None = None
    known: DataFrame | None = None
    for turn in range(star_rounds + 1):
        if turn < star_rounds:
            pairs = _star_pairs(sets, known, turn)
        else:
            pairs = _tile_pairs(_with_component(bands, known), sets, percent)
        edges = stored(links(stored(pairs, "join-pairs"), sets, percent), "join-edges")
        if edges.isEmpty():
            continue
        found = edges if found is None else found.union(edges)
        known = stored(components(found), "join-components")
    return known


def near_groups(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_key (a hash of the text)."""
    rows = stored(sets_of(docs, n), "join-rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    known = linked_classes(candidates(docs, total, n, percent), percent) if total else None
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_id"))
    placed = stored(_with_component(classes, known), "join-classes")
    smallest = stored(placed.groupBy("comp").agg(F.min("first_id").alias("component_id")), "join-smallest")
    ids = stored(placed.join(smallest, "comp").select(F.col("class").alias("_c"), F.col("component_id").alias("_id")), "join-ids")
    joined = rows.join(ids, F.col("class") == F.col("_c"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"), "text_key")


def keep_one(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Rows that repeat an id and its text count as one document. Documents with an empty set all stay, and so do the
    different texts of a group in which no row has an id.
    """
    groups = stored(near_groups(docs, n, percent), "join-groups")
    named = groups.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays"))
    gone = named.where("NOT stays").select("_id", "_key").distinct()
    often = named.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_key")
    rows = docs.select(
        F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_text")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    left = rows.join(gone, same, "left_anti")
    if often.isEmpty():
        return left.select("row.*")
    single, several = left.join(often, same, "left_anti"), left.join(often, same, "left_semi")
    return single.select("row.*").union(several.dropDuplicates(["_doc", "_text"]).select("row.*"))
