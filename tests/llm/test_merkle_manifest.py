"""The Merkle manifest against a plain tree, place by place."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runloom.llm import merkle_manifest
from runloom.llm.common import stored

SCHEMA = "doc_id long, text string, source string, g string, id string, at string, n string, leaf string, words string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and per node the siblings up to it with the places."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            proofs[k].append((run[: i % 16], run[i % 16 + 1 :]))
            at[k] = i // 16
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows, tampered=lambda row: row):
    """Tuples of doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        trees[g] = climb([digest(r) for r in groups[g]])
    root, above = climb([trees[g][0] for g in order])
    found = []
    for g, over in zip(order, above, strict=True):
        for row, proof in zip(groups[g], trees[g][1], strict=True):
            node = digest(tampered(row))
            for before, after in proof + over:
                node = sha("".join(before) + node + "".join(after))
            siblings = "".join("".join(b) + "".join(a) for b, a in proof + over)
            found.append((row[0], digest(row), trees[g][0], root, sha(siblings), node, node == root))
    return sorted(map(str, found))


def built(llm, rows, claimed="text"):
    df = llm.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    made = lambda text: merkle_manifest.leaf([F.col("doc_id"), F.expr(text), F.col("source")])
    slim = df.select(merkle_manifest.group_key(F.col("source")).alias("_g"), F.col("doc_id").alias("_id"), made("text").alias("_leaf"), made(claimed).alias("claimed"))
    slim = stored(slim.toDF("g", "id", "leaf", "claimed"), "leaves")
    found = merkle_manifest.verified(merkle_manifest.manifest(slim, {"claimed": "binary"}), "claimed")
    return sorted(str(tuple(r)) for r in found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("count", [1, 16, 17, 256, 257, 4097])
def test_one_group(llm, count):
    rows = [(i * 37 - 500, f"text {i}", "s") for i in range(count)]
    random.Random(count).shuffle(rows)
    assert built(llm, rows) == brute(rows)


def test_groups_nulls_and_repeats(llm):
    draw = random.Random(5)
    rows = [(draw.randrange(-(10**6), 10**12), f"é {i}" if i % 9 else None, draw.choice(["a", "b", "B", "é", "", None, *(f"s{k}" for k in range(40))])) for i in range(900)]
    rows += [(i, "dense", "dense") for i in range(70)] + [(7, f"again {i}", "dense") for i in range(40)] + [(7, "same", "dense")] * 5 + [(None, f"no id {i % 3}", "dense") for i in range(20)]
    rows += [((1 << 63) - 1, "last", "a"), (-(1 << 63), "first", "a"), (1, "x" * 200_000, None), (1, "", "only")]
    rows += [(9, f"hot {i}", "hot") for i in range(4500)]
    draw.shuffle(rows)
    lowered = lambda r: (r[0], r[1] and r[1].replace("d", "e"), r[2])
    assert built(llm, rows, "replace(text, 'd', 'e')") == brute(rows, lowered)


def test_no_rows(llm):
    assert built(llm, []) == []
