"""The trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runloom.llm import conversation_trie
from runloom.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, place string, band string, n string, k1 string, conv string"


def brute(rows, group, most):
    """The nodes of the rebuilt conversations as tuples."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = turns.get(c - c % group, [])[:h] + v[h:]
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    found = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = {p for p in below if len(p) == len(path) + 1}
        ended = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(path)))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        parent = min(members[path[:-1]]) if path else None
        found.append((min(convs), len(path), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(map(str, found))


def built(llm, rows, block=1024, bits=8, group=5, most=8):
    df = llm.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    turns = stored(conversation_trie.turns_of(df), "turns")
    rebuilt, lengths = conversation_trie.branched(turns, group, F.crc32(F.col("conv_id").cast("string")) % (most + 1), most)
    nodes, ends = conversation_trie.trie(stored(rebuilt, "rebuilt"), lengths, block, bits)
    found = conversation_trie.described(nodes, ends).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256")
    return sorted(str(tuple(r)) for r in found.collect())


def conversations(seed, count):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(4 * count), count):
        rows += [(c, turn, draw.choice(["user", "bot", None]), draw.choice(["", "a", "é", None, "long " * 50])) for turn in range(draw.randint(1, 9))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "bits"), [(1024, 8), (3, 1), (4, 2)])
def test_against_plain_python(llm, block, bits):
    rows = conversations(block, 40)
    rows += [(500, t, "user", "same") for t in range(14)] + [(501, t, "user", "same") for t in range(14)] + [(502, t, "user", "same") for t in range(12)]
    rows += [(600 + i, 0, "user", "hot") for i in range(12)]  # copies
    rows += [(700, None, "user", "first"), (700, -5000, "bot", "second"), (700, 9000, None, None)]
    rows += [(None, 0, "user", "no conversation"), (-7, 0, "user", "hot"), (1 << 50, 3, "user", "x" * 100_000)]
    assert built(llm, rows, block, bits) == brute(rows, 5, 8)


def test_repeated_rows_and_ties_are_turns(llm):
    rows = [(1, 0, "user", "a")] * 3 + [(2, None, "user", "a")] * 2
    got = built(llm, rows, most=0)
    assert got == brute(rows, 5, 0) and len(got) == 4


def test_nothing(llm):
    assert built(llm, []) == []
    assert built(llm, [(None, 1, "user", "a")]) == []


def test_end_lists_are_hashed_in_pieces(llm):
    ids = [*range(-3, 3), 4095, 4096, 4097, 10**12]
    ends = llm.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7)], "k1 long, k2 long, conv_id long")
    got = {r.k2: r.ends_sha256 for r in conversation_trie.ends_digest(ends).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"7").hexdigest()}
