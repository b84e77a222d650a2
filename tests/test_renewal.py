"""Ids of stored datasets after changes equal those from scratch, and untouched leaves are not read."""

import os
import random

from conftest import rows
from pyspark.sql import functions as F

from runloom import operators as op

SCHEMA = "base string, path string, hash64 bigint"


def frame(spark, files):
    return spark.createDataFrame([(b, p, h) for (b, p), h in files.items()], SCHEMA)


def test_renewed_ids_equal_those_from_scratch(spark, tmp_path):
    draw = random.Random(1)
    for by in ([], ["base"]):
        files = {(b, f"{b}/f{n}"): draw.randrange(1 << 62) for b in ("x", "y") for n in range(150)}
        root = op.store_dataset(frame(spark, files), f"{tmp_path}/d{len(by)}", by)
        assert rows(op.stored_id(spark, root, by)) == rows(op.dataset_id(frame(spark, files), by))
        for _ in range(2):
            changes = {key: draw.randrange(1 << 62) for key in draw.sample(sorted(files), 8)}
            changes |= {key: None for key in draw.sample(sorted(files), 30)}
            changes |= {("x", f"x/new{draw.randrange(10**6)}"): 7, ("z", f"z/new{draw.randrange(10**6)}"): 8}
            files = {key: h for key, h in (files | changes).items() if h is not None}
            for _ in range(2):  # again the same
                op.renew_dataset(frame(spark, changes), root, by)
                assert rows(op.stored_id(spark, root, by)) == rows(op.dataset_id(frame(spark, files), by))


def test_untouched_leaves_are_not_read(spark, tmp_path):
    files = {("x", f"f{n}"): n for n in range(400)}
    root = op.store_dataset(frame(spark, files), f"{tmp_path}/d")
    before = {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for folder, _, names in os.walk(root) for n in names if n.endswith(".parquet")}
    part = spark.range(1).select(F.substring(F.md5(F.lit("f7")), 1, 2)).first()[0]
    # Files that cannot be read show that nothing else is.
    for name in before:
        if f"part={part}" not in name and "/files/" in name and name != min(n for n in before if "/files/" in n):
            with open(name, "wb") as file:
                file.write(b"not to be read")
            crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
            if os.path.exists(crc):
                os.unlink(crc)
    op.renew_dataset(frame(spark, {("x", "f7"): 1000}), root)
    assert rows(op.stored_id(spark, root)) == rows(op.dataset_id(frame(spark, files | {("x", "f7"): 1000})))
    after = {f"{folder}/{n}" for folder, _, names in os.walk(root) for n in names if n.endswith(".parquet")}
    assert {n for n in before if n not in after} == {n for n in before if f"part={part}" in n}


def test_no_changes(spark, tmp_path):
    root = op.store_dataset(frame(spark, {("x", "a"): 1}), f"{tmp_path}/d")
    op.renew_dataset(frame(spark, {}), root)
    op.renew_dataset(frame(spark, {("x", "a"): None, ("x", "never"): None}), root)
    op.renew_dataset(frame(spark, {("x", "b"): 2}), root)
    assert rows(op.stored_id(spark, root)) == rows(op.dataset_id(frame(spark, {("x", "b"): 2})))
