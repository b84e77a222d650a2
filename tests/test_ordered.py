import hashlib
import os
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runloom import operators as op
from runloom.operators import retention
from runloom.operators.logs import SERVICE_CLASSES
from runloom.operators.sinks import write_ledger
from runloom.session import remove
from runloom.sources import parse_log


def retention_by_hand(data, limit):
    """The rule, run by run."""
    size = defaultdict(int)
    for ptype, _, n in data:
        size[ptype] += n
    total = sum(size.values())
    gone = []
    if total <= limit:
        return gone
    for ptype in size:
        older = 0
        timed = [(f.split("-")[0], hashlib.sha256(f.encode()).hexdigest(), f, n) for p, f, n in data if p == ptype and f[:2] == "20"]
        for _, _, folder, n in sorted(timed):
            if older * total >= size[ptype] * (total - limit):
                break
            gone.append((ptype, folder, n))
            older += n
    return sorted(gone)


def plan(spark, data, limit):
    df = spark.createDataFrame(data, "ptype string, folder string, size_bytes bigint")
    return sorted(rows(op.retention_plan(df, limit)))


def test_retention_equals_the_rule(spark):
    random.seed(5)
    data = []
    for i in range(120):
        # many runs in one second, some in one hour, some without a time
        minute, second = random.choice([(0, 0), (0, 0), (7, random.randint(0, 3)), (random.randint(0, 59), 5)])
        stamp = random.choice(["20240101T03", "20240102T05"]) + f"{minute:02}{second:02}Z"
        folder = f"{stamp}-{i:08}-p" if i % 11 else f"tmp-{i}"
        data.append((random.choice(["train", "inference"]), folder, random.randint(0, 50)))
    total = sum(n for _, _, n in data)
    for limit in (0, total // 3, total // 2, total - 1, total, total + 1):
        assert plan(spark, data, limit) == retention_by_hand(data, limit)


def test_retention_edges(spark):
    a, b = ("train", "20240101T000000Z-00000001-p", 10), ("train", "20240102T000000Z-00000001-p", 10)
    assert plan(spark, [a, b], 20) == []
    assert plan(spark, [a, b], 19) == [a]
    assert plan(spark, [a, b], 10) == [a]
    assert plan(spark, [a, b], 9) == [a, b]
    assert plan(spark, [], 0) == []
    assert plan(spark, [("train", "tmp-1", 10)], 0) == []


def test_retention_is_a_pushed_filter(spark, tmp_path):
    data = [("train", f"2024010{i}T000000Z-00000001-p", 10) for i in range(1, 5)]
    ledger = spark.createDataFrame(data, "ptype string, folder string, size_bytes bigint")
    ledger.write.partitionBy("ptype").parquet(f"{tmp_path}/ledger")
    got = op.retention_plan(spark.read.parquet(f"{tmp_path}/ledger"), 20)
    assert rows(got, "folder") == [(data[0][1],), (data[1][1],)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "LessThan(folder,20240102T000001Z)" in plan.split("PushedFilters: [")[1].split("]")[0]


def appended(spark, ledger, stamps, size=10):
    """Runs of (type, start time), appended to the ledger; returns what retention sees of them."""
    schema = "ptype string, start_time string, name string, failed boolean, size_bytes bigint, n bigint"
    records = spark.createDataFrame([(p, stamp, "p", False, size, i) for i, (p, stamp) in enumerate(stamps)], schema)
    op.append_run(records, ledger, number=records["n"])
    return [(p, f"{stamp}-{i:08}-p", size) for i, (p, stamp) in enumerate(stamps)]


def files_of(ledger):
    found = {}
    for folder, _, names in os.walk(ledger):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_ino for n in names if n.endswith(".parquet")}
    return found


def ledger_rows(spark, ledger):
    return sorted(rows(op.read_ledger(spark, ledger), "ptype", "folder", "size_bytes"))


def without(data, gone):
    return sorted(set(data) - set(gone))


def months(first, count):
    return [(p, f"2024{first + k:02}0{d}T000000Z") for p in ("train", "inference") for k in range(count) for d in range(1, 4)]


def test_append_and_trim_in_turn(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    held = appended(spark, ledger, [*months(1, 4), ("train", "202401-odd")])
    for first, limit in ((5, 150), (7, 95)):
        before = files_of(ledger)
        gone = by_rule(held, limit)
        op.apply_retention(spark, ledger, limit)
        held = without(held, gone)
        assert ledger_rows(spark, ledger) == held
        after = files_of(ledger)
        # Only months that keep some of their runs are written anew; newer ones keep their files.
        partly = {(p, f[:6]) for p, f, _ in gone} & {(p, f[:6]) for p, f, _ in held}
        anew = {tuple(part.split("=")[1] for part in name.split("/")[-3:-1]) for name in set(after) - set(before)}
        assert anew == partly and gone
        assert {name: inode for name, inode in before.items() if name in after} == {n: i for n, i in after.items() if n in before}
        held = sorted(held + appended(spark, ledger, months(first, 2)))
        assert ledger_rows(spark, ledger) == held
    op.apply_retention(spark, ledger, 10**6)
    assert ledger_rows(spark, ledger) == held


def by_rule(data, limit):
    """The runs to go; names of no valid time count but stay."""
    size, gone = defaultdict(int), []
    for p, _, n in data:
        size[p] += n
    total = sum(size.values())
    for p in size:
        older = 0
        for f, n in sorted((f, n) for q, f, n in data if q == p and "odd" not in f):
            if total <= limit or older * total >= size[p] * (total - limit):
                break
            gone.append((p, f, n))
            older += n
    return sorted(gone)


@pytest.mark.parametrize("stop", ["decide", "overwrite", "remove"])
def test_a_stopped_trimming_ends_with_the_same_rows(spark, tmp_path, monkeypatch, stop):
    ledger = f"{tmp_path}/ledger"
    held = appended(spark, ledger, months(1, 4))
    gone = by_rule(held, 130)

    def fail(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        if stop == "decide":
            patched.setattr(retention, "finish_retention", lambda *a: None if not os.path.exists(f"{ledger}/_retention") else fail())
        elif stop == "overwrite":
            patched.setattr(retention, "write_ledger", lambda rows, path, mode: fail() if path == ledger else write_ledger(rows, path, mode))
        else:
            patched.setattr(retention, "remove", lambda spark, path: fail() if "month=" in path else remove(spark, path))
        with pytest.raises(RuntimeError):
            op.apply_retention(spark, ledger, 130)
    op.finish_retention(spark, ledger)
    assert ledger_rows(spark, ledger) == without(held, gone)
    assert not os.path.exists(f"{ledger}/_retention")


def test_a_decision_that_was_not_finished_changes_nothing(spark, tmp_path, monkeypatch):
    ledger = f"{tmp_path}/ledger"
    held = appended(spark, ledger, months(1, 2))
    os.makedirs(f"{ledger}/_retention/rows")
    op.finish_retention(spark, ledger)
    assert ledger_rows(spark, ledger) == sorted(held) and not os.path.exists(f"{ledger}/_retention")


def logs(spark, lines):
    data = [("f", i, text) for i, text in enumerate(lines)]
    return spark.createDataFrame(data, "file string, line_no bigint, text string")


def test_show_lines(spark):
    lines = logs(
        spark,
        [
            "[SHOW|2024-01-01 00:00:00,000|USER|a",
            "noise [SHOW|2024-01-01 00:00:00,500|USER|a",
            "[SHOW|2024-01-01 00:00:00,250|SYS|a",
            "[SHOW|2024-01-01 00:00:01,500|USER|b",
            "[SHOW|2024-01-01 00:00:01,500|USER|c",
            "[SHOW|2024-01-01 00:00:02,000|USERS|c",
            "[SHOW|2024-01-01 00:00:04,250|SYS|USER|both",
        ],
    )
    for size in (1, 2, 100):
        got = op.show_increments(lines, SERVICE_CLASSES, chunk=F.floor(F.col("line_no") / size))
        assert rows(got, "line_no", "class", "seconds") == [
            (0, "USER", 0.0),
            (2, "SYS", 0.0),
            (3, "USER", 1.5),
            (4, "USER", 0.0),
            (6, "USER", 2.75),
        ]
    other = op.show_increments(lines, {"SYS": "framework"})
    assert rows(other, "line_no", "class", "seconds") == [(2, "framework", 0.0), (6, "framework", 4.0)]


def line(level, message):
    return f"[2024-01-01 00:00:00,000|SYS|{level}|a.py(1)|f()] {message}"


def test_error_tail(spark):
    texts = [
        line("INFO", "start"),
        line("ERROR", "before any step"),
        line("INFO", "current step: load"),
        "Traceback",
        line("MSG", "saw [ERROR] there"),
        line("INFO", "current step: train"),
        line("ERROR", "bad"),
    ]
    parsed = parse_log(logs(spark, texts))
    for size in (1, 3, 100):
        tail = op.error_tail(parsed, chunk=F.floor(F.col("line_no") / size))
        assert rows(tail, "line_no", "is_error", "error_step") == [
            (1, True, ""),
            (2, False, None),
            (3, False, None),
            (4, True, "load"),
            (5, False, None),
            (6, True, "train"),
        ]
    assert op.error_tail(parse_log(logs(spark, [line("INFO", "x")]))).count() == 0


def test_first_requirement_wins(spark):
    data = [
        (1, 0, "pandas==2.0"),
        (1, 1, "# only a comment"),
        (1, 2, "   "),
        (1, 3, "numpy >= 1.0  # pinned <later>"),
        (1, 4, "torch --index-url u"),
        (1, 5, "torch --index-url u"),
        (2, 0, "pandas<3"),
        (2, 1, "scipy~=1.1"),
        (2, 2, "scipy"),
        (2, 3, "six --force-reinstall"),
        (2, 4, "torch --index-url u"),
        (2, 5, "yaml!=5"),
        (3, 0, "pandas"),
    ]
    df = spark.createDataFrame(data, "step_no int, pos int, line string")
    got = op.first_wins(df)
    assert rows(got.filter("section = 'package'"), "key", "step_no", "pos", "requirement") == [
        ("numpy", 1, 3, "numpy>=1.0"),
        ("pandas", 1, 0, "pandas==2.0"),
        ("scipy", 2, 1, "scipy~=1.1"),
        ("yaml", 2, 5, "yaml!=5"),
    ]
    assert rows(got.filter("section <> 'package'"), "section", "step_no", "pos", "requirement") == [
        ("force-reinstall", 2, 3, "six --force-reinstall"),
        ("link_install", 1, 4, "torch --index-url u"),
        ("link_install", 2, 4, "torch --index-url u"),
    ]


def test_stage_durations(spark):
    marks = [("r", s, f"2024-01-01 00:00:{t}") for s, t in zip(("start", "setup", "load", "run", "save"), ("00", "01.5", "03.0004", "03.0009", "10"))]
    df = spark.createDataFrame(marks + [("half", "start", "2024-01-01 00:00:00")], "run string, stage string, t string")
    got = op.stage_durations(df.withColumn("ts", F.col("t").cast("timestamp")))
    assert rows(got) == [("half", None, None, None, None, None), ("r", 1.5, 1.5, 0.001, 6.999, 10.0)]


def test_latest_key(spark):
    data = [("g", "a/1/model.tar.gz", 1), ("g", "a/2/model.tar.gz", 2), ("g", "a/9/other", 9), ("h", "b/other", 1)]
    df = spark.createDataFrame(data, "g string, path string, size int")
    assert rows(op.latest_by_key(df, "model.tar.gz", ["g"])) == [("g", "a/2/model.tar.gz", 2)]
    assert rows(op.latest_by_key(df, "model.tar.gz"), "path") == [("a/2/model.tar.gz",)]
    assert op.latest_by_key(df, "nothing").count() == 0


def test_ordered_operators_never_gather_a_key(spark, sf_dir):
    """One window over chunk rows per key, one over rows per key and chunk."""
    from workload.queries import QUERIES

    for name in ("d2_show_increments", "d3_error_tail", "c9_link_train_run"):
        plan_text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan_text.splitlines() if "Window [" in line]
        assert len(windows) == 2 and sum("_chunk" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows) == 2
