import hashlib

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.functions.hashing import content_hash64, ordered_digest
from runloom.functions.ordered import carry_forward
from runloom.functions.text import as_float, as_int, base_name, comma_list, extension, value_kind
from runloom.functions.times import display_stamp, folder_stamp


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_content_hash_is_unsigned(spark):
    for content in ("", "a", "Ünïcode", "x" * 10_000):
        wanted = int(hashlib.sha256(content.encode()).hexdigest(), 16) & ((1 << 64) - 1)
        assert int(one(spark, content_hash64(F.col("x")), content)) == wanted


def tree(texts, algorithm="sha256"):
    """The digest of (key, text) pairs: leaves by 4 hex digits of the key's MD5, nodes by 2, the root."""
    digest = lambda parts: hashlib.new(algorithm, "".join(parts).encode()).hexdigest()
    leaves, nodes = {}, {}
    for key, text in sorted(texts):
        leaves.setdefault(hashlib.md5(str(key).encode()).hexdigest()[:4], []).append(text)
    for leaf in sorted(leaves):
        nodes.setdefault(leaf[:2], []).append(digest(leaves[leaf]))
    return digest(digest(nodes[node]) for node in sorted(nodes))


def test_digest_is_that_of_the_tree(spark):
    data = [("g", i, f"t{i}") for i in range(20)] + [("h", 1, "z")]
    df = spark.createDataFrame(data, "g string, i int, t string")
    got = dict(rows(ordered_digest(df, ["g"], ["i"], F.col("t")), "g", "digest"))
    assert got["g"] == tree([(i, f"t{i}") for i in range(20)])
    assert got["h"] == tree([(1, "z")])
    whole = ordered_digest(df.filter("g = 'g'"), [], ["i"], F.col("t"), "md5")
    assert rows(whole, "digest", "n_rows") == [(tree([(i, f"t{i}") for i in range(20)], "md5"), 20)]


def test_large_groups_have_the_same_tree(spark):
    """So many rows that leaves hold several; nothing depends on partitions or the order of the rows."""
    wanted = tree([(i, f"t{i}") for i in range(100_000)])
    for parts in (1, 5):
        df = spark.range(100_000, numPartitions=parts).select(F.col("id").alias("i"), F.concat(F.lit("t"), "id").alias("t"))
        df = df.orderBy(F.xxhash64("i", F.lit(parts)))
        assert rows(ordered_digest(df, [], ["i"], F.col("t")), "digest", "n_rows") == [(wanted, 100_000)]
    plan = ordered_digest(df, [], ["i"], F.col("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    assert ordered_digest(df.limit(0), [], ["i"], F.col("t")).count() == 0


def expected_carry(data, inclusive):
    out = []
    for key in {k for k, _, _ in data}:
        last = None
        for _, place, value in sorted((r for r in data if r[0] == key), key=lambda r: r[1]):
            if inclusive and value is not None:
                last = value
            out.append((key, place, last))
            if value is not None:
                last = value
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))),
        min_size=1,
        max_size=40,
        unique_by=lambda r: (r[0], r[1]),
    ),
    st.booleans(),
    st.sampled_from([1, 4, 100]),
)
def test_carry_forward_equals_a_plain_scan(spark, data, inclusive, size):
    df = spark.createDataFrame(data, "k string, place int, v int")
    chunk = F.floor(F.col("place") / size)
    got = carry_forward(df, ["k"], ["place"], chunk, {"last": F.col("v")}, inclusive=inclusive)
    assert rows(got, "k", "place", "last") == expected_carry(data, inclusive)


def test_carry_forward_starts_from_given_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 9, 5), ("b", 2, None)], "k string, place int, v int")
    start = spark.createDataFrame([("a", 3)], "k string, last int")
    got = carry_forward(df, ["k"], ["place"], F.floor(F.col("place") / 4), {"last": F.col("v")}, start=start)
    assert rows(got, "k", "place", "last") == [("a", 1, 3), ("a", 9, 5), ("b", 2, None)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("7", "int"),
        (" 7 ", "int"),
        ("-3", "int"),
        ("1.5", "float"),
        ("1e3", "float"),
        (".5", "float"),
        ("5.", "float"),
        ("1_0", "string"),
        ("inf", "string"),
        ("nan", "string"),
        ("True", "bool"),
        ("true", "string"),
        ("", "string"),
        ("99999999999999999999", "float"),
        (None, None),
    ],
)
def test_value_kind(spark, text, kind):
    assert one(spark, value_kind(F.col("x")), text) == kind


def test_numbers(spark):
    assert one(spark, as_int(F.col("x")), " 12 ") == 12
    assert one(spark, as_int(F.col("x")), "1.5") is None
    assert one(spark, as_float(F.col("x")), "1e3") == 1000.0
    assert one(spark, as_float(F.col("x")), "inf") is None


@pytest.mark.parametrize(
    ("name", "ext"), [("a.csv", ".csv"), ("a.tar.gz", ".gz"), (".bashrc", ""), ("a", ""), ("a.", "."), ("d.x/a", ""), ("..a", "")]
)
def test_extension(spark, name, ext):
    assert one(spark, extension(F.col("x")), name) == ext


@pytest.mark.parametrize(
    ("path", "name"),
    [("/a/b/", "b"), ("/a//b/.", "b"), ("a/b/..", "a"), ("./x", "x"), ("s3://bucket/key/", "key"), ("/", ""), ("../../x", "x")],
)
def test_base_name(spark, path, name):
    assert one(spark, base_name(F.col("x")), path) == name


def test_comma_list(spark):
    assert one(spark, comma_list(F.col("x")), "a, b ,") == ["a", "b", ""]


def test_stamps(spark):
    assert one(spark, display_stamp(F.col("x")), "20240131T235959Z") == "2024-01-31 23:59:59"
    assert one(spark, display_stamp(F.col("x")), "no time") is None
    assert one(spark, folder_stamp(F.col("x")).isNull(), "tmp-1") is True
