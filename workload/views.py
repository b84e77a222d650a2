"""Views of the given tables in the shapes the operators read.

Every view covers its whole table. The same rules stand as SQL in ``workload.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.constants import PLAN_KEYS, STAMP_FORMAT
from runloom.functions.hashing import short_id
from runloom.session import sized_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized_for(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text(column) -> F.Column:
    return column.cast("string")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order; even keys are train runs."""
    k = F.col("k")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("custkey"),
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("day"),
    )
    timed = orders.withColumn("end_ts", F.timestamp_add("SECOND", k % 86400, F.col("day"))).withColumn(
        "start_ts", F.timestamp_add("SECOND", -(1 + k % 3600), F.col("end_ts"))
    )
    name = F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("-"))
    start_time = F.date_format("start_ts", STAMP_FORMAT)
    run_id = F.concat_ws("-", start_time, F.lpad(text(k), 8, "0"), name)
    return timed.select(
        "k",
        F.when(k % 2 == 0, "train").otherwise("inference").alias("ptype"),
        name.alias("name"),
        run_id.alias("id"),
        F.concat(run_id, F.when(F.col("o_orderstatus") == "F", "-error").otherwise("")).alias("folder"),
        start_time.alias("start_time"),
        F.date_format("end_ts", STAMP_FORMAT).alias("end_time"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        short_id(F.sha2(text(F.col("custkey") % 50), 256)).alias("data_id"),
        short_id(F.sha2(F.concat(F.lit("p"), text(F.col("custkey") % 7)), 256)).alias("param_id"),
        short_id(F.md5("o_orderpriority")).alias("code_id"),
        F.floor(F.col("custkey") / 10).alias("plan_id"),
        (k % 10 != 0).alias("has_record"),
        (k % 7 != 0).alias("has_plan"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as the ledger holds them: sentinels where there is no record."""
    record = F.col("has_record")
    table_ = runs(spark, sf_dir)
    empty = {"id": "", "data_id": "", "param_id": "", "code_id": ""}
    empty |= {"start_time": "20000101T000000Z", "end_time": "20000101T000000Z"}
    return table_.withColumns({c: F.when(record, F.col(c)).otherwise(F.lit(v)) for c, v in empty.items()}).drop(
        "size_bytes", "name"
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary for every run with returned lines whose key is no multiple of 3."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_orderkey % 3 <> 0")
    n, f = F.col("n"), F.col("f")
    counted = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_linestatus") == "F").alias("f"),
        F.min("l_quantity").alias("score"),
        F.min("l_linestatus").alias("result"),
    )
    shares = F.map_filter(
        F.create_map(F.lit("F"), F.round(f / n, 6), F.lit("O"), F.round((n - f) / n, 6)), lambda _, share: share > 0
    )
    return counted.select(
        "k",
        F.lit("20240101").alias("date"),
        F.lit("").alias("file_path"),
        F.concat(F.lit("n"), text(n)).alias("note"),
        shares.alias("probability"),
        "result",
        "score",
        F.lit("1.0").alias("version"),
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = runs(spark, sf_dir).select("k", "folder")
    return scores(spark, sf_dir).join(keys, "k").drop("k")


def params(spark: SparkSession, sf_dir: str, part: str = "all") -> DataFrame:
    """Parameters from events; ``base`` and ``override`` split them by key."""
    events = table(spark, sf_dir, "events")
    if part == "base":
        events = events.filter("event_id % 3 <> 0")
    elif part == "override":
        events = events.filter("event_id % 3 = 0")
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    value = (
        F.when(e % 17 == 0, F.lit(None))
        .when(e % 11 == 0, "")
        .when(e % 13 == 0, F.concat(k, F.lit(", "), text(F.col("user_id"))))
        .otherwise(k)
    )
    keyed = events.select(
        F.col("user_id").alias("plan_id"),
        F.when(e % 2 == 0, "train").otherwise("inference").alias("pipeline"),
        F.col("event_type").alias("step"),
        F.concat(F.lit("k"), text(e % 4)).alias("name"),
        F.struct(e.alias("e"), value.alias("value")).alias("v"),
    )
    return (
        keyed.groupBy("plan_id", "pipeline", "step", "name")
        .agg(F.max_by("v", F.col("v.e")).alias("v"))
        .select("plan_id", "pipeline", "step", "name", "v.value")
    )


def plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per plan: the template with some left out, and one that is not allowed."""
    plan = F.col("c_custkey")
    kept = [F.when((plan + i) % 9 != 0, F.lit(key)) for i, key in enumerate(PLAN_KEYS)]
    extra = [F.when(plan % 8 == 0, F.lit("extra")), F.when(plan % 5 == 0, F.lit("ui_args_detail"))]
    return (
        table(spark, sf_dir, "customer")
        .select(plan.alias("plan_id"), F.explode(F.array(*kept, *extra)).alias("key"))
        .filter("key IS NOT NULL")
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control keys that the plans have, with a value of their own."""
    keys = plan_keys(spark, sf_dir)
    own = F.substring_index("key", ":", -1)
    is_control = F.col("key").startswith("control:")
    return keys.select(
        "plan_id",
        F.when(is_control, own).alias("key"),
        F.when(is_control, F.concat(F.lit("v"), text(F.col("plan_id") % 10))).alias("value"),
    )


def nested_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per conversation turn: a step with its arguments, none for the system."""
    turns = table(spark, sf_dir, "conversations")
    args = F.when(
        F.col("role") != "system",
        F.create_map(
            F.concat(F.lit("t"), text(F.col("turn"))),
            text(F.char_length("text")),
            F.concat(F.lit("u"), text(F.col("turn"))),
            F.lit("x"),
        ),
    )
    step = F.struct(F.col("role").alias("step"), args.alias("args"))
    return turns.select(
        F.col("conv_id").alias("plan_id"),
        F.when(F.col("turn") % 2 == 0, "train").otherwise("inference").alias("pipeline"),
        F.array(step, F.struct(F.lit("end").alias("step"), F.lit(None).cast("map<string,string>").alias("args"))).alias(
            "steps"
        ),
    )


FILE_EXTENSIONS = (".py", ".csv", ".png", ".jpg", ".svg", ".txt")


def files(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """One file per document."""
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(F.lpad(text(F.col("doc_id")), 8, "0"), ext)
    docs = table(spark, sf_dir, "documents")
    columns = [
        "doc_id",
        F.col("source").alias("base_dir"),
        F.col("lang").alias("step"),
        F.concat_ws("/", "source", "lang", name).alias("path"),
        F.col("n_chars").alias("size"),
    ]
    return docs.select(*columns, *([F.col("text").alias("content")] if content else []))


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as outputs of runs, three document ids per run."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return files(spark, sf_dir, content=False).join(labelled, "doc_id", "left_semi").withColumn(
        "run", F.floor(F.col("doc_id") / 3)
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines per user in event order."""
    e, kind = F.col("event_id"), F.col("event_type")
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    k = F.get_json_object("props", "$.k").cast("int")

    def line(level: str, source: str, func: str, message) -> F.Column:
        return F.concat(F.lit("["), t, F.lit(f"|SYS|{level}|{source}|{func}()] "), message)

    body = (
        F.when(kind == "view", line("INFO", "run.py(1)", "run", F.concat(F.lit("current step: s"), text(k % 5))))
        .when(kind == "click", F.concat(F.lit("[SHOW|"), t, F.lit("|USER|"), text(k)))
        .when(kind == "signup", F.concat(F.lit("[SHOW|"), t, F.lit("|SYS|"), text(k)))
        .when(kind == "error", line("ERROR", "load.py(2)", "load", F.lit("failed")))
        .otherwise(
            line("MSG", "save.py(3)", "save", F.when(e % 97 == 0, "ok [ERROR] seen").otherwise("ok"))
        )
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), e.alias("line_no"), body.alias("text")
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement lines per step; the steps are the part types in name order."""
    p, n = F.col("p_partkey"), text(F.col("p_size"))
    package = F.replace("p_name", F.lit(" "), F.lit("-"))
    forms = [
        F.concat(package, F.lit("=="), n),
        F.concat(package, F.lit(">="), n),
        F.concat(package, F.lit("<"), n),
        package,
        F.concat(package, F.lit(" == "), n),
        F.concat(package, F.lit("~="), n, F.lit("  # see <docs>")),
        F.concat(package, F.lit(" --force-reinstall")),
        F.concat(package, F.lit(" --index-url u"), text(F.col("p_size") % 5)),
    ]
    line = (
        F.when(p % 50 == 0, F.concat(F.lit("# "), package))
        .when(p % 51 == 0, F.lit(""))
        .otherwise(F.element_at(F.array(*forms), (p % 8 + 1).cast("int")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("step_no"), p.alias("pos"), line.alias("line"))


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External paths in all kinds from page addresses."""
    page = F.col("page_id")
    bare = F.regexp_replace("url", "^https?://", "")
    last = F.regexp_replace("url", r"^.*/([a-z]+)/.*$", "$1")
    forms = [
        F.concat(F.lit("s3://"), bare),
        F.concat(F.lit("/"), bare),
        F.concat(F.lit("a/b/"), bare),
        F.concat(F.lit("./"), last),
        F.concat(F.lit("~/"), last),
        last,
    ]
    return table(spark, sf_dir, "pages").select(
        page.alias("page_id"), F.element_at(F.array(*forms), (page % 6 + 1).cast("int")).alias("uri")
    )


def arg_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument specifications with some broken rules."""
    p, s = F.col("p_partkey"), F.col("p_size")
    kinds = ("string", "int", "float", "single_selection", "multi_selection")
    return table(spark, sf_dir, "part").select(
        p.alias("spec_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), s % 5 + 1).alias("type"),
        F.when(s % 5 < 3, F.lit(None))
        .when(p % 4 == 0, text(s))
        .otherwise(F.concat(text(s), F.lit(", "), text(s + 1)))
        .alias("selectable"),
        F.when(p % 6 == 0, "").when(p % 3 == 0, F.concat(text(s), F.lit(" ,b"))).otherwise(text(s)).alias("default"),
        F.when(s % 5 >= 3, F.lit(None))
        .when(p % 10 == 0, "1,2,3")
        .when(p % 14 == 0, "a,b")
        .when(p % 9 == 0, F.concat(F.lit("0.5, "), text(s)))
        .otherwise(F.concat(F.lit(" 1, "), text(s)))
        .alias("range"),
    )


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new, existing) names with versions."""
    suppliers, s = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    new = suppliers.select(
        F.when(s % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("new-"), "s_name")).alias("name"),
        (s % 4 < 2).alias("is_update"),
    )
    numbers = F.transform(F.sequence(F.lit(1), (s % 4 + 1).cast("int")), text)
    versions = F.when(s % 3 == 0, F.concat(numbers, F.array(F.lit("beta")))).otherwise(numbers)
    existing = suppliers.select(F.col("s_name").alias("name"), F.explode(versions).alias("version"))
    return new, existing


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in event order; the payload is cut short for some."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    value = F.when(e % 11 == 0, "").when(e % 13 == 0, F.concat(k, F.lit(", 7"))).otherwise(k)
    dataset = F.when(e % 41 == 0, "").otherwise(F.concat(F.lit("s3://lake/"), text(F.col("user_id") * 10 + e % 10)))
    section = F.struct(
        F.lit("inference").alias("type"),
        F.struct(
            F.array(
                F.struct(
                    F.col("event_type").alias("step"),
                    F.create_map(F.concat(F.lit("k"), text(e % 4)), value).alias("args"),
                )
            ).alias("selected_user_parameters")
        ).alias("parameters"),
        dataset.alias("dataset_uri"),
    )
    payload = F.to_json(F.struct(F.struct(F.array(section).alias("pipeline")).alias("solution_metadata")))
    return table(spark, sf_dir, "events").select(
        e.alias("request_id"),
        e.alias("seq"),
        F.col("user_id").alias("plan_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(e % 50 == 0, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"),
    )


STATUSES = {"view": "waiting", "click": "setup", "signup": "load", "error": "run", "purchase": "save"}


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, progress state and error code per event; two codes are unknown."""
    e = F.col("event_id")
    status = F.element_at(F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair]), F.col("event_type"))
    states = F.array(F.lit("init"), F.lit("summary"), F.lit("artifacts"))
    codes = ("E111", "E112", "E121", "E122", "E131", "E132", "E141", "E151", "E152", "E161", "E162", "E998", "E999")
    return table(spark, sf_dir, "events").select(
        e.alias("request_id"),
        F.col("user_id").alias("run"),
        e.alias("seq"),
        status.alias("status"),
        F.element_at(states, (e % 3 + 1).cast("int")).alias("state"),
        F.element_at(F.array(*[F.lit(c) for c in codes]), (e % 13 + 1).cast("int")).alias("code"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage marks: five events in a row are one run."""
    stages = F.array(*[F.lit(s) for s in ("start", "setup", "load", "run", "save")])
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 5).alias("run"),
        F.element_at(stages, (F.col("event_id") % 5 + 1).cast("int")).alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of features per dataset: the orders of a customer."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.floor("o_totalprice")).cast("bigint").alias("amount"))
        .select(F.concat(F.lit("s3://lake/"), text(F.col("o_custkey"))).alias("dataset_uri"), "n_rows", "amount")
    )
