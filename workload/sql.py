"""The queries as SQL over the given tables."""

from __future__ import annotations

from runloom.constants import ERROR_CODES, PLAN_KEYS, CONTROL_DEFAULTS
from workload.queries import RETENTION_HALF, RETENTION_LIMIT, id_of
from workload.views import STATUSES


def rows(values) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in values)


def low64(hex_text: str) -> str:
    return f"(('0x' || right({hex_text}, 16))::UBIGINT)::VARCHAR"


K_TEXT = "json_extract_string(props, '$.k')"
LOG_T = "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')"
STAMP = "'%Y%m%dT%H%M%SZ'"
SHOWN = "'%Y-%m-%d %H:%M:%S'"


def params_view(name: str, condition: str) -> str:
    return f"""{name} AS (
      SELECT user_id AS plan_id, pipeline, step, name, arg_max(v, event_id).value AS value FROM (
        SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'inference' END AS pipeline,
          event_type AS step, 'k' || (event_id % 4) AS name,
          {{'value': CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ''
            WHEN event_id % 13 = 0 THEN {K_TEXT} || ', ' || user_id ELSE {K_TEXT} END}} AS v
        FROM events WHERE {condition}) GROUP BY ALL)"""


def tree(source: str, by: list[str], order: list[str], text: str, algorithm: str = "sha256") -> str:
    """(by, digest, n_rows): digests of leaves by 4 hex digits of the key's MD5, of nodes by 2, of the root."""
    group = "".join(f"{name}, " for name in by)
    whole = f"GROUP BY {', '.join(by)}" if by else "HAVING sum(n) > 0"
    key = f"md5(concat_ws('.', {', '.join(order)}))"
    return f"""SELECT {group}{algorithm}(string_agg(d, '' ORDER BY node)) AS digest, sum(n)::BIGINT AS n_rows FROM (
        SELECT {group}left(leaf, 2) AS node, {algorithm}(string_agg(d, '' ORDER BY leaf)) AS d, sum(n) AS n FROM (
          SELECT {group}left({key}, 4) AS leaf, {algorithm}(string_agg({text}, '' ORDER BY {', '.join(order)})) AS d, count(*) AS n
          FROM {source} GROUP BY {group}leaf) GROUP BY {group}node) {whole}"""


VIEWS = {
    "runs": f"""runs AS (
      SELECT *, start_time || '-' || lpad(k::VARCHAR, 8, '0') || '-' || name AS id,
        start_time || '-' || lpad(k::VARCHAR, 8, '0') || '-' || name
          || CASE WHEN status_code = 'F' THEN '-error' ELSE '' END AS folder
      FROM (SELECT *, strftime(end_ts - to_seconds(1 + k % 3600), {STAMP}) AS start_time,
              strftime(end_ts, {STAMP}) AS end_time
        FROM (SELECT o_orderkey AS k, o_orderstatus AS status_code, o_orderdate + to_seconds(o_orderkey % 86400) AS end_ts,
                CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'inference' END AS ptype,
                replace(lower(o_orderpriority), ' ', '-') AS name,
                floor(o_totalprice * 100)::BIGINT AS size_bytes,
                left(sha256((o_custkey % 50)::VARCHAR), 12) AS data_id,
                left(sha256('p' || (o_custkey % 7)), 12) AS param_id,
                left(md5(o_orderpriority), 12) AS code_id,
                o_custkey // 10 AS plan_id, o_orderkey % 10 <> 0 AS has_record, o_orderkey % 7 <> 0 AS has_plan
              FROM orders)))""",
    "ledger": """ledger AS (
      SELECT k, ptype, folder, plan_id, has_plan,
        CASE WHEN has_record THEN id ELSE '' END AS id, CASE WHEN has_record THEN data_id ELSE '' END AS data_id,
        CASE WHEN has_record THEN param_id ELSE '' END AS param_id,
        CASE WHEN has_record THEN code_id ELSE '' END AS code_id,
        CASE WHEN has_record THEN start_time ELSE '20000101T000000Z' END AS start_time,
        CASE WHEN has_record THEN end_time ELSE '20000101T000000Z' END AS end_time FROM runs)""",
    "scores": """scores AS (
      SELECT k, '20240101' AS date, '' AS file_path, 'n' || n AS note, result, score, '1.0' AS version,
        '{' || concat_ws(',', CASE WHEN f > 0 THEN '"F":' || round(f / n, 6) END,
          CASE WHEN n > f THEN '"O":' || round((n - f) / n, 6) END) || '}' AS probability
      FROM (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f,
              min(l_quantity) AS score, min(l_linestatus) AS result
            FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 <> 0 GROUP BY l_orderkey))""",
    "params": params_view("params", "true"),
    "base": params_view("base", "event_id % 3 <> 0"),
    "override": params_view("override", "event_id % 3 = 0"),
    "wide": """wide AS (
      SELECT plan_id, max(value) FILTER (step = 'view' AND name = 'k0') AS view__k0,
        max(value) FILTER (step = 'view' AND name = 'k1') AS view__k1,
        max(value) FILTER (step = 'view' AND name = 'k2') AS view__k2,
        max(value) FILTER (step = 'view' AND name = 'k3') AS view__k3,
        max(value) FILTER (step = 'purchase' AND name = 'k0') AS purchase__k0,
        max(value) FILTER (step = 'purchase' AND name = 'k1') AS purchase__k1
      FROM params WHERE pipeline = 'train' GROUP BY plan_id)""",
    "inference_runs": """inference_runs AS (
      SELECT i.*, CASE WHEN i.k % 5 = 1 THEN b.folder END AS wanted_train_id, i.k % 35 = 3 AS external_model
      FROM runs i LEFT JOIN runs b ON b.k = i.k - 1 WHERE i.ptype = 'inference')""",
    "linked": """linked AS (
      SELECT i.*, CASE WHEN i.external_model THEN 'load-external-model'
          WHEN i.wanted_train_id IS NOT NULL THEN i.wanted_train_id ELSE coalesce(t.train_id, 'none') END AS train_id
      FROM inference_runs i ASOF LEFT JOIN (
        SELECT name, end_ts, arg_max(id, folder) AS train_id FROM runs
        WHERE ptype = 'train' AND folder NOT LIKE '%-error%' GROUP BY name, end_ts) t
      ON i.name = t.name AND i.end_ts >= t.end_ts)""",
    "files": """files AS (
      SELECT doc_id, source AS base_dir, lang AS step, n_chars AS size, text AS content, ext,
        lpad(doc_id::VARCHAR, 8, '0') || ext AS name, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || ext AS path
      FROM (SELECT *, ['.py', '.csv', '.png', '.jpg', '.svg', '.txt'][doc_id % 6 + 1] AS ext FROM documents))""",
    "hashed": f"hashed AS (SELECT base_dir, path, {low64('sha256(content)')} AS hash64 FROM files)",
    "digests": f"""digests AS (
      SELECT base_dir, step, {low64("digest")} AS code_hash
      FROM ({tree("(SELECT * FROM files WHERE ext = '.py')", ["base_dir", "step"], ["path"], "md5(content)", "md5")}))""",
    "lines": f"""lines AS (
      SELECT user_id AS file, event_id AS line_no, event_type, ts, {LOG_T} AS t, {K_TEXT}::INT AS n,
        CASE event_type WHEN 'view' THEN '[' || {LOG_T} || '|SYS|INFO|run.py(1)|run()] current step: s' || ({K_TEXT}::INT % 5)
          WHEN 'click' THEN '[SHOW|' || {LOG_T} || '|USER|' || {K_TEXT}
          WHEN 'signup' THEN '[SHOW|' || {LOG_T} || '|SYS|' || {K_TEXT}
          WHEN 'error' THEN '[' || {LOG_T} || '|SYS|ERROR|load.py(2)|load()] failed'
          ELSE '[' || {LOG_T} || '|SYS|MSG|save.py(3)|save()] ' || CASE WHEN event_id % 97 = 0 THEN 'ok [ERROR] seen' ELSE 'ok' END
        END AS text FROM events)""",
    "reqs": """reqs AS (
      SELECT p_type AS step_no, p_partkey AS pos, CASE WHEN p_partkey % 50 = 0 THEN '# ' || package
          WHEN p_partkey % 51 = 0 THEN ''
          ELSE [package || '==' || p_size, package || '>=' || p_size, package || '<' || p_size, package,
            package || ' == ' || p_size, package || '~=' || p_size || '  # see <docs>',
            package || ' --force-reinstall', package || ' --index-url u' || (p_size % 5)][p_partkey % 8 + 1] END AS line
      FROM (SELECT *, replace(p_name, ' ', '-') AS package FROM part))""",
    "uris": r"""uris AS (
      SELECT page_id, ['s3://' || bare, '/' || bare, 'a/b/' || bare, './' || w, '~/' || w, w][page_id % 6 + 1] AS uri
      FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS bare,
              regexp_replace(url, '^.*/([a-z]+)/.*$', '\1') AS w FROM pages))""",
    "specs": """specs AS (
      SELECT p_partkey AS spec_id, ['string', 'int', 'float', 'single_selection', 'multi_selection'][p_size % 5 + 1] AS type,
        CASE WHEN p_size % 5 < 3 THEN NULL WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR ELSE p_size || ', ' || (p_size + 1) END AS selectable,
        CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_size || ' ,b' ELSE p_size::VARCHAR END AS dflt,
        CASE WHEN p_size % 5 >= 3 THEN NULL WHEN p_partkey % 10 = 0 THEN '1,2,3' WHEN p_partkey % 14 = 0 THEN 'a,b'
          WHEN p_partkey % 9 = 0 THEN '0.5, ' || p_size ELSE ' 1, ' || p_size END AS rng
      FROM part)""",
    "found_keys": f"""template AS (SELECT * FROM (VALUES {rows([(i, key) for i, key in enumerate(PLAN_KEYS)])}) t(pos, key)),
      found_keys AS (
        SELECT c_custkey AS plan_id, key FROM customer, template WHERE (c_custkey + pos) % 9 <> 0
        UNION ALL SELECT c_custkey, 'extra' FROM customer WHERE c_custkey % 8 = 0
        UNION ALL SELECT c_custkey, 'ui_args_detail' FROM customer WHERE c_custkey % 5 = 0)""",
    "steps": """steps AS (
      SELECT conv_id AS plan_id, pipeline, role AS step, name, value FROM (
        SELECT *, CASE WHEN turn % 2 = 0 THEN 'train' ELSE 'inference' END AS pipeline FROM conversations), LATERAL (
        SELECT 't' || turn AS name, length(text)::VARCHAR AS value WHERE role <> 'system'
        UNION ALL SELECT 'u' || turn, 'x' WHERE role <> 'system'
        UNION ALL SELECT NULL, NULL WHERE role = 'system')
      UNION ALL SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'train' ELSE 'inference' END, 'end', NULL, NULL FROM conversations)""",
    "base_paths": "",
    "requests": f"""requests AS (
      SELECT event_id AS request_id, user_id AS plan_id, event_type AS step, 'k' || (event_id % 4) AS name,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN {K_TEXT} || ',7' ELSE {K_TEXT} END AS value,
        CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 41 = 0 THEN '' ELSE 's3://lake/' || (user_id * 10 + event_id % 10) END AS dataset_uri,
        CASE WHEN event_id % 50 = 0 THEN 'E111' WHEN event_id % 41 = 0 THEN 'E122' END AS error_code
      FROM events)""",
    "served": """features AS (
        SELECT 's3://lake/' || o_custkey AS dataset_uri, count(*) AS n_rows FROM orders GROUP BY o_custkey),
      plan_base AS (
        SELECT plan_id, max(value) FILTER (step = 'view' AND name = 'k0') AS v0, max(value) FILTER (step = 'view' AND name = 'k1') AS v1,
          max(value) FILTER (step = 'click' AND name = 'k3') AS c3, count(*) FILTER (step = 'view') > 0 AS has_view,
          count(*) FILTER (step = 'click') > 0 AS has_click
        FROM base WHERE pipeline = 'inference' GROUP BY plan_id),
      overlaid AS (
        SELECT request_id, plan_id, dataset_uri, error_code,
          last_value(CASE WHEN step = 'view' AND name = 'k0' THEN value END IGNORE NULLS) OVER w AS v0,
          last_value(CASE WHEN step = 'view' AND name = 'k1' THEN value END IGNORE NULLS) OVER w AS v1,
          last_value(CASE WHEN step = 'click' AND name = 'k3' THEN value END IGNORE NULLS) OVER w AS c3
        FROM requests WHERE error_code IS NULL OR error_code <> 'E111'
        WINDOW w AS (PARTITION BY plan_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      effective AS (
        SELECT o.request_id, coalesce(o.error_code, CASE WHEN f.dataset_uri IS NULL THEN 'E141' END) AS error_code, f.n_rows,
          CASE WHEN b.has_view THEN coalesce(o.v0, b.v0) END AS v0, CASE WHEN b.has_view THEN coalesce(o.v1, b.v1) END AS v1,
          CASE WHEN b.has_click THEN coalesce(o.c3, b.c3) END AS c3
        FROM overlaid o LEFT JOIN plan_base b USING (plan_id) LEFT JOIN features f ON f.dataset_uri = o.dataset_uri),
      served AS (
        SELECT request_id, error_code, n_rows * num(v0) + num(c3) * 10 + num(v1) AS score FROM effective
        UNION ALL SELECT request_id, error_code, NULL FROM requests WHERE error_code = 'E111')""".replace(
        "num(v0)", "(CASE WHEN regexp_matches(v0, '^[0-9]+$') THEN v0::BIGINT ELSE 0 END)"
    )
    .replace("num(c3)", "(CASE WHEN regexp_matches(c3, '^[0-9]+$') THEN c3::BIGINT ELSE 0 END)")
    .replace("num(v1)", "(CASE WHEN regexp_matches(v1, '^[0-9]+$') THEN v1::BIGINT ELSE 0 END)"),
}


def paths_view(name: str, source: str) -> str:
    return f"""{name} AS (
      SELECT plan_id, pipeline, CASE name WHEN 'k0' THEN 'dataset_uri' WHEN 'k1' THEN 'artifact_uri'
        WHEN 'k2' THEN 'model_uri' ELSE 'log_uri' END AS path_key, arg_max({{'v': value}}, step).v AS uri
      FROM {source} GROUP BY ALL)"""


VIEWS["base_paths"] = paths_view("base_paths", "base")
VIEWS["override_paths"] = paths_view("override_paths", "override")


def sql(names: str, body: str) -> str:
    wanted = names.split()
    return ("WITH " + ",\n".join(VIEWS[name] for name in wanted) + "\n" if wanted else "") + body


HISTORY_BODY = f"""strftime(strptime(l.start_time, {STAMP}), {SHOWN}) AS start_time,
    strftime(strptime(l.end_time, {STAMP}), {SHOWN}) AS end_time,
    CASE WHEN l.folder LIKE '%-error%' THEN 'error' ELSE 'success' END AS status,
    s.score, coalesce(s.result, '') AS result, coalesce(s.note, '') AS note, coalesce(s.probability, '{{}}') AS probability,
    coalesce(s.version, '') AS version, coalesce(s.date, '') AS date, l.id, l.data_id, l.code_id, l.param_id"""

LINE_TOTALS = """SELECT l_returnflag, l_linestatus, sum(floor(l_extendedprice * 100))::BIGINT AS cents,
    sum(floor(l_quantity))::BIGINT AS quantity, count(*) AS n_lines{more}
  FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL"""



def retention(runs: str, gone: str) -> str:
    """CTEs up to `gone`, the runs that go of the table `runs`."""
    return f"""{gone}_totals AS (SELECT ptype, sum(size_bytes)::HUGEINT AS size FROM {runs} GROUP BY ptype),
  {gone}_whole AS (SELECT sum(size)::HUGEINT AS total FROM {gone}_totals),
  {gone}_ordered AS (
    SELECT ptype, folder, size_bytes, coalesce(sum(size_bytes) OVER (PARTITION BY ptype
      ORDER BY start_time, sha256(folder), folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS older
    FROM {runs}),
  {gone} AS (
    SELECT ptype, folder, size_bytes FROM {gone}_ordered JOIN {gone}_totals USING (ptype), {gone}_whole
    WHERE total > {RETENTION_LIMIT} AND older * total < size * (total - {RETENTION_LIMIT}))"""


LEVEL_OF = "CASE event_type WHEN 'view' THEN 'INFO' WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'MSG' END"

ORACLE: dict[str, str] = {
    "a1_load_tagged": sql("runs", "SELECT k, folder, size_bytes, left(folder, 4) AS year, ptype AS base_dir FROM runs"),
    "a2_file_manifest": sql(
        "files",
        "SELECT path, size, base_dir || '/' || step AS folder, name, ext FROM files WHERE ext IN ('.jpg', '.jpeg', '.png', '.svg')",
    ),
    "a2_file_manifest_scan": """
      SELECT 'lang=' || lang AS folder, '.csv' AS ext, 1::BIGINT AS n_files, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS size
      FROM documents GROUP BY lang""",
    "a3_scan_run_records": f"""
      WITH r AS (SELECT c_custkey AS k, c_name, strftime(to_timestamp(1704067200 + c_custkey) AT TIME ZONE 'UTC', {STAMP}) AS t,
          strftime(to_timestamp(1704067200 + c_custkey) AT TIME ZONE 'UTC', {STAMP}) || '-' || lpad(c_custkey::VARCHAR, 8, '0') || '-' || lower(c_mktsegment) AS folder
        FROM customer)
      SELECT folder, CASE WHEN k % 10 <> 0 THEN folder ELSE '' END AS id,
        CASE WHEN k % 10 <> 0 THEN left(sha256(c_name), 12) ELSE '' END AS data_id, '' AS param_id,
        CASE WHEN k % 10 <> 0 THEN t ELSE '20000101T000000Z' END AS start_time,
        CASE WHEN k % 10 <> 0 THEN {low64('sha256(c_name)')} END AS data_hash FROM r""",
    "a4_parse_log": sql(
        "lines",
        f"""SELECT file, line_no,
          CASE WHEN event_type IN ('view', 'error', 'purchase') THEN replace(t, ',', '.') END AS ts,
          CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 'SYS' END AS service, {LEVEL_OF} AS level,
          CASE event_type WHEN 'view' THEN 'run.py' WHEN 'error' THEN 'load.py' WHEN 'purchase' THEN 'save.py' END AS source,
          CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 END AS source_line,
          CASE event_type WHEN 'view' THEN 'run' WHEN 'error' THEN 'load' WHEN 'purchase' THEN 'save' END AS func,
          CASE event_type WHEN 'view' THEN 'current step: s' || (n % 5) WHEN 'error' THEN 'failed'
            WHEN 'purchase' THEN CASE WHEN line_no % 97 = 0 THEN 'ok [ERROR] seen' ELSE 'ok' END END AS message
        FROM lines""",
    ),
    "a5_profile_uris": sql(
        "uris",
        """SELECT kind, bucket, count(*) AS n_uris, count(*) FILTER (kind = 'relative' AND page_id % 6 >= 3) AS n_rejected,
             count(*) FILTER (kind = 's3' AND uri NOT LIKE 's3:/%') AS n_suspicious, count(*) FILTER (key = '') AS n_without_key
           FROM (SELECT page_id, uri, CASE WHEN contains(uri, 's3:/') THEN 's3' WHEN uri LIKE '/%' THEN 'absolute' ELSE 'relative' END AS kind,
               CASE WHEN uri LIKE 's3://%' THEN regexp_extract(uri, '^s3://([^/?#]*)', 1) ELSE '' END AS bucket,
               ltrim(regexp_extract(CASE WHEN uri LIKE 's3://%' THEN regexp_replace(uri, '^s3://[^/?#]*', '') ELSE uri END, '^[^?#]*'), '/') AS key
             FROM uris) GROUP BY kind, bucket""",
    ),
    "b1_content_hash64": f"SELECT doc_id, {low64('sha256(text)')} AS hash64 FROM documents",
    "b2_dataset_id": sql(
        "files hashed",
        f"""SELECT base_dir, left(digest, 12) AS data_id, n_rows AS n_files FROM ({tree("hashed", ["base_dir"], ["path"], "hash64")})
           UNION ALL SELECT '*', left(digest, 12), n_rows FROM ({tree("hashed", [], ["path"], "hash64")})""",
    ),
    "b3_param_id": sql(
        "params",
        "SELECT plan_id, left(digest, 12) AS param_id FROM ("
        + tree(
            "params",
            ["plan_id"],
            ["pipeline", "step", "name"],
            "pipeline || '.' || step || '.' || name || '=' || coalesce(value, 'None') || chr(10)",
        )
        + ")",
    ),
    "b4_group_digest": sql("files digests", "SELECT base_dir, step, code_hash FROM digests"),
    "b5_code_id": sql(
        "files digests",
        """SELECT base_dir, left(md5(string_agg(code_hash, '' ORDER BY step DESC)), 12) AS code_id,
             string_agg(step || '=' || code_hash, ',' ORDER BY step) AS steps FROM digests GROUP BY base_dir""",
    ),
    "c1_attach_summary": sql(
        "runs scores",
        """SELECT folder, ptype, coalesce(date, '') AS date, coalesce(file_path, '') AS file_path, coalesce(note, '') AS note,
             coalesce(probability, '{}') AS probability, coalesce(result, '') AS result, score, coalesce(version, '') AS version
           FROM runs LEFT JOIN scores USING (k)""",
    ),
    "c2_attach_params": sql(
        "runs params wide",
        "SELECT folder, plan_id, has_plan, "
        + ", ".join(
            f"CASE WHEN has_plan THEN {c} ELSE 'none' END AS {c}"
            for c in ("view__k0", "view__k1", "view__k2", "view__k3", "purchase__k0", "purchase__k1")
        )
        + " FROM runs LEFT JOIN wide USING (plan_id)",
    ),
    "c3_run_status": sql(
        "runs", "SELECT folder, CASE WHEN folder LIKE '%-error%' THEN 'error' ELSE 'success' END AS status FROM runs"
    ),
    "c4_shape_columns": sql(
        "runs",
        """SELECT id, NULL::VARCHAR AS status, start_time, NULL::VARCHAR AS end_time, NULL::VARCHAR AS score, NULL::VARCHAR AS result,
             NULL::VARCHAR AS note, NULL::VARCHAR AS probability, NULL::VARCHAR AS version, NULL::VARCHAR AS data_id, code_id,
             NULL::VARCHAR AS param_id, NULL::VARCHAR AS train_id, size_bytes, folder FROM runs""",
    ),
    "c5_display_times": sql(
        "runs ledger",
        f"""SELECT folder, strftime(strptime(start_time, {STAMP}), {SHOWN}) AS start_time,
              strftime(strptime(end_time, {STAMP}), {SHOWN}) AS end_time FROM ledger""",
    ),
    "c6_filter_ids": sql(
        "runs",
        f"SELECT folder, data_id, param_id, code_id FROM runs WHERE data_id = '{id_of('7')}' AND param_id = '{id_of('p3')}'",
    ),
    "c7_sort_recent": sql(
        "runs ledger", "SELECT folder, end_time, row_number() OVER (ORDER BY end_time DESC, folder) - 1 AS rank FROM ledger"
    ),
    "c8_check_steps": sql(
        "steps",
        """SELECT plan_id, w.step FROM (SELECT DISTINCT plan_id FROM steps), (VALUES ('system'), ('assistant'), ('end'), ('score')) w(step)
           WHERE (plan_id, w.step) NOT IN (SELECT (plan_id, step) FROM steps)""",
    ),
    "c9_link_train_run": sql("runs inference_runs linked", "SELECT folder, name, end_time, train_id FROM linked"),
    "c10_history": sql(
        "runs ledger scores params wide",
        f"SELECT l.folder, {HISTORY_BODY}, "
        + ", ".join(
            f"CASE WHEN has_plan THEN {c} ELSE 'none' END AS {c}"
            for c in ("view__k0", "view__k1", "view__k2", "view__k3", "purchase__k0", "purchase__k1")
        )
        + " FROM ledger l LEFT JOIN scores s USING (k) LEFT JOIN wide USING (plan_id) WHERE l.ptype = 'train' ORDER BY l.end_time DESC, l.folder",
    ),
    "c10_history_inference": sql(
        "runs scores inference_runs linked",
        f"SELECT {HISTORY_BODY}, l.train_id FROM linked l LEFT JOIN scores s USING (k) WHERE l.data_id = '{id_of('7')}'",
    ),
    "d1_retention_plan": "WITH " + VIEWS["runs"] + ", " + retention("runs", "gone") + " SELECT * FROM gone",
    "d2_show_increments": sql(
        "lines",
        """SELECT file, line_no, class, text, coalesce((micros - lag(micros) OVER (PARTITION BY file, class ORDER BY line_no)) / 1000000, 0)::DOUBLE AS seconds
           FROM (SELECT file, line_no, text, CASE event_type WHEN 'click' THEN 'USER' ELSE 'SYS' END AS class,
               epoch_us(date_trunc('milliseconds', ts)) AS micros FROM lines WHERE event_type IN ('click', 'signup'))""",
    ),
    "d3_error_tail": sql(
        "lines",
        """SELECT file, line_no, text, is_error, CASE WHEN is_error THEN coalesce(step, '') END AS error_step FROM (
             SELECT *, bool_or(is_error) OVER w AS started, last_value(named IGNORE NULLS) OVER w AS step FROM (
               SELECT file, line_no, text, event_type = 'error' OR (event_type = 'purchase' AND line_no % 97 = 0) AS is_error,
                 CASE WHEN event_type = 'view' THEN 's' || (n % 5) END AS named FROM lines)
             WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
           WHERE started""",
    ),
    "d4_first_wins": sql(
        "reqs",
        r"""SELECT section, key, step_no, pos, requirement FROM (
              SELECT *, row_number() OVER (PARTITION BY section, key, CASE WHEN section = 'package' THEN '' ELSE step_no END
                ORDER BY step_no, pos) AS place FROM (
                SELECT step_no, pos, section, CASE WHEN section <> 'package' THEN line
                    WHEN contains(bare, '<') THEN rtrim(split_part(bare, '<', 1), '~!')
                    WHEN contains(bare, '>') THEN rtrim(split_part(bare, '>', 1), '~!')
                    ELSE rtrim(split_part(bare, '=', 1), '~!') END AS key,
                  CASE WHEN section = 'package' THEN bare ELSE line END AS requirement
                FROM (SELECT *, split_part(replace(line, ' ', ''), '#', 1) AS bare,
                    CASE WHEN contains(line, '--index-url') THEN 'link_install'
                      WHEN contains(line, '--force-reinstall') THEN 'force-reinstall' ELSE 'package' END AS section FROM reqs)
                WHERE section <> 'package' OR bare <> '')) WHERE place = 1""",
    ),
    "d5_stage_durations": """
      WITH marks AS (SELECT event_id // 5 AS run, epoch_us(max(ts) FILTER (event_id % 5 = 0)) AS s0, epoch_us(max(ts) FILTER (event_id % 5 = 1)) AS s1,
          epoch_us(max(ts) FILTER (event_id % 5 = 2)) AS s2, epoch_us(max(ts) FILTER (event_id % 5 = 3)) AS s3,
          epoch_us(max(ts) FILTER (event_id % 5 = 4)) AS s4 FROM events GROUP BY event_id // 5)
      SELECT run, ((s1 - s0 + 500) // 1000) / 1000 AS setup_seconds, ((s2 - s1 + 500) // 1000) / 1000 AS load_seconds,
        ((s3 - s2 + 500) // 1000) / 1000 AS run_seconds, ((s4 - s3 + 500) // 1000) / 1000 AS save_seconds,
        ((s4 - s0 + 500) // 1000) / 1000 AS total_seconds FROM marks""",
    "d6_latest_by_key": sql(
        "files",
        """SELECT base_dir, path, size, doc_id FROM files WHERE contains(path, '.py')
           QUALIFY row_number() OVER (PARTITION BY base_dir ORDER BY path DESC) = 1""",
    ),
    "e1_check_outputs": sql(
        "files",
        """SELECT run, n_files, reason = '' AS ok, reason FROM (
             SELECT run, n AS n_files, CASE WHEN n NOT IN (1, 2) THEN 'file count'
                 WHEN n = 1 AND NOT list_contains(['.csv', '.jpg', '.jpeg', '.png', '.svg'], exts[1]) THEN 'extension'
                 WHEN n = 2 AND NOT list_contains([['.csv', '.jpg'], ['.csv', '.jpeg'], ['.csv', '.png'], ['.csv', '.svg']], list_sort(list_distinct(exts)))
                   THEN 'pair' ELSE '' END AS reason
             FROM (SELECT run, count(f.doc_id) AS n, list(f.ext) AS exts
                   FROM (SELECT DISTINCT doc_id // 3 AS run FROM documents)
                   LEFT JOIN (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels)) f ON f.doc_id // 3 = run GROUP BY run))""",
    ),
    "e2_check_summary": sql("runs scores", "SELECT folder FROM runs WHERE k NOT IN (SELECT k FROM scores)"),
    "e3_check_keys": sql(
        "found_keys",
        """SELECT c_custkey AS plan_id, CASE WHEN key LIKE 'control:%' THEN 'defaulted' ELSE 'missing' END AS problem, key
             FROM customer, template WHERE (c_custkey, key) NOT IN (SELECT (plan_id, key) FROM found_keys)
           UNION ALL SELECT plan_id, 'not_allowed', key FROM found_keys
             WHERE key NOT IN (SELECT key FROM template) AND key <> 'ui_args_detail'""",
    ),
    "e4_match_steps": sql(
        "base override",
        """SELECT b.plan_id, b.pipeline, coalesce(len(a.steps), 0)::BIGINT AS n_param_steps, len(b.steps)::BIGINT AS n_source_steps,
             (len(list_filter(b.steps, lambda x: NOT list_contains(coalesce(a.steps, []), x)))
               + len(list_filter(coalesce(a.steps, []), lambda x: NOT list_contains(b.steps, x))))::BIGINT AS n_unmatched,
             coalesce(a.steps, []) = b.steps AS matches
           FROM (SELECT plan_id, pipeline, list_sort(list(DISTINCT step)) AS steps FROM base GROUP BY ALL) b
           LEFT JOIN (SELECT plan_id, pipeline, list_sort(list(DISTINCT step)) AS steps FROM override GROUP BY ALL) a
             ON a.plan_id = b.plan_id AND a.pipeline = b.pipeline""",
    ),
    "e5_find_duplicates": sql(
        "uris",
        """SELECT base_name, count(*) AS n FROM (SELECT regexp_extract(rtrim(uri, '/'), '[^/]*$') AS base_name FROM uris)
           GROUP BY base_name HAVING count(*) > 1""",
    ),
    "e6_check_text": """
      SELECT doc_id, name, strlen(text) < 5000 AS bytes_ok, length(text) < 500 AS chars_ok,
        NOT contains(name, '_') AS name_ok, strlen(name) <= 100 AS name_bytes_ok
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN source || '_' || lang ELSE source || '-' || lang END AS name FROM documents)""",
    "e7_check_arg_specs": sql(
        "specs",
        r"""SELECT spec_id, type, concat_ws(';', CASE WHEN dflt = '' AND type <> 'string' THEN 'default required' END,
              CASE WHEN type = 'single_selection' AND contains(dflt, ',') THEN 'one default' END,
              CASE WHEN type = 'multi_selection' AND dflt <> '' AND NOT contains(dflt, ',') THEN 'several defaults' END,
              CASE WHEN NOT contains(selectable, ',') THEN 'several selectable' END,
              CASE WHEN len(string_split(rng, ',')) <> 2 THEN 'two range ends' END,
              CASE WHEN type IN ('string', 'int') AND NOT regexp_full_match(rng, '[\s]*[0-9]+[\s]*(,[\s]*[0-9]+[\s]*)*') THEN 'whole range' END,
              CASE WHEN type = 'float' AND contains(rng, 'a') THEN 'number range' END) AS violations
            FROM specs""",
    ),
    "e8_check_enum": "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL",
    "e9_check_registry": """
      WITH known AS (SELECT s_name AS name, s_suppkey % 4 + 1 AS newest FROM supplier),
        new AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'new-' || s_name END AS name, s_suppkey % 4 < 2 AS is_update FROM supplier)
      SELECT new.name, is_update, CASE WHEN is_update AND newest IS NULL THEN 'unknown name'
          WHEN NOT is_update AND newest IS NOT NULL THEN 'name exists' ELSE '' END AS problem,
        CASE WHEN is_update THEN newest + 1 WHEN newest IS NULL THEN 1 END AS next_version
      FROM new LEFT JOIN known ON known.name = new.name""",
    "f1_flatten_params": sql("steps", "SELECT plan_id, pipeline, step, name, value FROM steps"),
    "f2_fill_defaults": sql(
        "found_keys",
        f"""SELECT c_custkey AS plan_id, d.key, CASE WHEN f.key IS NULL THEN d.value ELSE 'v' || (c_custkey % 10) END AS value,
              f.key IS NULL AS defaulted
            FROM customer CROSS JOIN (VALUES {rows(CONTROL_DEFAULTS.items())}) d(key, value)
            LEFT JOIN found_keys f ON f.plan_id = c_custkey AND f.key = 'control:' || d.key""",
    ),
    "f3_overlay_params": sql(
        "base override",
        """, o AS (SELECT plan_id, pipeline, step, name, array_to_string([trim(x) FOR x IN string_split(value, ',')], ',') AS value
             FROM override WHERE value <> '' AND (plan_id, pipeline, step) IN (SELECT (plan_id, pipeline, step) FROM base))
           SELECT coalesce(b.plan_id, o.plan_id) AS plan_id, coalesce(b.pipeline, o.pipeline) AS pipeline, coalesce(b.step, o.step) AS step,
             coalesce(b.name, o.name) AS name, coalesce(o.value, b.value) AS value,
             CASE WHEN o.name IS NULL THEN 'base' WHEN b.name IS NULL THEN 'added' ELSE 'override' END AS origin
           FROM base b FULL JOIN o ON b.plan_id = o.plan_id AND b.pipeline = o.pipeline AND b.step = o.step AND b.name = o.name""",
    ),
    "f4_overlay_paths": sql(
        "base override base_paths override_paths",
        """SELECT b.plan_id, b.pipeline, b.path_key, CASE WHEN o.path_key IS NULL OR (o.path_key = 'model_uri' AND o.pipeline = 'train')
               THEN b.uri ELSE o.uri END AS uri,
             CASE WHEN o.path_key = 'dataset_uri' AND o.pipeline = 'inference' AND coalesce(o.uri, '') = '' THEN 'E122' END AS error_code
           FROM base_paths b LEFT JOIN override_paths o ON b.plan_id = o.plan_id AND b.pipeline = o.pipeline AND b.path_key = o.path_key""",
    ),
    "f5_clean_args": sql(
        "params",
        """SELECT plan_id, pipeline, step, name, array_to_string([trim(x) FOR x IN string_split(value, ',')], '|') AS parts,
             len(string_split(value, ','))::INT AS n_parts, contains(value, ',') AS is_list FROM params WHERE value <> ''""",
    ),
    "f6_infer_types": sql(
        "params",
        r"""SELECT plan_id, step, n_bool, n_int, n_float, n_string, CASE WHEN n = 0 THEN NULL WHEN n_bool = n THEN 'bool'
              WHEN n_string > 0 OR n_bool > 0 THEN 'string' WHEN n_float > 0 THEN 'float' ELSE 'int' END AS type
            FROM (SELECT plan_id, step, count(value) AS n, count(*) FILTER (value IN ('True', 'False')) AS n_bool,
                count(*) FILTER (regexp_full_match(value, '\s*[+-]?[0-9]+\s*')) AS n_int,
                count(*) FILTER (regexp_full_match(value, '\s*[+-]?([0-9]*\.[0-9]+|[0-9]+\.)\s*')) AS n_float,
                count(*) FILTER (value = '' OR contains(value, ',')) AS n_string FROM params GROUP BY plan_id, step)""",
    ),
    "f7_select_ui_args": sql(
        "base override",
        """SELECT plan_id, step, name, value, true AS known FROM base WHERE (plan_id, step, name) IN (SELECT (plan_id, step, name) FROM override)
           UNION ALL SELECT DISTINCT plan_id, step, name, NULL, false FROM override
             WHERE (plan_id, step, name) NOT IN (SELECT (plan_id, step, name) FROM base)""",
    ),
    "f8_diff_plans": sql(
        "base override",
        """SELECT * FROM (SELECT coalesce(b.plan_id, o.plan_id) AS plan_id, coalesce(b.pipeline, o.pipeline) AS pipeline,
               coalesce(b.step, o.step) AS step, coalesce(b.name, o.name) AS name,
               CASE WHEN b.name IS NULL THEN 'added' WHEN o.name IS NULL THEN 'removed' WHEN b.value IS DISTINCT FROM o.value THEN 'changed' END AS change,
               b.value AS old_value, o.value AS new_value
             FROM base b FULL JOIN override o ON b.plan_id = o.plan_id AND b.pipeline = o.pipeline AND b.step = o.step AND b.name = o.name)
           WHERE change IS NOT NULL""",
    ),
    "f9_merge_plan": sql(
        "base override",
        "SELECT * FROM base WHERE pipeline <> 'train' UNION ALL SELECT * FROM override WHERE pipeline = 'train'",
    ),
    "g1_run_steps": LINE_TOTALS.format(more=", 2 AS used"),
    "g2_user_step": """SELECT l_returnflag, floor(l_quantity / 10)::BIGINT AS band, count(*) AS n_lines FROM lineitem
      WHERE round(l_discount * 100) >= 5 GROUP BY ALL""",
    "g3_interface_mode": LINE_TOTALS.format(more=", 2 AS used"),
    "g4_select_xy": "SELECT l_quantity, l_extendedprice, l_discount, l_linestatus, l_returnflag FROM lineitem",
    "g5_fit_step": """
      SELECT 100::INT AS n_trees, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels, 4::INT AS n_features,
        1.0::DOUBLE AS importance FROM lineitem WHERE l_orderkey % 5 <> 0""",
    "g6_score_step": """
      SELECT l_returnflag AS truth, count(*) AS n_lines, count(*) AS n_predicted, 1.0::DOUBLE AS probability
      FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_returnflag""",
    "g7_summarize_scores": """
      WITH c AS (SELECT lang AS run, quality || '/' || toxic AS result, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
        s AS (SELECT *, n / sum(n) OVER (PARTITION BY run) AS share FROM c)
      SELECT run, '20240101' AS date, 'n' || sum(n) AS note, arg_max(result, share) AS result, round(max(share), 6) AS score, '1.0' AS version,
        '{' || string_agg('"' || result || '":' || round(share, 6), ',' ORDER BY result) || '}' AS probability
      FROM (SELECT * FROM s ORDER BY run, result) GROUP BY run""",
    "g8_pick_model": sql(
        "runs inference_runs",
        """SELECT i.wanted_train_id, i.folder, CASE WHEN t.folder IS NOT NULL THEN 'history/train/' || t.folder || '/models/' END AS model_path
           FROM inference_runs i LEFT JOIN runs t ON t.folder = i.wanted_train_id AND t.ptype = 'train' AND t.has_record
           WHERE i.wanted_train_id IS NOT NULL""",
    ),
    "h1_request_stream": sql(
        "requests",
        """SELECT request_id, request_id AS seq, plan_id, error_code, dataset_uri,
             CASE WHEN error_code IS DISTINCT FROM 'E111' THEN step END AS steps FROM requests""",
    ),
    "h1_queue_source": sql(
        "requests",
        "SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY request_id)::INTEGER AS place, error_code, dataset_uri FROM requests",
    ),
    "h2_serve": sql(
        "base requests served",
        """SELECT request_id, CASE WHEN error_code IS NULL THEN 'success' ELSE 'fail' END AS status,
             coalesce(error_code, '{"score":' || score || ',"result":"' || CASE WHEN score >= 200 THEN 'high' ELSE 'low' END || '"}') AS message
           FROM served""",
    ),
    "h3_result_sinks": sql(
        "base requests served",
        """, coded AS (
             SELECT request_id, score, coalesce(error_code, CASE WHEN score % 11 = 0 THEN 'E161' END) AS early FROM served
           ), late AS (
             SELECT *, coalesce(early, CASE WHEN score % 7 = 0 OR score % 5 = 0 THEN 'E162' END) AS code FROM coded
           ), files AS (SELECT request_id, score % 3 + 1 AS n_files FROM late WHERE code IS NULL)
           SELECT request_id, channel, CASE WHEN c.code IS NULL THEN 'success' ELSE 'fail' END AS status, c.code, n_files
           FROM (SELECT request_id, 'inference_summary' AS channel, early AS code FROM late
                 UNION ALL SELECT request_id, 'inference_artifacts', code FROM late) c LEFT JOIN files USING (request_id)""",
    ),
    "h4_route_failures": f"""
      SELECT event_id AS request_id, channel, 'fail' AS status,
        ['E111', 'E112', 'E121', 'E122', 'E131', 'E132', 'E141', 'E151', 'E152', 'E161', 'E162', 'E998', 'E999'][event_id % 13 + 1] AS message
      FROM events, (VALUES ('inference_summary'), ('inference_artifacts')) c(channel)
      WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND channel = 'inference_artifacts')""",
    "h5_status_stream": "SELECT user_id AS run, max(event_id) AS seq, arg_max(CASE event_type "
    + " ".join(f"WHEN '{kind}' THEN '{status}'" for kind, status in STATUSES.items())
    + " END, event_id) AS status FROM events GROUP BY user_id",
    "h6_enrich_errors": f"""
      WITH e AS (SELECT event_id AS request_id, ['E111', 'E112', 'E121', 'E122', 'E131', 'E132', 'E141', 'E151', 'E152', 'E161', 'E162', 'E998',
          'E999'][event_id % 13 + 1] AS code FROM events)
      SELECT request_id, code, error_name, comment FROM e LEFT JOIN (VALUES {rows(ERROR_CODES)}) t(code, error_name, comment) USING (code)""",
    "i1_write_output": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "i2_write_artifacts": """
      SELECT l_orderkey, l_partkey, l_suppkey, 'output' AS area FROM lineitem
      UNION ALL SELECT l_orderkey, max(l_partkey), max(l_suppkey), 'score' FROM lineitem GROUP BY l_orderkey""",
    "i3_append_run": sql("runs", "SELECT ptype, id, folder, folder LIKE '%-error%' AS failed FROM runs"),
    "i4_replace_prefix": """
      SELECT role AS name, 'v1' AS version, CASE WHEN turn % 2 = 0 THEN 'train' ELSE 'inference' END AS pipeline, 'data' AS area, conv_id,
        CASE WHEN role = 'user' THEN turn + 100 ELSE turn END AS turn
      FROM conversations, range(2) copy(c) WHERE c = 0 OR role = 'system'""",
    "i5_apply_retention": "WITH "
    + VIEWS["runs"]
    + f", early AS (SELECT * FROM runs WHERE start_time < '{RETENTION_HALF}'), "
    + retention("early", "gone_first")
    + f""", later AS (SELECT * FROM runs WHERE start_time >= '{RETENTION_HALF}' OR folder NOT IN (SELECT folder FROM gone_first)), """
    + retention("later", "gone_then")
    + " SELECT ptype, folder, size_bytes FROM later WHERE folder NOT IN (SELECT folder FROM gone_then)",
}
ORACLE["b2_renewed_id"] = f"SELECT * FROM ({ORACLE['b2_dataset_id']}) WHERE base_dir <> '*'"
